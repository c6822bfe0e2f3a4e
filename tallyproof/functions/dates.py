"""Strict dates out of text. NULL means "not a real calendar day in this format"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.config import DD_MM
from tallyproof.functions.text import strip


def real_day(year: Column, month: Column, day: Column) -> Column:
    """NULL unless the three numbers name a day of the calendar, years 1 to 9999."""
    in_reach = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    days_in_month = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(in_reach & (day <= days_in_month), F.make_date(year, month, day))


def whole_numbers(c: Column, mark: str) -> list[Column]:
    """The three whole numbers between the marks; NULLs if there are not exactly three parts."""
    text = strip(c)
    three = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit(""))) == 2
    parts = [F.substring_index(text, mark, 1), F.substring_index(F.substring_index(text, mark, 2), mark, -1), F.substring_index(text, mark, -1)]
    return [F.when(three, part.try_cast("int")) for part in parts]


def with_both_readings(df: DataFrame, text: str, date_format: str, day: str, other_day: str, filtered: bool = False) -> DataFrame:
    """Adds the date under the given slash format and under the other one, taking the text apart once.

    `filtered` tells that rows will be chosen by these dates: the numbers then come out of an explode, since a filter put below
    the columns it names would take the text apart again for each of its parts.
    """
    numbers = dict(zip(("n1", "n2", "n3"), whole_numbers(F.col(text), "/")))
    first, second, year = F.col("n1"), F.col("n2"), F.col("n3")
    day_first, month_first = real_day(year, second, first), real_day(year, first, second)
    given, other = (day_first, month_first) if date_format == DD_MM else (month_first, day_first)
    if filtered:
        parts = F.struct(*[n.alias(name) for name, n in numbers.items()])
        apart = df.select("*", F.explode(F.array(parts)).alias("_parts")).select(*df.columns, "_parts.*")
    else:
        apart = df.withColumns(numbers)
    return apart.withColumns({day: given, other_day: other}).drop(*numbers)


def slash_date(c: Column, date_format: str = DD_MM) -> Column:
    first, second, year = whole_numbers(c, "/")
    return real_day(year, second, first) if date_format == DD_MM else real_day(year, first, second)


def rate_date(c: Column, date_format: str = DD_MM) -> Column:
    """Effective dates come as year-month-day or as slash dates."""
    return F.coalesce(real_day(*whole_numbers(c, "-")), slash_date(c, date_format))


def is_ambiguous(day_first: Column, month_first: Column) -> Column:
    """Both readings exist and mean different days."""
    return F.coalesce(day_first != month_first, F.lit(False))


def proves(this: Column, other: Column) -> Column:
    """The text is a date in this format only."""
    return this.isNotNull() & other.isNull()


def looks_ambiguous(c: Column) -> Column:
    """The looser profile test: first two of three parts are whole numbers up to 12."""
    parts = F.split(c, "/")
    small = [F.trim(F.get(parts, F.lit(i))).try_cast("int") <= 12 for i in (0, 1)]
    return F.coalesce((F.size(parts) == 3) & small[0] & small[1], F.lit(False))


def month_bucket(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM"), F.lit(""))


def as_slash(d: Column, date_format: str = DD_MM) -> Column:
    return F.date_format(d, "dd/MM/yyyy" if date_format == DD_MM else "MM/dd/yyyy")
