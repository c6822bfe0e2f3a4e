"""Exact money: text to decimal, conversion, cents."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyproof.functions.text import NUMBER_PATTERN

RATE = "decimal(18,10)"
AMOUNT = "decimal(25,6)"
MONEY = "decimal(38,2)"
#: Stands for a rate with more digits than RATE has, so that it takes part in the lookup and only the figures that need it are blocked.
LOST_RATE = Decimal("-99999999.9999999999")


def _multiplier(value) -> tuple[Decimal, int, int]:
    m = Decimal(str(value)).normalize()
    _, digits, exponent = m.as_tuple()
    if exponent > 0:
        m, digits, exponent = m.quantize(Decimal(1)), digits + (0,) * exponent, 0
    scale = -exponent
    return m, max(len(digits), scale), scale


def _scaled(text: Column, multiplier) -> Column:
    """Text times the unit multiplier, in a type whose product still multiplies exactly with a rate."""
    m, precision, scale = _multiplier(multiplier)
    if m == 1:
        return text.try_cast(AMOUNT)
    # the narrower the multiplier, the more digits are left for the amount
    narrow = text.try_cast(f"decimal({24 - precision},{6 - scale})")
    return (narrow * F.lit(m).cast(f"decimal({precision},{scale})")).cast(AMOUNT)


def amount_or_null(text: Column, multiplier=1, commas: bool = False) -> Column:
    """Decimal out of stripped text; NULL if unreadable."""
    return _scaled(F.replace(text, F.lit(","), F.lit("")) if commas else text, multiplier)


def amount_or_zero(text: Column, multiplier=1) -> Column:
    """An unreadable amount counts as nothing; the row stays."""
    return F.coalesce(amount_or_null(text, multiplier), F.lit(0).cast(AMOUNT))


def _problem(text: Column, held: Column, scale: int) -> Column:
    decimals = F.length(F.regexp_extract(text, r"\.([0-9]*?)0*$", 1))
    return (
        F.when(~text.rlike(NUMBER_PATTERN), "unreadable")
        .when(held.isNull(), "too_large")
        .when((decimals > scale) | (text.try_cast("decimal(38,18)") != held), "too_precise")
        .otherwise("ok")
    )


def amount_problem(text: Column) -> Column:
    """Why stripped text cannot be taken digit for digit: unreadable, too_precise, too_large, or ok."""
    return _problem(text, text.try_cast(AMOUNT), 6)


def loses_digits(text: Column, multiplier=1) -> Column:
    """A number with more digits than amounts have here. Only long or exponent forms are looked at closely.

    Lengths tell most texts that cannot be such a form, without a pattern.
    """
    m, precision, scale = _multiplier(multiplier)
    kind, whole, decimals = (AMOUNT, 19, 6) if m == 1 else (f"decimal({24 - precision},{6 - scale})", 18 - precision + scale, 6 - scale)
    size, point = F.octet_length(text), F.instr(text, ".")
    long = (size > whole) | ((point > 0) & (size - point > decimals)) | text.contains("e") | text.contains("E")
    suspect = long & text.rlike(rf"[0-9]{{{whole + 1}}}|\.[0-9]{{{decimals + 1}}}|[0-9.][eE]")
    return F.coalesce(suspect, F.lit(False)) & _problem(text, text.try_cast(kind), decimals).isin("too_large", "too_precise")


def rate_or_null(text: Column) -> Column:
    """Rate out of stripped text, NULL if unreadable, LOST_RATE if it has more digits than RATE."""
    held = text.try_cast(RATE)
    lost = ~text.contains("_") & _problem(text, held, 10).isin("too_large", "too_precise")
    return F.when(lost, F.lit(LOST_RATE).cast(RATE)).otherwise(held)


def rate_is_lost(rate: Column) -> Column:
    return F.coalesce(rate == F.lit(LOST_RATE).cast(RATE), F.lit(False))


def value_is_lost(amount: Column, rate: Column) -> Column:
    """No figure is right with this row: its rate has too many digits. Nothing at any rate is nothing."""
    return rate_is_lost(rate) & (amount != 0)


def kept_rate(rate: Column) -> Column:
    """The rate as shown in results: NULL if it has too many digits."""
    return F.when(~rate_is_lost(rate), rate)


def convert(amount: Column, rate: Column) -> Column:
    """Row value in the reporting currency, rounded half up to cents; no rate, or one of too many digits, gives 0.00.

    An amount below a milliard is multiplied as it is. Others have 43 digits together with the rate, so thousands and the
    rest are multiplied apart; what lies beyond the seventh decimal of the rest cannot change a rounding to cents and is cut off.
    """
    factor, size = F.coalesce(kept_rate(rate), F.lit(0)).cast(RATE), F.abs(amount).cast(AMOUNT)
    plain = F.round(amount.try_cast("decimal(15,6)") * factor, 2).cast("decimal(29,2)")
    thousands = F.floor(size * F.lit(Decimal("0.001"))).cast("decimal(16,0)")
    rest = (size - thousands * 1000).cast("decimal(9,6)")
    product = (thousands * factor * 1000).cast("decimal(37,7)") + F.floor(rest * factor, F.lit(7))
    value = F.round(product, 2).cast("decimal(29,2)")
    return F.coalesce(plain, F.when(amount < 0, -value).otherwise(value))


def total(c: Column) -> Column:
    """Exact sum, 0.00 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def rows_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")
