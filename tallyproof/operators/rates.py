"""Exchange rates: validity intervals, the rate in force on a day, the latest rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.functions.money import RATE
from tallyproof.operators.skew import fits, salted_join

# About 20 MB of (currency, rate, from, until) rows.
MAX_BROADCAST_RATES = 200_000


def rate_intervals(rates: DataFrame) -> DataFrame:
    """(cur, rate, valid_from, valid_to): one row per currency and day, the later rate row winning a tie.

    valid_to is NULL for the newest rate of a currency.

    The window sees one row per currency and day, so its groups are bounded by the calendar.
    """
    daily = rates.groupBy("cur", "eff").agg(F.max_by("rate", "ord").alias("rate"))
    following = F.lead("eff", 1).over(Window.partitionBy("cur").orderBy("eff"))
    return daily.select(
        "cur", "rate", F.col("eff").alias("valid_from"), following.alias("valid_to")
    )


def latest_rates(rates: DataFrame) -> DataFrame:
    """(cur, rate): the newest rate on file per currency."""
    return rates.groupBy("cur").agg(F.max_by("rate", F.struct("eff", "ord")).alias("rate"))


def _with_target(found: Column, cur: Column, target: str) -> Column:
    return F.when(cur == target, F.lit(1).cast(RATE)).otherwise(found)


def attach_rate_on(
    rows: DataFrame,
    rates: DataFrame,
    target: str,
    date_col: str,
    out: str = "rate",
    cur_col: str = "cur_eff",
    max_broadcast_rows: int = MAX_BROADCAST_RATES,
) -> DataFrame:
    """As-of join: the newest rate with valid_from <= day; NULL without one or without a day.

    Intervals are cut into (currency, month) pieces, so that a row meets the rates of one month only, however many a
    currency has. The newest rate of a currency has no end and is not cut; it is looked up by currency. Rows of the
    reporting currency and rows without a day meet nothing. Pieces that fit are broadcast, others are shuffled.
    """
    spans, day = rate_intervals(rates), F.col(date_col)
    since, until, month, key = (f"{out}_{n}" for n in ("since", "until", "month", "cur"))
    named = [F.col("cur").alias(key), F.col("valid_from").alias(since)]
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(F.date_sub("valid_to", 1), "month"), F.expr("interval 1 month"))
    pieces = spans.filter("valid_to is not null").select(
        *named, F.col("valid_to").alias(until), F.col("rate").alias(f"{out}_then"), F.explode(months).alias(month)
    )
    newest = spans.filter("valid_to is null").select(*named, F.col("rate").alias(f"{out}_newest"))
    asks = (F.col(cur_col) != target) & day.isNotNull()
    keyed = rows.withColumns({key: F.when(asks, F.col(cur_col)), month: F.trunc(day, "month")})
    small = fits(pieces, max_broadcast_rows)

    def meet(left: DataFrame, right: DataFrame, on: list[str], extra: str) -> DataFrame:
        if not small:
            return salted_join(left, right, on, "left", F.struct(*rows.columns), F.expr(extra))
        l, r = left.alias("l"), F.broadcast(right).alias("r")
        condition = F.expr(extra)
        for k in on:
            condition = (F.col(f"l.{k}") == F.col(f"r.{k}")) & condition
        kept = [F.col(f"r.{c}") for c in right.columns if c not in on]
        return l.join(r, condition, "left").select("l.*", *kept)

    joined = meet(keyed, pieces, [key, month], f"l.`{date_col}` >= r.{since} and l.`{date_col}` < r.{until}").drop(since, until, month)
    joined = meet(joined, newest, [key], f"l.`{date_col}` >= r.{since}").drop(since, key)
    found = F.coalesce(f"{out}_then", f"{out}_newest")
    return joined.withColumn(out, _with_target(found, F.col(cur_col), target)).drop(f"{out}_then", f"{out}_newest")


def attach_latest_rate(
    rows: DataFrame,
    rates: DataFrame,
    target: str,
    out: str = "rate",
    cur_col: str = "cur_eff",
    max_broadcast_rows: int = MAX_BROADCAST_RATES,
) -> DataFrame:
    """The newest rate on file whatever the row's day."""
    newest = latest_rates(rates).select(F.col("cur").alias(f"{out}_cur"), F.col("rate").alias(f"{out}_found"))
    cur = F.col(cur_col)
    if fits(newest, max_broadcast_rows):
        joined = rows.join(F.broadcast(newest), cur == F.col(f"{out}_cur"), "left")
    else:
        keyed = rows.withColumn(f"{out}_cur", cur)
        joined = salted_join(keyed, newest, [f"{out}_cur"], "left", F.struct(*rows.columns))
    return joined.withColumn(out, _with_target(F.col(f"{out}_found"), cur, target)).drop(f"{out}_found", f"{out}_cur")
