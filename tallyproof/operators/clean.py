"""Duplicate and conflict rules over the whole ledger.

Nearly all keys hold few rows. A sketch of the keys, one narrow pass, names those that do not. All others go through one
shuffle by key and one sort, in which every row learns whether it is the first copy and whether its key conflicts. The
named ones, if there are any, take a way on which no row of theirs is gathered: copies collapse before a
shuffle by the whole identity, and a key is then reduced to a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.operators.prepare import IDENTITY
from tallyproof.operators.skew import Parts, cut_by_heat, salted_join


def marked_rows(rows: DataFrame) -> DataFrame:
    """Adds `is_first` (the first copy in row order) and `is_conflict` (the key's valid rows carry different amounts).

    One shuffle by key and one sort; a key's rows are held together, so hot keys must not be among them.
    """
    in_order = Window.partitionBy("key").orderBy("date_raw", "entity_raw", "amount_raw", "row_order")
    whole_key = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    valid_amount = F.when(~F.col("is_missing"), F.col("amount_raw"))
    low, high = F.min(valid_amount).over(whole_key), F.max(valid_amount).over(whole_key)
    again = reduce(and_, [F.lag(c).over(in_order) == F.col(c) for c in IDENTITY[1:]])
    return rows.withColumns({"is_first": ~F.coalesce(again, F.lit(False)), "is_conflict": F.coalesce(low != high, F.lit(False))})


def _parts(rows: DataFrame | Parts) -> Parts:
    return rows if isinstance(rows, Parts) else cut_by_heat(rows, F.col("key"))


def cells(
    rows: DataFrame | Parts,
    by: Sequence[str],
    carry: Sequence[str],
    all_rows: Sequence[Column],
    first_rows: Callable[[Column], Sequence[Column]],
    keyed: bool = True,
) -> DataFrame:
    """Measures per key (and report columns `by`) with `is_conflict`. Rows already cut by heat are not looked at again for it,
    nor are ordinary ones that were marked before.

    `all_rows` are named sums over every row; `first_rows` gives named sums over first copies for a condition that tells
    them, and may use the columns in `carry`. Rows that have their key for themselves are summed up together, without a key.
    A ledger that is not keyed has no copies and no conflicts, and no shuffle.
    """
    if not keyed:
        sums = [*all_rows, *first_rows(F.lit(True))]
        rows = rows.cold if isinstance(rows, Parts) else rows
        return rows.groupBy(F.lit(None).cast("string").alias("key"), *by).agg(*sums, F.max(F.lit(False)).alias("is_conflict"))
    cold, hot, lone = _parts(rows)
    sums = [*all_rows, *first_rows(F.col("is_first")), F.max("is_conflict").alias("is_conflict")]
    marked = cold if "is_first" in cold.columns else marked_rows(cold)
    found = marked.groupBy("key", *by).agg(*sums)
    if lone is not None:
        alone = lone.groupBy(*by).agg(*all_rows, *first_rows(F.lit(True)))
        alone = alone.withColumns({"key": F.lit(None), "is_conflict": F.lit(False)})
        found = found.unionByName(alone.select(*[F.col(c).cast(t) for c, t in found.dtypes]))
    if hot is None:
        return found
    first = first_copies(hot, [*carry, *by], all_rows)
    summed = [c for c in first.columns if c not in {*IDENTITY, "row_order", *carry, *by}]
    reduced = key_cells(first, by, [*[F.sum(c).alias(c) for c in summed], *first_rows(F.lit(True))])
    return found.unionByName(reduced.select(*[F.col(c).cast(t) for c, t in found.dtypes]))


def first_copies(rows: DataFrame, carry: Sequence[str], sums: Sequence[Column] = ()) -> DataFrame:
    """One row per (key, date, entity, amount) as written: the first in row order, with the columns in `carry`.

    `sums` are aggregates over all copies, so that figures before cleaning come from the same pass. Rows without
    a date or an amount keep their own identity and are told by `is_missing` if it is carried.
    """
    head = F.min(F.struct("row_order", *carry)).alias("head")
    grouped = rows.groupBy(*IDENTITY).agg(head, *sums)
    names = [c for c in grouped.columns if c not in (*IDENTITY, "head")]
    return grouped.select(*IDENTITY, "head.*", *names)


def key_cells(first: DataFrame, by: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """Measures per key (and report columns `by`) with `is_conflict`: the key's rows carry different amounts.

    Without `by` this is one aggregation. With `by`, a key first shrinks to at most one row per report cell, and
    only then do its cells meet in a window, so no window group is larger than the report itself.
    """
    valid_amount = F.when(~F.col("is_missing"), F.col("amount_raw"))
    cells = first.groupBy("key", *by).agg(
        F.min(valid_amount).alias("low"), F.max(valid_amount).alias("high"), *measures
    )
    low, high = F.col("low"), F.col("high")
    if by:
        whole_key = Window.partitionBy("key")
        low, high = F.min("low").over(whole_key), F.max("high").over(whole_key)
    return cells.withColumn("is_conflict", F.coalesce(low != high, F.lit(False))).drop("low", "high")


def conflicting_keys(rows: DataFrame) -> DataFrame:
    """Keys whose valid rows carry more than one amount text."""
    return (
        rows.filter(~F.col("is_missing"))
        .groupBy("key")
        .agg(F.min("amount_raw").alias("low"), F.max("amount_raw").alias("high"))
        .filter("low != high")
        .select("key")
    )


def surviving_rows(rows: DataFrame | Parts, carry: Sequence[str]) -> DataFrame:
    """Cleaned ledger row by row: first copies whose key has no conflict."""
    columns = [*IDENTITY, "row_order", *carry]
    cold, hot, lone = _parts(rows).each(lambda part: part.filter(~F.col("is_missing")))
    kept = marked_rows(cold).filter("is_first and not is_conflict").select(*columns)
    if lone is not None:
        # a row is made as one, so that later conditions on a parsed date are not put where the texts are made
        kept = kept.unionByName(lone.select(F.explode(F.array(F.struct(*columns))).alias("row")).select("row.*"))
    if hot is None:
        return kept
    spread = salted_join(first_copies(hot, carry), conflicting_keys(hot), ["key"], "left_anti", F.struct(*IDENTITY))
    return kept.unionByName(spread.select(*columns))


def first_row_per_key(rows: DataFrame, carry: Sequence[str]) -> DataFrame:
    """First surviving row of every key, in one aggregation.

    Missing cells are looked at in the aggregation and not in a filter, which would be put where the ledger is read.
    """
    valid = ~F.col("is_missing")
    return (
        rows.groupBy("key")
        .agg(
            F.min(F.when(valid, F.col("amount_raw"))).alias("low"),
            F.max(F.when(valid, F.col("amount_raw"))).alias("high"),
            F.min(F.when(valid, F.struct("row_order", *carry))).alias("head"),
        )
        .filter("low = high")
        .select("key", "head.*")
    )
