"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8

#: A key is hot from this many rows on, if they are also more than one in HOT_SHARE.
HOT_ROWS = 10_000
HOT_SHARE = 200
#: Keys the sketch keeps count of; its error is about a 3,000th of the rows.
TRACKED = 10_000

#: Estimated bytes from which a ledger has the keys told that stand alone; their rows are then not shuffled by key.
LARGE = 32_000_000
#: More partitions than a table has.
UNMERGED = 10_000_000


class Parts(NamedTuple):
    """Rows cut by their keys: those of ordinary keys, and those of hot keys if there are any.

    Of a large ledger the rows whose key no other row has stand in `lone`, others of ordinary keys in `cold`.
    """

    cold: DataFrame
    hot: DataFrame | None
    lone: DataFrame | None = None

    def each(self, step: Callable[[DataFrame], DataFrame]) -> Parts:
        cold, hot, lone = [None if part is None else step(part) for part in self]
        return Parts(cold, hot, None if lone is None else apart(lone))


def apart(rows: DataFrame) -> DataFrame:
    """The same rows in the same partitions. What is done before and after does not become one generated method, too long to be compiled."""
    return rows.coalesce(UNMERGED)


def hot_keys(rows: DataFrame, key: Column) -> list[str]:
    """Keys with a large share of all rows: at most HOT_SHARE, whatever the table. A key missed or named in error costs time only."""
    top = F.expr(f"approx_top_k(key, {HOT_SHARE}, {TRACKED})")
    found = rows.select(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    return [t["item"] for t in found["top"] or [] if t["count"] > max(HOT_ROWS, found["n"] // HOT_SHARE)]


def cut_by_heat(rows: DataFrame, key: Column) -> Parts:
    hot = hot_keys(rows, key)
    return Parts(rows.filter(~key.isin(*hot)), rows.filter(key.isin(*hot))) if hot else Parts(rows, None)


def is_large(rows: DataFrame) -> bool:
    """By the planner's estimate, without a job."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > LARGE


def _marks(hashes: DataFrame) -> DataFrame:
    """A bitmap of 2**27 places: (mark_bucket, mark_words), one row per 32 words that have a bit of some `h`; 20 MB at most."""
    place = hashes.selectExpr("h & 65535 AS mark_bucket", "shiftright(h, 16) & 31 AS word", "shiftleft(1L, cast(shiftright(h, 21) & 63 AS int)) AS bit")
    words = place.groupBy("mark_bucket", "word").agg(F.bit_or("bit").alias("bits"))
    held = words.groupBy("mark_bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return held.selectExpr("mark_bucket", "transform(sequence(0L, 31L), i -> coalesce(try_element_at(held, i), 0L)) AS mark_words")


def marks_of(keys: DataFrame, key: Column) -> DataFrame:
    """Marks of all keys."""
    return _marks(keys.select(F.xxhash64(key).alias("h")))


def marks_of_repeated(rows: DataFrame, key: Column) -> DataFrame:
    """Marks of the keys that several rows have. Of every row only 40 bits of a hash are shuffled."""
    hashes = rows.select(F.expr("1099511627775").bitwiseAND(F.xxhash64(key)).alias("h")).repartition("h")
    return _marks(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def marked(rows: DataFrame, key: Column, marks: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose key is marked, or those whose key is not. A key may be marked in error, and is never missed."""
    side = F.broadcast(marks)
    here = F.expr("mark_hash & 65535 = mark_bucket")
    bit = F.expr("getbit(element_at(mark_words, cast(shiftright(mark_hash, 16) & 31 AS int) + 1), cast(shiftright(mark_hash, 21) & 63 AS int)) = 1")
    hashed = rows.withColumn("mark_hash", F.xxhash64(key))
    return hashed.join(side, here & bit, "left_semi" if inside else "left_anti").drop("mark_hash")


def fits(df: DataFrame, max_rows: int) -> bool:
    """Size check before a broadcast: reads at most max_rows + 1 rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Column,
    extra: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose left rows of one key go to `salts` tasks.

    The right side is repeated once per salt, so keep it the smaller one. Because of that repetition both
    join inputs are plain shuffles, which also lets adaptive execution split whatever is still too large.
    """
    side = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # never null, so that no filter for nulls is put where the rows are read, which would make their texts a second time
    rows = left.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"), F.lit(0)))
    keys = [*on, "salt"]
    if extra is None:
        return rows.join(side, keys, how).drop("salt")
    l, r = rows.alias("l"), side.alias("r")
    condition = extra
    for k in keys:
        condition = (F.col(f"l.{k}") == F.col(f"r.{k}")) & condition
    right_only = [F.col(f"r.{c}") for c in right.columns if c not in on]
    return l.join(r, condition, how).select(*[F.col(f"l.{c}") for c in left.columns], *right_only)
