"""Documents written into shards by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: the key seeds a generator whose numbers are the
steps at which the row would jump to a later shard; the last step inside the number of shards is where it lies. No table of
a ring is kept, and one more shard takes its even share of rows out of all others and moves nothing else.

`write` sends every row to the shard's files, which adaptive execution cuts into even parts, whatever the sizes of the shards
or of the groups in them. A row's slot is its place among the rows of its shard, files in order of their names: the
count of rows in the files before it and its place in its own file. Nothing is sorted or numbered by a window over rows.
`append` adds shards to a store that is written: it reads what is there, writes only the rows that move, and leaves
the old files alone; `read` tells by the function itself which of their rows have moved away.

Keys may be of any type; null keys share one shard, as all equal keys do, and repeated rows have a slot each. An empty table
gives an empty store. Text is not looked at here, so null, empty and very long texts are all the same. Columns may have any
name but SHARD, which is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyproof.operators.skew import fits

SHARD = "_shard"
#: File counts (one short row per file) are joined by broadcast up to here, by shuffle beyond.
BROADCAST_FILES = 200_000
#: Steps taken at once; a row that needs more (about one in 10**20 at a million shards) goes on to the end.
STEPS = 64

# Fixed value: the multiplier of the published generator (a 64-bit linear congruential one with increment 1).
MULTIPLIER = 2862933555777941757

_LOW32 = 0xFFFFFFFF
_LOW16 = 0xFFFF


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next number, as two halves of 32 bits; no product or sum leaves the range of a signed long."""
    top, m1, m0 = MULTIPLIER >> 32, (MULTIPLIER >> 16) & _LOW16, MULTIPLIER & _LOW16
    first = low * _long(m0) + _long(1)
    second = F.shiftright(first, 16) + low * _long(m1)
    new_low = F.shiftleft(second.bitwiseAND(_long(_LOW16)), 16).bitwiseOR(first.bitwiseAND(_long(_LOW16)))
    cross = (low * _long(top)).bitwiseAND(_long(_LOW32)) + (high * _long(m0)).bitwiseAND(_long(_LOW32))
    cross = cross + F.shiftleft((high * _long(m1)).bitwiseAND(_long(_LOW16)), 16) + F.shiftright(second, 16)
    return cross.bitwiseAND(_long(_LOW32)), new_low


def jump(number: Column, shards: int) -> Column:
    """Shard (0 to shards - 1) of a 64-bit number by jump consistent hashing."""
    if not 1 <= shards < 2**31:
        raise ValueError(f"the number of shards must be from 1 to 2**31 - 1, not {shards}")

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        # both factors are below 2**31 and the divisor is a whole number, so the quotient is that of the published function
        after = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        gone_on = F.struct(s["next"].alias("shard"), after.cast("bigint").alias("next"), high.alias("high"), low.alias("low"))
        return F.when(s["next"] < shards, gone_on).otherwise(s)

    start = F.struct(
        _long(-1).alias("shard"),
        _long(0).alias("next"),
        F.shiftrightunsigned(number, 32).alias("high"),
        number.bitwiseAND(_long(_LOW32)).alias("low"),
    )
    # the first number of a row is its first jump; a jump is at least one shard, so as many steps as shards are always enough
    found = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), start, step)
    if shards > STEPS:
        found = F.when(found["next"] >= shards, found).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), found, step))
    return found["shard"].cast("int")


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of any type: jump hashing of the 64-bit hash of its text (null has one of its own)."""
    return jump(F.xxhash64(key.cast("string")), shards)


def write(rows: DataFrame, path: str, shards: int, key: str) -> None:
    """Write all rows and columns below path, one folder per shard. One shuffle of the rows; shards of any size are cut evenly."""
    if SHARD in rows.columns:
        raise ValueError(f"{SHARD} is a column of the store and cannot be one of the rows")
    placed = rows.withColumn(SHARD, shard_of(F.col(f"`{key}`"), shards)).hint("rebalance", SHARD)
    placed.write.partitionBy(SHARD).option("compression", "zstd").parquet(path)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read(spark: SparkSession, path: str, shards: int, key: str, schema) -> DataFrame:
    """All rows of a store that holds so many shards (after any `append`), with their shard.

    schema: that of the rows and SHARD, as `store_schema` gives it. Files are not looked at for it.
    """
    rows = _stored(spark, path, schema)
    return rows.filter(F.col(SHARD) == shard_of(F.col(f"`{key}`"), shards))


def store_schema(rows: DataFrame):
    """Schema of a store of such rows."""
    return rows.limit(0).withColumn(SHARD, F.lit(0)).schema


def append(spark: SparkSession, path: str, shards: int, more: int, key: str, schema) -> DataFrame:
    """Grow a store from `shards` to `more` shards: only rows that move are written. Returns the store as it is then."""
    if more <= shards:
        raise ValueError(f"a store of {shards} shards grows to more than that, not to {more}")
    live = read(spark, path, shards, key, schema)
    after = shard_of(F.col(f"`{key}`"), more)
    moved = live.filter(after != F.col(SHARD)).withColumn(SHARD, after).hint("rebalance", SHARD)
    moved.write.mode("append").partitionBy(SHARD).option("compression", "zstd").parquet(path)
    return read(spark, path, more, key, schema)


def slots(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a store as written at once, with `slot`: 0, 1, ... within the shard, in order of file names and places in the files."""
    rows = _stored(spark, path, schema).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = rows.groupBy(SHARD, "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(SHARD).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file of a shard
    starts = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if fits(starts, BROADCAST_FILES):
        starts = F.broadcast(starts)
    return rows.join(starts, "_file").withColumn("slot", F.col("_start") + F.col("_place")).drop("_file", "_place", "_start")
