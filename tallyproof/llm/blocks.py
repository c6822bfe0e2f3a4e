"""Documents packed into blocks of a few megabytes, written once and read by every later step of an operator.

A block is one row; its number and a document's place in it make a row id that stays the same however often the table
is read. The table is bucketed by block, so later steps send the little they know of a document to its text instead
of shuffling the texts.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.arrays import frames, offsets_of, pieces, raw, unframe
from tallyproof.llm.staging import folder, small_batches

BLOCK_BYTES = 4 << 20
#: Places per block in a row id; a block never has more documents.
PLACES = 1 << 20


def _pack(batches):
    serial = itertools.count()
    pack = zstandard.ZstdCompressor(level=3)
    for some in pieces(batches, "text", BLOCK_BYTES):
        for first in range(0, len(some), PLACES):
            batch = some.slice(first, PLACES)
            block = (TaskContext.get().partitionId() << 20) + next(serial)
            at, data = raw(batch.column("text"))
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            body = pack.compress(frames(null.tobytes(), keys.tobytes(), np.diff(at).astype("<i8").tobytes(), data.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([body], pa.binary())], ["block", "body"])


def write_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (block, body) of all documents; null texts are empty."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    name = f"llm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(_pack, "block bigint, body binary")
    packed.write.bucketBy(buckets, "block").option("path", folder(spark, "blocks")).option("compression", "none").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external one: its files stay, and blocks is resolved already
    return blocks


def open_block(block: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row ids, null flags, doc_ids, offsets and bytes of a block."""
    null, keys, lengths, data = unframe(zstandard.ZstdDecompressor().decompress(body))
    keys = np.frombuffer(keys, "<i8")
    return block * PLACES + np.arange(len(keys)), np.frombuffer(null, bool), keys, offsets_of(np.frombuffer(lengths, "<i8")), np.frombuffer(data, np.uint8)


def block_of(row: Column) -> Column:
    return F.shiftright(row, 20)
