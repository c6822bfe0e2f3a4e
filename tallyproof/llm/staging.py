"""Tables written between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a session of one machine gets a folder of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


ROWS_PER_BATCH = 512


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python workers a few hundred at a time, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, ROWS_PER_BATCH)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage and survives the loss of executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
