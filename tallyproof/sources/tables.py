"""Reading ledgers, rates, refunds and reported figures; writing evidence."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.config import DD_MM, Mapping
from tallyproof.functions.dates import rate_date
from tallyproof.functions.money import AMOUNT, rate_or_null
from tallyproof.functions.text import cell, strip


def row_order(columns: Sequence[str]) -> Column:
    """The order that stands for file order. A DataFrame has none of its own."""
    return F.struct(*columns) if columns else F.lit(0)


def as_text(df: DataFrame, keep: Sequence[str] = (), na_values: Sequence[str] = ()) -> DataFrame:
    """Every cell as text and never null, but for the columns in `keep` (order columns)."""

    def column(name: str) -> Column:
        if name in keep:
            return F.col(name)
        text = cell(name)
        return (F.when(text.isin(*na_values), F.lit("")).otherwise(text) if na_values else text).alias(name)

    return df.select(*[column(c) for c in df.columns])


def read_csv(spark: SparkSession, path, na_values: Sequence[str] = (), **options) -> DataFrame:
    """CSV with a header row, all columns text. `options` go to the Spark reader (encoding, sep, multiLine...)."""
    reader = spark.read.options(header=True, inferSchema=False, escape='"', **options)
    return as_text(reader.csv(path), na_values=na_values)


def read_parquet(spark: SparkSession, path, keep: Sequence[str] = ()) -> DataFrame:
    return as_text(spark.read.parquet(path), keep)


def scan_rates(rates: DataFrame, mapping: Mapping, date_format: str = DD_MM) -> DataFrame:
    """(cur, eff, rate, ord); rows whose date or rate cannot be read are left out; a rate of too many digits is money.LOST_RATE."""
    cols = mapping.rates
    return rates.select(
        F.upper(strip(cell(cols.currency))).alias("cur"),
        rate_date(cell(cols.effective), date_format).alias("eff"),
        rate_or_null(strip(cell(cols.rate))).alias("rate"),
        row_order(cols.order).alias("ord"),
    ).filter("eff is not null and rate is not null")


def scan_refunds(refunds: DataFrame, mapping: Mapping) -> DataFrame:
    cols = mapping.refunds
    return refunds.select(
        cell(cols.key).alias("key"), cell(cols.amount).alias("ref_amount_raw"), cell(cols.date).alias("ref_date_raw")
    )


def scan_summary(
    summary: DataFrame, mapping: Mapping, quarters: Sequence[int] = (4,), years: str = "20[0-9]{2}"
) -> DataFrame:
    """(quarter, year, reported, ord): the last row whose label names the quarter; year is NULL if it names none."""
    cols = mapping.summary
    label = cell(cols.period)
    named_quarters = F.array_distinct(F.regexp_extract_all(label, F.lit("Q([1-4])"), F.lit(1)))
    named_years = F.array_distinct(F.regexp_extract_all(label, F.lit(f"(?<![0-9])({years})(?![0-9])"), F.lit(1)))
    lines = summary.select(
        F.explode(named_quarters).alias("quarter"),
        named_years.alias("years"),
        strip(cell(cols.amount)).try_cast(AMOUNT).alias("reported"),
        row_order(cols.order).alias("ord"),
    )
    return (
        lines.withColumn("year", F.explode_outer("years"))
        .groupBy(F.col("quarter").cast("bigint").alias("quarter"), F.col("year").cast("bigint").alias("year"))
        .agg(F.max_by("reported", "ord").alias("reported"), F.max("ord").alias("ord"))
        .filter(F.col("quarter").isin(*quarters))
    )


def write_evidence(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Save evidence rows as Spark files (csv gets a header)."""
    writer = rows.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


@functools.cache
def _folder_of_one_machine() -> str:
    return tempfile.mkdtemp(prefix="tallyproof-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a session of one machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or _folder_of_one_machine()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, path: str) -> DataFrame:
    """df written and read back: what follows does not compute it again, also after executors are lost."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
