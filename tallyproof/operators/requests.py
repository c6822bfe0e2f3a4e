"""Is a request answerable at all: operators, columns, entities, date ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.config import Mapping
from tallyproof.functions.dates import slash_date
from tallyproof.functions.text import entity_key


def request_problems(requests: DataFrame, entities: DataFrame, mapping: Mapping, columns: list[str]) -> DataFrame:
    """Adds `problem` (NULL if fine) to rows of (column, op, value, group_by)."""
    known = entities.select("entity_norm").withColumn("known", F.lit(True))
    joined = requests.withColumn("entity_norm", entity_key(F.col("value"))).join(known, "entity_norm", "left")
    entity_filter = F.col("column") == mapping.entity
    problem = (
        F.when(F.col("op") != "eq", "operator not supported")
        .when(~F.col("column").isin(*columns), "column does not exist")
        .when(entity_filter & F.col("known").isNull(), "unknown entity")
        .when(F.col("group_by").isNotNull() & (F.col("group_by") != mapping.entity), "grouping not supported")
    )
    return joined.withColumn("problem", problem).drop("entity_norm", "known")


def check_ranges(ranges: DataFrame, start: str, end: str, date_format: str) -> DataFrame:
    """Adds parsed dates and `status`: FAILED for a date that does not exist or a reversed range."""
    typed = ranges.withColumn("start_day", slash_date(F.col(start), date_format)).withColumn(
        "end_day", slash_date(F.col(end), date_format)
    )
    good = F.coalesce(F.col("start_day") <= F.col("end_day"), F.lit(False))
    return typed.withColumn("status", F.when(good, "OK").otherwise("FAILED"))


def latest_year(ledger_rows: DataFrame) -> DataFrame:
    """Year of the latest readable date, the default year of a request."""
    return ledger_rows.agg(F.year(F.max("txn_date")).cast("bigint").alias("year"))
