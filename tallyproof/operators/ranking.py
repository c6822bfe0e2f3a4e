"""Entities: the list, the comparison, the ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.config import Mapping
from tallyproof.functions.text import cell, entity_key, entity_label
from tallyproof.operators.prepare import entity_key_text
from tallyproof.sources.tables import row_order


def entity_list(ledger: DataFrame, mapping: Mapping) -> DataFrame:
    """(entity_norm, entity): spellings merged, labelled by the first spelling in ledger order; blanks left out."""
    spellings = ledger.groupBy(cell(mapping.entity).alias("raw")).agg(F.min(row_order(mapping.order)).alias("seen"))
    return (
        spellings.withColumn("entity_norm", entity_key(F.col("raw")))
        .filter("entity_norm <> ''")
        .groupBy("entity_norm")
        .agg(F.min_by("raw", "seen").alias("raw"))
        .select("entity_norm", entity_label(F.col("raw")).alias("entity"))
    )


def chosen(entities: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """A line for every entity asked for, also where the ledger does not have it."""
    asked = entities.sparkSession.createDataFrame([(entity_key_text(w), w) for w in wanted], "entity_norm string, asked string")
    asked = asked.groupBy("entity_norm").agg(F.min("asked").alias("asked"))
    both = asked.join(entities, "entity_norm", "left")
    return both.select("entity_norm", F.coalesce("entity", entity_label(F.col("asked"))).alias("entity"))


def per_entity(entities: DataFrame, figures: DataFrame) -> DataFrame:
    """One line per entity, also for those without rows in scope."""
    joined = entities.join(figures, "entity_norm", "left")
    fill = {f.name: 0 for f in joined.schema if f.name != "result" and f.dataType.simpleString() == "bigint"}
    empty = F.col("status").isNull()
    return (
        joined.withColumn("result", F.when(empty, F.lit(0).cast("decimal(38,2)")).otherwise(F.col("result")))
        .withColumn("status", F.coalesce("status", F.lit("VERIFIED")))
        .na.fill(fill)
    )


def ranked(figures: DataFrame, value: str = "result", name: str = "entity", out: str = "rank") -> DataFrame:
    """Positions 1..n, largest first, figures that are missing last; equal figures keep name order.

    The input is a report with one row per entity.
    """
    return figures.withColumn(out, F.row_number().over(Window.orderBy(*_largest_first(value, name)))).withColumn(
        out, F.col(out).cast("bigint")
    )


def _largest_first(value: str, name: str) -> list[Column]:
    return [F.col(value).desc_nulls_last(), F.col(name)]


def top_slices(items: DataFrame, value: str = "value", name: str = "name", keep: int = 6) -> DataFrame:
    """The largest positive items; all others together as "Other"."""
    positive = items.filter(F.col(value) > 0)
    placed = ranked(positive, value, name, "place")
    return placed.groupBy(
        F.when(F.col("place") <= keep, F.col(name)).otherwise("Other").alias(name),
        (F.col("place") > keep).alias("is_other"),
    ).agg(F.sum(value).alias(value))
