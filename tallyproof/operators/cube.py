"""Dashboard cube: month x entity x category, with everything that was left out counted by reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.config import Mapping, Policy
from tallyproof.functions.dates import month_bucket, with_both_readings
from tallyproof.functions.money import MONEY, RATE, amount_or_null, kept_rate, rows_where
from tallyproof.functions.text import cell, effective_currency, entity_label, raw_currency, strip
from tallyproof.operators.rates import attach_rate_on

# Why a row is not in the charts.
NO_AMOUNT, NO_RATE, NO_CURRENCY = "no amount", "no exchange rate", "no currency"
USED = "used"


def chart_rows(
    ledger: DataFrame,
    rates: DataFrame | None,
    mapping: Mapping,
    policy: Policy,
    columns: Sequence[str],
    category: str | None,
) -> DataFrame:
    """Distinct raw rows with their copies, month, value and reason. Conflicts and refunds play no part here.

    A rate of too many digits counts as none.
    """
    distinct = ledger.groupBy(*[cell(c).alias(c) for c in columns]).agg(F.count("*").alias("copies"))
    code = raw_currency(F.col(mapping.currency)) if mapping.currency else F.lit(policy.target_currency)
    texts = distinct.select(
        "copies",
        (F.col(mapping.entity) if mapping.entity else F.lit("")).alias("entity_raw"),
        (F.col(category) if category else F.lit(None).cast("string")).alias("category_raw"),
        F.col(mapping.date).alias("date_raw"),
        amount_or_null(strip(F.col(mapping.amount)), mapping.unit_multiplier, commas=True).alias("amount"),
        effective_currency(code, {}).alias("cur_eff"),
    )
    # the text is taken apart once; a date made of it in one expression would do so for each use of a part
    rows = with_both_readings(texts, "date_raw", policy.date_format, "day", "other_day").drop("date_raw", "other_day")
    if rates is None:
        same = F.when(F.col("cur_eff") == policy.target_currency, F.lit(1))
        rated = rows.withColumn("rate", same.cast(RATE))
    else:
        rated = attach_rate_on(rows, rates, policy.target_currency, "day").withColumn("rate", kept_rate(F.col("rate")))
    reason = (
        F.when(F.col("amount").isNull(), NO_AMOUNT)
        .when(F.col("cur_eff") == "", NO_CURRENCY)
        .when(F.col("rate").isNull(), NO_RATE)
        .otherwise(USED)
    )
    return rated.withColumn("reason", reason).withColumn("month", month_bucket(F.col("day")))


def cube(rows: DataFrame) -> DataFrame:
    """(month, entity, category, value, n). Raw spellings are summed first, labels only then made."""
    summed = (
        rows.filter(F.col("reason") == USED)
        .groupBy("month", "entity_raw", "category_raw")
        .agg(F.sum(F.col("amount") * F.col("rate")).alias("v"), F.count("*").alias("n"))
    )
    category = F.when(F.col("category_raw").isNull(), "").otherwise(entity_label(F.col("category_raw")))
    return summed.groupBy(
        "month", entity_label(F.col("entity_raw")).alias("entity"), category.alias("category")
    ).agg(F.bround(F.sum("v"), 2).cast(MONEY).alias("value"), F.sum("n").cast("bigint").alias("n"))


def cube_sorted(rows: DataFrame) -> DataFrame:
    return cube(rows).orderBy("month", "entity", "category")


def skips(rows: DataFrame) -> DataFrame:
    """(reason, rows): used rows, rows left out by reason, undated rows among the used, repeats removed."""
    used = F.col("reason") == USED
    counted = rows.agg(
        *[rows_where(F.col("reason") == r).alias(r) for r in (USED, NO_AMOUNT, NO_RATE, NO_CURRENCY)],
        rows_where(used & (F.col("month") == "")).alias("undated"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("repeats"),
    )
    lines = F.array(*[F.struct(F.lit(c).alias("reason"), F.col(c).alias("rows")) for c in counted.columns])
    return counted.select(F.explode(lines).alias("line")).select("line.*")


def currency_rows(rows: DataFrame) -> DataFrame:
    """Charted rows per currency, most first."""
    return (
        rows.filter(F.col("reason") == USED)
        .groupBy(F.col("cur_eff").alias("currency"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "currency")
    )


def charts(cells: DataFrame, entity: str | None = None, category: str | None = None) -> DataFrame:
    """(chart, name, value, n, average): bars by entity, slices by category, trend by month, and the tiles.

    A selection filters every chart but its own, so that another bar or slice can still be picked.
    """
    of_entity = F.lit(True) if entity is None else F.col("entity") == entity
    of_category = F.lit(True) if category is None else F.col("category") == category
    both = of_entity & of_category
    lines = F.array_compact(
        F.array(
            F.when(of_category, F.struct(F.lit("entity").alias("chart"), F.col("entity").alias("name"))),
            F.when(of_entity, F.struct(F.lit("category").alias("chart"), F.col("category").alias("name"))),
            F.when(
                both & (F.col("month") != ""), F.struct(F.lit("month").alias("chart"), F.col("month").alias("name"))
            ),
            F.when(both, F.struct(F.lit("total").alias("chart"), F.lit("").alias("name"))),
        )
    )
    return (
        cells.select(F.explode(lines).alias("line"), "value", "n")
        .groupBy("line.chart", "line.name")
        .agg(F.sum("value").cast(MONEY).alias("value"), F.sum("n").cast("bigint").alias("n"))
        .withColumn("average", F.round(F.col("value").cast("decimal(28,2)") / F.col("n").cast("decimal(18,0)"), 2).cast(MONEY))
    )


def rollups(cells: DataFrame) -> DataFrame:
    """The unfiltered charts in one pass over grouping sets."""
    chart = F.element_at(
        F.create_map(
            *[F.lit(x) for pair in {3: "entity", 5: "category", 6: "month", 7: "total"}.items() for x in pair]
        ),
        F.grouping_id().cast("int"),
    )
    dims = ["entity", "category", "month"]
    return (
        cells.groupingSets([["entity"], ["category"], ["month"], []], *dims)
        .agg(
            chart.alias("chart"),
            F.sum("value").cast(MONEY).alias("value"),
            F.sum("n").cast("bigint").alias("n"),
        )
        .withColumn("name", F.coalesce(*dims, F.lit("")))
        .filter("not (chart = 'month' and name = '')")
        .select("chart", "name", "value", "n")
    )

