"""Data quality of a whole ledger: columns, copies, conflicts, missing cells, dates, currencies, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.config import Mapping, Policy
from tallyproof.functions.dates import looks_ambiguous
from tallyproof.functions.money import rows_where
from tallyproof.functions.text import cell, is_blank, is_number, strip
from tallyproof.sources.tables import row_order

# Points taken per finding and at most, in the order they are taken.
DEDUCTIONS = {
    "exact_duplicate_groups": (5, 20),
    "conflicting_duplicate_groups": (10, 20),
    "missing_values": (3, 15),
    "unsupported_currencies": (5, 10),
    "ambiguous_dates": (1, 10),
}
HEALTH_BANDS = {"Looks great": 90, "Mostly fine": 75, "Needs attention": 0}


def cells_by_value(ledger: DataFrame, columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """(column, value, n, seen): every distinct cell text with its rows; equal cells meet before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), strip(cell(c)).alias("value")) for c in columns])
    return (
        ledger.select(F.explode(pairs).alias("p"), row_order(order).alias("at"))
        .groupBy("p.column", "p.value")
        .agg(F.count("*").alias("n"), F.min("at").alias("seen"))
    )


def column_profile(ledger: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One line per column: filled, empty, numeric and distinct cells."""
    filled = F.col("value") != ""
    return (
        cells_by_value(ledger, columns)
        .groupBy("column")
        .agg(
            F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("non_empty"),
            F.sum(F.when(~filled, F.col("n")).otherwise(0)).alias("empty"),
            F.sum(F.when(is_number(F.col("value")), F.col("n")).otherwise(0)).alias("numeric_values"),
            rows_where(filled).alias("distinct_values"),
        )
    )


def column_samples(
    ledger: DataFrame, columns: Sequence[str], order: Sequence[str], keep: int = 5
) -> DataFrame:
    """The first distinct values of every column, in ledger order (a report of `keep` lines per column)."""
    first_seen = Window.partitionBy("column").orderBy("seen", "value")
    return (
        cells_by_value(ledger, columns, order)
        .filter("value <> ''")
        .withColumn("position", F.row_number().over(first_seen))
        .filter(F.col("position") <= keep)
        .select("column", F.col("position").cast("bigint").alias("position"), "value")
    )


def _whole_rows(ledger: DataFrame, columns: Sequence[str]) -> DataFrame:
    return ledger.groupBy(*[cell(c).alias(c) for c in columns]).agg(F.count("*").alias("copies"))


def copy_groups(ledger: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole rows, as written, that stand in the ledger more than once."""
    return _whole_rows(ledger, columns).filter("copies > 1")


def conflict_groups(ledger: DataFrame, mapping: Mapping) -> DataFrame:
    """Non-blank keys with several trimmed amounts, blank included, before any cleaning; none without a key column."""
    if not mapping.key:
        return ledger.limit(0).select(*[F.lit("").alias(c) for c in ("key", "low", "high")])
    return (
        ledger.select(cell(mapping.key).alias("key"), strip(cell(mapping.amount)).alias("amount"))
        .filter("key <> ''")
        .groupBy("key")
        .agg(F.min("amount").alias("low"), F.max("amount").alias("high"))
        .filter("low <> high")
    )


def supported_codes(rates: DataFrame, mapping: Mapping, target: str) -> DataFrame:
    """The reporting currency and every code of the rates table, also of rates that cannot be read."""
    codes = rates.select(F.upper(strip(cell(mapping.rates.currency))).alias("code")).filter("code <> ''")
    return codes.union(codes.sparkSession.range(1).select(F.lit(target).alias("code"))).distinct()


def currency_codes(ledger: DataFrame, mapping: Mapping, rates: DataFrame, target: str) -> DataFrame:
    """(code, rows, supported): the codes found in the ledger; none without a currency column."""
    if not mapping.currency:
        return ledger.limit(0).select(F.lit("").alias("code"), F.lit(0).cast("bigint").alias("rows"), F.lit(True).alias("supported"))
    found = (
        ledger.groupBy(F.upper(strip(cell(mapping.currency))).alias("code"))
        .agg(F.count("*").alias("rows"))
        .filter("code <> ''")
    )
    known = supported_codes(rates, mapping, target).withColumn("known", F.lit(True))
    return found.join(known, "code", "left").select(
        "code", "rows", F.coalesce("known", F.lit(False)).alias("supported")
    )


def ledger_counts(ledger: DataFrame, mapping: Mapping) -> DataFrame:
    """One row: rows, missing dates, missing amounts, dates that look ambiguous."""
    day = cell(mapping.date)
    return ledger.agg(
        F.count("*").alias("rows"),
        rows_where(is_blank(day)).alias("missing_dates"),
        rows_where(is_blank(cell(mapping.amount))).alias("missing_amounts"),
        rows_where(looks_ambiguous(strip(day))).alias("ambiguous_dates"),
    )


def row_counts(ledger: DataFrame, mapping: Mapping, columns: Sequence[str]) -> DataFrame:
    """One row: ledger_counts and the number of copy_groups; cells are looked at once per distinct row, without a scan of their own."""
    if not {mapping.date, mapping.amount} <= set(columns):
        copies = copy_groups(ledger, columns).agg(F.count("*").alias("exact_duplicate_groups"))
        return ledger_counts(ledger, mapping).unionByName(copies, allowMissingColumns=True)
    day, n = F.col(mapping.date), F.col("copies")

    def of(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return _whole_rows(ledger, columns).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        of(is_blank(day)).alias("missing_dates"),
        of(is_blank(F.col(mapping.amount))).alias("missing_amounts"),
        of(looks_ambiguous(strip(day))).alias("ambiguous_dates"),
        rows_where(n > 1).alias("exact_duplicate_groups"),
    )


def quality(
    ledger: DataFrame, mapping: Mapping, rates: DataFrame, policy: Policy, columns: Sequence[str]
) -> DataFrame:
    """One row: every finding and the score, 100 less the capped deductions, never below 0."""
    parts = [
        row_counts(ledger, mapping, columns),
        conflict_groups(ledger, mapping).agg(F.count("*").alias("conflicting_duplicate_groups")),
        currency_codes(ledger, mapping, rates, policy.target_currency).agg(
            rows_where(~F.col("supported")).alias("unsupported_currencies")
        ),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    names = merged.columns
    found = merged.agg(*[F.max(c).alias(c) for c in names]).withColumn(
        "missing_values", F.col("missing_dates") + F.col("missing_amounts")
    )
    taken = [F.least(F.col(c) * each, F.lit(most)) for c, (each, most) in DEDUCTIONS.items()]
    return found.withColumn("score", F.greatest(F.lit(0), F.lit(100) - sum(taken, F.lit(0))).cast("bigint"))


def health(score: Column) -> Column:
    band = F.lit(None)
    for label, floor in sorted(HEALTH_BANDS.items(), key=lambda kv: kv[1]):
        band = F.when(score >= floor, label).otherwise(band)
    return band


def findings(profile: DataFrame) -> DataFrame:
    """One line per kind of finding that occurs, with the health band and the number of issues."""
    kinds = [
        "exact_duplicate_groups",
        "conflicting_duplicate_groups",
        "missing_dates",
        "missing_amounts",
        "ambiguous_dates",
        "unsupported_currencies",
    ]
    issues = sum((F.col(k) for k in kinds[:-1]), F.lit(0)).cast("bigint")
    lines = F.array(*[F.struct(F.lit(k).alias("finding"), F.col(k).cast("bigint").alias("n")) for k in kinds])
    return (
        profile.select(F.explode(lines).alias("line"), health(F.col("score")).alias("health"), issues.alias("issues"))
        .select("line.finding", "line.n", "health", "issues")
        .filter("n > 0")
    )


def category_columns(ledger: DataFrame, mapping: Mapping, columns: Sequence[str]) -> DataFrame:
    """Candidate category columns with their position, numeric share test and distinct values (case folded).

    No row if every column plays a role.
    """
    skip = mapping.roles()
    free = [c for c in columns if c not in skip and not c.lower().replace(" ", "_").endswith("id")]
    if not free:
        empty = "column string, filled bigint, numeric bigint, distinct_values bigint, position bigint, usable boolean"
        return ledger.sparkSession.createDataFrame([], empty)
    position = F.array_position(F.array(*[F.lit(c) for c in free]), F.col("column"))
    return (
        cells_by_value(ledger, free)
        .filter("value <> ''")
        .groupBy("column", F.lower("value").alias("folded"))
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(is_number(F.col("value"), special=False), F.col("n")).otherwise(0)).alias("numeric"),
        )
        .groupBy("column")
        .agg(F.sum("n").alias("filled"), F.sum("numeric").alias("numeric"), F.count("*").alias("distinct_values"))
        .withColumn("position", position)
        .withColumn(
            "usable", (F.col("numeric") * 2 < F.col("filled")) & F.col("distinct_values").between(2, 20)
        )
    )


def category_choice(ledger: DataFrame, mapping: Mapping, columns: Sequence[str]) -> DataFrame:
    """The first usable candidate; no row if there is none."""
    usable = category_columns(ledger, mapping, columns).filter("usable")
    return usable.orderBy("position").limit(1).select(F.col("column").alias("category"), "distinct_values")
