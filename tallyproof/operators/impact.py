"""What every cleaning rule did to a figure, out of one row of stage totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.functions.money import MONEY

# Names of the effects, in the order that settles ties.
EFFECTS = {
    "duplicate rows": "duplicate_effect",
    "conflicting invoices": "conflict_effect",
    "refunds": "refund_effect",
}
UNKNOWN_VALUE = "rows excluded without a convertible amount (value unknown)"
NONE_FOUND = "None identified"


def effects(found: DataFrame, agg: str = "sum") -> DataFrame:
    """Adds the effect columns and `reconciles` to rows of answers(): raw + effects = result. Only sums can reconcile."""
    duplicate = F.col("dedup_total") - F.col("raw_total")
    conflict = F.col("final_total") - F.col("dedup_total")
    return (
        found.withColumn("duplicate_effect", duplicate.cast(MONEY))
        .withColumn("conflict_effect", conflict.cast(MONEY))
        .withColumn("refund_effect", F.col("refund_total").cast(MONEY))
        .withColumn(
            "reconciles",
            F.lit(agg == "sum")
            & F.coalesce(
                F.col("raw_total") + duplicate + conflict + F.col("refund_total") == F.col("result"), F.lit(False)
            ),
        )
    )


def waterfall(found: DataFrame, by: Sequence[str] = (), agg: str = "sum") -> DataFrame:
    """(by, step, label, amount): from the raw total to the verified one."""
    steps = [("raw total", "raw_total"), *EFFECTS.items(), ("verified total", "result")]
    lines = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("step"), F.lit(n).alias("label"), F.col(c).cast(MONEY).alias("amount")
            )
            for i, (n, c) in enumerate(steps, 1)
        ]
    )
    return effects(found, agg).select(*by, "reconciles", F.explode(lines).alias("line")).select(*by, "line.*", "reconciles")


def largest_risk(found: DataFrame) -> DataFrame:
    """Adds `risk` and `risk_amount`: the largest absolute effect, the first listed on a tie."""
    sized = effects(found)
    worst = F.greatest(*[F.abs(F.col(c)) for c in EFFECTS.values()])
    name: Column = F.lit(None)
    for label, column in reversed(EFFECTS.items()):
        name = F.when(F.abs(F.col(column)) == worst, F.lit(label)).otherwise(name)
    left_out = (F.col("unsupported_rows") > 0) | (F.col("missing_rows") > 0)
    return sized.withColumn("risk_amount", worst.cast(MONEY)).withColumn(
        "risk", F.when(worst > 0, name).when(left_out, UNKNOWN_VALUE).otherwise(NONE_FOUND)
    )


def cleanup_actions(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, position, action, items): what to repair at the source, most important first."""
    wanted = [
        ("resolve conflicting amounts", "conflict_keys"),
        ("add exchange rates", "unsupported_rows"),
        ("supply dates or amounts", "missing_rows"),
        ("remove exact duplicates", "repeated_rows"),
    ]
    counted = found.withColumn("repeated_rows", F.col("raw_rows") - F.col("dedup_rows"))
    lines = F.array(
        *[
            F.when(
                F.col(c) > 0,
                F.struct(
                    F.lit(i).cast("bigint").alias("position"),
                    F.lit(n).alias("action"),
                    F.col(c).cast("bigint").alias("items"),
                ),
            )
            for i, (n, c) in enumerate(wanted, 1)
        ]
    )
    none = F.array(
        F.struct(
            F.lit(0).cast("bigint").alias("position"),
            F.lit("no cleanup required").alias("action"),
            F.lit(0).cast("bigint").alias("items"),
        )
    )
    needed = F.array_compact(lines)
    return counted.select(*by, F.explode(F.when(F.size(needed) > 0, needed).otherwise(none)).alias("line")).select(
        *by, "line.*"
    )
