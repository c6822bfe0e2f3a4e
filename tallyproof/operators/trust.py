"""The verdict on a figure, and whether evidence may be issued for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.operators.reconcile import CONTRADICTION

# Verdicts and what they allow.
REFUSED, BLOCKED, REVIEW, VERIFIED = "REFUSED", "BLOCKED", "VERIFIED_WITH_POLICY", "VERIFIED"
PUBLISH = {
    REFUSED: "EXTERNAL_REPORTING_BLOCKED",
    BLOCKED: "EXTERNAL_REPORTING_BLOCKED",
    REVIEW: "MANAGEMENT_REVIEW_REQUIRED",
    VERIFIED: "INTERNAL_EXPLORATION_OK",
}


def verdict(rows: DataFrame) -> DataFrame:
    """Adds decision, publishability and reasons to audit rows.

    Expects status, status_b, result, result_b, reconciliation (may be NULL), unsupported_rows, conflict_keys
    and final_rows. The first rule that applies decides.
    """
    refused = (F.col("status") == "REFUSED") | (F.col("status_b") == "REFUSED")
    failed = (F.col("status") != "VERIFIED") | (F.col("status_b") != "VERIFIED")
    differ = ~F.col("result").eqNullSafe(F.col("result_b"))
    contradicted = F.coalesce(F.col("reconciliation") == CONTRADICTION, F.lit(False))
    no_rate, conflict = F.col("unsupported_rows") > 0, F.col("conflict_keys") > 0
    empty = F.col("final_rows") == 0
    decision = (
        F.when(refused, REFUSED)
        .when(failed | differ, BLOCKED)
        .when(contradicted | no_rate | conflict | empty, REVIEW)
        .otherwise(VERIFIED)
    )
    publish = F.when(F.lit(False), F.lit(""))
    for name, allowed in PUBLISH.items():
        publish = publish.when(F.col("decision") == name, allowed)
    review = F.concat_ws(
        "; ",
        F.when(contradicted, "reported figure differs"),
        F.when(no_rate, "rows without a rate"),
        F.when(conflict, "conflicting amounts"),
        F.when(empty, "no data in scope"),
    )
    reasons = (
        F.when(refused, "request refused")
        .when(failed, "a route did not verify")
        .when(differ, "routes disagree")
        .otherwise(review)
    )
    return rows.withColumn("decision", decision).withColumn("publishability", publish).withColumn("reasons", reasons)


def issuable(rows: DataFrame) -> DataFrame:
    """Only figures both routes verified and agree on."""
    return rows.filter((F.col("status") == "VERIFIED") & (F.col("status_b") == "VERIFIED")).filter(
        F.col("result").eqNullSafe(F.col("result_b"))
    )
