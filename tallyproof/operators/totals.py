"""Totals of every cleaning stage from one pass, and the answer that follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.config import BLANK_LABEL, BLOCK_ANSWER, EXCLUDE_REFUNDS, Mapping, Policy, Request
from tallyproof.functions.dates import is_ambiguous, proves
from tallyproof.functions.money import MONEY, amount_or_zero, rows_where, total
from tallyproof.functions.text import strip
from tallyproof.operators.clean import cells, marked_rows, surviving_rows
from tallyproof.operators.prepare import dealt, matches, prepare, with_value
from tallyproof.operators.refunds import priced_refunds, refund_totals
from tallyproof.operators.skew import Parts

CARRY = ["is_missing", "in_scope", "value", "unsupported", "foreign", "ambiguous", "lost_digits"]
_PLAIN_ROWS = ["raw_rows", "missing_rows", "ambiguous_rows", "dedup_rows"]
_PLAIN_SUMS = ["raw_total", "dedup_total"]
_CLEAN_ROWS = ["unsupported_rows", "foreign_rows", "lost_digit_rows"]


def stage_totals(rows: DataFrame | Parts, target: str, by: Sequence[str] = (), keyed: bool = True) -> DataFrame:
    """Rows and converted amount in scope: as found, after exact copies, after conflicts. One scan, but for hot keys.

    `by` names report columns that follow from entity and date; not `keyed` is a ledger without a key column.
    """
    scope, ambiguous = F.col("in_scope"), F.col("ambiguous")
    flags = {
        "foreign": F.col("cur_eff") != target,
        "ambiguous": is_ambiguous(F.col("txn_date"), F.col("other_date")),
    }
    rows = rows.each(lambda part: part.withColumns(flags)) if isinstance(rows, Parts) else rows.withColumns(flags)
    per_copy = [
        rows_where(scope).alias("raw_rows"),
        total(F.when(scope, F.col("value"))).alias("raw_total"),
        rows_where(scope & ambiguous).alias("ambiguous_rows"),
        rows_where(F.col("is_missing") & F.col("in_entity")).alias("missing_rows"),
    ]

    def per_first(first: Column) -> list[Column]:
        counted = first & scope
        return [
            rows_where(counted).alias("dedup_rows"),
            total(F.when(counted, F.col("value"))).alias("dedup_total"),
            rows_where(counted & F.col("unsupported")).alias("unsupported_rows"),
            rows_where(counted & F.col("foreign")).alias("foreign_rows"),
            rows_where(counted & F.col("lost_digits")).alias("lost_digit_rows"),
            total(F.when(counted & ambiguous, F.col("value"))).alias("ambiguous_total"),
        ]

    found = cells(rows, by, CARRY, per_copy, per_first, keyed)
    clean, conflict = ~F.col("is_conflict"), F.col("is_conflict")

    def rows_of(c: str, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(c)) if where is not None else F.col(c)), F.lit(0)).cast("bigint")

    return found.groupBy(*by).agg(
        *[rows_of(c).alias(c) for c in _PLAIN_ROWS],
        *[total(F.col(c)).alias(c) for c in _PLAIN_SUMS],
        rows_of("dedup_rows", clean).alias("final_rows"),
        total(F.when(clean, F.col("dedup_total"))).alias("final_total"),
        *[rows_of(c, clean).alias(c) for c in _CLEAN_ROWS],
        total(F.when(clean, F.col("ambiguous_total"))).alias("ambiguous_total"),
        rows_of("dedup_rows", conflict).alias("conflict_rows"),
        rows_where(conflict & (F.col("dedup_rows") > 0)).alias("conflict_keys"),
    )


def answers(
    ledger: DataFrame,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    request: Request,
    refunds: DataFrame | None = None,
    by: Sequence[str] = (),
    derive=None,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """The verified figure per report row, with every stage total next to it.

    `derive` may add report columns to the prepared ledger, e.g. the quarter of the date; the same function is
    applied to refunds, whose date is the refund's own. It may use the columns over the raw ledger in `keep`,
    which refunds have from their order.
    """
    derive, keep = derive or (lambda df: df), keep or {}
    kept = [c.alias(name) for name, c in keep.items()]
    prepared = dealt(ledger, mapping).each(lambda part: derive(prepare(part, mapping, policy, request, kept)))
    # priced behind the window, so that no generated method both parses and prices rows
    marked = prepared._replace(cold=marked_rows(prepared.cold)) if mapping.key else prepared
    found = stage_totals(marked.each(lambda part: with_value(part, rates, policy)), policy.target_currency, by, bool(mapping.key))
    if not takes_refunds(refunds, mapping, policy, request):
        return settled(found, None, policy, request, by)
    priced = priced_refunds(refunds, prepared, rates, mapping, policy, request, list(keep))
    return settled(found, refund_totals(derive(priced), by), policy, request, by)


def settled(found: DataFrame, refunded: DataFrame | None, policy: Policy, request: Request, by: Sequence[str] = ()) -> DataFrame:
    """Stage totals and refund totals of the same report rows put together, with status and result."""
    if refunded is not None:
        found = found.unionByName(refunded, allowMissingColumns=True)
    else:
        found = found.withColumn("refund_rows", F.lit(0)).withColumn("refund_total", F.lit(0).cast(MONEY))
        found = found.withColumn("refund_unsupported", F.lit(0))
    sums = [c for c in found.columns if c not in by]
    merged = found.groupBy(*by).agg(
        *[
            (total(F.col(c)) if c.endswith("_total") else F.coalesce(F.sum(c), F.lit(0)).cast("bigint")).alias(c)
            for c in sums
        ]
    )
    return with_status(merged, policy, request)


def takes_refunds(refunds: DataFrame | None, mapping: Mapping, policy: Policy, request: Request) -> bool:
    """Only sums of the ledger's own amount have refunds, and only a key leads from a refund to its rows."""
    if refunds is None or mapping.key is None or policy.refunds == EXCLUDE_REFUNDS:
        return False
    return request.agg == "sum" and request.metric in (None, mapping.amount)


def with_status(found: DataFrame, policy: Policy, request: Request) -> DataFrame:
    """status, reason and result; a strict policy withholds the figure instead of leaving rows out.

    A sum over amounts, or with rates, that cannot be held digit by digit is withheld under every policy.
    """
    no_rate = F.lit(policy.unsupported_currency == BLOCK_ANSWER) & (F.col("unsupported_rows") > 0)
    conflict = F.lit(policy.conflicting_duplicate == BLOCK_ANSWER) & (F.col("conflict_keys") > 0)
    digits = F.lit(request.agg == "sum") & (F.col("lost_digit_rows") > 0)
    reason = F.concat_ws(
        "; ",
        F.when(no_rate, F.concat(F.col("unsupported_rows").cast("string"), F.lit(" rows without a rate"))),
        F.when(conflict, F.concat(F.col("conflict_keys").cast("string"), F.lit(" keys with conflicting amounts"))),
        F.when(digits, F.concat(F.col("lost_digit_rows").cast("string"), F.lit(" amounts or rates with too many digits"))),
    )
    figure = (
        F.col("final_rows").cast(MONEY)
        if request.agg == "count"
        else (F.col("final_total") + F.col("refund_total")).cast(MONEY)
    )
    blocked = no_rate | conflict | digits
    return (
        found.withColumn("status", F.when(no_rate | conflict, "BLOCKED_POLICY").when(digits, "BLOCKED_DIGITS").otherwise("VERIFIED"))
        .withColumn("reason", reason)
        .withColumn("result", F.when(~blocked, figure))
    )


def metadata_count(ledger: DataFrame, mapping: Mapping, request: Request) -> DataFrame:
    """Count for ledgers without a date or amount column: plain rows under the filters, no cleaning."""
    return ledger.filter(matches(ledger, mapping, request)).agg(F.count("*").alias("rows"))


def date_evidence(rows: DataFrame) -> DataFrame:
    """Which slash format the whole file proves, over all rows with a date and an amount."""
    base, other = F.col("txn_date"), F.col("other_date")
    valid = rows.filter(~F.col("is_missing"))
    return valid.agg(
        rows_where(proves(base, other)).alias("only_as_given"),
        rows_where(proves(other, base)).alias("only_as_other"),
        rows_where(is_ambiguous(base, other)).alias("ambiguous"),
        rows_where(base.isNull() & other.isNull()).alias("unreadable"),
    )


def unsupported_by_currency(rows: DataFrame | Parts, multiplier=1) -> DataFrame:
    """In-scope surviving rows without a rate, per effective currency: rows and native amount, both ways."""
    hit = F.col("in_scope") & F.col("unsupported")

    def per_first(first: Column) -> list[Column]:
        counted = first & hit
        return [
            rows_where(counted).alias("rows"),
            F.sum(F.when(counted, amount_or_zero(strip(F.col("amount_raw"))))).alias("native"),
            F.sum(F.when(counted, F.col("amount"))).alias("scaled"),
        ]

    found = cells(rows, ["cur_eff"], ["is_missing", "in_scope", "unsupported", "amount"], [], per_first)
    label = F.when(F.col("cur_eff") == "", F.lit(BLANK_LABEL)).otherwise(F.col("cur_eff"))
    return (
        found.filter(~F.col("is_conflict") & (F.col("rows") > 0))
        .groupBy(label.alias("currency"))
        .agg(
            F.sum("rows").cast("bigint").alias("rows"),
            F.sum("native").cast(MONEY).alias("native_amount"),
            F.sum("scaled").cast(MONEY).alias("native_amount_scaled"),
        )
    )


def unsupported_keys(rows: DataFrame | Parts, limit: int = 25) -> DataFrame:
    """The first keys, in ledger order, of in-scope surviving rows without a rate (a report of `limit` lines)."""
    kept = surviving_rows(rows, ["in_scope", "unsupported", "cur_eff"])
    return kept.filter("in_scope and unsupported").orderBy("row_order", "key").limit(limit)


def conflict_keys_in_scope(rows: DataFrame | Parts) -> DataFrame:
    """Conflicting keys with rows in scope, and how many distinct rows they hold there."""
    found = cells(rows, [], ["is_missing", "in_scope"], [], lambda first: [rows_where(first & F.col("in_scope")).alias("rows")])
    return found.filter("is_conflict and rows > 0").select("key", "rows").orderBy("key")


def conversion_summary(rows: DataFrame | Parts, target: str) -> DataFrame:
    """Foreign currencies among the in-scope surviving rows, one line each, with their rows."""
    found = cells(rows, ["cur_eff"], ["is_missing", "in_scope"], [], lambda first: [rows_where(first & F.col("in_scope")).alias("rows")])
    label = F.when(F.col("cur_eff") == "", F.lit(BLANK_LABEL)).otherwise(F.col("cur_eff"))
    return (
        found.filter("not is_conflict and rows > 0")
        .groupBy(label.alias("currency"), (F.col("cur_eff") != target).alias("is_foreign"))
        .agg(F.sum("rows").cast("bigint").alias("rows"))
        .orderBy("currency")
    )


def evidence_rows(rows: DataFrame | Parts, limit: int | None = 50) -> DataFrame:
    """Cleaned in-scope rows in ledger order: the first `limit`, or all of them with None."""
    carry = ["in_scope", "entity_norm", "txn_date", "cur_eff", "rate", "value", "unsupported"]
    kept = surviving_rows(rows, carry).filter("in_scope")
    return kept if limit is None else kept.orderBy("row_order", "key").limit(limit)
