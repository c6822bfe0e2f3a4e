"""Refunds: matched to the first surviving row of their order, valued in the order's currency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.config import LATEST, Mapping, Policy, Request
from tallyproof.functions.dates import with_both_readings
from tallyproof.functions.money import amount_or_zero, convert, kept_rate, loses_digits, rows_where, total, value_is_lost
from tallyproof.functions.text import strip
from tallyproof.operators.clean import first_row_per_key
from tallyproof.operators.prepare import in_range
from tallyproof.operators.rates import attach_latest_rate, attach_rate_on
from tallyproof.operators.skew import Parts, fits, is_large, marked, marks_of, salted_join
from tallyproof.sources.tables import scan_refunds

# About 10 MB of keys.
MAX_BROADCAST_KEYS = 200_000


def _orders(keys: DataFrame, prepared: DataFrame | Parts, carry: Sequence[str]) -> DataFrame:
    """The first surviving row of every refunded key, and of every hot one."""
    if isinstance(prepared, Parts):
        # an inner join stays where it is, so that the shuffle of the ledger is the one that its totals have
        found = first_row_per_key(prepared.cold.join(keys.distinct().hint("shuffle_hash"), "key"), carry)
        if prepared.lone is not None:
            near = marked(prepared.lone, F.col("key"), marks_of(keys, F.col("key")))
            found = found.unionByName(near.filter(~F.col("is_missing")).join(keys, "key", "left_semi").select(*found.columns))
        return found if prepared.hot is None else found.unionByName(first_row_per_key(prepared.hot, carry))
    valid = prepared.filter(~F.col("is_missing"))
    if fits(keys.distinct(), MAX_BROADCAST_KEYS):
        return first_row_per_key(valid.join(F.broadcast(keys.distinct()), "key", "left_semi"), carry)
    if is_large(prepared):
        valid = marked(valid, F.col("key"), marks_of(keys, F.col("key")))
    return first_row_per_key(valid.join(keys, "key", "left_semi"), carry)


def match_refunds(
    refunds: DataFrame, prepared: DataFrame | Parts, mapping: Mapping, policy: Policy, carry: Sequence[str] = ()
) -> DataFrame:
    """Every refund with its order's entity and currency; `matched` is false if the order did not survive.

    The ledger is first cut down to the refunded keys, so only their rows are parsed, cleaned and joined. A ledger dealt by
    key (prepare.dealt) is cut where its totals read it, behind the one shuffle that both then share. Otherwise keys counted
    to fit are looked up where the ledger is read, and no row without a refund is shuffled; beyond that the ledger and the
    keys are shuffled by the key alone, without a salt made of the rows' texts; both sides are plain shuffles, so adaptive
    execution splits a hot key. Of a large ledger hardly a row without a refund is shuffled there either: a bitmap of the
    keys is looked at where the rows are read.
    """
    scanned = scan_refunds(refunds, mapping)
    orders = _orders(scanned.select("key"), prepared, ["entity_norm", "cur_eff", "in_entity", *carry])
    # conditions on the parsed date stay above the explode: put where the text is made, they would make it again for each of its parts
    texts = scanned.select("key", "ref_amount_raw", F.explode(F.array("ref_date_raw")).alias("ref_date_raw"))
    dated = with_both_readings(texts, "ref_date_raw", policy.date_format, "ref_date", "other_ref_date", filtered=True)
    typed = dated.withColumn("ref_amount", amount_or_zero(strip(F.col("ref_amount_raw")), mapping.unit_multiplier))
    typed = typed.withColumn("lost_digits", loses_digits(strip(F.col("ref_amount_raw")), mapping.unit_multiplier))
    side = orders.drop("row_order").withColumn("matched", F.lit(True))
    joined = salted_join(typed, side, ["key"], "left", F.struct("ref_date_raw", "ref_amount_raw"))
    return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))


def priced_refunds(
    refunds: DataFrame,
    prepared: DataFrame | Parts,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    request: Request,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Matched refunds in scope: the order's entity and what is in `carry`, the refund's own date, the order's currency."""
    rows = match_refunds(refunds, prepared, mapping, policy, carry).filter("matched")
    if policy.basis == LATEST:
        rated = attach_latest_rate(rows, rates, policy.target_currency)
    else:
        rated = attach_rate_on(rows, rates, policy.target_currency, "ref_date")
    scope = F.col("in_entity") & in_range(F.col("ref_date"), request)
    amount, rate = F.col("ref_amount"), F.col("rate")
    return rated.filter(scope).withColumns(
        {
            "txn_date": F.col("ref_date"),
            "refund_value": convert(amount, rate),
            "unsupported": rate.isNull(),
            "lost_digits": F.col("lost_digits") | value_is_lost(amount, rate),
            "rate": kept_rate(rate),
        }
    )


def refund_totals(priced: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, negative total and rows without a rate."""
    return priced.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("refund_rows"),
        (-total(F.col("refund_value"))).cast("decimal(38,2)").alias("refund_total"),
        rows_where(F.col("unsupported")).alias("refund_unsupported"),
        rows_where(F.col("lost_digits")).alias("lost_digit_rows"),
    )
