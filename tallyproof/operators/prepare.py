"""From a raw ledger to a prepared one: roles picked, texts parsed, scope marked, amounts converted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.config import LATEST, Mapping, Policy, Request, RequestError
from tallyproof.functions.dates import with_both_readings
from tallyproof.functions.money import amount_or_zero, convert, kept_rate, loses_digits, value_is_lost
from tallyproof.functions.text import cell, effective_currency, entity_key, is_blank, raw_currency, strip
from tallyproof.operators.rates import attach_latest_rate, attach_rate_on
from tallyproof.operators.skew import Parts, apart, cut_by_heat, is_large, marked, marks_of_repeated
from tallyproof.sources.tables import row_order

IDENTITY = ["key", "date_raw", "entity_raw", "amount_raw"]


def _role(name: str | None) -> Column:
    return cell(name) if name else F.lit("")


def prepare(
    ledger: DataFrame,
    mapping: Mapping,
    policy: Policy,
    request: Request | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Typed ledger with scope flags; nothing is dropped, so duplicates can still be told over the whole ledger.

    `in_entity` covers the entity list and the equality filters, `in_scope` adds the date range and is false
    for rows without a date or an amount. `other_date` is the day under the other slash format, `lost_digits` an
    amount with more digits than are kept. Without a key column every row has a key of its own, so that there are no
    copies and no conflicts. A metric the ledger does not have is refused.
    """
    request = request or Request()
    if request.metric and request.metric not in ledger.columns:
        raise RequestError(f"the ledger has no column {request.metric!r}")
    mapping = mapping.measuring(request.metric)
    currency = _role(mapping.currency) if mapping.currency else F.lit(policy.target_currency)
    texts = ledger.select(
        (_role(mapping.key) if mapping.key else F.monotonically_increasing_id().cast("string")).alias("key"),
        _role(mapping.date).alias("date_raw"),
        _role(mapping.entity).alias("entity_raw"),
        _role(mapping.amount).alias("amount_raw"),
        raw_currency(currency).alias("cur_raw"),
        row_order(mapping.order).alias("row_order"),
        strip(_role(mapping.amount)).alias("amount_text"),
        matches(ledger, mapping, request).alias("in_entity"),
        *keep,
    )
    dated = with_both_readings(texts, "date_raw", policy.date_format, "txn_date", "other_date")
    typed = dated.withColumns(
        {
            "entity_norm": entity_key(F.col("entity_raw")),
            "amount": amount_or_zero(F.col("amount_text"), mapping.unit_multiplier),
            "lost_digits": loses_digits(F.col("amount_text"), mapping.unit_multiplier),
            "cur_eff": effective_currency(F.col("cur_raw"), policy.currency_map),
            "is_missing": is_blank(F.col("date_raw")) | is_blank(F.col("amount_raw")),
        }
    )
    inside = F.col("in_entity") & ~F.col("is_missing") & in_range(F.col("txn_date"), request)
    return typed.withColumn("in_scope", inside).drop("amount_text")


def dealt(ledger: DataFrame, mapping: Mapping) -> Parts:
    """The raw ledger cut by the heat of its keys, ordinary ones dealt by key, others evenly.

    Rows prepared from it are cleaned without another shuffle, and their texts are parsed behind the shuffle. Readers of the
    same columns share it. Of a large ledger only rows whose key repeats are dealt: a row that has its key for itself is no
    copy and in no conflict, and stays where it is read.
    """
    if not mapping.key:
        return Parts(ledger, None)
    key = _role(mapping.key)
    cold, hot, lone = cut_by_heat(ledger, key)
    if is_large(ledger):
        repeated = marks_of_repeated(cold, key)
        cold, lone = marked(cold, key, repeated), apart(marked(cold, key, repeated, inside=False))
    # rows of hot keys go round the tasks, so that what reads them again does not read the ledger
    return Parts(cold.repartition(key), None if hot is None else hot.hint("rebalance"), lone)


def matches(ledger: DataFrame, mapping: Mapping, request: Request) -> Column:
    """Entity list and equality filters; columns the ledger does not have are ignored (see requests)."""
    condition = F.lit(True)
    entity = entity_key(_role(mapping.entity))
    if request.entities:
        condition &= entity.isin(*[entity_key_text(e) for e in request.entities])
    for column, value in request.filters:
        if column == mapping.entity:
            condition &= entity == entity_key(F.lit(value))
        elif column in ledger.columns:
            condition &= cell(column) == value
    return condition


def entity_key_text(value: str) -> str:
    return value.strip().lower()


def in_range(day: Column, request: Request) -> Column:
    if request.start is None:
        return F.lit(True)
    return F.coalesce(day.between(F.lit(request.start), F.lit(request.end)), F.lit(False))


def with_value(rows: DataFrame, rates: DataFrame, policy: Policy, **limits) -> DataFrame:
    """Adds rate, value (cents, half up) and `unsupported` for rows no rate exists for.

    A rate of too many digits is shown as NULL, the row has `lost_digits`.
    """
    if policy.basis == LATEST:
        rated = attach_latest_rate(rows, rates, policy.target_currency, **limits)
    else:
        rated = attach_rate_on(rows, rates, policy.target_currency, "txn_date", **limits)
    amount, rate = F.col("amount"), F.col("rate")
    lost = F.col("lost_digits") | value_is_lost(amount, rate)
    return rated.withColumns({"value": convert(amount, rate), "unsupported": rate.isNull(), "lost_digits": lost, "rate": kept_rate(rate)})
