"""The figure under other readings of the same ledger, all from one scan.

Copies and conflicts go by raw text and so do not depend on the reading. Each reading is a value and a scope
column on the same rows, summed side by side.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.config import BLOCK_ANSWER, LATEST, Mapping, Policy, Request
from tallyproof.functions.dates import is_ambiguous, proves
from tallyproof.functions.money import MONEY, convert, rows_where, total, value_is_lost
from tallyproof.functions.periods import quarter_of, quarter_window
from tallyproof.operators.clean import cells
from tallyproof.operators.prepare import dealt, in_range, prepare
from tallyproof.operators.rates import attach_latest_rate, attach_rate_on
from tallyproof.operators.refunds import match_refunds
from tallyproof.operators.totals import takes_refunds
from tallyproof.sources.tables import scan_rates

# Names of the readings and what a change means.
ASSESSMENT = {
    "date_format": "format not established by data",
    "quarter_definition": "genuinely ambiguous label",
    "refunds": "policy choice",
    "conversion_basis": "policy choice (confirmed by the user)",
}
FORMAT_PROVED = "format established by data"
READINGS = ["base", *ASSESSMENT]


def other_quarter(request: Request) -> tuple[dt.date, dt.date] | None:
    """The window of the same quarter number under the other kind of year, if the range is exactly a quarter."""
    calendar = quarter_of(request.start, request.end)
    if calendar:
        return quarter_window(*calendar, fiscal=True)
    fiscal = quarter_of(request.start, request.end, fiscal=True)
    return quarter_window(*fiscal) if fiscal else None


def _with_rates(
    rows: DataFrame, rates: DataFrame, rates_other: DataFrame, policy: Policy, day: str, other_day: str
) -> DataFrame:
    """rate_base, rate_date_format, rate_conversion_basis."""
    target = policy.target_currency
    if policy.basis == LATEST:
        rows = attach_latest_rate(rows, rates, target, "rate_base")
        rows = attach_latest_rate(rows, rates_other, target, "rate_date_format")
        return attach_rate_on(rows, rates, target, day, "rate_conversion_basis")
    rows = attach_rate_on(rows, rates, target, day, "rate_base")
    rows = attach_rate_on(rows, rates_other, target, other_day, "rate_date_format")
    return attach_latest_rate(rows, rates, target, "rate_conversion_basis")


def _scopes(day: str, other_day: str, request: Request) -> dict[str, tuple[Column, str]]:
    """Scope of each reading, and the reading whose rate it uses."""
    alternative = other_quarter(request)
    base, other = in_range(F.col(day), request), in_range(F.col(other_day), request)
    if alternative:
        quarter = in_range(F.col(day), request.with_(start=alternative[0], end=alternative[1]))
    else:
        quarter = F.lit(False)
    ranges = {"base": base, "date_format": other, "quarter_definition": quarter, "conversion_basis": base}
    return {
        name: (F.coalesce(F.col("in_entity") & scope, F.lit(False)), "base" if name == "quarter_definition" else name)
        for name, scope in ranges.items()
    }


def _values(amount: str, day: str, other_day: str, request: Request) -> dict[str, Column]:
    """Value of a row inside the scope of each reading, 1 for counts, and 0 outside."""
    return {
        name: F.when(scope, F.lit(1) if request.agg == "count" else convert(F.col(amount), F.col(f"rate_{rate}")))
        .otherwise(0)
        .cast("decimal(29,2)")
        for name, (scope, rate) in _scopes(day, other_day, request).items()
    }


def _lost(amount: str, rate: str) -> Column:
    return F.col("lost_digits") | value_is_lost(F.col(amount), F.col(f"rate_{rate}"))


def _withheld(policy: Policy, request: Request) -> dict[str, Column]:
    """Rows for which a reading has no figure: no rate under a strict policy, or an amount or rate of too many digits in a sum."""
    strict, summed = F.lit(policy.unsupported_currency == BLOCK_ANSWER), F.lit(request.agg == "sum")
    return {
        name: scope & ~F.col("is_missing") & ((strict & F.col(f"rate_{rate}").isNull()) | (summed & _lost("amount", rate)))
        for name, (scope, rate) in _scopes("txn_date", "other_date", request).items()
    }


def readings(
    ledger: DataFrame,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    request: Request,
    refunds: DataFrame | None = None,
) -> DataFrame:
    """One row: the figure under every reading, and the counters that tell how plausible a reading is.

    A reading is NULL where its own run would be blocked. Counts know no refunds, nor do ledgers without a key and other metrics than the amount.
    `rates` is the raw table, because slash dates in it are read under the format in question too.
    """
    as_given = scan_rates(rates, mapping, policy.date_format)
    as_other = scan_rates(rates, mapping, policy.other_format)
    prepared = dealt(ledger, mapping).each(lambda part: prepare(part, mapping, policy, request))
    values = _values("amount", "txn_date", "other_date", request)
    base_day, other_day = F.col("txn_date"), F.col("other_date")

    def read(part: DataFrame) -> DataFrame:
        rated = _with_rates(part, as_given, as_other, policy, "txn_date", "other_date")
        for name, value in values.items():
            rated = rated.withColumn(f"v_{name}", F.when(F.col("is_missing"), 0).otherwise(value).cast("decimal(29,2)"))
        for name, withheld in _withheld(policy, request).items():
            rated = rated.withColumn(f"w_{name}", withheld)
        if policy.conflicting_duplicate == BLOCK_ANSWER:
            for name, (scope, _) in _scopes("txn_date", "other_date", request).items():
                rated = rated.withColumn(f"s_{name}", scope & ~F.col("is_missing"))
        ambiguous = F.col("in_scope") & is_ambiguous(base_day, other_day)
        return rated.withColumn("ambiguous", ambiguous).withColumn(
            "foreign", F.col("in_scope") & (F.col("cur_eff") != policy.target_currency)
        )

    rated = prepared.each(read)
    flags = [c for c in rated.cold.columns if c in {f"{k}_{n}" for k in "ws" for n in values}]
    valid = ~F.col("is_missing")
    per_copy = [
        rows_where(F.col("in_scope")).alias("scope_rows"),
        rows_where(F.col("ambiguous")).alias("ambiguous_rows"),
        rows_where(valid & proves(base_day, other_day)).alias("only_as_given"),
        rows_where(valid & proves(other_day, base_day)).alias("only_as_other"),
    ]
    counted = ["scope_rows", "ambiguous_rows", "only_as_given", "only_as_other"]

    def per_first(first: Column) -> list[Column]:
        return [
            *[F.sum(F.when(first, F.col(f"v_{n}"))).alias(n) for n in values],
            F.sum(F.when(first & F.col("ambiguous"), F.col("v_base"))).alias("ambiguous_total"),
            rows_where(first & F.col("foreign")).alias("foreign_rows"),
            *[rows_where(first & F.col(c)).alias(f"n_{c}") for c in flags],
        ]

    carry = ["is_missing", "ambiguous", "foreign", *[f"v_{n}" for n in values], *flags]
    found = cells(rated, [], carry, per_copy, per_first, bool(mapping.key))
    clean = ~F.col("is_conflict")
    found = found.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counted],
        *[total(F.when(clean, F.col(n))).alias(n) for n in values],
        total(F.when(clean, F.col("ambiguous_total"))).alias("ambiguous_total"),
        F.coalesce(F.sum(F.when(clean, F.col("foreign_rows"))), F.lit(0)).cast("bigint").alias("foreign_rows"),
        total(F.when(clean, F.col("base"))).alias("refunds"),
        *[
            F.coalesce(F.sum(F.when(clean if c[0] == "w" else F.col("is_conflict"), F.col(f"n_{c}"))), F.lit(0)).cast("bigint").alias(c)
            for c in flags
        ],
    )
    found, flags = found.withColumn("w_refunds", F.col("w_base")), [*flags, "w_refunds"]
    if refunds is None or request.agg == "count" or not mapping.key or request.metric not in (None, mapping.amount):
        return _without_blocked(found, flags)
    less = _refund_readings(refunds, prepared, as_given, as_other, mapping, policy, request)
    names = found.columns
    both = found.unionByName(less, allowMissingColumns=True)
    return _without_blocked(both.agg(*[F.sum(c).cast(found.schema[c].dataType).alias(c) for c in names]), flags)


def _without_blocked(found: DataFrame, flags: list[str]) -> DataFrame:
    def open_only(name: str) -> Column:
        own = {f"w_{name}", "s_base" if name == "refunds" else f"s_{name}"}
        return F.when(~reduce(or_, [F.col(c) > 0 for c in flags if c in own]), F.col(name))

    return found.withColumns({n: open_only(n) for n in ["base", *ASSESSMENT]}).drop(*flags)


def _refund_readings(refunds, prepared, as_given, as_other, mapping, policy, request) -> DataFrame:
    """What refunds take from every reading, and how many of them withhold it for their digits.

    The `refunds` reading is the one with the policy flipped.
    """
    matched = match_refunds(refunds, prepared, mapping, policy).filter("matched")
    rated = _with_rates(matched, as_given, as_other, policy, "ref_date", "other_ref_date")
    values = _values("ref_amount", "ref_date", "other_ref_date", request)
    taken = takes_refunds(refunds, mapping, policy, request)
    sums = [(-total(v if taken else F.lit(0))).cast(MONEY).alias(n) for n, v in values.items()]
    flipped = F.lit(0) if taken else values["base"]
    lost = {n: scope & _lost("ref_amount", rate) for n, (scope, rate) in _scopes("ref_date", "other_ref_date", request).items()}
    withheld = [rows_where(is_lost if taken else F.lit(False)).alias(f"w_{n}") for n, is_lost in lost.items()]
    withheld.append(rows_where(F.lit(False) if taken else lost["base"]).alias("w_refunds"))
    return rated.agg(*sums, (-total(flipped)).cast(MONEY).alias("refunds"), *withheld)


def _applies(name: str, request: Request, has_refunds: bool) -> Column:
    if name == "quarter_definition":
        return F.lit(other_quarter(request) is not None)
    if name == "refunds":
        return F.lit(has_refunds)
    return F.col("foreign_rows") > 0 if name == "conversion_basis" else F.lit(True)


def _format_proved() -> Column:
    return (F.col("only_as_given") > 0) & (F.col("only_as_other") == 0)


def percent(part: Column, whole: Column) -> Column:
    """One decimal; NULL of nothing."""
    share = F.abs(part).cast("double") / F.nullif(F.abs(whole), F.lit(0)).cast("double") * 100
    return F.round(share, 1).cast("decimal(38,1)")


def sensitivity(found: DataFrame, request: Request, has_refunds: bool) -> DataFrame:
    """(scenario, result, difference, percent, assessment): one line per reading that applies."""
    lines = F.array_compact(
        F.array(
            *[
                F.when(
                    _applies(name, request, has_refunds),
                    F.struct(
                        F.lit(name).alias("scenario"),
                        F.col(name).alias("result"),
                        F.when(_format_proved(), FORMAT_PROVED).otherwise(text).alias("assessment")
                        if name == "date_format"
                        else F.lit(text).alias("assessment"),
                    ),
                )
                for name, text in ASSESSMENT.items()
            ]
        )
    )
    difference = (F.col("line.result") - F.col("base")).cast(MONEY)
    return found.select("base", F.explode(lines).alias("line")).select(
        "line.scenario",
        F.col("base").alias("base_result"),
        "line.result",
        difference.alias("difference"),
        percent(difference, F.col("base")).alias("percent"),
        "line.assessment",
    )


def exposure(found: DataFrame) -> DataFrame:
    """Date-format exposure: the ambiguous rows' amount if the file proves its format, else the full swing."""
    swing = F.when(_format_proved(), F.abs("ambiguous_total")).otherwise(F.abs(F.col("date_format") - F.col("base")))
    return found.withColumn("format_proved", _format_proved()).withColumn("exposed", swing.cast(MONEY))


def materiality(found: DataFrame, request: Request, has_refunds: bool) -> DataFrame:
    """Adds `worst` (amount), `worst_percent` and the grade: below 0.5 % Low, below 5 % Medium, else High; NULL for a blocked figure."""
    sized = exposure(found)
    moves = [
        F.when(_applies(n, request, has_refunds), F.abs(F.col(n) - F.col("base")))
        for n in ASSESSMENT
        if n != "date_format"
    ]
    worst = F.when(F.col("base").isNotNull(), F.greatest(F.col("exposed"), *moves)).cast(MONEY)
    whole = F.abs(F.col("base"))
    grade = (
        F.when((whole == 0) | (worst * 200 < whole), "Low").when(worst * 20 < whole, "Medium").otherwise("High")
    )
    return (
        sized.withColumn("worst", worst)
        .withColumn("worst_percent", F.when(whole.isNotNull(), F.coalesce(percent(worst, F.col("base")), F.lit(0).cast("decimal(38,1)"))))
        .withColumn("materiality", F.when(whole.isNotNull(), grade))
    )
