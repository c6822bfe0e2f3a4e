"""Verified quarter totals against figures somebody reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.config import Mapping, Policy, Request
from tallyproof.functions.money import MONEY
from tallyproof.functions.periods import quarter_of
from tallyproof.operators.prepare import in_range, matches
from tallyproof.operators.sensitivity import percent
from tallyproof.operators.totals import answers

# Status names; a difference up to 0.5 % counts as agreement.
CONTRADICTION = "CONTRADICTION_DETECTED"
CONSISTENT = "CONSISTENT"
NOT_COMPARABLE = "NOT_COMPARABLE"

AS_ASKED = "as asked"
COMPANY_WIDE = "company-wide"


def reported_for(quarters: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds `reported` to rows with year and quarter: the later of the row reported for that quarter and year and
    a row whose label names the quarter only.

    `summary` is as scanned, so there is one row without a year per quarter at most.
    """
    own = summary.filter("year is not null").select(
        "quarter", "year", F.col("reported").alias("own"), F.col("ord").alias("own_ord")
    )
    general = summary.filter("year is null").select(
        "quarter", F.col("reported").alias("general"), F.col("ord").alias("general_ord")
    )
    both = quarters.join(own, ["quarter", "year"], "left").join(F.broadcast(general), "quarter", "left")
    later = F.col("own_ord").isNull() | (F.col("general_ord") > F.col("own_ord"))
    use_general = F.col("general_ord").isNotNull() & later
    return both.withColumn("reported", F.when(use_general, F.col("general")).otherwise(F.col("own"))).drop(
        "own", "own_ord", "general", "general_ord"
    )


def reconcile(verified: DataFrame) -> DataFrame:
    """Adds difference, percent and reconciliation to rows with `result` (company-wide) and `reported`."""
    difference = (F.col("reported") - F.col("result")).cast(MONEY)
    off = (F.col("result") == 0) | (F.abs(difference) * 200 > F.abs(F.col("result")))
    return (
        verified.withColumn("difference", difference)
        .withColumn("percent", percent(difference, F.col("result")))
        .withColumn(
            "reconciliation",
            F.when(F.col("reported").isNull() | F.col("result").isNull(), NOT_COMPARABLE)
            .when(off, CONTRADICTION)
            .otherwise(CONSISTENT),
        )
    )


def _wide(mapping: Mapping, request: Request) -> Request:
    """What a request is compared as: with a filter by entity all filters go."""
    named = request.entities or any(c == mapping.entity for c, _ in request.filters)
    return request.with_(filters=(), entities=()) if named else request


def request_reconciliation(
    ledger: DataFrame,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    request: Request,
    summary: DataFrame,
    refunds: DataFrame | None = None,
) -> DataFrame:
    """One row: the figure asked for, the figure compared, what was reported, and whether they agree.

    Reported figures are company-wide calendar Q4 totals (`summary` as scanned), so a filter by entity is dropped for the
    comparison, and with it all others. A request for another range, without a verified figure, or with nothing reported
    cannot be compared.
    """
    return request_reconciliations(ledger, rates, mapping, policy, {"": request}, summary, refunds).drop("request")


def request_reconciliations(
    ledger: DataFrame,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    requests: dict[str, Request],
    summary: DataFrame,
    refunds: DataFrame | None = None,
) -> DataFrame:
    """request_reconciliation of every named request, all requests for the same kind of figure in one run over the ledger."""
    kinds: dict[tuple, dict[str, Request]] = {}
    for name, request in requests.items():
        kinds.setdefault((request.agg, request.metric), {})[name] = request
    lines = [_lines(ledger, rates, mapping, policy, alike, refunds) for alike in kinds.values()]
    return _compared(reduce(DataFrame.unionByName, lines), summary)


def _lines(ledger, rates, mapping, policy, requests: dict[str, Request], refunds) -> DataFrame:
    """Per request of one kind of figure its own and its company-wide result, from figures cut by the scopes a row is in.

    Scopes may overlap; a row is counted in the one figure for all scopes that it is in, and a scope's result is their sum.
    """
    scopes = list(dict.fromkeys(s for r in requests.values() for s in (r, _wide(mapping, r))))
    keep = {f"asked_{i}": matches(ledger, mapping, s) for i, s in enumerate(scopes)}

    def cut(df: DataFrame) -> DataFrame:
        inside = [F.col(f"asked_{i}") & in_range(F.col("txn_date"), s) for i, s in enumerate(scopes)]
        return df.withColumn("asked", F.concat(*[F.when(i, "1").otherwise("0") for i in inside]))

    kind = next(iter(requests.values()))
    found = answers(ledger, rates, mapping, policy, Request(agg=kind.agg, metric=kind.metric), refunds, ["asked"], cut, keep)
    found = found.select("asked", "status", "result")
    # a request that no row answers has a figure too
    none = found.sparkSession.range(1).select(F.lit("0" * len(scopes)).alias("asked"), F.lit("VERIFIED").alias("status"), F.lit(0).cast(MONEY).alias("result"))

    def part(scope: Request) -> Column:
        return F.substring("asked", scopes.index(scope) + 1, 1) == "1"

    lines = [
        F.struct(F.lit(name).alias("request"), part(r).alias("own"), part(_wide(mapping, r)).alias("wide"), *_asked(mapping, r))
        for name, r in requests.items()
    ]
    named = found.unionByName(none).select("status", "result", F.explode(F.array(*lines)).alias("line")).select("status", "result", "line.*")
    return named.groupBy("request", "year", "quarter", "compared_as").agg(*_figures())


def _asked(mapping: Mapping, request: Request) -> list[Column]:
    """The Q4 that a request asks for, if it asks for one, and how it is compared."""
    quarter = quarter_of(request.start, request.end)
    year = quarter[0] if quarter and quarter[1] == 4 else None
    scope = AS_ASKED if _wide(mapping, request) == request else COMPANY_WIDE
    return [F.lit(year).cast("int").alias("year"), F.lit(4 if year else None).cast("int").alias("quarter"), F.lit(scope).alias("compared_as")]


def _figures() -> list[Column]:
    def figure(part: str) -> Column:
        open_ = F.coalesce(F.max(F.when(F.col(part), F.col("status") != "VERIFIED")), F.lit(False))
        return F.when(~open_, F.coalesce(F.sum(F.when(F.col(part), F.col("result"))), F.lit(0)).cast(MONEY))

    return [figure("own").alias("asked"), figure("wide").alias("result")]


def compare_scopes(rows: DataFrame, mapping: Mapping, request: Request, summary: DataFrame) -> DataFrame:
    """The one row of request_reconciliation, from figures with `own` (part of what was asked) and `wide` (part of what is compared)."""
    line = rows.agg(*_figures()).select("*", *_asked(mapping, request), F.lit("").alias("request"))
    return _compared(line, summary).drop("request")


def _compared(lines: DataFrame, summary: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("asked").isNull(), "no verified figure")
        .when(F.col("year").isNull(), "not a calendar Q4")
        .when(F.col("reported").isNull(), "nothing reported")
        .when(F.col("result").isNull(), "no verified company-wide figure")
        .otherwise("")
    )
    found = reported_for(lines, summary).withColumn("reason", reason)
    held = found.withColumn("reported", F.when(F.col("reason") == "", F.col("reported")))
    compared = F.when(F.col("reason") == "", F.col("result")).cast(MONEY)
    return reconcile(held).select(
        "request",
        F.col("asked").alias("result"),
        compared.alias("compared"),
        F.col("reported").cast(MONEY).alias("reported"),
        "difference",
        F.when(F.col("reason") == "", F.col("percent")).alias("percent"),
        "reconciliation",
        F.when(F.col("reason") == "", F.col("compared_as")).alias("scope"),
        "reason",
    )
