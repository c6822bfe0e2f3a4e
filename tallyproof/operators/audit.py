"""Audits of requests over one cleaned copy of a ledger.

What is a copy and what conflicts is decided over the whole ledger and does not depend on what is asked. So it is decided
once, and every row is written with its flags, its value and its texts. The figures of any number of requests, their
refunds, their second route and their reconciliation then read that copy: each is a scan with a partial aggregation, and no
row of the copy is shuffled by its key again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.config import Mapping, Policy, Request, RequestError
from tallyproof.functions.dates import is_ambiguous
from tallyproof.functions.money import rows_where, total
from tallyproof.functions.text import cell, entity_key
from tallyproof.operators import impact, trust
from tallyproof.operators.clean import conflicting_keys, first_copies, marked_rows
from tallyproof.operators.prepare import IDENTITY, dealt, entity_key_text, in_range, prepare, with_value
from tallyproof.operators.reconcile import compare_scopes
from tallyproof.operators.refunds import priced_refunds, refund_totals
from tallyproof.operators.second_route import second_route, second_routes
from tallyproof.operators.skew import is_large, marked, marks_of
from tallyproof.operators.totals import settled, takes_refunds
from tallyproof.sources.tables import scan_rates, scan_refunds, shared_folder, written_once

#: Columns of the ledger that requests may filter by stand in the copy under their name behind this.
KEPT = "column_"


@dataclass(frozen=True)
class CleanLedger:
    """A cleaned copy. `rows` has every row of the ledger with `is_raw`, and what counts after cleaning with `is_first`.

    Rows of ordinary keys carry both flags. For hot keys the surviving copies are rows of their own, without `is_raw`.
    """

    rows: DataFrame
    mapping: Mapping
    policy: Policy
    columns: tuple[str, ...]
    kept: tuple[str, ...] = ()
    metric: str | None = None

    def _filters(self, request: Request) -> list[tuple[str, str]]:
        """Filters by other columns than the entity, under their names in the copy; unknown columns are ignored, as elsewhere."""
        if request.metric not in (self.metric, None if self.metric else self.mapping.amount):
            raise RequestError(f"this copy of the ledger does not measure {request.metric!r}")
        asked = [(c, v) for c, v in request.filters if c != self.mapping.entity and c in self.columns]
        if missing := sorted({c for c, _ in asked} - set(self.kept)):
            raise RequestError("the copy of the ledger was written without " + ", ".join(missing))
        return [(KEPT + c, v) for c, v in asked]

    def inside(self, request: Request) -> Column:
        """Whether a row of the copy meets the entities and filters of a request."""
        inside = F.lit(True)
        if request.entities:
            inside &= F.col("entity_norm").isin(*[entity_key_text(e) for e in request.entities])
        for column, value in request.filters:
            if column == self.mapping.entity:
                inside &= F.col("entity_norm") == entity_key(F.lit(value))
        for column, value in self._filters(request):
            inside &= F.col(column) == value
        return inside

    def scoped(self, request: Request) -> DataFrame:
        """The rows with `in_entity` and `in_scope` of a request."""
        rows = self.rows.withColumn("in_entity", self.inside(request))
        return rows.withColumn("in_scope", F.col("in_entity") & ~F.col("is_missing") & in_range(F.col("txn_date"), request))

    def raw_texts(self, request: Request) -> tuple[DataFrame, Mapping, Request]:
        """The texts as found, without any flag, with the mapping and the request that fit them."""
        names = {"key": "key", "date": "date_raw", "entity": "entity_raw", "amount": "amount_raw", "currency": "currency_raw"}
        mapping = replace(self.mapping, **names, order=("row_order",))
        if not self.mapping.key:
            mapping = replace(mapping, key=None)
        entity = [("entity_raw", v) for c, v in request.filters if c == self.mapping.entity]
        asked = request.with_(filters=(*entity, *self._filters(request)), metric=None)
        texts = self.rows.filter("is_raw").select(*names.values(), "row_order", *[KEPT + c for c in self.kept])
        return texts, mapping, asked


def clean_ledger(
    ledger: DataFrame,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    keep: Sequence[str] = (),
    metric: str | None = None,
    path: str | None = None,
) -> CleanLedger:
    """Cleans the ledger and writes it, to `path` or below spark.checkpoint.dir. `rates` is as scanned.

    The ledger goes through one shuffle by key and one sort. Copies of a hot key collapse before their shuffle, and its
    other rows are spread over the tasks that read them. `keep` names the columns that requests may filter by; a `metric`
    is measured in place of the amount.
    """
    currency = cell(mapping.currency) if mapping.currency else F.lit(policy.target_currency)
    extra = [currency.alias("currency_raw"), *[cell(c).alias(KEPT + c) for c in keep]]

    def read(part: DataFrame) -> DataFrame:
        return prepare(part, mapping, policy, Request(metric=metric), extra).drop("in_entity", "in_scope")

    def priced(part: DataFrame) -> DataFrame:
        return with_value(part, rates, policy).withColumns(
            {
                "foreign": F.col("cur_eff") != policy.target_currency,
                "ambiguous": is_ambiguous(F.col("txn_date"), F.col("other_date")),
            }
        )

    cold, hot, lone = dealt(ledger, mapping).each(read)
    yes, no = F.lit(True), F.lit(False)
    # rows are priced behind the window: one generated method that parses and prices is beyond what the JVM compiles
    rows = priced(marked_rows(cold) if mapping.key else cold.withColumns({"is_first": yes, "is_conflict": no}))
    plain = [c for c in rows.columns if c not in ("is_first", "is_conflict")]
    columns = [*plain, "is_raw", "is_first", "is_conflict"]
    rows = rows.withColumn("is_raw", yes).select(*columns)
    if lone is not None:
        rows = rows.unionByName(priced(lone).withColumns({"is_raw": yes, "is_first": yes, "is_conflict": no}).select(*columns))
    if hot is not None:
        hot = priced(hot)
        carry = [c for c in plain if c not in (*IDENTITY, "row_order")]
        heads = first_copies(hot, carry).withColumns({"is_raw": no, "is_first": yes})
        both = hot.withColumns({"is_raw": yes, "is_first": no}).unionByName(heads)
        # hot keys are a few hundred at most, and so are the conflicting ones among them
        clashing = F.broadcast(conflicting_keys(hot).withColumn("clash", yes))
        marked = both.join(clashing, "key", "left").withColumn("is_conflict", F.coalesce("clash", no))
        rows = rows.unionByName(marked.select(*columns))
    path = path or shared_folder(ledger.sparkSession, "clean-ledger")
    return CleanLedger(written_once(rows, path), mapping, policy, tuple(ledger.columns), tuple(keep), metric)


def stage_totals(scoped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and converted amount in scope as found, after exact copies, after conflicts: totals.stage_totals from the flags."""
    scope, raw, conflict = F.col("in_scope"), F.col("is_raw"), F.col("is_conflict")
    found, first = raw & scope, F.col("is_first") & scope
    clean = first & ~conflict

    def value(where: Column) -> Column:
        return total(F.when(where, F.col("value")))

    return scoped.groupBy(*by).agg(
        rows_where(found).alias("raw_rows"),
        value(found).alias("raw_total"),
        rows_where(raw & F.col("is_missing") & F.col("in_entity")).alias("missing_rows"),
        rows_where(found & F.col("ambiguous")).alias("ambiguous_rows"),
        rows_where(first).alias("dedup_rows"),
        value(first).alias("dedup_total"),
        rows_where(clean).alias("final_rows"),
        value(clean).alias("final_total"),
        *[rows_where(clean & F.col(c)).alias(f"{n}_rows") for n, c in (("unsupported", "unsupported"), ("foreign", "foreign"), ("lost_digit", "lost_digits"))],
        value(clean & F.col("ambiguous")).alias("ambiguous_total"),
        rows_where(first & conflict).alias("conflict_rows"),
        F.count_distinct(F.when(first & conflict, F.col("key"))).alias("conflict_keys"),
    )


def figures(
    clean: CleanLedger,
    rates: DataFrame,
    request: Request,
    refunds: DataFrame | None = None,
    by: Sequence[str] = (),
    derive: Callable[[DataFrame], DataFrame] | None = None,
    refunded: CleanLedger | None = None,
) -> DataFrame:
    """totals.answers from the cleaned copy, column for column. `refunded` is the copy cut down to refunded keys, if there is one."""
    derive, policy = derive or (lambda df: df), clean.policy
    asked = request.with_(metric=clean.metric)
    scoped = derive(clean.scoped(request))
    found = stage_totals(scoped, by)
    if not takes_refunds(refunds, clean.mapping, policy, asked):
        return settled(found, None, policy, asked, by)
    orders = derive((refunded or clean).scoped(request)).filter("is_raw")
    priced = priced_refunds(refunds, orders, rates, clean.mapping, policy, asked)
    return settled(found, refund_totals(derive(priced), by), policy, asked, by)


def figures_of(
    clean: CleanLedger, rates: DataFrame, requests: dict[str, Request], refunds: DataFrame | None = None, refunded: CleanLedger | None = None
) -> DataFrame:
    """figures() of every named request, which all sum up or all count, from one scan of the copy; `asked` names the request.

    A row goes to every request whose entities and filters it meets.
    """
    kind = Request(agg=next(iter(requests.values())).agg, metric=clean.metric)

    def asked(df: DataFrame) -> DataFrame:
        lines = [F.when(clean.inside(r), F.struct(F.lit(n).alias("asked"), in_range(F.col("txn_date"), r).alias("within"))) for n, r in requests.items()]
        return df.withColumn("line", F.explode(F.array_compact(F.array(*lines)))).select(*df.columns, "line.*")

    rows = asked(clean.scoped(kind)).withColumn("in_scope", F.col("in_scope") & F.col("within"))
    # a request that no row meets has a figure too
    names = clean.rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in requests])).alias("asked"))
    found = stage_totals(rows, ["asked"]).unionByName(names, allowMissingColumns=True)
    if not takes_refunds(refunds, clean.mapping, clean.policy, kind):
        return settled(found, None, clean.policy, kind, ["asked"])
    orders = (refunded or clean).scoped(kind).filter("is_raw")
    priced = priced_refunds(refunds, orders, rates, clean.mapping, clean.policy, kind, [KEPT + c for c in clean.kept])
    return settled(found, refund_totals(asked(priced).filter("within"), ["asked"]), clean.policy, kind, ["asked"])


def cut_to_refunds(clean: CleanLedger, refunds: DataFrame) -> CleanLedger:
    """The rows of refunded keys, written once: refunds of any number of requests then leave the whole copy alone."""
    raw, keys = clean.rows.filter("is_raw"), scan_refunds(refunds, clean.mapping).select("key")
    if is_large(raw):
        raw = marked(raw, F.col("key"), marks_of(keys, F.col("key")))
    rows = written_once(raw.join(keys, "key", "left_semi").select(*clean.rows.columns), shared_folder(refunds.sparkSession, "refunded"))
    return replace(clean, rows=rows)


def second_figures(
    clean: CleanLedger, raw_rates: DataFrame, request: Request, refunds: DataFrame | None = None, by: dict[str, str] | None = None
) -> DataFrame:
    """The second route over the texts of the copy; it finds copies and conflicts itself and uses none of the flags."""
    texts, mapping, asked = clean.raw_texts(request)
    taken = refunds if takes_refunds(refunds, clean.mapping, clean.policy, request.with_(metric=clean.metric)) else None
    return second_route(texts.sparkSession, texts, raw_rates, mapping, clean.policy, asked, taken, by)


def second_figures_of(clean: CleanLedger, raw_rates: DataFrame, requests: dict[str, Request], refunds: DataFrame | None = None) -> DataFrame:
    """second_figures of every named request (`request`), all in one run over the copy."""
    texts, mapping, _ = clean.raw_texts(Request(metric=clean.metric))
    asked = {name: clean.raw_texts(r)[2] for name, r in requests.items()}
    takes = any(takes_refunds(refunds, clean.mapping, clean.policy, r.with_(metric=clean.metric)) for r in requests.values())
    return second_routes(texts.sparkSession, texts, raw_rates, mapping, clean.policy, asked, refunds if takes else None)


def request_audits(
    clean: CleanLedger, raw_rates: DataFrame, requests: dict[str, Request], summary: DataFrame, refunds: DataFrame | None = None
) -> DataFrame:
    """One row per named request with all that is known of its figure: both routes, the effect of each rule, what was
    reported, the verdict.

    `raw_rates` is the table of rates as found, `summary` is as scanned. A figure over nothing is 0 and calls for a review.
    The figures of all requests, and of those they are compared with, are one run over the copy, and so are their second
    routes. Both are written as they are found, so that no plan grows with the number of requests times the steps of a route.
    """
    spark = raw_rates.sparkSession
    rates = scan_rates(raw_rates, clean.mapping, clean.policy.date_format)
    refunded = cut_to_refunds(clean, refunds) if any(takes_refunds(refunds, clean.mapping, clean.policy, r.with_(metric=clean.metric)) for r in requests.values()) else None
    whole = {r: r.with_(filters=(), entities=()) for r in requests.values() if r.entities or any(c == clean.mapping.entity for c, _ in r.filters)}
    scopes = list(dict.fromkeys([*requests.values(), *whole.values()]))
    kinds = [{str(i): s for i, s in enumerate(scopes) if s.agg == agg} for agg in dict.fromkeys(s.agg for s in scopes)]
    found = written_once(reduce(DataFrame.unionByName, [figures_of(clean, rates, kind, refunds, refunded) for kind in kinds]), shared_folder(spark, "figures"))
    second = written_once(second_figures_of(clean, raw_rates, requests, refunds), shared_folder(spark, "second-figures"))

    def figure(asked: Request) -> DataFrame:
        return found.filter(F.col("asked") == str(scopes.index(asked))).drop("asked")

    def line(name: str, request: Request) -> DataFrame:
        own = figure(request)
        both = own.withColumns({"own": F.lit(True), "wide": F.lit(request not in whole)})
        if request in whole:
            both = both.unionByName(figure(whole[request]).withColumns({"own": F.lit(False), "wide": F.lit(True)}))
        told = compare_scopes(both, clean.mapping, request, summary)
        told = told.select("compared", "reported", "difference", "percent", "reconciliation", "scope", F.col("reason").alias("not_compared"))
        # three reports of one row each, side by side
        lines = impact.effects(own, request.agg).unionByName(second.filter(F.col("request") == name).drop("request"), allowMissingColumns=True)
        lines = lines.unionByName(told, allowMissingColumns=True)
        return lines.agg(*[F.max(c).alias(c) for c in lines.columns])

    audits = [line(name, request).select(F.lit(name).alias("request"), "*") for name, request in requests.items()]
    return trust.verdict(reduce(DataFrame.unionByName, audits))
