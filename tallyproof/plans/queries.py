"""Registered queries: every operator applied to the given tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.config import BLOCK_ANSWER, EXCLUDE_REFUNDS, LATEST, TRANSACTION_DATE, Policy, Request
from tallyproof.functions import dates, periods
from tallyproof.functions.money import MONEY, amount_or_null, amount_or_zero, amount_problem, rows_where, total
from tallyproof.functions.text import cell, is_number, strip
from tallyproof.operators import (
    audit,
    clean,
    cube,
    currencies,
    impact,
    profile,
    ranking,
    reconcile,
    refunds,
    requests,
    sensitivity,
    totals,
    trust,
)
from tallyproof.operators import rates as fx
from tallyproof.operators.prepare import dealt, prepare, with_value
from tallyproof.operators.second_route import compare_routes, second_route
from tallyproof.operators.skew import Parts
from tallyproof.plans import ledgers as L
from tallyproof.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- shared inputs ---------------------------------------------------------------------------------------------


def _rates(spark: SparkSession, policy: Policy = L.ANSWERS) -> DataFrame:
    return tables.scan_rates(L.rate_table(spark), L.LINES, policy.date_format)


def _prepared(spark, sf, request: Request = L.Q4_1998, policy: Policy = L.ANSWERS) -> DataFrame:
    return prepare(L.line_ledger(spark, sf), L.LINES, policy, request)


def _priced(spark, sf, request: Request = L.Q4_1998, policy: Policy = L.ANSWERS) -> DataFrame:
    return with_value(_prepared(spark, sf, request, policy), _rates(spark, policy), policy)


def _prepared_parts(spark, sf, request: Request = L.Q4_1998, policy: Policy = L.ANSWERS) -> Parts:
    return dealt(L.line_ledger(spark, sf), L.LINES).each(lambda part: prepare(part, L.LINES, policy, request))


def _priced_parts(spark, sf, request: Request = L.Q4_1998, policy: Policy = L.ANSWERS) -> Parts:
    rates = _rates(spark, policy)
    return _prepared_parts(spark, sf, request, policy).each(lambda part: with_value(part, rates, policy))


def _answers(spark, sf, request: Request = L.Q4_1998, policy: Policy = L.ANSWERS, by=(), derive=None) -> DataFrame:
    return totals.answers(
        L.line_ledger(spark, sf),
        _rates(spark, policy),
        L.LINES,
        policy,
        request,
        L.line_refunds(spark, sf),
        by,
        derive,
    )


def _second(spark, sf, request: Request = L.Q4_1998, policy: Policy = L.ANSWERS, by=None) -> DataFrame:
    return second_route(
        spark,
        L.line_ledger(spark, sf),
        L.rate_table(spark),
        L.LINES,
        policy,
        request,
        L.line_refunds(spark, sf),
        by,
    )


def with_quarter(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("txn_date").cast("bigint")).withColumn(
        "quarter", F.quarter("txn_date").cast("bigint")
    )


def _quarters(spark, sf, policy: Policy = L.ANSWERS) -> DataFrame:
    return _answers(spark, sf, L.EVERYTHING, policy, ["year", "quarter"], with_quarter).filter("year is not null")


def _label(norm: Column) -> Column:
    return F.when(norm == "", "(blank)").otherwise(norm)


ANY_YEAR = "(?:19|20)[0-9]{2}"
QUARTER_CUTS = {"year": "cast(year(day) as bigint)", "quarter": "cast(quarter(day) as bigint)"}
FIGURE = ["final_rows", "final_total", "refund_rows", "refund_total", "status", "result"]
STAGES = [
    "raw_rows", "raw_total", "dedup_rows", "dedup_total", "final_rows", "final_total", "missing_rows",
    "unsupported_rows", "foreign_rows", "conflict_rows", "conflict_keys", "ambiguous_rows", "ambiguous_total",
]


# ---- sources and sinks -----------------------------------------------------------------------------------------


@query
def ledger_scan(spark, sf):
    """A stored table as an all-text ledger."""
    return tables.read_parquet(spark, f"{sf}/orders.parquet")


@query
def refund_scan(spark, sf):
    """S3"""
    scanned = tables.scan_refunds(L.line_refunds(spark, sf), L.LINES)
    return scanned.groupBy("key", "ref_amount_raw", "ref_date_raw").agg(F.count("*").alias("n"))


@query
def reported_quarters(spark, sf):
    """Labels of every order year, the last row of a year winning."""
    return _order_summary_by_quarter(spark, sf)


def _order_summary(spark, sf) -> DataFrame:
    """Reported figures as a person might keep them: one line per order quarter and status, labels in three styles."""
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    year, quarter = F.year(day).cast("string"), F.concat(F.lit("Q"), F.quarter(day).cast("string"))
    label = (
        F.when(status == "F", F.concat_ws("_", quarter, year))
        .when(status == "O", F.concat_ws(" ", F.lit("FY"), year, quarter, F.lit("(120012 rev)")))
        .otherwise(quarter)
    )
    return (
        L.table(spark, sf, "orders")
        .groupBy(label.alias("label"))
        .agg(
            F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("string").alias("reported_text"),
            F.max("o_orderkey").alias("file_row"),
        )
    )


def _order_summary_by_quarter(spark, sf) -> DataFrame:
    merged = tables.scan_summary(_order_summary(spark, sf), L.LINES, (1, 2, 3, 4), ANY_YEAR)
    return merged.select("year", "quarter", F.col("reported").cast(MONEY).alias("reported"))


@query
def evidence_rows(spark, sf):
    """The first fifty cleaned rows in scope."""
    return _evidence(totals.evidence_rows(_priced_parts(spark, sf)))


@query
def evidence_full(spark, sf):
    """S5 without a limit."""
    return _evidence(totals.evidence_rows(_priced_parts(spark, sf), None))


def _evidence(rows: DataFrame) -> DataFrame:
    return rows.select(
        "key",
        "date_raw",
        "entity_norm",
        "amount_raw",
        "cur_eff",
        F.coalesce(F.col("rate").cast("decimal(38,6)"), F.lit(0)).cast("decimal(38,6)").alias("rate"),
        F.col("value").cast(MONEY).alias("value"),
    )


# ---- parsing and normalising -----------------------------------------------------------------------------------


@query
def date_parse_evidence(spark, sf):
    """P1, P4, P5"""
    return totals.date_evidence(_prepared(spark, sf))


@query
def rate_date_parse(spark, sf):
    """Effective dates of every quote, back to text."""
    quotes = L.quote_table(spark, sf)
    day = dates.rate_date(F.col("quote_day"))
    return quotes.groupBy(day.alias("day")).agg(F.count("*").alias("n")).select(
        F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("invalid")).alias("iso"),
        dates.as_slash(F.col("day")).alias("day_first"),
        dates.as_slash(F.col("day"), "MM/DD/YYYY").alias("month_first"),
        F.year("day").cast("bigint").alias("year"),
        F.month("day").cast("bigint").alias("month"),
        F.dayofmonth("day").cast("bigint").alias("day_of_month"),
        "n",
    )


@query
def amount_parse(spark, sf):
    """Both readings of every amount cell."""
    ledger = L.line_ledger(spark, sf)
    amount = strip(cell("amount"))
    return ledger.groupBy(amount_problem(amount).alias("problem")).agg(
        F.count("*").alias("n"),
        F.sum(amount_or_zero(amount)).cast(MONEY).alias("as_written"),
        F.coalesce(F.sum(amount_or_null(amount, commas=True)), F.lit(0)).cast(MONEY).alias("commas_removed"),
        rows_where(amount_or_null(amount, commas=True).isNull()).alias("skipped"),
    )


@query
def numeric_share(spark, sf):
    """P20"""
    ledger = L.line_ledger(spark, sf)
    return ledger.agg(*[rows_where(is_number(cell(c))).alias(c) for c in L.LINE_COLUMNS])


@query
def month_bucket(spark, sf):
    """P16"""
    rows = _prepared(spark, sf)
    return rows.groupBy(dates.month_bucket(F.col("txn_date")).alias("month")).agg(F.count("*").alias("n"))


@query
def quarter_of_range(spark, sf):
    """Ranges that are exactly one calendar quarter."""
    day, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
    start = F.when(status == "F", day).otherwise(F.trunc(day, "quarter"))
    end = F.when(status == "P", F.last_day(day)).otherwise(periods.quarter_end(F.trunc(day, "quarter")))
    ranges = L.table(spark, sf, "orders").select(start.alias("start"), end.alias("end"))
    exact = ranges.filter(periods.is_calendar_quarter(F.col("start"), F.col("end")))
    return exact.groupBy(
        F.year("start").cast("bigint").alias("year"), F.quarter("start").cast("bigint").alias("quarter")
    ).agg(F.count("*").alias("n"))


@query
def currency_counts(spark, sf):
    """P8, P9"""
    rows = _prepared(spark, sf)
    return rows.groupBy("cur_raw", "cur_eff").agg(F.count("*").alias("n"))


@query
def currency_map_check(spark, sf):
    """P10: answers as a table, one per customer segment and balance class."""
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    entries = L.table(spark, sf, "customer").select(
        F.when(balance < 0, " blank ")
        .when(balance < 1000, "")
        .otherwise(F.concat(F.lit(" "), F.lower(F.substring(segment, 1, 3))))
        .alias("found"),
        F.when(segment == "BUILDING", "usd ")
        .when(segment == "FURNITURE", "dollars")
        .when(segment == "MACHINERY", "E1R")
        .otherwise(F.substring(segment, 2, 3))
        .alias("means"),
    )
    return (
        currencies.check_code_map(entries, "found", "means")
        .groupBy("code", "means", "valid")
        .agg(F.count("*").alias("n"))
    )


@query
def entity_list(spark, sf):
    """P6, P7, A9"""
    return ranking.entity_list(L.line_ledger(spark, sf), L.LINES).orderBy("entity")


# ---- rates -----------------------------------------------------------------------------------------------------


@query
def rate_intervals(spark, sf):
    """S2, W5, over the feed of quotes."""
    spans = fx.rate_intervals(tables.scan_rates(L.quote_table(spark, sf), L.QUOTED))
    return spans.select(
        "cur",
        F.col("rate").cast("decimal(38,6)").alias("rate"),
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"),
    )


def _by_currency_and_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cur_eff", F.year("txn_date").cast("bigint").alias("year")).agg(
        F.count("*").alias("n"), rows_where(F.col("unsupported")).alias("no_rate"), total(F.col("value")).alias("value")
    )


@query
def asof_convert(spark, sf):
    """J1, P14, P15"""
    return _by_currency_and_year(_priced(spark, sf).filter("not is_missing"))


@query
def asof_convert_quotes(spark, sf):
    """J1 against a rates table that is joined by shuffle, in monthly pieces."""
    rows = prepare(L.quoted_ledger(spark, sf), L.QUOTED, Policy())
    quotes = tables.scan_rates(L.quote_table(spark, sf), L.QUOTED)
    return _by_currency_and_year(with_value(rows, quotes, Policy(), max_broadcast_rows=0))


@query
def latest_convert(spark, sf):
    """J2"""
    policy = L.ANSWERS.with_(conversion_basis=LATEST)
    return _by_currency_and_year(_priced(spark, sf, policy=policy).filter("not is_missing"))


@query
def latest_convert_quotes(spark, sf):
    """J2 against a rates table that is joined by shuffle."""
    policy = Policy(conversion_basis=LATEST)
    rows = prepare(L.quoted_ledger(spark, sf), L.QUOTED, policy)
    quotes = tables.scan_rates(L.quote_table(spark, sf), L.QUOTED)
    return _by_currency_and_year(with_value(rows, quotes, policy, max_broadcast_rows=0))


# ---- cleaning --------------------------------------------------------------------------------------------------


@query
def missing_rows(spark, sf):
    """F1, A17"""
    return profile.ledger_counts(L.line_ledger(spark, sf), L.LINES).select(
        "rows", "missing_dates", "missing_amounts"
    )


@query
def exact_duplicates(spark, sf):
    """How often identities, and whole rows, repeat."""
    ledger = L.line_ledger(spark, sf)
    identity = profile.copy_groups(ledger, ["invoice", "ship_date", "branch", "amount"]).withColumn(
        "identity", F.lit("key, date, entity, amount")
    )
    whole = profile.copy_groups(ledger, L.LINE_COLUMNS).withColumn("identity", F.lit("whole row"))
    return (
        identity.select("identity", "copies")
        .union(whole.select("identity", "copies"))
        .groupBy("identity", "copies")
        .agg(F.count("*").alias("groups"))
    )


@query
def conflicting_keys(spark, sf):
    """Keys the profile reports, and whether cleaning excludes them."""
    ledger = L.line_ledger(spark, sf)
    seen = profile.conflict_groups(ledger, L.LINES)
    out = clean.conflicting_keys(_prepared(spark, sf)).withColumn("excluded", F.lit(True))
    return seen.join(out, "key", "full").select("key", "low", "high", F.coalesce("excluded", F.lit(False)).alias("excluded"))


@query
def first_row_per_key(spark, sf):
    """W3"""
    first = clean.first_row_per_key(_prepared(spark, sf), ["entity_norm", "cur_eff", "amount"])
    return first.groupBy("entity_norm", "cur_eff").agg(
        F.count("*").alias("keys"), total(F.col("amount")).alias("amount")
    )


@query
def conflict_excluded(spark, sf):
    """The cleaned ledger row by row."""
    kept = clean.surviving_rows(_prepared_parts(spark, sf), ["entity_norm", "cur_eff", "amount"])
    return kept.groupBy("entity_norm", "cur_eff").agg(F.count("*").alias("n"), total(F.col("amount")).alias("amount"))


@query
def clean_ledger_totals(spark, sf):
    """The whole ledger by entity."""
    found = _answers(spark, sf, L.EVERYTHING, by=["entity_norm"])
    return found.select("entity_norm", *FIGURE)


@query
def conflicts_in_scope(spark, sf):
    """A6"""
    return totals.conflict_keys_in_scope(_prepared_parts(spark, sf, Request(start=L.Q4_1998.start.replace(month=1), end=L.Q4_1998.end)))


@query
def stage_totals(spark, sf):
    """A4 by quarter"""
    return _quarters(spark, sf).select("year", "quarter", *STAGES)


@query
def ambiguous_in_scope(spark, sf):
    """A23"""
    return _answers(spark, sf, by=["entity_norm"]).select("entity_norm", "ambiguous_rows", "ambiguous_total")


# ---- answers ---------------------------------------------------------------------------------------------------


@query
def quarter_total(spark, sf):
    """Calendar Q4 1998 in the reporting currency."""
    return _answers(spark, sf).select(*FIGURE)


@query
def fiscal_quarter_total(spark, sf):
    """Fiscal Q4 is January to March."""
    start, end = periods.quarter_window(1998, 4, fiscal=True)
    return _answers(spark, sf, Request(start=start, end=end)).select(*FIGURE)


@query
def month_total(spark, sf):
    """P19"""
    start, end = periods.month_window(2000, 2)
    return _answers(spark, sf, Request(start=start, end=end)).select(*FIGURE)


@query
def year_total(spark, sf):
    """Every year at once."""
    found = _answers(
        spark, sf, L.EVERYTHING, by=["year"], derive=lambda df: df.withColumn("year", F.year("txn_date").cast("bigint"))
    )
    return found.filter("year is not null").select("year", *FIGURE)


@query
def latest_year(spark, sf):
    """A10"""
    return requests.latest_year(_prepared(spark, sf))


@query
def row_count_answer(spark, sf):
    """A2 as a count request, by entity."""
    return _answers(spark, sf, L.Q4_1998.with_(agg="count"), by=["entity_norm"]).select("entity_norm", "result")


@query
def entity_filter_total(spark, sf):
    """F2, C2"""
    return _answers(spark, sf, L.Q4_1998.with_(filters=(("branch", " Asia "),))).select(*FIGURE)


@query
def column_filter_total(spark, sf):
    """F3"""
    chosen = Request(filters=(("return_flag", "R"), ("line_status", "F"), ("no_such_column", "x")))
    return _answers(spark, sf, chosen).select(*FIGURE)


@query
def scope_before_cleaning(spark, sf):
    """F6"""
    request = L.Q4_1998.with_(entities=("ASIA", "europe "))
    rows = currencies.scope_before_cleaning(L.line_ledger(spark, sf), L.LINES, L.ANSWERS, request)
    return rows.groupBy("entity_norm", "cur_raw").agg(F.count("*").alias("n"), total(F.col("amount")).alias("native"))


@query
def unsupported_by_currency(spark, sf):
    """A5"""
    return totals.unsupported_by_currency(_priced_parts(spark, sf, L.EVERYTHING, Policy()))


@query
def unsupported_keys(spark, sf):
    """K4: a report of 25 lines"""
    return totals.unsupported_keys(_priced_parts(spark, sf)).select("key", "date_raw", "amount_raw", "cur_eff")


@query
def conversion_summary(spark, sf):
    """A7"""
    return totals.conversion_summary(_prepared_parts(spark, sf), "INR")


@query
def refund_totals(spark, sf):
    """J4, J6, A22 by entity and quarter of the refund date"""
    prepared = _prepared(spark, sf, L.EVERYTHING)
    priced = refunds.priced_refunds(
        L.line_refunds(spark, sf), prepared, _rates(spark), L.LINES, L.ANSWERS, L.EVERYTHING
    )
    return refunds.refund_totals(with_quarter(priced), ["entity_norm", "year", "quarter"]).drop("lost_digit_rows")


@query
def refund_unmatched(spark, sf):
    """J5"""
    matched = refunds.match_refunds(L.line_refunds(spark, sf), _prepared(spark, sf), L.LINES, L.ANSWERS)
    return matched.filter("not matched").select("key", "ref_amount_raw", "ref_date_raw")


@query
def net_total(spark, sf):
    """U1 by quarter"""
    return _quarters(spark, sf).select("year", "quarter", "final_total", "refund_total", "result")


@query
def refund_policy_excluded(spark, sf):
    """C4"""
    return _answers(spark, sf, policy=L.ANSWERS.with_(refunds=EXCLUDE_REFUNDS)).select(*FIGURE)


@query
def multiplier_total(spark, sf):
    """Order headers in tens, by priority and year."""
    found = totals.answers(
        L.order_ledger(spark, sf),
        _rates(spark),
        L.ORDERS,
        Policy(),
        L.EVERYTHING,
        by=["entity_norm", "year"],
        derive=lambda df: df.withColumn("year", F.year("txn_date").cast("bigint")),
    )
    return found.select("entity_norm", "year", "final_rows", "unsupported_rows", "result")


@query
def metric_column_total(spark, sf):
    """Another column added up, by quarter; refunds are refunds of the amount and stay out of it."""
    request = L.EVERYTHING.with_(metric="quantity")
    first = _answers(spark, sf, request, by=["year", "quarter"], derive=with_quarter)
    second = _second(spark, sf, request, by=QUARTER_CUTS)
    both = first.join(second, ["year", "quarter"], "full").filter("year is not null")
    agrees = F.col("result").eqNullSafe(F.col("result_b"))
    return both.select("year", "quarter", *FIGURE, agrees.alias("agrees"))


@query
def blocked_scopes(spark, sf):
    """C3 by entity and quarter"""
    strict = L.ANSWERS.with_(unsupported_currency=BLOCK_ANSWER, conflicting_duplicate=BLOCK_ANSWER)
    found = _answers(spark, sf, L.EVERYTHING, strict, ["entity_norm", "year", "quarter"], with_quarter)
    return found.filter("year is not null").select("entity_norm", "year", "quarter", "status", "result")


@query
def metadata_count(spark, sf):
    """A3"""
    plain = L.LINES
    return totals.metadata_count(
        L.line_ledger(spark, sf), plain, Request(agg="count", filters=(("branch", "asia"), ("return_flag", "A")))
    )


# ---- compare, rank, verify -------------------------------------------------------------------------------------


@query
def compare_entities(spark, sf):
    """Chosen entities, one of them without rows in the period."""
    ledger = L.line_ledger(spark, sf)
    listed = ranking.chosen(ranking.entity_list(ledger, L.LINES), ["asia", "EUROPE ", "Atlantis"])
    return ranking.per_entity(listed, _answers(spark, sf, by=["entity_norm"])).select(
        "entity", "result", "unsupported_rows", "conflict_keys"
    )


@query
def rank_entities(spark, sf):
    """Ranked by verified figure, with the second route next to it."""
    entities = ranking.entity_list(L.line_ledger(spark, sf), L.LINES)
    figures = ranking.per_entity(entities, _answers(spark, sf, by=["entity_norm"]))
    second = _second(spark, sf, by={"entity_norm": "entity"})
    both = figures.join(second, "entity_norm", "left").withColumn(
        "verified", F.col("result") == F.coalesce("result_b", F.lit(0))
    )
    return ranking.ranked(both).select("rank", "entity", "result", "verified", "unsupported_rows", "conflict_keys")


@query
def ranking_sorted(spark, sf):
    """K1: suppliers by what they billed in the whole ledger."""
    rows = _priced_parts(spark, sf, L.EVERYTHING)
    found = totals.stage_totals(rows, "INR", ["entity_norm"])
    return found.select(_label(F.col("entity_norm")).alias("entity"), "final_total").orderBy(
        F.col("final_total").desc_nulls_last(), "entity"
    )


@query
def verify_routes(spark, sf):
    """V1, J8 by entity"""
    first = _answers(spark, sf, by=["entity_norm"])
    return compare_routes(first, _second(spark, sf, by={"entity_norm": "entity"}), ["entity_norm"])


@query
def verify_routes_latest(spark, sf):
    """V1 with the other basis and other answers, by quarter"""
    policy = Policy(currency_map={"EUR": "USD", "(BLANK)": "INR", "GBP": "XXX"}, conversion_basis=LATEST)
    first = _quarters(spark, sf, policy)
    second = _second(spark, sf, L.EVERYTHING, policy, QUARTER_CUTS).filter("year is not null")
    return compare_routes(first, second, ["year", "quarter"])


def _clean_copy(spark, sf, keep=()) -> audit.CleanLedger:
    return audit.clean_ledger(L.line_ledger(spark, sf), _rates(spark), L.LINES, L.ANSWERS, keep)


def _clean_quarters(clean: audit.CleanLedger, spark, sf) -> DataFrame:
    found = audit.figures(clean, _rates(spark), L.EVERYTHING, L.line_refunds(spark, sf), ["year", "quarter"], with_quarter)
    return found.filter("year is not null")


def _both_routes(clean: audit.CleanLedger, quarters: DataFrame, spark, sf) -> DataFrame:
    """One row per quarter: both routes side by side, also where only one has the quarter."""
    second = audit.second_figures(clean, L.rate_table(spark), L.EVERYTHING, L.line_refunds(spark, sf), QUARTER_CUTS)
    return quarters.join(second.filter("year is not null"), ["year", "quarter"], "full")


@query
def issued_evidence(spark, sf):
    """V2"""
    clean = _clean_copy(spark, sf)
    both = _both_routes(clean, _clean_quarters(clean, spark, sf), spark, sf)
    return trust.issuable(both).select("year", "quarter", "result", "final_rows")


# ---- profile ---------------------------------------------------------------------------------------------------


@query
def column_profile(spark, sf):
    """A8"""
    return profile.column_profile(L.line_ledger(spark, sf), L.LINE_COLUMNS)


@query
def column_samples(spark, sf):
    """The first five values of every column"""
    return profile.column_samples(L.line_ledger(spark, sf), L.LINE_COLUMNS, L.LINE_ORDER)


@query
def event_column_profile(spark, sf):
    """A8 on the event stream table"""
    return profile.column_profile(L.event_ledger(spark, sf), L.EVENT_COLUMNS)


@query
def unsupported_codes(spark, sf):
    """A11, U2"""
    found = profile.currency_codes(L.line_ledger(spark, sf), L.LINES, L.rate_table(spark), "INR")
    return found.select("code", "rows", "supported")


@query
def profile_ambiguous_dates(spark, sf):
    """A18"""
    return profile.ledger_counts(L.line_ledger(spark, sf), L.LINES).select("rows", "ambiguous_dates")


@query
def quality_score(spark, sf):
    """Q1"""
    return _quality(spark, sf)


def _quality(spark, sf) -> DataFrame:
    return profile.quality(L.line_ledger(spark, sf), L.LINES, L.rate_table(spark), L.ANSWERS, L.LINE_COLUMNS)


@query
def quality_findings(spark, sf):
    """Q3"""
    return profile.findings(_quality(spark, sf))


@query
def category_choice(spark, sf):
    """A20"""
    return profile.category_choice(L.line_ledger(spark, sf), L.LINES, L.LINE_COLUMNS)


# ---- currencies and requests -----------------------------------------------------------------------------------


def _asked(spark, sf, policy: Policy):
    return L.line_ledger(spark, sf), _rates(spark), L.LINES, policy, L.Q4_1998


@query
def currency_profile(spark, sf):
    """A19"""
    found = currencies.currency_profile(*_asked(spark, sf, L.ANSWERS))
    return found.select(
        "cur_raw", "rows", "native_amount", "rows_without_rate_on_date", "confirmed_as", "converts_as", "is_target",
        "rate_on_file",
        F.date_format("first_rate_day", "yyyy-MM-dd").alias("first_rate_day"),
        F.date_format("latest_rate_day", "yyyy-MM-dd").alias("latest_rate_day"),
        F.col("latest_rate").cast("decimal(38,6)").alias("latest_rate"),
    )


@query
def currency_open_items(spark, sf):
    """R1"""
    found = currencies.open_items(*_asked(spark, sf, L.ANSWERS))
    return found.select("item", "rows", F.col("native_amount").cast(MONEY).alias("native_amount"))


@query
def currency_suggestions(spark, sf):
    """P11"""
    items = currencies.open_items(*_asked(spark, sf, Policy(conversion_basis=TRANSACTION_DATE)))
    return currencies.suggestions(items, _rates(spark), "INR")


@query
def request_check(spark, sf):
    """Q2: one request per customer."""
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    customers = (
        L.table(spark, sf, "customer")
        .join(L.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(L.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    asked = customers.select(
        F.when(segment == "BUILDING", "territory").when(segment == "MACHINERY", "currency").otherwise("branch").alias("column"),
        F.when(balance < 0, "in").otherwise("eq").alias("op"),
        F.when(segment == "FURNITURE", F.col("n_name")).otherwise(F.concat(F.lit(" "), F.lower("r_name"))).alias("value"),
        F.when(balance > 9000, "currency").when(balance > 5000, "branch").alias("group_by"),
    )
    entities = ranking.entity_list(L.line_ledger(spark, sf), L.LINES)
    checked = requests.request_problems(asked, entities, L.LINES, L.LINE_COLUMNS)
    return checked.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query
def range_check(spark, sf):
    """typed ranges, some of them impossible."""
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    ranges = L.table(spark, sf, "orders").select(
        F.date_format(day, "dd/MM/yyyy").alias("from_text"),
        F.when(status == "F", F.date_format(F.date_add(day, 30), "dd/MM/yyyy"))
        .when(status == "O", F.date_format(F.date_sub(day, 1), "d/M/yyyy"))
        .otherwise(F.concat(F.lit("31/"), F.date_format(day, "MM/yyyy")))
        .alias("to_text"),
    )
    checked = requests.check_ranges(ranges, "from_text", "to_text", "DD/MM/YYYY")
    return checked.groupBy("status", F.month("end_day").cast("bigint").alias("end_month")).agg(F.count("*").alias("n"))


# ---- impact and sensitivity ------------------------------------------------------------------------------------


@query
def impact_waterfall(spark, sf):
    """I1 by entity"""
    return impact.waterfall(_answers(spark, sf, by=["entity_norm"]), ["entity_norm"])


@query
def largest_risk(spark, sf):
    """I2 by quarter"""
    return impact.largest_risk(_quarters(spark, sf)).select("year", "quarter", "risk", "risk_amount")


@query
def cleanup_actions(spark, sf):
    """I3 by entity"""
    return impact.cleanup_actions(_answers(spark, sf, by=["entity_norm"]), ["entity_norm"])


def _readings(spark, sf, request: Request, policy: Policy = L.ANSWERS) -> DataFrame:
    return sensitivity.readings(
        L.line_ledger(spark, sf), L.rate_table(spark), L.LINES, policy, request, L.line_refunds(spark, sf)
    )


@query
def sensitivity_lines(spark, sf):
    """N1"""
    return sensitivity.sensitivity(_readings(spark, sf, L.Q4_1998), L.Q4_1998, True)


@query
def date_exposure(spark, sf):
    """N2"""
    asia = L.Q4_1998.with_(filters=(("branch", "asia"),))
    return sensitivity.exposure(_readings(spark, sf, asia)).select(
        "base", "date_format", "only_as_given", "only_as_other", "scope_rows", "ambiguous_rows", "ambiguous_total",
        "format_proved", "exposed",
    )


@query
def materiality(spark, sf):
    """N3"""
    start, end = periods.quarter_window(1999, 2, fiscal=True)
    request = Request(start=start, end=end)
    graded = sensitivity.materiality(_readings(spark, sf, request), request, True)
    return graded.select("base", "worst", "worst_percent", "materiality")


# ---- reconciliation and verdict --------------------------------------------------------------------------------


def _reported(quarters: DataFrame) -> DataFrame:
    """What was reported for every quarter: exact, a little off, far off, or not at all, by year."""
    factor = (
        F.when(F.col("year").isin(1995, 1998), "1.00").when(F.col("year") == 1996, "1.003").when(F.col("year") < 2001, "1.02")
    ).cast("decimal(4,3)")
    label = F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit("_"), F.col("year").cast("string"))
    return quarters.select(
        label.alias("label"),
        F.round(F.col("result").cast("decimal(30,2)") * factor, 2).cast("string").alias("reported_text"),
        F.col("year").alias("file_row"),
    )


def _reconciled(quarters: DataFrame, reported: DataFrame) -> DataFrame:
    summary = tables.scan_summary(reported, L.LINES, years=ANY_YEAR)
    return reconcile.reconcile(reconcile.reported_for(quarters, summary))


@query
def summary_join(spark, sf):
    """Reported figures next to verified ones, order headers as the summary."""
    verified = _quarters(spark, sf).filter("quarter = 4").select("year", "quarter", "result")
    summary = tables.scan_summary(_order_summary(spark, sf), L.LINES, years=ANY_YEAR)
    return reconcile.reported_for(verified, summary).select(
        "year", "result", F.col("reported").cast(MONEY).alias("reported")
    )


@query
def summary_reconciliation(spark, sf):
    """X1"""
    quarters = _quarters(spark, sf)
    return _reconciled(quarters, _reported(quarters)).select(
        "year",
        "quarter",
        "result",
        F.col("reported").cast(MONEY).alias("reported"),
        "difference",
        "percent",
        "reconciliation",
    )


@query
def request_reconciliation(spark, sf):
    """X1 for single requests against the order headers' summary: one entity's Q4, a whole Q4, another quarter."""
    summary = tables.scan_summary(_order_summary(spark, sf), L.LINES, years=ANY_YEAR)
    return reconcile.request_reconciliations(
        L.line_ledger(spark, sf), _rates(spark), L.LINES, L.ANSWERS, _ASKED, summary, L.line_refunds(spark, sf)
    )


_ASKED = {
    "entity": L.Q4_1998.with_(entities=("Asia",)),
    "whole": L.Q4_1998,
    "other": Request(start=periods.quarter_window(1998, 3)[0], end=periods.quarter_window(1998, 3)[1]),
}


@query
def request_audit(spark, sf):
    """Whole audits of four requests over one cleaned copy."""
    summary = tables.scan_summary(_order_summary(spark, sf), L.LINES, years=ANY_YEAR)
    clean, rates, back = _clean_copy(spark, sf, ["return_flag"]), L.rate_table(spark), L.line_refunds(spark, sf)
    asked = _ASKED | {"column": L.Q4_1998.with_(filters=(("branch", "EUROPE"), ("return_flag", "N")))}
    columns = [
        *STAGES, *FIGURE[2:], "result_b", "duplicate_effect", "conflict_effect", "refund_effect", "reconciles",
        "compared", "reported", "reconciliation", "decision", "publishability", "reasons",
    ]
    return audit.request_audits(clean, rates, asked, summary, back).select("request", *columns)


@query
def trust_verdict(spark, sf):
    """T1, T2 by quarter, over one cleaned copy"""
    clean = _clean_copy(spark, sf)
    quarters = tables.written_once(_clean_quarters(clean, spark, sf), tables.shared_folder(spark, "quarters"))
    judged = trust.verdict(_reconciled(_both_routes(clean, quarters, spark, sf), _reported(quarters)))
    return judged.select("year", "quarter", "result", "decision", "publishability", "reasons")


@query
def entity_quarter_totals(spark, sf):
    """G1"""
    rows = _priced_parts(spark, sf, L.EVERYTHING).each(with_quarter)
    found = totals.stage_totals(rows, "INR", ["entity_norm", "year", "quarter"])
    return found.filter("year is not null").select(
        "entity_norm", "year", "quarter", "raw_total", "final_total", "unsupported_rows"
    )


@query
def top_entity(spark, sf):
    """G1: the largest entity of every fiscal quarter"""
    columns = {
        "year": F.year("txn_date").cast("bigint"),
        "fiscal_quarter": periods.fiscal_quarter(F.col("txn_date")).cast("bigint"),
    }
    fiscal = _priced_parts(spark, sf, L.EVERYTHING).each(lambda part: part.withColumns(columns))
    found = totals.stage_totals(fiscal, "INR", ["entity_norm", "year", "fiscal_quarter"])
    return (
        found.filter("year is not null")
        .groupBy("year", "fiscal_quarter")
        .agg(F.max_by("entity_norm", F.struct("final_total", "entity_norm")).alias("entity"), F.max("final_total").alias("total"))
    )


# ---- dashboard -------------------------------------------------------------------------------------------------


def _chart_rows(spark, sf) -> DataFrame:
    return cube.chart_rows(
        L.line_ledger(spark, sf), _rates(spark), L.LINES, L.ANSWERS, L.LINE_COLUMNS, "return_flag"
    )


@query
def cube_cells(spark, sf):
    """A12"""
    return cube.cube(_chart_rows(spark, sf))


@query
def cube_sorted(spark, sf):
    """The dashboard job, its category chosen from the data."""
    ledger = L.line_ledger(spark, sf)
    choice = profile.category_choice(ledger, L.LINES, L.LINE_COLUMNS).first()
    rows = cube.chart_rows(
        ledger, _rates(spark), L.LINES, L.ANSWERS, L.LINE_COLUMNS, choice["category"] if choice else None
    )
    return cube.cube_sorted(rows)


@query
def event_cube(spark, sf):
    """A12 on a ledger without currencies and rates"""
    return cube.cube(cube.chart_rows(L.event_ledger(spark, sf), None, L.EVENTS, Policy(), L.EVENT_COLUMNS, None))


@query
def cube_skips(spark, sf):
    """A13"""
    return cube.skips(_chart_rows(spark, sf))


@query
def cube_currencies(spark, sf):
    """A14"""
    return cube.currency_rows(_chart_rows(spark, sf))


@query
def cube_rollups(spark, sf):
    """A21"""
    return cube.rollups(cube.cube(_chart_rows(spark, sf)))


@query
def cross_filter(spark, sf):
    """F7"""
    return cube.charts(cube.cube(_chart_rows(spark, sf)), "Asia", "R")


@query
def top_slices(spark, sf):
    """K2: months of the trend as slices"""
    lines = cube.rollups(cube.cube(_chart_rows(spark, sf))).filter("chart = 'month'")
    return ranking.top_slices(lines.select("name", "value")).select("name", "is_other", F.col("value").cast(MONEY).alias("value"))
