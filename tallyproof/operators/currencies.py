"""Which currencies of a request still have to be confirmed, with what is known about each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.config import BLANK_CURRENCY, Mapping, Policy, Request
from tallyproof.functions.money import kept_rate, rows_where
from tallyproof.functions.text import cell, effective_currency, strip
from tallyproof.operators.prepare import prepare
from tallyproof.operators.rates import attach_rate_on, latest_rates

# What is written in place of a code, and the code.
ALIASES = {
    "RS": "INR", "RS.": "INR", "INR.": "INR", "₹": "INR", "RUPEE": "INR", "RUPEES": "INR",
    "$": "USD", "US$": "USD", "USD$": "USD", "DOLLAR": "USD", "DOLLARS": "USD",
    "€": "EUR", "EURO": "EUR", "EUROS": "EUR",
    "£": "GBP", "POUND": "GBP", "POUNDS": "GBP",
}
BASIS_ITEM = "conversion_basis"


def alias_of(code):
    """The likely meaning of a misspelt code."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(known, code)


def scope_before_cleaning(ledger: DataFrame, mapping: Mapping, policy: Policy, request: Request) -> DataFrame:
    """In-scope rows of the raw ledger, repeats and conflicts included."""
    return prepare(ledger, mapping, policy, request).filter("in_scope")


def currency_profile(
    ledger: DataFrame, rates: DataFrame, mapping: Mapping, policy: Policy, request: Request
) -> DataFrame:
    """One line per raw code in scope; `rates` as scanned. The target comes first, then by code."""
    target = policy.target_currency
    scoped = scope_before_cleaning(ledger, mapping, policy, request)
    rated = attach_rate_on(scoped, rates, target, "txn_date")
    counted = rated.groupBy("cur_raw").agg(
        F.count("*").alias("rows"),
        F.sum("amount").cast("decimal(38,2)").alias("native_amount"),
        rows_where(F.col("rate").isNull()).alias("rows_without_rate_on_date"),
    )
    on_file = rates.groupBy("cur").agg(
        F.min("eff").alias("first_rate_day"),
        F.max("eff").alias("latest_rate_day"),
    )
    on_file = on_file.join(latest_rates(rates).select("cur", kept_rate(F.col("rate")).alias("latest_rate")), "cur")
    code = F.col("cur_raw")
    answered = F.lit(None).cast("string")
    for found, means in policy.currency_map.items():
        answered = F.when(code == found, F.lit(means)).otherwise(answered)
    lines = counted.withColumn("confirmed_as", answered).withColumn(
        "converts_as", effective_currency(code, policy.currency_map)
    )
    return (
        lines.join(on_file, F.col("converts_as") == F.col("cur"), "left")
        .withColumn("is_target", F.col("converts_as") == target)
        .withColumn("rate_on_file", F.col("cur").isNotNull() | F.col("is_target"))
        .drop("cur")
        .orderBy(F.col("cur_raw") != target, "cur_raw")
    )


def open_items(
    ledger: DataFrame, rates: DataFrame, mapping: Mapping, policy: Policy, request: Request
) -> DataFrame:
    """(item, currency, rows, native_amount): what must be answered before a figure may be shown."""
    target = policy.target_currency
    lines = currency_profile(ledger, rates, mapping, policy, request)
    foreign = lines.filter(
        (F.col("cur_raw") != target) & ~(F.col("confirmed_as").isNotNull() & F.col("is_target"))
    )
    codes = foreign.filter("confirmed_as is null").select(
        F.concat(F.lit("confirm_currency:"), "cur_raw").alias("item"),
        F.col("cur_raw").alias("currency"),
        "rows",
        "native_amount",
        F.col("rate_on_file").alias("recognised"),
    )
    if policy.conversion_basis is not None:
        return codes
    basis = (
        foreign.groupBy()
        .agg(F.sum("rows").alias("rows"))
        .filter("rows is not null")
        .select(F.lit(BASIS_ITEM).alias("item"), F.lit(None).cast("string").alias("currency"), "rows")
    )
    return codes.unionByName(basis, allowMissingColumns=True)


def suggestions(items: DataFrame, rates: DataFrame, target: str) -> DataFrame:
    """(currency, position, suggestion): the alias first, then every code with a rate, then the target."""
    known = rates.agg(F.sort_array(F.collect_set("cur")).alias("known")).scalar()
    asked = items.filter("currency is not null").select("currency").distinct()
    code = F.col("currency")
    options = F.array_compact(F.concat(F.array(alias_of(code)), known, F.array(F.lit(target))))
    return asked.select(
        "currency", F.posexplode(F.array_remove(F.array_distinct(options), code)).alias("at", "suggestion")
    ).select("currency", (F.col("at") + 1).cast("bigint").alias("position"), "suggestion")


def check_code_map(entries: DataFrame, found: str, means: str) -> DataFrame:
    """Normalised currency answers given as a table, with `valid` false where the target is no three-letter code."""
    code = F.upper(strip(cell(found)))
    target = F.upper(strip(cell(means)))
    return entries.select(
        F.when(code.isin("", "BLANK", BLANK_CURRENCY), BLANK_CURRENCY).otherwise(code).alias("code"),
        target.alias("means"),
        target.rlike("^[A-Z]{3}$").alias("valid"),
    )

