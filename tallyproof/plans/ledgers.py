"""The given tables read as messy ledgers, by pure expressions over stored columns.

`line_ledger` is the main one: invoice lines with every kind of dirt the audit knows, told by tax and discount
classes of the lines. Money columns of the tables are doubles with two decimals and become decimals first.
"""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.config import Mapping, Policy, RateColumns, RefundColumns, Request, SummaryColumns
from tallyproof.functions.periods import quarter_window

LINE_COLUMNS = [
    "invoice", "ship_date", "branch", "amount", "currency", "supplier_id", "quantity", "return_flag", "line_status",
]
LINE_ORDER = ("copy", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINES = Mapping(
    key="invoice",
    date="ship_date",
    entity="branch",
    amount="amount",
    currency="currency",
    order=LINE_ORDER,
    rates=RateColumns("cur", "rate_text", "eff_text", ("file_row",)),
    refunds=RefundColumns("ref_key", "ref_amount_text", "ref_date_text"),
    summary=SummaryColumns("label", "reported_text", ("file_row",)),
)
ORDERS = Mapping(
    key="order_id",
    date="order_date",
    entity="priority",
    amount="amount",
    currency="currency",
    order=("o_orderkey",),
    unit_multiplier=Decimal(10),
    rates=LINES.rates,
)
ORDER_COLUMNS = ["order_id", "order_date", "priority", "status", "amount", "currency"]
EVENTS = Mapping(key="event", date="event_date", entity="event_type", amount="amount", order=("event_id",))
EVENT_COLUMNS = ["event", "event_date", "event_type", "amount", "props"]
QUOTED = replace(ORDERS, rates=RateColumns("quote_cur", "quote_rate", "quote_day", ("o_orderkey",)))

# Branch names, one per ten pieces of quantity (1 to 50).
BRANCHES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Answers given for the line ledger, and the flagship question.
ANSWERS = Policy(currency_map={"RS": "INR", "USD": "USD"})
Q4_1998 = Request(start=quarter_window(1998, 4)[0], end=quarter_window(1998, 4)[1])
EVERYTHING = Request()

# (file row, code, rate, effective date) as a rates file might hold them.
RATE_ROWS = [
    (1, "INR", "1.00", "1995-01-01"),
    (2, "USD", "35.18", "1995-01-01"),
    (3, "USD", "36.55", "1996-04-01"),
    (4, "usd ", "39.37", "01/10/1997"),
    (5, "USD", "n/a", "1998-06-01"),
    (6, "USD", "42.505", "1998-11-01"),
    (7, "USD", "43.10", "1999-01-01"),
    (8, "USD", "43.33", "1999-01-01"),
    (9, "USD", "99.99", ""),
    (10, "USD", "98.98", "31/02/1999"),
    (11, "USD", "47.20", "2001-05-01"),
    (12, "USD", "46.75", "2000-08-01"),
    (13, "GBP", "68.20", "1998-01-01"),
    (14, "GBP", "70.90", "1999-06-15"),
    (15, "GBP", "65.401", "02/03/2001"),
]

# Stored schemas, given to the reader so that no job has to look them up.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(15,2)")


def _class(tax: float, discount: float) -> Column:
    return (F.col("l_tax") == tax) & (F.col("l_discount") == discount)


def _line_key() -> Column:
    plain = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    return F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0.08), "").otherwise(plain)


def line_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines; one tax and discount class was exported twice."""
    lines = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate")
    price, number, discount = _money("l_extendedprice"), F.col("l_linenumber"), F.col("l_discount")
    ship_date = (
        F.when(_class(0.08, 0.10), "")
        .when(_class(0.07, 0.10), F.concat(F.lit("31/02/"), F.year(day).cast("string")))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    region = F.element_at(F.array(*[F.lit(b) for b in BRANCHES]), F.ceil(F.col("l_quantity") / 10).cast("int"))
    branch = (
        F.when(_class(0.06, 0.0), " ")
        .when(F.col("l_returnflag") == "A", F.lower(region))
        .when(F.col("l_returnflag") == "N", F.concat(region, F.lit(" ")))
        .otherwise(region)
    )
    amount = (
        F.when(_class(0.08, 0.09), "")
        .when(_class(0.06, 0.10), F.format_number(price, 2))
        .when(_class(0.05, 0.10), "n/a")
        .when(_class(0.04, 0.10), F.concat(F.lit("-"), price.cast("string")))
        .otherwise(price.cast("string"))
    )
    currency = (
        F.when(number <= 3, "INR")
        .when(number == 4, "USD")
        .when(number == 5, " usd")
        .when(number == 6, "GBP")
        .when(discount < 0.025, "EUR")
        .when(discount < 0.055, "RS")
        .when(discount < 0.085, "")
        .otherwise("inr ")
    )
    copies = F.when(_class(0.02, 0.05), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return lines.select(
        _line_key().alias("invoice"),
        ship_date.alias("ship_date"),
        branch.alias("branch"),
        amount.alias("amount"),
        currency.alias("currency"),
        F.col("l_suppkey").cast("string").alias("supplier_id"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.explode(copies).alias("copy"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def line_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of every returned first line, thirty days on; one tax class refers to orders that do not exist."""
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linenumber = 1")
    key = F.when(F.col("l_tax") == 0.08, F.concat(_line_key(), F.lit("-X"))).otherwise(_line_key())
    return returned.select(
        key.alias("ref_key"),
        (_money("l_extendedprice") * F.lit(Decimal("0.10"))).cast("decimal(15,2)").cast("string").alias(
            "ref_amount_text"
        ),
        F.date_format(F.date_add("l_shipdate", 30), "dd/MM/yyyy").alias("ref_date_text"),
    )


def rate_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(str(r) for r in RATE_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(file_row, cur, rate_text, eff_text)")


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers, amounts in tens."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
        status.alias("status"),
        _money("o_totalprice").cast("string").alias("amount"),
        F.when(status == "F", "INR").when(status == "O", "USD").otherwise("EUR").alias("currency"),
        "o_orderkey",
    )


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event"),
        F.date_format("ts", "dd/MM/yyyy").alias("event_date"),
        "event_type",
        _money("value").cast("string").alias("amount"),
        "props",
        "event_id",
    )


def quote_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers read as a feed of quotes: one code per priority, dates in three spellings."""
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1), F.lit(" ")).alias("quote_cur"),
        F.when(F.col("o_totalprice") < 2000, "n/a")
        .otherwise((_money("o_totalprice") / 1000).cast("decimal(12,4)").cast("string"))
        .alias("quote_rate"),
        F.when(status == "F", F.date_format(day, "yyyy-MM-dd"))
        .when(status == "O", F.date_format(day, "d/M/yyyy"))
        .otherwise(F.date_format(day, "dd.MM.yyyy"))
        .alias("quote_day"),
        "o_orderkey",
    )


def quoted_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers in the quoted codes, paid fifteen days after the order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.date_format(F.date_add("o_orderdate", 15), "dd/MM/yyyy").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        _money("o_totalprice").cast("string").alias("amount"),
        F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("currency"),
        "o_orderkey",
    )

