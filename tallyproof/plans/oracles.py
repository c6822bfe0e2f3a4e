"""The registered queries once more as plain SQL for another engine, over the same stored tables.

The SQL goes other ways than the library on purpose: whole cents, row numbers and window flags, ASOF joins.
"""

from __future__ import annotations

from tallyproof.plans.ledgers import RATE_ROWS

_RATE_VALUES = ", ".join(str(r) for r in RATE_ROWS)

_KEY = "CASE WHEN l_linenumber = 7 AND l_tax = 0.08 THEN '' ELSE l_orderkey || '-' || l_partkey END"
_PRICE = "CAST(l_extendedprice AS DECIMAL(15,2))"

LINE = f"""
line AS (
  SELECT {_KEY} AS invoice,
    CASE WHEN l_tax = 0.08 AND l_discount = 0.10 THEN ''
         WHEN l_tax = 0.07 AND l_discount = 0.10 THEN '31/02/' || year(l_shipdate)
         ELSE strftime(l_shipdate, '%d/%m/%Y') END AS ship_date,
    CASE WHEN l_tax = 0.06 AND l_discount = 0.0 THEN ' '
         WHEN l_returnflag = 'A' THEN lower(r_name)
         WHEN l_returnflag = 'N' THEN r_name || ' ' ELSE r_name END AS branch,
    CASE WHEN l_tax = 0.08 AND l_discount = 0.09 THEN ''
         WHEN l_tax = 0.06 AND l_discount = 0.10 THEN format('{{:,.2f}}', l_extendedprice)
         WHEN l_tax = 0.05 AND l_discount = 0.10 THEN 'n/a'
         WHEN l_tax = 0.04 AND l_discount = 0.10 THEN '-' || CAST({_PRICE} AS VARCHAR)
         ELSE CAST({_PRICE} AS VARCHAR) END AS amount,
    CASE WHEN l_linenumber <= 3 THEN 'INR' WHEN l_linenumber = 4 THEN 'USD' WHEN l_linenumber = 5 THEN ' usd'
         WHEN l_linenumber = 6 THEN 'GBP' WHEN l_discount < 0.025 THEN 'EUR' WHEN l_discount < 0.055 THEN 'RS'
         WHEN l_discount < 0.085 THEN '' ELSE 'inr ' END AS currency,
    CAST(l_suppkey AS VARCHAR) AS supplier_id, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity,
    l_returnflag AS return_flag, l_linestatus AS line_status,
    unnest(CASE WHEN l_tax = 0.02 AND l_discount = 0.05 THEN [0, 1] ELSE [0] END) AS copy,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM (SELECT *, CASE WHEN l_quantity <= 10 THEN 'AFRICA' WHEN l_quantity <= 20 THEN 'AMERICA'
    WHEN l_quantity <= 30 THEN 'ASIA' WHEN l_quantity <= 40 THEN 'EUROPE' ELSE 'MIDDLE EAST' END AS r_name FROM lineitem))"""

REFUND = f"""
refund AS (
  SELECT CASE WHEN l_tax = 0.08 THEN ({_KEY}) || '-X' ELSE {_KEY} END AS ref_key,
    CAST(CAST({_PRICE} * 0.10 AS DECIMAL(15,2)) AS VARCHAR) AS ref_amount_text,
    strftime(l_shipdate + INTERVAL 30 DAY, '%d/%m/%Y') AS ref_date_text
  FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)"""


def _rates(day_first: bool = True, name: str = "rate_ok") -> str:
    pattern = "%d/%m/%Y" if day_first else "%m/%d/%Y"
    return f"""
{name} AS (
  SELECT cur, eff, arg_max(rate, file_row) AS rate, max(file_row) AS file_row FROM (
    SELECT file_row, upper(trim(cur)) AS cur, try_cast(rate_text AS DECIMAL(18,10)) AS rate,
           coalesce(try_cast(try_strptime(eff_text, '%Y-%m-%d') AS DATE),
                    try_cast(try_strptime(eff_text, '{pattern}') AS DATE)) AS eff
    FROM (VALUES {_RATE_VALUES}) AS t(file_row, cur, rate_text, eff_text))
  WHERE rate IS NOT NULL AND eff IS NOT NULL GROUP BY cur, eff)"""


def _cents(amount: str, rate: str, times: int = 1) -> str:
    a = f"CAST({amount} * 1000000 AS HUGEINT)"
    r = f"CAST(coalesce({rate}, 0) * 1000000 AS HUGEINT)"
    return f"(CASE WHEN {a} < 0 THEN -1 ELSE 1 END * ((abs({a}) * {times} * {r} + 5000000000) // 10000000000))"


def _money(cents: str) -> str:
    return f"CAST(CAST(coalesce({cents}, 0) AS DECIMAL(30,0)) * 0.01 AS DECIMAL(38,2))"


def _big(expr: str) -> str:
    return f"CAST(coalesce({expr}, 0) AS BIGINT)"


def _decimal(expr: str) -> str:
    return f"CAST(coalesce({expr}, 0) AS DECIMAL(38,2))"


_RS_ONLY = {"RS": "INR"}
_RAW_CODE = "CASE WHEN upper(trim(currency)) IN ('', 'NAN') THEN '(BLANK)' ELSE upper(trim(currency)) END"


def _effective(answers: dict[str, str]) -> str:
    cases = "".join(f" WHEN '{k}' THEN '{v}'" for k, v in answers.items())
    blank = "" if "(BLANK)" in answers else " WHEN '(BLANK)' THEN ''"
    return f"CASE cur_raw{cases}{blank} ELSE cur_raw END"


def ledger(answers=_RS_ONLY, latest: bool = False, scope: str = "true", entity: str = "true", other: bool = False, metric: str = "amount") -> str:
    """CTEs up to `rows`: every ledger row with flags, value in cents, and the chosen scope."""
    if latest:
        rate = "LEFT JOIN (SELECT cur, arg_max(rate, eff) AS rate FROM rate_ok GROUP BY cur) AS r ON r.cur = p.cur"
    else:
        rate = "ASOF LEFT JOIN rate_ok AS r ON r.cur = p.cur AND p.dmy >= r.eff"
    return f"""WITH {LINE}, {REFUND}, {_rates()},
prep AS (
  SELECT *, {_effective(answers)} AS cur FROM (
    SELECT *, lower(trim(branch)) AS ent, try_cast(try_strptime(trim(ship_date), '%d/%m/%Y') AS DATE) AS dmy,
      try_cast(try_strptime(trim(ship_date), '%m/%d/%Y') AS DATE) AS mdy,
      coalesce(try_cast(trim(amount) AS DECIMAL(25,6)), 0) AS amt, {_RAW_CODE} AS cur_raw,
      trim(ship_date) = '' OR trim(amount) = '' AS missing FROM (SELECT * REPLACE ({metric} AS amount) FROM line))),
priced AS (
  SELECT p.*, CASE WHEN p.cur = 'INR' THEN 1 ELSE r.rate END AS rate FROM prep AS p {rate}),
flagged AS (
  SELECT *, rate IS NULL AS no_rate, {_cents('amt', 'rate')} AS cents,
    row_number() OVER (PARTITION BY invoice, ship_date, branch, amount
                       ORDER BY copy, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS copy_no,
    coalesce(min(CASE WHEN NOT missing THEN amount END) OVER (PARTITION BY invoice)
      <> max(CASE WHEN NOT missing THEN amount END) OVER (PARTITION BY invoice), false) AS conflict,
    coalesce(dmy <> mdy, false) AS ambiguous FROM priced),
rows AS (
  SELECT *, {entity} AS in_entity, coalesce(NOT missing AND ({entity}) AND ({scope}), false) AS in_scope,
    NOT missing AND copy_no = 1 AND NOT conflict AS clean, year(dmy) AS y, quarter(dmy) AS q FROM flagged),
heads AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice
     ORDER BY copy, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key_no FROM rows WHERE clean) WHERE key_no = 1),
matched AS (
  SELECT f.*, h.ent, h.cur, h.in_entity, h.invoice IS NOT NULL AS matched,
    try_cast(try_strptime(f.ref_date_text, '%d/%m/%Y') AS DATE) AS dmy,
    try_cast(try_strptime(f.ref_date_text, '%m/%d/%Y') AS DATE) AS mdy,
    CAST(f.ref_amount_text AS DECIMAL(25,6)) AS amt
  FROM refund AS f LEFT JOIN heads AS h ON h.invoice = f.ref_key),
refunded AS (
  SELECT p.*, {_cents('amt', "CASE WHEN p.cur = 'INR' THEN 1 ELSE r.rate END")} AS cents,
    p.cur <> 'INR' AND r.rate IS NULL AS no_rate, year(p.dmy) AS y, quarter(p.dmy) AS q
  FROM matched AS p {rate} WHERE p.matched AND p.in_entity AND ({scope.replace('dmy', 'p.dmy')}))"""


Q4 = "dmy BETWEEN DATE '1998-10-01' AND DATE '1998-12-31'"

_OWN = f"""
  {_big('count(*) FILTER (in_scope AND clean)')} AS final_rows,
  {_money('sum(cents) FILTER (in_scope AND clean)')} AS final_total"""
_BACK = f"{_big('count(*)')} AS refund_rows, {_money('-sum(cents)')} AS refund_total"


def _figure(by: str = "", keep: str = "true", refunds: bool = True, **how) -> str:
    """FIGURE columns: rows and refunds aggregated apart, then joined."""
    base = ledger(**how)
    names = [n.strip() for n in by.split(",") if n.strip()]
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    on = " AND ".join(f"a.{n} IS NOT DISTINCT FROM b.{n}" for n in names) or "true"
    source = "refunded" if refunds else "refunded WHERE false"
    out = "".join(f"coalesce(a.{n}, b.{n}) AS {_ALIAS.get(n, n)}, " for n in names)
    return f"""{base},
own AS (SELECT {lead}{_OWN} FROM rows {group}),
back AS (SELECT {lead}{_BACK} FROM {source} {group})
SELECT {out}{_big('final_rows')} AS final_rows, {_decimal('final_total')} AS final_total,
  {_big('refund_rows')} AS refund_rows, {_decimal('refund_total')} AS refund_total, 'VERIFIED' AS status,
  CAST(coalesce(final_total, 0) + coalesce(refund_total, 0) AS DECIMAL(38,2)) AS result
FROM own AS a FULL JOIN back AS b ON {on} WHERE {keep}"""


_ALIAS = {"ent": "entity_norm", "y": "year", "q": "quarter"}
_KEEP_QUARTER = "coalesce(a.y, b.y) IS NOT NULL"


def _pick(sql: str, columns: str, tail: str = "") -> str:
    """Outer selection over a finished query."""
    return f"SELECT {columns} FROM ({sql}) AS picked {tail}"


_STAGE = f"""
  {_big('count(*) FILTER (in_scope)')} AS raw_rows, {_money('sum(cents) FILTER (in_scope)')} AS raw_total,
  {_big('count(*) FILTER (in_scope AND copy_no = 1)')} AS dedup_rows,
  {_money('sum(cents) FILTER (in_scope AND copy_no = 1)')} AS dedup_total, {_OWN},
  {_big('count(*) FILTER (missing AND in_entity)')} AS missing_rows,
  {_big('count(*) FILTER (in_scope AND clean AND no_rate)')} AS unsupported_rows,
  {_big("count(*) FILTER (in_scope AND clean AND cur <> 'INR')")} AS foreign_rows,
  {_big('count(*) FILTER (in_scope AND copy_no = 1 AND conflict)')} AS conflict_rows,
  {_big('count(DISTINCT invoice) FILTER (in_scope AND copy_no = 1 AND conflict)')} AS conflict_keys,
  {_big('count(*) FILTER (in_scope AND ambiguous)')} AS ambiguous_rows,
  {_money('sum(cents) FILTER (in_scope AND clean AND ambiguous)')} AS ambiguous_total"""



def _audited(name: str, scope: str, entity: str) -> str:
    """Stage totals and refunds of one request, as one line."""
    return f"""SELECT '{name}' AS request, * FROM ({ledger(scope=scope, entity=entity)},
own AS (SELECT {_STAGE} FROM rows), back AS (SELECT {_BACK} FROM refunded) SELECT * FROM own, back)"""


_AUDITS = [
    ("entity", Q4, "ent = 'asia'"),
    ("whole", Q4, "true"),
    ("other", "dmy BETWEEN DATE '1998-07-01' AND DATE '1998-09-30'", "true"),
    ("column", Q4, "ent = 'europe' AND return_flag = 'N'"),
]

_LINE_COLUMNS = "invoice ship_date branch amount currency supplier_id quantity return_flag line_status".split()
_NUMERIC = r"'^[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$'"


def _unpivot(columns, table: str = "line") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", trim({c}) AS value, {i} AS pos, * FROM {table}" for i, c in enumerate(columns, 1)
    )


def _title(expr: str) -> str:
    t = f"trim({expr})"
    words = f"array_to_string(list_transform(string_split(lower({t}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"CASE WHEN {t} = '' THEN '(blank)' WHEN {t} = upper({t}) OR {t} = lower({t}) THEN {words} ELSE {t} END"


CUBE = f"""WITH {LINE}, {_rates()},
uniq AS (SELECT {', '.join(_LINE_COLUMNS)}, count(*) AS copies FROM line GROUP BY ALL),
typed AS (SELECT *, {_RAW_CODE} AS cur_raw, try_cast(replace(trim(amount), ',', '') AS DECIMAL(25,6)) AS amt,
  try_cast(try_strptime(trim(ship_date), '%d/%m/%Y') AS DATE) AS dmy FROM uniq),
charted AS (
  SELECT t.*, CASE WHEN cur_raw = 'INR' THEN 1 ELSE r.rate END AS rate,
    CASE WHEN amt IS NULL THEN 'no amount' WHEN cur_raw = '(BLANK)' THEN 'no currency'
         WHEN cur_raw <> 'INR' AND r.rate IS NULL THEN 'no exchange rate' ELSE 'used' END AS reason,
    coalesce(strftime(dmy, '%Y-%m'), '') AS month
  FROM typed AS t ASOF LEFT JOIN rate_ok AS r ON r.cur = t.cur_raw AND t.dmy >= r.eff),
summed AS (
  SELECT month, {_title('branch')} AS entity, {_title('return_flag')} AS category,
    sum(CAST(amt * 1000000 AS HUGEINT) * CAST(rate * 1000000 AS HUGEINT)) AS trillionths, count(*) AS n
  FROM charted WHERE reason = 'used' GROUP BY ALL),
-- half even: the cell as whole cents and a rest in units of 1e-12
cells AS (
  SELECT month, entity, category, n,
    CASE WHEN trillionths < 0 THEN -1 ELSE 1 END * (whole + CASE
      WHEN rest > 5000000000 OR (rest = 5000000000 AND whole % 2 = 1) THEN 1 ELSE 0 END) AS cents
  FROM (SELECT *, abs(trillionths) // 10000000000 AS whole, abs(trillionths) % 10000000000 AS rest FROM summed))"""

_ROLLUP = f"""
  SELECT 'entity' AS chart, entity AS name, cents, n FROM cells UNION ALL
  SELECT 'category', category, cents, n FROM cells UNION ALL
  SELECT 'month', month, cents, n FROM cells WHERE month <> '' UNION ALL
  SELECT 'total', '', cents, n FROM cells"""

QUOTE = """WITH quote AS (
  SELECT 'P' || o_orderpriority[1] AS cur, o_orderkey,
    CASE WHEN o_totalprice < 2000 THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS eff FROM orders),
quote_ok AS (
  SELECT cur, eff, arg_max(CAST(CAST(price * 100 AS DECIMAL(18,0)) AS HUGEINT) , o_orderkey) AS price_cents
  FROM quote WHERE price IS NOT NULL AND eff IS NOT NULL GROUP BY cur, eff),
-- a thousandth of the price with four decimals, half up
quote_rate AS (SELECT cur, eff, (price_cents + 5) // 10 AS ten_thousandths FROM quote_ok)"""

_QUOTED = """
ledger AS (SELECT 'P' || o_orderpriority[1] AS cur, CAST(o_orderdate + INTERVAL 15 DAY AS DATE) AS day,
  CAST(CAST(o_totalprice * 100 AS DECIMAL(18,0)) AS HUGEINT) AS cents FROM orders)"""
_QUOTED_OUT = f"""
SELECT l.cur AS cur_eff, CAST(year(l.day) AS BIGINT) AS year, count(*) AS n,
  {_big('count(*) FILTER (r.ten_thousandths IS NULL)')} AS no_rate,
  {_money('sum((l.cents * 10 * coalesce(r.ten_thousandths, 0) + 5000) // 10000)')} AS value
FROM ledger AS l"""

_BY_YEAR = f"""
SELECT cur AS cur_eff, CAST(y AS BIGINT) AS year, count(*) AS n, {_big('count(*) FILTER (no_rate)')} AS no_rate,
  {_money('sum(cents)')} AS value FROM rows WHERE NOT missing GROUP BY 1, 2"""

_QUALITY = f"""WITH {LINE}, {_rates()},
base AS (SELECT count(*) AS rows, count(*) FILTER (trim(ship_date) = '') AS missing_dates,
  count(*) FILTER (trim(amount) = '') AS missing_amounts,
  count(*) FILTER (try_cast(split_part(ship_date, '/', 1) AS INT) <= 12
    AND try_cast(split_part(ship_date, '/', 2) AS INT) <= 12) AS ambiguous_dates FROM line),
whole AS (SELECT count(*) AS exact_duplicate_groups FROM (SELECT count(*) AS c FROM
  (SELECT {', '.join(_LINE_COLUMNS)} FROM line) GROUP BY {', '.join(_LINE_COLUMNS)} HAVING count(*) > 1)),
clash AS (SELECT count(*) AS conflicting_duplicate_groups FROM
  (SELECT invoice FROM line WHERE invoice <> '' GROUP BY invoice HAVING count(DISTINCT trim(amount)) > 1)),
codes AS (SELECT count(*) AS unsupported_currencies FROM (SELECT DISTINCT upper(trim(currency)) AS c FROM line
  WHERE trim(currency) <> '') WHERE c NOT IN ('INR', 'USD', 'GBP')),
found AS (SELECT *, missing_dates + missing_amounts AS missing_values FROM base, whole, clash, codes),
quality AS (SELECT rows, missing_dates, missing_amounts, ambiguous_dates, exact_duplicate_groups,
  conflicting_duplicate_groups, unsupported_currencies, missing_values,
  CAST(greatest(0, 100 - least(20, 5 * exact_duplicate_groups) - least(20, 10 * conflicting_duplicate_groups)
    - least(15, 3 * missing_values) - least(10, 5 * unsupported_currencies) - least(10, ambiguous_dates)) AS BIGINT)
    AS score FROM found)"""


def _readings(start: str, end: str, alt_start: str, alt_end: str, entity: str = "true") -> str:
    """One row `r`: base and every other reading, refunds taken off, built by running the ledger per reading."""
    window = f"BETWEEN DATE '{start}' AND DATE '{end}'"
    alt = f"BETWEEN DATE '{alt_start}' AND DATE '{alt_end}'"
    base = ledger(scope=f"dmy {window}", entity=entity)

    def rated(source: str, day: str, rates: str) -> str:
        return f"{source} AS p ASOF LEFT JOIN {rates} AS r ON r.cur = p.cur AND p.{day} >= r.eff"

    def newest(source: str) -> str:
        return (
            f"{source} AS p LEFT JOIN (SELECT cur, arg_max(rate, eff) AS rate FROM rate_ok GROUP BY cur) AS r"
            " ON r.cur = p.cur"
        )

    per_row = _cents("amt", "CASE WHEN p.cur = 'INR' THEN 1 ELSE r.rate END")

    def net(joined_rows: str, joined_refunds: str, day: str, span: str) -> str:
        return f"""(SELECT coalesce(sum({per_row}), 0) FROM {joined_rows} WHERE p.clean AND p.in_entity AND p.{day} {span})
          - (SELECT coalesce(sum({per_row}), 0) FROM {joined_refunds} WHERE p.matched AND p.in_entity AND p.{day} {span})"""

    own = f"(SELECT coalesce(sum({per_row}), 0) FROM {rated('rows', 'dmy', 'rate_ok')} WHERE p.clean AND p.in_scope)"
    return f"""{base}, {_rates(False, 'rate_other')},
r AS (SELECT
  {net(rated('rows', 'dmy', 'rate_ok'), rated('matched', 'dmy', 'rate_ok'), 'dmy', window)} AS base,
  {net(rated('rows', 'mdy', 'rate_other'), rated('matched', 'mdy', 'rate_other'), 'mdy', window)} AS date_format,
  {net(rated('rows', 'dmy', 'rate_ok'), rated('matched', 'dmy', 'rate_ok'), 'dmy', alt)} AS quarter_definition,
  {own} AS refunds,
  {net(newest('rows'), newest('matched'), 'dmy', window)} AS conversion_basis,
  (SELECT count(*) FROM rows WHERE NOT missing AND dmy IS NOT NULL AND mdy IS NULL) AS only_as_given,
  (SELECT count(*) FROM rows WHERE NOT missing AND mdy IS NOT NULL AND dmy IS NULL) AS only_as_other,
  (SELECT count(*) FROM rows WHERE in_scope) AS scope_rows,
  (SELECT count(*) FROM rows WHERE in_scope AND ambiguous) AS ambiguous_rows,
  (SELECT coalesce(sum(cents), 0) FROM rows WHERE in_scope AND clean AND ambiguous) AS ambiguous_total)"""


def _percent(part: str, whole: str) -> str:
    return f"CAST(round(abs(CAST({part} AS DOUBLE)) / nullif(abs(CAST({whole} AS DOUBLE)), 0) * 100, 1) AS DECIMAL(38,1))"


_QUARTERS = _figure("y, q", _KEEP_QUARTER)
_FACTOR = "CASE WHEN year IN (1995, 1998) THEN 1000 WHEN year = 1996 THEN 1003 WHEN year < 2001 THEN 1020 END"
_COMPARED = f"""
compared AS (
  SELECT *, reported - result AS difference,
    CASE WHEN reported IS NULL THEN 'NOT_COMPARABLE'
         WHEN result = 0 OR abs(reported - result) * 200 > abs(result) THEN 'CONTRADICTION_DETECTED'
         ELSE 'CONSISTENT' END AS reconciliation
  FROM (SELECT *, CASE WHEN quarter = 4 THEN CAST(sign(result) * (CAST(abs(result) * 100 AS HUGEINT) * ({_FACTOR}) + 500 ) // 1000
     AS DECIMAL(30,0)) * 0.01 END AS reported FROM quarters))"""

_ORDER_SUMMARY = """
summary AS (
  SELECT quarter(o_orderdate) AS qq, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END AS yy,
    o_orderstatus AS st, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS reported, max(o_orderkey) AS file_row
  FROM orders GROUP BY 1, 2, 3),
reported AS (SELECT qq, yy, arg_max(reported, file_row) AS reported, max(file_row) AS file_row FROM summary GROUP BY 1, 2)"""

_ASKED = f"""{ledger(scope=Q4)},
code AS (
  SELECT cur_raw, cur AS converts_as, count(*) AS rows, sum(amt) AS native,
    count(*) FILTER (no_rate) AS rows_without_rate_on_date FROM rows WHERE in_scope GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    "ledger_scan": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
    "refund_scan": f"""WITH {REFUND} SELECT ref_key AS key, ref_amount_text AS ref_amount_raw,
  ref_date_text AS ref_date_raw, count(*) AS n FROM refund GROUP BY ALL""",
    "reported_quarters": f"""WITH {_ORDER_SUMMARY}
SELECT CAST(yy AS BIGINT) AS year, CAST(qq AS BIGINT) AS quarter, CAST(reported AS DECIMAL(38,2)) AS reported FROM reported""",
    "evidence_rows": f"""{ledger(scope=Q4)} SELECT invoice AS key, ship_date AS date_raw, ent AS entity_norm,
  amount AS amount_raw, cur AS cur_eff, CAST(coalesce(rate, 0) AS DECIMAL(38,6)) AS rate, {_money('cents')} AS value
FROM rows WHERE in_scope AND clean ORDER BY copy, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""",
    "evidence_full": f"""{ledger(scope=Q4)} SELECT invoice AS key, ship_date AS date_raw, ent AS entity_norm,
  amount AS amount_raw, cur AS cur_eff, CAST(coalesce(rate, 0) AS DECIMAL(38,6)) AS rate, {_money('cents')} AS value
FROM rows WHERE in_scope AND clean""",
    "date_parse_evidence": f"""{ledger()} SELECT count(*) FILTER (dmy IS NOT NULL AND mdy IS NULL) AS only_as_given,
  count(*) FILTER (mdy IS NOT NULL AND dmy IS NULL) AS only_as_other, count(*) FILTER (ambiguous) AS ambiguous,
  count(*) FILTER (dmy IS NULL AND mdy IS NULL) AS unreadable FROM rows WHERE NOT missing""",
    "rate_date_parse": """WITH d AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day
  FROM orders)
SELECT coalesce(strftime(day, '%Y-%m-%d'), 'invalid') AS iso, strftime(day, '%d/%m/%Y') AS day_first,
  strftime(day, '%m/%d/%Y') AS month_first, CAST(year(day) AS BIGINT) AS year, CAST(month(day) AS BIGINT) AS month,
  CAST(day(day) AS BIGINT) AS day_of_month, count(*) AS n FROM d GROUP BY day""",
    "amount_parse": f"""WITH {LINE}, p AS (SELECT CASE WHEN regexp_matches(trim(amount), {_NUMERIC}) THEN 'ok'
  ELSE 'unreadable' END AS problem, coalesce(try_cast(trim(amount) AS DECIMAL(25,6)), 0) AS a,
  try_cast(replace(trim(amount), ',', '') AS DECIMAL(25,6)) AS b FROM line)
SELECT problem, count(*) AS n, CAST(sum(a) AS DECIMAL(38,2)) AS as_written, {_decimal('sum(b)')} AS commas_removed,
  count(*) FILTER (b IS NULL) AS skipped FROM p GROUP BY problem""",
    "numeric_share": f"""WITH {LINE} SELECT {', '.join(
        f"count(*) FILTER (regexp_matches(replace(trim({c}), ',', ''), {_NUMERIC})) AS {c}" for c in _LINE_COLUMNS)}
FROM line""",
    "month_bucket": f"{ledger()} SELECT coalesce(strftime(dmy, '%Y-%m'), '') AS month, count(*) AS n FROM rows GROUP BY 1",
    "quarter_of_range": """WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE)
    ELSE CAST(date_trunc('quarter', o_orderdate) AS DATE) END AS s,
  CASE WHEN o_orderstatus = 'P' THEN last_day(o_orderdate)
    ELSE last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) END AS e FROM orders)
SELECT CAST(year(s) AS BIGINT) AS year, CAST(quarter(s) AS BIGINT) AS quarter, count(*) AS n FROM r
WHERE day(s) = 1 AND month(s) IN (1, 4, 7, 10) AND e = last_day(s + INTERVAL 2 MONTH) GROUP BY 1, 2""",
    "currency_counts": f"{ledger()} SELECT cur_raw, cur AS cur_eff, count(*) AS n FROM rows GROUP BY 1, 2",
    "currency_map_check": """WITH e AS (SELECT CASE WHEN c_acctbal < 1000 THEN '(BLANK)'
    ELSE upper(c_mktsegment[1:3]) END AS code, upper(CASE c_mktsegment WHEN 'BUILDING' THEN 'USD'
    WHEN 'FURNITURE' THEN 'DOLLARS' WHEN 'MACHINERY' THEN 'E1R' ELSE c_mktsegment[2:4] END) AS means FROM customer)
SELECT code, means, regexp_matches(means, '^[A-Z]{3}$') AS valid, count(*) AS n FROM e GROUP BY ALL""",
    "entity_list": f"""WITH {LINE} SELECT lower(trim(branch)) AS entity_norm,
  arg_min({_title('branch')}, (copy, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS entity
FROM line WHERE trim(branch) <> '' GROUP BY 1""",
    "rate_intervals": f"""{QUOTE} SELECT cur, CAST(ten_thousandths * 0.0001 AS DECIMAL(38,6)) AS rate,
  strftime(eff, '%Y-%m-%d') AS valid_from,
  strftime(lead(eff) OVER (PARTITION BY cur ORDER BY eff), '%Y-%m-%d') AS valid_to FROM quote_rate""",
    "asof_convert": ledger(scope=Q4) + _BY_YEAR,
    "asof_convert_quotes": f"{QUOTE}, {_QUOTED} {_QUOTED_OUT} ASOF LEFT JOIN quote_rate AS r ON r.cur = l.cur AND l.day >= r.eff GROUP BY 1, 2",
    "latest_convert": ledger(latest=True, scope=Q4) + _BY_YEAR,
    "latest_convert_quotes": f"""{QUOTE}, {_QUOTED} {_QUOTED_OUT} LEFT JOIN
  (SELECT cur, arg_max(ten_thousandths, eff) AS ten_thousandths FROM quote_rate GROUP BY cur) AS r ON r.cur = l.cur
GROUP BY 1, 2""",
    "missing_rows": f"""WITH {LINE} SELECT count(*) AS rows, count(*) FILTER (trim(ship_date) = '') AS missing_dates,
  count(*) FILTER (trim(amount) = '') AS missing_amounts FROM line""",
    "exact_duplicates": f"""WITH {LINE},
a AS (SELECT count(*) AS copies FROM line GROUP BY invoice, ship_date, branch, amount HAVING count(*) > 1),
b AS (SELECT count(*) AS copies FROM line GROUP BY {', '.join(_LINE_COLUMNS)} HAVING count(*) > 1)
SELECT 'key, date, entity, amount' AS identity, copies, count(*) AS groups FROM a GROUP BY copies
UNION ALL SELECT 'whole row', copies, count(*) FROM b GROUP BY copies""",
    "conflicting_keys": f"""{ledger()},
seen AS (SELECT invoice, min(trim(amount)) AS low, max(trim(amount)) AS high FROM line WHERE invoice <> ''
  GROUP BY invoice HAVING count(DISTINCT trim(amount)) > 1),
gone AS (SELECT DISTINCT invoice FROM rows WHERE conflict)
SELECT coalesce(s.invoice, g.invoice) AS key, low, high, g.invoice IS NOT NULL AS excluded
FROM seen AS s FULL JOIN gone AS g ON s.invoice = g.invoice""",
    "first_row_per_key": f"""{ledger()} SELECT ent AS entity_norm, cur AS cur_eff, count(*) AS keys,
  {_decimal('sum(amt)')} AS amount FROM heads GROUP BY 1, 2""",
    "conflict_excluded": f"""{ledger()} SELECT ent AS entity_norm, cur AS cur_eff, count(*) AS n,
  {_decimal('sum(amt)')} AS amount FROM rows WHERE clean GROUP BY 1, 2""",
    "clean_ledger_totals": _figure("ent"),
    "conflicts_in_scope": f"""{ledger(scope="dmy BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")}
SELECT invoice AS key, count(*) AS rows FROM rows WHERE in_scope AND conflict AND copy_no = 1 GROUP BY 1""",
    "stage_totals": f"""{ledger()} SELECT CAST(y AS BIGINT) AS year, CAST(q AS BIGINT) AS quarter, {_STAGE}
FROM rows WHERE y IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT DISTINCT CAST(y AS BIGINT), CAST(q AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM refunded
WHERE (y, q) NOT IN (SELECT (y, q) FROM rows WHERE y IS NOT NULL)""",
    "ambiguous_in_scope": f"{ledger(scope=Q4)} SELECT ent AS entity_norm, {_big('count(*) FILTER (in_scope AND ambiguous)')} AS ambiguous_rows, {_money('sum(cents) FILTER (in_scope AND clean AND ambiguous)')} AS ambiguous_total FROM rows GROUP BY 1",
    "quarter_total": _figure(scope=Q4),
    "fiscal_quarter_total": _figure(scope="dmy BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'"),
    "month_total": _figure(scope="dmy BETWEEN DATE '2000-02-01' AND DATE '2000-02-29'"),
    "year_total": _pick(_figure("y", _KEEP_QUARTER), "* REPLACE (CAST(year AS BIGINT) AS year)"),
    "latest_year": f"{ledger()} SELECT CAST(year(max(dmy)) AS BIGINT) AS year FROM rows",
    "row_count_answer": f"""{ledger(scope=Q4)} SELECT ent AS entity_norm,
  CAST(count(*) FILTER (in_scope AND clean) AS DECIMAL(38,2)) AS result FROM rows GROUP BY 1""",
    "entity_filter_total": _figure(scope=Q4, entity="ent = 'asia'"),
    "column_filter_total": _figure(entity="return_flag = 'R' AND line_status = 'F'"),
    "scope_before_cleaning": f"""{ledger(scope=Q4, entity="ent IN ('asia', 'europe')")}
SELECT ent AS entity_norm, cur_raw, count(*) AS n, {_decimal('sum(amt)')} AS native FROM rows WHERE in_scope GROUP BY 1, 2""",
    "unsupported_by_currency": f"""{ledger(answers={})} SELECT CASE cur WHEN '' THEN '(blank)' ELSE cur END AS currency,
  count(*) AS rows, {_decimal('sum(amt)')} AS native_amount, {_decimal('sum(amt)')} AS native_amount_scaled
FROM rows WHERE in_scope AND clean AND no_rate GROUP BY 1""",
    "unsupported_keys": f"""{ledger(scope=Q4)} SELECT invoice AS key, ship_date AS date_raw, amount AS amount_raw,
  cur AS cur_eff FROM rows WHERE in_scope AND clean AND no_rate
ORDER BY copy, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25""",
    "conversion_summary": f"""{ledger(scope=Q4)} SELECT CASE cur WHEN '' THEN '(blank)' ELSE cur END AS currency,
  cur <> 'INR' AS is_foreign, count(*) AS rows FROM rows WHERE in_scope AND clean GROUP BY 1, 2""",
    "refund_totals": f"""{ledger()} SELECT ent AS entity_norm, CAST(y AS BIGINT) AS year, CAST(q AS BIGINT) AS quarter,
  {_BACK}, {_big('count(*) FILTER (no_rate)')} AS refund_unsupported FROM refunded GROUP BY 1, 2, 3""",
    "refund_unmatched": f"""{ledger()} SELECT ref_key AS key, ref_amount_text AS ref_amount_raw,
  ref_date_text AS ref_date_raw FROM matched WHERE NOT matched""",
    "metric_column_total": _pick(
        _figure("y, q", keep=_KEEP_QUARTER, refunds=False, metric="quantity"),
        "* REPLACE (CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter), true AS agrees",
    ),
    "net_total": _pick(
        _QUARTERS, "CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, final_total, refund_total, result"
    ),
    "refund_policy_excluded": _figure(scope=Q4, refunds=False),
    "multiplier_total": f"""WITH {_rates()}, o AS (SELECT lower(o_orderpriority) AS ent, CAST(o_orderdate AS DATE) AS dmy,
  CAST(o_totalprice AS DECIMAL(15,2)) AS amt, CASE o_orderstatus WHEN 'F' THEN 'INR' WHEN 'O' THEN 'USD' ELSE 'EUR' END AS cur
  FROM orders),
v AS (SELECT o.*, CASE WHEN o.cur = 'INR' THEN 1 ELSE r.rate END AS rate FROM o
  ASOF LEFT JOIN rate_ok AS r ON r.cur = o.cur AND o.dmy >= r.eff)
SELECT ent AS entity_norm, CAST(year(dmy) AS BIGINT) AS year, count(*) AS final_rows,
  count(*) FILTER (rate IS NULL) AS unsupported_rows, {_money(f"sum({_cents('amt', 'rate', 10)})")} AS result
FROM v GROUP BY 1, 2""",
    "blocked_scopes": f"""WITH f AS ({_figure('ent, y, q', _KEEP_QUARTER)}),
s AS ({ledger()} SELECT ent AS entity_norm, y AS year, q AS quarter, {_STAGE} FROM rows WHERE y IS NOT NULL GROUP BY 1, 2, 3)
SELECT entity_norm, CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter,
  CASE WHEN coalesce(unsupported_rows, 0) > 0 OR coalesce(conflict_keys, 0) > 0 THEN 'BLOCKED_POLICY' ELSE 'VERIFIED' END AS status,
  CASE WHEN coalesce(unsupported_rows, 0) > 0 OR coalesce(conflict_keys, 0) > 0 THEN NULL ELSE result END AS result
FROM f LEFT JOIN s USING (entity_norm, year, quarter)""",
    "metadata_count": f"""WITH {LINE} SELECT count(*) AS rows FROM line
WHERE lower(trim(branch)) = 'asia' AND return_flag = 'A'""",
    "rank_entities": f"""WITH f AS ({_figure('ent', scope=Q4)}),
s AS ({ledger(scope=Q4)} SELECT ent AS entity_norm,
  {_big('count(*) FILTER (in_scope AND clean AND no_rate)')} AS unsupported_rows,
  {_big('count(DISTINCT invoice) FILTER (in_scope AND copy_no = 1 AND conflict)')} AS conflict_keys,
  arg_min(CASE WHEN trim(branch) <> '' THEN {_title('branch')} END, (copy, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS entity
  FROM rows WHERE ent <> '' GROUP BY 1)
SELECT row_number() OVER (ORDER BY result DESC, entity) AS rank, entity, result, true AS verified, unsupported_rows,
  conflict_keys FROM s JOIN f USING (entity_norm)""",
    "ranking_sorted": f"""{ledger()} SELECT CASE ent WHEN '' THEN '(blank)' ELSE ent END AS entity,
  {_money('sum(cents) FILTER (in_scope AND clean)')} AS final_total FROM rows GROUP BY 1""",
    "verify_routes": _pick(_figure("ent", scope=Q4), "entity_norm, result, result AS result_b, true AS agrees"),
    "verify_routes_latest": _pick(
        _figure("y, q", _KEEP_QUARTER, answers={"EUR": "USD", "(BLANK)": "INR", "GBP": "XXX"}, latest=True),
        "CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, result, result AS result_b, true AS agrees",
    ),
    "issued_evidence": _pick(
        _QUARTERS, "CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, result, final_rows"
    ),
    "column_profile": f"""WITH {LINE}, cells AS ({_unpivot(_LINE_COLUMNS)})
SELECT "column", count(*) FILTER (value <> '') AS non_empty, count(*) FILTER (value = '') AS empty,
  count(*) FILTER (regexp_matches(replace(value, ',', ''), {_NUMERIC})) AS numeric_values,
  count(DISTINCT value) FILTER (value <> '') AS distinct_values FROM cells GROUP BY 1""",
    "column_samples": f"""WITH {LINE}, cells AS ({_unpivot(_LINE_COLUMNS)}),
first AS (SELECT "column", value, min((copy, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS seen FROM cells
  WHERE value <> '' GROUP BY 1, 2)
SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY seen, value) AS position, value FROM first
QUALIFY position <= 5""",
    "event_column_profile": f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS event, strftime(ts, '%d/%m/%Y') AS event_date,
  event_type, CAST(CAST(value AS DECIMAL(15,2)) AS VARCHAR) AS amount, props FROM events),
cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, trim({c}) AS v FROM e" for c in "event event_date event_type amount props".split())})
SELECT c AS "column", count(*) FILTER (coalesce(v, '') <> '') AS non_empty, count(*) FILTER (coalesce(v, '') = '') AS empty,
  count(*) FILTER (regexp_matches(replace(v, ',', ''), {_NUMERIC})) AS numeric_values,
  count(DISTINCT v) FILTER (v <> '') AS distinct_values FROM cells GROUP BY 1""",
    "unsupported_codes": f"""WITH {LINE} SELECT upper(trim(currency)) AS code, count(*) AS rows,
  upper(trim(currency)) IN ('INR', 'USD', 'GBP') AS supported FROM line WHERE trim(currency) <> '' GROUP BY 1, 3""",
    "profile_ambiguous_dates": f"{_QUALITY} SELECT rows, ambiguous_dates FROM quality",
    "quality_score": f"{_QUALITY} SELECT * FROM quality",
    "quality_findings": f"""{_QUALITY}, lines AS (
  SELECT 'exact_duplicate_groups' AS finding, exact_duplicate_groups AS n FROM quality
  UNION ALL SELECT 'conflicting_duplicate_groups', conflicting_duplicate_groups FROM quality
  UNION ALL SELECT 'missing_dates', missing_dates FROM quality
  UNION ALL SELECT 'missing_amounts', missing_amounts FROM quality
  UNION ALL SELECT 'ambiguous_dates', ambiguous_dates FROM quality
  UNION ALL SELECT 'unsupported_currencies', unsupported_currencies FROM quality)
SELECT finding, n, CASE WHEN score >= 90 THEN 'Looks great' WHEN score >= 75 THEN 'Mostly fine' ELSE 'Needs attention' END
  AS health, exact_duplicate_groups + conflicting_duplicate_groups + missing_dates + missing_amounts + ambiguous_dates
  AS issues FROM lines, quality WHERE n > 0""",
    "category_choice": f"""WITH {LINE}, cells AS ({_unpivot(['quantity', 'return_flag', 'line_status'])})
SELECT "column" AS category, count(DISTINCT lower(value)) AS distinct_values FROM cells WHERE value <> ''
GROUP BY "column", pos HAVING avg(CASE WHEN regexp_matches(replace(value, ',', ''), {_NUMERIC}) THEN 1 ELSE 0 END) < 0.5
  AND count(DISTINCT lower(value)) BETWEEN 2 AND 20 ORDER BY pos LIMIT 1""",
    "currency_profile": f"""{_ASKED},
file AS (SELECT cur, min(eff) AS first_day, max(eff) AS last_day, arg_max(rate, eff) AS rate FROM rate_ok GROUP BY cur)
SELECT cur_raw, rows, {_decimal('native')} AS native_amount, rows_without_rate_on_date,
  CASE cur_raw WHEN 'RS' THEN 'INR' WHEN 'USD' THEN 'USD' END AS confirmed_as, converts_as,
  converts_as = 'INR' AS is_target, f.cur IS NOT NULL OR converts_as = 'INR' AS rate_on_file,
  strftime(first_day, '%Y-%m-%d') AS first_rate_day, strftime(last_day, '%Y-%m-%d') AS latest_rate_day,
  CAST(rate AS DECIMAL(38,6)) AS latest_rate FROM code LEFT JOIN file AS f ON f.cur = converts_as""",
    "currency_open_items": f"""{_ASKED},
open AS (SELECT * FROM code WHERE cur_raw <> 'INR' AND cur_raw <> 'RS')
SELECT 'confirm_currency:' || cur_raw AS item, rows, {_decimal('native')} AS native_amount FROM open WHERE cur_raw <> 'USD'
UNION ALL SELECT 'conversion_basis', {_big('sum(rows)')}, NULL FROM open HAVING count(*) > 0""",
    "currency_suggestions": f"""{_ASKED},
asked AS (SELECT cur_raw FROM code WHERE cur_raw <> 'INR'),
choice AS (SELECT 'RS' AS c, 0 AS p, 'INR' AS s UNION ALL
  SELECT cur_raw, row_number() OVER (PARTITION BY cur_raw ORDER BY cur), cur FROM asked, (SELECT DISTINCT cur FROM rate_ok)
  UNION ALL SELECT cur_raw, 999, 'INR' FROM asked),
kept AS (SELECT c, s, min(p) AS p FROM choice WHERE c <> s AND c IN (SELECT cur_raw FROM asked) GROUP BY c, s)
SELECT c AS currency, row_number() OVER (PARTITION BY c ORDER BY p) AS position, s AS suggestion FROM kept""",
    "request_check": f"""WITH {LINE}, known AS (SELECT DISTINCT lower(trim(branch)) AS e FROM line WHERE trim(branch) <> ''),
asked AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'territory' WHEN 'MACHINERY' THEN 'currency' ELSE 'branch' END AS col,
  c_acctbal < 0 AS bad_op, CASE WHEN c_mktsegment = 'FURNITURE' THEN lower(n_name) ELSE lower(r_name) END AS v,
  c_acctbal > 9000 AS by_currency FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)
SELECT CASE WHEN bad_op THEN 'operator not supported' WHEN col = 'territory' THEN 'column does not exist'
  WHEN col = 'branch' AND v NOT IN (SELECT e FROM known) THEN 'unknown entity'
  WHEN by_currency THEN 'grouping not supported' ELSE 'none' END AS problem, count(*) AS n FROM asked GROUP BY 1""",
    "range_check": """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS s, CASE o_orderstatus
  WHEN 'F' THEN CAST(o_orderdate + INTERVAL 30 DAY AS DATE) WHEN 'O' THEN CAST(o_orderdate - INTERVAL 1 DAY AS DATE)
  ELSE CASE WHEN day(last_day(o_orderdate)) = 31 THEN last_day(o_orderdate) END END AS e FROM orders)
SELECT CASE WHEN s <= e THEN 'OK' ELSE 'FAILED' END AS status, CAST(month(e) AS BIGINT) AS end_month, count(*) AS n
FROM r GROUP BY 1, 2""",
    "impact_waterfall": f"""WITH f AS ({_figure('ent', scope=Q4)}),
s AS ({ledger(scope=Q4)} SELECT ent AS entity_norm, {_STAGE} FROM rows GROUP BY 1),
w AS (SELECT f.entity_norm, s.raw_total, s.dedup_total - s.raw_total AS d, s.final_total - s.dedup_total AS c,
  f.refund_total AS b, f.result FROM f JOIN s USING (entity_norm))
SELECT entity_norm, step, label, CAST(amount AS DECIMAL(38,2)) AS amount, raw_total + d + c + b = result AS reconciles FROM (
  SELECT *, 1::BIGINT AS step, 'raw total' AS label, raw_total AS amount FROM w
  UNION ALL SELECT *, 2, 'duplicate rows', d FROM w UNION ALL SELECT *, 3, 'conflicting invoices', c FROM w
  UNION ALL SELECT *, 4, 'refunds', b FROM w UNION ALL SELECT *, 5, 'verified total', result FROM w)""",
    "largest_risk": f"""WITH f AS ({_QUARTERS}),
s AS ({ledger()} SELECT y AS year, q AS quarter, {_STAGE} FROM rows WHERE y IS NOT NULL GROUP BY 1, 2),
w AS (SELECT f.year, f.quarter, abs(coalesce(s.dedup_total - s.raw_total, 0)) AS d,
  abs(coalesce(s.final_total - s.dedup_total, 0)) AS c, abs(f.refund_total) AS b, coalesce(unsupported_rows, 0) AS u
  FROM f LEFT JOIN s USING (year, quarter))
SELECT CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter,
  CASE WHEN greatest(d, c, b) = 0 THEN CASE WHEN u > 0 THEN 'rows excluded without a convertible amount (value unknown)'
    ELSE 'None identified' END WHEN d >= c AND d >= b THEN 'duplicate rows' WHEN c >= b THEN 'conflicting invoices'
    ELSE 'refunds' END AS risk, CAST(greatest(d, c, b) AS DECIMAL(38,2)) AS risk_amount FROM w""",
    "cleanup_actions": f"""{ledger(scope=Q4)}, s AS (SELECT ent AS entity_norm, {_STAGE} FROM rows GROUP BY 1),
lines AS (SELECT entity_norm, 1 AS position, 'resolve conflicting amounts' AS action, conflict_keys AS items FROM s
  UNION ALL SELECT entity_norm, 2, 'add exchange rates', unsupported_rows FROM s
  UNION ALL SELECT entity_norm, 3, 'supply dates or amounts', missing_rows FROM s
  UNION ALL SELECT entity_norm, 4, 'remove exact duplicates', raw_rows - dedup_rows FROM s)
SELECT entity_norm, CAST(position AS BIGINT) AS position, action, items FROM lines WHERE items > 0
UNION ALL SELECT entity_norm, 0, 'no cleanup required', 0 FROM lines GROUP BY entity_norm HAVING max(items) = 0""",
    "sensitivity_lines": f"""{_readings('1998-10-01', '1998-12-31', '1998-01-01', '1998-03-31')},
lines AS (
  SELECT 'date_format' AS scenario, base, date_format AS v, CASE WHEN only_as_given > 0 AND only_as_other = 0
    THEN 'format established by data' ELSE 'format not established by data' END AS assessment FROM r
  UNION ALL SELECT 'quarter_definition', base, quarter_definition, 'genuinely ambiguous label' FROM r
  UNION ALL SELECT 'refunds', base, refunds, 'policy choice' FROM r
  UNION ALL SELECT 'conversion_basis', base, conversion_basis, 'policy choice (confirmed by the user)' FROM r)
SELECT scenario, {_money('base')} AS base_result, {_money('v')} AS result, {_money('v - base')} AS difference,
  {_percent('v - base', 'base')} AS percent, assessment FROM lines""",
    "date_exposure": f"""{_readings('1998-10-01', '1998-12-31', '1998-01-01', '1998-03-31', "ent = 'asia'")}
SELECT {_money('base')} AS base, {_money('date_format')} AS date_format, only_as_given, only_as_other, scope_rows,
  ambiguous_rows, {_money('ambiguous_total')} AS ambiguous_total, only_as_given > 0 AND only_as_other = 0 AS format_proved,
  CASE WHEN only_as_given > 0 AND only_as_other = 0 THEN {_money('abs(ambiguous_total)')}
    ELSE {_money('abs(date_format - base)')} END AS exposed FROM r""",
    "materiality": f"""{_readings('1999-07-01', '1999-09-30', '1999-10-01', '1999-12-31')},
w AS (SELECT base, greatest(CASE WHEN only_as_given > 0 AND only_as_other = 0 THEN abs(ambiguous_total)
    ELSE abs(date_format - base) END, abs(quarter_definition - base), abs(refunds - base), abs(conversion_basis - base))
    AS worst FROM r)
SELECT {_money('base')} AS base, {_money('worst')} AS worst, {_percent('worst', 'base')} AS worst_percent,
  CASE WHEN base = 0 OR worst * 200 < abs(base) THEN 'Low' WHEN worst * 20 < abs(base) THEN 'Medium' ELSE 'High' END
  AS materiality FROM w""",
    "summary_join": f"""WITH quarters AS ({_QUARTERS}), {_ORDER_SUMMARY},
own AS (SELECT * FROM reported WHERE qq = 4 AND yy IS NOT NULL),
general AS (SELECT * FROM reported WHERE qq = 4 AND yy IS NULL)
SELECT CAST(year AS BIGINT) AS year, result, CAST(CASE WHEN o.file_row IS NULL OR g.file_row > o.file_row
  THEN g.reported ELSE o.reported END AS DECIMAL(38,2)) AS reported
FROM quarters LEFT JOIN own AS o ON o.yy = year LEFT JOIN general AS g ON true WHERE quarter = 4""",
    "summary_reconciliation": f"""WITH quarters AS ({_QUARTERS}), {_COMPARED}
SELECT CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, result, CAST(reported AS DECIMAL(38,2)) AS reported,
  CAST(difference AS DECIMAL(38,2)) AS difference, {_percent('difference', 'result')} AS percent, reconciliation FROM compared""",
    "request_reconciliation": f"""WITH whole AS ({_figure(scope=Q4)}), part AS ({_figure(scope=Q4, entity="ent = 'asia'")}),
other AS ({_figure(scope="dmy BETWEEN DATE '1998-07-01' AND DATE '1998-09-30'")}), {_ORDER_SUMMARY},
own AS (SELECT * FROM reported WHERE qq = 4 AND yy = 1998),
general AS (SELECT * FROM reported WHERE qq = 4 AND yy IS NULL),
told AS (SELECT CAST(CASE WHEN o.file_row IS NULL OR g.file_row > o.file_row THEN g.reported ELSE o.reported END AS DECIMAL(38,2)) AS reported
  FROM (SELECT 1) LEFT JOIN own AS o ON true LEFT JOIN general AS g ON true),
asked AS (SELECT 'entity' AS request, result, (SELECT result FROM whole) AS compared, 'company-wide' AS scope, '' AS reason FROM part
  UNION ALL SELECT 'whole', result, result, 'as asked', '' FROM whole
  UNION ALL SELECT 'other', result, NULL, NULL, 'not a calendar Q4' FROM other),
line AS (SELECT a.*, CASE WHEN reason = '' THEN t.reported END AS reported,
  CASE WHEN reason = '' THEN t.reported - compared END AS difference FROM asked AS a, told AS t)
SELECT request, result, compared, reported, CAST(difference AS DECIMAL(38,2)) AS difference, {_percent('difference', 'compared')} AS percent,
  CASE WHEN reported IS NULL THEN 'NOT_COMPARABLE' WHEN compared = 0 OR abs(difference) * 200 > abs(compared)
    THEN 'CONTRADICTION_DETECTED' ELSE 'CONSISTENT' END AS reconciliation,
  CASE WHEN reported IS NOT NULL THEN scope END AS scope,
  CASE WHEN reason = '' AND reported IS NULL THEN 'nothing reported' ELSE reason END AS reason FROM line""",
    "request_audit": f"""WITH told AS ({{reconciled}}), audits AS ({" UNION ALL ".join(_audited(*a) for a in _AUDITS)}),
j AS (SELECT a.*, coalesce(final_total, 0) + coalesce(refund_total, 0) AS figure, t.compared, t.reported,
  coalesce(t.reconciliation, 'NOT_COMPARABLE') AS reconciliation FROM audits AS a
  LEFT JOIN told AS t ON t.request = CASE a.request WHEN 'column' THEN 'entity' ELSE a.request END), -- both are compared with the whole company's Q4
k AS (SELECT *, reconciliation = 'CONTRADICTION_DETECTED' AS off, unsupported_rows > 0 AS u, conflict_keys > 0 AS k, final_rows = 0 AS z FROM j)
SELECT * EXCLUDE (figure, off, u, k, z, compared, reported, reconciliation), 'VERIFIED' AS status, {_decimal('figure')} AS result, {_decimal('figure')} AS result_b,
  {_decimal('dedup_total - raw_total')} AS duplicate_effect, {_decimal('final_total - dedup_total')} AS conflict_effect,
  refund_total AS refund_effect, true AS reconciles, compared, reported, reconciliation,
  CASE WHEN off OR u OR k OR z THEN 'VERIFIED_WITH_POLICY' ELSE 'VERIFIED' END AS decision,
  CASE WHEN off OR u OR k OR z THEN 'MANAGEMENT_REVIEW_REQUIRED' ELSE 'INTERNAL_EXPLORATION_OK' END AS publishability,
  concat_ws('; ', CASE WHEN off THEN 'reported figure differs' END, CASE WHEN u THEN 'rows without a rate' END,
    CASE WHEN k THEN 'conflicting amounts' END, CASE WHEN z THEN 'no data in scope' END) AS reasons FROM k""",
    "trust_verdict": f"""WITH quarters AS ({_QUARTERS}), {_COMPARED},
s AS ({ledger()} SELECT y AS year, q AS quarter, {_STAGE} FROM rows WHERE y IS NOT NULL GROUP BY 1, 2),
j AS (SELECT c.year, c.quarter, c.result, c.reconciliation = 'CONTRADICTION_DETECTED' AS off,
  coalesce(s.unsupported_rows, 0) > 0 AS u, coalesce(s.conflict_keys, 0) > 0 AS k, coalesce(s.final_rows, 0) = 0 AS z
  FROM compared AS c LEFT JOIN s USING (year, quarter))
SELECT CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, result,
  CASE WHEN off OR u OR k OR z THEN 'VERIFIED_WITH_POLICY' ELSE 'VERIFIED' END AS decision,
  CASE WHEN off OR u OR k OR z THEN 'MANAGEMENT_REVIEW_REQUIRED' ELSE 'INTERNAL_EXPLORATION_OK' END AS publishability,
  concat_ws('; ', CASE WHEN off THEN 'reported figure differs' END, CASE WHEN u THEN 'rows without a rate' END,
    CASE WHEN k THEN 'conflicting amounts' END, CASE WHEN z THEN 'no data in scope' END) AS reasons FROM j""",
    "entity_quarter_totals": f"""{ledger()} SELECT ent AS entity_norm, CAST(y AS BIGINT) AS year, CAST(q AS BIGINT) AS quarter,
  {_money('sum(cents) FILTER (in_scope)')} AS raw_total, {_money('sum(cents) FILTER (in_scope AND clean)')} AS final_total,
  {_big('count(*) FILTER (in_scope AND clean AND no_rate)')} AS unsupported_rows FROM rows WHERE y IS NOT NULL GROUP BY 1, 2, 3""",
    "top_entity": f"""{ledger()}, t AS (SELECT y, CASE q WHEN 1 THEN 4 ELSE q - 1 END AS fq, ent,
  {_money('sum(cents) FILTER (in_scope AND clean)')} AS total FROM rows WHERE y IS NOT NULL GROUP BY 1, 2, 3)
SELECT CAST(y AS BIGINT) AS year, CAST(fq AS BIGINT) AS fiscal_quarter, ent AS entity, total FROM t
QUALIFY row_number() OVER (PARTITION BY y, fq ORDER BY total DESC, ent DESC) = 1""",
    "cube_cells": f"{CUBE} SELECT month, entity, category, {_money('cents')} AS value, n FROM cells",
    "cube_sorted": f"{CUBE} SELECT month, entity, category, {_money('cents')} AS value, n FROM cells ORDER BY 1, 2, 3",
    "event_cube": f"""SELECT strftime(ts, '%Y-%m') AS month, {_title('event_type')} AS entity, '' AS category,
  {_decimal('sum(CAST(value AS DECIMAL(15,2)))')} AS value, count(*) AS n FROM events GROUP BY ALL""",
    "cube_skips": f"""{CUBE}, c AS (SELECT count(*) FILTER (reason = 'used') AS used,
  count(*) FILTER (reason = 'no amount') AS a, count(*) FILTER (reason = 'no exchange rate') AS b,
  count(*) FILTER (reason = 'no currency') AS c, count(*) FILTER (reason = 'used' AND month = '') AS u,
  {_big('sum(copies - 1)')} AS d FROM charted)
SELECT unnest(['used', 'no amount', 'no exchange rate', 'no currency', 'undated', 'repeats']) AS reason,
  unnest([used, a, b, c, u, d]) AS rows FROM c""",
    "cube_currencies": f"{CUBE} SELECT cur_raw AS currency, count(*) AS rows FROM charted WHERE reason = 'used' GROUP BY 1",
    "cube_rollups": f"""{CUBE}, lines AS ({_ROLLUP})
SELECT chart, name, {_money('sum(cents)')} AS value, {_big('sum(n)')} AS n FROM lines GROUP BY 1, 2""",
    "cross_filter": f"""{CUBE}, lines AS (
  SELECT 'entity' AS chart, entity AS name, cents, n FROM cells WHERE category = 'R' UNION ALL
  SELECT 'category', category, cents, n FROM cells WHERE entity = 'Asia' UNION ALL
  SELECT 'month', month, cents, n FROM cells WHERE month <> '' AND entity = 'Asia' AND category = 'R' UNION ALL
  SELECT 'total', '', cents, n FROM cells WHERE entity = 'Asia' AND category = 'R')
SELECT chart, name, {_money('sum(cents)')} AS value, {_big('sum(n)')} AS n,
  {_money("CASE WHEN sum(cents) < 0 THEN -1 ELSE 1 END * ((2 * abs(sum(cents)) + sum(n)) // (2 * sum(n)))")} AS average FROM lines GROUP BY 1, 2""",
    "top_slices": f"""{CUBE}, m AS (SELECT month AS name, sum(cents) AS cents FROM cells WHERE month <> '' GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY cents DESC, name) AS p FROM m WHERE cents > 0)
SELECT CASE WHEN p <= 6 THEN name ELSE 'Other' END AS name, p > 6 AS is_other, {_money('sum(cents)')} AS value
FROM placed GROUP BY 1, 2""",
}

ORACLES["compare_entities"] = (
    f"SELECT entity, result, unsupported_rows, conflict_keys FROM ({ORACLES['rank_entities']}) AS ranked "
    "WHERE lower(entity) IN ('asia', 'europe') UNION ALL SELECT 'Atlantis', CAST(0 AS DECIMAL(38, 2)), 0, 0"
)

ORACLES["request_audit"] = ORACLES["request_audit"].replace("{reconciled}", ORACLES["request_reconciliation"])
