"""The same figure by another way: SQL, its own parsing and arithmetic, rates looked up per currency and day.

Nothing here uses the functions of the first route, so an error there cannot repeat itself here.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.config import BLANK_CURRENCY, DD_MM, EXCLUDE_REFUNDS, LATEST, Mapping, Policy, Request, RequestError

# a rate of too many digits; no rate in a table is this
_LOST = "cast('-99999999.9999999999' as decimal(18,10))"
# white space of every kind, by its code points
_BLANKS = "".join(
    rf"\u{n:04x}" for n in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_TRIM = "trim(BOTH '" + _BLANKS + "' FROM {0})"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(column: str | None) -> str:
    return f"coalesce(cast({_name(column)} as string), '')" if column else "''"


def _quoted(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}")
    return f"'{escaped}'"


def _trim(expression: str) -> str:
    return _TRIM.format(expression)


def _currency(code: str, policy: Policy) -> str:
    """`code` is a column: it is compared with every name."""
    known = {("" if k == BLANK_CURRENCY else k): v for k, v in policy.currency_map.items()}
    cases = "".join(f" WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in known.items() if k)
    return f"CASE {code} WHEN '' THEN {_quoted(known.get('', ''))} WHEN 'NAN' THEN {_quoted(known.get('', ''))}{cases} ELSE {code} END"


def _valued(rows: str, amount: str, policy: Policy, mapping: Mapping) -> str:
    """SQL for the rows, which have `cur` and `rate`, with `value`: amount x multiplier x rate to cents, half up, the rate's
    whole part and its fraction apart. What is used more than once is a column of its own first.

    NULL for a number whose digits do not fit, 0 for text that is no number.
    """
    factor = Decimal(str(mapping.unit_multiplier)).normalize()
    places = max(0, -factor.as_tuple().exponent)
    digits = max(len(factor.as_tuple().digits) + max(0, factor.as_tuple().exponent), places)
    scaled = "held" if factor == 1 else f"try_cast(held * cast('{factor:f}' as decimal({digits},{places})) as decimal(25,6))"
    number = "written rlike '^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$'"
    decimals = "length(regexp_extract(written, '[.]([0-9]*[1-9])0*$', 1))"
    fits = f"scaled IS NOT NULL AND {decimals} <= {6 - places} AND coalesce(try_cast(written as decimal(38,18)) = held, true)"
    # kept narrow, so that the sum has room for all seven decimals
    fraction = "cast(floor(size * cast(each - floor(each) as decimal(10,10)), 7) as decimal(30,7))"
    money = f"cast(round(cast(size * floor(each) as decimal(34,6)) + {fraction}, 2) as decimal(30,2))"
    return f"""
      SELECT * EXCEPT (written, each, numeral, held, scaled, size, money), CASE WHEN NOT numeral THEN 0 WHEN scaled < 0 THEN -money ELSE money END AS value
      FROM (SELECT *, CASE WHEN numeral AND {fits} AND NOT (scaled <> 0 AND each = {_LOST}) THEN {money} END AS money
      FROM (SELECT *, abs(scaled) AS size
      FROM (SELECT *, {scaled} AS scaled
      FROM (SELECT *, {number} AS numeral, try_cast(written as decimal(25,6)) AS held
      FROM (SELECT *, {_trim(amount)} AS written, CASE WHEN cur = {_quoted(policy.target_currency)} THEN 1 ELSE coalesce(rate, 0) END AS each
      FROM ({rows}))))))"""


def _rate(text: str) -> str:
    held, wide = f"try_cast({text} as decimal(18,10))", f"try_cast({text} as decimal(38,18))"
    number = f"{text} rlike '^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$'"
    decimals = f"length(regexp_extract({text}, '[.]([0-9]*[1-9])0*$', 1))"
    return f"if({number} AND ({held} IS NULL OR {decimals} > 10 OR coalesce({held} <> {wide}, false)), {_LOST}, {held})"


def _known_rates(asked: str, name: str, policy: Policy) -> str:
    """SQL for (cur, day, rate): rates for the days asked for, by walking days and quotes of a currency in date order."""
    if policy.basis == LATEST:
        return f"{name} AS (SELECT cur, max_by(rate, struct(eff, place)) AS rate FROM quoted GROUP BY cur)"
    return f"""{name} AS (
      SELECT cur, day, rate FROM (
        SELECT cur, day, asks, last_value(rate) IGNORE NULLS OVER (
          PARTITION BY cur ORDER BY day, asks ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate
        FROM (SELECT DISTINCT cur, day, true AS asks, NULL AS rate FROM {asked}
              WHERE day IS NOT NULL AND cur <> {_quoted(policy.target_currency)}
              UNION ALL
              SELECT cur, eff, false, max_by(rate, place) FROM quoted GROUP BY cur, eff))
      WHERE asks)"""


def _with_rate(rows: str, rates: str, policy: Policy) -> str:
    """The join with them. Rows of the reporting currency get an empty key, so they meet nothing and stay spread."""
    same_day = "" if policy.basis == LATEST else f" AND {rates}.day = {rows}.day"
    return f"LEFT JOIN {rates} ON {rates}.cur = nullif({rows}.cur, {_quoted(policy.target_currency)}){same_day}"


#: Rates by currency and day that are looked up where the rows are read; more of them are joined by a shuffle.
KNOWN_RATES = 200_000
#: Estimated bytes from which keys that stand alone are told first.
LARGE = 32_000_000

# where the bits of a key's hash h are in a bitmap of 2**27 places
_PLACE = "h & 65535 AS bucket, shiftright(h, 16) & 31 AS word, shiftleft(1L, cast(shiftright(h, 21) & 63 AS int)) AS bit"
# rows stay in their partitions; what is done before and after does not become one generated method, too long to be compiled
_APART = "/*+ COALESCE(10000000) */"
_MARKED = "h & 65535 = bucket AND getbit(element_at(words, cast(shiftright(h, 16) & 31 AS int) + 1), cast(shiftright(h, 21) & 63 AS int)) = 1"


def _bitmap(hashes: str) -> str:
    """SQL for (bucket, words): a bit for every h, 20 MB at most. A key may have the bit of another one, and none lacks its own."""
    return f"""
      SELECT bucket, transform(sequence(0L, 31L), i -> coalesce(try_element_at(held, i), 0L)) AS words
      FROM (SELECT bucket, map_from_entries(collect_list(struct(word, bits))) AS held
            FROM (SELECT bucket, word, bit_or(bit) AS bits FROM (SELECT {_PLACE} FROM ({hashes})) GROUP BY bucket, word) GROUP BY bucket)"""


def _is_large(ledger: DataFrame) -> bool:
    return int(ledger._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > LARGE


def second_route(
    spark: SparkSession,
    ledger: DataFrame,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    request: Request,
    refunds: DataFrame | None = None,
    by: dict[str, str] | None = None,
) -> DataFrame:
    """result_b and status_b per report row. BLOCKED_DIGITS: an amount in scope, or its rate, has more digits than are kept; no result.

    Without a key column there are no copies, conflicts or refunds. `by` maps output names to SQL over `entity`
    (normalised) and `day`.
    """
    return _routes(spark, ledger, rates, mapping, policy, {"": request}, refunds, by or {}).drop("request")


def second_routes(
    spark: SparkSession,
    ledger: DataFrame,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    requests: dict[str, Request],
    refunds: DataFrame | None = None,
) -> DataFrame:
    """second_route of every named request, all in one run over the ledger; they are about the same metric."""
    return _routes(spark, ledger, rates, mapping, policy, requests, refunds, {})


def _routes(
    spark: SparkSession,
    ledger: DataFrame,
    rates: DataFrame,
    mapping: Mapping,
    policy: Policy,
    requests: dict[str, Request],
    refunds: DataFrame | None,
    by: dict[str, str],
) -> DataFrame:
    """Of a large ledger only rows whose key repeats are shuffled: a valid row that has its key for itself is no copy and in no conflict."""
    metrics = {r.metric for r in requests.values()}
    if len(metrics) > 1:
        raise RequestError("requests for several metrics")
    metric = metrics.pop()
    measured = metric or mapping.amount
    if metric and metric not in ledger.columns:
        raise RequestError(f"no column {metric!r} to add up")
    pattern = "d/M/yyyy" if policy.date_format == DD_MM else "M/d/yyyy"
    order = ", ".join(_name(c) for c in mapping.order) or "1"
    # what the requests ask is looked at behind the shuffles, so that routes of several requests over one ledger share them
    asked: dict[str, str] = {}
    keeps, dates, counts = [], [], []
    for request in requests.values():
        filters, within = ["true"], "true"
        if request.entities:
            wanted = ", ".join(f"lower({_trim(_quoted(e))})" for e in request.entities)
            filters.append(f"lower({_trim('e')}) IN ({wanted})")
        for column, value in request.filters:
            if column == mapping.entity:
                filters.append(f"lower({_trim('e')}) = lower({_trim(_quoted(value))})")
            elif column in ledger.columns:
                name = asked.setdefault(column, f"asked_{len(asked)}")
                filters.append(f"{name} = {_quoted(value)}")
        if request.start:
            within = f"coalesce(day BETWEEN DATE'{request.start}' AND DATE'{request.end}', false)"
        keeps.append(" AND ".join(filters))
        dates.append(within)
        counts.append(request.agg == "count")
    each = range(len(requests))
    read = f"{_currency('code', policy)} AS cur, lower({_trim('e')}) AS entity, " + ", ".join(f"{keep} AS keep_{i}" for i, keep in enumerate(keeps))
    day = f"try_to_date({_trim('d')}, '{pattern}') AS day"
    kept = ", ".join(f"{within} AND keep_{i} AS kept_{i}" for i, within in enumerate(dates))
    r = mapping.rates
    rate_order = ", ".join(_name(c) for c in r.order) or "1"
    currency = _text(mapping.currency) if mapping.currency else _quoted(policy.target_currency)
    names, cuts = "".join(f", {n}" for n in by), "".join(f", {e} AS {n}" for n, e in by.items())
    first_names = "".join(n + ", " for n in by)
    grouping = f"GROUP BY {', '.join(by)}" if by else ""
    raw = f"""
      SELECT {_text(mapping.key)} AS k, {_text(mapping.date)} AS d, {_text(mapping.entity)} AS e,
             {_text(measured)} AS a, upper({_trim(currency)}) AS code,
             struct({order}) AS place{''.join(f', {_text(c)} AS {n}' for c, n in asked.items())}
      FROM {{ledger}}"""
    quoted = f"""
      SELECT * FROM (
        SELECT upper({_trim(_text(r.currency))}) AS cur, {_rate(_trim(_text(r.rate)))} AS rate,
               coalesce(try_to_date({_trim(_text(r.effective))}, 'yyyy-M-d'),
                        try_to_date({_trim(_text(r.effective))}, '{pattern}')) AS eff,
               struct({rate_order}) AS place
        FROM {{rates}}) WHERE rate IS NOT NULL AND eff IS NOT NULL"""
    valid = f"SELECT * FROM raw WHERE {_trim('d')} <> '' AND {_trim('a')} <> ''"
    # a date text is read once per currency
    days = f"SELECT {_currency('code', policy)} AS cur, {day} FROM (SELECT DISTINCT code, d FROM valid)"
    large = bool(mapping.key) and _is_large(ledger)
    known, hint, inputs = _known_rates("days", "per_day", policy), "", {"ledger": ledger, "rates": rates}
    if large:
        # of a small ledger the rows may as well be shuffled
        found = spark.sql(f"WITH raw AS ({raw}), valid AS ({valid}), days AS ({days}), quoted AS ({quoted}), {known} SELECT * FROM per_day WHERE rate IS NOT NULL LIMIT {KNOWN_RATES + 1}", **inputs).toArrow()
        if found.num_rows <= KNOWN_RATES:
            known, hint = "per_day AS (SELECT * FROM {known})", "/*+ BROADCAST(per_day) */"
            inputs["known"] = spark.createDataFrame(found)

    def valued(rows: str) -> str:
        asks = "".join(f", o.keep_{i}" for i in each)
        return _valued(f"SELECT {hint} o.k, o.a, o.entity, o.day{asks}, o.cur, per_day.rate FROM {rows} AS o {_with_rate('o', 'per_day', policy)}", "a", policy, mapping)

    def parts(rows: str, sums: bool = True) -> str:
        """What the requests count or add up, and the rows whose digits do not fit; `sums`: over rows, or else over their cells."""
        if sums:
            return ", ".join(f"count_if(kept_{i}) AS n_{i}, sum(if(kept_{i}, value, 0)) AS c_{i}, count_if(kept_{i} AND value IS NULL) AS bad_{i}" for i in each)
        return ", ".join((f"sum({rows}n_{i}) AS part_{i}, 0 AS bad_{i}" if counts[i] else f"sum({rows}c_{i}) AS part_{i}, sum({rows}bad_{i}) AS bad_{i}") for i in each)

    # whether a key's rows carry different amounts is told from its cells, which are at most as many as the report has rows
    extremes = ", min(a) AS low, max(a) AS high" if mapping.key else ""
    cells = f"""
            SELECT k{names}, {parts('')}{extremes}
            FROM (SELECT *{cuts}, {kept} FROM priced) GROUP BY k{names}"""
    gathered = "SELECT * FROM valid"
    if large:
        gathered = f"SELECT /*+ BROADCAST(again) */ * EXCEPT (h) FROM hashed LEFT SEMI JOIN again ON {_MARKED}"
    once = f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, d, e, a ORDER BY place) AS copy FROM ({gathered}))
      WHERE copy = 1"""
    unclashing = ""
    if not mapping.key:
        once = "SELECT * FROM valid"
    elif by:
        cells = f"SELECT *, min(low) OVER (PARTITION BY k) AS lowest, max(high) OVER (PARTITION BY k) AS highest FROM ({cells})"
        unclashing = "WHERE lowest = highest"
    else:
        unclashing = "WHERE low = high"
    own = f"""
      SELECT {first_names}{parts('', False)}
      FROM ({cells}) AS pieces {unclashing} {grouping}"""
    apart = lone = ""
    if large:
        apart = f""",
    hashed AS (SELECT *, xxhash64(k) AS h FROM valid),
    again AS ({_bitmap("SELECT h FROM (SELECT /*+ REPARTITION(h) */ * FROM (SELECT xxhash64(k) & 1099511627775 AS h FROM valid)) GROUP BY h HAVING count(*) > 1")}),
    lone AS (SELECT {_APART} *, {read}, {day} FROM (SELECT {_APART} * FROM (SELECT /*+ BROADCAST(again) */ * FROM hashed LEFT ANTI JOIN again ON {_MARKED})))"""
        lone = f"""
      UNION ALL
      SELECT {first_names}{parts('', False)}
      FROM (SELECT {first_names}{parts('')} FROM (SELECT *{cuts}, {kept} FROM ({valued('lone')})) {grouping}) {grouping}"""
    less = owed = ""
    taking = [not c for c in counts]
    if refunds is not None and policy.refunds != EXCLUDE_REFUNDS and any(taking) and mapping.key and measured == mapping.amount:
        f = mapping.refunds
        refund_day = f"try_to_date({_trim(_text(f.date))}, '{pattern}')"
        of_refunded, marks = "valid", ""
        if large:
            marks = f""",
    back_marks AS ({_bitmap("SELECT xxhash64(k) AS h FROM back")})"""
            of_refunded = f"(SELECT /*+ BROADCAST(back_marks) */ * EXCEPT (h) FROM hashed LEFT SEMI JOIN back_marks ON {_MARKED})"
        # the ledger is cut down to refunded keys before it is parsed; the first row of a key is one struct, so that both
        # readers of `owed` ask for the same columns and share a shuffle
        asks = "".join(f", o.keep_{i}" for i in each)
        wanted = " OR ".join(f"o.keep_{i}" for i in each if taking[i])
        owed = f""",
    back AS (SELECT {_text(f.key)} AS k, {_text(f.amount)} AS amount_text, {refund_day} AS day FROM {{refunds}}){marks},
    owed AS (
      SELECT o.entity, o.cur, p.amount_text, p.day{asks}
      FROM back AS p
      JOIN (SELECT k, {read} FROM (SELECT k, head.* FROM (
            SELECT k, min_by(struct({', '.join(['e', 'code', *asked.values()])}), place) AS head
            FROM {of_refunded} LEFT SEMI JOIN back USING (k) GROUP BY k HAVING min(a) = max(a)))) AS o USING (k)
      WHERE {wanted}),
    {_known_rates("owed", "owed_rate", policy)}"""
        asks = "".join(f", w.keep_{i}" for i in each)
        refunded = f"SELECT w.entity, w.day, w.amount_text, w.cur{asks}, owed_rate.rate FROM owed AS w {_with_rate('w', 'owed_rate', policy)}"
        taken = ", ".join(f"-sum(if(kept_{i}, value, 0)) AS part_{i}, count_if(kept_{i} AND value IS NULL) AS bad_{i}" if taking[i] else f"0 AS part_{i}, 0 AS bad_{i}" for i in each)
        less = f"""
      UNION ALL
      SELECT {first_names}{taken}
      FROM (SELECT *{cuts}, {kept} FROM ({_valued(refunded, "amount_text", policy, mapping)}))
      WHERE {' OR '.join(f'kept_{i}' for i in each if taking[i])} {grouping}"""
    answers = ", ".join(
        f"""struct({_quoted(name)} AS request,
           cast(if(coalesce(sum(bad_{i}), 0) > 0, NULL, coalesce(sum(part_{i}), 0)) as decimal(38,2)) AS result_b,
           if(coalesce(sum(bad_{i}), 0) > 0, 'BLOCKED_DIGITS', 'VERIFIED') AS status_b)"""
        for i, name in enumerate(requests)
    )
    query = rf"""
    WITH raw AS ({raw}),
    valid AS ({valid}){apart},
    once AS (SELECT *, {read}, {day} FROM ({once})),
    days AS ({days}),
    quoted AS ({quoted}),
    {known},
    priced AS ({valued('once')}){owed},
    parts AS ({own}{lone}{less})
    SELECT {first_names}answer.* FROM (
      SELECT {first_names}explode(array({answers})) AS answer FROM parts {grouping})"""
    return spark.sql(query, **(inputs | ({"refunds": refunds} if less else {})))


def compare_routes(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Line by line agreement of both routes; a line that only one of them has does not agree."""
    a = first.select(*on, "result").alias("a")
    b = second.select(*on, "result_b").alias("b")
    if not on:
        both = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one", "full").drop("one")
    else:
        same = F.lit(True)
        for c in on:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        both = a.join(b, same, "full").select(
            *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in on], "result", "result_b"
        )
    return both.withColumn("agrees", F.col("result").eqNullSafe(F.col("result_b")) & F.col("result").isNotNull())
