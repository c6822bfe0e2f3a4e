"""Personal data in texts, and terms that give away the person behind it.

Four kinds are found by their form (e-mail and IP addresses, payment cards, phone numbers) and checked. Each valid match is a
protected entity. Which words reveal an entity is estimated from the corpus: a word is tied to an entity if it stands
near the entity (wholly within 60 characters of it) in five or more different contexts, and it discloses the entity if, given the word, the entity is likely (at
least `likely` of the word's documents hold the entity near it) and far likelier than without it (the pointwise
information is at least `bits`). Such words are spans of the kind `term`, wherever they stand.

A word is a run of two or more letters, marks and digits. Scripts that are written without blanks have no such runs: there
each one, two or three characters in a row are a word, and longer names are covered by their parts.

Contexts that are copies of each other (but for numbers) count once, so a document that was copied a thousand times ties no
words to its entities; a word's documents are all counted.

DataFrame functions only. Null counts as empty; texts without personal data have no spans; rows are told apart by a number
that is written with them once, so repeated rows and null doc_ids each get a result.
The expressions run in time proportional to the text: matches start only where a run of their characters starts, or
where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.staging import staged

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone", "term")

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter runs are no cards, and would cut the words around one
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": lambda b: b.contains("@"), "ip": lambda b: b.rlike(r"[0-9]\.[0-9]"), "card": lambda b: b.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda b: b.contains("+")}

#: Characters of scripts without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana and ideographs.
UNSPACED = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}"
_ONE = rf"[\p{{L}}\p{{M}}\p{{N}}&&[{UNSPACED}]]"
_LETTER = rf"[0-9A-Za-z[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]]"
WORD = rf"{_LETTER}{{2,}}+|{_ONE}"
#: Characters in a row that are a word where there are no blanks.
LONGEST = 3
CONTEXT_CHARS = 60
MIN_CONTEXTS = 5
LIKELY = 0.5
BITS = 3.0
BROADCAST_TERMS = 50_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    figures = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(figures, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a kind's pattern is personal data."""
    digits = _digits(match)
    low = F.forall(F.split(match, r"\."), lambda p: F.coalesce((F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)) <= "255"), F.lit(False)))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", low)
        .when(kind == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def _end(gap: Column) -> Column:
    """The last characters of a text, without the rest of a word that begins before them."""
    return F.when(F.length(gap) <= CONTEXT_CHARS, gap).otherwise(F.regexp_replace(F.right(gap, F.lit(CONTEXT_CHARS + 1)), rf"(?s)\A(?:{_LETTER}++|.)", ""))


def _begin(gap: Column) -> Column:
    """The first characters of a text, without the start of a word that goes on behind them."""
    return F.when(F.length(gap) <= CONTEXT_CHARS, gap).otherwise(F.regexp_replace(F.left(gap, F.lit(CONTEXT_CHARS + 1)), rf"(?s)(?:(?<!{_LETTER}){_LETTER}++|.)\z", ""))


def _words(text: Column) -> Column:
    """Distinct words of a text in lower case."""
    low = F.lower(text)
    rows = [F.regexp_extract_all(low, F.lit(rf"(?=({_ONE}{{{n}}}))"), F.lit(1)) for n in range(2, LONGEST + 1)]
    found = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    return F.array_distinct(F.when(low.rlike(f"{_ONE}{{2}}"), F.concat(found, *rows)).otherwise(found))


def _matches(body: Column, kind: str) -> Column:
    """Matches of a kind with their place, the length of the text since the last one, and what stands around them."""
    found = F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(body, PATTERNS[kind], -1)
    rows = F.transform(
        F.arrays_zip(found.alias("match"), gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["match"].alias("match"), F.length(x["gap"]).alias("skip"), F.concat_ws(" ", _end(x["gap"]), _begin(x["next"])).alias("near")),
    )
    return F.when(_HINTS[kind](body), F.filter(rows, lambda r: r["match"].isNotNull()))


_NONE = "array<struct<kind:string,i:int,match:string,skip:int,near:string>>"


def base_matches(docs: DataFrame) -> DataFrame:
    """docs: row, doc_id, body. One row per valid match: row, doc_id, kind, start, end, match, near; and one of kind '' per document."""
    every = F.concat(F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("i"), F.lit("").alias("match"), F.lit(0).alias("skip"), F.lit("").alias("near"))), *[F.coalesce(_matches(F.col("body"), k), F.array().cast(_NONE)) for k in PATTERNS])
    rows = docs.select("row", "doc_id", F.inline(every))
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("skip") + F.length("match")).over(so_far)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    return rows.filter((F.col("kind") == "") | valid(F.col("kind"), F.col("match"))).select("row", "doc_id", "kind", "start", "end", "match", "near")


def _joined(left: DataFrame, right: DataFrame, on: str, how: str, rows: int) -> DataFrame:
    """Join that broadcasts the right side if it was counted to be small."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_TERMS else right, on, how)


def disclosing_terms(docs: DataFrame, matches: DataFrame, min_contexts: int = MIN_CONTEXTS, likely: float = LIKELY, bits: float = BITS) -> DataFrame | None:
    """term, entity, contexts, together, documents, information of the terms that disclose an entity; None if no term is tied to any."""
    entity = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))).otherwise(F.lower("match"))
    terms = _words(F.col("near"))
    near = matches.filter("kind <> ''").select("row", F.concat_ws(":", "kind", entity).alias("entity"), terms.alias("terms"))
    near = near.withColumn("context", F.xxhash64(F.array_sort(F.filter("terms", lambda t: ~t.rlike(r"^\p{N}+$")))))
    pairs = near.select("row", "entity", "context", F.explode("terms").alias("term"))
    contexts = pairs.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
    together = pairs.groupBy("entity", "term", "row").agg(F.lit(1).alias("n")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    tied = staged(contexts.filter(F.col("contexts") >= min_contexts).join(together, ["entity", "term"]), "pii-tied")
    n_tied = tied.limit(BROADCAST_TERMS + 1).count()
    if not n_tied:
        return None
    words = docs.select(F.explode(_words(F.col("body"))).alias("term"))
    spread = _joined(words, tied.select("term").distinct(), "term", "left_semi", n_tied).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    held = near.groupBy("entity", "row").agg(F.lit(1).alias("n")).groupBy("entity").agg(F.count(F.lit(1)).alias("holders"))
    n_docs = docs.count()
    judged = tied.join(spread, "term").join(held, "entity")
    given = F.col("together") / F.col("documents")
    judged = judged.withColumn("information", F.log2(given * F.lit(float(n_docs)) / F.col("holders")))
    return judged.filter((given >= likely) & (F.col("information") >= bits)).drop("holders")


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Places of the given terms in all texts: row, doc_id, kind, start, end."""
    n_terms = terms.limit(BROADCAST_TERMS + 1).count()
    found = F.regexp_extract_all("body", F.lit(WORD), F.lit(0))
    words = docs.select("row", F.explode(_words(F.col("body"))).alias("term"))
    holders = staged(_joined(words, terms, "term", "left_semi", n_terms).select("row").distinct(), "pii-holders")
    n_holders = holders.limit(BROADCAST_TERMS + 1).count()
    gaps = F.transform(F.split("body", WORD, -1), lambda g: F.length(g))
    rows = _joined(docs, holders, "row", "left_semi", n_holders).select("row", "doc_id", F.posexplode(F.arrays_zip(found.alias("word"), gaps.alias("skip"))).alias("i", "x")).filter("x.word is not null")
    so_far = Window.partitionBy("row").orderBy("i")
    rows = rows.select("row", "doc_id", "i", F.col("x.word").alias("word"), F.sum(F.col("x.skip") + F.length("x.word")).over(so_far).alias("end"))
    rows = rows.withColumn("start", F.col("end") - F.length("word"))
    # where there are no blanks, a word also goes on over the characters behind it
    order = Window.partitionBy("row").orderBy("i")
    alone = lambda n: F.lead("word", n).over(order).rlike(rf"\A{_ONE}\z") & (F.lead("start", n).over(order) == F.col("end") + n - 1)
    longer, goes_on, word = [], F.col("word").rlike(rf"\A{_ONE}\z"), F.col("word")
    for n in range(1, LONGEST):
        goes_on, word = goes_on & alone(n), F.concat(word, F.lead("word", n).over(order))
        longer.append(F.when(goes_on, F.struct(word.alias("word"), (F.col("end") + n).alias("end"))))
    rows = rows.select("row", "doc_id", "start", F.array(F.struct("word", "end"), *longer).alias("words"))
    rows = rows.select("row", "doc_id", "start", F.inline(F.filter("words", lambda w: w.isNotNull()))).withColumn("term", F.lower("word"))
    hit = _joined(rows, terms, "term", "left_semi", n_terms)
    return hit.select("row", "doc_id", F.lit("term").alias("kind"), "start", "end")


def _body(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """One row per row of docs: row (its number), doc_id, spans (kind, start, end; code points, end exclusive).

    before: the furthest end of a span that starts sooner.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), _body(F.col(text)).alias("body"))
    return _spans(staged(rows, "pii-documents"), **bounds)


def _spans(rows: DataFrame, **bounds) -> DataFrame:
    """rows: row, doc_id, body, as written; another scan of the input may number the rows in another way."""
    matches = staged(base_matches(rows), "pii-matches")
    terms = disclosing_terms(rows, matches, **bounds)
    found = matches.select("row", "doc_id", "kind", "start", "end")
    if terms is not None:
        found = found.unionByName(_term_spans(rows, staged(terms.select("term").distinct(), "pii-terms")))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    sooner = Window.partitionBy("row").orderBy("start", "end", "place").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("place", order).withColumn("before", F.coalesce(F.max("end").over(sooner), F.lit(0).cast("bigint")))
    held = F.collect_list(F.when(F.col("kind") != "", F.struct("place", "start", "end", "kind", "before")))
    return found.groupBy("row", "doc_id").agg(F.array_sort(held).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and the spans as text."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    written = lambda xs: F.array_join(F.transform(xs, text), ",")
    base = F.filter("spans", lambda x: x["kind"] != "term")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    counts = [of(k).alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """docs with every span of its texts replaced by its kind in angle brackets; spans that overlap by the first one's."""
    rows = staged(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "pii-documents")
    bodies = rows.select("row", F.col("doc")[key].alias("doc_id"), _body(F.col("doc")[text]).alias("body"))
    found = _spans(bodies, **bounds).filter(F.size("spans") > 0).select("row", "spans")
    both = rows.join(found, "row", "left")
    # a text of four bytes per character, from which a piece is cut without walking over what stands before it
    wide = F.when(F.col("spans").isNotNull(), F.encode(F.col(f"doc.{text}").cast("string"), "UTF-32"))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["place"].alias("place"), x["kind"].alias("kind"), x["before"].alias("before"))))
    both = both.select("doc", wide.alias("wide"), ordered.alias("ordered"))
    cut = lambda a, b: F.decode(F.substring(F.col("wide"), (4 * a + 1).cast("int"), (4 * F.greatest(b - a, F.lit(0))).cast("int")), "UTF-32")
    mark = lambda x: F.concat(cut(x["before"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
    parts = F.transform("ordered", lambda x: F.when(x["start"] < x["before"], F.lit("")).otherwise(mark(x)))
    last = F.element_at("ordered", -1)
    rest = cut(F.greatest(last["before"], last["end"]), (F.length("wide") / 4).cast("bigint"))
    clean = F.when(F.col("wide").isNull(), F.col("doc")[text]).otherwise(F.concat(F.array_join(parts, ""), rest))
    both = both.select("doc", clean.alias("clean"))
    return both.select(*[F.col("clean").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
