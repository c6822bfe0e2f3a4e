"""Quality rules whose cutoffs are chosen under a proven bound on the good documents they reject.

Each rule rejects documents whose feature lies above a cutoff. Cutoffs come from fixed grids and are judged on labelled
holdout documents, per stratum (language): a cutoff is safe if the exact binomial test shows that the rule rejects at
most `risk / number of rules` of the good documents, at a level corrected for the number of rules and strata. Within a
rule the cutoffs are tested from the loosest down and testing stops at the first that is not safe, so the grid needs
no further correction; the rules' shares add up, so all rules together reject at most `risk` of a stratum's good documents with
confidence `1 - error`. Of the safe cutoffs the one is used that rejects the most bad documents, net of `good_cost` for
each good one (ties: the loosest); a rule without a safe, useful cutoff does not apply in that stratum.

DataFrame functions only. Null or empty texts have no words and fail the base rule; a null stratum is a stratum of its
own; repeated rows are judged row by row; a doc_id with several labels counts once per label; without labels no cutoff
is safe and only the base rule rejects. Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.staging import staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SMALL_SET = 32

#: Feature and grid of each rule, loosest cutoff first. A document is rejected above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.6, 0.45, 0.35, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02),
    "capital_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15),
    "bang_share": (1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
}

#: So many cutoffs are broadcast; beyond that, with very many strata, the join shuffles.
BROADCAST_CUTOFFS = 10_000


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of docs in a struct `row`, and the measured columns beside it.

    n_repeat_words: positions are found from sorted window hashes. With few distinct repeated windows a scan of the windows marks
    them; with many, a sort of (hash, position) does. Both count the same, in n log n time for a text of n words.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), body.alias("body"))
    d = d.select("row", "body", F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "").alias("words"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("body", F.lit("[A-Z]")).alias("n_capitals"),
        F.regexp_count("body", F.lit("!")).alias("n_bangs"),
        lines.alias("lines"),
        F.slice(
            F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))),
            1,
            F.greatest(F.size("words") - 2, F.lit(0)),
        ).alias("windows"),
    )
    d = d.select(
        *[c for c in d.columns if c != "lines"],
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array("windows").alias("sorted"),
    )
    rest = F.greatest(F.size("sorted") - 1, F.lit(0))
    same = F.zip_with(F.slice("sorted", 1, rest), F.slice("sorted", 2, rest), lambda a, b: F.when(a == b, a))
    d = d.select(*[c for c in d.columns if c != "sorted"], F.array_distinct(F.array_compact(same)).alias("twice"))
    few = F.filter(F.transform("windows", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda p: p.isNotNull())
    pairs = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    d = d.select(
        *[c for c in d.columns],
        F.when(F.size("twice") > SMALL_SET, pairs).alias("pairs"),
    )
    next_to = F.size("pairs") - 1
    many = F.zip_with(F.slice("pairs", 1, next_to), F.slice("pairs", 2, next_to), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    marked = (
        F.when(F.size("twice") == 0, F.array().cast("array<int>"))
        .when(F.size("twice") <= SMALL_SET, few)
        .otherwise(F.sort_array(F.array_distinct(F.flatten(F.array_compact(many)))))
    )
    d = d.select(*[c for c in d.columns if c not in ("windows", "twice", "pairs")], marked.alias("marked"))
    gaps = F.zip_with("marked", F.slice("marked", 2, F.greatest(F.size("marked"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    d = d.select(*[c for c in d.columns if c != "marked"], F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_repeat_words"))
    return d.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        _share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        _share(F.col("n_capitals"), F.col("word_chars")).alias("capital_share"),
        _share(F.col("n_bangs"), F.col("n_words")).alias("bang_share"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
    )


def binomial_cdf(hits: Column, trials: Column, p: float) -> Column:
    """P(X <= hits) for X ~ Binomial(trials, p), exactly, summed from the logarithms of the terms; 1 where hits reach the mean."""
    from math import log

    odds = log(p) - log(1 - p)
    first = trials * F.lit(log(1 - p))
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((trials - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    terms = F.when(hits < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), hits))
    return F.when(hits >= trials * p, F.lit(1.0)).otherwise(F.aggregate(terms, start, step, lambda a: a["total"]))


def cutoffs(judged: DataFrame, risk: float, error: float, good_cost: float, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """One row per stratum and rule with a safe, useful cutoff: stratum, rule, cutoff, good, good_rejected, bad_rejected.

    judged: stratum, good (boolean) and the features of labelled documents that pass the base rule. All labels are
    counted, in one pass.
    """
    grid = [(r, i, c) for r, cuts in rules.items() for i, c in enumerate(cuts)]
    counts = [F.count_if("good").alias("n_good")]
    for r, i, c in grid:
        counts.append(F.count_if(F.col("good") & (F.col(r) > c)).alias(f"g_{r}_{i}"))
        counts.append(F.count_if(~F.col("good") & (F.col(r) > c)).alias(f"b_{r}_{i}"))
    by_stratum = staged(judged.groupBy("stratum").agg(*counts), "quality-counts")  # one row per stratum
    level = error / (len(rules) * max(1, by_stratum.count()))
    tests = [
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"g_{r}_{i}").alias("good_rejected"), F.col(f"b_{r}_{i}").alias("bad_rejected"))
        for r, i, c in grid
    ]
    rows = by_stratum.select("stratum", F.col("n_good").alias("good"), F.inline(F.array(*tests)))
    one_rule = Window.partitionBy("stratum", "rule")
    safe = binomial_cdf(F.col("good_rejected"), F.col("good"), risk / len(rules)) <= level
    rows = rows.withColumn("safe", F.min(safe).over(one_rule.orderBy("step")))
    rows = rows.withColumn("gain", F.col("bad_rejected") - good_cost * F.col("good_rejected")).filter("safe and gain > 0")
    rows = rows.withColumn("place", F.row_number().over(one_rule.orderBy(F.desc("gain"), "step"))).filter("place = 1")
    return rows.select("stratum", "rule", "cutoff", "good", "good_rejected", "bad_rejected")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    risk: float = 0.05,
    error: float = 0.05,
    good_cost: float = 10.0,
) -> DataFrame:
    """Every row of docs as a struct `row` of the kept columns, with its features, base_failed and kept.

    labels: doc_id and quality (1 good, 0 bad; other values are ignored). The features are written once and read for both
    the choice of cutoffs and the verdicts.
    """
    measured = features(docs, [*dict.fromkeys([key, stratum, *keep])], text)
    measured = staged(measured.withColumn("stratum", F.coalesce(F.col("row")[stratum].cast("string"), F.lit("\u0000"))), "quality-features")
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.when(F.col("quality").isin(0, 1), F.col("quality") == 1).alias("good")).filter(F.col("good").isNotNull())
    passed = measured.filter(~F.col("base_failed")).select(F.col("row")[key].cast("bigint").alias("label_id"), "stratum", *RULES)
    chosen = staged(cutoffs(passed.join(known, "label_id"), risk, error, good_cost), "quality-cutoffs")
    per_stratum = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    per_stratum = per_stratum.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    if chosen.limit(BROADCAST_CUTOFFS + 1).count() <= BROADCAST_CUTOFFS:
        per_stratum = F.broadcast(per_stratum)
    over = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0]
    for rule in over[1:]:
        rejected = rejected | rule
    judged = measured.join(per_stratum, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
    return judged.drop("stratum", *[f"cut_{r}" for r in RULES])
