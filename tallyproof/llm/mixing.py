"""Mixing a corpus to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Each cell's tokens are raked until the token shares of sources,
languages and topics all meet their targets; the ratio of raked to actual tokens of a cell, its weight, says how often its
documents are wanted. A document gets as many copies as the whole part of the weight says, and one more with the fraction as
probability, so that the tokens of all copies have the target shares, and the size of the corpus, in expectation. A rare cell that
is wanted often is repeated; it does not thin the others.

Only cells, not documents, go through the iteration; they are a table in the shared folder, never on the driver. Text null
counts as no tokens; null source or language is a value of its own. A document without tokens is drawn like
its cell; an empty input gives an empty result; repeated rows are drawn alike, since the draw depends on doc_id,
text and the seed only. Values without a target share what the targets leave or, where they leave nothing, keep the share they
have of the corpus; only a target of 0 removes a value. A target for a value the corpus lacks is spread over the others in proportion.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.staging import staged

SWEEPS = 4
MAX_ROUNDS = 8
TOLERANCE = 1e-6
#: A weight that raking left a hair below a whole number is that number.
WEIGHT_DECIMALS = 9
#: Targets that leave no more than this are taken to sum to 1.
ROUNDING = 1e-9

#: Production parameters: explicit language shares, large sources and topics flattened. The language shares sum to 1, so they
#: hold among these four; other languages, and null, keep their own share of the corpus.
TARGETS = {"lang": {"en": 0.58, "de": 0.16, "fr": 0.15, "es": 0.11}}
POWERS = {"source": 0.8, "topic": 0.9}
DIMENSIONS = ("source", "lang", "topic")
BROADCAST_CELLS = 10_000


def topic(text: Column) -> Column:
    """A coarse topic by what a text holds: license notices, contact data, markup or code, else prose."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\blicen[cs]e|all rights reserved|\bcopyright\b"), "legal")
        .when(text.contains("@") | text.rlike(r"\+[0-9]"), "contact")
        .when(text.rlike(r"[{}=]|</?[a-z]"), "markup")
        .otherwise("prose")
    )


def marginal(cells: DataFrame, dimension: str, targets: Mapping[str, float] | None, power: float = 1.0) -> DataFrame:
    """Target share of each value of a dimension, over the values the corpus has; they sum to 1.

    Values without a target share what the targets leave, in proportion to tokens ** power (power 0.5 flattens). Targets that
    leave nothing hold among their own values, and the others keep their part of all tokens ** power.
    """
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")
    given = F.lit(None).cast("double")
    for value, share in (targets or {}).items():
        given = F.when(F.col(dimension) == value, F.lit(float(share))).otherwise(given)
    left = max(0.0, 1.0 - sum((targets or {}).values()))
    rows = sums.select(dimension, given.alias("given"), F.pow("tokens", F.lit(power)).alias("size"))
    free, fixed, size = rows.agg(F.sum(F.when(F.col("given").isNull(), F.col("size"))), F.sum("given"), F.sum("size")).first()
    if free and left <= ROUNDING:  # as much more than the targets as makes free / size of the whole; all of it where no target counts
        left = (fixed or 1.0) * free / (size - free) if size > free else 1.0
    whole = (fixed or 0.0) + (left if free else 0.0)
    raw = F.coalesce("given", F.lit(left / free if free else 0.0) * F.col("size"))
    return rows.select(dimension, (raw / F.lit(whole or 1.0)).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (dimensions and tokens) with `raked`, tokens scaled until every marginal meets its target share, and `miss`, the
    largest difference between a marginal and its target that is left.

    After every few sweeps the cells are written out and the largest miss of a marginal is looked at; where targets
    contradict the cells (a value with a target that only occurs with values whose target is 0), max_rounds ends the search.
    """
    dims = list(targets)
    for d in dims:
        cells = cells.join(targets[d].withColumnRenamed("share", f"share_{d}"), d, "left").fillna(0.0, [f"share_{d}"])
    cells = staged(cells, "mix-cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    cells = cells.withColumn("raked", F.col("tokens") / F.lit(float(total or 1.0)))
    for _ in range(max_rounds):
        for _ in range(sweeps):
            for d in dims:
                have = F.sum("raked").over(Window.partitionBy(d))
                cells = cells.withColumn("raked", F.when(have > 0, F.col("raked") * F.col(f"share_{d}") / have).otherwise(0.0))
        cells = staged(cells, "mix-cells")
        misses = [cells.groupBy(d).agg(F.abs(F.sum("raked") - F.first(f"share_{d}")).alias("miss")).agg(F.max("miss").alias("miss")) for d in dims]
        worst = misses[0]
        for other in misses[1:]:
            worst = worst.unionAll(other)
        miss = worst.agg(F.max("miss")).first()[0]
        if miss is None or miss <= tolerance:
            break
    return cells.drop(*[f"share_{d}" for d in dims]).withColumn("miss", F.lit(miss).cast("double"))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    powers: Mapping[str, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topic_of=topic,
    least: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """All columns of docs in a struct `row`, with source, lang, topic, n_tokens, weight, probability, miss, copies and kept.

    targets: for each of source, lang and topic the wanted token shares, by value. copies: how often the document is drawn,
    weight in expectation; probability: of being drawn at all, and kept: whether it is. least: no document has
    a smaller weight; above 0 it gives up exactness of the shares for more tokens. miss: what raking left, see rake.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("source"),
        F.coalesce(F.col(lang).cast("string"), F.lit("\x00")).alias("lang"),
        topic_of(body).alias("topic"),
        F.size(F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")).cast("bigint").alias("n_tokens"),
        (F.xxhash64(F.col(key), body, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("draw"),
    )
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mix-counts")
    wanted = {d: staged(marginal(cells, d, targets.get(d), (powers or {}).get(d, 1.0)), f"mix-{d}") for d in DIMENSIONS}
    raked = rake(cells, wanted)
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    raked = staged(raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") * F.lit(total) / F.col("tokens")).otherwise(1.0)), "mix-raked")
    raked = raked.withColumn("weight", F.greatest(F.lit(least), F.round("weight", WEIGHT_DECIMALS))).withColumn("probability", F.least(F.lit(1.0), "weight"))
    raked = staged(raked.select(*DIMENSIONS, "weight", "probability", "miss"), "mix-weights")
    if raked.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        raked = F.broadcast(raked)
    whole = F.floor("weight")
    copies = (whole + (F.col("draw") < F.col("weight") - whole).cast("int")).cast("bigint")
    return rows.join(raked, list(DIMENSIONS), "left").withColumn("copies", copies).withColumn("kept", F.col("copies") > 0).drop("draw")
