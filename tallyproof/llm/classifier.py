"""A quality classifier learnt from trusted positives and unlabelled text only.

A linear model is fitted by non-negative positive-unlabelled risk minimisation: with the class prior p, the risk of the
negatives is the unlabelled risk less p times the positives' risk as negatives, and is never let below zero. The class
prior is estimated first: a classifier of positives against unlabelled text is fitted on one half of the sample, and
on the other half the share of unlabelled text above a threshold is compared with that of the positives; the
smallest such ratio is the estimate.

The model is fitted in one task on a bounded sample (MAX_POSITIVE and MAX_UNLABELLED rows, those with the smallest hash
of their doc_id); scores cover every document and whole texts. A text's features are the frequencies of triples of
character kinds and a few counts of words. Labels of rows held out by crc32(doc_id) mod 3 = 1 are never
read, nor are labels, language, source or doc_id inputs of a score.

Null texts count as empty and get a score like any other; a null doc_id is never held out; repeated rows are scored row
by row; without any positives every score is 0.5; columns other than the key and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.arrays import hash_rows, offsets_of, pieces, raw
from tallyproof.llm.staging import small_batches

MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000
FOLDS, HELD_OUT = 3, 1
STEPS = 400
BLOCK_BYTES = 4 << 20

# kinds of bytes: lower case, capital, digit, blank, line end, sentence punctuation, other signs, part of a longer character
_KINDS = np.full(256, 6, dtype=np.int64)
_KINDS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 0
_KINDS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KINDS[[ord(c) for c in "0123456789"]] = 2
_KINDS[[ord(c) for c in " \t"]] = 3
_KINDS[[ord(c) for c in "\n\r\x0b\x0c"]] = 4
_KINDS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_KINDS[128:] = 7

N_COUNTS = 8
WIDTH = 512 + N_COUNTS


def features(column: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers per text."""
    ends, data = raw(column)
    n = len(ends) - 1
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if not n or not len(data):
        return out
    kinds = _KINDS[data]
    doc = np.repeat(np.arange(n), np.diff(ends))
    triples = kinds[:-2] * 64 + kinds[1:-1] * 8 + kinds[2:]
    inside = doc[:-2] == doc[2:]
    counts = np.bincount(doc[:-2][inside] * 512 + triples[inside], minlength=n * 512).reshape(n, 512)
    out[:, :512] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    solid = (kinds != 3) & (kinds != 4)
    first = solid & np.concatenate([[True], (~solid[:-1]) | (doc[1:] != doc[:-1])])
    starts = np.flatnonzero(first)
    word_doc = doc[starts]
    lengths = np.add.reduceat(solid.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    words = np.bincount(word_doc, minlength=n)
    some = np.maximum(words, 1)
    hashes = hash_rows(offsets_of(lengths), data[solid])
    order = np.lexsort((hashes, word_doc))
    h, d = hashes[order], word_doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    size = np.maximum(np.diff(ends), 1)
    per = lambda kind: np.bincount(doc[kinds == kind], minlength=n) / size
    out[:, 512:] = np.stack(
        [
            np.log1p(words) / 10,
            np.log1p(np.bincount(word_doc, weights=lengths, minlength=n) / some) / 3,
            np.bincount(d[new], minlength=n) / some,
            top / some,
            np.bincount(word_doc[again], minlength=n) / some,
            per(1),
            per(2),
            per(6),
        ],
        axis=1,
    )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(gradient, width: int, steps: int = STEPS, rate: float = 0.05) -> np.ndarray:
    """Adam from zero weights."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in the unlabelled rows, from scores of rows the scoring model was not fitted on.

    Above any threshold the unlabelled rows hold at least the positives' part, so the smallest ratio of the two shares
    estimates the prior. Thresholds leave at least half of the positives above, and the two halves' curves are averaged.
    """
    curves = []
    for mine, other in ((0, 1), (1, 0)):
        p, u = positive[mine::2], unlabelled[mine::2]

        def gradient(w, p=p, u=u):
            return p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + 1e-3 * w

        w = _descend(gradient, positive.shape[1])
        scored, rest = np.sort(positive[other::2] @ w), np.sort(unlabelled[other::2] @ w)
        cuts = np.quantile(scored, np.linspace(0.0, 0.5, 51))
        above = [1 - np.searchsorted(s, cuts) / len(s) for s in (scored, rest)]
        curves.append(above[1] / np.maximum(above[0], 1e-9))
    return float(np.clip(np.mean(curves, axis=0).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = 1e-4) -> np.ndarray:
    """Weights of the non-negative risk's minimum, logistic loss."""

    def gradient(w):
        sp, su = _sigmoid(positive @ w), _sigmoid(unlabelled @ w)
        as_negative = np.logaddexp(0, unlabelled @ w).mean() - prior * np.logaddexp(0, positive @ w).mean()
        of_negative = unlabelled.T @ su / len(su) - prior * (positive.T @ sp) / len(sp)
        if as_negative < 0:  # overfitted: step back on that part alone
            return -of_negative
        return prior * (positive.T @ (sp - 1)) / len(sp) + of_negative + decay * w

    return _descend(gradient, positive.shape[1])


class Model:
    """Standardised features times weights; packs into bytes."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.design(x) @ self.weights)

    def pack(self) -> bytes:
        return np.concatenate([self.mean, self.scale, self.weights, [self.prior]]).astype("<f8").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Model:
        x = np.frombuffer(data, "<f8")
        return Model(x[:WIDTH], x[WIDTH : 2 * WIDTH], x[2 * WIDTH : -1], float(x[-1]))


def _train(batches):
    rows = sorted((k, p, f) for b in batches for k, p, f in zip(b.column("doc_id").to_pylist(), b.column("positive").to_pylist(), b.column("x").to_pylist()))
    x = np.array([np.frombuffer(f, "<f4") for _, _, f in rows], dtype=np.float64).reshape(-1, WIDTH)
    positive = np.array([p for _, p, _ in rows], dtype=bool)
    if positive.sum() < 2 or (~positive).sum() < 2:
        return
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.01  # rare features are not blown up
    model = Model(mean, scale, np.zeros(WIDTH + 1), 0.5)
    design = model.design(x)
    model.prior = estimate_prior(design[positive], design[~positive])
    model.weights = fit(design[positive], design[~positive], model.prior)
    yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary())], ["model"])


def _featurize(batches):
    for batch in pieces(batches, "text", BLOCK_BYTES):
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "positive", "x"])


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """doc_id, positive and features x of at most max_positive + max_unlabelled rows, none of them held out.

    Rows that share a doc_id count as one, the one with the smallest features, so the bound holds whatever ids repeat.
    """
    turn = F.xxhash64(F.col("doc_id"), F.lit("turn"))
    known = labels.filter(~held_out() & (F.col("quality") == 1)).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    free = docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id")
    positives = known.orderBy(turn, "doc_id").limit(max_positive).withColumn("positive", F.lit(True))
    unlabelled = free.orderBy(turn, "doc_id").limit(max_unlabelled).distinct().withColumn("positive", F.lit(False))
    sample = positives.unionByName(unlabelled)
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "positive", "text")
    return rows.mapInArrow(_featurize, "doc_id bigint, positive boolean, x binary").groupBy("doc_id", "positive").agg(F.min("x").alias("x"))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Model fitted on trusted positives and unlabelled documents, none of them held out; None without positives."""
    fitted = training_rows(docs, labels, max_positive, max_unlabelled).repartition(1).mapInArrow(_train, "model binary").first()
    return Model.unpack(fitted["model"]) if fitted else None


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5) of every row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = train(rows, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model.pack() if model else None)

    def run(batches):
        fitted = Model.unpack(shared.value) if shared.value else None
        for batch in pieces(batches, "text", BLOCK_BYTES):
            x = features(batch.column("text"))
            scores = fitted.scores(x) if fitted else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
