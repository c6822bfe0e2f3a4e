"""Hard negatives of anchors by a secondary-sort shuffle of pair scores.

All vectors are packed into blocks, the anchors among them into groups, and every group meets every block in some task. A
task keeps of a block what can still be among the results of one of the group's anchors: in the first pass the best rows of
the anchor's own label, its positives; in the second pass, when the positives' scores are known, the best rows of other
labels within each positive's window. A kept pair is packed into one key (anchor, descending score, kind, id), keys are
dealt by anchor and sorted within partitions, and an iterator walks each sorted partition once: a positive opens its
window of scores, a negative goes to the open windows it lies in, and a window that has enough of them is closed. The
iterator holds the open windows of one anchor and never an anchor's rows, so an anchor (or a label, or a vector) with
very many pairs costs no memory.

Components become whole numbers, floor(scale * x), and scores are their exact inner products: by floating point where no
product can exceed 2**53, else by integers of any length (a score beyond a signed long is held at its end). Rows with a
null label, a null vector or a null or non-finite component take no part, vectors of different lengths do not meet, and
an empty vector scores 0 with others. Ties go to the smaller id, null ids come last, then the first row in the scan; repeated
ids are rows of their own, also as anchors, and another row of the anchor's id can be its positive. An empty table, or
one without anchors, gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.arrays import frames, unframe
from tallyproof.llm.staging import staged

BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
#: Anchors held by a task, and the blocks it compares with them before another task goes on.
GROUP_ANCHORS = 4096
UNIT_BLOCKS = 4
#: Scores looked at at once.
CELLS = 1 << 20

_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1


# Vectors as whole numbers


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where all are exact, else Python's integers."""
    if not len(values) or np.abs(values).max() < 2.0**44:
        return np.floor(values * scale)
    return np.array([int(x) * scale if abs(x) >= _EXACT else math.floor(x * scale) for x in values.tolist()], dtype=object)


def _pack_matrix(x: np.ndarray) -> bytes:
    """A matrix of whole numbers in the narrowest of three integer types, or as text where none holds them."""
    if x.dtype == object:
        return b"t" + " ".join(map(str, x.ravel())).encode()
    most = np.abs(x).max(initial=0)
    kind = b"h" if most < 1 << 15 else b"i" if most < 1 << 31 else b"q"
    return kind + x.astype({b"h": "<i2", b"i": "<i4", b"q": "<i8"}[kind]).tobytes()


def _open_matrix(data: bytes, n: int) -> np.ndarray:
    kind, body = data[:1], data[1:]
    if kind == b"t":
        flat = np.array([int(t) for t in body.split()], dtype=object)
    else:
        flat = np.frombuffer(body, {b"h": "<i2", b"i": "<i4", b"q": "<i8"}[kind]).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, within the range of a signed long."""
    if a.dtype != object and b.dtype != object:
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < _EXACT:
            return (a @ b.T).astype(np.int64)
    integers = [np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape) for x in (a, b)]
    products = integers[0] @ integers[1].T if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
    return np.clip(products, -_MOST, _MOST).astype(np.int64)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest negative score with low * score <= 100 * negative <= high * score; empty if the first is larger."""
    return -(-low * score // 100), high * score // 100


# Blocks


def _bodies(batch: pa.RecordBatch, scale: int, most_rows: int):
    """Packed pieces of a batch of (row, id, label, vector[, marks]), each of vectors of one length in ascending id order."""
    vectors = batch.column("vector")
    lengths = np.diff(vectors.offsets.to_numpy())
    ids = batch.column("id")
    null = ids.is_null().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    rows, labels = (batch.column(c).to_numpy().astype("<i8") for c in ("row", "label"))
    order = np.lexsort((rows, keys, null))
    pack = zstandard.ZstdCompressor(level=1)
    for width in np.unique(lengths).tolist():
        own = order[lengths[order] == width]
        step = max(1, min(most_rows, BLOCK_BYTES // (8 * max(width, 1))))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            flat = vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = _whole(flat, scale).reshape(len(part), width)
            marks = np.array([m or [] for m in batch.column("marks").take(pa.array(part)).to_pylist()], dtype=object) if "marks" in batch.schema.names else None
            wide = b""
            if marks is not None:
                most = max((len(m) for m in marks), default=0)
                wide = np.array([list(m) + [-1] * (most - len(m)) for m in marks], dtype="<i8").tobytes()
            yield pack.compress(frames(len(part).to_bytes(8, "little"), width.to_bytes(8, "little"), rows[part].tobytes(), null[part].tobytes(), keys[part].tobytes(), labels[part].tobytes(), _pack_matrix(x), wide))


class _Body:
    """Rows of a packed piece; marks are the scores of an anchor's positives."""

    def __init__(self, data: bytes):
        n, width, rows, null, ids, labels, matrix, marks = unframe(zstandard.ZstdDecompressor().decompress(data))
        self.n, self.width = int.from_bytes(n, "little"), int.from_bytes(width, "little")
        self.rows, self.ids, self.labels = (np.frombuffer(x, "<i8") for x in (rows, ids, labels))
        self.null = np.frombuffer(null, bool)
        self.x = _open_matrix(matrix, self.n).reshape(self.n, self.width)
        self.marks = np.frombuffer(marks, "<i8").reshape(self.n, -1)


def _row_blocks(scale: int):
    def run(batches):
        serial, held, size = 0, [], 0

        def pack():
            nonlocal serial
            for body in _bodies(pa.concat_batches(held), scale, BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + serial]), pa.array([body], pa.binary())], ["block", "body"])
                serial += 1

        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if held and size + len(part) > BLOCK_ROWS:
                    yield from pack()
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield from pack()

    return run


def _anchor_groups(scale: int):
    """Rows sorted by group: one packed piece per group (and vector length)."""

    def run(batches):
        group, held = None, []

        def pack():
            for body in _bodies(pa.concat_batches(held), scale, GROUP_ANCHORS * 4):
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([body], pa.binary())], ["g", "body"])

        for batch in batches:
            groups = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and groups[a] != group:
                    yield from pack()
                    held = []
                if b > a:
                    group = int(groups[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from pack()

    return run


# Keys

_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("null", "u1"), ("id", ">u8"), ("row", ">u8")])
_TURN = np.uint64(1 << 63)
POSITIVE, NEGATIVE = 0, 1
_PAIRS = "anchor bigint, anchor_id bigint, key binary"


def _up(x: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones in the same order."""
    return x.astype(np.int64).view(np.uint64) ^ _TURN


def pack_keys(anchor, score, kind, null, ids, rows) -> pa.Array:
    """Keys whose byte order is: anchor, highest score first, positives before negatives, null ids last, id, row."""
    out = np.zeros(len(anchor), dtype=_KEY)
    out["anchor"], out["score"], out["kind"], out["null"], out["id"], out["row"] = _up(anchor), ~_up(score), kind, null, _up(ids), _up(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def open_keys(keys: pa.Array) -> dict[str, np.ndarray]:
    data = np.frombuffer(b"".join(keys.to_pylist()), dtype=_KEY)
    down = lambda x: (x.astype(np.uint64) ^ _TURN).view(np.int64)
    return {"anchor": down(data["anchor"]), "score": down(~data["score"].astype(np.uint64)), "kind": data["kind"], "null": data["null"].astype(bool), "id": down(data["id"]), "row": down(data["row"])}


# Comparing


def _best_of_own_label(s: np.ndarray, anchors: _Body, at: slice, block: _Body, most: int, low: int, high: int):
    """Places (anchor, row) of the best rows of each anchor's label; rows lie in tie order."""
    fits = (anchors.labels[at, None] == block.labels) & (anchors.rows[at, None] != block.rows)
    who, where = np.nonzero(fits)
    order = np.lexsort((where, -s[who, where], who))
    who, where = who[order], where[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < most], where[rank < most]


def _best_in_windows(s: np.ndarray, anchors: _Body, at: slice, block: _Body, most: int, low: int, high: int):
    """Places (anchor, row) of the best rows of other labels within the window of each positive, each place once."""
    order = np.argsort(-s, axis=1, kind="stable")
    ranked = np.take_along_axis(s, order, axis=1)
    other = anchors.labels[at, None] != block.labels[order]
    before = np.cumsum(other, axis=1)  # rows of other labels up to here
    found = []
    for k in range(anchors.marks.shape[1]):
        least, largest = (np.array(x, dtype=np.int64)[:, None] for x in zip(*(window(p, low, high) for p in anchors.marks[at, k].tolist())))
        inside = other & (ranked >= least) & (ranked <= largest)
        skipped = np.where((ranked > largest) & other, 1, 0).sum(axis=1, keepdims=True)
        found.append(np.flatnonzero((inside & (before - skipped <= most)).ravel()))
    flat = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    who = flat // max(s.shape[1], 1)
    return who, order.ravel()[flat]


def _compare(best, kind: int, most: int, low: int, high: int):
    """Rows sorted by unit, anchors before blocks: the pairs worth keeping, as keys."""

    def run(batches):
        unit, groups = None, []
        for batch in batches:
            for g, s, block, body in zip(*(batch.column(c).to_pylist() for c in ("g", "s", "block", "body"))):
                if (g, s) != unit:
                    unit, groups = (g, s), []
                if block is None:
                    groups.append(_Body(body))
                    continue
                rows = _Body(body)
                for anchors in groups:
                    if anchors.width != rows.width:
                        continue
                    step = max(1, CELLS // rows.n)
                    for first in range(0, anchors.n, step):
                        at = slice(first, min(first + step, anchors.n))
                        found = scores(anchors.x[at], rows.x)
                        who, where = best(found, anchors, at, rows, most, low, high)
                        if len(who):
                            one = who + first
                            keys = pack_keys(anchors.rows[one], found[who, where], kind, rows.null[where], rows.ids[where], rows.rows[where])
                            yield pa.RecordBatch.from_arrays([pa.array(anchors.rows[one]), pa.array(anchors.ids[one], mask=anchors.null[one]), keys], ["anchor", "anchor_id", "key"])

    return run


def _meet(blocks: DataFrame, groups: DataFrame, n_groups: int, n_units: int, compare) -> DataFrame:
    """Every group of anchors with every block: groups are sent to each unit of blocks, blocks to each group."""
    unit = F.pmod(F.xxhash64("block"), F.lit(n_units))
    ones = groups.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_units - 1).cast("bigint"))).alias("s"), F.lit(None).cast("bigint").alias("block"), "body")
    others = blocks.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_groups - 1).cast("bigint"))).alias("g"), unit.alias("s"), "block", "body")
    dealt = ones.unionAll(others).repartition("g", "s").sortWithinPartitions("g", "s", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(compare, _PAIRS)


def _sorted(pairs: DataFrame) -> DataFrame:
    """The secondary sort: pairs dealt by anchor, in key order within each partition."""
    return pairs.repartition("anchor").sortWithinPartitions("key")


def _first(most: int):
    """The first `most` keys of every anchor."""

    def run(batches):
        anchor, seen = None, 0
        for batch in batches:
            keep = []
            for a in batch.column("anchor").to_pylist():
                seen = seen + 1 if a == anchor else 1
                anchor = a
                keep.append(seen <= most)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _emit(most: int, low: int, high: int):
    """Walks sorted keys: positives open windows, negatives go to the windows they lie in."""

    def run(batches):
        anchor, windows = None, []  # of one anchor: [least, largest, score, id, negatives so far]
        for batch in batches:
            key, out = open_keys(batch.column("key")), []
            ids = [None if null else i for i, null in zip(key["id"].tolist(), key["null"].tolist())]
            for a, a_id, score, kind, i in zip(key["anchor"].tolist(), batch.column("anchor_id").to_pylist(), key["score"].tolist(), key["kind"].tolist(), ids):
                if a != anchor:
                    anchor, windows = a, []
                if kind == POSITIVE:
                    windows.append([*window(score, low, high), score, i, 0])
                    continue
                for w in windows:
                    if w[0] <= score <= w[1] and w[4] < most:
                        w[4] += 1
                        out.append((a_id, w[3], w[4], i, w[2], score))
                windows = [w for w in windows if w[4] < most and score >= w[0]]  # scores only fall
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def _marks(batches):
    """Scores of the keys."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), pa.array(open_keys(batch.column("key"))["score"])], ["row", "score"])


def mine(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each anchor (rows where `anchors` holds) its best `positives` rows of the same label, and for each of those the
    best `negatives` rows of other labels whose score is `low` to `high` percent of the positive's.
    """
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    given = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.col(f"`{label}`").cast("bigint").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    rows = staged(given.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & fine), "scored-vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors")).first()
    n_groups = max(1, -(-sizes["anchors"] // GROUP_ANCHORS))
    n_units = max(1, -(-sizes["n"] // (BLOCK_ROWS * UNIT_BLOCKS)))

    blocks = staged(rows.select("row", "id", "label", "vector").mapInArrow(_row_blocks(scale), "block bigint, body binary"), "vector-blocks")
    chosen = rows.filter("is_anchor").select(F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("bigint").alias("g"), "row", "id", "label", "vector")

    def groups(of: DataFrame) -> DataFrame:
        return staged(of.repartition("g").sortWithinPartitions("g").mapInArrow(_anchor_groups(scale), "g bigint, body binary"), "anchor-groups")

    best = _meet(blocks, groups(chosen), n_groups, n_units, _compare(_best_of_own_label, POSITIVE, positives, low, high))
    opened = staged(_sorted(best).mapInArrow(_first(positives), _PAIRS), "positives")
    marks = opened.mapInArrow(_marks, "row bigint, score bigint").groupBy("row").agg(F.collect_list("score").alias("marks"))  # at most `positives` each
    marked = groups(chosen.join(marks, "row").select("g", "row", "id", "label", "vector", "marks"))
    near = _meet(blocks, marked, n_groups, n_units, _compare(_best_in_windows, NEGATIVE, negatives, low, high))
    return _sorted(opened.unionAll(near)).mapInArrow(_emit(negatives, low, high), _MINED)
