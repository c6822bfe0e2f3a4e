"""Documents whose sets of five-word shingles are similar, by an n-gram join over vertical fragments.

All shingles stand in one global order, which is cut into a fixed number of fragments. For every candidate pair the
part of both sets within a fragment is compared by itself, in a task of its own, and the partial overlaps are summed per pair and
held against the exact bound in whole numbers. Of a candidate pair one document is the hub and the other a leaf; the hub's
part is sent once to each fragment and salt it has leaves in, a leaf's part to the fragments of its hub, and a
task holds one hub's part and streams the leaves past it. So a hub with very many leaves is spread over fragments and
salts, and no task gathers a group.

Candidates come from prefixes: a document's prefix is so long that two documents of similarity 0.75 must share as many
shingles of both prefixes as a sixteenth of the smaller set, and one more. To stay linear on groups of copies, this goes in rounds. Equal sets are one representative. In the first
round representatives that share small shingles are compared with one of them, the one whose shingles are shared
most widely (the text that the others were made from, if there is one), and those found similar take its label. The
second round is the complete prefix join, but leaves out pairs of the same label and pairs the first round compared. The
shingles that count are those so early in both sets that the overlap the pair needs can still follow. What is left is
verified, and one search for components ends it, so the components are exact.

The prefix order puts shingles that a sample of the documents suggests to be frequent last, so that passages of many documents
do not fill the prefixes. Any order gives the same result; the marks of frequent shingles are a bitmap of fixed size.

Shingles are 64-bit hashes of their words, 48 bits of them where two sets are compared. Null and empty texts have no
shingles and link with nothing; a text of one to four words has its whole sequence as its one shingle; a very long text is a
block by itself; rows with the same doc_id are documents of their own (a null doc_id too) and component_id is the smallest
doc_id of a component, null if it has none. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.arrays import hash_rows, mix64, offsets_of, pick
from tallyproof.llm.blocks import block_of, open_block, write_blocks
from tallyproof.llm.graph import components
from tallyproof.llm.staging import staged

WORDS = 5
PERCENT = 75
SKETCH = 12
#: Vertical fragments of the global order.
FRAGMENTS = 8
SAMPLED = 16
MARK_BITS = 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_TURNS = mix64(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and shingle hashes, distinct and ascending within each text."""
    n = len(ends) - 1
    data = _LOWER[data]
    solid = ~_SPACE[data]
    doc = np.repeat(np.arange(n), np.diff(ends))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    lengths = np.add.reduceat(solid.astype(np.int64), starts)
    words, owner = hash_rows(offsets_of(lengths), data[solid]), doc[starts]
    size = np.bincount(owner, minlength=n)
    sums = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        sums += words[k : k + len(sums)] * _TURNS[k]
    whole = owner[: len(sums)] == owner[WORDS - 1 :] if len(sums) else np.zeros(0, bool)
    hashes, holder = mix64(sums[whole]), owner[: len(sums)][whole]
    short = np.flatnonzero((size > 0) & (size < WORDS))
    if len(short):
        first = offsets_of(size)[short]
        extra = [mix64(np.array([sum(int(words[f + k]) * int(_TURNS[k]) for k in range(s)) + s * int(_TURNS[WORDS]) & (1 << 64) - 1], dtype=np.uint64))[0] for f, s in zip(first.tolist(), size[short].tolist())]
        hashes, holder = np.concatenate([hashes, np.array(extra, dtype=np.uint64)]), np.concatenate([holder, short])
    order = np.lexsort((hashes, holder))
    hashes, holder = hashes[order], holder[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (holder[1:] != holder[:-1])
    return offsets_of(np.bincount(holder[new], minlength=n)), hashes[new]


def _each(batches, choose=None):
    """Block by block: row ids, null flags, doc_ids, set offsets, set hashes, and the value of a third column, if there is one.

    choose: from the row ids and the third column's value, the places of the documents to look at.
    """
    for batch in batches:
        for i in range(len(batch)):
            rows, null, keys, ends, data = open_block(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            given = batch.column(2)[i].as_py() if batch.num_columns > 2 else None
            if choose is not None:
                few = choose(rows, given)
                lengths, data = pick(ends, data, few)
                rows, null, keys, ends = rows[few], null[few], keys[few], offsets_of(lengths)
            yield rows, null, keys, *shingle_sets(ends, data), given


def _describe(batches):
    for rows, null, keys, ends, hashes, _ in _each(batches):
        mixed = np.zeros((2, len(hashes) + 1), dtype=np.uint64)
        for k in range(2):
            np.cumsum(mix64(hashes + _TURNS[k]), out=mixed[k, 1:])
        sums = (mixed[:, ends[1:]] - mixed[:, ends[:-1]]).view(np.int64)
        low = np.minimum(np.diff(ends), SKETCH)
        place = np.arange(int(low.sum())) + np.repeat(ends[:-1] - offsets_of(low)[:-1], low)
        sketch = pa.ListArray.from_arrays(pa.array(offsets_of(low).astype(np.int32)), pa.array(hashes[place].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(keys, mask=null), pa.array(np.diff(ends)), pa.array(sums[0]), pa.array(sums[1]), sketch], ["row", "doc_id", "n", "s1", "s2", "sketch"])


#: A pair must share 1 + n // SHARE shingles of its prefixes (n: the smaller size).
SHARE = 16


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Length of the prefix of a set of n: a similar set's own prefix has 1 + n // SHARE shingles of it, or as its own size asks for.

    The k-th shingle that two similar sets share has all but k of their overlap behind it.
    """
    return np.where(n > 0, n - -(-PERCENT * n // 100) + 1 + n // SHARE, 0)


def _frequent(batches):
    """Shingles of a sample of the documents."""
    for _, _, _, _, hashes, _ in _each(batches, lambda rows, _: np.flatnonzero(mix64(rows.astype(np.uint64)) % np.uint64(SAMPLED) == 0)):
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["shingle"])


def _repeated(batches):
    """Of rows sorted by shingle, those whose shingle stands in a neighbouring row; holds one batch."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        s = batch.column("shingle").to_numpy()
        same = s[1:] == s[:-1]
        keep = np.zeros(len(s), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        # the last rows wait for what follows; a pair of them is enough to go on with
        tail = 1 if len(s) < 2 or not same[-1] else 2
        if keep[:-tail].any():
            yield batch.filter(pa.array(np.concatenate([keep[:-tail], np.zeros(tail, bool)])))
        held = batch.slice(len(s) - tail)
    if held is not None and len(held) == 2:
        yield held


def _marks(spark, blocks: DataFrame) -> bytes:
    """Bitmap over hashed shingles of those that occur in two or more documents of the sample: 2 ** MARK_BITS bits."""

    def pack(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, dtype=np.uint8)
        bits[group.column("bit").to_numpy()] = 1
        return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    sampled = blocks.mapInArrow(_frequent, "shingle bigint").repartition("shingle").sortWithinPartitions("shingle")
    place = F.shiftrightunsigned("shingle", 64 - MARK_BITS)
    spots = sampled.mapInArrow(_repeated, "shingle bigint").select(F.shiftright(place, 16).cast("int").alias("part"), (place.bitwiseAND(F.lit(0xFFFF))).cast("int").alias("bit")).distinct()
    parts = {r["part"]: r["bits"] for r in spots.groupBy("part").applyInArrow(pack, "part int, bits binary").collect()}  # 2 MB at most
    return b"".join(parts.get(i, bytes(1 << 13)) for i in range(1 << (MARK_BITS - 16)))


def _prefixes(shared):
    def run(batches):
        marks = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).astype(bool)
        for rows, _, _, ends, hashes, _ in _each(batches):
            n = np.diff(ends)
            doc = np.repeat(np.arange(len(n)), n)
            late = marks[(hashes >> np.uint64(64 - MARK_BITS)).astype(np.int64)]
            order = np.lexsort((hashes, late, doc))
            rank = np.arange(len(hashes)) - ends[:-1][doc]
            chosen = rank < prefix_length(n)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[order][chosen].view(np.int64)), pa.array(rows[doc[chosen]]), pa.array(rank[chosen].astype(np.int32))], ["shingle", "row", "place"])

    return run


SIX = 6  # bytes of a shingle's hash that are compared, the leading ones

_REQUEST = "hub bigint, salt int, leaf bigint, total bigint, weight bigint"
_SEGMENTS = "fragment int, hub bigint, salt int, leaf bigint, total bigint, weight bigint, segment binary"


def _segments(batches):
    """For each request of a block's documents, the document's shingles within each fragment, in global order."""
    bounds = np.array([-(-(k << 64) // FRAGMENTS) for k in range(1, FRAGMENTS)], dtype=np.uint64)
    schema = pa.schema([("fragment", pa.int32()), ("hub", pa.int64()), ("salt", pa.int32()), ("leaf", pa.int64()), ("total", pa.int64()), ("weight", pa.int64()), ("segment", pa.binary())])
    for rows, _, _, ends, hashes, wanted in _each(batches, lambda rows, wanted: np.unique(np.array([w["row"] for w in wanted], dtype=np.int64)) - rows[0]):
        place = {r: i for i, r in enumerate(rows.tolist())}
        lead = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SIX])
        parts = []
        for i in range(len(rows)):
            own = hashes[ends[i] : ends[i + 1]]
            cuts = [0, *np.searchsorted(own, bounds).tolist(), len(own)]
            parts.append([lead[ends[i] + a : ends[i] + b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])
        out: list[tuple] = []
        for w in wanted:
            out += [(k, w["hub"], w["salt"], w["leaf"], w["total"], w["weight"], part) for k, part in enumerate(parts[place[w["row"]]])]
        for at in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 4096]), schema)], schema=schema)


def _overlaps(batches):
    """Rows sorted by fragment, hub and salt, the hub's part first: each leaf's overlap with it within the fragment."""
    held: set[bytes] = set()
    split = lambda segment: [segment[i : i + SIX] for i in range(0, len(segment), SIX)]
    for batch in batches:
        found: list[tuple] = []
        for hub, leaf, total, weight, segment in zip(*(batch.column(c).to_pylist() for c in ("hub", "leaf", "total", "weight", "segment"))):
            if leaf is None:
                held = set(split(segment))
            elif overlap := sum(map(held.__contains__, split(segment))):
                found.append((hub, leaf, total, weight, overlap))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["hub", "leaf", "total", "weight", "overlap"])


def verify(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """hub, leaf, weight of the pairs (hub, leaf, total, weight) that are similar; total is the sum of both sizes."""
    salts = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FRAGMENTS)
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(salts)).cast("int"))
    nothing = F.lit(None).cast("bigint")
    asked = pairs.select(F.col("leaf").alias("row"), "hub", "salt", "leaf", "total", "weight")
    asked = asked.unionAll(pairs.select(F.col("hub").alias("row"), "hub", "salt", nothing, nothing, nothing).distinct())
    wanted = asked.groupBy(block_of(F.col("row")).alias("block")).agg(F.collect_list(F.struct("row", "hub", "salt", "leaf", "total", "weight")).alias("wanted"))
    segments = blocks.join(wanted, "block").mapInArrow(_segments, _SEGMENTS)
    dealt = segments.repartition("fragment", "hub", "salt").sortWithinPartitions("fragment", "hub", "salt", F.col("leaf").asc_nulls_first())
    partial = dealt.mapInArrow(_overlaps, "hub bigint, leaf bigint, total bigint, weight bigint, overlap bigint")
    counted = partial.groupBy("hub", "leaf", "total", "weight").agg(F.sum("overlap").alias("overlap"))
    return counted.filter(100 * F.col("overlap") >= PERCENT * (F.col("total") - F.col("overlap"))).select("hub", "leaf", "weight")


def _sizes_fit(one: str, two: str) -> Column:
    return 100 * F.least(one, two) >= PERCENT * F.greatest(one, two)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, and row, which tells rows of the same doc_id apart."""
    spark = docs.sparkSession
    blocks = write_blocks(docs, key, text)
    described = staged(blocks.mapInArrow(_describe, "row bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>"), "shingle-sets")
    filled = described.filter("n > 0")
    same = filled.groupBy("n", "s1", "s2").agg(F.min("row").alias("rep"))
    copies = staged(filled.join(same, ["n", "s1", "s2"]).select("row", "doc_id", "rep", "n", F.when(F.col("row") == F.col("rep"), F.col("sketch")).alias("sketch")), "copies")
    reps = copies.filter("row = rep").select("row", "n", "sketch")

    # first round: stars around the document with the most widely shared small shingles
    spread = reps.select("row", "n", F.explode("sketch").alias("shingle"))
    common = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    spread = staged(spread.join(common, "shingle"), "shared-sketches")
    fame = spread.groupBy("row", "n").agg(F.sum("df").alias("fame"), F.count(F.lit(1)).alias("met"))
    famous = fame.filter(2 * F.col("met") >= F.least(F.col("n"), F.lit(SKETCH))).select("row", "fame")
    spread = staged(spread.join(famous, "row").select("row", "n", "shingle", "fame"), "famous-sketches")
    centre = spread.groupBy("shingle").agg(F.max(F.struct("fame", (-F.col("row")).alias("turn"), "n")).alias("top"))
    stars = spread.join(centre, "shingle").select((-F.col("top.turn")).alias("hub"), F.col("row").alias("leaf"), F.col("n").alias("l_n"), F.col("top.n").alias("r_n"), F.col("top.fame").alias("weight"))
    first = stars.filter((F.col("hub") != F.col("leaf")) & _sizes_fit("l_n", "r_n")).select("hub", "leaf", (F.col("l_n") + F.col("r_n")).alias("total"), "weight").distinct()
    first = staged(first, "first-pairs")
    links = staged(verify(first, blocks), "first-links")
    # the most famous similar hub is a document's label, or that hub's own one
    label = links.groupBy(F.col("leaf").alias("row")).agg((-F.max(F.struct("weight", (-F.col("hub")).alias("turn")))["turn"]).alias("root"))
    label = staged(label, "labels")
    above = label.select(F.col("row").alias("root"), F.col("root").alias("next"))
    label = label.join(above, "root", "left").select("row", F.coalesce("next", "root").alias("root"))

    # second round: all pairs that share a prefix shingle and do not have the same label yet
    marks = spark.sparkContext.broadcast(_marks(spark, blocks))
    prefix = "shingle bigint, row bigint, place int"
    shingles = blocks.mapInArrow(_prefixes(marks), prefix).repartition("shingle").sortWithinPartitions("shingle")
    labelled = reps.select("row", "n").join(label, "row", "left").select("row", "n", F.coalesce("root", "row").alias("root"))
    members = staged(shingles.mapInArrow(_repeated, prefix).join(labelled, "row"), "prefix-members")
    open_shingles = members.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    open_members = staged(members.join(open_shingles, "shingle"), "open-members")
    l, r = (open_members.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in ("row", "n", "place", "root")]) for s in "lr")
    # the k-th shingle two similar sets share leaves enough of either set behind it for the overlap they must have
    total = F.col("l_n") + F.col("r_n")
    need = F.ceil(F.lit(PERCENT) * total / F.lit(float(100 + PERCENT)) - F.lit(1e-9))
    asked = 1 + F.floor(F.least("l_n", "r_n") / SHARE)
    early = (F.col("l_place") <= F.col("l_n") - need + asked - 1) & (F.col("r_place") <= F.col("r_n") - need + asked - 1)
    near = (F.col("l_row") < F.col("r_row")) & (F.col("l_root") != F.col("r_root")) & _sizes_fit("l_n", "r_n") & early
    met = l.join(r, "shingle").filter(near).groupBy(F.col("l_row").alias("hub"), F.col("r_row").alias("leaf"), total.alias("total"), asked.alias("asked"))
    second = met.agg(F.count(F.lit(1)).alias("met")).filter("met >= asked").select("hub", "leaf", "total", F.lit(0).cast("bigint").alias("weight"))
    compared = first.select(F.least("hub", "leaf").alias("hub"), F.greatest("hub", "leaf").alias("leaf"))
    second = second.join(compared, ["hub", "leaf"], "left_anti")
    more = staged(verify(second, blocks), "second-links")

    found = components(links.unionAll(more).select(F.col("hub").alias("a"), F.col("leaf").alias("b")))
    placed = copies.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("row", "doc_id", "n", F.coalesce("root", "rep").alias("root"))
    placed = staged(placed.unionByName(described.filter("n = 0").select("row", "doc_id", "n", F.col("row").alias("root"))), "placed")
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row")
