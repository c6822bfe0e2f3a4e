"""Token ids in files of compressed byte or bit planes.

A chunk holds the ids of consecutive whole documents, in blocks of a fixed number of ids. Each block is transposed (byte b
of every id, or bit b of every id, next to each other) and each plane is compressed by itself, so that the planes
that are all zero, or nearly so, cost next to nothing. Documents lie in ascending doc_id order over the shards of
a store (ties by content, null first), and chunks in order within a shard. A store has three tables: `chunks` (one row
per chunk: documents, lengths, planes), `index` (one row per chunk without the planes, with its first id's position
in the whole store) and `shards` (one row per shard: position of its first id).

Texts: null counts as empty; every document has at least its end id. Repeated rows are kept, row by row. An empty input
gives an empty store. Only the two named columns are read.
"""

from __future__ import annotations

import json
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.llm.arrays import binary, offsets_of, pick, pieces
from tallyproof.llm.staging import small_batches

BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 16
SHARD_ROWS = 4096
MAX_SHARDS = 10_000
TASK_BYTES = 4 << 20
CACHED_PIECES = 400_000

_SPACES = r" \t\n\r\x0b\x0c"


def _byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in prints)}
    return [others.get(b, chr(b)) for b in range(256)]


BYTE_SIGNS = _byte_signs()
_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(tokenizer_json: str) -> WordEncoder:
    """One encoder per Python worker, whose pieces stay cached from task to task."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = WordEncoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]


class WordEncoder:
    """Encodes blocks of texts by a BPE tokenizer that lower-cases and drops white space, each distinct piece only once.

    The tokenizer splits at the borders used here, and its normalisation never reaches over them: letters with their marks,
    runs of other signs, and, where a digit, an apostrophe or a mark comes first, the rest of the word. Pieces of letters
    in normal form are one word to the merges and go straight to them; all others go through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens") or []]
        self.cut = regex.compile(rf"[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}\p{{N}}{_SPACES}']++(?=[{_SPACES}]|\Z|[\p{{L}}\p{{N}}])|[^{_SPACES}]+")
        self.whole = regex.compile(rf"[^{_SPACES}]+")
        self.cache: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            piece = piece.lower()
        coded = self.cache.get(piece)
        if coded is None:
            if len(self.cache) >= CACHED_PIECES:
                self.cache.clear()
            low = piece.lower()
            if low.isalpha() and piece.isalpha() and is_normalized("NFC", piece) and "\u03a3" not in piece:  # capital sigma depends on its place
                ids = [t.id for t in self.tokenizer.model.tokenize("".join(map(BYTE_SIGNS.__getitem__, low.encode())))]
            else:
                ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            coded = self.cache[piece] = np.array(ids, dtype="<u4").tobytes()
        return coded

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.piece(word)
        parts = (self.whole if any(s in word for s in self.special) else self.cut).findall(word)
        return b"".join([self.piece(p) for p in parts])

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts, each closed by the end id."""
        # blanks put at borders the tokenizer has anyway: fewer distinct words
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), r"(\p{L})([.,]) ", r"\1 \2 ")
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().dictionary_encode()
        coded = [self.word(w) for w in values.dictionary.to_pylist()]
        coded.append(np.array([end], dtype="<u4").tobytes())
        stream = np.insert(values.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts), len(coded) - 1)
        lengths, ids = pick(offsets_of([len(c) // 4 for c in coded]), np.frombuffer(b"".join(coded), dtype="<u4"), stream)
        return offsets_of(lengths)[offsets_of(counts + 1)], ids


def encode_words(docs: DataFrame, tokenizer_path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, packed: the ids of each text and the end id, packed as zstandard over 32-bit integers."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: of fixed size

    def run(batches):
        encoder, pack = _encoder(tokenizer.value), zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "text", TASK_BYTES):
            at, ids = encoder.texts(batch.column("text").cast(pa.string()).fill_null(""), end)
            packed = [pack.compress(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "packed"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, packed binary")


def to_planes(ids: np.ndarray, bits: bool) -> list[np.ndarray]:
    """Planes of a block of 32-bit ids, lowest first: 4 byte planes, or 32 bit planes of packed bits."""
    if not bits:
        return list(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T))
    return [np.packbits(((ids >> b) & 1).astype(np.uint8)) for b in range(32)]


def from_planes(planes: list[np.ndarray], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.ascontiguousarray(np.stack(planes).T).view("<u4").ravel()
    out = np.zeros(n, dtype=np.uint32)
    for b, plane in enumerate(planes):
        out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(b)
    return out


_CHUNKS = "shard int, chunk int, shard_start bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, plane_bytes array<int>, planes binary"


def _write_chunks(block_ids: int, chunk_ids: int, bits: bool):
    """Streams rows sorted by shard and doc_id into chunks; holds one chunk in memory."""

    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        shard, chunk, start, held, keys, lengths = None, 0, 0, [], [], []

        def close():
            ids = np.concatenate(held) if held else np.zeros(0, dtype=np.uint32)
            frames = [pack.compress(p.tobytes()) for i in range(0, len(ids), block_ids) for p in to_planes(ids[i : i + block_ids], bits)]
            row = {"shard": shard, "chunk": chunk, "shard_start": start, "n_ids": len(ids), "doc_ids": keys, "doc_lengths": lengths, "plane_bytes": [len(f) for f in frames], "planes": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary())])
        for batch in batches:
            for row_shard, key, n, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "packed"))):
                if keys and (row_shard != shard or sum(lengths) >= chunk_ids):
                    yield close()
                    chunk, start, held, keys, lengths = chunk + 1, start + sum(lengths), [], [], []
                if row_shard != shard:
                    shard, chunk, start = row_shard, 0, 0
                held.append(np.frombuffer(unpack.decompress(packed), dtype="<u4"))
                keys.append(key)
                lengths.append(n)
        if keys:
            yield close()

    return run


def _read_chunks(block_ids: int, bits: bool):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        per_block = 32 if bits else 4
        for batch in batches:
            for row in range(len(batch)):
                get = {c: batch.column(c)[row] for c in batch.schema.names}
                n, frames, data = get["n_ids"].as_py(), get["plane_bytes"].as_py(), get["planes"].as_py()
                ends = offsets_of(frames)
                planes = [np.frombuffer(unpack.decompress(data[a:b]), dtype=np.uint8) for a, b in zip(ends[:-1], ends[1:])]
                blocks = [from_planes(planes[i : i + per_block], min(block_ids, n - i // per_block * block_ids), bits) for i in range(0, len(planes), per_block)]
                ids = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.uint32)
                lengths = get["doc_lengths"].values.to_numpy().astype(np.int64)
                ends = offsets_of(lengths)
                first = get["shard_start"].as_py() + get["base"].as_py()
                yield pa.RecordBatch.from_arrays([get["doc_ids"].values, pa.array(first + ends[:-1]), pa.array(lengths), binary(ends * 4, ids)], ["doc_id", "start", "n_tokens", "ids"])

    return run


def write_store(encoded: DataFrame, keys: DataFrame, path: str, block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, bits: bool = False) -> None:
    """Write encode_words' rows as a store at path (any file system Spark writes to).

    keys has the doc_id of every row of encoded; it is read by itself so that the texts are encoded only once.
    Shards are ranges of doc_id with about SHARD_ROWS rows each, at most MAX_SHARDS; their borders are quantiles of
    doc_id, the only values of the corpus that reach the driver, and bounded in number.
    """
    spark = encoded.sparkSession
    size = keys.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n_shards = max(1, min(MAX_SHARDS, -(-size // SHARD_ROWS)))
    shares = [i / n_shards for i in range(1, n_shards)]
    borders = keys.agg(F.percentile_approx("doc_id", F.lit(shares) if shares else F.lit([0.5]), 100_000)).first()[0] or []
    borders = sorted(set(borders)) if shares else []
    cuts = spark.sparkContext.broadcast(np.array(borders, dtype=np.int64))

    def place(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            shard = np.searchsorted(cuts.value, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", *batch.schema.names])

    rows = encoded.mapInArrow(place, "shard int, doc_id bigint, n_tokens bigint, packed binary")
    ordered = rows.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "packed")
    ordered.mapInArrow(_write_chunks(block_ids, chunk_ids, bits), _CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    totals = {r["shard"]: r["n"] for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # at most MAX_SHARDS rows
    base = 0
    bases = []
    for shard in sorted(totals):
        bases.append((shard, base, block_ids, bits))
        base += totals[shard]
    shards = spark.createDataFrame(bases, "shard int, base bigint, block_ids int, bits boolean")
    shards.write.parquet(f"{path}/shards")
    index = chunks.join(F.broadcast(shards), "shard").select("shard", "chunk", (F.col("base") + F.col("shard_start")).alias("start"), "n_ids", F.size("doc_ids").alias("n_docs"), F.element_at("doc_ids", 1).alias("first_doc_id"), F.element_at("doc_ids", -1).alias("last_doc_id"))
    index.write.parquet(f"{path}/index")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (position of its first id in the store), n_tokens, ids (packed 32-bit integers)."""
    shards = spark.read.schema("shard int, base bigint, block_ids int, bits boolean").parquet(f"{path}/shards")
    form = shards.first()
    block_ids, bits = (form["block_ids"], form["bits"]) if form else (BLOCK_IDS, False)
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    rows = chunks.join(F.broadcast(shards.select("shard", "base")), "shard")  # at most MAX_SHARDS rows
    return rows.mapInArrow(_read_chunks(block_ids, bits), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
