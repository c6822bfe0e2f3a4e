"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A word is a piece of text that begins with the space before it; the pattern that splits text never matches across
the start of one, so a text's tokens are the tokens of its words (known of the usual pattern only: with any other one a
word is a match). Documents are written once in blocks of a few megabytes. Tasks cut them into words and send every
distinct word of a block to the task that owns it. There each distinct word is encoded once, however many
blocks hold it; its ids go back to the blocks, where documents are put together by position. A block sends a word once, so
common words are aggregated before the shuffle, and the texts themselves are never shuffled.

Texts: null counts as empty, empty texts have no ids, a very long text is a block by itself. An empty table gives no rows.
Repeated rows and repeated doc_ids are encoded row by row. Only the two named columns are read; other columns may have
any name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.arrays import binary, frames, hash_rows, offsets_of, pack_ints, pick, pieces, raw, unframe, unpack_ints
from tallyproof.llm.blocks import open_block, write_blocks
from tallyproof.llm.staging import small_batches

DECODE_BYTES = 2 << 20
#: Words are dealt over owners by hash, an owner keeping its distinct words in memory: at least so many owners, and more for more blocks.
OWNERS = 64
BLOCKS_PER_OWNER = 4096

# Fixed value: the pattern known not to match across the start of a word.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The white space of the splitting pattern (Unicode White_Space), written out because Python's \s has more.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ENCODED = "doc_id bigint, n_tokens bigint, ids binary"


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    table = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        table[int(rank)] = base64.b64decode(token)
    return table


def splitter(pattern: str):
    """The splitting pattern with its white space spelt out, for the `regex` module."""
    import regex

    inside = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return regex.compile(inside.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


def _words(texts: pa.Array, pattern: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the word numbers of all texts in order, and how many each text has."""
    split = splitter(pattern)
    # a space before other white space, or at the end, does not begin a word: such texts are split by the pattern itself
    odd = pc.match_substring_regex(texts, f" [{_SPACE_RE2}]| $").to_numpy(zero_copy_only=False) | (pattern != _USUAL)
    plain = texts.filter(pa.array(~odd))
    lists = pc.split_pattern(plain, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().dictionary_encode()
    numbers = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.binary_join_element_wise(pa.scalar(" ", values.dictionary.type), values.dictionary, pa.scalar("", values.dictionary.type)).to_pylist()
    extra: dict[str, int] = {}

    def number(word: str) -> int:
        return extra.setdefault(word, len(words) + len(extra))

    if len(plain):
        starts = offsets_of(counts)[:-1]  # the first word of a text has no space before it
        heads = values.dictionary.take(pa.array(numbers[starts])).to_pylist()
        numbers[starts] = [number(w) for w in heads]
    lengths = np.zeros(len(texts), dtype=np.int64)
    lengths[~odd] = counts
    if odd.any():
        found = [np.array([number(w) for w in split.findall(t)], dtype=np.int64) for t in texts.filter(pa.array(odd)).to_pylist()]
        lengths[odd] = [len(x) for x in found]
        flat = np.concatenate([numbers, *found])
        at = np.zeros(len(texts), dtype=np.int64)
        at[~odd] = offsets_of(counts)[:-1]
        at[odd] = len(numbers) + offsets_of([len(x) for x in found])[:-1]
        shift = np.repeat(at - (np.cumsum(lengths) - lengths), lengths)
        numbers = flat[np.arange(int(lengths.sum())) + shift]
    return words + list(extra), numbers, lengths


_CODED = "owner int, block bigint, payload binary"


def _texts(body: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Null flags, doc_ids and texts of a block."""
    _, null, keys, ends, data = open_block(0, body)
    return null, keys, binary(ends, data).cast(pa.string())


def _owned(texts: pa.Array, pattern: str, owners: int):
    """Distinct words sorted by owner and word (their ends and bytes), where each owner's begin, word numbers, words per text.

    Depends on the texts alone, so the words sent away and the documents put together later are numbered alike.
    """
    words, numbers, lengths = _words(texts, pattern)
    table = pa.array(words, pa.string())
    offsets, flat = raw(table)
    owner = (hash_rows(offsets, flat) % np.uint64(owners)).astype(np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[pc.sort_indices(table).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank, owner))
    counts, flat = pick(offsets, flat, order)
    turn = np.empty(len(words), dtype=np.int64)
    turn[order] = np.arange(len(words))
    return offsets_of(counts), flat, np.searchsorted(owner[order], np.arange(owners + 1)), turn[numbers], lengths


def _send_words(pattern: str, owners: int):
    """For each owner a row with the sorted distinct words of a block that it encodes."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                ends, flat, at, _, _ = _owned(_texts(body)[2], pattern, owners)
                some = np.flatnonzero(np.diff(at)).tolist()
                rows = [pack.compress(frames(np.diff(ends[at[o] : at[o + 1] + 1]).astype("<u4").tobytes(), flat[ends[at[o]] : ends[at[o + 1]]].tobytes())) for o in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(rows, pa.binary())], ["owner", "block", "payload"])

    return run


def _encode_words(table, pattern: str):
    """Replaces each row's words by their ids. Rows come sorted by owner: every distinct word of an owner is encoded once."""

    def run(batches):
        import tiktoken

        split, unpack = splitter(pattern), zstandard.ZstdDecompressor()
        ranks = {token: i for i, token in enumerate(table.value) if token}
        merges = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        owner, known = None, {}
        for batch in batches:
            out = []
            for o, payload in zip(batch.column("owner").to_pylist(), batch.column("payload")):
                if o != owner:
                    owner, known = o, {}
                counts, flat = unframe(unpack.decompress(payload.as_py()))
                ends = offsets_of(np.frombuffer(counts, "<u4")).tolist()
                words = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
                for word in words:
                    if word not in known:
                        known[word] = [i for token in split.findall(word.decode()) for i in merges.encode_ordinary(token)]
                coded = [known[word] for word in words]
                ids = np.fromiter(itertools.chain.from_iterable(coded), dtype=np.uint32)
                out.append(frames(pack_ints(np.array([len(c) for c in coded])), pack_ints(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["owner", "block", "payload"])

    return run


def _assemble(pattern: str, owners: int):
    """Documents of blocks: word numbers are replaced by the words' ids, which the owners have sent."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                null, keys, texts = _texts(batch.column("body")[i].as_py())
                _, _, at, stream, words = _owned(texts, pattern, owners)
                coded = sorted(batch.column("coded")[i].as_py() or [], key=lambda c: c["owner"])
                parts = [[unpack_ints(x) for x in unframe(c["payload"])] for c in coded]
                lengths, flat = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.uint32)]) for k in (0, 1))
                if len(lengths) != at[-1]:
                    raise RuntimeError("a block did not get the ids of all its words back")
                per_word, ids = pick(offsets_of(lengths), flat, stream)
                ends = offsets_of(per_word)[offsets_of(words)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(np.diff(ends), pa.int64()), binary(ends * 4, ids)], ["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, packed).

    ranks_path is read on the driver and broadcast; a vocabulary is of fixed size, whatever the corpus.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(read_ranks(ranks_path))
    blocks = write_blocks(docs, key, text)
    owners = max(OWNERS, blocks.select("block").count() // BLOCKS_PER_OWNER)
    owned = blocks.mapInArrow(_send_words(pattern, owners), _CODED).repartition("owner").sortWithinPartitions("owner")
    coded = owned.mapInArrow(_encode_words(table, pattern), _CODED)
    told = coded.groupBy("block").agg(F.collect_list(F.struct("owner", "payload")).alias("coded"))  # one per owner, a block's words in all
    return blocks.join(told, "block", "left").select("body", "coded").mapInArrow(_assemble(pattern, owners), ENCODED)


class Vocabulary:
    """Token bytes laid out for joining ids with them in bulk."""

    def __init__(self, table: list[bytes]):
        self.offsets = offsets_of([len(t) for t in table])
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    def decode(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and bytes of the decoded texts of a column of packed ids."""
        at, data = raw(ids)
        lengths, flat = pick(self.offsets, self.flat, np.ascontiguousarray(data).view(np.uint32).astype(np.int64))
        return offsets_of(lengths)[at // 4], flat


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `data`, the bytes the ids stand for: a map-side join with the token-byte table (one row per id of the vocabulary)."""
    small_batches(encoded.sparkSession)
    table = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        vocabulary = Vocabulary(table.value)
        for batch in pieces(batches, "ids", DECODE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, binary(*vocabulary.decode(batch.column("ids")))], [*batch.schema.names, "data"])

    columns = [F.col(c) for c in encoded.columns if c != "data"]
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "data")
    return encoded.select(*columns).mapInArrow(run, f"{schema}, data binary")


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes).

    Decodes as `decode` does, but without handing ids and bytes back to the JVM in between.
    """
    small_batches(encoded.sparkSession)
    table = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        vocabulary = Vocabulary(table.value)
        decimals = Vocabulary([b"%d " % i for i in range(len(table.value))])
        for batch in pieces(batches, "ids", DECODE_BYTES):
            sums = []
            for words, cut in ((decimals, 1), (vocabulary, 0)):
                ends, flat = words.decode(batch.column("ids"))
                view = memoryview(flat)
                sums.append(pa.array([hashlib.sha256(view[a : max(a, b - cut)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *sums], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
