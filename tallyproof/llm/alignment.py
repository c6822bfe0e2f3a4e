"""Alignment of two tokenizers over a corpus by diagonal run skipping.

Both tokenizers cut the same bytes; the ends of their tokens are two ascending arrays. While tokens pair up one to one, the
arrays are equal at a fixed shift of their indexes, so `align` compares stretches of them at the current shift, each
twice as long as the one before, and jumps what is equal. Where that ends, an irregular group (several tokens of one side or
both, up to the next common end) is walked token by token, and its surplus becomes the new shift.

A block is a few megabytes of documents: its words are encoded (each distinct word once per worker, as long as it is
remembered), its ends aligned, and ids and groups written once, with the distinct id pairs that the block links. Pairs
are counted over the corpus by their B id's owner, after each task has added up its own blocks; owners know each pair's
count and each B id's highest and answer every block with one row, so a pair that all blocks hold costs an owner no more
than a rare one per block, and slices of blocks spread an owner's answers over tasks. What an owner holds is bounded by the two
vocabularies, not by the corpus.

Words are cut before a blank that follows something else and has no white space after it, and between a Latin letter and a
point, comma or the like. Those are borders for both tokenizers if A splits text by the byte-level pattern and no piece
of B has a blank behind another character, or such a sign behind a letter; this is looked up in their files, and where it does
not hold, texts are encoded whole.

Null and empty texts, and texts that the tokens of either side do not spell (byte by byte, behind one blank), have no tokens:
zeros, and '' for their groups. Repeated rows and doc_ids are documents of their own. A very long text is a block
by itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.arrays import frames, offsets_of, pack_ints, pick, pieces, raw, unframe, unpack_ints
from tallyproof.llm.bpe import _SPACE, _SPACE_RE2, Vocabulary
from tallyproof.llm.planes import BYTE_SIGNS
from tallyproof.llm.staging import folder, small_batches, staged

BLOCK_BYTES = 2 << 20
CACHED_WORDS = 300_000
OWNERS = 64
#: Blocks that one slice of an owner answers.
SLICE_BLOCKS = 4096


# Diagonal run skipping


def align(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """The irregular groups as (first token of A, of B, token of A behind it, of B); all other tokens pair up one to one.

    The arguments are ascending ends of non-empty tokens over the same bytes, so the last ones are equal.
    """
    n, m = len(ends_a), len(ends_b)
    found = []
    i = shift = 0
    while i < n:
        step = 1
        # longer and longer stretches of the diagonal, then shorter ones up to its end
        while (stop := i + step) <= n and ends_a[i:stop] == ends_b[i + shift : stop + shift]:
            i, step = stop, step * 2
        while step > 1:
            step >>= 1
            if (stop := i + step) <= n and ends_a[i:stop] == ends_b[i + shift : stop + shift]:
                i = stop
        if i == n:
            break
        first, j = i, i + shift
        a, b = ends_a[i], ends_b[j]
        while a != b:  # up to the next common end
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        i += 1
        found.append((first, first + shift, i, j + 1))
        shift = j + 1 - i
    return found


def group_sizes(irregular: list[tuple[int, int, int, int]], n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in every group, irregular ones and pairs."""
    first_a, first_b, stop_a, stop_b = np.array(irregular, dtype=np.int64).reshape(-1, 4).T
    size_a, size_b = stop_a - first_a, stop_b - first_b
    place = first_a - offsets_of(size_a - 1)[:-1]  # groups before each irregular one
    sizes = []
    for n, size in ((n_a, size_a), (n_b, size_b)):
        out = np.ones(n - int((size - 1).sum()), dtype=np.int64)
        out[place] = size
        sizes.append(out)
    return sizes[0], sizes[1]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token pairs whose bytes overlap (numbers in A and in B): one per piece between two ends of either side."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    if len(ends):
        ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


# Encoding


# Letters that every table of letters has, and signs that end a word behind them.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGN = ".,;:!?"
_TAIL = "\x01"  # put before a cut that is no blank; texts with one of their own are not cut there
_LATIN = "\u0250"  # letters below are letters to every library


def _cutter():
    return re.compile(rf"(?<=[^ ])(?= [^{_SPACE}])")


class Pair:
    """Both tokenizers, their tokens' bytes, and the words they have met."""

    def __init__(self, byte_json: str, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.bytes_a, self.bytes_b = tokens_of_a(byte_json), tokens_of_b(self.b)
        form = json.loads(byte_json)
        split = form.get("pre_tokenizer") or {}
        self.by_words = form.get("normalizer") is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex", True)) and not split.get("add_prefix_space")
        border = re.compile(rf"[^ ] |[{_LETTER}][{_SIGN}]")
        self.by_words &= not any(border.search(piece.decode("utf-8", "replace")) for piece in self.bytes_b)
        self.cut = _cutter()
        self.spell_a, self.spell_b = Vocabulary(self.bytes_a), Vocabulary(self.bytes_b)
        self.known: dict[str, tuple] = {}

    def meet(self, words: list[str]) -> list[tuple]:
        """(ids of A, ids of B, whether both spell the word) of every word; a word begins with a blank or is cut from a letter."""
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            plain = [self.by_words and w[0] == " " and w[1:].isalpha() and max(w) < _LATIN for w in new]
            # a word cut from a letter is encoded behind one, whose own token goes
            rest = self.a.encode_batch([w if w[0] == " " else " a" + w for w, p in zip(new, plain) if not p], add_special_tokens=False)
            others = iter(rest)
            ids_a = [self._letters(w) if p else next(others).ids[w[0] != " " :] for w, p in zip(new, plain)]
            ids_b = self.b.encode([w[1:] if w[0] == " " else "a" + w for w in new], num_threads=1)
            ids_b = [ids if w[0] == " " else ids[1:] for w, ids in zip(new, ids_b)]
            ends, data = raw(pa.array(new, pa.string()))
            right = np.ones(len(new), dtype=bool)
            for ids, table in ((ids_a, self.spell_a), (ids_b, self.spell_b)):
                at, flat = _ragged(ids)
                lengths, spelt = pick(table.offsets, table.flat, flat)
                own = offsets_of(lengths)[at]
                same = np.diff(own) == np.diff(ends)
                if same.all():
                    wrong = np.flatnonzero(spelt != data)
                    same[np.searchsorted(ends, wrong, side="right") - 1] = False
                else:
                    same &= [spelt[own[k] : own[k + 1]].tobytes() == data[ends[k] : ends[k + 1]].tobytes() for k in range(len(new))]
                right &= same
            self.known.update(zip(new, zip(ids_a, ids_b, right.tolist())))
        return [self.known[w] for w in words]

    def _letters(self, word: str) -> list[int]:
        """Ids of letters behind a blank: one word to the pattern, so they go straight to the merges."""
        signs = BYTE_SIGNS[32] + word[1:] if word.isascii() else "".join(map(BYTE_SIGNS.__getitem__, word.encode()))
        return [t.id for t in self.a.model.tokenize(signs)]

    def words(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of some non-empty texts (each behind a blank), the word numbers in order, and how many each text has."""
        found: dict[str, int] = {}
        if not self.by_words:
            lists = [[" " + t] for t in texts.to_pylist()]
            odd = np.ones(len(texts), dtype=bool)
        else:
            # blanks next to white space, or at the ends, may not be borders: such texts are cut by the whole rule
            odd = pc.match_substring_regex(texts, f" [{_SPACE_RE2}]| $|^[{_SPACE_RE2}]|{_TAIL}").to_numpy(zero_copy_only=False)
            lists = [self.cut.split(" " + t) for t in texts.filter(pa.array(odd)).to_pylist()]
        plain = pc.split_pattern(pc.replace_substring_regex(texts.filter(pa.array(~odd)), f"([{_LETTER}])([{_SIGN}])", f"\\1 {_TAIL}\\2"), " ")
        counts = pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        values = plain.flatten().dictionary_encode()
        held = [w[1:] if w[:1] == _TAIL else " " + w for w in values.dictionary.to_pylist()]
        numbers = [values.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        if lists:
            found.update(zip(held, range(len(held))))
            numbers += [np.array([found.setdefault(w, len(found)) for w in words], dtype=np.int64) for words in lists]
            held = list(found)
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[~odd], lengths[odd] = counts, [len(w) for w in lists]
        at = np.zeros(len(texts), dtype=np.int64)
        at[~odd] = offsets_of(counts)[:-1]
        at[odd] = int(counts.sum()) + offsets_of([len(w) for w in lists])[:-1]
        flat = np.concatenate(numbers)
        shift = np.repeat(at - (np.cumsum(lengths) - lengths), lengths)
        return held, flat[np.arange(len(flat)) + shift], lengths


def tokens_of_a(byte_json: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary; added tokens stand for their text."""
    form = json.loads(byte_json)
    byte = {sign: b for b, sign in enumerate(BYTE_SIGNS)}
    table: dict[int, bytes] = {i: bytes(byte[c] for c in entry) for entry, i in form["model"]["vocab"].items()}
    table.update({t["id"]: t["content"].encode() for t in form.get("added_tokens") or []})
    return [table.get(i, b"") for i in range(max(table) + 1)]


def tokens_of_b(model) -> list[bytes]:
    """Bytes of every id of a piece vocabulary: U+2581 is a blank, <0xHH> a byte; marks that stand for no text have none."""
    return [
        bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]


_PAIR: dict[str, Pair] = {}


def _pair(byte_json: str, piece_model: bytes) -> Pair:
    """One per Python worker, whose words stay known from task to task."""
    name = hashlib.sha1(byte_json.encode() + piece_model).hexdigest()
    if name not in _PAIR:
        _PAIR.clear()
        _PAIR[name] = Pair(byte_json, piece_model)
    return _PAIR[name]


# Blocks

_ALIGNED = "block bigint, docs binary, a binary, b binary, groups binary, pairs binary"


def _keys(ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """Id pairs as numbers that sort by owner (of the B id), B id, A id; ids are below 2**28."""
    ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
    return (ids_b % OWNERS) << 56 | ids_b << 28 | ids_a


def _open_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys & ((1 << 28) - 1), (keys >> 28) & ((1 << 28) - 1)


def _pack_keys(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending keys and columns beside them, compressed."""
    steps = np.diff(keys, prepend=0)
    return frames(pack_ints(steps & 0xFFFFFFFF), pack_ints(steps >> 32), *(pack_ints(c) for c in more))


def _unpack_keys(data: bytes) -> list[np.ndarray]:
    low, high, *more = (unpack_ints(p) for p in unframe(data))
    return [np.cumsum(low.astype(np.int64) | high.astype(np.int64) << 32), *more]


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return offsets_of([len(x) for x in lists]), np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64)


def _encode_block(pair: Pair, texts: pa.Array):
    """Tokens per document, ids and ends of both sides over the whole block; documents that are not spelt have none."""
    filled = np.array(pc.greater(pc.binary_length(texts), 0).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
    words, numbers, lengths = pair.words(texts.filter(pa.array(filled)))
    coded = pair.meet(words)
    spelt = np.array([c[2] for c in coded], dtype=bool)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    good = np.bincount(doc[~spelt[numbers]], minlength=len(lengths)) == 0 if len(words) else np.zeros(0, bool)
    ends = offsets_of(lengths)
    for d in np.flatnonzero(~good):  # a word by itself is not spelt: then the whole text decides
        own = [coded[k] for k in numbers[ends[d] : ends[d + 1]].tolist()]
        data = "".join(words[k] for k in numbers[ends[d] : ends[d + 1]].tolist()).encode()
        good[d] = all(b"".join(table[i] for c in own for i in c[side]) == data for side, table in ((0, pair.bytes_a), (1, pair.bytes_b)))
    kept = numbers[good[doc]]
    lengths = np.where(good, lengths, 0)
    sides = []
    for side, table in ((0, pair.bytes_a), (1, pair.bytes_b)):
        at, flat = _ragged([c[side] for c in coded])
        per_word, ids = pick(at, flat, kept)
        tokens = np.zeros(len(texts), dtype=np.int64)
        tokens[filled] = np.diff(offsets_of(per_word)[offsets_of(lengths)])
        sides.append((tokens, ids, np.cumsum(np.array([len(t) for t in table], dtype=np.int64)[ids])))
    return sides


def _align_blocks(files):
    def run(batches):
        pair = _pair(*files.value)
        serial = itertools.count()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text", BLOCK_BYTES):
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            (n_a, a, ends_a), (n_b, b, ends_b) = _encode_block(pair, batch.column("text").cast(pa.string()))
            sizes_a, sizes_b = group_sizes(align(ends_a.tolist(), ends_b.tolist()), len(a), len(b))
            one, two = overlaps(ends_a, ends_b)
            keys, counts = np.unique(_keys(a[one], b[two]), return_counts=True)
            docs = frames(null.tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), n_a.astype("<i8").tobytes(), n_b.astype("<i8").tobytes())
            row = [(TaskContext.get().partitionId() << 32) + next(serial), pack.compress(docs), pack_ints(a), pack_ints(b), frames(pack_ints(sizes_a), pack_ints(sizes_b)), _pack_keys(keys, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([x], pa.binary()) for x in row[1:])], ["block", "docs", "a", "b", "groups", "pairs"])

    return run


class Opened:
    """A block's documents (null flags, doc_ids, tokens of each side), ids of both sides and group sizes."""

    def __init__(self, docs: bytes, a: bytes, b: bytes, groups: bytes):
        null, ids, n_a, n_b = unframe(zstandard.ZstdDecompressor().decompress(docs))
        self.doc_ids = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(null, bool))
        self.n_a, self.n_b = np.frombuffer(n_a, "<i8"), np.frombuffer(n_b, "<i8")
        self.a, self.b = unpack_ints(a).astype(np.int64), unpack_ints(b).astype(np.int64)
        self.sizes_a, self.sizes_b = (unpack_ints(x).astype(np.int64) for x in unframe(groups))
        # a document ends where a group does
        self.groups = np.searchsorted(np.cumsum(self.sizes_a), offsets_of(self.n_a)[1:], side="right")
        self.n_groups = np.diff(self.groups, prepend=0)


def align_corpus(docs: DataFrame, byte_json: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Both tokenizers' ids of all documents and their groups, one row per block, written once and bucketed by block.

    byte_json and piece_model are paths on the driver; vocabularies are of fixed size, whatever the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(byte_json, encoding="utf-8") as one, open(piece_model, "rb") as two:
        files = spark.sparkContext.broadcast((one.read(), two.read()))
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    name = f"llm_aligned_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(_align_blocks(files), _ALIGNED).write.bucketBy(buckets, "block").option("path", folder(spark, "aligned")).option("compression", "none").saveAsTable(name)
    aligned = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external one: its files stay, and aligned is resolved already
    return aligned


def groups(aligned: DataFrame) -> DataFrame:
    """doc_id, a and b (ids), a_sizes and b_sizes (tokens of each group), one row per document."""

    def run(batches):
        for batch in batches:
            for row in batch.select(["docs", "a", "b", "groups"]).to_pylist():
                block = Opened(**row)
                lists = [(block.n_a, block.a), (block.n_b, block.b), (block.n_groups, block.sizes_a), (block.n_groups, block.sizes_b)]
                columns = [pa.ListArray.from_arrays(pa.array(offsets_of(n).astype(np.int32)), pa.array(flat.astype(np.int32))) for n, flat in lists]
                yield pa.RecordBatch.from_arrays([block.doc_ids, *columns], ["doc_id", "a", "b", "a_sizes", "b_sizes"])

    return aligned.select("docs", "a", "b", "groups").mapInArrow(run, "doc_id bigint, a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>")


# Counts of id pairs

_COUNTED = 1 << 21


def _count(batches):
    """Pairs of a task's blocks added up, sent on when there are very many."""
    held: list[list[np.ndarray]] = []
    size = 0

    def add_up():
        keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([h[1] for h in held]), minlength=len(keys)).astype(np.int64)
        return keys, counts

    def send(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    for batch in batches:
        for data in batch.column("pairs").to_pylist():
            held.append(_unpack_keys(data))
            size += len(held[-1][0])
            if size > _COUNTED:
                held = [[*add_up()]]
                size = len(held[0][0])
                if size > _COUNTED // 2:
                    yield send(*held[0])
                    held, size = [], 0
    if held:
        yield send(*add_up())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a number, see `open_pairs`), n: links of the corpus that hold the pair."""
    return aligned.select("pairs").mapInArrow(_count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def open_pairs(counted: DataFrame) -> DataFrame:
    """a, b (ids), n of counted pairs."""
    mask = F.lit((1 << 28) - 1).cast("bigint")
    return counted.select(F.col("pair").bitwiseAND(mask).alias("a"), F.shiftright("pair", 28).bitwiseAND(mask).alias("b"), "n")


def _owner_table(group: pa.Table) -> pa.Table:
    """All pairs of an owner in one row, with counts and whether they are their B id's highest."""
    order = np.argsort(group.column("pair").to_numpy())
    keys, n = group.column("pair").to_numpy()[order], group.column("n").to_numpy()[order]
    _, first = np.unique(keys >> 28, return_index=True)  # one run per B id
    best = np.repeat(np.maximum.reduceat(n, first), np.diff([*first, len(keys)]))
    body = frames(_pack_keys(keys), n.astype("<i8").tobytes(), (n == best).tobytes())
    return pa.table({"owner": group.column("owner").slice(0, 1), "body": pa.array([zstandard.ZstdCompressor(level=1).compress(body)], pa.binary())})


def _ask(batches):
    """A block's pairs, one row per owner."""
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist()):
            keys = _unpack_keys(data)[0]
            cuts = np.searchsorted(keys, np.arange(OWNERS + 1) << 56)
            some = np.flatnonzero(np.diff(cuts)).tolist()
            bodies = [_pack_keys(keys[cuts[o] : cuts[o + 1]]) for o in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array(bodies, pa.binary())], ["owner", "block", "body"])


def _answer(batches):
    """Rows sorted by owner and slice, the owner's table first: counts and marks of each block's pairs."""
    keys = counts = best = np.zeros(0, np.int64)
    for batch in batches:
        out = []
        for owner, block, body in zip(*(batch.column(c).to_pylist() for c in ("owner", "block", "body"))):
            if block is None:
                packed, n, marks = unframe(zstandard.ZstdDecompressor().decompress(body))
                keys, counts, best = _unpack_keys(packed)[0], np.frombuffer(n, "<i8"), np.frombuffer(marks, bool)
                continue
            at = np.searchsorted(keys, _unpack_keys(body)[0])
            n = counts[at]
            out.append((owner, block, frames(pack_ints(n & 0xFFFFFFFF), pack_ints(n >> 32), np.packbits(best[at]).tobytes())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["owner", "block", "body"])


def answers(aligned: DataFrame, counted: DataFrame) -> DataFrame:
    """Per block the counts and marks of all its pairs: block, answers (owner, body)."""
    size = aligned.select("block").count()
    slices = max(1, -(-size // SLICE_BLOCKS))
    owner = F.shiftright("pair", 56).alias("owner")
    tables = staged(counted.select(owner, "pair", "n").groupBy("owner").applyInArrow(_owner_table, "owner bigint, body binary"), "pair-counts")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    asked = aligned.select("block", "pairs").mapInArrow(_ask, "owner bigint, block bigint, body binary")
    asked = asked.select("owner", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), "block", "body")
    rows = tables.select("owner", every, F.lit(None).cast("bigint").alias("block"), "body").unionAll(asked)
    dealt = rows.repartition("owner", "slice").sortWithinPartitions("owner", "slice", F.col("block").asc_nulls_first())
    told = dealt.mapInArrow(_answer, "owner bigint, block bigint, body binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("owner", "body")).alias("answers"))  # at most one per owner


# Reports per document


def _symbols(size: int) -> Vocabulary:
    return Vocabulary([b"%d%c" % (i, sign) for i in range(size) for sign in b",|;"])


def _texts_of_groups(block: Opened, symbols: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ends (per document) and bytes of `a1,a2|b1;a3|b2,b3`, each document with one sign too many at its end."""
    ends_a, ends_b = np.cumsum(block.sizes_a), np.cumsum(block.sizes_b)
    sign_a, sign_b = np.zeros(len(block.a), dtype=np.int64), np.zeros(len(block.b), dtype=np.int64)
    sign_a[ends_a - 1], sign_b[ends_b - 1] = 1, 2
    stream = np.empty(len(block.a) + len(block.b), dtype=np.int64)
    stream[np.arange(len(block.a)) + np.repeat(ends_b - block.sizes_b, block.sizes_a)] = block.a * 3 + sign_a
    stream[np.arange(len(block.b)) + np.repeat(ends_a, block.sizes_b)] = block.b * 3 + sign_b
    lengths, flat = pick(symbols.offsets, symbols.flat, stream)
    return offsets_of(lengths)[offsets_of(block.n_a + block.n_b)], flat


_REPORT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _report(tables):
    def run(batches):
        lengths_a, lengths_b = (np.array(x, dtype=np.int64) for x in tables.value)
        symbols = _symbols(max(len(lengths_a), len(lengths_b)))
        for batch in batches:
            for row in range(len(batch)):
                get = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                block = Opened(get["docs"], get["a"], get["b"], get["groups"])
                one, two = overlaps(np.cumsum(lengths_a[block.a]), np.cumsum(lengths_b[block.b]))
                keys = _unpack_keys(get["pairs"])[0]
                told = [unframe(x["body"]) for x in sorted(get["answers"] or [], key=lambda x: x["owner"])]
                counts = np.concatenate([unpack_ints(low).astype(np.int64) | unpack_ints(high).astype(np.int64) << 32 for low, high, _ in told] or [np.zeros(0, np.int64)])
                marks = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=len(unpack_ints(low))) for low, _, bits in told] or [np.zeros(0, np.uint8)])
                if len(counts) != len(keys):
                    raise RuntimeError("a block was not told the counts of all its pairs")
                at = np.searchsorted(keys, _keys(block.a[one], block.b[two]))
                n_links = block.n_a + block.n_b - block.n_groups
                ends = offsets_of(n_links)
                sums = [np.diff(offsets_of(column[at].astype(np.int64))[ends]) for column in (marks, counts)]
                cuts, flat = _texts_of_groups(block, symbols)
                view = memoryview(flat)
                sha = [hashlib.sha256(view[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                columns = [block.n_a, block.n_b, block.n_groups, n_links, *sums]
                yield pa.RecordBatch.from_arrays([block.doc_ids, *(pa.array(c.astype(np.int64)) for c in columns), pa.array(sha, pa.string())], [c.split()[0] for c in _REPORT.split(", ")])

    return run


def report(aligned: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """One row per document: tokens, groups and links, links whose pair is its B id's most frequent, the links' counts added up, digest of the groups."""
    import sentencepiece

    spark = aligned.sparkSession
    with open(byte_json, encoding="utf-8") as file:
        a = tokens_of_a(file.read())
    b = tokens_of_b(sentencepiece.SentencePieceProcessor(model_file=piece_model))
    lengths = spark.sparkContext.broadcast(([len(t) for t in a], [len(t) for t in b]))
    told = answers(aligned, staged(pair_counts(aligned), "pairs"))
    return aligned.join(told, "block", "left").select("docs", "a", "b", "groups", "pairs", "answers").mapInArrow(_report(lengths), _REPORT)
