"""Removal of repeated byte strings, by suffix arrays over the places where texts may agree.

A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller doc_id. Every such
string holds an anchor: the place whose 20 bytes hash lowest within it, which depends on the string alone. So

1. each block of documents reports the hashes at its anchors, packed by ranges, and those of two or more documents come back;
2. for each anchor left, the block sends the bytes of the strings it is lowest in, at most 80 (equal ones once, with the
   smallest doc_id), to the task that owns the anchor's hash;
3. there, where the surroundings of an anchor differ, stretches of 45 bytes tell which parts of them may agree, a suffix array
   over these parts brings equal strings together, and each string gets the smallest doc_id it occurs in;
4. the blocks mark and cut what is covered.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefixes, from the largest group down;
a group's suffixes extend the prefix of the nearest earlier suffix that is in a smaller group. When all groups are
final, the suffixes of each are put in order by the next smaller suffix behind their prefix, which stands before them.

An anchor with very many different surroundings is not gathered in one task: its strings are spread by their content
and aggregated. Null and empty texts keep nothing and lose nothing. Documents with the same doc_id do not take bytes
from each other; a null doc_id comes after all others. Other columns are not read.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.arrays import binary, hash_rows, mix64, offsets_of, powers, raw
from tallyproof.llm.blocks import open_block, write_blocks
from tallyproof.llm.staging import staged

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM  # bytes of a string before, or behind, its anchor at most
#: Different surroundings of one anchor that a task gathers; beyond that the strings are spread by content.
GATHERED = 2_000
SUFFIX_BYTES = 60_000
#: Rows a task gathers for each surrounding it may gather, and rows it looks at together.
ROWS_EACH = 500
WAIT = 20_000
LAST = 2**63 - 1
LAST_HASH = 2**64 - 1
#: Bytes looked through at a time.
STRETCH = 1 << 15
#: Pieces whose bytes are laid out at a time; each byte takes several numbers of eight bytes meanwhile.
TOGETHER = 4_000
#: Starts that share one test of whether pieces have a string in common.
STEP = 5
#: Bits of an anchor's hash left out when blocks report it; a chance match only sends bytes in vain.
SHORT = np.uint64(16)
#: Blocks per owner of a range of hashes: about two million hashes.
BLOCKS_PER_OWNER = 8
_SIGNS = [chr(b + 1) for b in range(256)]  # the sign 0 parts pieces


def suffix_array(text: str) -> list[int]:
    """Order of all suffixes of a text, by linear grouping on Lyndon prefixes."""
    n = len(text)
    letters: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        letters.setdefault(c, []).append(i)
    # groups form a chain from small to large; larger ones are finished first
    members: list[dict[int, None]] = [dict.fromkeys(letters[c]) for c in sorted(letters)]
    length = [1] * len(members)
    smaller = list(range(-1, len(members) - 1))
    larger = list(range(1, len(members) + 1))
    if larger:
        larger[-1] = -1
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    before = list(range(-1, n - 1))  # nearest earlier suffix that may be unfinished
    done = bytearray(n)
    behind = [0] * n  # next smaller suffix
    ranked: list[int] = []
    top = len(members) - 1
    while top >= 0:
        own, size = members[top], length[top]
        for i in own:
            done[i] = 1
            behind[i] = i + size
        hits: dict[int, int] = {}
        for i in own:
            p = before[i]
            if p >= 0 and done[p]:
                path = [i]
                while p >= 0 and done[p]:
                    path.append(p)
                    p = before[p]
                for q in path:
                    before[q] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        ranked.append(top)
        # prefixes that this group extends move up, those it extends more often further
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in hits.items():
            moved.setdefault((group[p], times), []).append(p)
        last: dict[int, int] = {}
        for g, times in sorted(moved) if len(moved) > 1 else moved:
            places = moved[g, times]
            old = members[g]
            for p in places:
                del old[p]
            under = last.get(g, g)
            new = len(members)
            members.append(dict.fromkeys(places))
            length.append(length[g] + times * size)
            over = larger[under]
            smaller.append(under)
            larger.append(over)
            larger[under] = new
            if over >= 0:
                smaller[over] = new
            for p in places:
                group[p] = new
            last[g] = new
        top = smaller[top]
        while top >= 0 and not members[top]:
            top = smaller[top]
    place = [0] * len(members)
    at = 0
    for g in reversed(ranked):
        place[g] = at
        at += len(members[g])
    # the suffixes that each place leads, in text order, as chains: a list for each would take longer to make than to read
    first, following = [-1] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        j = behind[i]
        following[i] = first[j]
        first[j] = i
    order = [0] * n
    i = first[n]
    while i >= 0:
        g = group[i]
        order[place[g]] = i
        place[g] += 1
        i = following[i]
    for j in order:  # grows ahead of the loop
        i = first[j]
        while i >= 0:
            g = group[i]
            order[place[g]] = i
            place[g] += 1
            i = following[i]
    return order


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each `width` consecutive values."""
    out, n = values, 1
    while 2 * n <= width:
        out, n = pick(out[:-n], out[n:]), 2 * n
    return out if n == width else pick(out[: len(out) - (width - n)], out[width - n :])


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    step = powers(GRAM + 1)
    hashes, n = mix64(data.astype(np.uint64) + np.uint64(1)), 1
    parts: list[tuple[int, np.ndarray]] = []
    while n <= GRAM:
        if GRAM & n:
            parts.append((n, hashes))
        hashes = hashes[:-n] * step[n] + hashes[n:]
        n *= 2
    size, total = parts[-1]
    for n, h in reversed(parts[:-1]):
        total = total[: len(data) - size - n + 1] * step[n] + h[size : size + len(data) - size - n + 1]
        size += n
    return mix64(total)


def anchors(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: the anchors' places, hashes, texts, and the first and last start of the strings each is lowest in.

    All places of equal lowest hashes in a string are anchors of it. The bytes are read in stretches that fit a cache.
    """
    found: list[tuple[np.ndarray, ...]] = []
    width = REACH + 1
    # anchors stand up to the last gram, behind the last start of a string; a text shorter than a string has none
    for at in range(0, len(data) - GRAM + 1 if len(data) >= LENGTH else 0, STRETCH):
        low_at, high_at = max(0, at - REACH), min(len(data), at + STRETCH + LENGTH + REACH)
        total = _gram_hashes(data[low_at:high_at])
        for end in ends[np.searchsorted(ends, low_at, side="right") : np.searchsorted(ends, high_at, side="left")]:
            total[max(0, end - low_at - GRAM + 1) : end - low_at] = np.uint64(LAST_HASH)
        low = np.concatenate([np.zeros(REACH, np.uint64), _slide(total, width, np.minimum), np.zeros(REACH, np.uint64)])
        spots = np.flatnonzero((_slide(low, width, np.maximum) == total) & (total != np.uint64(LAST_HASH)))
        spots = spots[(spots + low_at >= at) & (spots + low_at < at + STRETCH)]
        lowest = low[spots[:, None] + np.arange(width)] == total[spots][:, None]  # by start, from REACH before the place on
        doc = np.searchsorted(ends, spots + low_at, side="right") - 1
        first = np.maximum(spots + low_at - REACH + lowest.argmax(axis=1), ends[doc])
        last = np.minimum(spots + low_at - lowest[:, ::-1].argmax(axis=1), ends[doc + 1] - LENGTH)
        some = first <= last
        found.append(tuple(x[some] for x in (spots + low_at, total[spots], doc, first, last)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _open(batches):
    for batch in batches:
        for i in range(len(batch)):
            block = batch.column(0)[i].as_py()
            known = None
            if batch.num_columns > 2 and pa.types.is_struct(batch.column(2).type):
                answers = batch.column(2).field("answers")[i].values
                known = {"grams": batch.column(2).field("grams")[i].as_py(), "answers": answers}
            elif batch.num_columns > 2:
                known = batch.column(2)[i].as_py()
            yield block, open_block(block, batch.column(1)[i].as_py()), known


def _order(null: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.where(null, LAST, keys)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Sorted hashes by their differences, as compressed byte planes."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _grams(batches, owners: int):
    """Anchor hashes of a block, each once and without its last bits, by the owner of their range, and which of them several documents of the block have."""
    for block, (_, null, keys, ends, data), _ in _open(batches):
        _, hashes, docs, _, _ = anchors(ends, data)
        if not len(hashes):
            continue
        h, d = hashes >> SHORT, _order(null, keys)[docs]
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
        h = h[first]
        owner = ((h >> np.uint64(16)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        rows = [(int(owner[i]), block, _pack_sorted(h[i:j]), np.packbits(several[i:j]).tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000]), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["owner", "block", "grams", "several"])


def _shared(batches):
    """Of rows sorted by owner, per block the hashes that another block or several documents of this one have."""

    def settled(rows):
        parts = [_unpack_sorted(r[2]) for r in rows]
        h = np.concatenate(parts)
        several = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(p)) for r, p in zip(rows, parts)]).astype(bool)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        keep = several[order]
        keep[1:] |= same
        keep[:-1] |= same
        back = np.zeros(len(h), dtype=bool)
        back[order] = keep
        ends = np.cumsum([len(p) for p in parts])
        for (_, block, _, _), part, end in zip(rows, parts, ends):
            if (own := back[end - len(part) : end]).any():
                yield block, _pack_sorted(part[own])

    def answers(rows):
        out = list(settled(rows))
        for i in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000]), (pa.int64(), pa.binary()))], ["block", "grams"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("owner", "block", "grams", "several"))):
            if held and held[0][0] != row[0]:
                yield from answers(held)
                held = []
            held.append(row)
    if held:
        yield from answers(held)


def _gather(data: np.ndarray, first: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the bytes, one after the other: offsets and bytes."""
    at = offsets_of(stops - first)
    return at, data[np.arange(at[-1]) + np.repeat(first - at[:-1], stops - first)]


def _signed_off(at: np.ndarray, flat: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Hashes of pieces and where their anchor is; with the anchor's own hash 128 bits stand for a piece."""
    return hash_rows(at, flat) ^ mix64(skip.astype(np.uint64) + np.uint64(1))


def _places(grams: list[bytes], null, keys, ends: np.ndarray, data: np.ndarray):
    """Shared anchors of a block: gram, start and end of the strings it is lowest in, distance to the anchor, document's order, and the number of its piece.

    Pieces are numbered by gram and content; the order and the bounds of the numbers come last.
    """
    wanted = np.sort(np.concatenate([_unpack_sorted(g) for g in grams]))
    spots, hashes, docs, first, last = anchors(ends, data)
    short = hashes >> SHORT
    found = wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short
    spots, signed, docs, first, stops = (x[found] for x in (spots, hashes.view(np.int64), docs, first, last + LENGTH))
    skip = spots - first
    parts = [slice(i, i + TOGETHER) for i in range(0, len(spots), TOGETHER)]
    content = np.concatenate([_signed_off(*_gather(data, first[p], stops[p]), skip[p]) for p in parts] or [np.zeros(0, np.uint64)])
    order = np.lexsort((content, signed))
    g, c = signed[order], content[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, bool)
    number = np.empty(len(g), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return signed, first, stops, skip, _order(null, keys)[docs], number, order, np.flatnonzero(new)


_SURROUNDINGS = "gram bigint, block bigint, n int, least bigint, most bigint, skip int, bytes binary"
_KINDS = {"gram": pa.int64(), "block": pa.int64(), "n": pa.int32(), "least": pa.int64(), "most": pa.int64(), "skip": pa.int32(), "bytes": pa.binary()}


def _surroundings(batches):
    """For each shared anchor the bytes around it, equal ones of a block once: number in the block, smallest and largest doc_id."""
    for block, (_, null, keys, ends, data), grams in _open(batches):
        signed, first, stops, skip, doc, _, order, new = _places(grams, null, keys, ends, data)
        if not len(new):
            continue
        least, most = np.minimum.reduceat(doc[order], new), np.maximum.reduceat(doc[order], new)
        for i in range(0, len(new), 5000):
            own = order[new[i : i + 5000]]
            columns = [signed[own], np.full(len(own), block), np.arange(i, i + len(own)), least[i : i + 5000], most[i : i + 5000], skip[own]]
            arrays = [pa.array(c, t) for c, t in zip(columns, _KINDS.values())]
            yield pa.RecordBatch.from_arrays([*arrays, binary(*_gather(data, first[own], stops[own]))], list(_KINDS))


def _common_parts(pieces: list[tuple[int, bytes]]) -> list[tuple[int, int] | None]:
    """Of each piece of one anchor, the stretch whose strings another piece may hold; None where there is none.

    A string that starts from t to t + STEP bytes before the anchor holds all bytes from t before it on, less STEP.
    """
    seen: dict[tuple[int, bytes], int] = {}
    keys = []
    for skip, data in pieces:
        own = [(t, data[skip - t : skip - t + LENGTH - STEP]) for t in range(0, REACH, STEP) if t <= skip and skip - t + LENGTH - STEP <= len(data)]
        keys.append(own)
        for k in own:
            seen[k] = seen.get(k, 0) + 1
    out: list[tuple[int, int] | None] = []
    for (skip, data), own in zip(pieces, keys):
        ts = [k[0] for k in own if seen[k] > 1]
        out.append((max(0, skip - ts[-1] - STEP), min(len(data), skip - ts[0] + LENGTH)) if ts else None)
    return out


def equal_strings(pieces: list[bytes], least: list[int]) -> list[list[int]]:
    """For each piece and each of its strings of 50 bytes, the smallest of `least` over all pieces that hold the string."""
    out = [[m] * (len(p) - LENGTH + 1) for p, m in zip(pieces, least)]
    text = "\x00".join("".join(map(_SIGNS.__getitem__, p)) for p in pieces)
    owner: list[tuple[int, int] | None] = []
    for k, p in enumerate(pieces):
        owner += [(k, j) for j in range(len(p) - LENGTH + 1)] + [None] * LENGTH
    run: list[tuple[int, int]] = []
    last = None

    def close():
        if len(run) > 1:
            m = min(least[k] for k, _ in run)
            for k, j in run:
                out[k][j] = m

    for i in suffix_array(text):
        if owner[i] is None:
            continue
        string = text[i : i + LENGTH]
        if string != last:
            close()
            run, last = [], string
        run.append(owner[i])
    close()
    return out



_ANSWERS = "block bigint, n int, strings array<bigint>, gram bigint, skip int, bytes binary, least bigint"
_ANSWER_KINDS = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.int64())


def _by_gram(keys) -> dict[int, list[tuple[int, int, bytes]]]:
    out: dict[int, list[tuple[int, int, bytes]]] = {}
    for key in keys:
        out.setdefault(key[0], []).append(key)
    return out


def _settle(rows: list[tuple]) -> list[list]:
    """_settled without the search for cycles of objects: none are made, and it would go through all of them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        return _settled(rows)
    finally:
        if on:
            gc.enable()


def _settled(rows: list[tuple]) -> list[list]:
    """Answers for the rows of some anchors, all of each: smallest doc_id by string (one number if it is the same for all)."""
    distinct: dict[tuple[int, int, bytes], int] = {}
    for gram, _, _, least, _, skip, data in rows:
        key = gram, skip, data
        distinct[key] = min(least, distinct.get(key, LAST))
    by_gram = _by_gram(distinct)
    parts: dict[tuple[int, int, bytes], tuple[int, tuple[int, int, bytes]]] = {}
    least_of: dict[tuple[int, int, bytes], int] = {}
    for keys in by_gram.values():
        if len(keys) < 2:
            continue
        cut: list[tuple[int, int, bytes]] = []
        for key, part in zip(keys, _common_parts([k[1:] for k in keys])):
            if part:
                cut.append((key[0], key[1] - part[0], key[2][part[0] : part[1]]))
                parts[key] = part[0], cut[-1]
                least_of[cut[-1]] = min(distinct[key], least_of.get(cut[-1], LAST))
    several = [key for keys in _by_gram(least_of).values() if len(keys) > 1 for key in keys]
    common = dict(zip(several, equal_strings([k[2] for k in several], [least_of[k] for k in several])))
    strings: dict[tuple[int, int, bytes], list[int]] = {}
    for key, (at, part) in parts.items():
        found = common.get(part) or [least_of[part]] * (len(part[2]) - LENGTH + 1)
        strings[key] = [distinct[key]] * at + found + [distinct[key]] * (len(key[2]) - LENGTH + 1 - at - len(found))
    columns: list[list] = [[] for _ in _ANSWER_KINDS]
    for gram, block, n, _, most, skip, data in rows:
        own = distinct[gram, skip, data]
        found = strings.get((gram, skip, data), [own])
        found = found if min(found) != max(found) else found[:1]
        if most > min(found):
            for c, v in zip(columns, (block, n, found, None, None, None, None)):
                c.append(v)
    return columns


_NAMES = ["block", "n", "strings", "gram", "skip", "bytes", "least"]


def _answered(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ANSWER_KINDS)], _NAMES)


def _passed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that are not answered here."""
    return pa.RecordBatch.from_arrays([pa.nulls(len(rows), _ANSWER_KINDS[2]) if c == "strings" else rows.column(c) for c in _NAMES], _NAMES)


def _resolve(batches, gathered: int):
    """Rows sorted by anchor hash: answers, a suffix array for as many anchors as fill a text; rows of crowded anchors are passed on."""
    held: list[pa.RecordBatch] = []
    crowded = None  # an anchor whose first rows have been passed on
    ready: list[tuple] = []

    def settled(rows: pa.RecordBatch, content: np.ndarray):
        """Answers for rows that hold all of their anchors."""
        gram, least, most = (rows.column(c).to_numpy() for c in ("gram", "least", "most"))
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        sizes = np.diff(np.append(starts, len(gram)))
        alike = np.minimum.reduceat(content, starts) == np.maximum.reduceat(content, starts)
        low = np.repeat(np.minimum.reduceat(least, starts), sizes)
        passing = gram == crowded if crowded is not None else np.zeros(len(gram), bool)
        for k in np.flatnonzero(~alike & (sizes > gathered)):
            own = slice(starts[k], starts[k] + sizes[k])
            passing[own] = passing[own] | (len(np.unique(content[own])) > gathered)
        if passing.any():
            yield _passed(rows.filter(pa.array(passing)))
        plain = np.repeat(alike, sizes) & ~passing
        told = np.flatnonzero(plain & (most > low))
        if len(told):
            some = rows.take(pa.array(told))
            strings = pa.ListArray.from_arrays(pa.array(np.arange(len(told) + 1), pa.int32()), pa.array(low[told]))
            yield pa.RecordBatch.from_arrays([some.column("block"), some.column("n"), strings, *[pa.nulls(len(told), t) for t in _ANSWER_KINDS[3:]]], _NAMES)
        size, last = 0, None
        some = rows.filter(pa.array(~plain & ~passing))
        for row in zip(*(some.column(c).to_pylist() for c in _KINDS)):
            if row[0] != last and size > SUFFIX_BYTES:
                yield _answered(_settle(ready))
                ready.clear()
                size = 0
            ready.append(row)
            size, last = size + len(row[6]), row[0]
        if ready:
            yield _answered(_settle(ready))
            ready.clear()

    def content_of(rows: pa.RecordBatch) -> np.ndarray:
        parts = (rows.slice(i, TOGETHER) for i in range(0, len(rows), TOGETHER))
        return np.concatenate([_signed_off(*raw(p.column("bytes")), p.column("skip").to_numpy()) for p in parts])

    count, wait = 0, WAIT
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < wait:
            continue
        rows = pa.concat_batches(held)
        gram, content = rows.column("gram").to_numpy(), content_of(rows)
        tail = int(np.searchsorted(gram, gram[-1]))
        if tail:
            yield from settled(rows.slice(0, tail), content[:tail])
        rest = rows.slice(tail)
        if gram[-1] == crowded or len(rest) > gathered and (len(np.unique(content[tail:])) > gathered or len(rest) > ROWS_EACH * gathered):
            crowded = gram[-1]
            yield _passed(rest)
            rest = rest.slice(0, 0)
        held, count = [rest], len(rest)
        wait = WAIT + 2 * count
    if count:
        rows = pa.concat_batches(held)
        yield from settled(rows, content_of(rows))


def _cut(batches):
    """Per document of a block what is removed and what stays."""
    for _, (_, null, keys, ends, data), known in _open(batches):
        gone = np.zeros(len(data) + 1, dtype=np.int32)
        text = data.tobytes()
        if known["answers"] is not None and len(known["answers"]):
            numbers, lists = (known["answers"].field(c) for c in ("n", "strings"))
            numbers, at, strings = numbers.to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy()
            _, first, stops, _, doc, number, _, new = _places(known["grams"], null, keys, ends, data)
            answer = np.full(len(new), -1, dtype=np.int64)
            answer[numbers] = np.arange(len(numbers))
            told = np.flatnonzero(answer[number] >= 0)
            answer = answer[number[told]]
            lengths = np.diff(at)[answer]
            one = lengths == 1  # all strings: one stretch
            whole = told[one][strings[at[answer[one]]] < doc[told[one]]]
            np.add.at(gone, first[whole], 1)
            np.add.at(gone, stops[whole], -1)
            for p in range(0, int((~one).sum()), TOGETHER):
                own, which = told[~one][p : p + TOGETHER], answer[~one][p : p + TOGETHER]
                offsets, values = _gather(strings, at[which], at[which + 1])
                size = np.diff(offsets)
                begins = (np.arange(len(values)) - np.repeat(offsets[:-1] - first[own], size))[values < np.repeat(doc[own], size)]
                np.add.at(gone, begins, 1)
                np.add.at(gone, begins + LENGTH, -1)
        removed = np.cumsum(gone, out=gone)[: len(data)] > 0
        columns: list[list] = [[], [], [], []]
        for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = removed[low:high]
            n = int(own.sum())
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
            for c, v in zip(columns, (high - low, n, spans, data[low:high][~own].tobytes() if n else text[low:high])):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", gathered: int = GATHERED) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    blocks = write_blocks(docs, key, text)
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count() // BLOCKS_PER_OWNER)
    grams = blocks.mapInArrow(lambda batches: _grams(batches, owners), "owner bigint, block bigint, grams binary, several binary").repartition("owner").sortWithinPartitions("owner")
    shared = grams.mapInArrow(_shared, "block bigint, grams binary").groupBy("block").agg(F.collect_list("grams").alias("grams"))
    shared = staged(shared, "repeat-grams")
    around = blocks.join(shared, "block").select("block", "body", "grams").mapInArrow(_surroundings, _SURROUNDINGS)
    found = staged(around.repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda batches: _resolve(batches, gathered), _ANSWERS), "repeat-answers")

    # crowded anchors: their strings meet by content, each piece's row is put together again from its strings' doc_ids
    crowd = found.filter("strings is null and length(bytes) >= 50").withColumn("place", F.explode(F.sequence(F.lit(0), F.length("bytes") - LENGTH)))
    crowd = crowd.select("block", "n", "least", "place", F.substring("bytes", F.col("place") + 1, F.lit(LENGTH)).alias("string"))
    lowest = crowd.groupBy("string").agg(F.min("least").alias("lowest"))
    crowd = crowd.join(lowest, "string").groupBy("block", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "lowest"))), lambda x: x["lowest"]).alias("strings"))
    answers = found.filter("strings is not null").select("block", "n", "strings").unionByName(crowd)
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("n", "strings")).alias("answers"))
    known = shared.join(answers, "block", "left")
    return blocks.join(known, "block", "left").select("block", "body", F.struct("grams", "answers").alias("known")).mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
