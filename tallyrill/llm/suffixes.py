"""Exact deduplication of repeated byte strings: sampled suffixes, sorted in runs that are merged by their common prefixes.

Every byte goes that is covered by a string of ``length`` bytes that also starts earlier: in a document of a smaller id, or
at an earlier place of the same one. Strings never cross documents, and are judged on the input.

Not every suffix is sorted. Each window of ``length`` bytes has an anchor, the place in it whose ``GRAM`` bytes have the least hash
(the rightmost of equal ones), so equal windows have anchors at the same place in them. The suffixes at anchors, about one in
forty, are what is sorted:

1. Each task sorts the suffixes of its documents (as far as all windows of an anchor share them) and cuts the run into parts by
   a hash of the suffix. Parts are front-coded: of each suffix, the length of the prefix it shares with the one before, and the rest.
2. Each part's runs are merged by a loser tree that holds, for each run, the length of the prefix shared with the last winner.
   Runs whose lengths differ are told apart without a look at the suffixes; others are compared from that length on. The
   merged lengths say which suffixes are equal.
3. Equal suffixes whose surroundings (all bytes of all windows that hold the anchor) are equal too, by 128-bit hashes, make a class: all
   but its first are covered whole. (Tasks already send only the first of theirs.) The firsts of different classes with one suffix are
   compared in groups that share half of a window's free bytes after or before the anchor, as two equal windows must: few by their
   bytes, more by 128-bit hashes of their windows, one distance from the anchor at a time. Groups over ``HOT`` are not gathered at all: their
   windows' hashes are grouped by Spark, which keeps the least place of each.
4. The covered spans are united for each document.

Null texts count as empty; null ids come last in order. Rows of equal id and text count as one document, those of an equal id and
different texts are ordered by hashes of the texts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._shared import materialize, own_names, partitions, utf8
from .winnowing import _sliding_least, rolling_hashes

#: Bytes of a suffix that are sorted: as many as all windows of an anchor share at least.
GRAM = 24
#: Suffixes that a task sorts at a time; and bytes of text whose suffixes a part should hold.
RUN = 200_000
PART_BYTES = 1 << 23
#: Rows of a group that one task compares.
HOT = 1 << 15
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = np.iinfo(np.int64).max


def anchors(codes: np.ndarray, length: int) -> np.ndarray:
    """The anchors of all windows of ``length`` bytes, ascending."""
    window, grams = length - GRAM + 1, len(codes) - GRAM + 1
    low, out = np.uint64(0xFFFFFFFF), []
    with np.errstate(over="ignore"):
        for at in range(0, grams - window + 1, _BLOCK):
            h = rolling_hashes(codes[at : min(grams, at + _BLOCK + window - 1) + GRAM - 1], GRAM)
            least = _sliding_least((h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64)), window)
            # The least of a window may come back after a smaller one has left: places, not keys, are what counts.
            out.append((low - (least[np.flatnonzero(np.diff(least, prepend=~least[:1]))] & low)).astype(np.int64) + at)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def surroundings(raw: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor a hash of the bytes of all windows that hold it (two 64-bit numbers), and how many of these come from it on."""
    start, end = np.maximum(at - (length - GRAM), 0), np.minimum(at + length, len(raw))
    digest = xxhash.xxh3_128_digest
    h = b"".join([digest(raw[i:j], n) for i, j, n in zip(start.tolist(), end.tolist(), (at - start).tolist(), strict=True)])
    return np.frombuffer(h, np.uint64).reshape(-1, 2), (end - at).astype(np.uint16)


# A block: a run's part, front-coded. Columns: shared lengths, rests, surroundings' hashes, ids, hashes of texts, places, bytes from the place on.
_COLUMNS = (("hash", np.uint64), ("more", np.uint64), ("doc", np.int64), ("dk", np.int32), ("at", np.int32), ("ahead", np.uint16))


def front_code(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys (a row each): the lengths of the prefixes shared with the row before, and the rests in one piece."""
    differ = keys[1:] != keys[:-1]
    shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])]).astype(np.uint8)
    return shared, keys[np.arange(keys.shape[1])[None] >= shared[:, None]]


def front_decode(shared: np.ndarray, rests: np.ndarray, width: int) -> np.ndarray:
    own = np.arange(width)[None] >= shared[:, None]
    keys = np.zeros((len(shared), width), np.uint8)
    keys[own] = rests
    rows = np.arange(len(shared))
    for c in range(width):
        keys[:, c] = keys[np.maximum.accumulate(np.where(own[:, c], rows, 0)), c]
    return keys


def _block(keys: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    shared, rests = front_code(keys)
    parts = [np.array([len(shared), len(rests)], np.int64), shared, rests, *(columns[c].astype(t) for c, t in _COLUMNS)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def _unblock(packed: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, rest = np.frombuffer(raw, np.int64, 2).tolist()
    shared, rests, at = np.frombuffer(raw, np.uint8, n, 16), np.frombuffer(raw, np.uint8, rest, 16 + n), 16 + n + rest
    columns = {}
    for c, t in _COLUMNS:
        columns[c] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return shared, front_decode(shared, rests, GRAM), columns


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of (keys, lengths shared with the key before) by a loser tree.

    Returns for each place of the merged order the run, and the prefix length shared with the key before; the runs' own
    orders stay. Every length in the tree is one shared with the last winner, so of two runs the one that shares more is
    the smaller, and what equal lengths have told is never looked at again.
    """
    size = 1
    while size < len(runs):
        size *= 2
    keys = [r[0] for r in runs] + [[]] * (size - len(runs))
    common = [r[1] for r in runs] + [[]] * (size - len(runs))
    counts = list(map(len, keys))
    place = [0] * size
    head = [k[0] if k else b"" for k in keys]
    shares = [0 if k else -1 for k in keys]  # -1: a run that has ended, and always loses
    tree = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        if duel(b, a):
            a, b = b, a
        tree[node] = b
        return a

    def duel(a: int, b: int) -> bool:
        """Does a win against b? The loser's length becomes the one shared with the winner."""
        la, lb = shares[a], shares[b]
        if la != lb:
            return la > lb
        if la < 0:
            return True
        ka, kb = head[a], head[b]
        if ka == kb:
            first = a < b
            shares[b if first else a] = len(ka)
            return first
        h = la
        while ka[h] == kb[h]:
            h += 1
        if ka[h] < kb[h]:
            shares[b] = h
            return True
        shares[a] = h
        return False

    winner = build(1) if size > 1 else 0
    out_run, out_shared = [], []
    for _ in range(sum(counts)):
        out_run.append(winner)
        out_shared.append(shares[winner])
        i = place[winner] = place[winner] + 1
        if i < counts[winner]:
            head[winner] = keys[winner][i]
            shares[winner] = common[winner][i]
        else:
            shares[winner] = -1
        node = (winner + size) >> 1
        while node:
            other = tree[node]
            la, lb = shares[winner], shares[other]
            if la < lb or (la == lb and not duel(winner, other)):
                tree[node], winner = winner, other
            node >>= 1
    return out_run, out_shared, place


def _spans(columns: dict[str, np.ndarray], which: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All that the windows of these anchors cover: id, hash of the text, start, end."""
    at, ahead = columns["at"][which].astype(np.int64), columns["ahead"][which].astype(np.int64)
    start, end = np.maximum(at - (length - GRAM), 0), at + ahead
    whole = end - start >= length
    return columns["doc"][which][whole], columns["dk"][which][whole], start[whole], end[whole]


def _united(doc: np.ndarray, dk: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document, united where they touch."""
    order = np.lexsort((end, start, dk, doc))
    doc, dk, start, end = doc[order], dk[order], start[order], end[order]
    out: list[list] = []
    for d, k, s, e in zip(doc.tolist(), dk.tolist(), start.tolist(), end.tolist(), strict=True):
        if out and out[-1][0] == d and out[-1][1] == k and s <= out[-1][3]:
            out[-1][3] = max(out[-1][3], e)
        else:
            out.append([d, k, s, e])
    return tuple(np.array([o[i] for o in out], t) for i, t in enumerate((np.int64, np.int32, np.int64, np.int64)))


_FOUND = ["doc", "dk", "start", "end", "ask"]
_FOUND_SCHEMA = "doc long, dk int, start long, end long, ask boolean"


def _found(parts: list[tuple[np.ndarray, ...]], ask: bool) -> pa.RecordBatch:
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1].astype(np.int32), pa.int32()), pa.array(columns[2].astype(np.int64), pa.int64()), pa.array(columns[3].astype(np.int64), pa.int64()), pa.array(np.full(len(columns[0]), ask))], _FOUND)


def _runs(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Front-coded sorted runs, cut into parts; and, as part -1 onward, spans that this task knows already."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, count
        keys = np.concatenate([h[0] for h in held])
        columns = {c: np.concatenate([h[i] for h in held]) for i, (c, _) in enumerate(_COLUMNS, 1)}
        held, count = [], 0
        words = np.ascontiguousarray(keys).view(">u8").astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (words * np.array([_BASE, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)).sum(axis=1, dtype=np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((columns["at"], columns["dk"], columns["doc"], columns["more"], columns["hash"], words[:, 2], words[:, 1], words[:, 0], part))
        keys, part, columns = keys[order], part[order], {c: x[order] for c, x in columns.items()}
        same = (keys[1:] == keys[:-1]).all(axis=1) & (columns["hash"][1:] == columns["hash"][:-1]) & (columns["more"][1:] == columns["more"][:-1])
        first = np.concatenate([[True], ~same])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        own = (columns["doc"] == columns["doc"][lead]) & (columns["dk"] == columns["dk"][lead]) & (columns["at"] == columns["at"][lead])
        known = _united(*_spans(columns, np.flatnonzero(~first & ~own), length))
        keys, part, columns = keys[first], part[first], {c: x[first] for c, x in columns.items()}
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        names = [int(part[i]) for i in cuts[:-1]]
        blocks = [_block(keys[i:j], {c: x[i:j] for c, x in columns.items()}) for i, j in zip(cuts, cuts[1:], strict=False)]
        if len(known[0]):
            names.append(-1 - int(known[0][0] % parts))
            blocks.append(b"".join(x.tobytes() for x in known))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    for b in batches:
        for doc, dk, raw in zip(b.column("doc").to_pylist(), b.column("dk").to_pylist(), b.column("raw"), strict=True):
            raw = raw.as_py()
            if len(raw) < length:
                continue
            codes = np.frombuffer(raw, np.uint8)
            every = anchors(codes, length)
            for at in np.split(every, range(RUN, len(every), RUN)):
                h, ahead = surroundings(raw, at, length)
                n = len(at)
                held.append((np.lib.stride_tricks.sliding_window_view(codes, GRAM)[at], h[:, 0], h[:, 1], np.full(n, doc, np.int64), np.full(n, dk, np.int32), at.astype(np.int32), ahead))
                count += n
                if count >= RUN:
                    yield flush()
    if held:
        yield flush()


def _merge_parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part. Spans of what is covered whole, and (ask) the anchors whose surroundings are to be compared."""

    def merged(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        runs, columns = [], []
        for packed in blocks:
            shared, keys, own = _unblock(packed)
            runs.append(([k.tobytes() for k in keys], shared.tolist()))
            columns.append(own)
        out_run, out_shared, _ = merge(runs)
        run = np.array(out_run)
        starts = np.cumsum([0, *(len(r[0]) for r in runs)])[:-1]
        # The runs' own orders stay, so the n-th place of a run is its n-th key.
        index = np.zeros(len(run), np.int64)
        index[np.argsort(run, kind="stable")] = np.arange(len(run)) - np.repeat(starts, [len(r[0]) for r in runs])
        index += starts[run]
        group = np.cumsum(np.array(out_shared) < GRAM)
        several = np.bincount(group)[group] > 1
        index, group = index[several], group[several]
        every = {c: np.concatenate([o[c] for o in columns])[index] for c, _ in _COLUMNS}
        order = np.lexsort((every["at"], every["dk"], every["doc"], every["more"], every["hash"], group))
        group, every = group[order], {c: x[order] for c, x in every.items()}
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (every["hash"][1:] != every["hash"][:-1]) | (every["more"][1:] != every["more"][:-1])]) if len(group) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        own = (every["doc"] == every["doc"][lead]) & (every["dk"] == every["dk"][lead]) & (every["at"] == every["at"][lead])
        yield _found([_united(*_spans(every, np.flatnonzero(~first & ~own), length))], False)
        firsts = np.flatnonzero(first)
        firsts = firsts[np.bincount(group[firsts])[group[firsts]] > 1] if len(firsts) else firsts
        yield _found([(every["doc"][firsts], every["dk"][firsts], every["at"][firsts], every["at"][firsts])], True)

    now, held = None, []
    for b in batches:
        for part, block in zip(b.column("part").to_pylist(), b.column("block"), strict=True):
            block = block.as_py()
            if part < 0:
                n = len(block) // 28
                yield _found([(np.frombuffer(block, np.int64, n), np.frombuffer(block, np.int32, n, 8 * n), np.frombuffer(block, np.int64, n, 12 * n), np.frombuffer(block, np.int64, n, 20 * n))], False)
                continue
            if part != now and held:
                yield from merged(held)
                held = []
            now = part
            held.append(block)
    if held:
        yield from merged(held)


def _squeeze(batches: Iterator[pa.RecordBatch], raw: str) -> Iterator[pa.RecordBatch]:
    """Texts (the column ``raw``, the last one) become zipped ones: less to shuffle."""
    packer = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([packer.compress(r.as_py()) for r in b.column(raw)], pa.binary())], b.schema.names)


def _sides(length: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(bytes before, bytes from the anchor on) of the two kinds of groups: equal windows share, with half their free bytes on a side, those after or before."""
    half = (length - GRAM) // 2
    return (half, length), (length - GRAM, length - half)


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    unpacker, (one, two) = zstandard.ZstdDecompressor(), _sides(length)
    half, rows = one[0], []
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())

    def made() -> pa.RecordBatch:
        columns = [[r[i] for r in rows] for i in range(6)]
        columns[0] = np.array(columns[0], np.uint64).view(np.int64)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _CONTEXT)

    for b in batches:
        for doc, dk, packed, places in zip(b.column("doc").to_pylist(), b.column("dk").to_pylist(), b.column("raw"), b.column("places"), strict=True):
            raw = unpacker.decompress(packed.as_py())
            for at in places.values.to_numpy().tolist():
                if at + length - half <= len(raw):  # what all windows of the first kind share
                    start = max(0, at - one[0])
                    rows.append((xxhash.xxh3_64_intdigest(raw[at : at + length - half], 1), doc, dk, at, at - start, raw[start : at + one[1]]))
                if at >= half:
                    start = max(0, at - two[0])
                    rows.append((xxhash.xxh3_64_intdigest(raw[at - half : at + GRAM], 2), doc, dk, at, at - start, raw[start : at + two[1]]))
                if len(rows) >= 8192:
                    yield made()
    yield made()


_CONTEXT = ["key", "doc", "dk", "at", "before", "bytes"]
_CONTEXT_SCHEMA = "key long, doc long, dk int, at long, before int, bytes binary"


def _shared_after(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return n if not x else ((x & -x).bit_length() - 1) >> 3


def _shared_before(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - n :], "big") ^ int.from_bytes(b[len(b) - n :], "big")
    return n if not x else ((x & -x).bit_length() - 1) >> 3


def _compare_few(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    out = []
    for i, (doc, dk, at, before, own) in enumerate(rows):
        left, right = own[:before], own[before:]
        for _, _, _, b, other in rows[:i]:
            back, ahead = _shared_before(left, other[:b]), _shared_after(right, other[b:])
            if back + ahead >= length:
                out.append((doc, dk, at - back, at + ahead))
    return out


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _window_hashes(table: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Of a table of bytes, a row each, the two hashes of each row's window at each place in turn: polynomials modulo 2^64, mixed."""
    with np.errstate(over="ignore"):
        wide = table[:, :length].astype(np.uint64) + np.uint64(1)
        tops = [np.uint64(pow(b, length - 1, 1 << 64)) for b in _BASES]
        now = []
        for b in _BASES:
            powers = np.array([pow(b, length - 1 - i, 1 << 64) for i in range(length)], np.uint64)
            now.append((wide * powers).sum(axis=1, dtype=np.uint64))
        del wide
        for at in range(table.shape[1] - length + 1):
            yield np.stack([(h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD) for h in now], axis=1)
            if at + length < table.shape[1]:
                first, new = (table[:, c].astype(np.uint64) + np.uint64(1) for c in (at, at + length))
                now = [(h - first * top) * np.uint64(b) + new for h, top, b in zip(now, tops, _BASES, strict=True)]


def _table(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes, with the anchors in one column, and how many are before and from the anchor on."""
    before = np.array([r[3] for r in rows])
    ahead = np.array([len(r[4]) for r in rows]) - before
    most = int(before.max())
    table = np.zeros((len(rows), most + int(ahead.max())), np.uint8)
    for i, r in enumerate(rows):
        table[i, most - r[3] : most - r[3] + len(r[4])] = np.frombuffer(r[4], np.uint8)
    return table, before, ahead


def _compare_many(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """By hashes of the windows at each distance from the anchor: all but the first of equal ones are covered."""
    table, before, ahead = _table(rows)
    most = int(before.max())
    covered = np.zeros((len(rows), most + 3), bool)
    for at, h in enumerate(_window_hashes(table, length)):
        back = most - at
        if back < 0:
            break
        have = np.flatnonzero((before >= back) & (ahead >= length - back))
        if len(have) > 1:
            own = h[have]
            order = np.lexsort((have, own[:, 1], own[:, 0]))
            later = (own[order[1:]] == own[order[:-1]]).all(axis=1)
            covered[have[order[1:][later]], back + 1] = True
    edge = np.diff(covered.astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return [(rows[i][0], rows[i][1], rows[i][2] - (h - 1), rows[i][2] - lo + length) for i, lo, h in zip(row.tolist(), low.tolist(), high.tolist(), strict=True)]


def _compare(batches: Iterator[pa.RecordBatch], length: int, few: int = 16) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and order of place."""

    def found(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        return (_compare_few if len(rows) <= few else _compare_many)(rows, length) if len(rows) > 1 else []

    def made(out: list[tuple]) -> pa.RecordBatch:
        return _found([tuple(np.array([o[i] for o in out], np.int64) for i in range(4))], False)

    now, rows = None, []
    for b in batches:
        out = []
        for key, doc, dk, at, before, own in zip(*(b.column(c).to_pylist() for c in _CONTEXT[:-1]), b.column("bytes"), strict=True):
            if key != now:
                out += found(rows)
                now, rows = key, []
            if not rows or rows[-1][:3] != (doc, dk, at):  # rows of equal id and text are one document
                rows.append((doc, dk, at, before, own.as_py()))
        yield made(out)
    yield made(found(rows))


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of the rows' anchors: its hash and where it is."""
    names = ["h", "more", "doc", "dk", "start"]
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            places = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("doc", "dk", "at")], axis=1)
            rows = [(0, 0, 0, n, raw.as_py()) for n, raw in zip(part.column("before").to_pylist(), part.column("bytes"), strict=True)]
            table, before, ahead = _table(rows)
            most = int(before.max())
            for c, h in enumerate(_window_hashes(table, length)):
                back = most - c
                have = np.flatnonzero((before >= back) & (ahead >= length - back)) if back >= 0 else []
                if len(have):
                    columns = (h[have, 0].view(np.int64), h[have, 1].view(np.int64), places[have, 0], places[have, 1].astype(np.int32), places[have, 2] - back)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """What is covered in groups that are too large to gather: a window each. Sums of no group's rows, only the least place of each hash, are kept."""
    windows = materialize(contexts.mapInArrow(partial(_windows, length=length), "h long, more long, doc long, dk int, start long").distinct(), "hot-windows")
    place = F.struct("doc", "dk", "start")
    first = windows.groupBy("h", "more").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = windows.join(materialize(first, "hot-firsts"), ["h", "more"]).filter(place != F.col("first"))
    return again.select("doc", "dk", "start", (F.col("start") + length).alias("end"), F.lit(False).alias("ask")).distinct()


def _placed(docs: DataFrame, *names: str) -> DataFrame:
    """docs with columns of these names: the id in the order of ids, a hash of the text, and its bytes."""
    doc, dk, raw = names
    return docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(dk, F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int")).withColumn(raw, utf8("text"))


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """Covered spans, not yet united: doc (id; the largest long for null), dk (hash of the text), start, end."""
    count = partitions(docs.sparkSession)
    source = _placed(docs.select("doc_id", "text"), "doc", "dk", "raw").select("doc", "dk", "raw")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * count, size // PART_BYTES)
    blocks = source.mapInArrow(partial(_runs, length=length, parts=parts), "part int, block binary")
    found = blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(partial(_merge_parts, length=length), _FOUND_SCHEMA)
    found = materialize(found, "suffix-groups")
    asked = found.filter("ask").groupBy("doc", "dk").agg(F.collect_set("start").alias("places"))
    texts = source.mapInArrow(partial(_squeeze, raw="raw"), "doc long, dk int, raw binary")
    contexts = materialize(texts.join(asked, ["doc", "dk"]).select("doc", "dk", "raw", "places").mapInArrow(partial(_contexts, length=length), _CONTEXT_SCHEMA), "contexts")
    sizes = contexts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    hot = materialize(sizes.filter(F.col("n") > HOT).select("key"), "hot-contexts")
    spans = found.filter("not ask")
    if not hot.isEmpty():
        spans = spans.unionAll(_hot_spans(contexts.join(hot, "key", "left_semi").select(_CONTEXT), length))
        contexts = contexts.join(hot, "key", "left_anti").select(_CONTEXT)
    compared = contexts.repartition(parts, "key").sortWithinPartitions("key", "doc", "dk", "at").mapInArrow(partial(_compare, length=length), _FOUND_SCHEMA)
    return spans.unionAll(compared).select("doc", "dk", "start", "end")


def united(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def _united_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each batch, united where they touch: far fewer rows to shuffle."""
    for b in batches:
        parts = _united(*(b.column(c).to_numpy() for c in ("doc", "dk", "start", "end")))
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["doc", "dk", "start", "end"])


def _apply(batches: Iterator[pa.RecordBatch], digests: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The last two columns, zipped texts and spans, become the results, of these names."""
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        *carried, texts, spans_of = b.columns
        sizes, gone, counts, kept = [], [], [], []
        for packed, spans in zip(texts, spans_of, strict=True):
            raw, spans = unpacker.decompress(packed.as_py()), united(spans.as_py() or [])
            left = _cut(raw, spans)
            sizes.append(len(raw))
            gone.append(len(raw) - len(left))
            counts.append(len(spans))
            # A cut may go through a character, whose other bytes go with it.
            kept.append(hashlib.sha256(left).hexdigest() if digests else left.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([*carried, *(pa.array(x, pa.int64()) for x in (sizes, gone, counts)), pa.array(kept, pa.string())], [*b.schema.names[:-2], *names])


def _applied(docs: DataFrame, length: int, digests: bool, names: list[str], *carried: str) -> DataFrame:
    """The carried columns, and under these names: bytes, removed bytes, spans, and what is kept."""
    doc, dk, raw, at_doc, at_dk, spans = own_names(docs, "doc", "dk", "raw", "at_doc", "at_dk", "spans")
    found = materialize(repeated_spans(docs, length), "spans").mapInArrow(_united_spans, "doc long, dk int, start long, end long")
    found = found.groupBy(F.col("doc").alias(at_doc), F.col("dk").alias(at_dk)).agg(F.collect_list(F.struct("start", "end")).alias(spans))
    kept = [F.col(f"`{c}`") for c in carried]
    rows = _placed(docs, doc, dk, raw).select(*kept, doc, dk, raw)
    zipped = rows.mapInArrow(partial(_squeeze, raw=raw), rows.schema)
    met = zipped.join(found, (F.col(doc) == F.col(at_doc)) & (F.col(dk) == F.col(at_dk)), "left").select(*kept, raw, spans)
    return met.mapInArrow(partial(_apply, digests=digests, names=names), StructType([*met.schema.fields[:-2], *(StructField(n, LongType()) for n in names[:-1]), StructField(names[-1], StringType())]))


def digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _applied(docs, length, True, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], "doc_id")


def remove_repeated(docs: DataFrame, length: int = 100) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts; those that lost all of it are dropped."""
    others = [c for c in docs.columns if c != "text"]
    names = own_names(docs, "n_bytes", "n_removed", "n_spans", "kept")
    out = _applied(docs, length, False, names, *others).filter((F.col(names[1]) == 0) | (F.trim(names[3]) != ""))
    return out.withColumn("text", F.col(names[3])).select(*(F.col(f"`{c}`") for c in docs.columns))
