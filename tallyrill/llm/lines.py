"""Fuzzy deduplication of lines by MinHash.

Lines count by their normal form: lower case, without white space at the ends. The shingles of a line are its runs of
``k`` characters (a shorter line: the line itself). One permutation hashing gives a signature of ``bands * rows`` minima in one pass,
and empty bins borrow from their neighbours. Lines that agree in one band are candidates: groups of up to ``SMALL`` lines pair all of
them, and in larger ones each is first paired with the line that is in the most of such groups. Every pair is checked once. A larger
group whose lines are not all in one component by then is compared by itself, every line with every other one that is not in its component.
There a bit set of each line's shingles first gives a bound that no similarity exceeds; what may be similar is checked exactly.
A pair becomes a link if the Jaccard similarity of the shingle sets is at least ``similarity``.
Union by alternating stars makes components, of which the first line stays, in the order of ids, then of line numbers; all
other occurrences go, exact copies among them.

Bands are exchanged as sorted blocks, one for each task and part. A task keeps only a few lines of a band that many of its lines share
for the part, and sends the others straight to the group, so no part holds a group that is hot. Groups of much text are dealt out by
pairs of blocks; lines of the group's largest component are compared with the others alone.

Blank lines take no part and stay. Null texts have no lines. A document of which every line that is not blank went is dropped
by ``drop_repeated_lines``. Null ids come last in order. Rows with equal id and text cannot be told apart: they keep the same lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, own_names, partitions, utf8
from .components import components
from .winnowing import rolling_hashes

#: Characters that are hashed at a time: what fits a core's cache.
BLOCK = 1 << 17
#: Groups of up to so many lines send on all their pairs.
SMALL = 6
#: Characters of a large group's lines that one task compares with as many others.
PART = 1 << 20
#: Lines of a task that are held at a time; lines that it remembers to have seen; and lines of one band that it sends to the band's part.
HELD = 1 << 15
SEEN = 1 << 18
FEW = 64
#: Entries of bands that a part should hold.
PART_BANDS = 1 << 20
#: Bits of a shingle's hash; lines of a tile.
BITS = 44
TILE = 256


def normal(line: str) -> str:
    return line.strip().lower()


def shingles(line: str, k: int) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def _grams(lines: list[str], k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and the number of the line each is of."""
    padded = [x if len(x) >= k else x.ljust(k, "\0") for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    with np.errstate(over="ignore"):
        h = rolling_hashes(codes, k, bits)
    owner = np.repeat(np.arange(len(lines)), lengths)[: len(h)]
    inside = np.arange(len(h)) + k <= np.cumsum(lengths)[owner]
    return h[inside], owner[inside]


def _blocks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about BLOCK characters."""
    start = size = 0
    for i, x in enumerate(lines, 1):
        size += len(x)
        if size >= BLOCK:
            yield start, i
            start, size = i, 0
    if start < len(lines):
        yield start, len(lines)


def signatures(lines: list[str], k: int, bands: int, rows: int) -> np.ndarray:
    """The band hashes of each line: an int32 array of lines by bands."""
    return np.concatenate([np.zeros((0, bands), np.int32), *(_signatures(lines[i:j], k, bands, rows) for i, j in _blocks(lines))])


def _signatures(lines: list[str], k: int, bands: int, rows: int) -> np.ndarray:
    bins = bands * rows
    h, owner = _grams(lines, k, 32)
    with np.errstate(over="ignore"):
        least = np.full(len(lines) * bins, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, owner * bins + (h * np.uint64(bins) >> np.uint64(32)).astype(np.int64), (h * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        least = least.reshape(len(lines), bins)
        poor = np.flatnonzero((least == 0xFFFFFFFF).any(axis=1))
        part = least[poor]
        while len(part) and (empty := part == 0xFFFFFFFF).any():
            part = np.where(empty, np.where((left := np.roll(part, 1, axis=1)) == 0xFFFFFFFF, left, left * np.uint32(0x85EBCA6B) >> np.uint32(1)), part)
        least[poor] = part
        out = np.zeros((len(lines), bands), np.uint64)
        for r in range(rows):
            out = (out ^ least[:, r::rows]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Sets:
    """The sets of shingles of some lines, as sorted hashes: of line i those from ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, lines: list[str], k: int):
        self.lines, self.k = lines, k
        parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in _blocks(lines):
            h, owner = _grams(lines[i:j], k, BITS)
            keys = np.sort((owner.astype(np.uint64) << np.uint64(BITS)) | h)
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            sizes.append(np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=j - i))
            parts.append(keys & np.uint64((1 << BITS) - 1))
        self.hashes, self.sizes = np.concatenate(parts), np.concatenate(sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def _of(self, which: np.ndarray) -> np.ndarray:
        """The hashes of these lines, each with the line's place in ``which`` above it."""
        n = self.sizes[which]
        place = np.repeat(np.arange(len(which)), n)
        at = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + self.starts[which][place]
        return (place.astype(np.uint64) << np.uint64(BITS)) | self.hashes[at]

    def similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether each pair of lines is similar. Where a few equal hashes of different shingles would matter, the shingles themselves decide."""
        out = np.zeros(len(a), bool)
        work = np.cumsum(self.sizes[a] + self.sizes[b]) >> 18
        for at, end in zip(*(np.flatnonzero(np.diff(work, **edge)) for edge in ({"prepend": -1}, {"append": -1})), strict=True):
            x, y = a[at : end + 1], b[at : end + 1]
            both = np.sort(np.concatenate([self._of(x), self._of(y)]))
            shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(BITS)).astype(np.int64), minlength=len(x))
            over = shared * (1 + similarity) - similarity * (self.sizes[x] + self.sizes[y])
            out[at : end + 1] = over >= 0
            for i in np.flatnonzero(np.abs(over) <= 2).tolist():
                one, two = shingles(self.lines[x[i]], self.k), shingles(self.lines[y[i]], self.k)
                n = len(one & two)
                out[at + i] = n >= similarity * (len(one) + len(two) - n)
        return out

    def bits(self) -> np.ndarray:
        """A bit set of each line's shingles: an array of lines by 64-bit words, 16 bits or more for each shingle of most lines."""
        width = 1 << min(13, max(8, int(16 * np.median(self.sizes)).bit_length()))
        out = np.zeros((len(self.lines), width // 64), np.uint64)
        for i in range(0, len(self.lines), TILE):
            n = min(TILE, len(self.lines) - i)
            flat = np.zeros(n * width, bool)
            flat[np.repeat(np.arange(n), self.sizes[i : i + n]) * width + (self.hashes[self.starts[i] : self.starts[i + n]] & np.uint64(width - 1)).astype(np.int64)] = True
            out[i : i + n] = np.packbits(flat, bitorder="little").view(np.uint64).reshape(n, -1)
        return out


def _occurrences(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: the occurrences of lines; and signs, blocks of lines' numbers and band hashes, each line once for each task if it can be."""
    names = ["doc_id", "dk", "line_no", "h", "lid", "signs"]
    seen: set[int] = set()
    fresh: dict[int, str] = {}

    def signed(kind: pa.DataType) -> pa.RecordBatch:
        block = np.array(list(fresh), np.int64).tobytes() + signatures(list(fresh.values()), k, bands, rows).tobytes()
        if len(seen) > SEEN:
            seen.clear()
        seen.update(fresh)
        fresh.clear()
        return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([block], pa.binary())], names)

    def made(b: pa.RecordBatch, row: list[int], number: list[int], h: list[bytes], lid: list[int]) -> pa.RecordBatch:
        at = pa.array(row, pa.int32())
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("dk").take(at), pa.array(number, pa.int32()), pa.array(h, pa.binary()), pa.array(lid, pa.int64()), pa.nulls(len(row), pa.binary())], names)

    kind = pa.null()
    for b in batches:
        kind = b.column("doc_id").type
        row, number, hs, lids = [], [], [], []
        for i, raw in enumerate(b.column("raw")):
            for n, line in enumerate(raw.as_py().decode("utf-8", "replace").split("\n")):
                line = normal(line)
                if line:
                    h = xxhash.xxh3_128_digest(line)
                    lid = int.from_bytes(h[:6], "little")
                    row.append(i)
                    number.append(n)
                    hs.append(h)
                    lids.append(lid)
                    if lid not in seen:
                        fresh[lid] = line
                    if len(row) >= HELD or len(fresh) >= HELD:
                        yield made(b, row, number, hs, lids)
                        row, number, hs, lids = [], [], [], []
                        if len(fresh) >= HELD:
                            yield signed(kind)
        yield made(b, row, number, hs, lids)
    if fresh:
        yield signed(kind)


_MIX = 0x9E3779B97F4A7C15


def _banded(batches: Iterator[pa.RecordBatch], bands: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of signs become blocks of band keys and lines, sorted, one for each part. A part below zero holds lines that are known to be in large groups."""
    with np.errstate(over="ignore"):
        for b in batches:
            for block in b.column("signs"):
                raw = block.as_py()
                n = len(raw) // (8 + 4 * bands)
                signs = np.frombuffer(raw, np.uint32, n * bands, 8 * n).reshape(n, bands)
                key = (((np.arange(bands, dtype=np.uint64) << np.uint64(32))[None] | signs) * np.uint64(_MIX)).reshape(-1)
                lid = np.repeat(np.frombuffer(raw, np.int64, n), bands)
                order = np.argsort(key, kind="stable")
                key, lid = key[order], lid[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                place = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                more = place >= FEW
                names, blocks = [], []
                if more.any():
                    names, blocks = [-1 - int(lid[0] % parts)], [key[more].tobytes() + lid[more].tobytes()]
                    key, lid = key[~more], lid[~more]
                part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    names.append(int(part[i]))
                    blocks.append(key[i:j].tobytes() + lid[i:j].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])


def _unblocked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([np.frombuffer(b, t, len(b) // 16, o * len(b) // 2) for b in blocks]) for o, t in ((0, np.uint64), (1, np.int64)))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part. Pairs (a, b) of small groups; of large ones each line (a) with the group's key."""

    def rows(a: np.ndarray, b: np.ndarray, lid: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        pair = np.arange(len(a) + len(lid)) < len(a)
        columns = np.concatenate([a, lid]), np.concatenate([b, lid]), np.concatenate([a, key.view(np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=~pair), pa.array(columns[2], mask=pair)], ["a", "b", "key"])

    def grouped(blocks: list[bytes]) -> pa.RecordBatch:
        key, lid = _unblocked(blocks)
        order = np.lexsort((lid, key))
        key, lid = key[order], lid[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (lid[1:] != lid[:-1])])
        key, lid = key[once], lid[once]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(key)))[np.cumsum(new) - 1]
        key, lid, place, size = (x[size > 1] for x in (key, lid, np.arange(len(key)) - starts[np.cumsum(new) - 1], size))
        big = size > SMALL
        ends = [np.flatnonzero((place >= back) & ~big) for back in range(1, SMALL)]
        a, b = (np.concatenate([lid[at - back * first] for back, at in enumerate(ends, 1)]) for first in (1, 0))
        return rows(a, b, lid[big], key[big])

    now, held, none = None, [], np.zeros(0, np.int64)
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
            if part < 0:
                key, lid = _unblocked([block.as_py()])
                yield rows(none, none, lid, key)
                continue
            if part != now and held:
                yield grouped(held)
                held = []
            now = part
            held.append(block.as_py())
    if held:
        yield grouped(held)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each text. Rows that repeat come one after the other and count once; were one to come later, its pairs would just be checked again."""
    last = None
    for b in batches:
        lids, hs, texts = [], [], []
        for doc_id, dk, raw, wanted in zip(b.column("doc_id").to_pylist(), b.column("dk").to_pylist(), b.column("raw"), b.column("wanted"), strict=True):
            if (doc_id, dk) == last:
                continue
            last = (doc_id, dk)
            lines = raw.as_py().decode("utf-8", "replace").split("\n")
            for w in wanted.as_py():
                lids.append(w["lid"])
                hs.append(w["h"])
                texts.append(normal(lines[w["line_no"]]))
        yield pa.RecordBatch.from_arrays([pa.array(lids, pa.int64()), pa.array(hs, pa.binary()), pa.array(texts, pa.string())], ["lid", "h", "line"])


def _verify(batches: Iterator[pa.RecordBatch], k: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs that are similar."""
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            index: dict[bytes, int] = {}
            texts: list[str] = []
            ends = []
            for h, t in (("ha", "ta"), ("hb", "tb")):
                names = part.column(h).to_pylist()
                for name, text in zip(names, part.column(t), strict=True):
                    if name not in index:
                        index[name] = len(texts)
                        texts.append(text.as_py())
                ends.append(np.array([index[name] for name in names], np.int64))
            good = pa.array(np.flatnonzero(Sets(texts, k).similar(*ends, similarity)))
            yield pa.RecordBatch.from_arrays([part.column("ha").take(good), part.column("hb").take(good)], ["a", "b"])


def group_links(roots: list[bytes], sides: list[int], lines: list[str], k: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links of roots (components so far) that have similar lines; sides: 0 is compared within, or 1 with 2."""
    sets = Sets(lines, k)
    order = np.argsort(sets.sizes, kind="stable")
    bits = sets.bits()[order]
    sizes, side = sets.sizes[order], np.array(sides)[order]
    lost = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    root = np.array([names[r] for r in roots])[order]
    out: list[tuple[bytes, bytes]] = []
    n = len(lines)
    for i in range(0, n, TILE):
        x = slice(i, min(n, i + TILE))
        for j in range(i, n, TILE):
            y = slice(j, min(n, j + TILE))
            if sizes[x][-1] < similarity * sizes[j] - 2:
                break  # the longer ones are too long for all of these
            near = root[x][:, None] != root[None, y]
            near &= (side[x][:, None] == 0) | (side[x][:, None] != side[None, y])
            if i == j:
                near &= np.arange(x.stop - i)[:, None] < np.arange(y.stop - j)[None]
            rows, columns = (np.flatnonzero(near.any(axis=axis)) for axis in (1, 0))
            if not len(rows):
                continue
            shared = np.zeros((len(rows), len(columns)), np.int64)
            step = max(1, (1 << 17) // shared.size)
            for w in range(0, bits.shape[1], step):
                shared += np.bitwise_count(bits[i + rows, w : w + step][:, None] & bits[j + columns, w : w + step][None]).sum(axis=2, dtype=np.int64)
            shared += np.minimum(lost[i + rows][:, None], lost[j + columns][None]) + 2
            near = near[np.ix_(rows, columns)] & (shared * (1 + similarity) >= similarity * (sizes[i + rows][:, None] + sizes[j + columns][None]))
            a, b = i + rows, j + columns
            while near.any():
                p = np.flatnonzero(near.any(axis=1))
                q = near[p].argmax(axis=1)
                near[p, q] = False
                good = sets.similar(order[a[p]], order[b[q]], similarity)
                for u, v in zip(a[p][good].tolist(), b[q][good].tolist(), strict=True):
                    if root[u] != root[v]:
                        out.append((roots[order[u]], roots[order[v]]))
                        root[root == root[v]] = root[u]
                near &= root[a][:, None] != root[None, b]
    return out


def _group_links(batches: Iterator[pa.RecordBatch], k: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and unit."""

    def found(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
        links = group_links(*map(list, zip(*rows, strict=True)), k, similarity) if len({r[0] for r in rows}) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    now, rows = None, []
    for b in batches:
        for key, unit, root, side, line in zip(*(b.column(c) for c in ("key", "unit", "root", "side", "line")), strict=True):
            if (key.as_py(), unit.as_py()) != now:
                if rows:
                    yield found(rows)
                now, rows = (key.as_py(), unit.as_py()), []
            rows.append((root.as_py(), side.as_py(), line.as_py()))
    if rows:
        yield found(rows)


def _stars(large: DataFrame) -> DataFrame:
    """Pairs (a, b) of each line of the large groups (key, lid) and the group's line that is in the most of them.

    Copies of one line need not be near each other, but each shares bands with that line, which so is in more groups than they.
    Where that is not so, ``_rest`` finds what these pairs miss.
    """
    ranked = large.join(materialize(large.groupBy("lid").agg(F.count("*").alias("n")), "line-ranks"), "lid")
    middle = materialize(ranked.groupBy("key").agg(F.max(F.struct("n", (-F.col("lid")).alias("less"))).alias("m")).select("key", (-F.col("m.less")).alias("to")), "line-middles")
    return large.join(middle, "key").filter("lid <> to").select(F.least("lid", "to").alias("a"), F.greatest("lid", "to").alias("b"))


def _rest(large: DataFrame, texts: DataFrame, found: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) of roots that are missing in ``found`` (h, root), in large groups whose lines have more roots than one.

    Groups of much text are dealt out: lines of the most frequent root and the others by hashes into blocks, and each pair of blocks by
    itself, but for those of the most frequent root.
    """
    rooted = texts.select("lid", "h", F.length("line").alias("size")).join(found, "h", "left").select("lid", "h", "size", F.coalesce("root", "h").alias("root"))
    members = materialize(large.join(materialize(rooted, "line-rooted"), "lid"), "line-members")
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sums = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("main")).filter("roots > 1")
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / PART)).cast("int")
    whole = F.col("size") <= PART
    sums = sums.select("key", F.col("main.root").alias("main"), F.when(whole, 0).otherwise(blocks(F.col("main.size"))).alias("mains"), F.when(whole, 0).otherwise(blocks(F.col("size") - F.col("main.size"))).alias("others"))
    met = members.drop("size").join(materialize(sums, "line-open"), "key")
    block = lambda n: F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.col(n))).cast("int")
    own, unit = block("others"), lambda i, j: (i.cast("long") * (1 << 32) + j).alias("unit")
    # Units (i, j) of others have i <= j < others; those of others with main lines have j >= others.
    to_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(unit(F.least(own, j), F.greatest(own, j)), F.when(j == own, 0).when(own < j, 1).otherwise(2).alias("side")))
    to_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(unit(own, F.col("others") + j), F.lit(1).alias("side")))
    from_mains = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(unit(i, F.col("others") + block("mains")), F.lit(2).alias("side")))
    units = F.when(F.col("others") == 0, F.array(F.struct(F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side")))).when(F.col("root") == F.col("main"), from_mains).otherwise(F.concat(to_others, to_mains))
    dealt = met.withColumn("u", F.explode(units)).select("key", "u.*", "root", "h").join(texts.select("h", "line"), "h").select("key", "unit", "side", "root", "line")
    return dealt.repartition("key", "unit").sortWithinPartitions("key", "unit").mapInArrow(partial(_group_links, k=k, similarity=similarity), "a binary, b binary")


_LINE_KEY = ("doc_id", "dk")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("dk", F.xxhash64("text"))


def _occurrence():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "dk")


def repeated_lines(docs: DataFrame, k: int = 8, similarity: float = 0.8, bands: int = 12, rows: int = 4) -> DataFrame:
    """The lines that go, for each id and text of ``docs`` (doc_id, text) that loses any: doc_id, dk (hash of the text), gone (line numbers)."""
    keyed = _keyed(docs.select("doc_id", "text")).select(*_LINE_KEY, utf8("text").alias("raw"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = materialize(keyed.mapInArrow(partial(_occurrences, k=k, bands=bands, rows=rows), f"doc_id {kind}, dk long, line_no int, h binary, lid long, signs binary"), "line-hashes")
    occ, signs = both.filter("lid is not null").drop("signs"), both.filter("signs is not null").select("signs")
    entries = signs.agg(F.sum(F.octet_length("signs"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), bands * entries // (8 + 4 * bands) // PART_BANDS)
    banded = signs.mapInArrow(partial(_banded, bands=bands, parts=parts), "part int, block binary")
    groups = materialize(banded.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_candidates, "a long, b long, key long"), "line-groups")
    large = groups.filter("key is not null").select("key", F.col("a").alias("lid")).distinct()
    pairs = materialize(groups.filter("key is null").select("a", "b").unionAll(_stars(large)).distinct(), "line-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    where = occ.select("lid", "h", _occurrence().alias("o")).join(wanted, "lid", "left_semi").groupBy("lid", "h").agg(F.min("o").alias("o"))
    by_doc = where.groupBy("o.doc_id", "o.dk").agg(F.collect_list(F.struct("lid", "h", F.col("o.line_no").alias("line_no"))).alias("wanted"))
    by_doc = by_doc.select(F.col("doc_id").alias("id"), F.col("dk").alias("key"), "wanted")
    texts = keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("dk") == F.col("key"))).select("doc_id", "dk", "raw", "wanted").mapInArrow(_pick, "lid long, h binary, line string")
    texts = materialize(texts, "line-texts")  # two lines that share a number are told apart by h
    one, two = (texts.select(F.col("lid").alias(i), F.col("h").alias(f"h{i}"), F.col("line").alias(f"t{i}")) for i in "ab")
    met = pairs.join(one, "a").join(two, "b").select("ha", "ta", "hb", "tb")
    found = components(met.mapInArrow(partial(_verify, k=k, similarity=similarity), "a binary, b binary"))
    found = materialize(found.select(F.col("node").alias("h"), "root"), "line-roots")
    rest = materialize(_rest(large, texts, found, k, similarity), "line-rest")
    if not rest.isEmpty():
        tree = materialize(components(rest), "line-root-roots")  # of roots, so its roots are the smallest of all
        moved = found.join(tree.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("h", F.coalesce("to", "root").alias("root"))
        found = materialize(moved.unionAll(tree.select(F.col("node").alias("h"), "root")), "line-roots")
    # Lines that are alone in every sense need no more looking at.
    alike = found.select("h").unionAll(found.select(F.col("root").alias("h"))).distinct().withColumn("linked", F.lit(True))
    classes = occ.groupBy("h").agg(F.min(_occurrence()).alias("o"), F.count("*").alias("n")).join(alike, "h", "left").filter("n > 1 or linked").join(found, "h", "left").select("h", "o", F.coalesce("root", "h").alias("root"))
    classes = materialize(classes, "line-classes")
    # Written tables on one side let adaptive execution split a line or component with very many rows on the other.
    first = materialize(classes.groupBy("root").agg(F.min("o").alias("stays")), "line-firsts")
    stays = materialize(classes.select("h", "root").join(first, "root").select("h", "stays"), "line-stays")
    judged = occ.select("h", "doc_id", "dk", "line_no", _occurrence().alias("own")).join(stays, "h")
    return judged.filter(~F.col("own").eqNullSafe(F.col("stays"))).groupBy(*_LINE_KEY).agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def report(docs: DataFrame, **how) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_lines, n_removed, removed_lines (numbers from 0, joined by commas)."""
    counted = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("n_lines")).withColumn("dk", F.xxhash64("text")).drop("text")
    gone = repeated_lines(docs, **how).select(F.col("doc_id").alias("id"), F.col("dk").alias("key"), "gone")
    met = counted.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("dk") == F.col("key")), "left")
    return met.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts; those of which nothing but blank lines is left are dropped if they lost any."""
    own, at, key, gone = own_names(docs, "hash", "id", "key", "gone")
    lines = materialize(repeated_lines(docs, **how), "lines-gone").select(F.col("doc_id").alias(at), F.col("dk").alias(key), F.col("gone").alias(gone))
    met = docs.withColumn(own, F.xxhash64("text")).join(lines, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(own) == F.col(key)), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = met.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    out = out.filter(F.col(gone).isNull() | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
