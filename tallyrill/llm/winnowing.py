"""Document fingerprints by winnowing.

Every k-gram of characters gets a rolling hash. Of each window of ``window`` consecutive hashes the smallest is chosen, the
rightmost of equal ones; the fingerprint is the set of chosen hashes, with the positions where they were chosen. Any match
of at least ``window + k - 1`` characters shares a chosen hash, and none shorter than k is ever seen.

A text of fewer than k characters has the hash of the whole text at position 0; an empty one has an empty fingerprint. Texts
of fewer than ``window`` k-grams are one window. Null texts count as empty. The likeness of two fingerprints is the share of
hashes in both among those in either (1.0 for two empty ones).

``fingerprint_edits`` looks at neighbours in the order of ids. Null ids come first, and equal ids follow the order of their
texts. Every task gets a range of ids, and the first row of the next range besides, so each text is shuffled once and only
the rows that begin a range are sent twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import partitions, utf8

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Hashes that are computed at a time; blocks overlap by a window.
_BLOCK = 1 << 18


def rolling_hashes(codes: np.ndarray, k: int, bits: int = 32) -> np.ndarray:
    """A hash of each k-gram: sums of powers, put together from those of shorter grams by doubling."""
    sums, width, power = {}, 1, _BASE
    h = codes.astype(np.uint64) + np.uint64(1)
    powers = {1: power}
    while True:
        sums[width] = h
        if width * 2 > k:
            break
        h = h[: len(h) - width] * powers[width] + h[width:]
        powers[width * 2] = powers[width] * powers[width]
        width *= 2
    total, done = None, 0
    n = len(codes) - k + 1
    for width in sorted(sums, reverse=True):
        if k & width:
            part = sums[width][done : done + n]
            total = part if total is None else total * powers[width] + part
            done += width
    total = (total ^ (total >> np.uint64(33))) * _MIX
    return (total ^ (total >> np.uint64(29))) & np.uint64((1 << bits) - 1)


def _sliding_least(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each window, by doubling."""
    width = 1
    while width * 2 <= window:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = window - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def winnow(text: str, k: int = 32, window: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes and their positions, by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, len(codes))
    grams = len(codes) - k + 1
    window = min(window, grams)
    low = np.uint64(0xFFFFFFFF)
    chosen = []
    with np.errstate(over="ignore"):
        for at in range(0, grams - window + 1, _BLOCK):
            end = min(grams, at + _BLOCK + window - 1)
            h = rolling_hashes(codes[at : end + k - 1], k)
            # Equal hashes: the larger position has the smaller key.
            key = (h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))
            least = _sliding_least(key, window)
            least = least[np.flatnonzero(np.diff(least, prepend=~least[:1]))]
            chosen.append(np.stack([least >> np.uint64(32), low - (least & low) + np.uint64(at)]))
    both = np.concatenate(chosen, axis=1)
    both = both[:, np.flatnonzero(np.diff(both[1], prepend=both[1][:1] + np.uint64(1)))]  # blocks may choose the same one
    return both[0].astype(np.uint32), both[1].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared among all, of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [winnow(t.decode("utf-8", "replace"), k, window) for t in b.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])


def fingerprints(docs: DataFrame, k: int = 32, window: int = 64) -> DataFrame:
    """doc_id, hashes and positions for each row of ``docs`` (doc_id, text), in the order of positions. No shuffle."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hashes array<long>, positions array<long>"
    return docs.select("doc_id", utf8("text").alias("raw")).mapInArrow(partial(_fingerprints, k=k, window=window), schema)


def _edit_range(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of ranges, in order, each range followed by the row after it (``guard``); each row is paired with the next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last, ended = None, None  # last: (id, text, hashes) that waits for the next row; ended: a range whose guard has been used
    for b in batches:
        rows = []
        for part, doc_id, guard, raw in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("guard").to_pylist(), b.column("raw").to_pylist(), strict=True):
            if guard and ended == part:
                continue  # rows of the same id as the guard
            text = raw.decode("utf-8", "replace")
            hashes = np.unique(winnow(text, k, window)[0])
            if last is not None:
                own, mine = last[1], last[2]
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                theirs = np.unique(winnow(edited, k, window)[0])
                rows.append((last[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), _hex(mine), _hex(theirs), likeness(mine, theirs), likeness(mine, hashes)))
            last = None if guard else (doc_id, text, hashes)
            ended = part if guard else ended
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind or b.schema.field("doc_id").type) for i, kind in enumerate(kinds)], names)


def fingerprint_edits(docs: DataFrame, k: int = 32, window: int = 64) -> DataFrame:
    """For each row of ``docs`` (doc_id, text), of its text and of the text whose last half is replaced by the next row's beginning.

    The last floor(n_chars / 2) characters are replaced by the first as many of the next row (or all it has), in the order
    of ids; the last row's next is the first. Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint
    (eight hexadecimal digits for each chosen hash, in ascending order), near_edited, near_next.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select("doc_id", order.alias("okey"), "text")
    marks = keyed.agg(F.min("okey").alias("first"), F.percentile_approx("okey", [i / count for i in range(1, count)] or [0.5], max(10_000, 10 * count)).alias("marks")).first()
    first = marks["first"] if marks["first"] is not None else 0
    # Ids that begin a range; each is the id of a row, so no range is empty.
    starts = sorted({m for m in marks["marks"] or [] if m > first})
    ranges = F.array(*map(F.lit, starts)).cast("array<long>")
    part = F.when(F.lit(not starts), F.lit(0)).otherwise(F.size(F.filter(ranges, lambda s: s <= F.col("okey"))))
    begins = F.array_contains(ranges, F.col("okey")) if starts else F.lit(False)
    nothing = F.lit(None).cast("struct<part:int,guard:boolean>")
    places = F.array(
        F.struct(part.cast("int").alias("part"), F.lit(False).alias("guard")),
        F.when(begins, F.struct((part - 1).cast("int").alias("part"), F.lit(True).alias("guard"))).otherwise(nothing),
        F.when(F.col("okey") == first, F.struct(F.lit(len(starts)).alias("part"), F.lit(True).alias("guard"))).otherwise(nothing),
    )
    dealt = keyed.select("doc_id", "okey", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("at"), "text").select("at.*", "doc_id", "okey", utf8("text").alias("raw"))
    ordered = dealt.repartition(len(starts) + 1, "part").sortWithinPartitions("part", "guard", "okey", "raw")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("part", "doc_id", "guard", "raw").mapInArrow(partial(_edit_range, k=k, window=window), schema)
