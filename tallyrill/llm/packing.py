"""Packing documents into sequences of bounded length.

Each document is tokenised where it lies; what moves on are rows of a few numbers. A document longer than a sequence is cut
into pieces of the full length and a rest. Full pieces are sequences of their own. The others are dealt out evenly into
groups of about ``group_rows`` (by a hash of the row's number), and every group is packed by itself: best fit by falling
length, then local search between underfull bins. A group loses less than one sequence against what its tokens need,
however many groups there are.

Local search: the emptiest bin gives up documents. It moves one into another underfull bin, exchanges one of its documents
for a shorter one, or two of them for one shorter than both together. Each step makes the sum of squared fills grow, so the
search ends; emptied bins vanish.

Nulls: a null text counts as empty and still has its end token; a null id is a value like others. Repeated rows are packed
each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, utf8
from .tokens import SpacedWords, encoder, slices

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit by falling length: bins of indices. Free space is a bit set of spaces that some bin has."""
    bins: list[list[int]] = []
    of_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = of_space[space].pop()
            if not of_space[space]:
                spaces &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        if space > n:
            of_space[space - n].append(b)
            spaces |= 1 << (space - n)
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int, most_failures: int = 200) -> list[list[int]]:
    """Exchange between underfull bins until as few bins as the total needs are left, or ``most_failures`` bins can give up nothing more."""
    need = -(-int(lengths.sum()) // capacity)
    fill = {b: int(lengths[x].sum()) for b, x in enumerate(bins)}
    stuck: set[int] = set()
    left = len(bins)
    while left > need and len(stuck) < most_failures:
        under = [b for b, f in fill.items() if f < capacity and b not in stuck]
        if len(under) < 1:
            break
        src = min(under, key=lambda b: (fill[b], b))
        others = [b for b, f in fill.items() if f < capacity and b != src and f >= fill[src]]
        if not others:
            stuck.add(src)
            continue
        space = np.array([capacity - fill[b] for b in others])
        owner = np.repeat(np.arange(len(others)), [len(bins[b]) for b in others])
        items = np.array([i for b in others for i in bins[b]])
        theirs, room = lengths[items], space[owner]
        best = (0, None)
        own = sorted(bins[src], key=lambda i: -lengths[i])
        # Moves: the tightest bin for the longest document that fits anywhere.
        for i in own:
            fits = np.flatnonzero(space >= lengths[i])
            if len(fits):
                best = (int(lengths[i]), ([i], None, others[fits[np.argmin(space[fits])]]))
                break
        # Exchanges of one or two documents for one: the largest gain that still fits.
        pairs = [[i] for i in own] + [[i, j] for k, i in enumerate(own[:40]) for j in own[k + 1 : 40]]
        for give in pairs[:400]:
            gain = int(lengths[give].sum()) - theirs
            good = np.flatnonzero((gain > best[0]) & (gain <= room))
            if len(good):
                k = good[np.argmax(gain[good])]
                best = (int(gain[k]), (give, int(items[k]), others[owner[k]]))
        if best[1] is None:
            stuck.add(src)
            continue
        give, take, dst = best[1]
        bins[src] = [i for i in bins[src] if i not in give] + ([] if take is None else [take])
        bins[dst] = [i for i in bins[dst] if i != take] + list(give)
        fill[src] -= best[0]
        fill[dst] += best[0]
        stuck.discard(dst)
        if not bins[src]:
            del fill[src]
            left -= 1
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each length; lengths are 1 to ``capacity``."""
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        which[items] = b
        offset[items] = np.cumsum(lengths[items]) - lengths[items]
    return which, offset


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    coder, end = encoder(SpacedWords, path), end_id.to_bytes(4, "little")
    step = 4 * capacity
    for b in batches:
        raws = b.column("raw").to_pylist()
        for i, j in slices(raws):
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(coder.encode(raws[i:j]), i):
                ids += end
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECE_SCHEMA}"
    return docs.select("doc_id", utf8("text").alias("raw")).mapInArrow(partial(_pieces, path=path, capacity=capacity, end_id=end_id), schema)


def _pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values("__uid", ignore_index=True)  # the same packing on each run
    which, offset = pack_lengths(rows["length"].to_numpy(), capacity)
    return rows.drop(columns=["__grp", "__uid"]).assign(sequence_id=rows["__grp"].to_numpy(np.int64) * (1 << 32) + which, offset=offset)


def pack(parts: DataFrame, capacity: int = 4096, group_rows: int = 20_000) -> DataFrame:
    """The rows of ``parts`` (with a long column ``length``, 1 to ``capacity``), with sequence_id and offset."""
    stored = materialize(parts.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    loose = stored.filter(F.col("length") < capacity)
    groups = max(1, -(-loose.count() // group_rows))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"
    packed = loose.withColumn("__grp", F.pmod(F.xxhash64("__uid"), F.lit(groups))).groupBy("__grp").applyInPandas(partial(_pack_group, capacity=capacity), schema)
    # Negative numbers: the full pieces.
    full = stored.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("__uid")).withColumn("offset", F.lit(0).cast("long")).drop("__uid")
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, group_rows: int = 20_000) -> DataFrame:
    """The pieces of ``docs`` and where they are: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, capacity, end_id), capacity, group_rows)
