"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit for each bit of 64 that is set in more than half of the text's shingle hashes. Equal fingerprints
are one class. Distinct ones are compared exactly: tables of blocks of bits bring those together that agree on some blocks,
of which any two within the radius share at least one (pigeonhole), so no link is lost. Inside a block's
group fingerprints are sorted by how many bits they have, cut into tiles, and compared tile against tile by exclusive-or and
bit counts; tile pairs whose counts differ by more than the radius are skipped. A group sends on a spanning forest of its links,
not the links. Union by alternating stars joins the forests.

The more fingerprints there are, the more blocks must agree (of ``tables``: the first of which groups stay small on average), so the
work grows in proportion to the input. Groups over ``hot`` fingerprints are split by bit counts into pairs of slices that
are dealt out by themselves.

Words are runs of bytes other than ASCII white space, after A-Z have become a-z. A text of fewer words than a shingle has one
shingle of all its words; one without words has fingerprint zero, which links like any other. Null texts count as empty. Repeated
rows and null ids are rows like others (a component's id is its smallest id that is not null).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ._shared import materialize, own_names, utf8
from .components import components, local_roots

#: Rows of a table's group that are wanted at most on average; of a tile; and of a group that one task compares.
GROUP_ROWS = 4096
TILE = 1024
HOT_ROWS = 32_768
#: Shingles of the sets of a least shingle's group that one task compares with as many others.
HOT_SHINGLES = 1 << 23


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, text = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(text, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(text[i:j], 42) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(shingle_hashes(r, width)) for r in b.column("__raw").to_pylist()], np.uint64).view(np.int64)
        keep = [i for i, n in enumerate(b.schema.names) if n != "__raw"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(prints)], [*(b.schema.names[i] for i in keep), "__fp"])


def with_fingerprints(docs: DataFrame, *carried: str, width: int = 4) -> DataFrame:
    """The carried columns of ``docs`` and __fp, the fingerprint as a signed long."""
    kept = docs.select(*carried)
    return docs.select(*carried, utf8("text").alias("__raw")).mapInArrow(partial(_fingerprints, width=width), StructType([*kept.schema.fields, StructField("__fp", LongType())]))


def _masks(count: int, radius: int) -> list[int]:
    """Bits of 64 for each table: with the fewest blocks of which groups of ``count`` fingerprints stay small on average."""
    for agree in range(1, 9):
        blocks = radius + agree
        bits = 64 * agree // blocks
        if count >> bits <= GROUP_ROWS or agree == 8:
            edges = [64 * i // blocks for i in range(blocks + 1)]
            parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
            return [sum(chosen) for chosen in combinations(parts, agree)]
    raise AssertionError


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def tiled_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of links in a (b: none), or from a to b; uint64 arrays sorted by bit counts."""
    right = a if b is None else b
    ca, cb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    left_out, right_out = [], []
    for i in range(0, len(a), TILE):
        x = a[i : i + TILE]
        lo, hi = int(ca[i]) - radius, int(ca[min(i + TILE, len(a)) - 1]) + radius
        first, end = np.searchsorted(cb, lo, "left"), np.searchsorted(cb, hi, "right")
        for j in range(max(first, i) if b is None else first, end, TILE):
            near = np.bitwise_count(x[:, None] ^ right[None, j : min(end, j + TILE)]) <= radius
            p, q = np.nonzero(near)
            left_out.append(p + i)
            right_out.append(q + j)
    if not left_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left_out), np.concatenate(right_out)


def _forest(prints: np.ndarray, radius: int, side: np.ndarray) -> list[tuple[int, int]]:
    """Links of one group that span its components: (fingerprint, that of its root). side: 0 is compared within, or 1 with 2."""
    order = np.argsort(np.bitwise_count(prints), kind="stable")
    prints, side = prints[order], side[order]
    if side.max() == 0:
        p, q = tiled_links(prints, None, radius)
    else:
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if not len(one) or not len(two):
            return []
        p, q = tiled_links(prints[one], prints[two], radius)
        p, q = one[p], two[q]
    root = local_roots(len(prints), p, q)
    off = np.flatnonzero(root != np.arange(len(prints)))
    signed = prints.view(np.int64)
    return list(zip(signed[off].tolist(), signed[root[off]].tolist(), strict=True))


def _groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group may go on in the next batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def done(keys: np.ndarray, prints: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        out = []
        for i, j in zip([0, *bounds.tolist()], [*bounds.tolist(), len(keys)], strict=True):
            if j - i > 1:
                out += _forest(prints[i:j], radius, side[i:j])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([h[k] for h in held]) for k in range(3))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "val", "slice")], axis=1)
        mine = (keys, batch.column("fp").to_numpy().view(np.uint64), batch.column("side").to_numpy(zero_copy_only=False))
        if held and (held[-1][0][-1] != keys[-1]).any():
            held.append(mine)
            keys, prints, side = joined()
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))[-1] + 1
            yield done(keys[:last], prints[:last], side[:last])
            held = [(keys[last:], prints[last:], side[last:])]
        else:
            held.append(mine)
    if held:
        yield done(*joined())


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (fp)."""
    masks = _masks(prints.count(), radius)
    tables = F.array(*(F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("val")) for t, m in enumerate(masks)))
    keyed = prints.select("fp", F.explode(tables).alias("k")).select("k.*", "fp")
    hot = materialize(keyed.groupBy("tab", "val").count().filter(F.col("count") > HOT_ROWS).select("tab", "val", F.lit(True).alias("hot")), "hot-blocks")
    if hot.isEmpty():
        dealt = keyed.withColumn("slice", F.lit(-1)).withColumn("side", F.lit(0))
    else:
        # There are at most tables * fingerprints / HOT_ROWS hot groups; the join is by hash where that is much.
        bits = F.bit_count("fp")
        pairs = F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.struct((F.least(bits, bits + d) * 65 + F.greatest(bits, bits + d)).cast("int").alias("slice"), F.when(d == 0, 0).when(d > 0, 1).otherwise(2).alias("side")))
        whole = F.array(F.struct(F.lit(-1).alias("slice"), F.lit(0).alias("side")))
        dealt = keyed.join(hot, ["tab", "val"], "left").select("tab", "val", "fp", F.explode(F.when(F.col("hot"), pairs).otherwise(whole)).alias("s")).select("tab", "val", "fp", "s.*")
    dealt = dealt.select(F.col("tab").cast("long"), "val", F.col("slice").cast("long"), "fp", "side").repartition("tab", "val", "slice").sortWithinPartitions("tab", "val", "slice")
    return dealt.mapInArrow(partial(_groups, radius=radius), "a long, b long")


def _with_first(rows: DataFrame, classes: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows (with ``key``) and __first: the least __own of the component; classes: a row for each key, with __least; found: links (a, b) of keys.

    What is joined to is written first, so that adaptive execution can split a key or component that holds many rows.
    """
    tree = components(found)
    # Roots are no nodes of their own.
    both = tree.unionAll(tree.select("root", "root").distinct())
    linked = materialize(both.join(classes, both["node"] == classes[key]).select(key, "root", "__least"), "linked")
    firsts = materialize(linked.groupBy("root").agg(F.min("__least").alias("__first")), "firsts")
    placed = materialize(linked.join(firsts, "root").select(key, "__first"), "placed")
    table = materialize(classes.join(placed, key, "left").select(key, F.coalesce("__first", "__least").alias("__first")), "components")
    return rows.join(table, key)


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id)."""
    rows = materialize(with_fingerprints(docs, "doc_id", width=width), "fingerprints")
    classes = materialize(rows.groupBy("__fp").agg(F.min("doc_id").alias("__least")), "prints")
    placed = _with_first(rows, classes, "__fp", links(classes.select(F.col("__fp").alias("fp")), radius))
    return placed.select("doc_id", hexadecimal(F.col("__fp")).alias("fingerprint"), F.col("__first").alias("component_id"))


def hexadecimal(signed: Column) -> Column:
    return F.lower(F.lpad(F.hex(signed), 16, "0"))


def _own():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and __h, a hash of it, alone."""
    return docs.select("doc_id", "text").withColumn("__h", F.xxhash64("text"))


def _kept(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their component."""
    own, at, key, row = own_names(docs, "h", "id", "key", "row")
    first = placed.select(F.col("__first.doc_id").alias(at), F.col("__first.__h").alias(key)).distinct()
    kept = docs.withColumn(own, F.xxhash64("text")).join(first, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(own) == F.col(key)), "left_semi")
    # Repeated rows have the same id and text: any one of them stays.
    once = kept.withColumn(row, F.row_number().over(Window.partitionBy("doc_id", own).orderBy(F.lit(0)))).filter(F.col(row) == 1)
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, that of the smallest id (then of the smallest hash of its text), with all columns of ``docs``."""
    rows = materialize(with_fingerprints(_hashed(docs), "doc_id", "__h", width=width).withColumn("__own", _own()), "fingerprints")
    classes = materialize(rows.groupBy("__fp").agg(F.min("__own").alias("__least")), "prints")
    return _kept(docs, _with_first(rows, classes, "__fp", links(classes.select(F.col("__fp").alias("fp")), radius)))


# Near-duplicates by similarity: a radius wide enough for it, and an exact check of what is within.

#: Odd numbers by which shingle hashes are put into other orders.
_ORDERS = [pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(16)]


def _sketch(batches: Iterator[pa.RecordBatch], width: int, tables: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints, sizes, least, sets = [], [], [], []
        for raw in (x.as_py() for x in b.column("__raw")):
            own = np.unique(shingle_hashes(raw, width))
            prints.append(fingerprint(own))  # repeats do not count, as they do not in the similarity
            sizes.append(len(own))
            sets.append(xxhash.xxh3_128_digest(own.tobytes()))
            with np.errstate(over="ignore"):
                least.append([int((own * np.uint64(m)).min()) if len(own) else 0 for m in _ORDERS[:tables]])
        keep = [i for i, n in enumerate(b.schema.names) if n != "__raw"]
        mins = np.array(least, np.uint64).view(np.int64).reshape(-1)
        columns = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(mins) + 1, tables), pa.int32()), pa.array(mins)), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *columns], [*(b.schema.names[i] for i in keep), "__fp", "__n", "__mins", "__set"])


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of two rows or more; rows come sorted by table, key and unit."""
    now, rows = None, []
    for b in batches:
        for tab, key, unit, *rest in zip(*((x.as_py() for x in b.column(n)) if n == "all" else b.column(n).to_pylist() for n in ("tab", "key", "unit", *names)), strict=True):
            if (tab, key, unit) != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = (tab, key, unit), []
            rows.append(rest)
    if len(rows) > 1:
        yield now, rows


class _Reach:
    """For rows that begin with a fingerprint, a size and a side (0 is compared within, or 1 with 2): which can be similar. Pairs are not held."""

    def __init__(self, rows: list[list], radius: int, similarity: float):
        self.prints = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        self.sizes, self.sides = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        self.radius, self.similarity = radius, similarity

    def of(self, i: int) -> np.ndarray:
        size = self.sizes[i]
        near = np.bitwise_count(self.prints ^ self.prints[i]) <= self.radius
        near &= np.minimum(self.sizes, size) >= self.similarity * np.maximum(self.sizes, size)
        if self.sides[i]:
            near &= self.sides != self.sides[i]
        near[i] = False
        return np.flatnonzero(near)


def _members(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Those rows of each group that have another one within reach."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["tab", "key", "unit", "fp", "n", "side", "set"])

    for unit, rows in _runs(batches, "fp", "n", "side", "set"):
        reach = _Reach(rows, radius, similarity)
        out += ((*unit, *row) for i, row in enumerate(rows) if len(reach.of(i)))
        if len(out) > 50_000:
            yield batch()
            out.clear()
    yield batch()


def _shingle_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            sets = [np.unique(shingle_hashes(unpacker.decompress(z.as_py()), width)).tobytes() for z in part.column("__zip")]
            yield pa.RecordBatch.from_arrays([part.column("set"), pa.array(sets, pa.binary())], ["set", "all"])


def _verified(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of each group that span its components of similar sets. Those in the middle are looked at first: one original links its copies."""
    a, c = [], []
    for _, rows in _runs(batches, "fp", "n", "side", "set", "all"):
        reach = _Reach(rows, radius, similarity)
        near = np.array([len(reach.of(i)) for i in range(len(rows))])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        root, done = np.arange(len(rows)), np.zeros(len(rows), bool)
        for i in np.argsort(-near, kind="stable").tolist():
            others = reach.of(i)
            for j in others[~done[others] & (root[others] != root[i])].tolist():
                if root[i] != root[j]:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                        root[root == root[j]] = root[i]
                        a.append(rows[i][3])
                        c.append(rows[j][3])
            done[i] = True
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary())], ["a", "b"])


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__h"), pa.array([packer.compress(r.as_py()) for r in b.column("__raw")], pa.binary())], ["doc_id", "__h", "__zip"])


def similar_links(hashed: DataFrame, classes: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) of shingle sets that are at least so similar; hashed: the documents, with __h; classes: a row for each __set."""
    tables = F.posexplode("__mins")
    keyed = classes.select(tables.alias("tab", "key"), F.col("__fp").alias("fp"), F.col("__n").alias("n"), F.col("__set").alias("set")).filter("n > 0")
    sums = keyed.groupBy("tab", "key").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).filter("rows > 1")
    hot = sums.select("tab", "key", F.greatest(F.ceil(F.col("rows") / HOT_ROWS), F.ceil(F.col("shingles") / HOT_SHINGLES)).cast("int").alias("blocks"))
    hot = materialize(hot.filter("blocks > 1"), "hot-minima")
    if hot.isEmpty():
        dealt = keyed.select("tab", "key", F.lit(0).cast("long").alias("unit"), "fp", "n", F.lit(0).alias("side"), "set")
    else:
        # Too many to compare in one task: dealt by hashes into blocks, and each pair of blocks is compared by itself.
        own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
        unit = lambda j: (F.least(own, j).cast("long") * (1 << 32) + F.greatest(own, j)).alias("unit")
        units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(unit(j), F.when(j == own, 0).when(own < j, 1).otherwise(2).alias("side")))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side")))
        dealt = keyed.join(hot, ["tab", "key"], "left").withColumn("u", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(units)))
        dealt = dealt.select("tab", "key", "u.unit", "fp", "n", "u.side", "set")
    dealt = dealt.repartition("tab", "key", "unit").sortWithinPartitions("tab", "key", "unit")
    members = materialize(dealt.mapInArrow(partial(_members, radius=radius, similarity=similarity), "tab int, key long, unit long, fp long, n long, side int, set binary"), "near-members")
    wanted = classes.join(members.select(F.col("set").alias("__set")).distinct(), "__set", "left_semi").select(F.col("__set").alias("set"), F.col("__least.doc_id").alias("id"), F.col("__least.__h").alias("k"))
    kind = hashed.schema["doc_id"].dataType.simpleString()
    texts = hashed.select("doc_id", "__h", utf8("text").alias("__raw")).mapInArrow(_squeeze, f"doc_id {kind}, __h long, __zip binary")
    sets = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__h") == F.col("k"))).select("set", "__zip").mapInArrow(partial(_shingle_sets, width=width), "set binary, all binary").dropDuplicates(["set"])
    met = members.join(materialize(sets, "shingle-sets"), "set").select("tab", "key", "unit", "fp", "n", "side", "set", "all").repartition("tab", "key", "unit").sortWithinPartitions("tab", "key", "unit")
    return met.mapInArrow(partial(_verified, radius=radius, similarity=similarity), "a binary, b binary")


def keep_one_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 20, tables: int = 6) -> DataFrame:
    """One row of each component of documents whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    Similar sets have fingerprints within a wide radius (about 10 bits at 0.8), for which blocks of bits are no help. So
    fingerprints are compared, in tiles, where two documents share one of ``tables`` least shingles (at 0.8 all but 0.2 ^ tables
    of pairs do); what is within the radius is checked exactly on the shingles.
    """
    hashed = _hashed(docs)
    kept = hashed.select("doc_id", "__h")
    more = [StructField("__fp", LongType()), StructField("__n", LongType()), StructField("__mins", ArrayType(LongType())), StructField("__set", BinaryType())]
    rows = hashed.select("doc_id", "__h", utf8("text").alias("__raw")).mapInArrow(partial(_sketch, width=width, tables=tables), StructType([*kept.schema.fields, *more]))
    rows = materialize(rows.withColumn("__own", _own()), "sketches")
    classes = materialize(rows.groupBy("__set").agg(F.min("__own").alias("__least"), F.first("__fp").alias("__fp"), F.first("__n").alias("__n"), F.first("__mins").alias("__mins")), "sets")
    return _kept(docs, _with_first(rows.select("doc_id", "__h", "__set", "__own"), classes, "__set", similar_links(hashed, classes, width, similarity, radius)))
