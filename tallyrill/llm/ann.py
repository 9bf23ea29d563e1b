"""Nearest neighbours for the largest inner product, by score-aware anisotropic quantisation and an exact check.

Vectors are told apart first by the nearest of a few cells' centres; what is left, brought to length one, is cut into subspaces,
each quantised to one of sixteen centres: four bits. What is least is not the plain residual
but one whose part parallel to the vector weighs ``eta`` times as much, because that part is what large scores lose.
Codes are chosen by coordinate descent over subspaces and centres solved for in turn. A code keeps the scale that fits it best and
the length of what it still leaves out. A search adds up, for each code, the entries of a query's tables (two four-bit tables make
one of 256 entries). That and the length left out bound the vector's inner product from above (Cauchy-Schwarz).

The ``rerank`` best codes of a chunk are checked by their exact inner products, and then every other whose bound reaches the
best found so far. So no nearest vector is lost, whatever the rows are like: codes that fit badly cost checks, at
most one for each query and vector, not results.

Cells and centres are fitted on at most ``sample`` vectors (those of the smallest hashes); every vector is coded. Equal vectors are coded
once, as a class: a class yields as many of its smallest ids as a result can hold, so copies crowd nothing out. Queries
are taken in blocks of about ``block`` at a time, each against all codes in one pass, and codes in chunks.

Null vectors, those of zeros only, those holding null or non-finite components, and rows without an id take no part, nor do
vectors of another dimension than the most common (the larger of equally common ones). Rows that repeat a query's id count as
its own and are no candidates of it, and the least of their vectors asks. Ties in the measure go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

CENTRES = 16
#: More than products that are too small for a double can lose.
TINY = 1e-290
#: A task holds at most so many bytes of vectors at a time.
CHUNK_BYTES = 1 << 25


def _lengths(x: np.ndarray) -> np.ndarray:
    """Of rows whose squares may be out of range."""
    most = np.maximum(np.abs(x).max(axis=1), 1e-300)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]


@dataclass
class Quantizer:
    """centres: subspace, centre, component (padded with zeros); eta: the weight of the parallel residual."""

    centres: np.ndarray
    eta: float

    @property
    def width(self) -> int:
        return self.centres.shape[2]

    def _cut(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.centres.shape
        return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(len(x), m, w)

    def _part(self, v: np.ndarray, u: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector and centre of a subspace: the residual's squared length, and its length along the vector."""
        left = v[:, m, None] - self.centres[m][None]
        return (left**2).sum(axis=2), (left * u[:, m, None]).sum(axis=2)

    def codes(self, x: np.ndarray, sweeps: int = 3, start: np.ndarray | None = None, toward: np.ndarray | None = None) -> np.ndarray:
        """The code of each vector and subspace: coordinate descent from the nearest centres. One subspace is held at a time.
        ``toward``: the directions in which residuals weigh more, if not those of the vectors."""
        v, u = self._cut(x), self._cut(_unit(x if toward is None else toward))
        rows, total = np.arange(len(x)), np.zeros(len(x))
        code = np.zeros((len(x), len(self.centres)), np.int64) if start is None else start
        for m in range(len(self.centres)):
            away, along = self._part(v, u, m)
            if start is None:
                code[:, m] = away.argmin(axis=1)
            total += along[rows, code[:, m]]
        for _ in range(sweeps):
            for m in range(len(self.centres)):
                away, along = self._part(v, u, m)
                others = total - along[rows, code[:, m]]
                code[:, m] = (away + (self.eta - 1) * (others[:, None] + along) ** 2).argmin(axis=1)
                total = others + along[rows, code[:, m]]
        return code

    def solve(self, x: np.ndarray, code: np.ndarray, toward: np.ndarray | None = None) -> None:
        """The best centres for these codes, one subspace after the other."""
        v, u = self._cut(x), self._cut(_unit(x if toward is None else toward))
        m_all, _, w = self.centres.shape
        along = np.stack([((v[:, m] - self.centres[m][code[:, m]]) * u[:, m]).sum(axis=1) for m in range(m_all)], axis=1)
        for m in range(m_all):
            others = along.sum(axis=1) - along[:, m]
            a = np.eye(w)[None] + (self.eta - 1) * u[:, m, :, None] * u[:, m, None, :]
            b = v[:, m] + (self.eta - 1) * u[:, m] * (others + (u[:, m] * v[:, m]).sum(axis=1))[:, None]
            lhs, rhs, n = np.zeros((CENTRES, w, w)), np.zeros((CENTRES, w)), np.bincount(code[:, m], minlength=CENTRES)
            np.add.at(lhs, code[:, m], a)
            np.add.at(rhs, code[:, m], b)
            used = n > 0
            self.centres[m][used] = np.linalg.solve(lhs[used], rhs[used][:, :, None])[:, :, 0]
            along[:, m] = ((v[:, m] - self.centres[m][code[:, m]]) * u[:, m]).sum(axis=1)

    def decode(self, code: np.ndarray, d: int) -> np.ndarray:
        return np.concatenate([c[code[:, m]] for m, c in enumerate(self.centres)], axis=1)[:, :d]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a packed code: the 256 sums of its two entries."""
        q = self._cut(queries)
        one = np.stack([q[:, m] @ c.T for m, c in enumerate(self.centres)], axis=1)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), one.shape[1] // 2, CENTRES * CENTRES).astype(np.float32)


def pack(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, the first one low."""
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8)


def fit(x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 6, seed: int = 7, toward: np.ndarray | None = None) -> Quantizer:
    """From a sample. eta follows from ``threshold``: scores over this cosine are what the quantiser cares for."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    start = x[rng.choice(n, CENTRES, replace=n < CENTRES)]
    m = -(-d // width)
    cut = lambda y: np.pad(y, ((0, 0), (0, m * width - d))).reshape(len(y), m, width)
    out = Quantizer(cut(start).transpose(1, 0, 2).copy(), max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
    plain = Quantizer(out.centres, 1.0)
    for _ in range(rounds):  # first for the plain residual
        plain.solve(x, plain.codes(x, 0))
    code = out.codes(x, 1, toward=toward)
    for _ in range(rounds):
        out.solve(x, code, toward)
        code = out.codes(x, 1, code, toward)
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def cells(x: np.ndarray, most: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Centres of at most ``most`` cells: k-means, begun with vectors far from one another."""
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    away = ((x - out[0]) ** 2).sum(axis=1)
    while len(out) < most and away.sum() > 0:
        out.append(x[rng.choice(len(x), p=away / away.sum())])
        away = np.minimum(away, ((x - out[-1]) ** 2).sum(axis=1))
    centres = np.stack(out)
    for _ in range(rounds):
        own, total = _nearest(x, centres), np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Coder:
    """unit: what components are divided by first, so that squares stay in range; centres: of cells, in that unit."""

    unit: float
    centres: np.ndarray
    quantizer: Quantizer

    @classmethod
    def fit(cls, x: np.ndarray, width: int, most: int = 128) -> Coder:
        unit = float(np.abs(x).max())
        x = x / unit
        centres = cells(x, max(1, min(most, len(x) // 16)))
        return cls(unit, centres, fit(_unit(x - centres[_nearest(x, centres)]), width, toward=x))

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each vector: its cell, the scale of its code, how far at most the two are from it, the packed code."""
        d = x.shape[1]
        x = x / self.unit
        cell = _nearest(x, self.centres)
        left = x - self.centres[cell]
        code = self.quantizer.codes(_unit(left), toward=x)
        near = self.quantizer.decode(code, d)
        scale = (left * near).sum(axis=1) / np.maximum((near**2).sum(axis=1), 1e-30)
        part = np.abs(scale) * np.linalg.norm(near, axis=1)
        # With what rounding can do to sums of table entries, to inner products and to these lengths.
        wrong = (d + 4) * (2.0**-23 * part + 2.0**-50 * (np.linalg.norm(self.centres[cell], axis=1) + part + np.linalg.norm(x, axis=1)))
        return cell, scale * self.unit, (np.linalg.norm(left - scale[:, None] * near, axis=1) + wrong) * self.unit, pack(code)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _code(batches: Iterator[pa.RecordBatch], coder: Coder, d: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            with np.errstate(all="ignore"):
                cell, scale, away, code = coder.rows(_matrix(part.column("vec"), d))
            columns = [pa.array(cell, pa.int32()), pa.array(scale), pa.array(away), pa.array([row.tobytes() for row in code], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("least"), *columns, part.column("vec")], ["cid", "least", "cell", "scale", "away", "code", "vec"])


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            if n + part.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _key(score: np.ndarray) -> np.ndarray:
    """Scores out of range and not a number count as the largest, as Spark sorts them."""
    return np.where(np.isnan(score), np.inf, score)


def _floor(score: np.ndarray, keep: int) -> float:
    """What each of the ``keep`` best reaches."""
    return np.partition(score, -keep)[-keep] if len(score) >= keep else -np.inf


@dataclass
class Found:
    """Classes, their smallest ids and their scores."""

    cid: np.ndarray
    least: np.ndarray
    score: np.ndarray

    def best(self, keep: int) -> Found:
        order = np.lexsort((self.least, -_key(self.score)))[:keep]
        return Found(self.cid[order], self.least[order], self.score[order])

    @classmethod
    def union(cls, parts: list[Found]) -> Found:
        return cls(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("cid", "least", "score")))


FOUND = "query_id long, cid array<long>, least array<long>, score array<double>"


def _scan(batches: Iterator[pa.RecordBatch], coder: Coder, ids: np.ndarray, queries: np.ndarray, rerank: int, keep: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The ``keep`` best classes of this task for each query, in one row, with their exact scores (sums in the order of components)."""
    d = queries.shape[1]
    lengths = _lengths(queries)
    best = [Found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(ids)
    with np.errstate(all="ignore"):
        for t in _chunks(batches, max(1, min(chunk, CHUNK_BYTES // (8 * d)))):
            cid, least, cell, scale, away = (t.column(n).to_numpy() for n in ("cid", "least", "cell", "scale", "away"))
            codes = np.ascontiguousarray(np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(cid), -1).T)
            x = _matrix(t.column("vec").combine_chunks(), d)
            rounding = (d + 4) * 2.0**-50 * _lengths(x).max()
            for at in range(0, len(ids), 64):
                part, length = queries[at : at + 64], lengths[at : at + 64]
                middle, dense = part @ coder.centres.T * coder.unit, None  # dense: all products, once a query needs many
                for i, tables in enumerate(coder.quantizer.tables(part / length[:, None]), at):
                    q, slack = queries[i], lengths[i] * rounding + TINY
                    approx = middle[i - at][cell] + lengths[i] * scale * reduce(np.add, (e.take(c) for e, c in zip(tables, codes, strict=True)))
                    some = np.argpartition(-approx, min(rerank, len(cid)) - 1)[:rerank]
                    score = _key(x[some] @ q)
                    before = _key(best[i].score)
                    may = ~(approx + lengths[i] * away < _floor(np.concatenate([before, score - slack]), keep) - TINY)
                    may[some] = False
                    more = may.nonzero()[0]
                    if 4 * len(more) > len(cid) and dense is None:
                        dense = part @ x.T
                    rest = x[more] @ q if dense is None else dense[i - at][more]
                    some, score = np.concatenate([some, more]), np.concatenate([score, _key(rest)])
                    some = some[~(score < _floor(np.concatenate([before, score - slack]), keep) - slack)]
                    exact = np.cumsum(x[some] * q, axis=1)[:, -1] + 0.0
                    best[i] = Found.union([best[i], Found(cid[some], least[some], exact)]).best(keep)
    if best and len(best[0].cid):
        kinds = (("cid", pa.int64()), ("least", pa.int64()), ("score", pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array([getattr(f, n) for f in best], pa.list_(kind)) for n, kind in kinds)], ["query_id", "cid", "least", "score"])


def _merge(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by query: of what the tasks have found for one, the best; ties go to the smaller id."""

    def best(query: int, parts: list[Found]) -> pa.RecordBatch:
        f = Found.union(parts).best(keep)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(f.cid), query)), pa.array(f.cid), pa.array(f.score)], ["query_id", "cid", "score"])

    now, parts = None, []
    for b in batches:
        for query, *row in zip(*(b.column(n).to_pylist() for n in ("query_id", "cid", "least", "score")), strict=True):
            if query != now and parts:
                yield best(now, parts)
                parts = []
            now = query
            parts.append(Found(*(np.array(c) for c in row)))
    if parts:
        yield best(now, parts)


def search(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = 8192, rerank: int = 100, width: int = 2, block: int = 4096, chunk: int = 16_384) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``: query_id, rank, vec_id, score of its k nearest."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    common = sound.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    sound = sound.filter(F.size("vec") == d)
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    first = by_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of each class its k + 1 smallest ids, as one may be the query's own, and of each id as many rows as a result can hold.
    members = sound.withColumn("row", F.monotonically_increasing_id()).select(
        "vec_id", "vec", F.row_number().over(by_id).alias("n"), F.rank().over(by_id).alias("r"), F.dense_rank().over(by_id).alias("g"), F.first("row").over(first).alias("cid")
    )
    members = materialize(members.filter((F.col("g") <= k + 1) & (F.col("n") - F.col("r") < k)), "classes")
    classes = members.filter("n = 1").select("cid", F.col("vec_id").alias("least"), "vec")
    picked = classes.orderBy(F.xxhash64("least"), "least", "vec").limit(sample).select("vec").toArrow()
    coder = Coder.fit(_matrix(picked.column("vec").combine_chunks(), d), width)
    codes = materialize(classes.mapInArrow(partial(_code, coder=coder, d=d), "cid long, least long, cell int, scale double, away double, code binary, vec array<double>"), "codes")
    asked = materialize(sound.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")).distinct(), "queries")
    count, repeats = asked.groupBy("query_id").count().agg(F.count("*"), F.max("count")).first()
    queries = asked.groupBy("query_id").agg(F.min("query").alias("query"))
    # So many of the best classes hold the k best rows, whichever of them are the query's own.
    keep = k + (repeats or 0)
    blocks = max(1, -(-count // block))
    found = None
    for b in range(blocks):
        # Bounded: about ``block`` queries.
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        if own.num_rows:
            ids, x = own.column("query_id").to_numpy(), _matrix(own.column("query").combine_chunks(), d)
            scan = partial(_scan, coder=coder, ids=ids, queries=x, rerank=rerank, keep=keep, chunk=chunk)
            hits = codes.mapInArrow(scan, FOUND)
            best = hits.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(partial(_merge, keep=keep), "query_id long, cid long, score double")
            best = materialize(best, "candidates")
            found = best if found is None else found.unionAll(best)
    if found is None:
        return spark.createDataFrame([], schema)
    rows = found.join(members.select("cid", "vec_id"), "cid").filter("vec_id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
