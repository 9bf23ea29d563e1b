"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: a logistic model on the shape of its text (shares of kinds of characters, word lengths,
repetition) and on the strongest word scores it holds, fitted on a bounded sample of labelled rows. Two targets: quality
and toxicity.

Sites: each document belongs to a host and a path of it. A host's mean of the documents' probabilities is shrunk toward the
global mean, a path's toward its host's; how far depends on how much hosts (paths) really differ, which the method of
moments tells from grouped sums over all documents. A document's posterior log-odds are its own plus the shift of its
path against the global mean. So a site with few documents says little, and one with many says what it has shown.

Nulls: a null text counts as empty, a null source as the host ''. Empty texts have the shape of an empty text and are
rejected as any other text that the model finds poor. Without labels of both kinds a target's evidence is the share of its
labels (0.5 without any). Repeated rows are scored each; other columns are carried along untouched.
Very long texts are scored whole, as the last of their block. Posteriors that equal a limit: quality stays, toxicity goes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._shared import materialize, own_names, small_batches, utf8

#: Bytes that are no part of a word become spaces.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_KINDS = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = [_b < 128 and _c.islower(), _b < 128 and _c.isupper(), _c in "0123456789", _c in " \t\r", _c == "\n", _c in ".,;:'\"?-()", _b < 128 and not _c.isalnum() and not _c.isspace() and _c not in ".,;:'\"?-()"]

TARGETS = ("quality", "toxic")
TOP = 4


def words_of(raw: bytes) -> list[bytes]:
    return raw.decode("utf-8", "replace").lower().encode().translate(_WORDS).split()


#: Bytes of the beginnings that stand for the words that share them.
BEGINNINGS = (6, 7, 8, 9)


def terms_of(words: set[bytes]) -> set[bytes]:
    """The words, and the beginnings of longer ones (with a mark), by which a family of rare words counts together."""
    return words.union(*({w[:n] + b"~" for w in words if len(w) > n} for n in BEGINNINGS))


def shape(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    """The shape of a text: the same length for every text."""
    n = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / n
    lines = raw.split(b"\n")
    tokens = raw.count(b" ") + len(lines)
    return [*kinds, np.log1p(len(raw)), np.log1p(len(words)), len(words) / tokens, sum(map(len, words)) / max(1, len(words)) / 10, distinct / max(1, len(words)), len(set(lines)) / len(lines), float(kinds[1] > 0.5 * (kinds[0] + kinds[1]))]


def _strongest(terms: set[bytes], scores: dict[bytes, float]) -> list[float]:
    """The TOP highest scores of words, and their lowest; zeros where there are fewer."""
    found = sorted(scores[w] for w in terms & scores.keys())
    up, down = [x for x in found[::-1] if x > 0][:TOP], [x for x in found if x < 0][:TOP]
    return [*up, *[0.0] * (TOP - len(up)), *down, *[0.0] * (TOP - len(down))]


@dataclass
class Model:
    """For each target: scores of terms, the features' means and scales, and weights (the last one is the intercept)."""

    scores: list[dict[bytes, float]]
    mean: list[np.ndarray]
    scale: list[np.ndarray]
    weights: list[np.ndarray]

    def log_odds(self, raws: list[bytes]) -> np.ndarray:
        out = np.zeros((len(raws), len(TARGETS)))
        features: list[list[list[float]]] = [[] for _ in TARGETS]
        for raw in raws:  # no more than one text's terms are held
            words = words_of(raw)
            distinct = set(words)
            form, terms = shape(raw, words, len(distinct)), terms_of(distinct)
            for k in range(len(TARGETS)):
                features[k].append([*form, *_strongest(terms, self.scores[k])])
        for k in range(len(TARGETS)):
            if raws:
                out[:, k] = ((np.array(features[k]) - self.mean[k]) / self.scale[k]) @ self.weights[k][:-1] + self.weights[k][-1]
        return np.clip(out, -30, 30)


#: Terms are first counted by this many hashes; only those that can matter are then told apart.
BUCKETS = 1 << 22


def _bucket(term: bytes) -> int:
    return zlib.crc32(term) & (BUCKETS - 1)


def _tells(a: np.ndarray, b: np.ndarray, n1: int, n0: int, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Of terms in a texts of one label and b of the other: log-odds, and whether enough texts tell the labels apart clearly."""
    score = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    return score, (a + b >= least) & (np.abs(score) >= 1) & (np.abs(score) >= 3 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))


def _term_scores(sets: list[set[bytes]], y: np.ndarray) -> dict[bytes, float]:
    """Log-odds of the terms that tell the labels apart."""
    c1, c0 = Counter(), Counter()
    for s, label in zip(sets, y, strict=True):
        (c1 if label else c0).update(s)
    terms = list(c1.keys() | c0.keys())
    score, good = _tells(np.array([c1[t] for t in terms], float), np.array([c0[t] for t in terms], float), int(y.sum()), int((1 - y).sum()))
    return {t: float(x) for t, x, g in zip(terms, score, good, strict=True) if g}


def _useful(words: list[bytes], labels: list[list]) -> list[set[bytes]]:
    """The terms of each text that may tell the labels of a target apart, in all texts or in either half of them."""
    hashed = [np.unique(np.fromiter(map(_bucket, terms_of(set(w.split()))), np.uint32)) for w in words]
    may = np.zeros(BUCKETS, bool)
    for k in range(len(TARGETS)):
        own = [i for i, y in enumerate(labels) if y[k] in (0, 1)]
        for part in (own, own[::2], own[1::2]):
            counts, n = np.zeros((2, BUCKETS), np.float32), [0, 0]
            for i in part:
                counts[int(labels[i][k]), hashed[i]] += 1
                n[int(labels[i][k])] += 1
            may |= _tells(counts[1], counts[0], n[1], n[0])[1]
    return [{t for t in terms_of(set(w.split())) if may[_bucket(t)]} for w in words]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept is free."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x1.shape[1]), np.diag([*[ridge] * x.shape[1], 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + pull, x1.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[bytes, list[float], list]]) -> Model:
    """From (the distinct words joined by spaces, shape, labels) of the sample. Word scores that train the weights come from the other half."""
    model = Model([], [], [], [])
    width = len(shape(b"", [], 0)) + 2 * TOP
    useful = _useful([r[0] for r in rows], [r[2] for r in rows])
    for k in range(len(TARGETS)):
        own = [(t, s, int(y[k])) for t, (_, s, y) in zip(useful, rows, strict=True) if y[k] in (0, 1)]
        y = np.array([r[2] for r in own])
        if len(own) < 20 or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            model.scores.append({})
            model.mean.append(np.zeros(width))
            model.scale.append(np.ones(width))
            model.weights.append(np.array([*[0.0] * width, np.log(share / (1 - share))]))
            continue
        sets, x = [r[0] for r in own], np.zeros((len(own), width))
        for half in (0, 1):
            scores = _term_scores(sets[1 - half :: 2], y[1 - half :: 2])
            x[half::2] = [[*s, *_strongest(w, scores)] for w, s, _ in own[half::2]]
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        model.scores.append(_term_scores(sets, y))
        model.mean.append(mean)
        model.scale.append(scale)
        model.weights.append(_logistic((x - mean) / scale, y))
    return model


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, shapes = [], []
        for raw in b.column("raw").to_pylist():
            w = words_of(raw)
            words.append(b" ".join(sorted(set(w))))
            shapes.append(shape(raw, w, len(set(w))))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(shapes, pa.list_(pa.float64())), b.column("quality"), b.column("toxic")], ["words", "shape", *TARGETS])


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """Fit on at most ``sample`` labelled ids, those of the smallest hashes."""
    picked = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max(t).cast("int").alias(t) for t in TARGETS)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of three numbers.
    rows = docs.select("doc_id", utf8("text").alias("raw")).join(F.broadcast(picked), "doc_id")
    # One text for each id, so the driver gets no more than ``sample`` rows however often ids repeat.
    rows = rows.groupBy("doc_id", *TARGETS).agg(F.min_by("raw", F.xxhash64("raw")).alias("raw")).select("raw", *TARGETS)
    with small_batches(docs.sparkSession):
        got = rows.mapInArrow(_describe, "words binary, shape array<double>, quality int, toxic int").collect()
    return fit(sorted((bytes(r["words"]), list(r["shape"]), [r[t] for t in TARGETS]) for r in got if r["words"] is not None))


_SCORED = ("__q", "__t")


def _score(batches: Iterator[pa.RecordBatch], model: Model, at: int, kept: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The first ``kept`` columns, and the log-odds of the texts, which are the column ``at``; in blocks of a bounded number of bytes."""
    for b in batches:
        texts, block, size, start = b.column(at).cast(pa.binary()), [], 0, 0
        for i in range(b.num_rows):
            block.append(texts[i].as_py() or b"")
            size += len(block[-1])
            if size > 1 << 22 or len(block) >= 1024 or i + 1 == b.num_rows:
                odds, part = model.log_odds(block), b.slice(start, len(block))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(odds[:, 0]), pa.array(odds[:, 1])], [*b.schema.names[:kept], *names])
                block, size, start = [], 0, i + 1


def evidence(docs: DataFrame, model: Model, *carried: str, names: tuple[str, ...] = _SCORED) -> DataFrame:
    """The carried columns of ``docs``, and under ``names`` the log-odds of quality and toxicity by the document alone.

    A text that is carried goes to Python once, for both.
    """
    sent = kept = docs.select(*(F.col(f"`{c}`") for c in carried))
    at = next((i for i, f in enumerate(kept.schema.fields) if f.name.lower() == "text" and isinstance(f.dataType, StringType)), len(kept.columns))
    if at == len(kept.columns):
        sent = docs.select(*(F.col(f"`{c}`") for c in carried), utf8("text").alias(own_names(kept, "raw")[0]))
    schema = StructType([*kept.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    return sent.mapInArrow(partial(_score, model=model, at=at, kept=len(kept.columns), names=list(names)), schema)


def site_columns(docs: DataFrame) -> tuple:
    """Host and path: what is before and after the first '/' of the source; the language, where the source has no path."""
    source = F.coalesce("source", F.lit(""))
    host = F.regexp_extract(source, r"^(?:[a-z]+://)?([^/]*)", 1)
    path = F.regexp_extract(source, r"^(?:[a-z]+://)?[^/]*/([^/?#]+)", 1)
    return host, F.when(path == "", F.coalesce("lang", F.lit(""))).otherwise(path)


def _p(odds: str):
    return 1 / (1 + F.exp(-F.col(odds)))


def sites(scored: DataFrame) -> DataFrame:
    """A row for each __host and __path of ``scored``: __n, and for each target the shrunk means and the shift of log-odds.

    Method of moments: with group means m, sizes n and the mean variance v inside groups, the variance between groups is
    t = max(0, (between - (groups - 1) v) / (N - sum n^2 / N)), and a group's weight is n / (n + v / t).
    """
    stats = [F.count("*").alias("__n")]
    for t, odds in zip(TARGETS, _SCORED, strict=True):
        stats += [F.sum(_p(odds)).alias(f"__s_{t}"), F.sum(_p(odds) * _p(odds)).alias(f"__ss_{t}")]
    paths = materialize(scored.groupBy("__host", "__path").agg(*stats), "site-sums")
    sums = [F.sum(c).alias(c) for c in paths.columns if c not in ("__host", "__path")]
    hosts = paths.groupBy("__host").agg(*sums)

    def strength(groups: DataFrame, t: str, within: DataFrame | None) -> tuple[float, float]:
        """Rows' worth of the prior (v / t), and the mean over all rows."""
        n, s, ss = F.col("__n"), F.col(f"__s_{t}"), F.col(f"__ss_{t}")
        parts = [F.sum(n), F.sum(s), F.sum(ss), F.sum(s * s / n), F.sum(n * n / (F.lit(1.0) if within is None else F.col("__hn"))), F.count("*")]
        of = groups if within is None else groups.join(within.select("__host", F.col("__n").alias("__hn"), F.col(f"__s_{t}").alias("__hs")), "__host")
        base = F.lit(None).cast("double") if within is None else F.sum(F.col("__hs") * F.col("__hs") / F.col("__hn") * n / F.col("__hn"))
        uppers = F.lit(1) if within is None else F.countDistinct("__host")
        total, sum_, squares, between, n2, groups_n, above, n_above = of.agg(*(c.alias(f"c{i}") for i, c in enumerate([*parts, base, uppers]))).first()
        if not total:
            return float("inf"), 0.5
        above = sum_ * sum_ / total if above is None else above
        n2 = n2 / total if within is None else n2
        v = max(1e-9, (squares - between) / max(1, total - groups_n))
        spread = max(0.0, between - above - (groups_n - n_above) * v) / max(1e-9, total - n2)
        return (v / spread if spread > 0 else float("inf")), sum_ / total

    out = paths.join(hosts.select("__host", F.col("__n").alias("__hn"), *(F.col(f"__s_{t}").alias(f"__hs_{t}") for t in TARGETS)), "__host")
    shown = ["__host", "__path", "__n"]
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    for t in TARGETS:
        (kh, mean), (kp, _) = strength(hosts, t, None), strength(paths, t, hosts)
        host = F.lit(mean) if kh == float("inf") else (F.col(f"__hs_{t}") + kh * mean) / (F.col("__hn") + kh)
        out = out.withColumn(f"__host_{t}", host.cast("double"))
        path = F.col(f"__host_{t}") if kp == float("inf") else (F.col(f"__s_{t}") + kp * F.col(f"__host_{t}")) / (F.col("__n") + kp)
        out = out.withColumn(f"__path_{t}", path).withColumn(f"__shift_{t}", logit(F.col(f"__path_{t}")) - logit(F.lit(mean)))
        shown += [f"__host_{t}", f"__path_{t}", f"__shift_{t}"]
    return materialize(out.select(*shown), "sites")


#: Site tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SITES = 200_000


def judge(docs: DataFrame, model: Model, *carried: str, least_quality: float = 0.5, most_toxic: float = 0.5) -> tuple[DataFrame, str]:
    """The carried columns and, with a prefix that is returned too, p_quality and p_toxic (posteriors), the site's means, and keep.

    Texts are scored once: what is carried is written with the evidence, and read for the sites and for the result.
    """
    prefix = own_names(docs, "")[0]
    host, path, *odds = (prefix + n for n in ("host", "path", "q", "t"))
    columns = site_columns(docs)
    placed = docs.withColumn(host, columns[0]).withColumn(path, columns[1])
    with small_batches(docs.sparkSession):
        scored = materialize(evidence(placed, model, *carried, host, path, names=tuple(odds)), "evidence")
    by_site = sites(scored.select(*(F.col(a).alias(b) for a, b in zip((host, path, *odds), ("__host", "__path", *_SCORED), strict=True))))
    by_site = by_site.select(*(F.col(c).alias(prefix + c[2:]) for c in by_site.columns))
    by_site = F.broadcast(by_site) if by_site.count() <= BROADCAST_SITES else by_site
    out = scored.join(by_site, [host, path])
    for t, own in zip(TARGETS, odds, strict=True):
        out = out.withColumn(f"{prefix}p_{t}", 1 / (1 + F.exp(-(F.col(own) + F.col(f"{prefix}shift_{t}")))))
    return out.withColumn(f"{prefix}keep", (F.col(f"{prefix}p_quality") >= least_quality) & (F.col(f"{prefix}p_toxic") < most_toxic)), prefix


def score(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang, source): doc_id, host, path, posteriors and sites' means, keep."""
    out, prefix = judge(docs, fit_on(docs, labels), "doc_id", **limits)
    return out.select("doc_id", *(F.col(prefix + c).alias(c) for c in ("host", "path", "p_quality", "p_toxic", "host_quality", "path_quality", "host_toxic", "path_toxic", "keep")))


def keep_good(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    out, prefix = judge(docs, fit_on(docs, labels), *docs.columns, **limits)
    return out.filter(prefix + "keep").select(*(F.col(f"`{c}`") for c in docs.columns))
