"""Quality scores: kernel ridge by random Fourier features, then isotonic calibration.

Statistics of each text are standardised and clipped, and ``cos(W x + b)`` with
Gaussian ``W`` approximates a Gaussian kernel on them.  Each partition sums its
normal equations; the sums meet on the driver (their size depends on the number
of features alone) and give the ridge weights.  A pool-adjacent-violators fit
on histogram bins of other labelled rows turns ridge values into probabilities.

Labels are learned only from rows whose ``crc32(doc_id as text) mod 5`` is not
0: remainders 2 to 4 fit the weights, 1 the calibration.  Language, source and
id are never inputs.  At most ``MOST_LABELLED`` labelled rows are used; beyond
that a fixed share is taken by a hash of the id.

Defined results: null counts as an empty text; empty texts are scored like any
other; a null id is not held out and has no label; several labels of one id
count as their mean; without usable labels every score is 0.5; rows that
repeat an id each get their row; no rows give no rows; further columns are
ignored, and kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylace.llm.arrow import keep_rows, map_rows
from waylace.llm.statistics import FEATURES, statistics
from waylace.plans.scratch import discard, materialize

FOLDS = 5
THRESHOLD = 0.3
MOST_LABELLED = 200_000
N_FOURIER = 256
RIDGE = 1e-3
BINS = 1_024
CLIP = 5.0
SEED = 7
_FIT_TASKS = 16
_HASH_RANGE = 1 << 20


def fold(id_col: str) -> Column:
    """``crc32(id as text) mod 5``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str) -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


@dataclass(frozen=True)
class QualityModel:
    """Everything that scoring needs; a few kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        waves = np.cos(z @ self.project + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.concatenate([waves, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit of ``value`` by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, x array<double>)`` for every row."""

    def make():
        return lambda doc_id, raw: (doc_id, statistics(raw)[1])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")), make, "doc_id long, x array<double>")


def usable_labels(labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED) -> DataFrame:
    """``(doc_id, y)`` for the ids that may be learned from, at most about ``most``."""
    mean = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(label_col).alias("y")).where(~held_out("doc_id"))
    n = mean.count()
    if n > most:
        mean = mean.where(F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_RANGE)) < int(most / n * _HASH_RANGE))
    return mean


def labelled_rows(features: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED) -> DataFrame:
    """``(x, y, part)`` of rows that may be learned from; ``part`` is the id's fold."""
    return features.join(usable_labels(labels, label_col, most), "doc_id").select("x", "y", fold("doc_id").alias("part"))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
    return x, batch.column(1).to_numpy(zero_copy_only=False)


_ROWS = pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.float64()))])


def _matrix(df: DataFrame) -> np.ndarray | None:
    """The sum of the matrices that partitions sent by rows."""
    table = df.toArrow()
    if not table.num_rows:
        return None
    rows = np.array(table["sums"].to_pylist(), dtype=np.float64)
    out = np.zeros((int(max(table["i"].to_pylist())) + 1, rows.shape[1]))
    np.add.at(out, table["i"].to_numpy(), rows)
    return out


def _summed(rows: DataFrame, terms) -> np.ndarray | None:
    """``terms(x, y)`` gives a matrix; each partition sends the sum of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = terms(*_columns(batch.slice(at, 4_096)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), _ROWS.field(1).type)], schema=_ROWS)

    return _matrix(rows.select("x", "y").mapInArrow(run, "i int, sums array<double>"))


def fit_quality(labelled: DataFrame) -> QualityModel | None:
    """A model from ``(x, y, part)`` rows, or None if there is nothing to learn from."""
    rows = materialize(labelled.repartition(_FIT_TASKS), "labelled")
    fitting = rows.where("part <> 1")
    moments = _summed(fitting, lambda x, y: np.stack([np.ones(x.shape[1]) * len(x), x.sum(axis=0), (x * x).sum(axis=0)]))
    if moments is None:
        discard(rows)
        return None
    mean = moments[1] / moments[0]
    scale = np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 0.0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    d = len(FEATURES)
    blank = QualityModel(mean, scale, rng.normal(size=(d, N_FOURIER)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, N_FOURIER), np.zeros(N_FOURIER + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def normal(x, y):
        z = blank.fourier(x)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)

    system = _summed(fitting, normal)
    n = moments[0][0]
    weights = np.linalg.solve(system[:, :-1] + RIDGE * n * np.eye(N_FOURIER + 1) / N_FOURIER, system[:, -1])
    ridge = QualityModel(mean, scale, blank.project, blank.phase, weights, blank.knots, blank.values)
    low, high = -0.5, 1.5

    def binned(x, y):
        at = np.clip(((ridge.raw(x) - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)], axis=1)

    counts = _summed(rows.where("part = 1"), binned)
    if counts is None:
        counts = _summed(fitting, binned)
    discard(rows)
    used = np.flatnonzero(counts[:, 0] > 0)
    share = counts[used, 1] / counts[used, 0]
    centres = low + (used + 0.5) * (high - low) / BINS
    return QualityModel(mean, scale, blank.project, blank.phase, weights, centres, isotonic(share, counts[used, 0]))


def _scored(features: DataFrame, model: QualityModel | None) -> DataFrame:
    if model is None:
        return features.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                x = np.array(part.column(1).to_pylist(), dtype=np.float64).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    features = materialize(document_features(docs, id_col, text_col), "features")
    scores = _scored(features, fit_quality(labelled_rows(features, labels, label_col)))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below ``threshold``; all columns stay."""
    known = F.broadcast(usable_labels(labels, label_col))  # bounded by MOST_LABELLED
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).join(known, "doc_id").select("raw", "y", fold("doc_id").alias("part"))

    def make_features():
        return lambda raw, y, part: (statistics(raw)[1], y, part)

    model = fit_quality(map_rows(texts, make_features, "x array<double>, y double, part long"))
    if model is None:
        return docs

    def make():
        return lambda found: (model.score(np.array([statistics(t.encode() if t is not None else b"")[1] for t in found])) >= threshold).tolist()

    return keep_rows(docs, make, [text_col])
