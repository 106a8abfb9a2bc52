"""Quality scores: random Fourier features and ridge regression, calibrated (operator 4).

Statistics of a whole text are standardised and mapped to cosines of random projections,
which approximate a Gaussian kernel. Every partition sums its part of the normal equations;
the sums, of a size that only `features` sets, meet on the driver. Isotonic regression on
labelled rows that the ridge fit didn't see turns raw scores into probabilities.

At most about `most_labels` labelled rows are learned from, chosen by a hash of doc_id.
Null and empty texts have the statistics of an empty text. Rows with a null doc_id or label
aren't learned from; a doc_id with several labels counts once for each. Without any labelled
row every score is 0.5. Repeated rows are scored each; other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ._spark import documents, materialize
from .arrow import portions

FEATURES, RIDGE, SEED, MOST_LABELS, BINS = 256, 1e-3, 7, 400_000, 4000
THRESHOLD = 0.3
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1

_CLASS = np.zeros(256, np.int64)  # 0 letters and bytes above ASCII, 1 lower-case is in 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:!?'\"-()"]] = 6
_CLASS[[*range(9), *range(14, 32), 127]] = 7


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text that don't depend on its language."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, len(data))
    by_byte = np.bincount(data, minlength=256)
    share = np.bincount(_CLASS, by_byte, minlength=8) / n
    p = by_byte[by_byte > 0] / n
    words = (text or "").split()
    m = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, counts), np.float64, len(counts)) if counts else np.zeros(1)
    times = np.fromiter(counts.values(), np.float64, len(counts)) if counts else np.ones(1)
    mean = float(lengths @ times) / m
    spread = math.sqrt(max(0.0, float(lengths**2 @ times) / m - mean**2))
    again = sum(map(str.__eq__, words, words[1:])) / m
    tails = sum(c for w, c in counts.items() if not (w[-1].isalnum() or w[-1] in ".,;:!?'\"-)")) / m
    lines = (text or "").split("\n")
    return [
        math.log1p(n) / 10, *share.tolist(), -float(p @ np.log2(p)) if len(p) else 0.0, mean / 10, spread / 10,
        len(counts) / m, math.log1p(len(counts)) / math.log1p(m), float(times.max()) / m, again, tails,
        float(times[lengths <= 1].sum()) / m, len(set(lines)) / len(lines), math.log1p(len(lines)) / 10,
    ]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.project + self.phase
        return np.hstack([np.cos(z) * math.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a little of the raw score keeps the order within a level."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def with_statistics(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, x (the statistics) and the columns named in keep; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, 1)):
            x = [statistics(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64())), *(part.column(k) for k in at)], ["__cf_id", "__cf_x", *keep])

    more = [c for c in keep if c != "text"]
    at = [1 if c == "text" else 2 + more.index(c) for c in keep]
    schema = StructType([StructField("__cf_id", LongType()), StructField("__cf_x", ArrayType(DoubleType())), *(docs.schema[c] for c in keep)])
    rows = docs.select(F.col("doc_id").cast("long").alias("__cf_id"), F.col("text"), *(F.col(f"`{c}`") for c in more)).mapInArrow(run, schema)
    return materialize(rows, "statistics")


def isotonic(x: np.ndarray, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins at x: knots and non-decreasing levels."""
    blocks: list[list[float]] = []
    for at, s, k in zip(x.tolist(), sums.tolist(), n.tolist(), strict=True):
        blocks.append([at, at, s, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, s2, k2 = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + s2, blocks[-1][3] + k2]
    knots = [v for b in blocks for v in b[:2]]
    return np.array(knots) + np.arange(len(knots)) * 1e-9, np.array([v for b in blocks for v in [b[2] / b[3]] * 2])


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """Sum over partitions of the matrix that part(x, y) gives for a batch: one row a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                got = part(np.array(batch.column(0).to_pylist(), np.float64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
                total = got + (total if len(total) else 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["line", "sums"])

    def add(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": df.line[:1], "sums": [sum(np.frombuffer(b) for b in df.sums).tobytes()]})

    lines = rows.mapInArrow(run, "line int, sums binary").groupBy("line").applyInPandas(add, "line int, sums binary").collect()
    return np.array([np.frombuffer(bytes(r.sums)) for r in sorted(lines, key=lambda r: r.line)])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", features: int = FEATURES, ridge: float = RIDGE, most_labels: int = MOST_LABELS) -> Model | None:
    """Learn from labelled rows outside the held-out fold; None if there are none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.withColumn("fold", fold(F.col("doc_id"), FOLDS)).where(F.col("fold") != HELD_OUT)
    n = known.count()
    if not n:
        return None
    if n > most_labels:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_labels / n))
    rows = stats.select(F.col("__cf_id").alias("doc_id"), F.col("__cf_x").alias("x")).join(known, "doc_id").select("x", "y", "fold")
    # few, bounded rows: as few partitions as their sums need
    rows = materialize(rows.repartition(max(1, -(-min(n, most_labels) // 4000))), "labelled")
    learn = rows.where(F.col("fold") != CALIBRATION).select("x", "y")
    moments = _summed(learn, lambda x, y: np.vstack([x.sum(0), (x**2).sum(0), np.full(x.shape[1], len(x))]), 0)
    if not len(moments):
        return None
    mean = moments[0] / moments[2]
    scale = np.sqrt(np.maximum(moments[1] / moments[2] - mean**2, 1e-8))
    rng = np.random.default_rng(SEED)
    project = rng.normal(size=(len(mean), features)) / math.sqrt(2 * len(mean))
    model = Model(mean, scale, project, rng.uniform(0, 2 * math.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))

    def normal(x, y):
        z = model.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = _summed(learn, normal, features + 2)
    weights = np.linalg.solve(sums[:, :-1] + ridge * moments[2][0] * np.eye(features + 1), sums[:, -1])
    model = model._replace(weights=weights)

    def binned(x, y):
        at = np.clip(((model.raw(x) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.vstack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    sums = _summed(rows.where(F.col("fold") == CALIBRATION).select("x", "y"), binned, BINS)
    if not len(sums):
        return model._replace(knots=np.array([0.0, 1.0]), levels=np.array([0.0, 1.0]))
    full = np.flatnonzero(sums[1])
    knots, levels = isotonic((full + 0.5) / BINS * 3 - 1, sums[0][full], sums[1][full])
    return model._replace(knots=knots, levels=levels)


def score_statistics(x: Column, model: Model | None) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows.to_numpy())) if len(rows) else [], dtype="float64")

    return score(x)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that a classifier learned from labels scores at the threshold or above.

    Each text's statistics are worked out once; they and the rows wait in the shared folder
    until the model is there.
    """
    stats = with_statistics(docs, docs.columns)
    good = stats.where(score_statistics(F.col("__cf_x"), fit(stats, labels)) >= threshold)
    return good.drop("__cf_id", "__cf_x")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = with_statistics(documents(spark, sf_dir))
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold(F.col("__cf_id"), FOLDS) == HELD_OUT, F.lit(False))
    out = stats.select(F.col("__cf_id").alias("doc_id"), held_out.alias("held_out"), score_statistics(F.col("__cf_x"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
