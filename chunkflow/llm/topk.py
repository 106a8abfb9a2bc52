"""Exact top-k by inner product with a three-phase uniform threshold (operator 3).

A vector's components are cut into `slices`; a query's score against a vector is the sum of
its scores on the slices, so each slice is a list to search. Phase one gathers local lists: from
one of SHARE rows, chosen by a hash, every partition gives the best of each slice's list with
their whole scores; the k-th best of them is a safe cutoff, one that no top-k score lies below.
Phase two hands it out: a sum reaches the cutoff only if some slice reaches its uniform share,
cutoff / slices, so each slice's list over all rows gives just the entries at or above the
share. Phase three works out the slices that such an entry lacks, for these entries alone, and
keeps those at or above the cutoff, of which the best k in the whole table are the answer.

Queries go out in batches of bounded bytes, each a pass over the vectors whose finds are kept in
the shared folder. Vectors that are null or hold null or non-finite components, and null ids, take
no part; only vectors of equal length meet. Rows that share a query's id aren't its candidates.
Ties go to the smaller id, rows repeated under one id count each. An empty table gives no rows,
other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import materialize

K, SLICES, SHARE, BATCH_BYTES, ROWS, QUERIES = 20, 2, 8, 16 << 20, 4096, 256
_LISTS = pa.schema([("query_id", pa.int64()), ("scores", pa.list_(pa.int64()))])
_ENTRIES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(embedding: Column) -> Column:
    """floor(64 * x) of every component; null if one is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * 64)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of one length at a time, at most ROWS of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            ids, vectors = (c.slice(at, ROWS) for c in batch.columns)
            sizes = np.diff(vectors.offsets.to_numpy()[: len(vectors) + 1])
            flat, ids, ends = vectors.flatten().to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for d in np.unique(sizes[sizes > 0]).tolist():
                of = np.flatnonzero(sizes == d)
                yield ids[of], flat[(ends[of] - d)[:, None] + np.arange(d)]


class Batch:
    """The queries of one pass, by vector length."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        by: dict[int, list[int]] = defaultdict(list)
        for i, v in enumerate(vectors):
            by[len(v)].append(i)
        self.by = {d: (np.array([ids[i] for i in rows]), np.array([vectors[i] for i in rows])) for d, rows in by.items()}

    def parts(self, vectors: np.ndarray, slices: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """For some of the queries: their ids, and the slices of their vectors and of `vectors`.

        As numbers whose sums of products are exact.
        """
        d = vectors.shape[1]
        if d not in self.by or not len(vectors):
            return
        ids, q = self.by[d]
        widest = float(np.abs(q).max()) * float(np.abs(vectors).max()) * d
        kind = np.float32 if widest < 1 << 24 else np.float64 if widest < 1 << 53 else object
        cuts = np.linspace(0, d, min(slices, d) + 1).astype(int)
        q, v = (np.split(x.astype(kind), cuts[1:-1], axis=1) for x in (q, vectors))
        for at in range(0, len(ids), QUERIES):
            yield ids[at : at + QUERIES], [x[at : at + QUERIES] for x in q], v


def best_of_lists(ids: np.ndarray, own: np.ndarray, q: list[np.ndarray], v: list[np.ndarray], k: int) -> list[list[int]]:
    """Whole scores of the k best of each slice's list, for each query."""
    scores = [a @ b.T for a, b in zip(q, v, strict=True)]
    whole, other = sum(scores), own[:, None] != ids[None, :]
    if len(ids) <= k:
        return [row[keep].tolist() for row, keep in zip(whole, other, strict=True)]
    chosen = np.zeros(whole.shape, bool)
    for s in scores:
        np.put_along_axis(chosen, np.argpartition(s, -k, axis=1)[:, -k:], True, axis=1)
    return [row[keep].tolist() for row, keep in zip(whole, chosen & other, strict=True)]


def sufficient(q: list[np.ndarray], v: list[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) places of the entries at or above the cutoff, and the slice scores resolved.

    A slice's list gives its entries at or above the uniform share; what an entry lacks is
    worked out for it alone. A cutoff of minus infinity lets all through.
    """
    share, n = np.array([c if c == -np.inf else -(-c // len(q)) for c in cutoff.tolist()], cutoff.dtype), len(v[0])
    lists = []
    for a, b in zip(q, v, strict=True):
        s = a @ b.T
        at = np.flatnonzero(s >= share[:, None])
        lists.append((at, s.ravel()[at]))
    entries, resolved = np.unique(np.concatenate([at for at, _ in lists])), 0
    i, j = entries // n, entries % n
    score = np.zeros(len(entries), q[0].dtype)
    for (at, s), a, b in zip(lists, q, v, strict=True):
        have = np.isin(entries, at, assume_unique=True)
        score[have] += s
        lack = np.flatnonzero(~have)
        resolved += len(lack)
        score[lack] += (a[i[lack]] * b[j[lack]]).sum(1)
    keep = score >= cutoff[i]
    return i[keep], j[keep], score[keep], resolved


def search(vectors: DataFrame, queries: DataFrame, k: int = K, batch_bytes: int = BATCH_BYTES, slices: int = SLICES, share: int = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score; both tables hold vec_id and v, an array of longs."""
    spark = vectors.sparkSession
    vectors, queries = (x.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where("vec_id is not null and v is not null and size(v) > 0") for x in (vectors, queries))
    total = queries.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    batches, out = max(1, -(-total // batch_bytes)), spark.createDataFrame([], "query_id long, vec_id long, score long")
    for b in range(batches):
        part = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(batches)) == b).toArrow()  # about batch_bytes
        batch = spark.sparkContext.broadcast(Batch(part["vec_id"].to_pylist(), part["v"].to_pylist()))

        def gather(rows: Iterator[pa.RecordBatch], batch=batch) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[int]] = {}
            for ids, v in _blocks(rows):
                for own, q, own_v in batch.value.parts(v, slices):
                    for i, got in zip(own.tolist(), best_of_lists(ids, own, q, own_v, k), strict=True):
                        best[i] = sorted(best.get(i, []) + got)[-k:]
            for at in range(0, len(best), 5000):
                some = list(best.items())[at : at + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in some], pa.int64()), pa.array([[int(x) for x in s] for _, s in some], pa.list_(pa.int64()))], schema=_LISTS)

        lists = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(share)) == 0)
        lists = lists.mapInArrow(gather, "query_id long, scores array<long>").groupBy("query_id")
        lists = lists.agg(F.sort_array(F.flatten(F.collect_list("scores")), asc=False).alias("s"))
        cut = {r.query_id: r.cut for r in lists.select("query_id", F.get("s", F.lit(k - 1)).alias("cut")).where("cut is not null").collect()}  # a number for each query of the batch
        cutoff = spark.sparkContext.broadcast(cut)

        def collect(rows: Iterator[pa.RecordBatch], batch=batch, cutoff=cutoff) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for ids, v in _blocks(rows):
                for own, q, own_v in batch.value.parts(v, slices):
                    i, j, score, _ = sufficient(q, own_v, np.array([cutoff.value.get(x, -np.inf) for x in own.tolist()], object if q[0].dtype == object else np.float64))
                    for x, y, s in zip(own[i].tolist(), ids[j].tolist(), score.tolist(), strict=True):
                        if x != y:
                            held[x].append((-int(s), y))
                            if len(held[x]) >= 50 * k:
                                held[x] = sorted(held[x])[:k]
            made = [(x, y, -s) for x, got in held.items() for s, y in sorted(got)[:k]]
            for at in range(0, len(made), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made[at : at + 10_000], strict=True)], schema=_ENTRIES)

        out = out.unionByName(materialize(vectors.mapInArrow(collect, "query_id long, vec_id long, score long"), "entries"))
        batch.destroy()
        cutoff.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantized(F.col("embedding")).alias("v"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP3_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
