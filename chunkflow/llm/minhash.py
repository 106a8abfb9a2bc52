"""Near duplicates by b-bit MinHash, confirmed on full shingle sets (operator 8).

Texts with equal shingle sets are one class, stood for by its first row. A class's minima
give band keys; of each minimum the two lowest bits are kept, packed as bit planes. Classes
that share a band key are candidates if their similarity, estimated by counting equal low
bits and corrected for chance, isn't far below the threshold; links are confirmed on the
full sets. With 32 bands of 4 minima a pair at 0.85 is missed with probability 6e-11.

No bucket is turned into all its pairs: its members are first held against hubs, and the
linked ones become components. Where a bucket still holds several components, its members
are compared in pairs if they are at most FEW, else what lies outside the largest component in
blocks (buckets.py). So no link between different components is lost.

Null and empty texts and texts without words have no shingles and link with nothing. A very long
text is hashed whole, in portions.
Repeated rows are copies. Rows with a null doc_id take part; a component's id is its
smallest non-null doc_id. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents, materialize, scratch
from .arrow import portions
from .buckets import deal_in_blocks, settle, with_hubs
from .shingles import mix, overlap, shingle_sets

MINIMA, BANDS, BITS, MARGIN = 128, 32, 2, 0.25
FEW = 16
_RNG = np.random.default_rng(85)
_A = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)

SIGNATURE = "_row long, doc_id long, text_hash long, n long, hi long, lo long, planes array<long>, bands array<long>"
_ARROW = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("planes", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(shingles), 1 << 14):
        low = (shingles[k : k + (1 << 14)] >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, (low[:, None] * _A + _B).min(0), out=out)
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    pair = np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))] if len(shingles) else [0, 0], np.uint64)
    return tuple(pair.view(np.int64).tolist())


def packed(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the low bits (2 longs a plane) and the band keys, for each row of minima."""
    low = least.astype(np.uint64)
    low = mix(low)
    planes = [np.packbits((low >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for b in range(BITS)]
    parts = low.reshape(len(low), BANDS, MINIMA // BANDS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(parts.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return np.hstack(planes), key.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """SIGNATURE of every row of docs; _row numbers the rows. In the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in portions(batch, 2):
                ids, hashed, texts = (c.to_pylist() for c in part.columns)
                sets = shingle_sets(texts, width)
                planes, bands = packed(np.stack([minima(s) for s in sets]))
                prints = [fingerprint(s) for s in sets]
                flat = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                columns = [np.arange(row, row + len(ids)), ids, hashed, [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints]]
                row += len(ids)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), flat(np.ascontiguousarray(planes)), flat(np.ascontiguousarray(bands))], schema=_ARROW)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNATURE), "signatures")


def estimate(a: str, b: str) -> Column:
    """Similarity from the planes in columns a and b: equal low bits less chance hits."""
    per = MINIMA // 64
    words = [" | ".join(f"({a}[{p * per + k}] ^ {b}[{p * per + k}])" for p in range(BITS)) for k in range(per)]
    unequal = " + ".join(f"bit_count({w})" for w in words)
    chance = 1 / (1 << BITS)
    return (F.lit(1.0) - F.expr(unequal) / F.lit(float(MINIMA)) - F.lit(chance)) / F.lit(1 - chance)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and the estimate leave room for a link."""
    sizes = F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)")
    return sizes & (estimate(f"{a}.planes", f"{b}.planes") >= percent / 100 - MARGIN)


def shingle_table(nodes: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the full sets, 8 bytes a shingle, of the rows in column node."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0):
                texts, rows, hi, lo = (c.to_pylist() for c in part.columns)
                found = [(r, s.tobytes()) for r, s, h, k in zip(rows, shingle_sets(texts, width), hi, lo, strict=True) if fingerprint(s) == (h, k)]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["node", "shingles"])

    wanted = reps.join(nodes.select(F.col("node").alias("_row")).distinct(), "_row", "left_semi").select("_row", F.col("doc_id").alias("_id"), "hi", "lo")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")))
    # several rows under one doc_id can have the same set
    held = texts.select("text", "_row", "hi", "lo").mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])
    return materialize(held, "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v): the pairs (a, b) whose full sets reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = overlap(p, q)
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(test, "u long, v long")


def spanning_links(nodes: np.ndarray, components: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all components which links between the two sides (or within the one) join.

    Overlaps come from products of 0/1 matrices over the shingles that two members share.
    """
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    shared = (n > 1)[at]
    member, column = member[shared], column[at[shared]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[member[a:b], column[a:b] - low] = 1
        both += part @ part.T
    size = np.array([len(s) for s in sets])
    linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (components[:, None] != components[None, :])
    if len(set(sides.tolist())) > 1:
        linked &= sides[:, None] != sides[None, :]
    root = {c: c for c in components.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        p, q = find(int(components[i])), find(int(components[j]))
        if p != q:
            root[p] = q
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def links_in_blocks(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of mixed buckets (key, node, component).

    Every two blocks meet in one task, which gives no more than the links that join their
    components.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(s, np.uint64) for s in df.shingles]
        links = spanning_links(df.node.to_numpy(), df.component.to_numpy(), df.side.to_numpy(), held, percent)
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    dealt = deal_in_blocks(rest).join(sets, "node")
    return dealt.groupBy("key", "i", "j").applyInPandas(run, "u long, v long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n and group (any number) of every row of docs."""
    with scratch(docs.sparkSession):
        sig = signatures(docs, width)
        classes = sig.where("n > 0").groupBy("hi", "lo").agg(F.min("_row").alias("node"))
        member = materialize(sig.join(classes, ["hi", "lo"], "left").select("_row", "doc_id", "text_hash", "n", "node"), "members")
        reps = materialize(sig.join(member.where("_row = node").select("_row"), "_row", "left_semi"), "classes")
        slim = reps.select(F.col("_row").alias("node"), "n", "planes")
        bands = reps.select(F.col("_row").alias("node"), F.explode("bands").alias("key"))
        buckets = with_hubs(bands)
        sets = shingle_table(buckets, reps, docs, width)

        def test(pairs: DataFrame) -> DataFrame:
            x, y = slim.alias("x"), slim.alias("y")
            may = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(may_link("x", "y", percent))
            return materialize(confirmed(materialize(may.select("a", "b"), "pairs"), sets, percent), "links")

        none = buckets.sparkSession.createDataFrame([], "u long, v long")
        groups = settle(buckets, none, test, lambda rows: materialize(links_in_blocks(rows, sets, percent), "links"), FEW)
        out = member.join(groups, "node", "left")
        # rows without shingles are in groups of their own
        return materialize(out.select("doc_id", "text_hash", "n", F.coalesce("component", "node", "_row").alias("group")), "near-groups", keep=True)


def duplicate_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    out = near_groups(docs, width, percent)
    least = out.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = out.join(least, "group").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, that with the smallest doc_id.

    Null doc_ids come last; under one doc_id the text with the smallest hash is kept, and of
    rows equal in both any one. All columns of docs come back.
    """
    groups = near_groups(docs, width, percent).select("group", F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    place = F.struct("late", "doc_id", "text_hash")
    kept = groups.groupBy("group").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1")
    found = materialize(groups.join(kept, "group"), "grouped").where("n > 1")
    gone = found.where(~place.eqNullSafe(F.col("kept"))).select(F.col("doc_id").alias("__cf_id"), F.col("text_hash").alias("__cf_hash")).distinct()
    # kept rows that are there more than once
    twice = found.where(place.eqNullSafe(F.col("kept"))).groupBy(F.col("doc_id").alias("__cf_id"), F.col("text_hash").alias("__cf_hash")).count().where("count > 1").drop("count")
    at = F.col("doc_id").cast("long").eqNullSafe(F.col("__cf_id")) & (F.xxhash64("text") == F.col("__cf_hash"))
    left = docs.join(gone, at, "left_anti")
    again = materialize(twice, "repeated")
    if again.isEmpty():
        return left
    one = left.join(again, at, "left_semi").withColumn("__cf_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__cf_hash"]).drop("__cf_hash")
    return left.join(again, at, "left_anti").unionByName(one)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir), width=3, percent=85)
