"""Best-fit packing by a grouping genetic algorithm (operator 1).

Items (key, length) go into sequences of at most `capacity`. Items are dealt into blocks of
bounded size by a hash; each block evolves on several islands. An individual is a set of
bins; the first ones take the items in random orders, each into the last bin or a new one. Crossover
injects another individual's well-filled bins whole, takes out the bins that now hold an item
twice and best-fits their displaced items; mutation dissolves the emptiest bins. An island stops
at the bound of bins. After every epoch each island's elite migrates to the next island of its
block, unless all blocks have met their bounds, and at last each block keeps its best island.
The bins with most room left are then dissolved and packed once more across blocks.

Items of the full capacity are sequences by themselves. Null or non-positive lengths, or
ones above the capacity, raise an error; repeated keys aren't allowed, ties are free.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents, materialize
from .arrow import portions
from .tokens import ChunkIds, vocabulary

CAPACITY, BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 16384, 2, 2, 4, 16
EOS = 1


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put items, longest first, each into the fullest bin that has room for it."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in sorted(items, key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        if over := mask >> size:
            r = size + (over & -over).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] = r = r - size
        if r:
            if not by_room.setdefault(r, []):
                mask |= 1 << r
            by_room[r].append(b)


def _rooms(bins, sizes, capacity):
    return [capacity - sum(sizes[i] for i in b) for b in bins]


def _worth(bins, sizes, capacity) -> tuple[int, int]:
    """Fewer bins first, then fuller ones: the larger the better."""
    return -len(bins), sum((capacity - r) ** 2 for r in _rooms(bins, sizes, capacity))


def _cross(one, two, sizes, capacity, rng) -> list[list[int]]:
    room = _rooms(two, sizes, capacity)
    full = sorted(range(len(two)), key=room.__getitem__)[: max(1, len(two) // 2)]
    chosen = [two[b] for b in full if rng.random() < 0.5] or [two[full[0]]]
    taken = {i for b in chosen for i in b}
    kept, loose = [list(b) for b in chosen], []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    best_fit(loose, sizes, kept, left := _rooms(kept, sizes, capacity), capacity)
    return _mutate(kept, left, sizes, capacity, rng)


def _mutate(bins, room, sizes, capacity, rng) -> list[list[int]]:
    worst = set(sorted(range(len(bins)), key=room.__getitem__, reverse=True)[: 1 + rng.randrange(1 + len(bins) // 50)])
    kept, loose = [b for k, b in enumerate(bins) if k not in worst], [i for k in worst for i in bins[k]]
    best_fit(loose, sizes, kept, _rooms(kept, sizes, capacity), capacity)
    return kept


def _random(sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    order, bins, room = list(range(len(sizes))), [], 0
    rng.shuffle(order)
    for i in order:
        if sizes[i] > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= sizes[i]
    return bins


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), population: int = POPULATION, generations: int = GENERATIONS) -> tuple[list[list[int]], int]:
    """The best individual of one island and the generations it took; stops at the bound on bins."""
    rng, least = random.Random(seed), -(-sum(sizes) // capacity)
    pool = [(_worth(bins, sizes, capacity), bins) for bins in [*(list(map(list, e)) for e in elites), *(_random(sizes, capacity, rng) for _ in range(max(2, population - len(elites))))]]
    best = lambda x: x[0]
    for n in range(generations):
        pool.sort(key=best, reverse=True)
        if len(pool[0][1]) <= least:
            return pool[0][1], n
        one, two = pool[0][1], pool[1 + rng.randrange(len(pool) - 1)][1]
        if rng.random() < 0.5:
            one, two = two, one
        child = _cross(one, two, sizes, capacity, rng)
        worth = _worth(child, sizes, capacity)
        if worth > pool[-1][0]:
            pool[-1] = (worth, child)
    return max(pool, key=best)[1], generations


def _pack_once(items: DataFrame, capacity: int, block_items: int, islands: int, epochs: int, level: int) -> DataFrame:
    """key, length, sequence_id, room of every item; every block keeps its best island."""
    n = items.count()
    blocks = max(1, -(-n // block_items))
    block = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(blocks))
    rows = items.select("key", "length", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    rows = rows.withColumns({"elite": F.lit(0), "bin": F.lit(-1).cast("int"), "generations": F.lit(0)})
    schema = "key long, length int, block long, island int, elite int, bin int, generations int, bins int, least int, room int"

    def island(epoch: int):
        def run(key, df: pd.DataFrame) -> pd.DataFrame:
            own = df[df.elite == 0].sort_values("key")
            keys, sizes = own.key.to_numpy(), own.length.tolist()
            elites = []
            for _, part in df[df.bin >= 0].groupby("elite"):
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(part.sort_values("key").bin.tolist()):
                    bins.setdefault(b, []).append(i)
                elites.append(list(bins.values()))
            best, took = evolve(sizes, capacity, hash((int(key[0]), int(key[1]), epoch, level)) & 0xFFFFFFFF, elites)
            at, room = [0] * len(sizes), [0] * len(sizes)
            for b, members in enumerate(best):
                r = capacity - sum(sizes[i] for i in members)
                for i in members:
                    at[i], room[i] = b, r
            return pd.DataFrame({"key": keys, "length": own.length.to_numpy(), "block": key[0], "island": key[1], "elite": 0, "bin": at, "generations": int(df.generations.max()) + took, "bins": len(best), "least": -(-sum(sizes) // capacity), "room": room})

        return run

    for epoch in range(epochs):
        if epoch:
            if rows.groupBy("block").agg(F.min(F.col("bins") - F.col("least")).alias("over")).where("over > 0").isEmpty():
                break
            moved = rows.withColumns({"island": F.pmod(F.col("island") + 1, F.lit(islands)), "elite": F.lit(1)})
            rows = rows.unionByName(moved)
        rows = rows.select("key", "length", "block", "island", "elite", "bin", "generations").groupBy("block", "island").applyInPandas(island(epoch), schema)
        rows = materialize(rows, "islands")
    best = rows.groupBy("block").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    sequence = F.lit(level << 56) + F.col("block") * F.lit(1 << 20) + F.col("bin")
    return rows.join(best, ["block", "island"]).select("key", "length", sequence.alias("sequence_id"), "room", "generations")


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(key, length) -> key, sequence_id, offset, generations (of the island that placed the item)."""
    bad = F.col("key").isNull() | F.col("length").isNull() | ~F.col("length").between(1, capacity)
    items = items.select("key", F.when(bad, F.raise_error(F.lit("a length outside 1 to the capacity"))).otherwise(F.col("length")).cast("int").alias("length"))
    whole = items.where(F.col("length") == capacity).select("key", "length", (F.lit(3 << 56) + F.col("key")).alias("sequence_id"), F.lit(0).alias("generations"))
    first = materialize(_pack_once(items.where(F.col("length") < capacity), capacity, block_items, islands, epochs, 1), "packed")
    loose = F.col("room") * 50 > capacity
    second = _pack_once(first.where(loose), capacity, block_items, islands, epochs, 2)
    out = whole.unionByName(first.where(~loose).drop("room")).unionByName(second.drop("room"))
    order = "(PARTITION BY sequence_id ORDER BY length DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return out.select("key", "sequence_id", F.expr(f"coalesce(sum(length) OVER {order}, 0L)").alias("offset"), "generations")


def document_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids of every document: key, doc_id, piece, start, length, ids_crc32.

    A null text is an empty one; each document ends in EOS, so each has a piece.
    keep_ids adds the ids as little-endian unsigned 32-bit numbers. key numbers the pieces.
    """
    fields = [("key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids
    arrow = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, key, step = ChunkIds(path), TaskContext.get().partitionId() << 33, capacity * 4
        for part in (p for batch in batches for p in portions(batch, 1)):
            made: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                ids = by.encode(text or "") + EOS.to_bytes(4, "little")
                for piece, k in enumerate(range(0, len(ids), step)):
                    cut_out = ids[k : k + step]
                    made.append((key, doc_id, piece, k // 4, len(cut_out) // 4, zlib.crc32(cut_out), cut_out)[: len(fields)])
                    key += 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    schema = "key long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, **how) -> DataFrame:
    """document_pieces() with their sequence_id and offset."""
    pieces = materialize(document_pieces(docs, path, capacity, keep_ids), "pieces")
    return pieces.join(pack(pieces, capacity, **how), "key").drop("key")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
