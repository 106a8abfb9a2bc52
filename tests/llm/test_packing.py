from __future__ import annotations

import zlib
from array import array

import pytest

from chunkflow.llm import packing
from chunkflow.llm.tokens import ChunkIds, vocabulary

VOCAB = vocabulary("word_bpe_49k.json")


def sound(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table_is_cut_and_packed_to_the_bound(spark, tiny):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCAB)
    rows = packing.op1_packing(spark, tiny).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(ids)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), zlib.crc32(array("I", part).tobytes()), r.start) == (r.length, r.ids_crc32, 4096 * r.piece)
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total
    assert sound(rows, 4096) <= -(-total // 4096) + 1


def test_odd_documents(spark, messy, nothing):
    rows = packing.pack_documents(messy, VOCAB, block_items=4).collect()
    assert sound(rows, 4096) < 40
    assert sorted(r.length for r in rows if r.doc_id in (3, 4, 5)) == [1, 1, 1]
    assert sum(r.doc_id == 8 for r in rows) == 2 and any(r.doc_id is None for r in rows)
    assert packing.pack_documents(nothing, VOCAB).collect() == []


#: Lengths that best fit, longest first, packs in one bin of 100 more than they need.
HARD = [[38, 27, 35, 27, 45, 28, 24, 45, 31], [32, 37, 31, 36, 29, 35, 34, 35, 31], [32, 33, 35, 44, 56, 40, 60, 32, 42, 26]]


@pytest.mark.parametrize("sizes", HARD)
def test_evolving_needs_fewer_bins_than_best_fit(sizes):
    first: list[list[int]] = []
    packing.best_fit(list(range(len(sizes))), sizes, first, [], 100)
    best, generations = packing.evolve(sizes, 100, 1, generations=200)
    assert sorted(i for b in best for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in best)
    assert len(best) == len(first) - 1 == -(-sum(sizes) // 100) and generations > 0


def test_islands_migrate_and_beat_best_fit(spark):
    sizes = HARD[0]
    first: list[list[int]] = []
    packing.best_fit(list(range(len(sizes))), sizes, first, [], 100)
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, length int").repartition(3)
    rows = packing.pack(items, 100, islands=2, epochs=12).collect()
    assert len({r.sequence_id for r in rows}) < len(first) and max(r.generations for r in rows) > 0
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, sizes[r.key]) for r in rows if r.sequence_id == s)
        assert [at for at, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 100


def test_lengths_out_of_range_are_errors(spark):
    with pytest.raises(Exception, match="capacity"):
        packing.pack(spark.createDataFrame([(1, 0), (2, 5)], "key long, length int"), 10).collect()


def test_chunk_ids_equal_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    tokenizer, own, rng = Tokenizer.from_file(VOCAB), ChunkIds(VOCAB), random.Random(4)
    parts = ["a", "É", "é", "é", "́", "İ", "Σ", "'s", "'S", "1", "½", "<|endoftext|>", "<|", "😀", "中", "\x1c", "\x85", "\xa0", " ", "​", "\n", "-", "ﬁ", "नि"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert list(array("I", own.encode(s))) == tokenizer.encode(s, add_special_tokens=False).ids, repr(s)
