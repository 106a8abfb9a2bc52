"""Byte-level BPE, periodic runs and alignment of tokenizers, against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN

from chunkflow.llm import aligning, bytebpe, runs
from chunkflow.llm.tokens import vocabulary

RANKS, A_PATH, B_PATH = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["a", " ", "\n", "\t", " ", "\x85", "\x1c", "　", "é", "漢", "🙂", "́", "'s", "12", "!", "=", "--", "<|endoftext|>", "▁", "\x00", "﻿", "᠎", "the ", "ß"]


def strings(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 25))) for _ in range(n)] + [c * k for c in "a =\n" for k in (2, 7, 100, 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*strings(4, 300), None, ""]
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# byte-level BPE


def test_ids_are_those_of_the_rank_file(reference):
    bpe = bytebpe.byte_bpe(RANKS, PATTERN)
    texts = [*strings(1, 3000), *(f"a{chr(c)}b {chr(c)}{chr(c)} !{chr(c)}\n {chr(c)}1" for c in range(0x3100))]
    ids, counts = bpe.encode(texts)
    want = reference.encode_ordinary_batch(texts)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [len(x) for x in bpe.encode(["", ""])] == [0, 2] and [len(x) for x in bpe.encode([])] == [0, 0]


def test_encode_and_decode_rows(spark, odd, messy, nothing, reference):
    for docs in (odd, messy):
        made = bytebpe.encode(docs, RANKS, PATTERN)
        for r in made.collect():
            text = r.text or ""
            assert r.ids == reference.encode_ordinary(text)
            at, spans = 0, []
            for i in r.ids:
                size = len(reference.decode_single_token_bytes(i))
                spans.append((len(text.encode()[:at].decode(errors="ignore")), len((text.encode()[: at + size] + b"").decode(errors="replace"))))
                at += size
            assert list(zip(r.starts, r.ends, strict=True)) == spans
        back = bytebpe.decode(made, RANKS, PATTERN).collect()
        assert len(back) == docs.count()
        assert all(bytes(r.bytes) == (r.text or "").encode() and r.decoded == (r.text or "") and (r.lead, r.tail) == (0, 0) for r in back)
    assert bytebpe.decode(bytebpe.encode(nothing, RANKS, PATTERN), RANKS, PATTERN).collect() == []


def test_pieces_that_split_characters(spark, reference):
    text = "漢字🙂é̂ のみ 🙂🙂 ok"
    ids = reference.encode_ordinary(text)
    pieces = [(k, ids[k : k + 1]) for k in range(len(ids))] + [(len(ids), None)]
    rows = bytebpe.decode(spark.createDataFrame(pieces, "k int, ids array<int>").coalesce(1), RANKS, PATTERN).orderBy("k").collect()
    assert b"".join(bytes(r.bytes) for r in rows).decode() == text
    assert any(r.lead for r in rows) and any(r.tail for r in rows)
    for r in rows:
        data = bytes(r.bytes)
        assert data[r.lead : len(data) - r.tail].decode() == r.decoded


def test_whole_characters():
    data = "a漢🙂".encode()
    for a in range(len(data) + 1):
        for b in range(a, len(data) + 1):
            text, lead, tail = bytebpe.whole_characters(data[a:b])
            assert data[a + lead : b - tail].decode() == text and lead < 4 and tail < 4


def test_op11(spark, tiny, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = bytebpe.op11_byte_bpe(spark, tiny).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(docs[r.doc_id]))


# periodic runs


def plain_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // times + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            part = words[s : s + length]
            if length >= max(least, times * q) and not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out)


def collapse(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repeating(rng: random.Random, alphabet: int, n: int) -> list[str]:
    words = [str(rng.randint(1, alphabet)) for _ in range(n)]
    if n > 3 and rng.random() < 0.6:
        p, a = rng.randint(1, n // 2), rng.randint(0, n - 1)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3), (9, 2), (1, 2)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(150):
        texts = [repeating(rng, rng.choice([1, 2, 3, 40]), rng.choice([0, 1, 6, 7, 30, 70])) for _ in range(rng.randint(1, 6))]
        codes = np.array([int(x) for t in texts for x in [*t, "0"]], np.int32)
        of = np.array([k for k, t in enumerate(texts) for _ in range(len(t) + 1)], np.int32)
        want, at = [], 0
        for t in texts:
            want += [(s + at, length, q) for s, length, q in plain_runs(t, least, times)]
            at += len(t) + 1
        assert list(zip(*(x.tolist() for x in runs.periodic_runs(codes, of, least, times)), strict=True)) == sorted(want)


def test_find_runs_in_rows(spark, messy, nothing):
    rng = random.Random(7)
    gaps = [" ", "\n", "\t ", "\x0b", "  "]
    texts = ["".join(w + rng.choice(gaps) for w in repeating(rng, 3, rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "  \n", " a a\x1ca a a a a a a a ", "ab cd " * 9, "x " * 20_000, "é a é a é a é a é"]
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, collapsed string").repartition(3)
    for table in (docs, messy):
        rows = runs.find_runs(table).collect()
        assert len(rows) == table.count() and set(table.columns) <= set(rows[0].asDict())
        for r in rows:
            words = [w.decode() for w in (r.text or "").encode().split()]
            found = [tuple(x) for x in r.runs]
            if len(words) < 5000:
                assert found == plain_runs(words)
            assert (r.n_words, r.collapsed) == (len(words), collapse(words, found))
    assert [tuple(x) for x in runs.find_runs(docs.where("text like 'x x%'")).first().runs] == [(0, 20_000, 1)]
    assert runs.find_runs(nothing).collect() == []
    with pytest.raises(ValueError, match="twice"):
        runs.find_runs(docs, times=1)


def test_op12(spark, tiny):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = runs.op12_periodic_runs(spark, tiny).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    with_runs = 0
    for r in rows:
        words = [w.decode() for w in docs[r.doc_id].encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words) if n < 3000 else [(s, size, q) for s, size, q in plain_runs(words)]
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert (r.n_runs, r.runs_sha256) == (len(found), sha("".join(f"{s},{size},{q}\n" for s, size, q in found)))
        assert r.collapsed_sha256 == sha(collapse(words, found))
        with_runs += bool(found)
    assert with_runs


# alignment


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    back = {c: x for x, c in enumerate(bytebpe.byte_letters())}
    as_bytes = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    out, counts = [], Counter()
    for text in texts:
        ids = [a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        spelt = [[bytes([back[c] for c in a.id_to_token(i)]) for i in ids[0]], [as_bytes(b.id_to_piece(i)) for i in ids[1]]]
        if text and any(b"".join(s) != f" {text}".encode() for s in spelt):
            ids, spelt = [[], []], [[], []]
        ends = [{sum(map(len, s[: k + 1])): k for k in range(len(s))} for s in spelt] if len(spelt[0]) < 3000 else [dict(zip(np.cumsum([len(x) for x in s]).tolist(), range(len(s)), strict=True)) for s in spelt]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for c in cuts:
            x, y = ends[0][c] + 1, ends[1][c] + 1
            groups.append(f"{','.join(map(str, ids[0][i:x]))}|{','.join(map(str, ids[1][j:y]))}")
            links.append((x - 1, y - 1))
            i, j = x, y
        counts.update((ids[0][x], ids[1][y]) for x, y in links)
        out.append((ids, groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    final = []
    for ids, groups, links in out:
        each = [(counts[ids[0][x], ids[1][y]], most[ids[1][y]]) for x, y in links]
        text = ";".join(groups)
        final.append((len(ids[0]), len(ids[1]), len(groups), len(links), sum(n == m for n, m in each), sum(n for n, _ in each), sha(text) if text else "", ids, groups, links))
    return final


def test_alignment_equals_a_plain_one(spark, odd, messy, nothing):
    for docs in (odd, messy):
        rows = docs.collect()
        want = Counter((r.doc_id, *w[:7]) for r, w in zip(rows, plain_alignment([r.text for r in rows]), strict=True))
        for head in (3, 50, 200_000):
            got = Counter(tuple(r) for r in aligning.link_counts(docs, A_PATH, B_PATH, head=head).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
            assert got == want
    assert aligning.link_counts(nothing, A_PATH, B_PATH).collect() == [] and aligning.align(nothing, A_PATH, B_PATH).collect() == []


def test_alignment_rows(spark, odd):
    rows = aligning.align(odd, A_PATH, B_PATH).collect()
    assert {"text", "ids"} <= set(rows[0].asDict())
    for r, (*_, ids, groups, links) in zip(rows, plain_alignment([r.text for r in rows]), strict=True):
        assert [r.a_ids, r.b_ids] == ids and list(zip(r.link_a, r.link_b, strict=True)) == links
        assert len(r.a_sizes) == len(r.b_sizes) == len(groups)


@pytest.mark.parametrize("seed", range(5))
def test_lockstep_equals_set_intersection(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    a, b = (np.unique(np.append(1 + rng.choice(n, int(rng.integers(1, n + 1))), n)) for _ in range(2))
    cuts = np.intersect1d(a, b)
    for edges in ([0, n], [0, *sorted(set(rng.integers(1, n + 1, 7).tolist())), n], range(n + 1)):
        x, y = aligning.lockstep(a, b, np.array(edges))
        assert a[x].tolist() == cuts.tolist() and b[y].tolist() == cuts.tolist()


def test_op13(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w[:7] for r, w in zip(docs, plain_alignment([r.text for r in docs]), strict=True)}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in aligning.op13_alignment(spark, tiny).collect()}
    assert got == want
