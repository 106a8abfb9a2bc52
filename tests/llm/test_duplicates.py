"""Near duplicates, line dedup, decontamination and the pipeline, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkflow.llm import buckets, decontam, lines, minhash
from chunkflow.llm._spark import connected_components, materialize

from .conftest import prose


def shingles(text, width):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(words)} if 0 < len(words) < width else set(zip(*(words[k:] for k in range(width)), strict=False))


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def grouped(texts: dict[int, str], width: int, percent: int):
    sets, group = {i: shingles(t, width) for i, t in texts.items()}, Union()
    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            group.join(a, b)
    return {i: (len(sets[i]), group.find(i)) for i in texts}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, tiny, width, percent):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = grouped({r.doc_id: r.text for r in docs.collect()}, width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.duplicate_groups(docs, width, percent).collect()}
    assert got == want


@pytest.mark.parametrize("copies", [0, 100])
def test_a_large_group_of_near_copies(spark, monkeypatch, copies):
    monkeypatch.setattr(minhash, "FEW", 4)
    monkeypatch.setattr(buckets, "COPIES", copies)
    monkeypatch.setattr(buckets, "BLOCK", 16)
    base, rng, texts = prose(1, 120).split(), random.Random(3), {}
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(50)}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.duplicate_groups(docs, 3, 85).collect()}
    assert got == grouped(texts, 3, 85)


def test_odd_documents(spark, messy, nothing):
    rows = minhash.duplicate_groups(messy, 3, 85).collect()
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert len(rows) == messy.count()
    assert by[2, 78] == (1, False) and by[3, 0] == (3, True) and by[4, 0] == (4, True) and by[8, 1] == (8, True)
    assert next(r.component_id for r in rows if r.doc_id == 7) == 6
    assert next(r for r in rows if r.doc_id is None).kept
    assert minhash.duplicate_groups(nothing).collect() == []


def test_estimate_is_near_the_similarity():
    from chunkflow.llm.shingles import overlap, shingle_sets

    one, two = shingle_sets([prose(1, 300), prose(1, 270) + " x y z"], 3)
    least = np.stack([minhash.minima(one), minhash.minima(two)])
    planes, bands = minhash.packed(least)
    unequal = sum(bin(int(np.bitwise_or.reduce([planes[0, 2 * p + k] ^ planes[1, 2 * p + k] for p in range(2)])) & (1 << 64) - 1).count("1") for k in range(2))
    both = overlap(one, two)
    assert abs((1 - unequal / 128 - 0.25) / 0.75 - both / (len(one) + len(two) - both)) < 0.15
    assert bands.shape == (2, 32)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 7), (200, 201), (5, 5), (None, 3)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {got[i] for i in [*range(61), 100]} == {0} and got[201] == 200 and {got[i] for i in range(300, 340)} == {300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def kept_lines(texts: dict[int, str]):
    """doc_id -> remaining text, by comparing all lines with each other."""
    places: dict[str, list[tuple[int, int]]] = {}
    for i, t in texts.items():
        for n, line in enumerate(t.split("\n")):
            if norm := lines.normalised(line):
                places.setdefault(norm, []).append((i, n))
    keys, group = list(places), Union()
    bags = np.zeros((len(keys), 256), np.int32)
    for k, norm in enumerate(keys):
        np.add.at(bags[k], [ord(c) % 256 for c in norm], 1)
    sizes = bags.sum(1)
    for a in range(len(keys)):
        # an edit changes two counts by one at most
        may = 5 * np.maximum(np.abs(bags - bags[a]).sum(1) / 2, np.abs(sizes - sizes[a])) <= np.maximum(sizes, sizes[a])
        for b in np.flatnonzero(may[:a]).tolist():
            if group.find(a) != group.find(b) and lines.similar(keys[a], keys[b]):
                group.join(a, b)
    first: dict[int, tuple[int, int]] = {}
    for k, norm in enumerate(keys):
        g = group.find(k)
        first[g] = min(first.get(g, places[norm][0]), min(places[norm]))
    gone = {p for k, norm in enumerate(keys) for p in places[norm] if p != first[group.find(k)]}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts.items()}


@pytest.mark.parametrize(("copies", "batch"), [(0, "7"), (100, "10000")])
def test_lines_equal_brute_force(spark, monkeypatch, copies, batch):
    monkeypatch.setattr(lines, "FEW", 4)
    monkeypatch.setattr(buckets, "BLOCK", 16)
    monkeypatch.setattr(buckets, "COPIES", copies)
    rng, base, texts = random.Random(8), prose(4, 120).split(), {}
    for i in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(30)}"
        texts[i] = "\n".join([prose(100 + i, 30), " ".join(own), "", "Same, line here!", prose(500 + i % 7, 9)])
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()], "doc_id long, text string, node string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == kept_lines(texts)


def test_lines_with_some_changed_words_are_linked(spark):
    rng, texts, want = random.Random(5), {}, set()
    for i in range(120):
        own = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range((2, 4, 7, 12, 30, 90)[i % 6])]
        near = list(own)
        for _ in range(max(1, len(own) // 9)):
            k = rng.randrange(len(near))
            near[k] = near[k][:-1] + "z" if i % 2 or len(own) < 8 else "".join(rng.choice("klmnop") for _ in near[k])
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(near)
        if lines.similar(texts[2 * i], texts[2 * i + 1]):
            want.add(2 * i + 1)
    assert len(want) > 100
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in lines.dedup_lines(docs).where("lines_gone = 1").collect()}
    assert got <= want and len(got) >= 0.95 * len(want)  # keys are drawn by chance


def test_odd_lines(spark, messy, nothing):
    out = lines.dedup_lines(messy)
    rows = out.collect()
    assert len(rows) == messy.count() and set(out.columns) == set(messy.columns)
    assert sorted((r.text or "?") for r in rows if r.doc_id == 8) == ["one two", "one two"]
    assert next(r.text for r in rows if r.doc_id == 2) == "" and next(r.text for r in rows if r.doc_id == 3) is None
    assert next(r.text for r in rows if r.doc_id == 11) == "!!! ???"
    assert lines.dedup_lines(nothing).collect() == []


def test_tiny_lines_within_their_edits_share_a_deletion():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice([[], ["a"], ["d"]])
        b = "".join(b)
        if b and len(b) <= lines.TINY and lines.similar(a, b):
            assert lines.deletions(a) & lines.deletions(b)


def test_near_duplicates_go_by_row(spark, messy, nothing):
    one, two, other = prose(1, 80), prose(1, 80) + " end", prose(7, 80)
    rows = [(3, one), (8, two), (8, other), (3, one), (None, one), (None, other), (None, None), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"group": F.lit(1), "kept": F.lit("x")}).repartition(3)
    out = minhash.without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, ""), (-1, ""), (3, one), (8, other), (9, "")]
    assert minhash.without_near_duplicates(nothing).collect() == [] and minhash.without_near_duplicates(messy).count() == messy.count() - 3


def test_edit_distance():
    rng = random.Random(1)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 13))) for _ in "ab")
        assert lines.edits(a, b) == slow(a, b)


def test_leaks_with_edits_case_and_cuts(spark):
    rng, rows, want = random.Random(6), [], set()
    items = [(k, prose(1000 + k, 40)) for k in range(12)]
    for k, text in items:
        for how in range(4):
            own = list(text)
            for _ in range(int(len(own) * 0.05) if how == 1 else 0):
                p = rng.randrange(len(own))
                own[p : p + 1] = rng.choice([[], ["q"], [own[p], "q"]])
            t = "".join(own)
            t = t.upper().replace(" ", ",\n ") if how == 2 else t[20 : 20 + 170] if how == 3 else t
            rows.append((len(rows), prose(len(rows), 50) + " " + t + " " + prose(len(rows) + 77, 50), "x"))
            want.add((len(rows) - 1, k))
    rows += [(1000 + i, prose(5000 + i, 200), "x") for i in range(60)] + [(2000, None, None), (2001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([*items, (90, None), (91, "short"), (None, "x" * 50)], "item_id long, text string")
    out = decontam.with_leaks(docs, bench)
    got = {(r.doc_id, x.item_id) for r in out.collect() for x in r.leaks}
    assert got == want
    spans = [(r.text[x.start : x.stop], x.edits) for r in out.collect() for x in r.leaks if x.edits == 0]
    plain = lambda s: " ".join(re.findall(r"\w+", s.lower()))
    assert all(any(plain(s) in plain(t) for _, t in items) for s, _ in spans)
    assert decontam.with_leaks(docs.limit(0), bench).collect() == [] and {len(r.leaks) for r in decontam.with_leaks(docs, bench.limit(0)).collect()} == {0}


def test_leaks_in_long_texts_and_batches(spark, monkeypatch):
    item = prose(77, 30)
    text = prose(5, 70_000) + " " + item + " " + prose(6, 70_000)
    found = decontam.find_leaks(decontam.normalized(text)[0], decontam.Index.of([(4, item, True)]))
    assert [x[0] for x in found] == [4]
    bench = spark.createDataFrame([(k, prose(k, 30)) for k in range(6)], "item_id long, text string")
    assert sum(1 for _ in decontam.item_batches(bench, 300)) > 2


def test_leaks_equal_an_alignment_of_every_segment(spark):
    """Against the whole table of edits of every segment of every item and each text."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip()
    items = [(k, letters(n)) for k, n in enumerate((25, 60, 99, 100, 131, 180, 320))]
    texts = []
    for _ in range(60):
        item = rng.choice(items)[1]
        a = rng.randrange(max(1, len(item) - 90))
        part = list(item[a : a + rng.choice((60, 104, 120, 400))])
        for _ in range(rng.randint(0, 11)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["z"], [part[k], "z"]])
        texts.append(letters(70) + " " + "".join(part) + " " + letters(50))

    def least(own, text):
        row = np.zeros(len(text) + 1, int)
        for i, c in enumerate(own, 1):
            new = np.minimum(np.concatenate([[i], row[:-1] + (text != c)]), np.concatenate([[i], row[1:] + 1]))
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        return row.min()

    index, seen = decontam.Index.of([(*x, True) for x in items]), set()
    for text in texts:
        codes, want = decontam.normalized(text)[0], {}
        for k, (item, own) in enumerate(zip(index.items.tolist(), index.codes, strict=True)):
            last = max(0, len(own) - decontam.SEGMENT)
            edits = min(least(own[a : a + decontam.SEGMENT], codes) for a in {*range(0, last + 1, decontam.STRIDE), last})
            if edits <= index.budget[k]:
                want[item] = edits
        assert {i: e for i, _, _, e in decontam.find_leaks(codes, index)} == want
        seen |= set(want.values())
    assert len(seen) > 5
    # several batches give what one does, and short items stand as whole words
    items = [*items, (50, "Ab c"), (51, "abcdefgh"), (52, "?!"), (0, items[0][1]), (53, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "x, ab - C!", "ab cd", None, "", texts[0]])], "doc_id long, text string").withColumns({"leaks": F.lit(1), "item_id": F.lit("i")})
    found = [{(r.doc_id, x.item_id, x.start, x.stop, x.edits) for r in decontam.with_leaks(docs, bench, batch_chars=n).collect() for x in r.leaks} for n in (decontam.BATCH_CHARS, 300)]
    assert found[0] == found[1] and (len(texts), 50, 3, 9, 0) in found[0] and not any(x[0] == len(texts) + 1 for x in found[0])
    left = {r.doc_id for r in decontam.without_leaks(docs, bench).collect()}
    assert left == set(range(len(texts) + 5)) - {x[0] for x in found[0] if x[3] - x[2] >= decontam.SHORTEST} and len(texts) in left


def test_a_very_long_item_is_met_anywhere(spark, nothing):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(30_000)]
    item = " ".join(rng.choices(words, k=330_000))
    assert len(item) > 2_000_000
    bench = spark.createDataFrame([(7, item), (8, "a short one of the usual kind, met whole or not at all by a text"), (7, item)], "item_id long, text string")
    step = decontam.PART_CHARS - decontam.OVERLAP
    places = [0, len(item) - 130, *(k * step + d for k in (1, 5, 20) for d in (-130, -60, 0, decontam.OVERLAP - 60, decontam.OVERLAP)), *(rng.randrange(len(item)) for _ in range(10))]
    docs = spark.createDataFrame([(k, f"before {item[at : at + 130]} after") for k, at in enumerate(places)] + [(99, " ".join(rng.choices(words, k=60)))], "doc_id long, text string")
    found = {r.doc_id: {(x.item_id, x.edits) for x in r.leaks} for r in decontam.with_leaks(docs, bench).collect()}
    assert found == {k: {(7, 0)} for k in range(len(places))} | {99: set()}
    assert {r.doc_id for r in decontam.without_leaks(docs, bench).collect()} == {99}
    parts = decontam.item_parts(bench.limit(1)).collect()
    assert len(parts) > 20 and max(len(r.part) for r in parts) == decontam.PART_CHARS and not any(r.entire for r in parts)


def test_banded_alignment_equals_the_whole_table():
    rng = random.Random(3)
    for _ in range(200):
        own = np.array([rng.randrange(4) for _ in range(20)], np.uint32)
        text = np.array([rng.randrange(4) for _ in range(5)] + [c for c in own.tolist() if rng.random() > 0.06] + [9] * 12, np.uint32)[:31]
        row = [0] * (len(text) + 1)
        for i, c in enumerate(own, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + int(c != y)))
            row = new
        if min(row) <= 3:
            assert decontam.banded(own, text[None, :])[0][0] == min(row)


def test_pipeline_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, tiny), name)
        seen[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = map(texts, seen["line_dedup"])
    want = kept_lines(before)
    assert after == {i: t for i, t in want.items() if t == before[i] or lines.normalised(t)}
    before, after = map(texts, seen["minhash_near_dedup"])
    assert set(after) == {i for i, (_, c) in grouped(before, 5, 80).items() if i == c}
    before, after = map(texts, seen["benchmark_decontamination"])
    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert all(not any(x in t for x in items) for t in after.values())
    assert {i for i, t in before.items() if any(x.lower() in t.lower() for x in items)} <= set(before) - set(after)
    docs, packed = seen["best_fit_packing"]
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert corpus_pipeline.run(spark, tiny).agg(F.sum("length")).first()[0] == sum(r.length for r in rows)


def test_stages_on_odd_tables(spark, messy, nothing, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, no rows at all."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 60)), (2, None), (3, ""), (4, "two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda rows: sorted(((r.doc_id or -1, r.text or "") for r in rows), key=repr)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).collect() == []
        out = stage(spark, messy, str(tmp_path))
        rows = out.collect()
        if name == "best_fit_packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in messy.collect()} and len(rows) >= messy.count()
            continue
        assert out.columns == corpus_pipeline.COLUMNS
        if name == "minhash_near_dedup":
            gone = {2, 7}  # and one of the two equal rows
            assert key(rows) == sorted({x for x in key(messy.collect()) if x[0] not in gone}, key=repr)
        if name == "benchmark_decontamination":
            # only the row with the item's text goes; a short item drops nothing
            assert key(rows) == [x for x in key(messy.collect()) if x[1] != prose(2, 60)]


@pytest.mark.parametrize(("kind", "rate", "least"), [("words", 0.05, 0.95), ("words", 0.1, 0.93), ("words", 0.15, 0.9), ("letters", 0.02, 0.9), ("letters", 0.05, 0.6), ("letters", 0.08, 0.3)])
def test_recall_of_lines_with_scattered_edits(sf, kind, rate, least):
    """Of similar pairs, how many share a key and lie within the bound; README states what is lost."""
    import pyarrow.parquet as pq

    rng = random.Random(1)
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t]
    own = sorted({x for t in texts for x in t.split("\n") if 10 <= len(x.split()) <= 60})
    own = rng.sample(own, 1000)
    letter = lambda c: rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and rng.random() < rate else c
    word = lambda w: rng.choice(["zulu", "qwert", "vexing", "jumble"]) if rng.random() < rate else w
    changed = ["".join(map(letter, x)) if kind == "letters" else " ".join(map(word, x.split(" "))) for x in own]
    x, y = lines.Hashes.of(own), lines.Hashes.of(changed)
    halves = lambda k: np.ascontiguousarray(k).view(np.uint32)
    middle = (x.words <= lines.MIDDLE[1]) & (y.words <= lines.MIDDLE[1])
    met = (halves(x.k) == halves(y.k)).any(1) | ((halves(x.g) == halves(y.g)).any(1) & middle)
    met &= lines.near(x.sim, y.sim)
    alike = [k for k, (a, b) in enumerate(zip(own, changed, strict=True)) if a != b and lines.similar(lines.normalised(a), lines.normalised(b))]
    assert len(alike) > 500 and met[alike].mean() >= least


def test_profiles_deny_no_similar_pair():
    rng, pairs = random.Random(12), []
    for k in range(600):
        line = lines.normalised(prose(k, rng.choice([4, 9, 30, 300])) + rng.choice(["", " é漢字", " \U0001f600 z"]))
        own = list(line)
        for _ in range(rng.randrange(1 + len(own) // 4)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice(["", "x", own[at] + "é", "漢"])
        pairs.append((line, "".join(own) if k % 5 else lines.normalised(prose(-k, len(line.split())))))
    (p, n), (q, m) = (lines.profiles([x[k] for x in pairs]) for k in (0, 1))
    may, good = lines.may_be_similar(p, q, n, m), np.array([lines.similar(*x) for x in pairs])
    assert n.tolist() == [len(x) for x, _ in pairs]
    assert may[good].all() and good.sum() > 200 and not may[(n < 200) & (np.arange(600) % 5 == 0)].all()


def test_unlike_lines_of_a_bucket_are_not_read(spark, monkeypatch):
    """Many short lines that share two frequent words: none may get as far as similar()."""
    rng, asked = random.Random(3), spark.sparkContext.accumulator(0)

    def counted(a, b, real=lines.similar):
        asked.add(1)
        return real(a, b)

    monkeypatch.setattr(lines, "similar", counted)
    own = ["the and " + " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)) for _ in range(300)]
    docs = spark.createDataFrame([(k, x, k) for k, x in enumerate(own)], "doc_id long, line string, sim long")
    texts = docs.select(F.col("doc_id").alias("node"), "line")
    info = texts.select("node", F.lit(40).alias("level"), F.lit(0).cast("long").alias("sim"), *(F.xxhash64("node", F.lit(c)).alias(c) for c in lines.PACKED))
    rest = texts.select(F.lit(9 << 40 | 5).cast("long").alias("key"), "node", F.lit(300).alias("m"), F.col("node").alias("component"))
    assert lines._links_in_blocks(rest, info, texts).collect() == []
    assert asked.value < 100


def test_edits_stop_only_beyond_the_bound():
    rng = random.Random(21)
    for k in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.choice([70, 200, 500])))
        own = list(a)
        for _ in range(rng.randrange(1 + len(a) // 2)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice(["", "x", own[at] + "e", "xyz"])
        b = a[: len(a) // 3] + "".join(rng.choice("abcd ") for _ in range(len(a) // 2)) if k % 4 == 0 else "".join(own)
        true = lines.edits(a, b, len(a) + len(b))
        for most in (true - 1, true, true + 1, len(a) // 5):
            got = lines.edits(a, b, max(0, most))
            assert got == true or (true > max(0, most) and got > max(0, most))


def test_many_pairs_at_once_are_as_one_by_one():
    rng = random.Random(31)
    for length in (1, 3, 60, 159, 160, 161, 320, 700):
        x, y = [], []
        for k in range(60):
            a = "".join(rng.choice("abcd é漢\U0001f600") for _ in range(max(1, length - rng.randrange(1 + length // 10))))
            own = list(a)
            for _ in range(rng.randrange(1 + len(a) // 3)):
                at = rng.randrange(len(own) or 1)
                own[at : at + 1] = rng.choice(["", "x", "ex", "xyz"])
            b = "".join(rng.choice("abcd ") for _ in a) if k % 5 == 0 else "".join(own) or "x"
            a, b = (b, a) if k % 2 else (a, b)
            x.append(a)
            y.append(b)
        assert lines.alike(x, y).tolist() == [lines.similar(a, b) for a, b in zip(x, y, strict=True)]
        true = np.array([lines.edits(a, b, len(a) + len(b)) for a, b in zip(x, y, strict=True)])
        for off in (-1, 0, 1):
            most = np.maximum(true + off, [abs(len(a) - len(b)) for a, b in zip(x, y, strict=True)])
            assert (lines.within(x, y, most) == (true <= most)).all()
    assert lines.alike([], []).tolist() == []


def test_rows_of_a_large_bucket_of_like_lengths_come_once(spark, monkeypatch):
    """Forty near copies share keys: a row of a key for each of them, not one for each of two levels of length."""
    held, base = [], prose(77, 40).split()

    def counted(members, real=lines.with_hubs):
        held.append((members.count(), members.select("key", "node").distinct().count(), members.groupBy("key").count().agg(F.max("count")).first()[0]))
        return real(members)

    monkeypatch.setattr(lines, "with_hubs", counted)
    docs = spark.createDataFrame([(k, " ".join([*base[:9], f"v{k}", *base[10:]])) for k in range(40)], "doc_id long, text string")
    assert lines.dedup_lines(docs).where("lines_gone = 1").count() == 39
    (rows, distinct, most), = held
    assert rows == distinct <= lines.KEYS * 40 and most <= 40


def test_parts_of_a_large_bucket_bring_like_lengths_together(spark):
    rng = random.Random(9)
    own = [(b, rng.randrange(*((30, 45) if b else (0, 200))), n) for b in (0, 1) for n in range(60)]
    large = spark.createDataFrame([(b << 42 | level, b * 100 + n) for b, level, n in own], "key long, node long")
    parts: dict[int, set] = {}
    for r in lines.by_length(large).collect():
        parts.setdefault(r.key, set()).add(r.node)
    assert len([k for k in parts if k >> 40 == 1]) == 1 < len([k for k in parts if k >> 40 == 0])
    for b, level, n in own:
        for c, other, m in own:
            if b == c and abs(level - other) <= 8:
                assert any({b * 100 + n, c * 100 + m} <= p for p in parts.values())
