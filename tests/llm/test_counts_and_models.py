"""Token counts, language identification and the quality classifier."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from chunkflow.llm import langid, quality, tokencount
from chunkflow.llm.tokens import vocabulary

from .conftest import prose

VOCAB = vocabulary("word_bpe_49k.json")


def test_token_counts(spark, messy, nothing, tiny):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCAB)
    true = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    for docs in (messy, spark.read.parquet(f"{tiny}/documents.parquet")):
        for head in (5, 100_000):
            want = sorted((r.doc_id or 0, len((r.text or "").encode()), true(r.text)) for r in docs.collect())
            got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, VOCAB, head=head).collect())
            assert got == want
    assert tokencount.count_tokens(nothing, VOCAB).collect() == []


def test_frequent_long_pre_tokens_are_looked_up(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCAB)
    rules = ["-" * 80, "=" * 100, "é" * 70, "x" * 5000]
    docs = spark.createDataFrame([(k, f"a {rules[k % 4]} b {'long' * 30}{k}") for k in range(60)], "doc_id long, text string").repartition(3)
    rows = tokencount.frequencies(docs, VOCAB)
    table = tokencount.pretoken_table(rows, VOCAB)
    top = tokencount.frequent(table, 200)
    assert max(map(len, top["name"].to_pylist())) <= 64 and sum(n.startswith("  ") for n in top["name"].to_pylist()) == 5
    for head in (0, 10, 200):
        got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, VOCAB, head=head).collect()}
        assert got == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_language_of_held_out_documents(spark, sf):
    got = langid.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.99


def test_language_of_odd_documents(spark, messy, nothing):
    model = langid.learn(messy)
    rows = langid.identify(messy, model).collect()
    assert len(rows) == messy.count() and set(messy.columns) <= set(rows[0].asDict())
    assert {r.lang_pred for r in rows if r.text is None or not any(map(str.isalpha, r.text))} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.learn(nothing) is None
    assert {r.lang_pred for r in langid.identify(messy, None).collect()} == {"und"}
    assert langid.identify(nothing, model).collect() == []


def test_code_lengths_are_those_of_the_context_trees():
    import math

    import pandas as pd

    grams, _ = langid.grams_in([b"\n\n\nabab"])
    counts = pd.Series(grams.tolist()).value_counts()
    model = langid.build(pd.DataFrame({"lang": "x", "gram": counts.index, "n": counts.values}))
    # after "\n\n\n" only "a" came, once: 1 / (1 + 1)
    assert math.isclose(float(model.costs(langid.grams_in([b"\n\n\na"])[0])[0, 0]), 1.0)
    # "z" was never seen: an escape of each order, then one of 256 bytes
    total = sum(math.log2(x) for x in (2, 2, 2, (4 + 2) / 2)) + 8
    assert math.isclose(float(model.costs(langid.grams_in([b"\n\n\nz"])[0])[0, 0]), total, rel_tol=1e-6)


def test_quality_of_held_out_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = quality.op4_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_quality_of_odd_documents(spark, messy, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (9, None), (1, 0)], "doc_id long, quality int")
    stats = quality.with_statistics(messy, ["text", "score"])
    score = lambda model: [r.s for r in stats.withColumn("s", quality.score_statistics(F.col("__cf_x"), model)).collect()]
    rows = score(quality.fit(stats, labels))
    assert len(rows) == messy.count() and all(0 <= x <= 1 for x in rows)
    assert quality.fit(stats, labels.limit(0)) is None and set(score(None)) == {0.5}
    assert quality.fit(quality.with_statistics(nothing), labels) is None
    for threshold, n in ((0.0, messy.count()), (1.1, 0)):
        out = quality.good_documents(messy, labels, threshold)
        assert out.schema == messy.schema and out.count() == n
    assert quality.good_documents(nothing, labels).collect() == []


def test_sums_and_weights_equal_one_solve(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(700, 21)), rng.integers(0, 2, 700)
    folds = [zlib.crc32(str(i).encode()) % quality.FOLDS for i in range(700)]
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "__cf_id long, __cf_x array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(stats, labels, features=40)
    own = np.array([f not in (quality.HELD_OUT, quality.CALIBRATION) for f in folds])
    assert np.allclose(model.mean, x[own].mean(0)) and np.allclose(model.scale, x[own].std(0))
    z = model.features(x[own])
    want = np.linalg.solve(z.T @ z + quality.RIDGE * own.sum() * np.eye(z.shape[1]), z.T @ y[own])
    assert np.allclose(model.weights, want)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    x, n = rng.normal(size=(30, 21)), 20_000
    project, phase = rng.normal(size=(21, n)) / np.sqrt(42), rng.uniform(0, 2 * np.pi, n)
    z = quality.Model(np.zeros(21), np.ones(21), project, phase, np.zeros(n + 1), np.zeros(1), np.zeros(1)).features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 84)
    assert np.abs(z @ z.T - exact).max() < 0.04


def test_isotonic_equals_the_least_squares_fit():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = rng.integers(1, 9, 12).astype(float)
        s = np.floor(rng.random(12) * (n + 1))
        knots, levels = quality.isotonic(np.arange(12.0), s, n)
        # the fit at i: the largest of the least means of runs that hold i
        mean = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(np.interp(np.arange(12.0), knots, levels), want, atol=1e-6)


def test_code_lengths_equal_a_plain_reading_of_the_texts(spark):
    import math

    learned = {"a": [prose(1, 40), "zebra ñu", ""], "b": ["qwxz " * 30, prose(2, 5)]}
    docs = spark.createDataFrame([(k, lang, t) for lang, texts in learned.items() for k, t in enumerate(texts * 3) if zlib.crc32(str(k).encode()) % 4 != 2], "doc_id long, lang string, text string")
    model = langid.learn(docs)
    tries = {}
    for r in docs.collect():
        data = b"\n\n\n" + r.text.lower().encode()
        for k in range(3, len(data)):
            for order in range(4):
                by = tries.setdefault((r.lang, data[k - order : k]), {})
                by[data[k]] = by.get(data[k], 0) + 1

    def bits(lang, text):
        data, total = b"\n\n\n" + text.lower().encode(), 0.0
        for k in range(3, len(data)):
            for order in (3, 2, 1, 0):
                by = tries.get((lang, data[k - order : k]))
                if by and data[k] in by:
                    total -= math.log2(by[data[k]] / (sum(by.values()) + len(by)))
                    break
                if by:
                    total -= math.log2(len(by) / (sum(by.values()) + len(by)))
            else:
                total += 8
        return total

    for text in (prose(3, 30), "Zebra QWX", "漢字", "x"):
        got = model.costs(langid.grams_in([b"\n\n\n" + text.lower().encode()])[0]).sum(0)
        assert [round(float(x), 2) for x in got] == [round(bits(lang, text), 2) for lang in model.langs]
    whole, cut = (langid.padded([prose(5, 900), "", "b"], n) for n in (1 << 20, 100))
    flat = lambda parts: [np.sort(langid.grams_in(p)[0]).tolist() for _, p in parts]
    assert sorted(sum(flat(whole), [])) == sorted(sum(flat(cut), []))
    small = langid.learn(docs, most_costs=400)
    assert small is None or sum(len(t.keys) for t in small.tables[-1:]) * len(small.langs) <= 400


def test_isotonic_levels_rise():
    knots, levels = quality.isotonic(np.arange(5.0), np.array([1.0, 0, 3, 1, 4]), np.array([2.0, 2, 4, 4, 4]))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all() and levels[-1] == 1.0
