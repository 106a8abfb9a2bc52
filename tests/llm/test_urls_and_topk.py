from __future__ import annotations

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkflow.llm import queries, topk, urls


def verdicts(spark, found, host_rules, patterns=()):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(found)], "page_id long, url string, rule string, token string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rules_table(spark, host_rules, list(patterns))).collect()}


def test_hosts_paths_and_longest_rules(spark):
    found = ["http://A.Example.NET/en/x?q#f", "https://example.net/fr/", "http://x.net", "http://net/", None, "no scheme", "http://o.org/fr/a", "http://o.org/frx", "x://h?a://b/c", "http://myexample.com/de/", "http://example.com/DE/"]
    got = verdicts(spark, found, urls.HOST_RULES)
    assert [got[i] for i in range(len(found))] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"), ("x.net", "", None, "allow"), ("net", "/", "net/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("o.org", "/fr/a", "org/fr/", "allow"), ("o.org", "/frx", None, "allow"), ("h", "", None, "allow"),
        ("myexample.com", "/de/", None, "allow"), ("example.com", "/DE/", None, "allow"),
    ]


def test_patterns_without_a_whole_token_still_run(spark):
    got = verdicts(spark, ["http://a.b/xadsy", "http://ads.b/", "http://a.b/c"], [], ["*adsy", "^ads^"])
    assert [got[i][3] for i in range(3)] == ["block", "block", "allow"]
    assert urls.compile_pattern("*adsy")[1] == [" ads", " dsy"] and urls.compile_pattern("*ab*^c^*")[1] == ["c"] and urls.compile_pattern("*ab*")[1] == [] and urls.compile_pattern("||a.b/c")[1] == ["a", "b"]


def test_the_index_spares_regular_expressions(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rules = urls.rules_table(spark, urls.HOST_RULES, urls.patterns())
    host, path = urls.url_parts(F.col("url"))
    found = pages.select("url").where("url is not null").distinct().withColumn("key", F.concat(host, path))
    n, m = found.count(), rules.count()
    assert m > 350 and urls.candidates(found, rules).where("not listed").count() < 0.01 * n * m


@pytest.mark.parametrize("most", [0, 1000])
def test_patterns_against_every_regular_expression(spark, monkeypatch, most):
    import re

    monkeypatch.setattr(urls, "MOST_RULES", most)
    rng = random.Random(3)
    words = [*urls.ANYWHERE[:2], *urls.OFFERS[:2], *urls.GOODS[:2], "help", "x", "adsx"]
    found = ["http://" + "".join(rng.choice(words) + rng.choice(".-./") for _ in range(rng.randint(1, 6))) + rng.choice(["com", "com/", "com/ADS", "com/" + "y" * 5000 + "/spam"]) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, 1, "k", "v") for i, u in enumerate(found)], "page_id long, url string, host int, token string, verdict string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, urls.rules_table(spark, [], urls.patterns())).collect()}
    rules = [(p.startswith("@@"), re.compile(urls.compile_pattern(p.removeprefix("@@"), True)[0])) for p in urls.patterns()]
    for i, u in enumerate(found):
        hits = {exception for exception, rx in rules if rx.search(u.removeprefix("http://").split("/")[0].lower() + u.removeprefix("http://")[len(u.removeprefix("http://").split("/")[0]) :])}
        assert got[i] == ("allow" if True in hits or not hits else "block"), u
    assert set(got.values()) == {"allow", "block"}


def test_repeated_and_missing_rows(spark):
    assert len(verdicts(spark, ["http://a.net/"] * 3, urls.HOST_RULES)) == 3
    assert verdicts(spark, [], urls.HOST_RULES) == {}
    assert verdicts(spark, ["http://a.net/"], [])[0][3] == "allow"


def test_topk_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(300)] + [(7, [1] * 6), (400, [2] * 6), (401, [2] * 6), (402, [3, 3]), (403, []), (404, None), (None, [1] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    queries = table.where(F.col("vec_id") % 20 == 0)
    got = {}
    for r in topk.search(table, queries, k=4, batch_bytes=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, v in ((i, v) for i, v in rows if i is not None and i % 20 == 0 and v):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i not in (q, None) and w and len(w) == len(v))[:4]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]


def test_topk_of_few_and_huge_numbers(spark):
    big = 1 << 55
    table = spark.createDataFrame([(0, [big, 1]), (1, [2, 1]), (2, [2, 3])], "vec_id long, v array<long>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.search(table, table.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2, 2 * big + 3), (2, 1, 2 * big + 1)]
    assert topk.search(table.limit(0), table.limit(0)).collect() == []


@pytest.mark.parametrize("top", [9, 1 << 22, 1 << 58])
def test_phases_lose_nothing_and_spare_products(top):
    rng = np.random.default_rng(4)
    v, q = rng.integers(-top, top, (500, 8)), rng.integers(-9, 9, (6, 8))
    ids, own = np.arange(500), np.arange(6)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q], object)
    for slices in (1, 2, 3):
        (got_ids, a, b), = topk.Batch(own.tolist(), q.tolist()).parts(v, slices)
        assert got_ids.tolist() == own.tolist() and len(a) == slices
        lists = topk.best_of_lists(ids, own, a, b, 20)
        cutoff = np.array([sorted(int(x) for x in got)[-20] for got in lists], object if top > 1 << 50 else float)
        i, j, score, resolved = topk.sufficient(a, b, cutoff)
        assert sorted(zip(i.tolist(), j.tolist(), map(int, score), strict=True)) == sorted((x, y, int(exact[x, y])) for x in range(6) for y in range(500) if exact[x, y] >= cutoff[x])
        assert resolved <= 0.5 * 3000 * (slices - 1)


def test_topk_with_clashing_columns(spark):
    table = spark.createDataFrame([(i, [i, 1], i, 1, 0) for i in range(40)], "vec_id long, v array<long>, score long, rank int, query_id int")
    rows = topk.search(table, table.where("vec_id = 20"), k=3, share=100).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in rows) == [(1, 39, 781), (2, 38, 761), (3, 37, 741)]


def test_bad_components_are_left_out(spark):
    rows = [(1, [0.5, -0.01]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf"), 0.0])]
    got = spark.createDataFrame(rows, "i int, e array<float>").select("i", topk.quantized(F.col("e")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [[32, -1], None, None, None, None]


def test_very_long_urls(spark):
    long = "http://Shop.example.net/en/" + "a-b/" * 200_000 + "?x=casino"
    got = verdicts(spark, [long, "http://cheap-pills.org/" + "x" * 500_000, "http://" + "h." * 100_000 + "net/" + "p" * 100_000], urls.HOST_RULES, urls.patterns())
    assert [(len(v[1]), v[2], v[3]) for _, v in sorted(got.items())] == [(4 + 800_000, "example.net/en/", "allow"), (500_001, None, "block"), (100_001, "net/", "block")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        p = Path(tiny, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got, want = queries.QUERIES[name](spark, tiny), con.sql(queries.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    of = lambda columns, rows: sorted((tuple(r[columns.index(n)] for n in names) for r in rows), key=repr)
    assert of(got.columns, got.collect()) == of(want.columns, want.fetchall())


def test_rules_from_a_table_of_the_urls_own_parts(spark, sf, tmp_path):
    """Hosts, anchors, wildcards inside tokens and exceptions, as patterns in a file, against every regular expression."""
    import re

    found = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").where("page_id % 7 = 0")  # the other side is every pair
    host, path = urls.url_parts(F.col("url"))
    parts = found.select(host.alias("h"), F.regexp_extract(path, "([A-Za-z0-9]{4,})", 1).alias("w"), "page_id").where("h <> ''")
    made = parts.select(F.explode(F.array(
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("||"), "h", F.lit("^"))), F.when((F.col("page_id") % 5 == 0) & (F.col("w") != ""), F.concat(F.lit("/"), "w", F.lit("^"))),
        F.when(F.col("w") != "", F.concat(F.lit("*"), F.substring("w", 2, 3), F.lit("*"))), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("@@||"), "h", F.lit("/*"), F.substring("w", 1, 3), F.lit("*"))),
    )).alias("pattern")).where("pattern is not null")
    made.select("pattern", F.lit("block").alias("action")).unionByName(spark.createDataFrame([(None, "block"), ("", "block"), ("*qz*", "allow")], "pattern string, action string")).write.parquet(str(tmp_path / "rules"))
    rules = urls.rules_of(spark.read.parquet(str(tmp_path / "rules")))
    rows = rules.collect()
    assert len(rows) > 20 and any(t.startswith(" ") for r in rows for t in r.tokens) and not any(r.listed for r in rows)
    got = {r.page_id: (r.host, r.path, r.verdict) for r in urls.judge_urls(found, rules).collect()}
    compiled = [(re.compile(r.rx), r.action) for r in rows]
    for host, path, verdict in got.values():
        fits = {a for rx, a in compiled if rx.search(host + path)} if host or path else set()
        assert verdict == ("allow" if "allow" in fits or not fits else "block")
    known = found.where("url is not null").select("url").distinct().withColumn("key", F.concat(*urls.url_parts(F.col("url"))))
    runs, pairs = urls.candidates(known, rules).count(), known.count() * len(rows)
    assert runs < 0.35 * pairs
    with pytest.raises(Exception, match="block and allow"):
        urls.rules_of(spark.createDataFrame([("a", "drop")], "pattern string, action string")).collect()
