"""Cases of single operators that the given tables don't hold."""

from __future__ import annotations

import base64
import io
import json
import random
import tracemalloc
import xml.dom.minidom
import zipfile

import pytest
from pyspark.sql import functions as F

from chunkflow.functions import checking
from chunkflow.functions import text as T
from chunkflow.functions.reversing import reversing_translator
from chunkflow.operators import answers, chunking, commits, cost, failures, glossary, links, records, review, sequences, translation
from chunkflow.sources import books, markup, packing
from chunkflow.streaming import jobs

CHUNKS = "book_id string, chunk_index int, markdown string, document_path string, chapter_title string, join_with string"


def chunks(spark, n=10, book="b"):
    return spark.createDataFrame([(book, i, f"[{i}]", "p", "t", None) for i in range(n)], CHUNKS).repartition(3)


def test_big_chunks_and_windows(spark):
    got = sequences.big_chunks(chunks(spark), 4).orderBy("big_id").collect()
    assert [(r.from_index, r.to_index, r.markdown) for r in got] == [(0, 3, "[0][1][2][3]"), (4, 7, "[4][5][6][7]"), (8, 9, "[8][9]")]
    spans = lambda df: [(r.from_index, r.to_index) for r in df.orderBy("window_id").collect()]
    assert spans(sequences.translate_windows(chunks(spark), 4)) == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert spans(sequences.translate_windows(chunks(spark, 3), 5)) == [(0, 1), (1, 2), (2, 3)]
    assert spans(sequences.translate_windows(chunks(spark), 1)) == [(0, 10)]
    assert spans(sequences.translate_windows(chunks(spark, 0), 4)) == []
    assert spans(sequences.review_windows(chunks(spark, 11), 4)) == [(0, 4), (4, 8), (8, 11)]


def test_chapters_with_blank_titles(spark):
    rows = [("b", i, "x", "p", t, None) for i, t in enumerate(["Opening", "Opening", " ", "Redemption", "Redemption"])]
    df = spark.createDataFrame(rows, CHUNKS)
    assert sequences.chapter_list(df).first().chapters == "# Opening (chunks from 1 to 2)\n# Untitled 2 (chunks from 3 to 3)\n# Redemption (chunks from 4 to 5)"


def test_chapters_cross_block_borders(spark):
    df = spark.createDataFrame([("b", i, "x", "p", "aabbbbbbca"[i], None) for i in range(10)], CHUNKS).repartition(4)
    for block in (2, 3, 4096):
        got = {r.chunk_index: r.chapter_no for r in sequences.chapter_ids(df, block).collect()}
        assert [got[i] for i in range(10)] == [0, 0, 1, 1, 1, 1, 1, 1, 2, 3]


def test_context_crosses_block_borders(spark):
    pairs = chunks(spark).where("chunk_index <> 4").select("book_id", "chunk_index", F.col("markdown").alias("original"), F.col("markdown").alias("translation"))
    whole = sequences.neighbours(chunks(spark), 2, block=3)
    assert whole.where("_own").count() == 10 and whole.count() == 16
    got = {r.chunk_index: [x["at"] for x in r.context] for r in sequences.context_pairs(chunks(spark), pairs).collect()}
    assert got[0] == [] and got[5] == [3] and got[6] == [5] and got[9] == [7, 8]


def test_seams(spark):
    parts = [("a  ", None), (" b", "space"), ("c", "line"), (" ", None), ("d", None)]
    df = spark.createDataFrame([("b", i, m, "p", "t", j) for i, (m, j) in enumerate(parts)], CHUNKS)
    assert commits.join_chunks(df).first().markdown == "a b\nc\n\nd\n"


def test_glossary_rules(spark):
    seed = spark.createDataFrame([("b", 0, " A ", "a"), ("b", 1, "Same", "Same")], "book_id string, pos int, src string, dst string")
    found = spark.createDataFrame([("b", 1, 0, "A", "z"), ("b", 0, 1, "B", "late"), ("b", 0, 0, "B", "first"), ("b", 2, 0, "Same", "real"), ("b", 3, 0, "", "x")], "book_id string, big_id int, pos int, src string, dst string")
    got = {r.src: r.dst for r in glossary.merge_glossary(seed, found).collect()}
    assert got == {"A": "a", "B": "first", "Same": "real"}
    assert glossary.glossary_entries('x ```json\n{"k": " v ", "n": 1, "e": ""}\n```') == [{"src": "k", "dst": "v"}]
    assert glossary.glossary_entries("[1]") == [] and glossary.glossary_entries('{"a": ') == [] and glossary.glossary_entries(None) == []


@pytest.mark.parametrize(
    ("row", "kind", "budget"),
    [
        ((400, "maximum context length is 16385 tokens (503)", None, None, False), "context", 1), ((429, "slow", None, 171.0, False), "rate", 3), ((429, "slow", None, 2.0, False), "rate", 86),
        ((None, "got 503 tokens", None, None, False), "unknown", 1), ((None, "x", None, None, True), "network", None), ((None, "x", "TimeoutError", None, False), "network", 2),
        ((None, "Failed to fetch", None, None, False), "cors", 11), ((None, "invalid JSON", "TypeError", None, False), "network", 11), ((500, None, None, None, None), "server", 11),
    ],
)
def test_failures(spark, row, kind, budget):
    df = spark.createDataFrame([(*row, 1)], "status int, message string, error_name string, retry_after_s double, offline boolean, attempt int")
    got = failures.retry_plan(failures.classify_failures(df)).first()
    assert (got.kind, got.attempt_budget) == (kind, budget)


def test_cost_of_dense_scripts(spark):
    rows = [(b, i, c * 5000, "p", "t", None) for b, c in (("en", "a"), ("ru", "ж")) for i in range(20)]
    settings = spark.createDataFrame([("en", "ru", 1, 4, 5), ("ru", "en", 1, 4, 5)], "book_id string, target_lang string, concurrency int, glossary_batch int, review_batch int")
    got = {r.book_id: r for r in cost.estimate_cost(spark.createDataFrame(rows, CHUNKS), settings).collect()}
    assert 1.7 < got["en"].output_tokens / got["ru"].output_tokens < 2.1
    assert got["en"].eta_ms == 5 * 7000 + 20 * 9000 + 4 * 12000


def test_checkpoints(spark):
    good = {"version": 2, "fileName": "a", "fileBytes": "AA==", "title": "t", "format": "fb2", "styleGuide": "", "index": 0, "translated": [], "chunks": [{"index": 0, "documentPath": "", "chapterTitle": "", "markdown": "m", "joinWith": "line"}], "extra": {"a": 1}}
    bad = [{**good, "version": 1}, {**good, "format": "pdf"}, {**good, "title": 3}, {k: v for k, v in good.items() if k != "index"}, {**good, "chunks": "x"}, {**good, "chunks": [{"index": 0}]}, {**good, "translated": [{"index": "0", "original": "", "translation": ""}]}]
    rows = [(json.dumps(good),), *((json.dumps(b),) for b in bad), ("not json",), (None,), ("[]",)]
    got = [r.is_valid for r in records.valid_checkpoints(spark.createDataFrame(rows, "record string")).collect()]
    assert got == [True] + [False] * (len(rows) - 1)


def test_edits():
    pair = {"original": "one two", "translation": "eins zwei", "used_original": True, "reason": "r", "pre_review": None}
    new, said = review.edited(pair, "zwei", "$& $1")
    assert said == "ok" and new["translation"] == "eins $& $1" and new["pre_review"] == "eins zwei" and new["used_original"] is False
    assert review.edited(new, "eins", "x")[0]["pre_review"] == "eins zwei"
    assert review.edited(pair, "eins", "eins") == (pair, "ok")
    assert review.edited(pair, "i", "y")[1] == "err: old matches 2 times in this chunk; make it a unique substring"
    assert review.edited(pair, "eins zwei", " ")[1] == "err: empty translation"
    assert review.diff_words("a b c", "a x c") == [{"type": "eq", "text": "a "}, {"type": "del", "text": "b"}, {"type": "ins", "text": "x"}, {"type": "eq", "text": " c"}]
    assert review.diff_words("a", "a") == [{"type": "eq", "text": "a"}] and review.diff_words(None, "") == []


def test_a_translator_that_fails_stops_its_window(spark):
    def fails(sources, contexts):
        if sources[0] == "[4]":
            raise OSError("down")
        return reversing_translator(sources, contexts)

    rows = chunks(spark).withColumn("window_id", F.floor(F.col("chunk_index") / 3))
    got = {r.chunk_index: r for r in translation.translate_windows_run(rows, fails).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 6, 7, 8, 9} and got[4].failure == "OSError: down" and got[4].translation is None
    stubborn = translation.translate_windows_run(rows, lambda s, c: ["as an ai"]).collect()
    assert all(r.used_original and r.reason == "model refusal" and r.translation == r.original for r in stubborn)


def test_results_dont_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select(F.col("source").alias("book_id"), "doc_id", "text")
    seen = set()
    for n in (1, 4, 37):
        parts = chunking.chunk_documents(docs.repartition(n), 900, "text").withColumnRenamed("doc_id", "piece_pos")
        rows = sequences.index_chunks(parts).select("book_id", "chunk_index", "markdown", "join_with").collect()
        seen.add(tuple(sorted(map(tuple, rows), key=repr)))
    assert len(seen) == 1


FB2 = '<?xml version="1.0" encoding="{enc}"?><FictionBook xmlns:l="x"><description><title-info><book-title>Книга</book-title></title-info></description><body><section><title><p>Глава</p></title><p>Текст <emphasis>да</emphasis></p><v>стих</v><image l:href="#pic.png"/></section><section><p> </p></section></body><body name="notes"><section><p>no</p></section></body><binary id="pic.png" content-type="image/png">iVBO</binary><binary id="bad">*</binary></FictionBook>'


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="a" href="ch%201.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="b" linear="no"/><itemref idref="a"/></spine></package>')
        z.writestr("O/ch 1.xhtml", '<html><body><h1>One</h1><script>x("</p>")</script><div>He said <b>no</b>.</div><p><a href="b.xhtml#x">l</a><img src="../img/p.png" alt="P"/></p><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><th>x</th></tr><tr><td>1<br/>2</td></tr></table></body></html>')
        z.writestr("img/p.png", b"png")
    return out.getvalue()


def test_books(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.fb2", FB2.format(enc="utf-8"))
    files = [("a.EPUB", epub()), ("b.fb2", FB2.format(enc="windows-1251").encode("cp1251")), ("c.fb2", FB2.format(enc="utf-8").encode("cp1251")), ("d.fb2.zip", inner.getvalue()), ("e.zip", b"PK\x05\x06" + b"\0" * 18), ("f.epub", b"zip?"), ("g.txt", b""), ("h.fb2", b"<FictionBook><body><section><p> </p></section></body></FictionBook>"), ("i.fb2", None)]
    df = spark.createDataFrame([(n[0], n, None if c is None else bytearray(c)) for n, c in files], "book_id string, file_name string, content binary")
    rows = books.extract_sections(df).collect()
    assert {r.book_id: r.parse_status for r in rows} == dict(zip("abcdefghi", ["ok", "ok", "ok", "ok", "zip-no-fb2", "corrupt", "unsupported", "empty", "corrupt"], strict=True))
    own = {r.book_id: r for r in rows}
    assert own["a"].document_path == "O/ch 1.xhtml" and own["a"].chapter_title == "One"
    assert own["a"].markdown == "# One\n\nHe said **no**.\n\n[l](O/b.xhtml#x)![P](images/p.png)\n\n- a\n  \n  - b\n\n| x |\n| --- |\n| 1 2 |\n"
    assert own["b"].markdown == own["c"].markdown == own["d"].markdown == "# Глава\n\nТекст *да*\n\nстих\n![](images/pic.png)\n"
    assert own["b"].document_path == "section:main:0:1"
    images = {(r.book_id, r.href, r.mime_type) for r in books.extract_images(df).collect()}
    assert images == {("a", "images/p.png", "image/png"), *((b, "images/pic.png", "image/png") for b in "bcd")}


def test_blocks_in_the_target_language_go():
    page = markup.parse('<p>Hello there, my friend</p><p>Привет, дорогой друг</p><p lang="ru">Hm</p>')
    assert markup.Markdown(langs=("en", "ru")).write(page) == "Hello there, my friend\n"
    only = markup.parse("<p>Привет, дорогой друг</p>")
    assert markup.Markdown(langs=("en", "ru")).write(only) == "Привет, дорогой друг\n"


def test_packed_books_are_well_formed(spark):
    rows = spark.createDataFrame([("b", "x.fb2.zip", "T & <t>", "pre *a _b* c_ <\n\n# H\n\n- d\n\n![i](images/p.png)\n\x01")], "book_id string, file_name string, title string, markdown string")
    images = spark.createDataFrame([("b", "images/p.png", "image/png", bytearray(b"x"))], "book_id string, href string, mime_type string, bytes binary")
    got = packing.pack_books(rows, images, "ru").first()
    with zipfile.ZipFile(io.BytesIO(got.epub)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        pages = [n for n in z.namelist() if n.endswith(("xhtml", "opf"))]
        assert len(pages) == 4 and all(xml.dom.minidom.parseString(z.read(n)) for n in pages)
    assert got.file_name == "x.ru.epub"


def test_streams_equal_batches(spark, tmp_path):
    docs = spark.createDataFrame([(f"b{i}", "word " * 300 + f"{i}") for i in range(6)], "book_id string, markdown string")
    docs.write.parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.stream_chunks(jobs.read_stream(spark, str(tmp_path / "in")), 500), str(tmp_path / "out"), str(tmp_path / "cp"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out")).select("book_id", "part_pos", "markdown")) == key(chunking.chunk_documents(docs, 500).select("book_id", "part_pos", "markdown"))


def test_answers_in_any_order_give_the_batch_pairs(spark, tmp_path):
    source = "A source text that is long enough to check."
    good, bad = "Ein Text, der lang genug ist, um gut zu sein.", "as an ai"
    rows = [("a", 1, bad), ("a", 2, good), ("a", 3, "later " + good), ("b", 1, bad), ("b", 2, ""), ("b", 3, "<<<SOURCE>>>"), ("c", 2, good), ("c", 1, bad), ("d", 2, good), ("e", 1, good)]
    attempts = [(b, 0, n, text, source, 1) for b, n, text in rows]
    schema = "book_id string, chunk_index int, attempt int, response string, original string, ms long"
    for i, part in enumerate((attempts[2:5], attempts[:2] + attempts[6:7], attempts[5:6] + attempts[7:] + attempts[:3])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.stream_commit(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    fields = ["book_id", "chunk_index", "translation", "used_original", "reason"]
    key = lambda df: sorted(map(tuple, df.select(*fields).collect()), key=repr)
    sources = spark.createDataFrame([(b, 0, source) for b in "abcde"], "book_id string, chunk_index int, markdown string")
    batch = answers.accept_attempts(sources, spark.createDataFrame(attempts, schema)).where("book_id <> 'd'")
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_running_progress(spark, tmp_path):
    pairs = spark.createDataFrame([("a", i, i % 3 == 0) for i in range(7)] + [("b", 0, True)], "book_id string, chunk_index int, used_original boolean")
    pairs.write.parquet(str(tmp_path / "in"))
    query = jobs.stream_progress(jobs.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("progress").collect())) == [("a", 7, 3), ("b", 1, 1)]


def test_exports(spark, tmp_path):
    guide = spark.createDataFrame([("a", "g"), ("b", "h")], "book_id string, style_guide string")
    terms = spark.createDataFrame([("a", 1, "y", "z"), ("a", 0, "w", "x")], "book_id string, ord int, src string, dst string")
    packing.export_brief(guide, terms, str(tmp_path / "brief"))
    packing.write_requests(guide, str(tmp_path / "requests"))
    got = {(x := json.loads(r.value))["book_id"]: x["glossary"] for r in spark.read.text(str(tmp_path / "brief")).collect()}
    assert got == {"a": [{"src": "w", "dst": "x"}, {"src": "y", "dst": "z"}], "b": []}
    assert spark.read.json(str(tmp_path / "requests")).count() == 2


def test_read_books(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.fb2").write_bytes(FB2.format(enc="utf-8").encode())
    got = books.read_books(spark, str(tmp_path)).collect()
    assert [(r.file_name, len(r.book_id)) for r in got] == [("x.fb2", 40)]


def test_read_listed(spark, tmp_path):
    for name in ("x.fb2", "a b%.fb2"):
        (tmp_path / name).write_bytes(name.encode())
    rows = [(1, f"file://{tmp_path}/x.fb2"), (2, f"file://{tmp_path}/a%20b%25.fb2"), (3, None)]
    got = books.read_listed(spark.createDataFrame(rows, "book_id long, path string")).collect()
    assert sorted((r.book_id, r.file_name, bytes(r.content)) for r in got) == [("1", "x.fb2", b"x.fb2"), ("2", "a b%.fb2", b"a b%.fb2")]
    with pytest.raises(Exception, match="none.fb2"):
        books.read_listed(spark.createDataFrame([(1, f"file://{tmp_path}/none.fb2")], "book_id long, path string")).collect()


def test_rules_for_one_text_equal_those_of_columns(spark):
    rng = random.Random(4)
    parts = ["word ", "Слово ", "![a](img/x y.png)", "[l](http://e/(x))", "[m](rel)", "[n](a.b)", "# ", "\n", "```c```", "> ", "1. ", "*", "as an AI", "<<<SOURCE>>>", "<<<TRANSLATION>>>", "<<<END_TRANSLATION>>>", "﻿", " ", "```md\n", "\n```", "", "  "]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
    pairs = [(i, text(), text()) for i in range(400)]
    pairs += [(400 + i, a, a + b) for i, (_, a, b) in enumerate(pairs[:200])]
    rows = spark.createDataFrame(pairs, "i int, original string, translation string")
    got = answers.validate_pairs(rows).select("i", "original", "translation", "reason", T.parse_response(F.col("translation")).alias("parsed"), T.plain_text(F.col("translation")).alias("plain")).collect()
    for r in got:
        assert (r.reason, r.parsed, r.plain) == (checking.problem(r.original, r.translation), checking.parse_answer(r.translation), checking.plain(r.translation)), r
    assert len({r.reason and r.reason[:12] for r in got}) > 5


def test_answers_delivered_twice_and_out_of_bounds(spark):
    source, good = "A source text that is long enough to check.", "Ein Text, der lang genug ist, um gut zu sein."
    rows = [("a", 0, n, r, 10 * n) for n, r in ((1, ""), (1, ""), (2, "as an ai"), (2, "as an ai"))] + [("b", 0, n, "", 5) for n in (1, 2, 3, 3, 9)]
    rows += [("c", 0, 3, good, 7), ("c", 0, 1, None, 8), ("d", 0, 4, good, 9), ("e", 0, 2, good, 1), ("no chunk", 0, 1, good, 1)]
    attempts = spark.createDataFrame(rows, "book_id string, chunk_index int, attempt int, response string, ms long")
    texts = spark.createDataFrame([(b, 0, source) for b in "abcdef"] + [("b", 1, None)], "book_id string, chunk_index int, markdown string")
    out = answers.accept_attempts(texts, attempts)
    got = {r.book_id: (r.translation, r.used_original, r.reason, r.ms) for r in out.collect()}
    assert got == {"b": (source, True, "empty translation", 5), "c": (good, False, None, 7), "e": (good, False, None, 1)}
    # one exchange brings the answers together, one the sources; what follows the join stays in place
    plan = out._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count(" Exchange hashpartitioning(book_id") == 2 and plan.index("SortMergeJoin") < plan.index(" Exchange hashpartitioning(book_id")


@pytest.mark.parametrize(("seed", "block"), [(0, 2), (1, 3), (2, 7), (3, 4096), (4, 4), (5, 5)])
def test_retry_by_chains_equals_a_fold_over_the_book(spark, seed, block):
    rng = random.Random(seed)
    rows = [(b, i, f"s{i}", f"t{i}", rng.random() < 0.5, "old", 1) for b in "ab" for i in range(60) if rng.random() < 0.8]
    pairs = spark.createDataFrame(rows, "book_id string, chunk_index int, original string, translation string, used_original boolean, pre_review string, ms long").repartition(3)

    def translator(sources, contexts):  # an answer that shows what was seen
        s = sources[0]
        return ["" if int(s[1:]) % 7 == 0 else f"n{s} " + "/".join(f"{a}:{b}"[:40] for a, b in contexts[0])]

    want = {}
    for b in "ab":
        done = {}
        for _, i, s, t, used, pre, _ in sorted(r for r in rows if r[0] == b):
            text = t
            if used:
                made = translator([s], [[done[k] for k in (i - 2, i - 1) if k in done]])[0]
                text, used, pre = (made.strip(), False, None) if made else (t, True, pre)
            done[i] = (s, text)
            want[b, i] = (text, used, pre)
    new, left = translation.retry_kept(pairs, pairs.select("book_id", "chunk_index"), translator, block=block)
    assert {(r.book_id, r.chunk_index): (r.translation, r.used_original, r.pre_review) for r in new.collect()} == want
    tried = {(r[0], r[1]) for r in rows if r[4]}
    assert {tuple(r) for r in left.collect()} == {k for k in want if k not in tried or want[k][1]}


def test_kept_chunks_of_one_large_book_are_tried_in_many_tasks(spark):
    kept = spark.range(100_000).select(F.lit("b").alias("book_id"), (F.col("id") * 3 + F.col("id") % 2).cast("int").alias("chunk_index"))
    chains = translation.retry_chains(kept)
    sizes = chains.groupBy("book_id", "chain").count()
    assert (sizes.count(), sizes.agg(F.max("count")).first()[0]) == (50_001, 2)
    spread = chains.repartition(8, "book_id", "chain").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 20_000


def plain_chapters(text: str) -> list[tuple[str, str, int]]:
    parts, inside = [[]], False
    for n, line in enumerate((text or "").strip(" \t\n\x0b\f\r").split("\n")):
        if line.startswith("```"):
            inside = not inside
        elif not inside and n and line.startswith(("# ", "## ")):
            parts.append([])
        parts[-1].append(line)
    title = lambda x: x.lstrip("#").strip(" ") if x.startswith(("# ", "## ")) else ""
    return [(title(p[0]), "\n".join(p).strip(" \t\n\x0b\f\r"), len(p)) for p in parts]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 4096])
def test_chapters_by_blocks_of_lines(spark, block):
    rng = random.Random(block)
    kinds = ["text", "```", "# A b", "## C", "### no", "", " # no", "```x", "  "]
    texts = ["\n".join(rng.choices(kinds, k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "\n \n", "# only"]
    books_ = spark.createDataFrame(list(enumerate(texts)), "book_id int, markdown string").repartition(3)
    got = {}
    for r in commits.split_chapters(books_, block).orderBy("book_id", "chapter_no").collect():
        got.setdefault(r.book_id, []).append((r.title, r.body, r.n_lines))
    assert got == {k: plain_chapters(t) for k, t in enumerate(texts)}


def test_pages_of_a_book_share_what_is_around_them(monkeypatch):
    made = []
    monkeypatch.setattr(packing, "_xml", lambda root, xml=packing._xml: made.append(root.tag) or xml(root))
    titles = ["a & b <c> \"d\"", "]]>", "\x01", "</body><title />", "ä\U0001f600"] * 4
    epub = packing.EpubWriter(out := io.BytesIO(), "t", "de", "p {}")
    for x in titles:
        epub.chapter(x, "text")
    epub.close()
    assert len(made) <= 3  # container, page and package, however many chapters
    with zipfile.ZipFile(out) as z:
        pages = [xml.dom.minidom.parseString(z.read(f"OEBPS/chapter-{n:03d}.xhtml")) for n in range(1, len(titles) + 1)]
        got = ["".join(n.data for n in p.getElementsByTagName("title")[0].childNodes) for p in pages]
    assert got == [x.replace("\x01", "") for x in titles]


def test_chapters_shuffle_lines_once(spark):
    books_ = spark.createDataFrame([(1, "a")], "book_id int, markdown string").where("book_id is not null")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is the last one
    try:
        plan = commits.split_chapters(books_)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Generate posexplode") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("n", [5_000, 100_000])
def test_links_with_very_many_parentheses(spark, n):
    target = "x" + "(y)" * n
    text = f"see [a]({target}) and ![i]({target}) and [b](c" + "(d)" * n
    rows = spark.createDataFrame([(1, 0, text, text), (2, 0, text, "none of them, but long enough " * n)], "book_id int, chunk_index int, original string, translation string")
    got = rows.select(T.link_hrefs(F.col("original")), T.image_srcs(F.col("original"))).first()
    assert tuple(map(list, got)) == ([target], [target])
    found = links.explode_links(rows.withColumnRenamed("book_id", "doc_id"), "doc_id", "original").collect()
    assert {(r.doc_id, r.kind, r.target == target) for r in found} == {(k, kind, True) for k in (1, 2) for kind in ("link", "image")}
    reasons = {r.book_id: r.reason for r in answers.validate_pairs(rows).collect()}
    assert reasons == {1: None, 2: f"missing image {target}"}
    assert checking.problem(text, text) is None and checking.problem(text, "none of them, but long enough " * n) == f"missing image {target}"


def test_images_come_without_the_chapters(spark, monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("O/b.JPG", b"jpg")
        z.writestr("O/ch.xhtml", b"<broken")
        z.writestr("x/b.jpg", b"two")
        z.writestr("O/bad.png", b"spoilt later")
    bad = out.getvalue().replace(b"spoilt later", b"spoilt_later")
    binary = "".join(f'<binary id="i{n}.png" content-type="image/png">{base64.b64encode(bytes([n]) * 50_000).decode()}</binary>' for n in range(60))
    odd = '<body><p>open<binary id="a.png">AAAA</binary><binary id="a.png">BBBB</binary><binary>CCCC</binary><binary id="no.png">AAA</binary><script><binary id="s.png">AAAA</binary></script><binary id="cut.png">AA'
    files = [("a", "a.epub", bad), ("b", "b.fb2", f"<FictionBook><body/>{binary}</FictionBook>".encode()), ("c", "c.fb2", odd.encode()), ("d", "d.epub", b"no zip"), ("e", "e.fb2", None), ("f", None, b"x"), ("g", "g.zip", bad)]
    df = spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in files], "book_id string, file_name string, content binary")
    monkeypatch.setattr(books, "parse_book", None)  # isn't asked for
    got = books.extract_images(df, batch_bytes=100_000).collect()
    images = {(r.book_id, r.source_path): (r.href, r.mime_type, bytes(r.bytes)) for r in got}
    assert len(images) == len(got)
    assert {k: v for k, v in images.items() if k[0] != "b"} == {
        ("a", "O/b.JPG"): ("images/b.JPG", "image/jpeg", b"jpg"), ("a", "x/b.jpg"): ("images/b.jpg", "image/jpeg", b"two"), ("c", "a.png"): ("images/a.png", "image/png", b"\0\0\0"),
    }
    assert {k[1]: v for k, v in images.items() if k[0] == "b"} == {f"i{n}.png": (f"images/i{n}.png", "image/png", bytes([n]) * 50_000) for n in range(60)}


def test_binaries_are_let_go_as_they_pass():
    text = "<FictionBook>" + "<p>word</p>" * 1000 + "".join(f'<binary id="{n}">{"QUJD" * 100_000}</binary>' for n in range(40)) + "</FictionBook>"
    tracemalloc.start()
    assert sum(len(data) for _, _, data in books.fb2_images(text)) == 40 * 300_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000 < len(text)


def test_sections_know_images_without_decoding_them(monkeypatch):
    monkeypatch.setattr(books.base64, "b64decode", None)
    status, sections = books.parse_book("b.fb2", FB2.format(enc="utf-8").encode())
    assert status == "ok" and "![](images/pic.png)" in sections[0][2]


def test_books_are_written_entry_by_entry(spark, tmp_path):
    rows = [("b/1", "x.fb2", "T & <t>", "# One\n\n" + "> " * 3000 + "deep\n\n# Two\n\n![i](images/p.png)"), ("b/2", "y.epub", None, None), (None, "z.fb2", "t", "m")]
    texts = spark.createDataFrame(rows, "book_id string, file_name string, title string, markdown string")
    images = spark.createDataFrame([("b/1", f"images/{n}.png", "image/png", bytearray([n]) * 1000) for n in range(30)] + [("none", "images/p.png", "image/png", bytearray(b"x")), ("b/1", "images/q.png", None, None)], "book_id string, href string, mime_type string, bytes binary")
    for _ in range(2):  # written again, the same files
        got = {r.book_id: r for r in packing.write_books(texts, images, "ru", str(tmp_path / "out"), "p {}").collect()}
    assert set(got) == {"b/1", "b/2"} and [p.name for p in (tmp_path / "out" / "b%2F1").iterdir()] == ["x.ru.epub"]
    packed = {r.book_id: bytes(r.epub) for r in packing.pack_books(texts, images, "ru", "p {}").collect()}
    for book, r in got.items():
        data = (tmp_path / "out" / book.replace("/", "%2F") / r.file_name).read_bytes()
        assert data == packed[book] and len(data) == r.size and data[38:58] == b"application/epub+zip"
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and [(x.filename, x.file_size, x.CRC) for x in z.infolist()] == [tuple(e) for e in r.entries]
            package = xml.dom.minidom.parseString(z.read(packing.PACKAGE))
            hrefs = {f"OEBPS/{n.getAttribute('href')}" for n in package.getElementsByTagName("item")}
            assert hrefs == set(z.namelist()) - {"mimetype", "META-INF/container.xml", packing.PACKAGE}
            assert all(b'href="book.css"' in z.read(n) for n in z.namelist() if n.endswith("xhtml"))
    with zipfile.ZipFile(io.BytesIO(packed["b/1"])) as z:
        assert z.read("OEBPS/images/7.png") == b"\x07" * 1000 and z.read("OEBPS/chapter-001.xhtml").count(b"<blockquote>") == 3000
        assert len(package.getElementsByTagName("itemref")) == 2
    back = books.extract_sections(spark.createDataFrame([("b", "x.epub", bytearray(packed["b/1"]))], "book_id string, file_name string, content binary")).collect()
    assert [r.chapter_title for r in back] == ["One", "Two"]


def test_a_writer_holds_one_entry():
    class Sink(io.RawIOBase):
        size = 0

        def write(self, data):
            self.size += len(data)
            return len(data)

    sink, picture = Sink(), random.Random(1).randbytes(2_000_000)
    tracemalloc.start()
    book = packing.EpubWriter(sink, "t", "de")
    for n in range(30):
        book.image(f"images/{n}.png", "image/png", picture)
    book.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sink.size > 60_000_000 and peak < 10_000_000


def _deliver(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in" / name))


def test_done_chunks_leave_the_store(spark, tmp_path):
    schema = "book_id string, chunk_index int, attempt int, response string, original string, ms long"
    source, good = "A source text that is long enough to check.", "Ein Text, der lang genug ist, um gut zu sein."
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run(horizon_ms):
        query = jobs.run_available(jobs.stream_commit(read(), horizon_ms), str(tmp_path / "out"), str(tmp_path / "cp"))
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]

    _deliver(spark, tmp_path, "1", [("a", n, 1, good, source, 5) for n in range(50)] + [("b", 0, 2, good, source, 6)], schema)
    held = run(3_600_000)
    assert held >= 51
    # delivered again within the horizon: nothing new
    _deliver(spark, tmp_path, "2", [("a", n, 1, "later " + good, source, 9) for n in range(50)], schema)
    run(3_600_000)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 50 and {(r.translation, r.ms) for r in rows} == {(good, 5)}
    _deliver(spark, tmp_path, "3", [("b", 0, 1, "", source, 4)], schema)
    run(3_600_000)
    assert [(r.translation, r.ms) for r in spark.read.parquet(str(tmp_path / "out")).where("book_id = 'b'").collect()] == [(good, 6)]


def test_marks_of_done_chunks_expire(spark, tmp_path):
    schema = "book_id string, chunk_index int, attempt int, response string, original string"
    source, good = "A source text that is long enough to check.", "Ein Text, der lang genug ist, um gut zu sein."
    held = []
    for n in range(3):
        _deliver(spark, tmp_path, str(n), [(f"b{n}", k, 1, good, source) for k in range(40)], schema)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = jobs.run_available(jobs.stream_commit(stream, horizon_ms=1), str(tmp_path / "out"), str(tmp_path / "cp"))
        held.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
    assert held[-1] < 120


def test_progress_counts_once_and_survives_a_replay(spark, tmp_path):
    schema = "book_id string, chunk_index int, used_original boolean"
    path = str(tmp_path / "table")
    counts = lambda: sorted(map(tuple, jobs.read_progress(spark, path).collect()))
    assert counts() == []

    def run(sum_every=2):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return jobs.merge_progress(stream, path, sum_every)

    _deliver(spark, tmp_path, "1", [("a", n, n == 0) for n in range(5)] * 2, schema)
    run()
    assert counts() == [("a", 5, 1)]
    _deliver(spark, tmp_path, "2", [("a", n, False) for n in range(4, 8)] + [("b", 0, True)], schema)
    run()
    assert counts() == [("a", 8, 1), ("b", 1, 1)]
    assert (tmp_path / "table/rows/sum=1").exists()
    _deliver(spark, tmp_path, "3", [("b", 0, True), ("b", 1, None)], schema)
    run()
    assert counts() == [("a", 8, 1), ("b", 2, 1)]
    # the last batch is run again, as after a crash before its commit
    for name in ("commits/2", "commits/.2.crc"):
        (tmp_path / "table/state" / name).unlink(missing_ok=True)
    run()
    assert counts() == [("a", 8, 1), ("b", 2, 1)]
