"""Column functions on small cases."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from chunkflow.functions import checking, xhtml
from chunkflow.functions import text as T
from chunkflow.functions.reversing import reverse_text


def one(spark, text, *columns):
    return tuple(spark.createDataFrame([(text,)], "s string").select(*columns).first())


@pytest.mark.parametrize(
    ("md", "plain"),
    [("# Title\n\nA *b* [c](d) ![e](f)", "Title A b c"), ("```\ncode\n```\nx", "x"), ("- a\n1. b\n> c", "a b c"), ("  ", ""), ("a  b", "a b")],
)
def test_plain_text(spark, md, plain):
    assert one(spark, md, T.plain_text(F.col("s")))[0] == plain == checking.plain(md)


def test_targets_keep_order_and_parentheses(spark):
    md = "[a](x_(y)) ![i](p.png) [b](z) [a](x_(y)) ![j](p.png)"
    links, images = one(spark, md, T.link_hrefs(F.col("s")), T.image_srcs(F.col("s")))
    assert (links, images) == (["x_(y)", "z"], ["p.png"])


@pytest.mark.parametrize(
    ("raw", "safe"),
    [("java\tscript:alert(1)", None), ("\x01javascript:x", None), ("https://a/b", "https://a/b"), ("../c", "../c"), ("mailto:a@b", "mailto:a@b"), ("//h", None), (" ", None)],
)
def test_safe_href(spark, raw, safe):
    assert one(spark, raw, T.safe_href(F.col("s")))[0] == safe


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ("<<<TRANSLATION>>>\nHi\n<<<END_TRANSLATION>>>", "Hi"), ("<<<TRANSLATION>>>\nHi", "Hi"), ("```markdown\nHi\n```", "Hi"), ("Hi", "Hi"),
        ("<<<TRANSLATION>>><<<TRANSLATION>>>Hi<<<END_TRANSLATION>>>", "Hi"), ("﻿ Hi <<<END_GLOSSARY>>>", "Hi"),
    ],
)
def test_parse_response(spark, raw, text):
    assert one(spark, raw, T.parse_response(F.col("s")))[0] == text == checking.parse_answer(raw)


@pytest.mark.parametrize(("lang", "script"), [("ru-RU", "cyrillic"), ("zh_Hans", "cjk"), (" EN ", "latin"), ("xx", "other"), ("", "other")])
def test_scripts(spark, lang, script):
    assert one(spark, lang, T.script_for_lang(F.col("s")))[0] == script


def test_nulls_give_nulls(spark):
    got = one(spark, None, T.plain_text(F.col("s")), T.parse_response(F.col("s")), T.safe_href(F.col("s")), T.nav_title(F.col("s"), F.col("s")))
    assert got == (None, None, None, "")


def test_reversing_keeps_markup_and_is_its_own_inverse():
    md = "# Ab\nxy [cd](e/f.png) `k l`\n```\nuv\n```"
    once = reverse_text(md)
    assert once == "# bA\n yx[dc](e/f.png) `k l`\n```\nvu\n```"
    assert reverse_text(once) == md


@pytest.mark.parametrize(
    ("md", "html"),
    [
        ("a **b *c* d**", "<p>a <strong>b <em>c</em> d</strong></p>"), ("snake_case_name 2 * 3 * 4", "<p>snake_case_name 2 * 3 * 4</p>"),
        ("- one\n- two", "<p>- one</p>\n<p>- two</p>"), ("1. a\n2. b", "<ol>\n<li><p>a</p></li>\n<li><p>b</p></li>\n</ol>"),
        ("`[x](y)` & <z>", "<p><code>[x](y)</code> &amp; &lt;z&gt;</p>"), ("a\nb", "<p>a<br/>\nb</p>"), ("> q\n\n---", "<blockquote><p>q</p></blockquote>\n<hr/>"),
    ],
)
def test_xhtml(md, html):
    assert xhtml.fragment(md) == html


@pytest.mark.parametrize(
    ("md", "html"),
    [
        ("> a\n> > b\n> c\n\n> d", "<blockquote><p>a</p>\n<blockquote><p>b</p></blockquote>\n<p>c</p>\n<p>d</p></blockquote>"), ("> a\n\n\n> b", "<blockquote><p>a</p></blockquote>\n<blockquote><p>b</p></blockquote>"),
        ("> ```\n> > x\n\n> y\nz", "<blockquote><pre><code>&gt; x\n\ny</code></pre></blockquote>\n<p>z</p>"), ("```\na\n```\n```\nb", "<pre><code>a</code></pre>\n<pre><code>b</code></pre>"),
        ("* a\n  b\n  * c\n- d\n1. e", "<ul>\n<li><p>a<br/>\nb</p></li>\n<li><p>c</p></li>\n</ul>\n<p>- d</p>\n<ol>\n<li><p>e</p></li>\n</ol>"), (">", "<blockquote></blockquote>"), ("", ""),
        ("***both*** **a*", "<p><strong><em>both</em></strong> *<em>a</em></p>"), ("_a_b_ __c__", "<p><em>a_b</em> <strong>c</strong></p>"), ("*a\nb*", "<p>*a<br/>\nb*</p>"),
        ("[![x](y/z.png)](u)", '<p>[<img alt="x" src="images/z.png"/>](u)</p>'), ("`a [b](c)` [d](e(f)g)", '<p><code>a [b](c)</code> <a href="e(f)g">d</a></p>'),
    ],
)
def test_xhtml_blocks_and_spans(md, html):
    assert xhtml.fragment(md) == html


@pytest.mark.parametrize("md", [">" * 2000, "> " * 100_000, "*a " * 100_000, "_a " * 100_000, "**a *" * 50_000, "[a](x" + "(y)" * 100_000 + ")", "[" * 200_000, "[a " * 50_000 + "](", "x" + "`" * 100_001, "* a\n" * 50_000])
def test_hostile_markdown_takes_one_pass(spark, md):
    start = time.monotonic()
    got = xhtml.fragment(md)
    assert time.monotonic() - start < 5
    assert got.count("<blockquote>") == got.count("</blockquote>") and xhtml.fragment(md + "\n\nend").endswith("<p>end</p>")


def test_hostile_markdown_in_rows(spark):
    texts = [">" * 2000, "*a " * 20_000, "_a " * 20_000, "[a](x" + "(y)" * 5000 + ")"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(xhtml.markdown_to_xhtml(F.col("s")).alias("x")).collect()
    assert [r.x.count("<") for r in rows] == [4000, 2, 2, 4]
