"""Queries of the operators over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reversing, xhtml
from ..functions import text as T
from ..operators import answers, chunking, commits, cost, failures, glossary, links, progress, records, requests, review, sequences, translation
from ..sources import books, packing
from ..streaming import jobs
from .inputs import table, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of get(table name) under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = with_inputs(sql)
        return f

    return add


WS = T.WS


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _plain(x: str) -> str:
    for a, b in [(r"```[\s\S]*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (rf"(?m)^#{{1,6}}{WS}+", ""), (rf"(?m)^[>*+-]{WS}+", ""), (rf"(?m)^[0-9]+\.{WS}+", ""), (r"[`*_~]", ""), (rf"{WS}+", " ")]:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return _trim(x)


URL = r"[^()\s]*(?:\([^()]*\)[^()]*)*"
MARK = "(?i)<<<(?:END_)?(?:TRANSLATION|SOURCE|GLOSSARY)>>>"
ROUND = "floor({} + 0.5)::BIGINT"


# --- text functions


@query(f"SELECT doc_id, {_plain('md')} AS plain, least(length(md), 9) AS n FROM @docs_md")
def plain_text(get):
    return get("docs_md").select("doc_id", T.plain_text(F.col("md")).alias("plain"), F.least(F.length("md"), F.lit(9)).alias("n"))


@query(rf"""
WITH f AS (
  SELECT doc_id, 'image' AS kind, regexp_extract_all(md, '!\[[^\]]*\]\(({URL})\)', 1) AS t FROM @docs_md
  UNION ALL SELECT doc_id, 'link', regexp_extract_all(md, '(?:^|[^!])\[[^\]]*\]\(({URL})\)', 1) FROM @docs_md
)
SELECT doc_id, kind, i - 1 AS pos, t[i] AS target FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM f)
""")
def explode_links(get):
    return links.explode_links(get("docs_md"), "doc_id", "md")


HREF = "CASE page_id % 7 WHEN 0 THEN 'java' || chr(9) || 'script:alert(1)' WHEN 1 THEN '//host/x' WHEN 2 THEN ' mailto:a@b.example' WHEN 3 THEN '../rel/' || cast(page_id AS string) WHEN 4 THEN ' ' WHEN 5 THEN 'data:text/html,x' ELSE url END"


@query(rf"""
WITH b AS (SELECT page_id, regexp_replace({HREF}, '[\x00-\x20\x7F]', '', 'g') AS bare FROM pages),
s AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM b)
SELECT page_id, CASE WHEN bare = '' OR starts_with(bare, '//') THEN NULL WHEN scheme = '' OR scheme IN ('http', 'https', 'mailto') THEN bare END AS href FROM s
""")
def safe_href(get):
    return get("pages").select("page_id", T.safe_href(F.expr(HREF)).alias("href"))


ANSWER = "CASE turn % 5 WHEN 0 THEN '<<<TRANSLATION>>>' || chr(10) || text || chr(10) || '<<<END_TRANSLATION>>>' WHEN 1 THEN '```markdown' || chr(10) || text || chr(10) || '```' WHEN 2 THEN '<<<translation>>> ' || text WHEN 3 THEN 'so: <<<TRANSLATION>>><<<TRANSLATION>>>' || text || ' <<<END_TRANSLATION>>> <<<SOURCE>>>' ELSE text || '<<<END_GLOSSARY>>>' END"


@query(rf"""
WITH a AS (SELECT conv_id, turn, {_trim(rf"regexp_replace(regexp_replace({ANSWER}, '^(?i:```(?:markdown|md|xml|html)?\n?)', ''), '\n?```$', '')")} AS s FROM conversations),
b AS (SELECT *, regexp_extract(s, '(?is)<<<TRANSLATION>>>{WS}*(.*?){WS}*<<<END_TRANSLATION>>>', 1) AS inner_, regexp_matches(s, '(?is)<<<TRANSLATION>>>.*<<<END_TRANSLATION>>>') AS tagged FROM a),
c AS (SELECT conv_id, turn, CASE WHEN tagged THEN {_trim("inner_")} END AS tagged, CASE WHEN tagged THEN {_trim("inner_")} ELSE s END AS s FROM b)
SELECT conv_id, turn, tagged, {_trim(rf"regexp_replace(regexp_replace(regexp_replace(s, '(?i)^{WS}*<<<TRANSLATION>>>{WS}*', ''), '(?i){WS}*<<<END_TRANSLATION>>>{WS}*$', ''), '{MARK}', '', 'g')")} AS answer FROM c
""")
def parse_response(get):
    raw = F.expr(ANSWER)
    return get("conversations").select("conv_id", "turn", T.extract_tagged(T.strip_fence(raw), "TRANSLATION").alias("tagged"), T.parse_response(raw).alias("answer"))


@query(r"SELECT page_id, replace(replace(replace(replace(regexp_replace(html || chr(1) || chr(31), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '" + '"' + "', '&quot;') AS escaped FROM pages")
def escape_xml(get):
    return get("pages").select("page_id", T.escape_xml(F.expr("html || chr(1) || chr(31)")).alias("escaped"))


MIXED = "CASE WHEN doc_id % 4 = 0 THEN 'Это русский текст о погоде и море. ' || text WHEN doc_id % 4 = 1 THEN 'Русский текст, только он.' WHEN doc_id % 4 = 2 THEN '漢字かな交じり文の例です' ELSE text END"
SCRIPTS = "CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN 'latin' ELSE 'other' END"


@query(rf"""
WITH c AS (SELECT doc_id, lang, len(regexp_extract_all(t, '[\x{{400}}-\x{{4FF}}]')) AS cyrillic, len(regexp_extract_all(t, '[A-Za-z]')) AS latin, len(regexp_extract_all(t, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}]')) AS cjk FROM (SELECT doc_id, lang, {MIXED} AS t FROM documents)),
s AS (SELECT *, cyrillic + latin + cjk AS total FROM c)
SELECT doc_id, cyrillic, latin, cjk, {SCRIPTS} AS script, total >= 8 AND latin / nullif(total, 0) > 0.7 AS mostly_latin, total >= 8 AND cyrillic / nullif(total, 0) > 0.7 AS mostly_cyrillic FROM s
""")
def script_profile(get):
    rows = get("documents").select("doc_id", T.script_counts(F.expr(MIXED)).alias("c"), T.script_for_lang(F.concat("lang", F.lit("-XX"))).alias("script"))
    return rows.select("doc_id", "c.*", "script", T.mostly_script(F.col("c"), F.col("script")).alias("mostly_latin"), T.mostly_script(F.col("c"), F.lit("cyrillic")).alias("mostly_cyrillic"))


@query(rf"""
SELECT doc_id, greatest(1, ceil(n_chars / (CASE WHEN regexp_matches({MIXED}, '[\x{{400}}-\x{{4FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]') THEN 2.0 ELSE 4.0 END)))::BIGINT AS by_sample,
       greatest(1, ceil(n_chars / (CASE WHEN doc_id % 2 = 0 THEN 2.0 ELSE 4.0 END)))::BIGINT AS by_lang,
       least(32768, greatest(2048, ceil(n_chars / 4.0::DOUBLE * 2.2::DOUBLE) + 512))::BIGINT AS budget FROM documents
""")
def token_estimates(get):
    lang = F.when(F.col("doc_id") % 2 == 0, "RU-ru").otherwise(F.col("lang"))
    return get("documents").select(
        "doc_id", T.tokens_for_chars(F.col("n_chars"), F.expr(MIXED)).alias("by_sample"), T.tokens_for_lang(F.col("n_chars"), lang).alias("by_lang"), T.output_token_budget(F.col("n_chars")).alias("budget")
    )


@query(rf"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || lang || ' ' ELSE '' END AS title, {_plain("CASE WHEN doc_id % 3 = 1 THEN '# Hi' ELSE text END")} AS plain FROM documents)
SELECT doc_id, CASE WHEN trim(title) <> '' THEN trim(title) WHEN length(plain) <= 48 THEN plain ELSE {_trim("substr(plain, 1, 48)")} || '…' END AS nav FROM p
""")
def nav_title(get):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "lang", F.lit(" ")))
    return get("documents").select("doc_id", T.nav_title(title, F.when(F.col("doc_id") % 3 == 1, "# Hi").otherwise(F.col("text"))).alias("nav"))


# --- filters and checks


@query(rf"""
WITH p AS (SELECT *, {_plain("original")} AS src, {_plain("translation")} AS dst FROM @answers),
q AS (SELECT *, length(src) AS s, length(dst) AS d FROM p)
SELECT book_id, chunk_index, reason IS NULL AS ok, reason FROM (SELECT book_id, chunk_index, CASE
  WHEN {_trim("translation")} = '' THEN 'empty translation'
  WHEN s > 20 AND d < greatest(8.0::DOUBLE, s * 0.15::DOUBLE) THEN 'translation too short'
  WHEN s > 20 AND d > s * 8 THEN 'translation too long'
  WHEN regexp_matches(dst, '(?i)i cannot translate|i can''t translate|as an ai|не могу перевести|отказ от перевода') THEN 'model refusal'
  WHEN regexp_matches(translation, '{MARK}') THEN 'harness tags in translation'
  WHEN book_id % 8 = 5 THEN 'missing image img/x.png'
  WHEN book_id % 8 = 6 THEN 'missing href https://e.example/(x)/y' END AS reason FROM q)
""")
def validate_pairs(get):
    return answers.validate_pairs(get("answers")).select("book_id", "chunk_index", "ok", "reason")


@query(rf"""
WITH b AS (SELECT doc_id, source, doc_id % 9 AS mark, {MIXED} AS text FROM documents),
c AS (SELECT *, len(regexp_extract_all(text, '[\x{{400}}-\x{{4FF}}]')) AS cyr, len(regexp_extract_all(text, '[A-Za-z]')) AS lat, len(regexp_extract_all(text, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}]')) AS cjk FROM b),
k AS (SELECT *, cyr + lat + cjk AS n FROM c),
g AS (SELECT *, NOT (mark = 3 OR (n >= 8 AND cyr / nullif(n, 0) > 0.7 AND NOT (n >= 8 AND lat / nullif(n, 0) > 0.7))) AS stays FROM k)
SELECT source, doc_id FROM (SELECT *, max(stays) OVER (PARTITION BY source, doc_id % 50) AS any_left FROM g) WHERE stays OR NOT any_left
""")
def drop_target_language(get):
    rows = get("documents").select("source", "doc_id", (F.col("doc_id") % 50).alias("section"), F.when(F.col("doc_id") % 9 == 3, "RU-ru").alias("lang"), F.expr(MIXED).alias("text"))
    return answers.drop_target_language(rows, F.lit("en"), F.lit("ru_RU"), ["source", "section"]).select("source", "doc_id")


@query("SELECT book_id, chunk_index FROM @pairs WHERE used_original")
def kept_original(get):
    return commits.kept_original(get("pairs")).select("book_id", "chunk_index")


@query("SELECT DISTINCT source AS id FROM documents WHERE contains(lower(source), 'src1')")
def match_models(get):
    return cost.match_models(get("documents").select(F.col("source").alias("id")).distinct(), " SRC1 ")


# --- sequences


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id, turn) - 1 AS chunk_index FROM conversations")
def index_chunks(get):
    parts = get("conversations").select((F.col("conv_id") % 40).alias("book_id"), F.col("conv_id").alias("piece_pos"), F.col("turn").alias("part_pos"))
    return sequences.index_chunks(parts).select(F.col("piece_pos").alias("conv_id"), F.col("part_pos").alias("turn"), "chunk_index")


@query("SELECT book_id, chunk_index // 4 AS big_id, min(chunk_index) AS from_index, max(chunk_index) AS to_index, string_agg(markdown, '' ORDER BY chunk_index) AS markdown FROM @sourced GROUP BY ALL")
def big_chunks(get):
    return sequences.big_chunks(get("sourced"))


_WINDOWS = "SELECT book_id, w AS window_id, w * size AS from_index, least(n, (w + 1) * size) AS to_index FROM (SELECT *, unnest(range(0, ceil(n / size)::BIGINT)) AS w FROM s)"


@query(f"WITH c AS (SELECT book_id, count(*) AS n FROM @sourced GROUP BY 1), s AS (SELECT *, ceil(n / greatest(1, least(3, n)))::BIGINT AS size FROM c) {_WINDOWS}")
def translate_windows(get):
    return sequences.translate_windows(get("sourced"), 3)


@query(f"WITH c AS (SELECT book_id, least(count(*), 7) AS n FROM @sourced GROUP BY 1), s AS (SELECT *, ceil(n / greatest(1, least(3, n)))::BIGINT AS size FROM c) {_WINDOWS}")
def trial_windows(get):
    return sequences.translate_windows(get("sourced"), 3, limit=7)


@query(f"WITH s AS (SELECT book_id, count(*) AS n, 5 AS size FROM @sourced GROUP BY 1) {_WINDOWS}")
def review_windows(get):
    return sequences.review_windows(get("sourced"), 5)


@query("""
WITH r AS (SELECT conv_id AS book_id, turn AS window_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE turn % 3 <> 0)
SELECT book_id, window_id, (rank // ceil(n / greatest(1, least(2, n)))::BIGINT)::INT AS slot FROM r
""")
def review_slots(get):
    return sequences.review_slots(get("conversations").where("turn % 3 <> 0").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("window_id")), 2)


_CHAPTERS = """c AS (SELECT *, CASE WHEN lag(chapter_title || '/' || document_path) OVER w IS NOT DISTINCT FROM chapter_title || '/' || document_path THEN 0 ELSE 1 END AS new FROM {0} WINDOW w AS (PARTITION BY book_id ORDER BY chunk_index)),
n AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY chunk_index) - 1 AS chapter_no FROM c)"""
_RANGES = "SELECT book_id, chapter_no, min(chapter_title) AS title, min(document_path) AS document_path, min(chunk_index) AS from_index, max(chunk_index) AS to_index FROM n GROUP BY 1, 2"


@query(f"WITH {_CHAPTERS.format('@sourced')} {_RANGES}")
def chapter_ranges(get):
    return sequences.chapter_ranges(get("sourced"))


@query(f"""WITH {_CHAPTERS.format("(SELECT * REPLACE (CASE WHEN chapter_title = 'T1' THEN ' ' ELSE chapter_title END AS chapter_title) FROM @turns)")}, r AS ({_RANGES})
SELECT book_id, string_agg('# ' || CASE WHEN trim(title) = '' THEN 'Untitled ' || (chapter_no + 1)::INT ELSE trim(title) END || ' (chunks from ' || (from_index + 1) || ' to ' || (to_index + 1) || ')', chr(10) ORDER BY chapter_no) AS chapters FROM r GROUP BY 1""")
def chapter_list(get):
    return sequences.chapter_list(get("turns").withColumn("chapter_title", F.when(F.col("chapter_title") == "T1", " ").otherwise(F.col("chapter_title"))))


BOOK_MD = "CASE WHEN doc_id % 3 = 0 THEN '# A' || chr(10) || 'one' || chr(10) || '```' || chr(10) || '# no' || chr(10) || '```' || chr(10) || '## B ' || source || chr(10) ELSE 'pre' || chr(10) || '# C' || chr(10) END || text"


@query(rf"""
WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, string_split({_trim(BOOK_MD)}, chr(10)) AS x FROM documents))),
f AS (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM l),
h AS (SELECT *, sum((i > 0 AND fences % 2 = 0 AND regexp_matches(line, '^#{{1,2}} '))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM f),
g AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY i) AS body, arg_min(line, i) AS first, count(*) AS n_lines FROM h GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS chapter_no, trim(regexp_extract(first, '^#{{1,2}} (.*)', 1)) AS title, {_trim("body")} AS body, n_lines FROM g
""")
def split_chapters(get):
    books = get("documents").select(F.col("doc_id").alias("book_id"), F.expr(BOOK_MD).alias("markdown"))
    return commits.split_chapters(books).withColumnRenamed("book_id", "doc_id")


@query("SELECT book_id, arg_max(chunk_index, length(markdown) * 100000 - chunk_index) AS chunk_index FROM @sourced GROUP BY 1")
def longest_chunk(get):
    return sequences.longest_chunk(get("sourced"))


@query("SELECT book_id, chunk_index FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM @turns) WHERE chunk_index IN (0, 1, n // 3, n * 2 // 3, n - 1)")
def style_sample(get):
    return sequences.style_sample(get("turns")).select("book_id", "chunk_index")


# --- joins and commits


@query("""
SELECT t.book_id, t.chunk_index, count(p.chunk_index) AS n_prev, coalesce(string_agg(p.chunk_index::VARCHAR, ',' ORDER BY p.chunk_index), '') AS prev_turns
FROM @turns t LEFT JOIN @pairs p ON p.book_id = t.book_id AND p.chunk_index BETWEEN t.chunk_index - 2 AND t.chunk_index - 1 GROUP BY 1, 2
""")
def context_pairs(get):
    out = sequences.context_pairs(get("turns"), get("pairs"))
    return out.select("book_id", "chunk_index", F.size("context").alias("n_prev"), F.array_join(F.transform("context", lambda x: x["at"].cast("string")), ",").alias("prev_turns"))


@query("""
SELECT t.book_id, t.chunk_index, count(p.chunk_index) AS n_prev
FROM @turns t LEFT JOIN @pairs p ON p.book_id = t.book_id AND p.chunk_index BETWEEN t.chunk_index - 2 AND t.chunk_index - 1 AND p.chunk_index // 3 = t.chunk_index // 3 GROUP BY 1, 2
""")
def window_context(get):
    turns = get("turns").withColumn("window_id", F.floor(F.col("chunk_index") / 3))
    return sequences.context_pairs(turns, get("pairs"), windowed=True).select("book_id", "chunk_index", F.size("context").alias("n_prev"))


@query("SELECT t.book_id, t.chunk_index, coalesce(p.translation, t.markdown) AS markdown FROM @turns t LEFT JOIN @pairs p USING (book_id, chunk_index)")
def assemble_translations(get):
    return commits.assemble_translations(get("turns"), get("pairs")).select("book_id", "chunk_index", "markdown")


@query("SELECT book_id, chunk_index FROM @turns t ANTI JOIN @pairs p USING (book_id, chunk_index) WHERE chunk_index < 5")
def pending_chunks(get):
    return commits.pending_chunks(get("turns"), get("pairs"), limit=5).select("book_id", "chunk_index")


@query("""
WITH u AS (SELECT book_id, chunk_index, translation, -1 AS v FROM @pairs UNION ALL SELECT book_id, chunk_index, markdown, 1 FROM @turns WHERE chunk_index % 4 = 1 UNION ALL SELECT book_id, chunk_index, 'z', 2 FROM @turns WHERE chunk_index % 8 = 1)
SELECT book_id, chunk_index, arg_max(translation, v) AS translation FROM u GROUP BY 1, 2
""")
def commit_pairs(get):
    cols = ["book_id", "chunk_index", "translation"]
    new = get("turns").where("chunk_index % 4 = 1").select("book_id", "chunk_index", F.concat(F.lit("<<<TRANSLATION>>>"), "markdown", F.lit("<<<END_TRANSLATION>>>")).alias("translation"), F.lit(1).cast("long").alias("version"))
    last = get("turns").where("chunk_index % 8 = 1").select("book_id", "chunk_index", F.lit("z").alias("translation"), F.lit(2).cast("long").alias("version"))
    return commits.commit_pairs(get("pairs").select(cols), new.unionByName(last))


@query("SELECT book_id, chunk_index FROM @reviewed r ANTI JOIN (SELECT * FROM @pairs WHERE used_original) p USING (book_id, chunk_index)")
def invalidate_reviewed(get):
    return commits.invalidate_reviewed(get("reviewed"), get("pairs").where("used_original")).select("book_id", "chunk_index")


@query("""
WITH e AS (SELECT conv_id AS book_id, turn AS chunk_index, conv_id % 3 AS window_id FROM conversations)
SELECT book_id, chunk_index, window_id, chunk_index // 2 = window_id AS owned,
       CASE WHEN chunk_index // 2 <> window_id THEN 'err: chunk ' || chunk_index || ' is outside your range: ' || window_id * 2 || ', ' || window_id * 2 + 1 END AS message FROM e
""")
def edit_ownership(get):
    edits = get("conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chunk_index"), (F.col("conv_id") % 3).alias("window_id"))
    return commits.edit_ownership(edits, 2)


@query("""
WITH p AS (SELECT p.* FROM @pairs p SEMI JOIN @reviewed r USING (book_id, chunk_index))
SELECT book_id, chunk_index, coalesce(pre_review, translation) AS before, translation AS after, coalesce(pre_review, translation) <> translation AS changed FROM p
""")
def changed_pairs(get):
    return commits.changed_pairs(get("pairs"), get("reviewed"))


@query(rf"""
WITH p AS (SELECT book_id, chunk_index, join_with, regexp_replace(markdown, '\s+$', '') AS t FROM (SELECT * REPLACE (CASE WHEN chunk_index = 3 THEN '  ' ELSE ' ' || markdown || chr(10) END AS markdown) FROM @turns)),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chunk_index) AS i FROM p WHERE t <> '')
SELECT book_id, string_agg(CASE WHEN i = 1 THEN t WHEN join_with IS NULL THEN chr(10) || chr(10) || t WHEN join_with = 'space' THEN ' ' || regexp_replace(t, '^[ \t]+', '') ELSE chr(10) || regexp_replace(t, '^[ \t]+', '') END, '' ORDER BY i) || chr(10) AS markdown FROM k GROUP BY 1
""")
def join_chunks(get):
    text = F.when(F.col("chunk_index") == 3, "  ").otherwise(F.concat(F.lit(" "), "markdown", F.lit("\n")))
    return commits.join_chunks(get("turns").withColumn("markdown", text))


@query(rf"""
WITH a AS (SELECT a.*, c.text AS original, {_trim(rf"regexp_replace(coalesce(nullif(regexp_extract(response, '(?is)<<<TRANSLATION>>>{WS}*(.*?){WS}*<<<END_TRANSLATION>>>', 1), ''), response), '{MARK}', '', 'g')")} AS t FROM @attempts a JOIN conversations c ON c.conv_id = a.book_id AND c.turn = a.chunk_index),
v AS (SELECT *, CASE WHEN t = '' THEN 'empty translation' WHEN length({_plain("original")}) > 20 AND length({_plain("t")}) < greatest(8.0::DOUBLE, length({_plain("original")}) * 0.15::DOUBLE) THEN 'translation too short' WHEN contains(lower(t), 'as an ai') THEN 'model refusal' END AS reason FROM a),
g AS (SELECT book_id, chunk_index, max(original) AS original, arg_min(t, attempt) FILTER (reason IS NULL) AS good, arg_max(reason, attempt) AS last, count(*) AS n FROM v GROUP BY 1, 2)
SELECT book_id, chunk_index, coalesce(good, original) AS translation, good IS NULL AS used_original, CASE WHEN good IS NULL THEN last END AS reason FROM g WHERE good IS NOT NULL OR n >= 3
""")
def accept_attempts(get):
    return answers.accept_attempts(get("turns"), get("attempts")).select("book_id", "chunk_index", "translation", "used_original", "reason")


# --- glossaries

@query("SELECT book_id, chunk_index, len(list_distinct(regexp_extract_all(markdown, '\\b[A-Z][A-Za-z]{2,}\\b'))) AS n_names FROM @sourced")
def glossary_candidates(get):
    return glossary.glossary_candidates(get("sourced"), top=1_000_000).select("book_id", "chunk_index", F.size("names").alias("n_names"))


def _extracts(get):
    rows = glossary.candidate_rows(get("sourced").select("book_id", F.col("chunk_index").alias("big_id"), "markdown"), top=1_000_000)
    return rows.withColumn("dst", F.when(F.length("src") == 4, F.col("src")).otherwise(F.concat(F.col("big_id"), F.lit(" "), F.reverse("src"), F.lit(" "))))


@query("""
WITH x AS (SELECT book_id, 1 AS prio, chunk_index AS big_id, unnest(regexp_extract_all(markdown, '\\b[A-Z][A-Za-z]{2,}\\b')) AS src FROM @sourced),
u AS (SELECT book_id, prio, big_id, src, big_id || ' ' || reverse(src) AS dst FROM x WHERE length(src) <> 4 UNION ALL SELECT DISTINCT source, 0, 0, 'The', 'Seed' FROM documents)
SELECT book_id, src, arg_min(dst, prio * 1000000 + big_id) AS dst FROM u GROUP BY 1, 2
""")
def glossary_merge(get):
    seed = get("documents").select(F.col("source").alias("book_id"), F.lit(0).alias("pos"), F.lit(" The").alias("src"), F.lit("Seed ").alias("dst")).distinct()
    return glossary.merge_glossary(seed, _extracts(get)).select("book_id", "src", "dst")


@query("""
WITH c AS (SELECT conv_id % 20 AS book_id, conv_id * 100 + turn AS spot, 'w' || conv_id % 7 AS src, 'd' || conv_id || '-' || turn AS dst, 0 AS late FROM conversations WHERE turn % 3 = 0
UNION ALL SELECT conv_id % 20, conv_id * 100 + turn, 'w' || conv_id % 9, 'u' || turn, 1 FROM conversations WHERE turn % 3 > 0)
SELECT book_id, src, arg_max(dst, late * 1000000000 + spot) AS dst, min(late) AS late FROM c GROUP BY 1, 2
""")
def glossary_upsert(get):
    c = get("conversations").withColumn("book_id", F.col("conv_id") % 20)
    now = c.where("turn % 3 = 0").select("book_id", F.expr("conv_id * 100 + turn").alias("pos"), F.expr("'w' || conv_id % 7").alias("src"), F.expr("'d' || conv_id || '-' || turn").alias("dst"))
    new = c.where("turn % 3 > 0").select("book_id", F.expr("conv_id * 100 + turn").alias("seq"), F.expr("' w' || conv_id % 9").alias("src"), F.expr("'u' || turn || ' '").alias("dst"))
    return glossary.upsert_glossary(now, new).select("book_id", "src", "dst", "ord.late")


@query("""
WITH e AS (SELECT conv_id % 30 AS book_id, conv_id * 100 + turn AS ord, 's' || conv_id || '-' || turn AS src, role AS dst FROM conversations WHERE conv_id % 30 < 25)
SELECT book_id, coalesce(glossary, '(none yet)') AS glossary FROM (SELECT DISTINCT conv_id % 30 AS book_id FROM conversations) LEFT JOIN (SELECT book_id, string_agg(src || ' — ' || dst, chr(10) ORDER BY ord) AS glossary FROM e GROUP BY 1) USING (book_id)
""")
def glossary_text(get):
    c = get("conversations").withColumn("book_id", F.col("conv_id") % 30)
    return glossary.glossary_text(c, c.where("book_id < 25").select("book_id", F.expr("conv_id * 100 + turn").alias("ord"), F.expr("'s' || conv_id || '-' || turn").alias("src"), F.col("role").alias("dst")))


PASTED = "'# note' || chr(10) || chr(10) || ' a' || cast(conv_id AS string) || ' -> b ' || chr(10) || 'c — d|e' || chr(10) || 'none' || chr(10) || role || '|' || cast(turn AS string) || ' – x'"


@query(rf"""
WITH l AS (SELECT conv_id, turn, unnest(range(0, len(x))) AS pos, {_trim("unnest(x)")} AS line FROM (SELECT conv_id, turn, string_split({PASTED}, chr(10)) AS x FROM conversations)),
p AS (SELECT *, regexp_split_to_array(line, '\s*(?:->|—|–|\|)\s*') AS parts FROM l WHERE line <> '' AND NOT starts_with(line, '#'))
SELECT cast(conv_id AS varchar) || '-' || cast(turn AS varchar) AS book_id, pos, parts[1] AS src, array_to_string(parts[2:], ' | ') AS dst FROM p WHERE len(parts) >= 2
""")
def parse_glossary_lines(get):
    return glossary.parse_glossary_lines(get("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("book_id"), F.expr(PASTED).alias("text")))


# --- cost, catalog, progress

_COST = rf"""
WITH b AS (SELECT book_id, count(*) AS n, sum(length(markdown)) / count(*)::DOUBLE AS avg, regexp_matches(arg_min(markdown, chunk_index)[:2000], '[\x{{400}}-\x{{4FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]') AS dense FROM @sourced GROUP BY 1),
t AS (SELECT *, greatest(1, ceil(avg / CASE WHEN dense THEN 2 ELSE 4 END)) AS t, greatest(1, ceil(avg / 4)) AS o, ceil(n / 4.0) AS g, ceil(n / 5.0) AS r, greatest(1, ceil(avg * 4 / CASE WHEN dense THEN 2 ELSE 4 END)) AS tg FROM b),
i AS (SELECT *, n * (t + 1500 + 800 + t + o) + g * (1500 + tg) + r * (2300 * 14 + (t + o) / 2.0 * 12 * 7.5) + 9000 + t * least(10, greatest(n, 1)) * 3.5 + 4 * (1500 + t + o) AS i FROM t),
c AS (SELECT book_id, n AS chunks, floor(i + 0.5)::BIGINT AS input_tokens, floor(n * ceil(o * 1.15::DOUBLE) + 400 * g + 600 * r + 900 + 1200 + 0.5)::BIGINT AS output_tokens, floor(7000 * g + 9000 * n / 2.0 + 12000 * r / 2.0 + 0.5)::BIGINT AS eta_ms FROM i)"""


@query(_COST + """, m AS (SELECT c.*, s.model, s.model LIKE '%:free' AS free, p.input_per_million AS pi, p.output_per_million AS po FROM c JOIN @settings s USING (book_id) LEFT JOIN @prices p ON p.model_id = s.model)
SELECT book_id, chunks, input_tokens, output_tokens, eta_ms, round(CASE WHEN free THEN 0.0 ELSE input_tokens / 1e6::DOUBLE * pi + output_tokens / 1e6::DOUBLE * po END, 6) AS usd, CASE WHEN free THEN 'fallback' WHEN pi IS NOT NULL THEN 'catalog' ELSE 'unknown' END AS source FROM m""")
def estimate_cost(get):
    out = cost.estimate_cost(get("sourced"), get("settings"), get("prices"))
    return out.select("book_id", "chunks", "input_tokens", "output_tokens", "eta_ms", F.round("usd", 6).alias("usd"), "source")


@query(_COST + " SELECT book_id, least(20, greatest(chunks, 1)) AS chunks, floor(input_tokens * (least(20, greatest(chunks, 1)) / greatest(chunks, 1)::DOUBLE) + 0.5)::BIGINT AS input_tokens, floor(eta_ms * (least(20, greatest(chunks, 1)) / greatest(chunks, 1)::DOUBLE) + 0.5)::BIGINT AS eta_ms FROM c")
def scale_cost(get):
    return cost.scale_cost(cost.estimate_cost(get("sourced"), get("settings")), F.lit(20)).select("book_id", "chunks", "input_tokens", "eta_ms")


@query("""
SELECT s.book_id, CASE WHEN provider_id = 'open' OR model LIKE '%:free' THEN 0.0 ELSE coalesce(p.input_per_million, CASE WHEN model = 'm-es' THEN 0.5 END) END AS price_in,
       CASE WHEN provider_id = 'open' OR model LIKE '%:free' THEN 'fallback' WHEN p.model_id IS NOT NULL THEN 'catalog' WHEN model = 'm-es' THEN 'fallback' ELSE 'unknown' END AS source
FROM @settings s LEFT JOIN @prices p ON p.model_id = s.model
""")
def model_price(get):
    prices = get("prices")
    fallback = prices.sparkSession.createDataFrame([("m-es", 0.5, 0.7)], "model_id string, input_per_million double, output_per_million double")
    return cost.model_price(get("settings"), prices, fallback, free=["open"]).select("book_id", "price_in", "source")


@query("""
WITH k AS (SELECT 'm-' || source AS id, CASE WHEN min(doc_id) % 3 = 0 THEN min(doc_id)::DOUBLE END AS p FROM documents GROUP BY 1 UNION ALL SELECT 'm-x:free', 3.0),
l AS (SELECT DISTINCT 'm-' || source AS id, CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 END AS live_ord FROM documents WHERE source IN ('src1', 'src3') UNION ALL SELECT 'm-new', 3)
SELECT id, CASE WHEN id LIKE '%:free' THEN 0.0 ELSE coalesce(p, CASE WHEN id = 'm-src1' THEN 9.0 END) END AS input_per_million, live_ord FROM k FULL JOIN l USING (id)
""")
def model_catalog(get):
    d, spark = get("documents"), get("documents").sparkSession
    p = F.when(F.min("doc_id") % 3 == 0, F.min("doc_id").cast("double"))
    catalog = d.groupBy(F.concat(F.lit("m-"), "source").alias("id")).agg(F.min("doc_id").alias("ord"), p.alias("input_per_million"), p.alias("output_per_million"))
    curated = catalog.limit(0).unionByName(spark.createDataFrame([("m-x:free", 0, 3.0, 3.0)], "id string, ord long, input_per_million double, output_per_million double"))
    live = d.where("source in ('src1', 'src3')").select(F.concat(F.lit("m-"), "source").alias("id"), F.when(F.col("source") == "src3", 1).otherwise(2).alias("ord")).distinct()
    live = live.unionByName(spark.createDataFrame([("m-new", 3)], "id string, ord int"))
    fallback = spark.createDataFrame([("m-src1", 9.0, 9.0)], "id string, input_per_million double, output_per_million double")
    return cost.model_catalog(curated, catalog, live, fallback).select("id", "input_per_million", "live_ord")


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE value > 0)
SELECT user_id, floor(avg(value) * 12 / 3 + 0.5)::BIGINT AS eta_ms FROM r WHERE n <= 8 GROUP BY 1
""")
def eta(get):
    pairs = get("events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("chunk_index"), F.col("value").alias("ms"))
    left = pairs.where("ms > 0").select("book_id").distinct().withColumn("remaining", F.lit(12))
    return progress.eta(pairs, left, 3).select(F.col("book_id").alias("user_id"), "eta_ms")


_PROGRESS = """
WITH r AS (SELECT t.book_id, t.chunk_index, t.chapter_title, t.document_path, p.book_id IS NOT NULL AS done, coalesce(p.used_original, false) AS kept, p.ms FROM @turns t LEFT JOIN @pairs p USING (book_id, chunk_index)),
g AS (SELECT book_id, count(*) AS total, sum(done::INT) AS done, sum(kept::INT) AS kept, avg(CASE WHEN ms > 0 THEN ms END) AS mean_ms, coalesce(min(CASE WHEN NOT done THEN chunk_index END), max(chunk_index)) AS live_index FROM r GROUP BY 1)"""


@query(_PROGRESS + " SELECT book_id, total, done, kept, done - kept AS translated, floor(100 * done / total + 0.5)::INT AS percent, round(mean_ms, 6) AS mean_ms, live_index FROM g")
def book_progress(get):
    return progress.progress(get("turns"), get("pairs")).withColumn("mean_ms", F.round("mean_ms", 6))


@query(_PROGRESS + ", " + _CHAPTERS.format("r") + """, h AS (SELECT book_id, chapter_no, min(chunk_index) AS first, max(chunk_index) AS last, count(*) AS n, sum(done::INT) AS done, sum(kept::INT) AS kept FROM n GROUP BY 1, 2)
SELECT h.book_id, chapter_no, first, n, h.done, h.kept, CASE WHEN live_index BETWEEN first AND last THEN 'running' WHEN h.done = n THEN CASE WHEN h.kept > 0 THEN 'kept' ELSE 'done' END WHEN h.done > 0 THEN 'running' ELSE 'queued' END AS state FROM h JOIN g USING (book_id)""")
def chapter_progress(get):
    return progress.chapter_progress(get("turns"), get("pairs"))


@query("""
WITH w AS (SELECT t.book_id, t.chunk_index // 2 AS window_id, bool_and(r.book_id IS NOT NULL) AS done FROM @turns t LEFT JOIN @reviewed r USING (book_id, chunk_index) GROUP BY 1, 2)
SELECT book_id, count(*) AS total, sum(done::INT) AS reviewed FROM w GROUP BY 1
""")
def review_progress(get):
    return progress.review_progress(sequences.review_windows(get("turns"), 2), get("reviewed"), 2)


# --- requests


@query(rf"""
WITH p AS (SELECT t.book_id, t.chunk_index, t.markdown, coalesce((SELECT string_agg('<prev' || i || '><original>' || chr(10) || original || chr(10) || '</original><translate>' || chr(10) || translation || chr(10) || '</translate></prev' || i || '>', chr(10) ORDER BY i) FROM (SELECT *, row_number() OVER (ORDER BY q.chunk_index) AS i FROM @pairs q WHERE q.book_id = t.book_id AND q.chunk_index BETWEEN t.chunk_index - 2 AND t.chunk_index - 1)), '(start of book)') AS recent FROM @turns t)
SELECT book_id, chunk_index, 'GLOSSARY:' || chr(10) || '(none yet)' || chr(10) || chr(10) || 'PREVIOUS TWO CHUNKS:' || chr(10) || recent || chr(10) || chr(10) || '<<<SOURCE>>>' || chr(10) || markdown || chr(10) || '<<<END_SOURCE>>>' AS prompt,
       least(32768, greatest(2048, ceil(length(markdown) / 4.0::DOUBLE * 2.2::DOUBLE) + 512))::BIGINT AS max_tokens FROM p
""")
def translate_requests(get):
    turns = get("turns").select("book_id", "chunk_index", "markdown")
    guide = turns.select("book_id").distinct().withColumn("style_guide", F.lit("plain"))
    terms = guide.select("book_id", F.lit("(none yet)").alias("glossary"))
    out = requests.translate_requests(sequences.context_pairs(turns, get("pairs")), terms, guide)
    return out.select("book_id", "chunk_index", F.col("messages")[1]["content"].alias("prompt"), "max_tokens")


@query("""
WITH b AS (SELECT book_id, chunk_index // 4 AS big_id, string_agg(markdown, '' ORDER BY chunk_index) AS markdown FROM @turns GROUP BY 1, 2)
SELECT book_id, big_id, '<<<SOURCE>>>' || chr(10) || markdown || chr(10) || '<<<END_SOURCE>>>' AS prompt, least(2048, greatest(2048, ceil(least(length(markdown), 4000) / 4.0 * 2.2) + 512))::BIGINT AS max_tokens FROM b
""")
def glossary_requests(get):
    guide = get("turns").select("book_id").distinct().withColumn("style_guide", F.lit("plain"))
    return requests.glossary_requests(sequences.big_chunks(get("turns")), guide).select("book_id", "big_id", F.col("messages")[1]["content"].alias("prompt"), "max_tokens")


@query(f"""
WITH s AS (SELECT book_id, count(*) AS n, 2 AS size FROM @turns GROUP BY 1), w AS ({_WINDOWS.replace("SELECT book_id,", "SELECT book_id, n,", 1)})
SELECT book_id, window_id, from_index, to_index, array_to_string(range(from_index, to_index), ', ') AS ids,
       concat_ws(' and ', CASE WHEN from_index > 0 THEN from_index - 1 END, CASE WHEN to_index < n THEN to_index END) AS neighbours, least(60, 6 + 5 * (to_index - from_index)) AS max_steps FROM w
""")
def review_requests(get):
    turns = get("turns")
    return requests.review_requests(sequences.review_windows(turns, 2), turns.groupBy("book_id").agg(F.count("*").alias("n")))


@query("""
WITH s AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system FROM @chat WHERE role = 'system' GROUP BY 1),
r AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS rest FROM @chat WHERE role IN ('user', 'assistant') GROUP BY 1)
SELECT conv_id, coalesce(concat_ws('|', 'system:' || system, rest), '') AS chat FROM (SELECT DISTINCT conv_id FROM @chat) LEFT JOIN s USING (conv_id) LEFT JOIN r USING (conv_id)
""")
def normalise_chat(get):
    out = requests.normalise_chat(get("chat"))
    return out.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("chat"))


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS text FROM conversations GROUP BY 1")
def last_user_message(get):
    return requests.last_user_message(get("conversations"))


# --- failures and events

_FAIL = """
WITH a AS (SELECT *, CASE WHEN retry_after_s > 0 THEN retry_after_s * 1000 END AS asked, coalesce(message, '') AS m, coalesce(error_name, '') AS e FROM @failures),
k AS (SELECT *, CASE WHEN status IN (401, 403) THEN 'auth,f,1' WHEN regexp_matches(m, '(?i)context length|context_length|maximum context') THEN 'context,f,1'
  WHEN status = 429 AND asked > 170000 THEN 'rate,f,1' WHEN status = 429 THEN 'rate,t,11' WHEN status >= 500 THEN 'server,t,11' WHEN status >= 400 THEN 'request,f,1'
  WHEN offline THEN 'network,t,' WHEN e = 'TimeoutError' OR regexp_matches(m, '(?i)timeout of [0-9]+ ms exceeded') THEN 'network,t,2' WHEN e = 'AbortError' THEN 'network,t,11'
  WHEN regexp_matches(m, '(?i)socket|econnreset') THEN 'network,t,11' WHEN e = 'TypeError' OR regexp_matches(m, '(?i)failed to fetch') THEN 'cors,t,11' ELSE 'unknown,f,1' END AS k FROM a),
f AS (SELECT *, split_part(k, ',', 1) AS kind, split_part(k, ',', 2) = 't' AS retryable, try_cast(split_part(k, ',', 3) AS INT) AS max_attempts FROM k)"""


@query(_FAIL + " SELECT event_id, kind, retryable, max_attempts FROM f")
def classify_failures(get):
    return failures.classify_failures(get("failures")).select("event_id", "kind", "retryable", "max_attempts")


@query(_FAIL + """, b AS (SELECT *, CASE WHEN asked IS NOT NULL THEN least(asked, 120000) END AS ra FROM f), c AS (SELECT *, CASE WHEN max_attempts IS NULL THEN NULL WHEN ra IS NULL THEN max_attempts ELSE greatest(max_attempts, ceil(170000 / ra) + 1)::INT END AS attempt_budget FROM b),
d AS (SELECT *, retryable AND (attempt_budget IS NULL OR attempt < attempt_budget) AS will_retry FROM c)
SELECT event_id, attempt_budget, will_retry, CASE WHEN will_retry THEN coalesce(ra::BIGINT, [1000, 2000, 4000, 8000, 15000, 20000, 30000, 30000, 30000, 30000][least(attempt, 10)]) END AS delay_ms FROM d""")
def retry_plan(get):
    return failures.retry_plan(failures.classify_failures(get("failures"))).select("event_id", "attempt_budget", "will_retry", "delay_ms")


@query("SELECT user_id, event_id, n_all - n + 1 AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, least(5, count(*) OVER (PARTITION BY user_id)) AS n_all FROM events) WHERE n <= 5")
def event_tail(get):
    return progress.event_tail(get("log"), 5).select(F.col("book_id").alias("user_id"), "event_id", "rn")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(get):
    return progress.event_counts(get("log")).select(F.col("book_id").alias("user_id"), F.col("key").alias("event_type"), "n")


# --- chunking


@query("SELECT doc_id, n_chars AS total_chars, true AS intact, true AS within_limit FROM documents")
def chunk_integrity(get):
    docs = get("documents")
    out = chunking.chunk_quality(chunking.chunk_documents(docs.select("doc_id", "text"), text="text"), docs, "doc_id", "text")
    return out.select("doc_id", F.col("total_chars").cast("long").alias("total_chars"), "intact", "within_limit")


@query("SELECT doc_id, length(md) AS total_chars, true AS intact, 0 AS split_fences FROM @docs_md")
def chunk_markdown(get):
    docs = get("docs_md")
    out = chunking.chunk_quality(chunking.chunk_documents(docs.select("doc_id", "md"), 1000, "md"), docs, "doc_id", "md", 1000)
    return out.select("doc_id", F.col("total_chars").cast("long").alias("total_chars"), "intact", "split_fences")


# every line a paragraph, with a heading and a fence in front; no text has a line that begins like one
BLOCKS = "'## ' || source || chr(10) || '```' || chr(10) || lang || chr(10) || '```' || chr(10) || replace(text, chr(10), chr(10) || chr(10))"


@query(rf"SELECT doc_id, unnest(range(0, len(b)))::INT AS pos, unnest(b) AS block FROM (SELECT doc_id, regexp_extract_all({BLOCKS}, '^## [^\n]*\n|```\n[^\n]*\n```\n|\n+|[^\n]+\n*') AS b FROM documents)")
def split_blocks(get):
    return chunking.split_blocks_of(get("documents").select("doc_id", F.expr(BLOCKS).alias("md")), "md").select("doc_id", "pos", "block")


# texts of letters, digits and single spaces, so that markup can be put around them
CLEAN_SQL = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _clean(get):
    # CLEAN_SQL in one pass; Java looks the class of a character up, where it tries the parts of a union one by one
    return get("documents").select("doc_id", "source", "lang", F.trim(F.regexp_replace("text", r"\P{Alnum}+", " ")).alias("t"))


@query(f"""
WITH c AS (SELECT doc_id, source, lang, {CLEAN_SQL} AS t FROM documents)
SELECT doc_id, '# ' || reverse(source) || chr(10) || reverse(t) || chr(10) || '```' || chr(10) || reverse(t) || chr(10) || '```' || chr(10) || '[' || reverse(lang) || '](u/' || lang || ')`' || lang || '`' || reverse(source) AS once, true AS back FROM c
""")
def reverse_markdown(get):
    md = "'# ' || source || chr(10) || t || chr(10) || '```' || chr(10) || t || chr(10) || '```' || chr(10) || '[' || lang || '](u/' || lang || ')`' || lang || '`' || source"
    rows = _clean(get).select("doc_id", F.expr(md).alias("md"))
    rows = rows.withColumn("once", reversing.reverse_markdown(F.col("md")))
    return rows.select("doc_id", "once", (reversing.reverse_markdown(F.col("once")) == F.col("md")).alias("back"))


# --- folds and helpers


@query("SELECT book_id, chunk_index, length(markdown) AS chars, false AS used_original FROM @turns WHERE length(trim(markdown)) > 0")
def translate_run(get):
    turns = get("turns").withColumn("window_id", F.floor(F.col("chunk_index") / 3)).withColumn("markdown", T.trim_ws(F.col("markdown")))
    out = translation.translate_windows_run(turns.where("markdown <> ''"), reversing.reversing_translator)
    return out.select("book_id", "chunk_index", F.length("translation").alias("chars"), "used_original")


@query("""
SELECT p.book_id, p.chunk_index, p.used_original AND trim(p.original) = '' AS used_original, CASE WHEN p.used_original THEN NULL ELSE p.pre_review END AS pre_review, r.book_id IS NOT NULL AND NOT p.used_original AS reviewed
FROM @pairs p LEFT JOIN @reviewed r USING (book_id, chunk_index)
""")
def retry_kept(get):
    pairs, reviewed = translation.retry_kept(get("pairs"), get("reviewed"), reversing.reversing_translator)
    seen = reviewed.withColumn("reviewed", F.lit(True))
    return pairs.join(seen, ["book_id", "chunk_index"], "left").select("book_id", "chunk_index", "used_original", "pre_review", F.coalesce("reviewed", F.lit(False)).alias("reviewed"))


def _edited(get):
    pairs = get("pairs").withColumn("reason", F.lit(None).cast("string"))
    own = get("pairs").select("book_id", "chunk_index")
    step = lambda seq, window, old, new: own.select("book_id", "chunk_index", window.cast("long").alias("window_id"), F.lit(seq).alias("seq"), F.lit(old).alias("old"), F.lit(new).alias("new"))
    at = F.floor(F.col("chunk_index") / 2)
    edits = step(1, at, "x ", "y $& ").unionByName(step(2, at, "", "z")).unionByName(step(3, at + 1, "y", "z")).unionByName(step(4, at, "no such text", "z"))
    return review.apply_edits(pairs, edits, 2)


@query("""
SELECT book_id, chunk_index, seq, CASE seq WHEN 1 THEN CASE WHEN n = 1 THEN 'ok' ELSE 'err: old matches ' || n || ' times in this chunk; make it a unique substring' END WHEN 2 THEN 'err: old is empty' WHEN 3 THEN 'err: chunk ' || chunk_index || ' is outside your range: ' || (chunk_index // 2 + 1) * 2 || ', ' || (chunk_index // 2 + 1) * 2 + 1 ELSE 'err: old was not found in this chunk' END AS result
FROM (SELECT *, (length(translation) - length(replace(translation, 'x ', ''))) // 2 AS n FROM @pairs), range(1, 5) AS r(seq)
""")
def edit_results(get):
    return _edited(get)[1].select("book_id", "chunk_index", "seq", "result")


@query("""
SELECT book_id, chunk_index, CASE WHEN single THEN 'y $& ' || original ELSE translation END AS translation, CASE WHEN single THEN coalesce(pre_review, translation) ELSE pre_review END AS pre_review, used_original AND NOT single AS used_original
FROM (SELECT *, NOT contains(original, 'x ') AS single FROM @pairs)
""")
def apply_edits(get):
    return _edited(get)[0].select("book_id", "chunk_index", "translation", "pre_review", "used_original")


@query("SELECT conv_id, turn, '-[a]+[c]= ' || text || ' -[b]+[d]' AS ops FROM conversations")
def word_diff(get):
    ops = review.word_diff(F.concat(F.lit("[a] "), "text", F.lit(" [b]")), F.concat(F.lit("[c] "), "text", F.lit(" [d]")))
    mark = lambda x: F.when(x["type"] == "eq", "=").when(x["type"] == "del", "-").otherwise("+")
    return get("conversations").select("conv_id", "turn", F.array_join(F.transform(ops, lambda x: F.concat(mark(x), x["text"])), "").alias("ops"))


TERMS = """'so {"b' || conv_id || '": " x ", "a": "' || role || '", "n": 1, "e": ""}'"""


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE 'b' || conv_id || '=x,a=' || role END AS terms FROM conversations")
def glossary_json(get):
    answer = F.expr(f"CASE turn % 3 WHEN 0 THEN {TERMS} WHEN 1 THEN '```json' || chr(10) || {TERMS} || chr(10) || '``` }}' ELSE '{{bad' END")
    rows = get("conversations").select("conv_id", "turn", glossary.parse_glossary_json(answer).alias("e"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("e", lambda x: F.concat(x["src"], F.lit("="), x["dst"])), ",").alias("terms"))


@query("SELECT conv_id AS book_id, turn AS big_id, CASE (conv_id + turn) % 3 WHEN 0 THEN 'second' WHEN 1 THEN '' ELSE 'third' END AS term FROM conversations")
def accept_extracts(get):
    answer = "CASE WHEN a = 1 AND (conv_id + turn) % 3 = 1 THEN ' {} ' WHEN a = 2 AND (conv_id + turn) % 3 = 0 THEN '{\"k\": \"second\"}' WHEN a = 3 THEN '{\"k\": \"third\"}' ELSE 'oops' END"
    rows = get("conversations").select("conv_id", "turn", F.explode(F.array(*map(F.lit, (3, 1, 2)))).alias("a"))
    out = glossary.accept_extracts(rows.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("big_id"), F.col("a").alias("attempt"), F.expr(answer).alias("response")))
    return out.select("book_id", "big_id", F.array_join(F.transform("entries", lambda x: x["dst"]), ",").alias("term"))


RECORD = """'{"version":' || CASE WHEN (conv_id + turn) % 9 = 1 THEN '1' ELSE '2' END || ',"fileName":"a","fileBytes":"AA==","title":"t","format":"' || CASE WHEN (conv_id + turn) % 9 = 2 THEN 'pdf' ELSE 'epub' END
 || '","chunks":[{"index":0,"documentPath":"p","chapterTitle":"c","markdown":"m"' || CASE (conv_id + turn) % 9 WHEN 3 THEN ',"joinWith":"tab"' WHEN 4 THEN ',"joinWith":"line"' ELSE '' END
 || '}],"styleGuide":' || CASE WHEN (conv_id + turn) % 9 = 5 THEN '3' ELSE '"g"' END || ',"translated":[{"index":0,"original":"o"' || CASE WHEN (conv_id + turn) % 9 = 6 THEN '' ELSE ',"translation":"x"' END || '}],"index":1,"more":[]' || CASE WHEN (conv_id + turn) % 9 = 7 THEN '' ELSE '}' END"""


@query("SELECT conv_id, turn, (conv_id + turn) % 9 IN (0, 4, 8) AS is_valid FROM conversations")
def valid_checkpoints(get):
    rows = get("conversations").select("conv_id", "turn", F.expr(RECORD).alias("record"))
    return records.valid_checkpoints(rows).select("conv_id", "turn", "is_valid")


# --- pages and images


@query("SELECT page_id, regexp_matches(html, '<h1>') AS has_head, true AS no_script, true AS no_style FROM pages")
def page_markdown(get):
    out = books.html_to_markdown(get("pages"))
    return out.select("page_id", out.markdown.rlike("(?m)^# ").alias("has_head"), (~F.contains("markdown", F.lit("track("))).alias("no_script"), (~F.contains("markdown", F.lit("margin:0"))).alias("no_style"))


@query(f"""
WITH c AS (SELECT doc_id, source, lang, {CLEAN_SQL} AS t FROM documents)
SELECT doc_id, '## ' || source || chr(10) || chr(10) || CASE WHEN t = '' THEN '' ELSE t || ' ' END || '*' || lang || '* [r](https://e.example/' || doc_id || ')' || chr(10) || chr(10) || '- one' || chr(10) || '- **two**' || chr(10) || '  - in' || chr(10) || chr(10)
  || '1. ' || lang || chr(10) || chr(10) || '> quoted' || chr(10) || '>' || chr(10) || '> more' || chr(10) || chr(10) || '| a | b \\| c |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || source || ' |' || chr(10) || chr(10) || '```' || chr(10) || 'x  y' || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '![p](i.png)' || chr(10) AS markdown
FROM c
""")
def html_markdown(get):
    html = "'<html><head><title>x</title><style>p {}</style></head><body><h2>' || source || '</h2><script>no()</script><p>' || t || ' <em>' || lang || '</em> <a href=\"https://e.example/' || doc_id || '\">r</a></p><ul><li>one</li><li><b>two</b></li><ul><li>in</li></ul></ul><ol><li>' || lang || '</li></ol><blockquote><p>quoted</p><p>more</p></blockquote><table><tr><th>a</th><th>b | c</th></tr><tr><td>1</td><td>' || source || '</td></tr></table><pre>x  y</pre><hr><img src=\"i.png\" alt=\"p\"></body></html>'"
    return books.html_to_markdown(_clean(get).select("doc_id", F.expr(html).alias("html"))).select("doc_id", "markdown")


@query(f"""
SELECT doc_id, '<h2>' || source || '</h2>' || chr(10) || '<p>' || {CLEAN_SQL} || ' <em>' || lang || '</em> <strong>a &amp; b</strong><br/>' || chr(10) || '<a href="u/' || doc_id || '">r</a> <code>x &lt; y</code></p>' || chr(10) || '<ul>' || chr(10) || '<li><p>one</p></li>' || chr(10) || '<li><p>two</p></li>' || chr(10) || '</ul>' || chr(10) || '<blockquote><p>quoted</p></blockquote>' || chr(10) || '<hr/>' || chr(10) || '<pre><code>*a*</code></pre>' || chr(10) || '<p><img alt="p" src="images/i.png"/></p>' AS xhtml FROM documents
""")
def xhtml_text(get):
    md = "'## ' || source || chr(10) || chr(10) || t || ' *' || lang || '* **a & b**' || chr(10) || '[r](u/' || doc_id || ') `x < y`' || chr(10) || chr(10) || '* one' || chr(10) || '* two' || chr(10) || chr(10) || '> quoted' || chr(10) || chr(10) || '---' || chr(10) || '```' || chr(10) || '*a*' || chr(10) || '```' || chr(10) || '![p](img/i.png)'"
    return _clean(get).select("doc_id", xhtml.markdown_to_xhtml(F.expr(md)).alias("xhtml"))


def _books(get):
    """Books of two chapters and two images, packed and as files again."""
    rows = _clean(get).select(F.col("doc_id").alias("book_id"), F.expr("'b' || doc_id || '.fb2'").alias("file_name"), F.col("source").alias("title"), F.expr("'# A ' || lang || chr(10) || chr(10) || 'w ' || t || chr(10) || chr(10) || '## B' || chr(10) || chr(10) || 'end'").alias("markdown"))
    images = rows.select("book_id", F.explode(F.array(*(F.struct(F.lit(f"images/{n}").alias("href"), F.lit("image/png").alias("mime_type"), F.encode(F.concat(F.lit(n), F.col("book_id").cast("string")), "UTF-8").alias("bytes")) for n in ("a.png", "b c.png")))).alias("x")).select("book_id", "x.*")
    return packing.pack_books(rows, images, "de").select(F.col("book_id").cast("string").alias("book_id"), "file_name", F.col("epub").alias("content"))


@query(f"""
SELECT doc_id, 0 AS piece_pos, 'b' || doc_id || '.de.epub' AS file_name, 'A ' || lang AS chapter_title, '# A ' || lang || chr(10) || chr(10) || trim('w ' || {CLEAN_SQL}) || chr(10) AS markdown FROM documents
UNION ALL SELECT doc_id, 1, 'b' || doc_id || '.de.epub', 'B', '## B' || chr(10) || chr(10) || 'end' || chr(10) FROM documents
""")
def book_sections(get):
    out = books.extract_sections(_books(get))
    return out.select(F.col("book_id").cast("long").alias("doc_id"), "piece_pos", "file_name", "chapter_title", "markdown")


@query("""
SELECT doc_id, 'OEBPS/images/' || n AS source_path, 'images/' || replace(n, ' ', '_') AS href, 'image/png' AS mime_type, n || doc_id AS content FROM documents, (VALUES ('a.png'), ('b c.png')) AS v(n)
""")
def book_images(get):
    out = books.extract_images(_books(get))
    return out.select(F.col("book_id").cast("long").alias("doc_id"), "source_path", "href", "mime_type", F.decode("bytes", "UTF-8").alias("content"))


@query("SELECT conv_id, turn, role, text, 'part' AS file FROM conversations")
def request_files(get):
    """Requests written as JSON lines, the files read as any book is, and their lines parsed."""
    rows = get("conversations").select("conv_id", "turn", "role", "text")
    path = jobs.shared_path(rows.sparkSession, "requests")
    packing.write_requests(rows, path)
    files = books.read_books(rows.sparkSession, path).where(F.col("file_name").startswith("part-"))
    lines = files.select(F.substring("file_name", 1, 4).alias("file"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", rows.schema).alias("x"), "file").select("x.*", "file")


@query("""
SELECT source AS book_id, 'plain' AS style_guide, string_agg('s' || doc_id || '=' || lang, ',' ORDER BY doc_id) AS terms FROM documents GROUP BY source
""")
def brief_files(get):
    docs = get("documents").withColumnRenamed("source", "book_id")
    path = jobs.shared_path(docs.sparkSession, "brief")
    packing.export_brief(docs.select("book_id", F.lit("plain").alias("style_guide")).distinct(), docs.select("book_id", F.col("doc_id").alias("ord"), F.expr("'s' || doc_id").alias("src"), F.col("lang").alias("dst")), path)
    read = docs.sparkSession.read.schema("book_id string, style_guide string, glossary array<struct<src string, dst string>>").json(path)
    return read.select("book_id", "style_guide", F.array_join(F.transform("glossary", lambda x: F.concat(x["src"], F.lit("="), x["dst"])), ",").alias("terms"))


REF = "CASE page_id % 6 WHEN 0 THEN '#art/c%20' || page_id || '.png' WHEN 1 THEN '/art/c ' || page_id || '.png' WHEN 2 THEN 'other/c%20' || page_id || '.png' WHEN 3 THEN 'c%zz.png' WHEN 4 THEN '' ELSE 'art/c ' || page_id || '.png' END"


@query(f"SELECT page_id, {REF} AS href, CASE WHEN page_id % 6 IN (0, 1, 2, 5) THEN 'images/i' || page_id || '.png' END AS packed FROM pages")
def resolve_image_refs(get):
    images = get("pages").select((F.col("page_id") % 7).alias("book_id"), F.expr("'art/c ' || page_id || '.png'").alias("source_path"), F.expr("'images/i' || page_id || '.png'").alias("href"))
    links = get("pages").select("page_id", (F.col("page_id") % 7).alias("book_id"), F.expr(REF).alias("href"))
    return books.resolve_image_refs(links, images).select("page_id", "href", "packed")


@query("""
WITH i AS (SELECT page_id % 5 AS book_id, 'images/i' || page_id || '.png' AS href FROM pages),
r AS (SELECT DISTINCT page_id % 5 AS book_id, 'images/i' || page_id || '.png' AS href FROM pages WHERE page_id % 5 < 3 AND page_id % 4 = 0)
SELECT book_id, href FROM i WHERE (book_id, href) IN (SELECT (book_id, href) FROM r) OR book_id NOT IN (SELECT book_id FROM r)
""")
def used_images(get):
    own = get("pages").withColumn("book_id", F.col("page_id") % 5)
    images = own.select("book_id", F.expr("'images/i' || page_id || '.png'").alias("href"))
    texts = own.where("book_id < 3 and page_id % 4 = 0").select("book_id", F.expr("'see ![a](x/i' || page_id || '.png) there'").alias("markdown"))
    return books.used_images(texts, images).select("book_id", "href")


@query(f"""
WITH c AS (SELECT doc_id, source, lang, {CLEAN_SQL} AS t FROM documents),
e AS (SELECT doc_id, 'OEBPS/chapter-001.xhtml' AS entry, '<h1>A ' || lang || '</h1>' || chr(10) || '<p>' || trim('w ' || t) || '</p>' AS body FROM c
UNION ALL SELECT doc_id, 'OEBPS/chapter-002.xhtml', '<h2>B</h2>' || chr(10) || '<p>end</p>' FROM c UNION ALL SELECT doc_id, 'OEBPS/images/a.png', 'picture ' || doc_id FROM c
UNION ALL SELECT doc_id, n, NULL FROM c, (VALUES ('mimetype'), ('META-INF/container.xml'), ('OEBPS/nav.xhtml'), ('OEBPS/book.css'), ('OEBPS/content.opf')) AS v(n))
SELECT doc_id, 'b' || doc_id || '.de.epub' AS file_name, entry, body, true AS same_size FROM e
""")
def pack_books(get):
    """All books written as files, these read by their paths, and what is in their entries."""
    docs = _clean(get)
    rows = docs.select(F.col("doc_id").alias("book_id"), F.expr("'b' || doc_id || '.fb2'").alias("file_name"), F.col("source").alias("title"), F.expr("'# A ' || lang || chr(10) || chr(10) || 'w ' || t || chr(10) || '## B' || chr(10) || 'end'").alias("markdown"))
    images = rows.select("book_id", F.lit("images/a.png").alias("href"), F.lit("image/png").alias("mime_type"), F.encode(F.expr("'picture ' || book_id"), "UTF-8").alias("bytes"))
    path = jobs.shared_path(docs.sparkSession, "books")
    written = jobs.table_of(packing.write_books(rows, images, "de", path, style="p { margin: 0 }"), "written")
    files = written.select(F.col("book_id").alias("doc_id"), "file_name", F.explode("entries").alias("e"))
    body = F.when(F.col("entry").endswith(".png"), F.col("text")).when(F.col("entry").contains("/chapter-"), F.regexp_extract("text", r"(?s)<body>\n(.*)\n</body>", 1))
    entries = books.entry_texts(books.read_listed(written)).select(F.col("book_id").cast("long").alias("_book"), "entry", "size", body.alias("body"))
    both = files.join(entries, (F.col("doc_id") == F.col("_book")) & (F.col("e.name") == F.col("entry")))
    return both.select("doc_id", "file_name", "entry", "body", (F.col("size") == F.col("e.size")).alias("same_size"))


@query("SELECT doc_id, true AS head, true AS picture, true AS link FROM @docs_md")
def markdown_to_xhtml(get):
    out = get("docs_md").select("doc_id", xhtml.markdown_to_xhtml(F.col("md")).alias("x"))
    has = lambda s: F.contains("x", F.lit(s))
    return out.select("doc_id", has("<h1>Title ").alias("head"), has('<img alt="pic" src="images/').alias("picture"), has('<a href="a_(b).html">rel</a> <em>em</em> <code>code</code>').alias("link"))


# --- streams: the tables' files, worked off


@query("SELECT doc_id, n_chars AS total_chars, true AS intact FROM documents")
def stream_chunks(get):
    docs = get("documents")
    source = docs.sparkSession.readStream.schema(docs.schema).parquet(get("documents.path"))
    chunks = jobs.work_off(jobs.stream_chunks(source.select("doc_id", "text"), 5000, "text"), "chunks")
    out = chunking.chunk_quality(chunks, docs, "doc_id", "text")
    return out.select("doc_id", F.col("total_chars").cast("long").alias("total_chars"), "intact")


@query("SELECT conv_id AS book_id, turn AS chunk_index, CASE WHEN turn % 3 = 1 THEN text ELSE 'x ' || text END AS translation, turn % 3 = 1 AS used_original FROM conversations WHERE length(trim(text)) > 0 AND turn % 3 < 2 AND NOT regexp_matches(text, '(?i)as an ai')")
def stream_commit(get):
    turns = get("conversations")
    spark = turns.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STORE)
    source = spark.readStream.schema(turns.schema).parquet(get("conversations.path")).where("length(trim(text)) > 0 and not text rlike '(?i)as an ai'")
    answer = F.when(F.col("turn") % 3 == 1, "").when(F.col("turn") % 3 == 2, F.lit(None)).when(F.col("a") == 2, F.concat(F.lit("x "), "text")).otherwise("<<<SOURCE>>>")
    tries = source.select("conv_id", "turn", "text", F.explode(F.array(*map(F.lit, (3, 2, 1)))).alias("a")).where("a = 2 or turn % 3 < 2")
    attempts = tries.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chunk_index"), F.col("a").alias("attempt"), answer.alias("response"), F.col("text").alias("original"))
    return jobs.work_off(jobs.stream_commit(attempts), "pairs").select("book_id", "chunk_index", "translation", "used_original")


@query("SELECT conv_id AS book_id, count(*) AS done, sum((turn % 5 = 0)::INT) AS kept FROM conversations GROUP BY 1")
def stream_progress(get):
    turns = get("conversations")
    source = turns.sparkSession.readStream.schema(turns.schema).parquet(get("conversations.path"))
    # every pair is delivered twice
    pairs = source.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chunk_index"), (F.col("turn") % 5 == 0).alias("used_original"), F.explode(F.array(F.lit(1), F.lit(2))).alias("_")).drop("_")
    path = jobs.shared_path(turns.sparkSession, "progress")
    jobs.merge_progress(pairs, path)
    return jobs.read_progress(turns.sparkSession, path, turns.schema["conv_id"].dataType.simpleString())


@query(f"""
WITH c AS (SELECT doc_id, {CLEAN_SQL} AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(range(200, 601), lambda p: substr(t, p, 1) = ' ') AS near, list_filter(range(1, 401), lambda p: substr(t, p, 1) = ' ') AS ahead FROM c)
SELECT doc_id, CASE WHEN length(t) <= 400 THEN length(t) WHEN len(near) > 0 THEN list_min(list_transform(near, lambda p: abs(p - 400) * 10000 + p)) % 10000 ELSE coalesce(list_max(ahead), 400) END::INT AS cut FROM w
""")
def best_cut(get):
    return _clean(get).select("doc_id", chunking.best_cut(F.col("t"), F.lit(0), 400).alias("cut"))


@query("SELECT page_id, html AS text FROM pages")
def decode_xml(get):
    bom = F.when(F.col("page_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")))
    return get("pages").select("page_id", books.decode_xml_of(bom).alias("text"))
