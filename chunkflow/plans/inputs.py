"""Inputs of the registered queries, derived from the given tables.

Each is SQL that Spark and DuckDB both read; markdown features that the tables lack are
added by the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
#: documents with a heading, an image, two links, marks and a list in front.
DOC_MD = f"""'# Title ' || source || {NL} || {NL} || '![pic](img/' || source || '.png) see [ref](https://x.example/' || cast(doc_id AS string) || ') and [rel](a_(b).html) *em* `code`' || {NL} || '- item' || {NL} || '2. two' || {NL} || text"""

INPUTS = {
    "docs_md": f"SELECT doc_id, source, lang, text, {DOC_MD} AS md FROM documents",
    # a conversation is a book, a turn a chunk
    "turns": """SELECT conv_id AS book_id, cast(turn AS int) AS chunk_index, text AS markdown, role,
        'T' || cast(cast(floor(turn / 3) AS int) AS string) AS chapter_title, 'p' || cast(cast(floor(turn / 6) AS int) AS string) AS document_path,
        CASE WHEN turn % 3 = 1 THEN 'space' WHEN turn % 3 = 2 THEN 'line' END AS join_with FROM conversations""",
    # a source is a book, a document a chunk
    # numbered by ranks in blocks of ids and the counts of the blocks before; no join back to the texts
    "sourced": """SELECT d.source AS book_id, cast(d.at + coalesce(b.before, 0) AS int) AS chunk_index, d.text AS markdown, d.lang AS chapter_title, 'd' AS document_path, d.doc_id, d.lang
        FROM (SELECT doc_id, source, lang, text, cast(floor(doc_id / 4096) AS bigint) AS blk, row_number() OVER (PARTITION BY source, cast(floor(doc_id / 4096) AS bigint) ORDER BY doc_id) - 1 AS at FROM documents AS x) AS d
        JOIN (SELECT source, blk, sum(n) OVER (PARTITION BY source ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM (SELECT source, cast(floor(doc_id / 4096) AS bigint) AS blk, count(*) AS n FROM documents AS y GROUP BY source, cast(floor(doc_id / 4096) AS bigint)) AS z) AS b ON d.source = b.source AND d.blk = b.blk""",
    # translations with holes: no pair for every third turn
    "pairs": """SELECT conv_id AS book_id, cast(turn AS int) AS chunk_index, text AS original, 'x ' || text AS translation,
        turn % 5 = 0 AS used_original, CASE WHEN turn % 2 = 1 THEN 'old ' || text END AS pre_review, cast(conv_id % 7 * 100 + turn AS bigint) AS ms
        FROM conversations WHERE turn % 3 <> 1""",
    "reviewed": "SELECT conv_id AS book_id, cast(turn AS int) AS chunk_index FROM conversations WHERE (conv_id + turn) % 4 <> 0 OR conv_id % 3 = 0",
    # every turn with an answer, changed so that every rule is met
    "answers": f"""SELECT book_id, chunk_index, CASE book_id % 8 WHEN 5 THEN original || ' ![a](img/x.png)' WHEN 6 THEN original || ' [a](https://e.example/(x)/y)' WHEN 7 THEN original || ' [a](plain)' ELSE original END AS original,
        CASE book_id % 8 WHEN 0 THEN ' ' || {NL} WHEN 1 THEN 'shrt' WHEN 2 THEN repeat(original || ' ', 10) WHEN 3 THEN 'As an AI I will not. ' || original WHEN 4 THEN original || '<<<END_SOURCE>>>' ELSE original END AS translation
        FROM (SELECT conv_id AS book_id, cast(turn AS int) AS chunk_index, text AS original FROM conversations) AS u""",
    # three answers for each turn
    "attempts": """SELECT conv_id AS book_id, cast(turn AS int) AS chunk_index, a AS attempt, cast(100 * a AS bigint) AS ms,
        CASE WHEN conv_id % 4 = 0 AND a < 3 THEN '' WHEN conv_id % 4 = 1 THEN 'as an ai, no' WHEN conv_id % 4 = 2 AND a = 1 THEN '<<<SOURCE>>>' ELSE '<<<TRANSLATION>>>' || chr(10) || text || chr(10) || '<<<END_TRANSLATION>>>' END AS response
        FROM conversations CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 3) AS t WHERE a < 3 OR conv_id % 5 > 0""",
    "settings": "SELECT source AS book_id, min(lang) AS target_lang, 2 AS concurrency, 4 AS glossary_batch, 5 AS review_batch, CASE WHEN source = 'src1' THEN 'open' ELSE 'paid' END AS provider_id, CASE WHEN source = 'src2' THEN 'm:free' ELSE 'm-' || min(lang) END AS model FROM documents GROUP BY source",
    "prices": "SELECT 'm-' || lang AS model_id, min(doc_id) AS ord, cast(0.25 AS double) AS input_per_million, cast(count(*) AS double) AS output_per_million FROM documents WHERE lang <> 'es' GROUP BY lang",
    "log": "SELECT user_id AS book_id, event_id, ts, event_type AS key, value FROM events",
    "failures": """SELECT event_id, CASE event_id % 11 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN 400 WHEN 10 THEN 429 END AS status,
        CASE event_id % 11 WHEN 4 THEN 'the maximum context is 9 tokens' WHEN 5 THEN 'Timeout of 9000 ms exceeded' WHEN 6 THEN 'Failed to fetch' WHEN 7 THEN 'socket hang up' WHEN 8 THEN 'no 503 here' ELSE event_type END AS message,
        CASE WHEN event_id % 13 = 0 THEN 'AbortError' WHEN event_id % 13 = 1 THEN 'TypeError' END AS error_name,
        CASE WHEN event_id % 11 = 10 THEN cast(event_id % 400 AS double) WHEN event_id % 5 = 0 THEN cast(2.0 AS double) END AS retry_after_s,
        event_id % 17 = 0 AS offline, cast(event_id % 12 + 1 AS int) AS attempt FROM events""",
    "chat": "SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'system' WHEN turn = 4 THEN 'tool' ELSE role END AS role, text FROM conversations",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | str:
    """A table of the folder, or an input derived from one; name.path gives a table's path."""
    if name.endswith(".path"):
        return f"{sf_dir}/{name.removesuffix('.path')}.parque[t]"  # as a pattern it may be a file or a folder
    if name not in INPUTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    query = INPUTS[name]
    held = {}
    for t in ("documents", "conversations", "events"):
        if f" {t}" in query:
            held[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            query = query.replace(f" {t}", f" {{{t}}}")
    return spark.sql(query, **held)


def with_inputs(sql: str) -> str:
    """DuckDB SQL with the inputs that it names as leading CTEs."""
    used = [k for k in INPUTS if f"@{k}" in sql]
    for k in sorted(used, key=len, reverse=True):
        sql = sql.replace(f"@{k}", f"in_{k}")
    body = sql.strip()
    ctes = ", ".join(f"in_{k} AS ({INPUTS[k]})" for k in used)
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
