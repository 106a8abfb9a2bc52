"""URL filters: pattern rules indexed by their rarest literal token (operator 2).

A rule is a pattern over host + path. ``||`` stands for the start of the host or of one of
its labels, ``^`` for a separator (anything but a letter or digit, or either end), ``*`` for
anything; the rest is literal. A pattern after ``@@`` is an exception: it allows what other
patterns of the method block. Letter and digit runs that must be whole tokens of a
matching URL index a rule, of these the one that the fewest URLs hold. A rule without such a token is
indexed by the rarest run of three characters of its literal parts, which URLs are cut into only if there are such rules.

Null URLs and URLs without ``://`` have an empty host and path. Rules without three literal
characters in a row are candidates for every URL. Equal rules count once; of the listed rules that fit, the longest
wins, then the last in string order. Repeated rows come back each, very long URLs whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query: (action, host + path).
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: What the method blocks where no such rule fits: these words anywhere, offers in host labels and paths.
ANYWHERE = ["spam", "ads", "adult", "casino", "porn", "track"]
OFFERS = ["cheap", "free", "best", "buy", "online", "instant", "discount", "win"]
GOODS = ["pills", "bets", "loans", "replica", "watches", "viagra", "poker", "slots", "lottery", "jackpot"]
#: Hosts whose pages are about such things.
ABOUT = ["help", "docs", "research"]
#: Rules up to so many, of so many characters together, are broadcast; more meet the tokens in salted joins.
MOST_RULES, MOST_CHARS, SALTS = 200_000, 16 << 20, 16
#: Before the three characters of an index entry; no token of a URL holds it.
GRAM = " "


def patterns() -> list[str]:
    """The method's patterns, several hundred, by rule from the words above."""
    out = [f"^{w}^" for w in ANYWHERE]
    for g in GOODS:
        for o in OFFERS:
            out += [f"||{o}-{g}.", f"||{g}.{o}.", f"/{o}/{g}^", f"/{g}/*^{o}^"]
    return out + [f"@@||{a}.*/{w}^" for a in ABOUT for w in ANYWHERE + GOODS]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def compile_pattern(pattern: str, ignore_case: bool = False) -> tuple[str, list[str]]:
    """(regular expression, tokens that any match holds whole, or else runs of three characters marked GRAM)."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    parts = {"^": "(?:[^A-Za-z0-9]|^|$)", "*": "(?s:.*)"}
    rx = "".join(parts.get(c) or re.sub(r"([\\.\[\]{}()+?|$^-])", r"\\\1", c) for c in body)
    rx = ("(?i)" if ignore_case else "") + ("^(?:[^/]*\\.)?" if anchored else "") + rx
    tokens = []
    for m in re.finditer("[A-Za-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else "." if anchored else "*"
        after = body[m.end()] if m.end() < len(body) else "*"
        if "*" not in (before, after) and before.isascii() and after.isascii():
            tokens.append(m[0].lower())
    if not tokens:
        literals = re.split(r"[*^]", body.translate(str.maketrans(UPPER, LOWER)))
        tokens = [GRAM + x[k : k + 3] for x in literals for k in range(len(x) - 2)]
    return rx, sorted(set(tokens))


def rules_table(spark: SparkSession, host_rules: list[tuple[str, str]], patterns: list[str]) -> DataFrame:
    """(rule, action, rx, tokens, listed): listed rules come before the method's patterns."""
    rows = [(r, a, *compile_pattern("||" + r), True) for a, r in host_rules]
    rows += [(p, "allow" if p.startswith("@@") else "block", *compile_pattern(p.removeprefix("@@"), True), False) for p in patterns]
    return spark.createDataFrame(rows, "rule string, action string, rx string, tokens array<string>, listed boolean").distinct()


def rules_of(patterns: DataFrame) -> DataFrame:
    """The rules of a table (pattern, action), as the method's: for rules_table().unionByName() or by themselves.

    The pattern of an exception begins with ``@@`` and allows, whatever its action; another action than
    block or allow is an error, null or empty patterns are left out, repeated rows count once.
    """

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, "allow" if p.startswith("@@") else a, *compile_pattern(p.removeprefix("@@"), True), False) for p, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if bad := {a for _, a, *_ in rows} - {"block", "allow"}:
                raise ValueError(f"actions {sorted(map(str, bad))}; block and allow are known")
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rule", "action", "rx", "tokens", "listed"])

    rows = patterns.where("pattern <> ''").select("pattern", "action").distinct()
    return rows.mapInArrow(compiled, "rule string, action string, rx string, tokens array<string>, listed boolean").distinct()


def candidates(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, key, rule, action, rx, listed): each URL with the rules whose rarest token it holds."""
    small, grams = _shape(rules)
    lower = ascii_lower(F.col("key"))
    words = F.array_union(F.array(F.lit("")), F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)))
    if grams:
        cut = F.transform(F.sequence(F.lit(1), F.length(lower) - 2), lambda k: F.concat(F.lit(GRAM), F.substring(lower, k, F.lit(3))))
        words = F.when(F.length(lower) > 2, F.array_union(words, cut)).otherwise(words)
    tokens = urls.select("url", "key", F.explode(words).alias("token"))
    literals = rules.select("rule", "action", "rx", "listed", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    seen = tokens.join(F.broadcast(literals.select("token").distinct()) if small else literals.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    index = literals.join(seen, "token", "left").groupBy("rule", "action", "rx", "listed")
    index = index.agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    if small:
        return tokens.join(F.broadcast(index), "token").drop("token")
    # a token that many URLs hold is spread over SALTS keys
    tokens = tokens.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return tokens.join(index, ["token", "salt"]).drop("token", "salt")


def _shape(rules: DataFrame) -> tuple[bool, bool]:
    """Whether the rules are few enough to be broadcast, and whether some are indexed by runs of three characters."""
    gram = F.exists("tokens", lambda t: t.startswith(GRAM))
    n, chars, grams = rules.agg(F.count("*"), F.sum(F.length("rx")), F.max(gram)).first()
    return n <= MOST_RULES and (chars or 0) <= MOST_CHARS, bool(grams)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added; every row of pages comes back once.

    Only the URL column is tokenised and shuffled. Columns of pages that are called host,
    path, rule or verdict are replaced.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("key", F.concat(host, path))
    fits = candidates(urls, rules).where(F.expr("regexp(key, rx)"))
    order = F.struct(F.length("rule"), "rule", "action")
    best = fits.groupBy(F.col("url").alias("__cf_url")).agg(
        F.max_by("rule", F.when(F.col("listed"), order)).alias("__cf_rule"),
        F.max_by("action", F.when(F.col("listed"), order)).alias("__cf_action"),
        F.min(F.when(~F.col("listed"), F.col("action"))).alias("__cf_own"),  # an exception comes before a block
    )
    host, path = url_parts(F.col(url))
    out = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    out = out.join(best, F.col(url) == F.col("__cf_url"), "left").drop("__cf_url")
    return out.withColumns({"rule": F.col("__cf_rule"), "verdict": F.coalesce("__cf_action", "__cf_own", F.lit(default))}).drop("__cf_rule", "__cf_action", "__cf_own")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = judge_urls(pages, rules_table(spark, HOST_RULES, patterns()))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rule, action, h, pre) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
         ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), m AS (
  SELECT q.page_id, q.host, q.path,
         (SELECT max_by(struct_pack(rule := rule, action := action), length(rule)) FROM r
          WHERE (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, pre)) AS hit
  FROM q
)
SELECT page_id, host, path, hit.rule AS rule,
       coalesce(hit.action, CASE
         WHEN regexp_matches(u, '(?i)^([^/]*[.])?({about})[.](.|\n)*/({anywhere}|{goods})([^a-z0-9]|$)') THEN 'allow'
         WHEN regexp_matches(u, '(?i)(^|[^a-z0-9])({anywhere})([^a-z0-9]|$)') THEN 'block'
         WHEN regexp_matches(u, '(?i)^([^/]*[.])?(({offers})-({goods})|({goods})[.]({offers}))[.]') THEN 'block'
         WHEN regexp_matches(u, '(?i)/({offers})/({goods})([^a-z0-9]|$)|/({goods})/((.|\n)*[^a-z0-9])?({offers})([^a-z0-9]|$)') THEN 'block'
         ELSE 'allow' END) AS verdict
FROM (SELECT *, host || path AS u FROM m)
""".replace("{anywhere}", "|".join(ANYWHERE)).replace("{offers}", "|".join(OFFERS)).replace("{goods}", "|".join(GOODS)).replace("{about}", "|".join(ABOUT))
