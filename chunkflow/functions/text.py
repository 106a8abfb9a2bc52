"""Column functions on markdown and model answers, built from Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a set of code points, the same in every operator.
WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = WS.replace("[", "[^", 1)
#: A link target. Possessive, so that Java steps through its groups in a loop: what follows a target
#: is never part of it, and the depth of a match doesn't grow with the text.
_URL = rf"(?:{NOT_WS.replace('[^', '[^()')}*+(?:\([^()]*+\)[^()]*+)*+)"
IMAGE = rf"!\[([^\]]*)\]\(({_URL})\)"
LINK = rf"(?<!!)\[([^\]]*)\]\(({_URL})\)"
MARKERS = r"(?i)<<<(?:END_)?(?:TRANSLATION|SOURCE|GLOSSARY)>>>"

#: Languages by script, and those whose text packs two characters a token.
CYRILLIC_LANGS = ["ru", "uk", "be", "bg", "mk", "sr", "kk", "ky", "tg", "mn"]
CJK_LANGS = ["zh", "ja", "ko"]
LATIN_LANGS = ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "cs", "sk", "sv", "da", "no", "fi", "hu", "ro", "tr", "id", "vi", "lt", "lv", "et"]
DENSE_LANGS = ["ru", "uk", "be", "bg", "sr", "mk", "zh", "ja", "ko"]
DENSE = r"[\x{400}-\x{4FF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def trim_ws(c: Column) -> Column:
    return replace(c, rf"\A{WS}+|{WS}+\z")


def plain_text(c: Column) -> Column:
    """Markdown as visible text on one line."""
    for pattern, by in [
        (r"```[\s\S]*?```", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (rf"(?m)^#{{1,6}}{WS}+", ""),
        (rf"(?m)^[>*+-]{WS}+", ""),
        (rf"(?m)^[0-9]+\.{WS}+", ""),
        (r"[`*_~]", ""),
        (rf"{WS}+", " "),
    ]:
        c = replace(c, pattern, by)
    return trim_ws(c)


def _targets(c: Column, pattern: str) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), trim_ws)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def image_srcs(c: Column) -> Column:
    """Distinct image targets, in the order they are first seen."""
    return _targets(c, IMAGE)


def link_hrefs(c: Column) -> Column:
    """Distinct link targets, in the order they are first seen; images don't count."""
    return _targets(c, LINK)


def safe_href(c: Column) -> Column:
    """The href without control characters and spaces if it is harmless, else null."""
    bare = replace(c, r"[\x00-\x20\x7F]")
    scheme = F.lower(F.regexp_extract(bare, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(bare == "", None)
        .when(bare.startswith("//"), None)
        .when(scheme == "", bare)
        .when(scheme.isin("http", "https", "mailto"), bare)
    )


def extract_tagged(c: Column, tag: str) -> Column:
    """Trimmed text between <<<TAG>>> and <<<END_TAG>>>, null without them."""
    pattern = rf"(?is)<<<{tag}>>>{WS}*(.*?){WS}*<<<END_{tag}>>>"
    return F.when(c.rlike(pattern), trim_ws(F.regexp_extract(c, pattern, 1)))


def strip_harness(c: Column) -> Column:
    """An answer without the markers that it was asked to stand in."""
    s = trim_ws(replace(c, r"\A\x{FEFF}"))
    s = F.coalesce(extract_tagged(s, "TRANSLATION"), s)
    s = replace(s, rf"(?i)\A{WS}*<<<TRANSLATION>>>{WS}*")
    s = replace(s, rf"(?i){WS}*<<<END_TRANSLATION>>>{WS}*\z")
    return trim_ws(replace(s, MARKERS))


def strip_fence(c: Column) -> Column:
    """An answer without a code fence around it; each end is looked at by itself."""
    return trim_ws(replace(replace(c, r"(?i)\A```(?:markdown|md|xml|html)?\n?"), r"\n?```\z"))


def parse_response(c: Column) -> Column:
    return strip_harness(strip_fence(c))


def strip_xml_illegal(c: Column) -> Column:
    return replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]")


def escape_xml(c: Column) -> Column:
    c = strip_xml_illegal(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def script_counts(c: Column) -> Column:
    """Struct of the letters in three scripts."""
    return F.struct(
        F.regexp_count(c, F.lit(r"[\x{400}-\x{4FF}]")).alias("cyrillic"),
        F.regexp_count(c, F.lit("[A-Za-z]")).alias("latin"),
        F.regexp_count(c, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]")).alias("cjk"),
    )


def mostly_script(counts: Column, script: Column) -> Column:
    """Whether over 0.7 of at least 8 letters are of the script, from script_counts()."""
    total = counts["cyrillic"] + counts["latin"] + counts["cjk"]
    n = F.when(script == "cyrillic", counts["cyrillic"]).when(script == "latin", counts["latin"]).when(script == "cjk", counts["cjk"])
    return F.coalesce((total >= 8) & (n / F.nullif(total, F.lit(0)) > 0.7), F.lit(False))


def is_mostly_script(c: Column, script: Column) -> Column:
    return mostly_script(script_counts(c), script)


def language_prefix(c: Column) -> Column:
    """ru-RU -> ru."""
    return F.get(F.split(F.lower(trim_ws(c)), "[-_]"), F.lit(0))


def script_for_lang(c: Column) -> Column:
    p = language_prefix(c)
    return F.when(p.isin(CYRILLIC_LANGS), "cyrillic").when(p.isin(CJK_LANGS), "cjk").when(p.isin(LATIN_LANGS), "latin").otherwise("other")


def tokens(chars: Column, dense: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / F.when(dense, 2.0).otherwise(4.0))).cast("long")


def tokens_for_chars(chars: Column, sample: Column) -> Column:
    """Estimated tokens of so many characters in the sample's script."""
    return tokens(chars, F.coalesce(sample.rlike(DENSE), F.lit(False)))


def tokens_for_lang(chars: Column, lang: Column) -> Column:
    return tokens(chars, F.get(F.split(F.lower(lang), "-"), F.lit(0)).isin(DENSE_LANGS))


def output_token_budget(chars: Column) -> Column:
    return F.least(F.lit(32768), F.greatest(F.lit(2048), F.ceil(chars / 4.0 * 2.2) + 512)).cast("long")


def nav_title(title: Column, body: Column) -> Column:
    """The title, else the first 48 characters of the text, else empty."""
    text = plain_text(body)
    short = F.when(F.length(text) <= 48, text).otherwise(F.concat(trim_ws(F.substring(text, 1, 48)), F.lit("…")))
    own = trim_ws(F.coalesce(title, F.lit("")))
    return F.when(own != "", own).otherwise(F.coalesce(short, F.lit("")))
