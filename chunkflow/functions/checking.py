"""The rules of operators.answers for one text at a time, for folds that must check as they go."""

from __future__ import annotations

import re

from . import rules
from .text import IMAGE, LINK, MARKERS, WS

_python = lambda p: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", p)
_WS = _python(WS)
_PLAIN = [
    (re.compile(r"```[\s\S]*?```"), " "), (re.compile(r"!\[[^\]]*\]\([^)]*\)"), " "), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(rf"^#{{1,6}}{_WS}+", re.M), ""), (re.compile(rf"^[>*+-]{_WS}+", re.M), ""), (re.compile(rf"^[0-9]+\.{_WS}+", re.M), ""),
    (re.compile(r"[`*_~]"), ""), (re.compile(rf"{_WS}+"), " "),
]
_TRIM = re.compile(rf"\A{_WS}+|{_WS}+\Z")
_IMAGE, _LINK, _MARKERS, _REFUSAL = re.compile(_python(IMAGE)), re.compile(_python(LINK)), re.compile(MARKERS), re.compile(rules.REFUSAL)
_FIRM = re.compile(rules.FIRM)
_INNER = re.compile(rf"(?is)<<<TRANSLATION>>>{_WS}*(.*?){_WS}*<<<END_TRANSLATION>>>")


def trim(text: str) -> str:
    return _TRIM.sub("", text)


def plain(text: str) -> str:
    for pattern, by in _PLAIN:
        text = pattern.sub(by, text)
    return trim(text)


def targets(pattern: re.Pattern, text: str) -> list[str]:
    return list(dict.fromkeys(t for m in pattern.finditer(text) if (t := trim(m[2]))))


def parse_answer(text: str) -> str:
    """functions.text.parse_response for one text."""
    s = trim(re.sub(r"\n?```\Z", "", re.sub(r"(?i)\A```(?:markdown|md|xml|html)?\n?", "", text)))
    s = trim(s.removeprefix("﻿"))
    if m := _INNER.search(s):
        s = trim(m[1])
    s = re.sub(rf"(?i)\A{_WS}*<<<TRANSLATION>>>{_WS}*", "", s)
    s = re.sub(rf"(?i){_WS}*<<<END_TRANSLATION>>>{_WS}*\Z", "", s)
    return trim(_MARKERS.sub("", s))


def problem(source: str, translation: str | None) -> str | None:
    """Why the translation isn't accepted, None if it is: operators.answers.refusal_reason for one text."""
    text, src, dst = translation or "", plain(source), plain(translation or "")
    counts = len(src) > rules.COUNTS_FROM
    missing = lambda targets, gone: next((t for t in targets if gone(t)), None)
    failed = {
        rules.EMPTY: lambda: not trim(text), rules.SHORT: lambda: counts and len(dst) < max(rules.LEAST, len(src) * rules.LEAST_SHARE),
        rules.LONG: lambda: counts and len(dst) > len(src) * rules.MOST_TIMES, rules.REFUSED: lambda: _REFUSAL.search(dst), rules.TAGS: lambda: _MARKERS.search(text),
        rules.NO_IMAGE: lambda: missing(targets(_IMAGE, source), lambda t: f"]({t})" not in text),
        rules.NO_HREF: lambda: missing(targets(_LINK, source), lambda t: _FIRM.search(t) and t not in text),
    }
    for reason in rules.REASONS:
        if found := failed[reason]():
            return reason + found if reason in (rules.NO_IMAGE, rules.NO_HREF) else reason
    return None
