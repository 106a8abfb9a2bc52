"""A deterministic stand-in for a translator: readable text is reversed, markdown stays."""

from __future__ import annotations

import re

from pyspark.sql import Column

from .arrays import each_text

#: What stays in place: links and images (whose label is reversed), code spans, runs of marks.
_FIXED = re.compile(r"(!?\[[^\]]*\]\([^)]+\)|`[^`]+`|[\[\]#!*_`]+)")


def _reversed(part: str) -> str:
    label, target, rest = part.partition("](")
    if not target:
        return part
    mark, bracket, inner = label.partition("[")
    return f"{mark}{bracket}{inner[::-1]}{target}{rest}"


def reverse_line(line: str) -> str:
    """The words between what is fixed, each stretch backwards; a fence line is all fixed."""
    if line.startswith("```"):
        return line
    hashes = len(line) - len(line.lstrip("#"))
    head = hashes + 1 if 0 < hashes < 7 and line[hashes : hashes + 1] == " " else 0
    parts = _FIXED.split(line[head:])
    parts[::2] = [x[::-1] for x in parts[::2]]
    parts[1::2] = [_reversed(x) if x.endswith(")") else x for x in parts[1::2]]
    return line[:head] + "".join(parts)


def reverse_text(markdown: str | None) -> str | None:
    """Lines keep their places."""
    return None if markdown is None else "\n".join(map(reverse_line, markdown.split("\n")))


def reverse_markdown(c: Column) -> Column:
    return each_text(reverse_text, c)


def reversing_translator(sources: list[str], contexts: list[list[tuple[str, str]]]) -> list[str]:
    """A translator as translate_windows_run takes them: answers to sources, given contexts."""
    return [f"<<<TRANSLATION>>>\n{reverse_text(s)}\n<<<END_TRANSLATION>>>" for s in sources]
