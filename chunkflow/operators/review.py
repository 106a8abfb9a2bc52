"""Edits of reviewed translations and word differences."""

from __future__ import annotations

import re
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checking import problem
from .commits import KEYS, edit_ownership

MOST_CELLS = 4_000_000
OPS = "array<struct<type:string,text:string>>"


def edited(pair: dict, old: str | None, new: str | None) -> tuple[dict, str]:
    """(pair, result) after replacing the one place where old stands, literally."""
    if not old:
        return pair, "err: old is empty"
    n = pair["translation"].count(old)
    if n != 1:
        return pair, "err: old was not found in this chunk" if not n else f"err: old matches {n} times in this chunk; make it a unique substring"
    text = pair["translation"].replace(old, new or "")
    if reason := problem(pair["original"], text):
        return pair, f"err: {reason}"
    if text == pair["translation"]:
        return pair, "ok"
    before = pair["pre_review"] if pair["pre_review"] is not None else pair["translation"]
    pair = pair | {"translation": text, "pre_review": before}
    return (pair if text == pair["original"] else pair | {"used_original": False, "reason": None}), "ok"


def apply_edits(pairs: DataFrame, edits: DataFrame, batch: int = 5) -> tuple[DataFrame, DataFrame]:
    """(pairs after the edits, results): edits of a chunk apply in the order of seq.

    Only chunks with edits go through Python, each as one row with its few edits.
    """
    owned = edit_ownership(edits, batch)
    step = F.struct("seq", "window_id", "old", "new", "message")
    todo = owned.groupBy(*KEYS).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    schema = "struct<translation:string,used_original:boolean,reason:string,pre_review:string,results:array<string>>"

    @F.pandas_udf(schema)
    def run(original: pd.Series, translation: pd.Series, used: pd.Series, reason: pd.Series, pre: pd.Series, steps: pd.Series) -> pd.DataFrame:
        out = []
        for o, t, u, r, p, edits_ in zip(original, translation, used, reason, pre, steps, strict=True):
            pair, results = {"original": o, "translation": t, "used_original": u, "reason": r, "pre_review": p}, []
            for e in edits_ if edits_ is not None else []:
                if e["message"] is not None:
                    results.append(e["message"])
                elif t is None:
                    results.append("err: no translation for this chunk")
                else:
                    pair, said = edited(pair, e["old"], e["new"])
                    results.append(said)
            out.append({k: v for k, v in pair.items() if k != "original"} | {"results": results})
        return pd.DataFrame(out, columns=["translation", "used_original", "reason", "pre_review", "results"])

    both = todo.join(pairs, KEYS, "left").withColumn("_new", run("original", "translation", "used_original", "reason", "pre_review", "_steps"))
    results = both.select(*KEYS, F.explode(F.arrays_zip(F.col("_steps"), F.col("_new.results").alias("result"))).alias("x"))
    results = results.select(*KEYS, "x._steps.window_id", "x._steps.seq", "x.result")
    changed = both.where("original is not null").select(*KEYS, F.col("_new").alias("_new"))
    out = pairs.join(changed, KEYS, "left")
    fields = ("translation", "used_original", "reason", "pre_review")
    return out.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields}).drop("_new"), results


def diff_words(before: str | None, after: str | None) -> list[dict[str, str]]:
    """Equal, deleted and inserted stretches between two texts, word by word.

    What is deleted comes before what is inserted at the same place. If the parts that differ
    have more than MOST_CELLS pairs of words, all of them are replaced.
    """
    a, b = (re.findall(r"\s+|\S+", t or "") for t in (before, after))
    out: list[dict[str, str]] = []
    at_a = at_b = 0
    for i, j, n in [*_equal_runs(a, b), (len(a), len(b), 0)]:
        for kind, words in (("del", a[at_a:i]), ("ins", b[at_b:j]), ("eq", a[i : i + n])):
            if words:
                out.append({"type": kind, "text": "".join(words)})
        at_a, at_b = i + n, j + n
    return out


def _equal_runs(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Runs (place in a, place in b, length) of a longest common subsequence."""
    same = len(commonprefix([a, b]))
    tail = len(commonprefix([a[same:][::-1], b[same:][::-1]]))
    x, y = a[same : len(a) - tail], b[same : len(b) - tail]
    pairs = [(k, k) for k in range(same)] + [(i + same, j + same) for i, j in common_places(x, y)]
    pairs += [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    runs: list[tuple[int, int, int]] = []
    for i, j in pairs:
        if runs and (i, j) == (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]):
            runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
        else:
            runs.append((i, j, 1))
    return runs


def common_places(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, bit-parallel: one number holds a row over y.

    A zero at bit j of row i says that y[j] makes the subsequence of x[: i + 1] longer.
    """
    if len(x) * len(y) > MOST_CELLS:
        return []
    where: dict[str, int] = {}
    for j, w in enumerate(y):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for w in x:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    out, i, j = [], len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def word_diff(before: Column, after: Column) -> Column:
    @F.pandas_udf(OPS)
    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([diff_words(x, y) for x, y in zip(one, two, strict=True)], dtype=object)

    return run(before, after)
