"""Language by prediction by partial matching (operator 9).

Each language has a byte context tree of orders 0 to 3 with escape probabilities after
method C (distinct / (total + distinct)) and no exclusions. The statistics are frozen, so a
byte costs what its last four bytes say, and a text's exact code length is a sum of table
look-ups. The language with the shortest code wins, ties go to the smaller name.

Statistics come from all grams of at most about `most_rows` rows of each language, chosen by a
hash. A table of more than MOST_COSTS numbers (grams times languages) isn't broadcast: learning
starts again from half as many rows, and so on. More than MOST_LANGS languages are an error.
Null texts and texts without a letter are `und` with score 0, as is every text if nothing could
be learned. Rows with null doc_id or lang aren't learned from. Repeated rows are predicted each
and are learned from each; very long texts are scored in stretches. Columns called `lang_pred`
or `score` are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents, materialize
from .arrow import portions
from .quality import fold

FOLDS, HELD_OUT, MOST_ROWS, MOST_COSTS, MOST_LANGS = 4, 2, 20_000, 1 << 26, 10_000
ORDER, CHUNK = 3, 1 << 20
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def padded(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    """About `most` bytes at a time: the lower-cased texts, each after three line ends, and which they are.

    A longer text comes in stretches that begin with the three bytes before them.
    """
    of, parts, size = [], [], 0
    for i, t in enumerate(texts):
        data = b"\n\n\n" + (t or "").lower().encode("utf-8", "replace")
        for a in range(0, max(1, len(data) - 3), most):
            parts.append(data[a : a + most + 3])
            of.append(i)
            size += len(parts[-1])
            if size >= most:
                yield of, parts
                of, parts, size = [], [], 0
    if parts:
        yield of, parts


def grams_in(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last four bytes at every byte of the parts but their first three; where each part ends."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
    grams = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    keep = np.ones(len(grams), bool)
    for k in range(3):  # the grams that end in a later part's first bytes
        at = ends[:-1] - 3 + k
        keep[at[(at >= 0) & (at < len(grams))]] = False
    return grams[keep], np.cumsum(sizes - 3)


def gram_counts(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(lang, gram, n) of rows (lang, text), summed by partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[int, int]] = {}

        def out():
            for lang, got in found.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(got), "gram": list(got), "n": list(got.values())}, GRAMS)
            found.clear()

        for part in (p for batch in batches for p in portions(batch, 1)):
            by: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, parts in padded(texts):
                    values, n = np.unique(grams_in(parts)[0], return_counts=True)
                    got = found.setdefault(lang, {})
                    for v, k in zip(values.tolist(), n.tolist(), strict=True):
                        got[v] = got.get(v, 0) + k
            if sum(map(len, found.values())) > most:
                yield from out()
        yield from out()

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table(NamedTuple):
    """Costs by key in an open-addressed table, a row of one cost for each language."""

    slots: np.ndarray
    keys: np.ndarray
    costs: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, costs: np.ndarray) -> Table:
        bits = max(8, int(len(keys)).bit_length() + 2)
        slots, left = np.full(1 << bits, -1, np.int32), np.arange(len(keys), dtype=np.int32)
        at = cls._hash(keys, bits)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            lost = slots[at] != left
            left, at = left[lost], at[lost] + 1 & (1 << bits) - 1
        return cls(slots, keys, costs)

    @staticmethod
    def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(32 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where it isn't held."""
        mask = len(self.slots) - 1
        at = self._hash(keys, mask.bit_length())
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        while len(todo):
            at[todo] = at[todo] + 1 & mask
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


class Model(NamedTuple):
    """Code lengths in bits: tables[k] of k + 1 bytes, escapes[k] of contexts of k bytes."""

    langs: list[str]
    tables: list[Table]
    escapes: list[Table]

    def costs(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits for each gram (order context bytes and the byte), for each language."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        at = self.tables[order].find(grams)
        out = self.tables[order].costs[at] if len(self.tables[order].keys) else np.zeros((len(grams), len(self.langs)), np.float32)
        if len(unseen := np.flatnonzero(at < 0)):
            grams = grams[unseen]
            esc = self.escapes[order].find(grams >> np.uint32(8))
            out[unseen] = self.costs(grams & np.uint32((1 << 8 * order) - 1), order - 1) + np.where(esc[:, None] >= 0, self.escapes[order].costs[esc], np.float32(0))
        return out


def build(counts: pd.DataFrame) -> Model:
    """Context trees from (lang, gram, n)."""
    langs = sorted(counts.lang.unique())
    model = Model(langs, [], [])
    code, grams, n = counts.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(), counts.gram.to_numpy().astype(np.int64), counts.n.to_numpy()
    for order in range(ORDER + 1):
        own = grams & ((1 << 8 * (order + 1)) - 1)
        keys, at = np.unique(own, return_inverse=True)
        table = np.zeros((len(keys), len(langs)))
        np.add.at(table, (at, code), n)
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.zeros((2, len(contexts), len(langs)))
        np.add.at(total, of, table)
        np.add.at(kinds, of, table > 0)
        esc = np.log2((total + kinds) / np.maximum(kinds, 1), where=kinds > 0, out=np.zeros_like(total))
        lower = model.costs((keys & ((1 << 8 * order) - 1)).astype(np.uint32), order - 1)
        seen = np.log2(np.maximum(total + kinds, 1)[of] / np.maximum(table, 1))
        costs = np.where(table > 0, seen, esc[of] + lower).astype(np.float32)
        model.escapes.append(Table.of(contexts.astype(np.uint32), esc.astype(np.float32)))
        model.tables.append(Table.of(keys.astype(np.uint32), costs))
    return model


def learn(docs: DataFrame, most_rows: int = MOST_ROWS, most_costs: int = MOST_COSTS) -> Model | None:
    rows = docs.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null")
    rows = rows.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    sizes = rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))
    while True:
        share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int((1 << 52) * min(1, most_rows / r["count"])))])
        counts = materialize(gram_counts(rows.where(chance < share[F.col("lang")])), "grams")
        grams = counts.agg(F.countDistinct("gram")).first()[0]
        if grams * len(sizes) <= most_costs or most_rows <= 1:
            break
        most_rows //= 2
    return build(counts.toArrow().to_pandas()) if grams else None


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        own, langs = held.value, np.array([*held.value.langs, "und"], object)
        total = np.zeros((len(texts), len(langs) - 1))
        for of, parts in padded(texts.tolist()):
            grams, ends = grams_in(parts)
            full = np.flatnonzero(np.diff(ends, prepend=0))
            if len(full):
                sums = np.add.reduceat(own.costs(grams), np.concatenate([[0], ends[:-1]])[full], axis=0, dtype=np.float64)
                np.add.at(total, np.array(of)[full], sums)
        least = total.min(1, initial=np.inf, keepdims=True)
        letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        score = np.where(letters, 1 / np.exp2(np.maximum(least - total, -1000)).sum(1), 0.0)
        return pd.DataFrame({"lang_pred": langs[np.where(letters, total.argmin(1), len(langs) - 1)], "score": score})

    out = docs.withColumn("__cf_ppm", run(F.col(text)))
    return out.withColumns({"lang_pred": F.col("__cf_ppm.lang_pred"), "score": F.col("__cf_ppm.score")}).drop("__cf_ppm")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), learn(docs))
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
