"""Token counts from pre-token frequencies (operator 10).

One pass splits the texts and keeps each document's pre-token frequencies in the shared folder.
Pieces are counted once per distinct pre-token of the corpus. The most frequent pre-tokens (at
most `head`, long ones by their digests, hence a bound on bytes) go to the tasks as a broadcast; a
document's other pre-tokens meet the table of pieces in a shuffled join. No ids are made. Null
and empty texts have no tokens, repeated rows are counted each, other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._spark import documents, materialize
from .arrow import Memory, portions
from .tokens import MOST_CHARS, MOST_CHUNKS, chunks, pre_tokenizer, vocabulary

HEAD = 200_000
ROWS = "_row long, n_bytes long, pretokens array<string>, freqs array<int>"


def frequencies(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ROWS and _key of every row of docs: its distinct pre-tokens and how often they occur."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, held, row = pre_tokenizer(path), Memory(MOST_CHUNKS), TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in portions(batch, 1)):
            sizes, tokens, freqs, keys = [], [], [], part.column(0)
            for t in part.column(1).to_pylist():
                found: dict[str, int] = {}
                for c, n in Counter(chunks(t or "")).items():
                    if (pieces := held[c]) is None:
                        pieces = by.split(c)
                        if len(c) <= MOST_CHARS:
                            held.keep(c, pieces)
                    for p in pieces:
                        found[p] = found.get(p, 0) + n
                sizes.append(len(found))
                tokens += found
                freqs += found.values()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((tokens, pa.string()), (freqs, pa.int32()))]
            n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(sizes))), n_bytes, *lists, keys], ["_row", "n_bytes", "pretokens", "freqs", "_key"])
            row += len(sizes)

    schema = StructType([*StructType.fromDDL(ROWS).fields, StructField("_key", docs.schema[key].dataType)])
    return materialize(docs.select(key, text).mapInArrow(split, schema), "token-rows")


def pretoken_table(rows: DataFrame, path: str) -> DataFrame:
    """(pretoken, n, pieces) of all rows of frequencies(); written to the shared folder."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = pre_tokenizer(path)
        for batch in batches:
            yield batch.append_column("pieces", pa.array([len(by.ids(p)) for p in batch.column(0).to_pylist()], pa.int32()))

    each = rows.select(F.explode(F.arrays_zip("pretokens", "freqs")).alias("x")).select(F.col("x.pretokens").alias("pretoken"), "x.freqs")
    counted = each.groupBy("pretoken").agg(F.sum("freqs").alias("n"))
    return materialize(counted.mapInArrow(pieces, "pretoken string, n long, pieces int"), "pretokens")


def frequent(table: DataFrame, head: int) -> pa.Table:
    """(name, pieces) of the most frequent pre-tokens, at most `head` rows.

    A name is the pre-token, or, if that is long, two spaces and its MD5: no pre-token holds a space. A step
    of frequency comes in whole or not at all: counts by step are summed before they meet, so no task
    ranks the pre-tokens.
    """
    name = F.when(F.length("pretoken") <= MOST_CHARS, F.col("pretoken")).otherwise(F.concat(F.lit("  "), F.md5(F.col("pretoken").cast("binary"))))
    named = table.select(name.alias("name"), "pieces", F.floor(F.log2("n") * 16).cast("int").alias("step"))
    least, held = None, 0
    for r in sorted(named.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # at most 16 * 64 steps
        held += r["count"]
        if held > head:
            break
        least = r["step"]
    return named.where(F.lit(False) if least is None else F.col("step") >= least).select("name", "pieces").toArrow()


def names_of(tokens: pa.Array) -> pa.Array:
    """The names of pre-tokens, as frequent() has them."""
    long = np.flatnonzero(np.asarray(pc.utf8_length(tokens)) > MOST_CHARS)
    if not len(long):
        return tokens
    spelt = ["  " + hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() for t in tokens.take(pa.array(long)).to_pylist()]
    mask = np.zeros(len(tokens), bool)
    mask[long] = True
    return pc.replace_with_mask(tokens, pa.array(mask), pa.array(spelt, tokens.type))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """key, n_bytes and n_tokens of every row of docs."""
    rows = frequencies(docs, path, key, text)
    table = pretoken_table(rows, path)
    top = frequent(table, head)
    known = docs.sparkSession.sparkContext.broadcast((top["name"].to_numpy(), top["pieces"].to_numpy()))
    kept = [f for f in StructType.fromDDL("_row long, n_bytes long, known long, pretokens array<string>, freqs array<int>").fields]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pieces = pa.array(known.value[0], pa.string()), np.append(known.value[1], 0).astype(np.int64)
        for batch in batches:
            tokens, freqs = (batch.column(k) for k in (2, 3))
            size = np.asarray(pc.list_value_length(tokens))
            flat, times = tokens.flatten(), freqs.flatten()
            at = np.asarray(pc.fill_null(pc.index_in(names_of(flat), value_set=names), -1))
            of = np.repeat(np.arange(len(size)), size)
            found = np.bincount(of, pieces[at] * np.asarray(times), minlength=len(size)).astype(np.int64)
            rest = at < 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[rest], minlength=len(size)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x.filter(pa.array(rest))) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found), *lists, batch.column(4)], ["_row", "n_bytes", "known", "pretokens", "freqs", "_key"])

    looked = materialize(rows.mapInArrow(look_up, StructType([*kept, rows.schema["_key"]])), "token-counts")
    rest = looked.select("_row", F.explode(F.arrays_zip("pretokens", "freqs")).alias("x")).select("_row", "x.pretokens", "x.freqs")
    rest = rest.join(table.select("pretoken", "pieces"), F.col("pretokens") == F.col("pretoken"))
    rest = rest.groupBy("_row").agg(F.sum(F.col("freqs") * F.col("pieces")).alias("rest"))
    out = looked.select("_row", "n_bytes", "known", F.col("_key").alias(key)).join(rest, "_row", "left")
    return out.select(key, "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
