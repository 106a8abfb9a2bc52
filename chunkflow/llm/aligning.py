"""Cross-tokenizer alignment (operator 13).

Tokenizer A reads a space and the text, tokenizer B the text, to which it adds the space itself.
Both sequences of tokens spell the same bytes; where tokens of both end is a cut, and the tokens
between two cuts are a group. A and B tokens that end together are linked.

The texts of a portion are merged in lockstep: one state vector holds an A and a B pointer for every
lane, each step looks at the ends of all lanes' tokens at once, advances the pointer whose token ends
first or both, and emits cuts and links; lanes that are through are compacted away. A lane is
a stretch of a document of about LANE tokens, so that long documents don't run alone for long: ends
that fall into its bytes are its own, wherever the cuts are.

How often each pair of ids is linked is summed over the corpus from each row's own counts. The most
frequent pairs (at most `head`) go to the tasks as a broadcast, a row's other pairs meet the
table in a shuffled join.

Null and empty texts, and texts whose tokens don't spell them, have no tokens. Repeated rows count
each. A very long text is one portion. Other columns are kept, but for those of ALIGNED,
which are replaced. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._spark import documents, materialize
from .arrow import portions
from .bytebpe import BYTES, byte_letters
from .pieces import ByChunk, is_blank, is_space, starts
from .tokens import vocabulary

LANE, HEAD = 256, 200_000
ALIGNED = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, link_a array<int>, link_b array<int>"


class Tokens:
    """A tokenizer, by chunks, and the bytes of its ids."""

    def __init__(self, table: list[bytes], space: Callable[[np.ndarray], np.ndarray], many: Callable[[list[str]], list[list[int]]]):
        self.table, self.sizes = pa.array(table, pa.binary()), np.array([len(b) for b in table], np.int64)
        self.encode = ByChunk(space, many, self.sizes)

    def spelling(self, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Which texts their tokens spell."""
        made = self.table.take(pa.array(ids, pa.int64()))
        data = b"" if not len(ids) else bytes(memoryview(made.buffers()[2])[: int(self.sizes[ids].sum())])
        if data == b"".join(texts):  # as a rule; tokens then end where texts do, or the texts differ
            sizes = np.diff(starts(self.sizes[ids])[starts(counts)])
            if np.array_equal(sizes, [len(t) for t in texts]):
                return np.ones(len(texts), bool)
        ends = starts(self.sizes[ids])[starts(counts)].tolist()
        return np.array([data[a:b] == t for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)], bool)


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokens:
    """A byte-level BPE file of the tokenizers library; special strings are ordinary text."""
    from tokenizers import Tokenizer

    t, back = Tokenizer.from_file(path), {c: b for b, c in enumerate(byte_letters())}
    t.encode_special_tokens = True
    table = [b""] * t.get_vocab_size()
    for word, i in t.get_vocab().items():
        table[i] = bytes([back[c] for c in word]) if all(c in back for c in word) else word.encode()
    return Tokens(table, is_space, lambda chunks: [e.ids for e in t.encode_batch_fast(chunks, add_special_tokens=False)])


@lru_cache(maxsize=2)
def word_pieces(path: str) -> Tokens:
    """A sentencepiece model that puts a space before the text and merges over no space.

    A chunk begins with the space that the model adds.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    mark = "▁"  # stands for a space
    if any(mark in p.lstrip(mark) for p in pieces):
        raise ValueError("pieces go over spaces")
    of_byte = re.compile("<0x([0-9A-F]{2})>")
    table = [bytes([int(m[1], 16)]) if (m := of_byte.fullmatch(p)) else p.replace(mark, " ").encode() for p in pieces]
    alone = [model.piece_to_id(mark)]  # an empty text gets no space
    return Tokens(table, is_blank, lambda chunks: [ids or alone for ids in model.encode([c[1:] for c in chunks], num_threads=1)])


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two rising sequences of ends that are equal, merged in lanes of (edge, next edge]."""
    a, b = (np.searchsorted(x, edges, "right") for x in (a_ends, b_ends))
    a_to, b_to = a[1:], b[1:]
    a, b = a[:-1], b[:-1]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        live = (a < a_to) & (b < b_to)
        if not live.all():  # finished lanes go
            a, b, a_to, b_to = a[live], b[live], a_to[live], b_to[live]
        if not len(a):
            break
        x, y = a_ends[a], b_ends[b]
        same = x == y
        found_a.append(a[same])
        found_b.append(b[same])
        a, b = a + (x <= y), b + (y <= x)
    # lanes emit in turn: put the cuts in order
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Merged(NamedTuple):
    """Ids of a portion's texts one after another, where each text's begin, and the A and B tokens that end at a cut."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def columns(self) -> list[pa.ListArray]:
        """ALIGNED of each text."""
        text_of = np.searchsorted(self.a_starts, self.cut_a, "right") - 1
        groups = starts(np.bincount(text_of, minlength=len(self.a_starts) - 1))
        column = lambda flat, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        out = [column(self.a_ids, self.a_starts), column(self.b_ids, self.b_starts), *(column(np.diff(c, prepend=-1), groups) for c in (self.cut_a, self.cut_b))]
        return [*out, column(self.cut_a - self.a_starts[text_of], groups), column(self.cut_b - self.b_starts[text_of], groups)]


def merge_portion(a: Tokens, b: Tokens, texts: list[str | None]) -> Merged:
    """Tokens and cuts of a portion of texts; see align()."""
    read = [f" {t}" if t else "" for t in texts]
    spelt = [t.encode() for t in read]
    ids, counts = zip(*(t.encode(read) for t in (a, b)), strict=True)
    good = a.spelling(ids[0], counts[0], spelt) & b.spelling(ids[1], counts[1], spelt)
    if not good.all():
        ids = [i[np.repeat(good, n)] for i, n in zip(ids, counts, strict=True)]
        counts = [np.where(good, n, 0) for n in counts]
    ids = [i.astype(np.int64) for i in ids]
    # one line of bytes for all texts: tokens end on both sides where a text ends
    ends = [np.cumsum(t.sizes[i]) for t, i in zip((a, b), ids, strict=True)]
    step = np.arange(0, len(ends[0]), LANE)
    cuts = lockstep(*ends, np.concatenate([[0], ends[0][step[1:] - 1], ends[0][-1:]]))
    return Merged(*ids, *(starts(n) for n in counts), *cuts)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs with ALIGNED for each row's text.

    The ids of both tokenizers, how many of each make up every group, and for every link the numbers of
    the two tokens in their sequences.
    """
    fields = StructType.fromDDL(ALIGNED).fields
    kept = [c for c in docs.columns if c not in {f.name for f in fields}]
    schema = StructType([*(docs.schema[c] for c in kept), *fields])
    arrow, at = to_arrow_schema(schema), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), word_pieces(b_path)
        for part in (p for x in batches for p in portions(x, at)):
            new = merge_portion(a, b, part.column(at).to_pylist()).columns()
            yield pa.RecordBatch.from_arrays([*(part.column(k).cast(arrow.field(k).type) for k in range(len(kept))), *new], schema=arrow)

    return docs.select(*kept).mapInArrow(run, schema)


@lru_cache(maxsize=4)
def _labels(blocks: int) -> pa.Array:
    """Every id of so many blocks of 16,384, and one more, with each mark that can follow it."""
    return pa.array([f"{i}{mark}" for i in range(blocks + 1 << 14) for mark in ",|;"], pa.string())


def group_texts(a_ids: pa.ListArray, b_ids: pa.ListArray, a_sizes: pa.ListArray, b_sizes: pa.ListArray) -> pa.Array:
    """`a1,a2|b1;a3|b2,b3` of each row: ids of the groups, A before B; empty without tokens."""
    a, b, na, nb = (x.flatten().to_numpy() for x in (a_ids, b_ids, a_sizes, b_sizes))
    end_a, end_b = np.cumsum(na), np.cumsum(nb)
    # the place of each token when groups follow one another, and what follows it
    place_a = np.arange(len(a)) + np.repeat(end_b - nb, na)
    place_b = np.arange(len(b)) + np.repeat(end_a, nb)
    tail_a, tail_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    tail_a[end_a - 1], tail_b[end_b - 1] = 1, 2
    ids, tail = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b], tail[place_a], tail[place_b] = a, b, tail_a, tail_b
    spelt = _labels(int(ids.max(initial=0)) >> 14).take(pa.array(ids * 3 + tail))
    sizes = sum(pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a_ids, b_ids))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts(sizes), pa.int32()), spelt), "")
    return pc.utf8_slice_codeunits(joined, 0, -1)


def _counts(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """One row for each row of docs: counts, a digest of its groups, and its distinct linked pairs of ids with their counts.

    What align() gives, without its lists leaving the task.
    """
    ddl = "_row long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, n array<int>"
    schema = StructType([*StructType.fromDDL(ddl).fields, docs.schema[key]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), word_pieces(b_path)
        row = TaskContext.get().partitionId() << 33
        for part in (p for x in batches for p in portions(x, 1, BYTES)):
            n, m = part.num_rows, merge_portion(a, b, part.column(1).to_pylist())
            lists = m.columns()
            sizes = [pc.list_value_length(x).cast(pa.int64()) for x in lists[:3]]
            own = np.repeat(np.arange(n), sizes[2].to_numpy())
            found = pa.array(m.a_ids[m.cut_a] << 32 | m.b_ids[m.cut_b]).dictionary_encode()
            most = max(1, len(found.dictionary))
            counted = pa.array(own * most + found.indices.to_numpy()).value_counts()  # in the order of rows
            both, times = (counted.field(k).to_numpy() for k in (0, 1))
            of, pair = both // most, found.dictionary.to_numpy()[both % most]
            ends = pa.array(starts(np.bincount(of, minlength=n)), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pair >> 32, pair & 0xFFFFFFFF, times)]
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(*lists[:4]).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), *sizes, pa.array(digests, pa.string()), *columns, part.column(0)], names=schema.names)
            row += n

    return docs.select(key, text).mapInArrow(run, schema)


def pair_table(rows: DataFrame) -> DataFrame:
    """(a, b, count, best) of all linked pairs of ids: how many links hold it, and whether no other pair of b has more."""
    each = rows.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x"))
    counted = materialize(each.groupBy("x.a", "x.b").agg(F.sum("x.n").alias("count")), "pairs")
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return materialize(counted.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")


def frequent_pairs(table: DataFrame, head: int) -> pa.Table:
    """The most frequent pairs, at most `head`: a step of counts comes in whole or not at all."""
    stepped = table.withColumn("step", F.floor(F.log2("count") * 16).cast("int"))
    least, held = None, 0
    for r in sorted(stepped.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):  # at most 16 * 64 steps
        held += r["n"]
        if held > head:
            break
        least = r["step"]
    return stepped.where(F.lit(False) if least is None else F.col("step") >= least).select("a", "b", "count", "best").toArrow()


def link_counts(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Per row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum and the SHA-256 of group_texts(), empty without tokens."""
    rows = materialize(_counts(docs, a_path, b_path, key, text), "aligned")
    table = pair_table(rows)
    top = frequent_pairs(table, head)
    code = top["a"].to_numpy().astype(np.int64) << 32 | top["b"].to_numpy()
    order = np.argsort(code)
    known = rows.sparkSession.sparkContext.broadcast(tuple(x[order] for x in (code, top["count"].to_numpy(), top["best"].to_numpy())))
    schema = StructType.fromDDL("_row long, best long, total long, a array<int>, b array<int>, n array<int>")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = known.value
        for part in (p.slice(k, 200) for p in batches for k in range(0, p.num_rows, 200)):
            size = pc.list_value_length(part.column(1)).to_numpy()
            a, b, n = (part.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
            of, pair = np.repeat(np.arange(len(size)), size), a << 32 | b
            at = np.searchsorted(code, pair)
            hit = code[np.minimum(at, len(code) - 1)] == pair if len(code) else np.zeros(len(pair), bool)
            sums = np.zeros((2, len(size)), np.int64)
            np.add.at(sums[0], of[hit], n[hit] * best[at[hit]])
            np.add.at(sums[1], of[hit], n[hit] * count[at[hit]])
            ends = pa.array(starts(np.bincount(of[~hit], minlength=len(size))), pa.int32())
            rest = [pa.ListArray.from_arrays(ends, pa.array(x[~hit], pa.int32())) for x in (a, b, n)]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums), *rest], names=schema.names)

    found = materialize(rows.select("_row", "a", "b", "n").mapInArrow(look_up, schema), "link-counts")
    rest = found.select("_row", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("_row", "x.a", "x.b", "x.n").join(table, ["a", "b"])
    rest = rest.select("_row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("best"), (F.col("n") * F.col("count")).alias("total"))
    sums = found.select("_row", "best", "total").unionByName(rest).groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    out = rows.select("_row", F.col(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256").join(sums, "_row")
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
