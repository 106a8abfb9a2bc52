"""Byte-level BPE encoding and decoding (operator 11).

A rank file becomes a model of the tokenizers library: each byte has a character (the byte
table), ranks are merges in order, and the splitting pattern runs before them. Texts pass in Arrow
batches. A token's bytes give its place in the text's UTF-8; the character at each byte turns that
into character offsets, which for tokens that split a character take in the whole of it. Decoding
looks bytes up in the reversed table. A piece of a document can begin or end inside a character:
its text has the whole characters, `lead` and `tail` count the bytes before and after them, and
pieces put one after another give the document's bytes.

Null and empty texts have no tokens. Repeated rows are encoded each. A very long text is one
row and is encoded whole, chunk by chunk. Other columns are kept, but for those of ENCODED or
DECODED, which are replaced. A table without rows gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._spark import documents
from .arrow import portions, runs
from .pieces import ByChunk, is_space, starts
from .tokens import vocabulary

#: Bytes of text, or of ids, in a portion.
BYTES = 2 << 20
ENCODED = "ids array<int>, starts array<int>, ends array<int>, n_split int"
DECODED = "bytes binary, decoded string, lead int, tail int"


def byte_letters() -> list[str]:
    """The character of each byte: printable ones stand for themselves, the others follow after 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merged_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens that make this one: what lower ranks leave of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class ByteBPE:
    """A rank file and a splitting pattern as a tokenizer, with the bytes of every id."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        letters, ranks = byte_letters(), read_ranks(path)
        back = {c: b for b, c in enumerate(letters)}
        spell = lambda token: "".join([letters[b] for b in token])
        in_order = sorted(ranks, key=ranks.get)
        merges = [tuple(map(spell, merged_pair(t, ranks))) for t in in_order if len(t) > 1]
        vocab = {spell(t): i for t, i in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # decoding goes back through the table of letters
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            self.bytes[i] = bytes([back[c] for c in word])
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.table = pa.array(self.bytes, pa.binary())
        self.encode = ByChunk(is_space, self._many, self.sizes)

    def decode(self, ids: pa.Array, counts: np.ndarray) -> pa.BinaryArray:
        """The bytes of lists of ids that follow one another, counts in each."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts(counts), pa.int32()), self.table.take(ids)), b"")

    def _many(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def character_offsets(texts: list[str], sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last character (exclusive) of each token in its text, and whether it begins inside one.

    sizes: the bytes of the tokens of all texts; counts: how many each text has.
    """
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    begins = (data & 0xC0) != 0x80
    of = np.cumsum(begins, dtype=np.int32) - 1  # the character of each byte
    ends = np.cumsum(sizes)
    base = np.repeat(starts([len(t) for t in texts])[:-1], counts)
    return of[ends - sizes] - base, of[ends - 1] + 1 - base, ~begins[ends - sizes]


def _put(df: DataFrame, new: str) -> tuple[list[str], StructType]:
    """The columns of df that stay, and the schema with the new ones."""
    fields = StructType.fromDDL(new).fields
    kept = [c for c in df.columns if c not in {f.name for f in fields}]
    return kept, StructType([*(df.schema[c] for c in kept), *fields])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ENCODED for each row's text: ids, characters [start, end) of each token, tokens that begin inside a character."""
    kept, schema = _put(docs, ENCODED)
    arrow, at = to_arrow_schema(schema), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for part in (p for b in batches for p in portions(b, at, BYTES)):
            texts = [t or "" for t in part.column(at).to_pylist()]
            ids, counts = bpe.encode(texts)
            first, last, inside = character_offsets(texts, bpe.sizes[ids], counts)
            ends = starts(counts)
            split = starts(inside)[ends]
            new = [*(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, first, last)), pa.array(np.diff(split), pa.int32())]
            old = [part.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*old, *new], schema=arrow)

    return docs.select(*kept).mapInArrow(run, schema)


def whole_characters(data: bytes) -> tuple[str, int, int]:
    """The text between broken ends, and the bytes that the ends take."""
    lead = next((k for k in range(min(3, len(data))) if data[k] & 0xC0 != 0x80), min(3, len(data)))
    tail = 0
    for back in range(1, min(3, len(data) - lead) + 1):
        b = data[-back]
        if b & 0xC0 != 0x80:
            tail = back if back < (4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1) else 0
            break
    return data[lead : len(data) - tail].decode("utf-8", "replace"), lead, tail


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with DECODED for the ids of each; null ids are no ids."""
    kept, schema = _put(rows, DECODED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            sizes = [4 * n for n in pc.fill_null(pc.list_value_length(batch.column(len(kept))), 0).to_pylist()]
            for part in (batch.slice(r.start, r.stop - r.start) for r in runs(sizes, BYTES)):
                own = part.column(len(kept))
                data = bpe.decode(own.flatten(), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
                whole = [whole_characters(d) for d in data.to_pylist()]
                new = [data, pa.array([w[0] for w in whole], pa.string()), *(pa.array([w[k] for w in whole], pa.int32()) for k in (1, 2))]
                old = [part.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*old, *new], schema=arrow)

    return rows.select(*kept, F.col(ids).alias("_ids")).mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _numbers(n: int) -> pa.Array:
    return pa.array([str(i) for i in range(n)], pa.string())


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_split, and SHA-256 of the ids and of the bytes that they decode to, of every row of docs.

    What encode() and decode() give, without their lists leaving the task.
    """
    schema = StructType([docs.schema[key], *StructType.fromDDL("n_tokens long, n_split int, ids_sha256 string, decoded_sha256 string").fields])
    sha = lambda data: pa.array([hashlib.sha256(d).hexdigest() for d in data.to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        numbers = _numbers(len(bpe.bytes))
        for part in (p for b in batches for p in portions(b, 1, BYTES)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, counts = bpe.encode(texts)
            split = np.diff(starts(character_offsets(texts, bpe.sizes[ids], counts)[2])[starts(counts)])
            flat, ends = pa.array(ids), pa.array(starts(counts), pa.int32())
            spelt = pc.binary_join(pa.ListArray.from_arrays(ends, numbers.take(flat)), " ").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(split, pa.int32()), sha(spelt), sha(bpe.decode(flat, counts))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
