"""Token ids of whole texts, each distinct chunk of a portion encoded once.

A tokenizer that never merges over a kind of place gives a text's ids chunk by chunk. The texts of
a portion are cut there as bytes, Arrow numbers the distinct chunks, these go to the tokenizer as
a few long texts, and each text's ids are gathered from its chunks' ids. Nothing is kept between portions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: UTF-8 of the characters with the White_Space property: single bytes, and what can follow a leading byte.
SINGLE = [*range(9, 14), 32]
LONGER = {b"\xc2": [b"\x85", b"\xa0"], b"\xe1\x9a": [b"\x80"], b"\xe2\x80": [*(bytes([x]) for x in range(0x80, 0x8B)), b"\xa8", b"\xa9", b"\xaf"], b"\xe2\x81": [b"\x9f"], b"\xe3\x80": [b"\x80"]}
#: Bytes of chunks that go to the tokenizer as one text.
TOGETHER = 4000


def starts(sizes: list[int] | np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and where the last ends."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def gather(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of a UTF-8 text belong to white space."""
    table = np.zeros(256, bool)
    table[SINGLE] = True
    out = table[data]
    for lead, last in LONGER.items():
        at = np.flatnonzero(data == lead[0])
        for k, b in enumerate(lead[1:], 1):
            at = at[data[np.minimum(at + k, len(data) - 1)] == b]
        n = len(lead)
        at = at[np.isin(data[np.minimum(at + n, len(data) - 1)], [x[0] for x in last])]
        for k in range(n + 1):
            out[at + k] = True
    return out


def is_blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are spaces."""
    return data == 32


class ByChunk:
    """Encodes lists of texts. A chunk is a run of what `space` marks and what follows up to the next run.

    many: the ids of each of a list of texts; sizes: the bytes of each id. Chunks that begin with
    space and end without are dealt their ids by bytes; where ids don't end with the chunks, and for
    other chunks, each is encoded by itself.
    """

    def __init__(self, space: Callable[[np.ndarray], np.ndarray], many: Callable[[list[str]], list[list[int]]], sizes: np.ndarray):
        self.space, self.many, self.sizes = space, many, sizes

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        spelt = [t.encode() for t in texts]
        begins = starts([len(t) for t in spelt])
        data = np.frombuffer(b"".join(spelt), np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        space = self.space(data)
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[begins[:-1][begins[:-1] < len(data)]] = True
        at = np.flatnonzero(first)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)])
        found = chunks.dictionary_encode()
        ids, sizes = self._distinct(found.dictionary)
        code = found.indices.to_numpy()
        own = sizes[code]
        counts = np.diff(starts(own)[np.searchsorted(at, begins)])
        return ids[gather((np.cumsum(sizes) - sizes)[code], own)], counts

    def _distinct(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and how many each has."""
        raw = np.frombuffer(chunks.buffers()[2], np.uint8)
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[: len(chunks) + 1].astype(np.int64)
        raw = raw[: ends[-1]]
        space = self.space(raw)
        joins = space[ends[:-1]] & ~space[ends[1:] - 1]
        alone = np.flatnonzero(~joins)
        out: list[tuple[np.ndarray, np.ndarray]] = []  # (numbers of chunks, sizes), with their ids in `made`
        made: list[np.ndarray] = []
        together = np.flatnonzero(joins)
        if len(together):
            length = np.diff(ends)[together]
            group = np.cumsum(length) // TOGETHER
            cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(together))
            data = raw[gather(ends[:-1][together], length)].tobytes()
            edge = starts(length)
            parts = [together[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            lists = self.many([data[edge[a] : edge[b]].decode() for a, b in zip(cut[:-1], cut[1:], strict=True)])
            for part, ids in zip(parts, lists, strict=True):
                ids = np.array(ids, np.uint32)
                have, want = np.cumsum(self.sizes[ids]), np.cumsum(ends[part + 1] - ends[part])
                last = np.searchsorted(have, want)
                if len(have) and last[-1] == len(have) - 1 and np.array_equal(have[last], want):
                    out.append((part, np.diff(last, prepend=-1)))
                    made.append(ids)
                else:
                    alone = np.concatenate([alone, part])
        if len(alone):
            lists = self.many([raw[ends[k] : ends[k + 1]].tobytes().decode() for k in alone.tolist()])
            out.append((alone, np.array([len(x) for x in lists], np.int64)))
            made.append(np.array([i for x in lists for i in x], np.uint32))
        numbers, sizes = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        order = np.argsort(numbers, kind="stable")
        return np.concatenate(made)[gather((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]
