"""Word shingles as 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

import re
import numpy as np

#: Characters that are hashed at once, a bound on memory.
PORTION = 1 << 19
_BREAK = re.compile(r"[ \t-\r]")

_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1); tables of up to 32 MB are kept."""
    held = _TABLES.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        held[0] = 1
        np.cumprod(held, out=held)
        if len(held) <= 1 << 22:
            _TABLES[int(base)] = held
    return held[:n]


def word_hashes(texts: list[str | None], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased; bounds[i]:bounds[i + 1] are those of text i.

    Also the byte ranges of the words within the texts joined by one space each. table, if
    given, maps bytes first.
    """
    parts = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    sizes = np.array([0, *(len(p) + 1 for p in parts)])
    joined = b" ".join([*parts, b""])
    data = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P, len(data)), out=sums[1:])
    words = mix((sums[end] - sums[start]) * _powers(_P_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))
    return words, np.searchsorted(start, np.cumsum(sizes)), start, end


def _words_in_parts(text: str) -> np.ndarray:
    out, at = [], 0
    while at < len(text):
        m = _BREAK.search(text, at + PORTION)
        end = m.end() if m else len(text)
        out.append(word_hashes([text[at:end]])[0])
        at = end
    return np.concatenate(out)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    if len(texts) == 1 and len(texts[0] or "") > 2 * PORTION:
        words = _words_in_parts(texts[0])
        bounds = np.array([0, len(words)])
    else:
        words, bounds, _, _ = word_hashes(texts)
    out = []
    if len(words) >= width:
        n = len(words) - width + 1
        run = np.full(n, np.uint64(width))
        for k in range(width):
            run = mix(run * _P + words[k : k + n])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            h = np.full(1, np.uint64(b - a))
            for k in range(a, b):
                h = mix(h * _P + words[k])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))
