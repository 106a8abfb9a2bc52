"""Pre-tokens and ids of a word-end BPE vocabulary, looked up by white-space chunk.

No pre-token crosses white space, so a chunk's ids never depend on its neighbours: a text
is the sequence of its chunks, and what a chunk gives is worked out once per worker. The
memory of chunks is bounded and forgets the oldest when full; results don't depend on it.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from .arrow import Memory

#: Python splits at these too, the tokenizer doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
#: A Latin-1 word and closing punctuation: lower-casing is all the normalizer does to it.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Bounds on what is remembered: entries of a generation, characters of an entry.
MOST_CHUNKS, MOST_CHARS = 200_000, 64


def chunks(text: str) -> list[str]:
    """The text's white-space chunks, as the tokenizer sees white space."""
    if any(c in text for c in NOT_SPACE):
        return [x for x in SPACE.split(text) if x]
    return text.split()


class PreTokenizer:
    """Splits a chunk as the tokenizer in a vocabulary file does, and runs its model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {b: p for b in range(256) if (p := self._letter(b))}

    def _letter(self, b: int) -> str:
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(b) if b in kept else chr(256 + b - sum(x < b for x in kept))

    def split(self, chunk: str) -> tuple[str, ...]:
        if m := PLAIN.fullmatch(chunk):
            word, end = m[1].lower(), m[2]
            return (word, end) if end else (word,)
        out: list[str] = []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.special:
                out.append(part)
            elif part:
                text = self.tokenizer.normalizer.normalize_str(part)
                out += [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return tuple(out)

    def ids(self, pretoken: str) -> list[int]:
        if pretoken in self.special:
            return [self.special[pretoken]]
        spelt = pretoken.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(spelt)]


@lru_cache(maxsize=4)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)


class ChunkIds(Memory):
    """chunk -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__(MOST_CHUNKS)
        self.by, self.words = pre_tokenizer(path), Memory(MOST_CHUNKS)

    def __missing__(self, chunk: str) -> bytes:
        if (out := super().__missing__(chunk)) is not None:
            return out
        out = b""
        for p in self.by.split(chunk):
            if (got := self.words[p]) is None:
                got = array("I", self.by.ids(p)).tobytes()
                if len(p) <= MOST_CHARS:
                    self.words.keep(p, got)
            out += got
        if len(chunk) <= MOST_CHARS:
            self.keep(chunk, out)
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([self[c] for c in chunks(text)])


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
