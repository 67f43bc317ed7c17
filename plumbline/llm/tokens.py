"""Exact word-wise tokenisation with a bounded memo.

The public vocabularies used here never let a token span white space inside a text, so a text's ids are the ids of its
white-space-separated chunks in turn. Chunks recur, so their ids are kept in a dictionary that is emptied when it is full;
what it holds never changes a result. `tests/llm` compares whole texts with the libraries' own results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from .common import tokenizer_path

#: Chunks remembered by a worker process.
MEMO = 800_000
#: Texts split into chunks at a time; bounds a worker's memory whatever the batch size.
SLICE = 256
#: Characters of such a slice, unless one text has more.
SLICE_CHARS = 4_000_000
#: Words sent to the library as one text.
JOINED = 512

_ALNUM = np.array([chr(i).isalnum() for i in range(256)])
_BREAK = np.isin(np.arange(256), [10, 32])
_MARK = np.isin(np.arange(256), [44, 46])


def cuts(sizes: Iterable[int], rows: int = SLICE, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of at most `rows` texts and `chars` characters; a longer text is a stretch of its own."""
    at, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > at and (i - at >= rows or total + n > chars):
            yield at, i
            at, total = i, 0
        total += n
    if i >= at:
        yield at, i + 1


def slices(texts: list[str], rows: int = SLICE, chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    for lo, hi in cuts(map(len, texts), rows, chars):
        yield texts[lo:hi]


class WordBpe:
    """`tokenizers` file whose pre-tokenizer drops white space (word_bpe_49k.json): ids as little-endian uint32 bytes."""

    #: White space to the tokenizer; Python's own split also takes what is in ODD.
    SPLIT = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, name: str = "word_bpe_49k.json", folder: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(tokenizer_path(name, folder))
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """The text's chunks. Latin-1 text is folded to lower case, as the tokenizer would, and points and commas that end words
        are chunks of their own, as they are tokens of their own; so the memo has to hold fewer."""
        if self.ODD.search(text):
            return [c for c in self.SPLIT.split(text) if c]
        try:
            a = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return text.split()
        if "<|" in text:  # may be a special token
            return text.split()
        text = text.lower()
        at = np.flatnonzero(_MARK[a[:-1]] & _BREAK[a[1:]])
        if len(at) and at[0] > 0 and _ALNUM[a[at - 1]].all():
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n")
        return text.split()

    def learn(self, new: Iterable[str]) -> None:
        plain, other = [], []
        for c in new:
            (plain if c.isalpha() else other).append(c)
        for i in range(0, len(plain), JOINED):  # each is one word to the tokenizer, and so has one last token
            part = plain[i : i + JOINED]
            ids = np.array(self.t.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(part):
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for c, to in zip(part, ends.tolist(), strict=True):
                self.memo[c] = raw[at:to]
                at = to
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for c, e in zip(part, self.t.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[c] = np.array(e.ids, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        split = [self.chunks(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new: set[str] = set().union(*split)
        self.learn(new.difference(self.memo))
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) for s in split]


@lru_cache(4)
def word_bpe(name: str = "word_bpe_49k.json", folder: str | None = None) -> WordBpe:
    """One for each worker process, so that its memo serves all tasks there."""
    return WordBpe(name, folder)


class PieceBpe:
    """`sentencepiece` model with byte fallback (piece_bpe_32k.model): ids of each chunk, as uint16 bytes."""

    def __init__(self, name: str = "piece_bpe_32k.model", folder: str | None = None):
        import sentencepiece

        self.t = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name, folder))
        self.size = self.t.get_piece_size()
        self.bytes = np.array([self.t.is_byte(i) for i in range(self.size)])
        self.memo: dict[str, bytes] = {}

    def encode_words(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text given as its words, each word encoded as it is after a space."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new: set[str] = set()
        for s in texts:
            new.update(s)
        part = list(new.difference(self.memo))
        for c, ids in zip(part, self.t.encode(part, num_threads=1) if part else [], strict=True):
            self.memo[c] = np.array(ids, "<u2").tobytes()
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) for s in texts]


@lru_cache(4)
def piece_bpe(name: str = "piece_bpe_32k.model", folder: str | None = None) -> PieceBpe:
    """One for each worker process."""
    return PieceBpe(name, folder)


class ByteBpe:
    """`tiktoken` ranks of a byte-level vocabulary (byte_bpe_multi_50k.tiktoken): how many tokens a word is after a space."""

    def __init__(self, name: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name, folder)) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        self.t = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def count_words(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each text given as its words."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new: set[str] = set().union(*texts).difference(self.memo)
        for w in new:
            self.memo[w] = len(self.t.encode_ordinary(" " + w))
        get = self.memo.__getitem__
        return [sum(map(get, s)) for s in texts]


@lru_cache(4)
def byte_bpe(name: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(name, folder)
