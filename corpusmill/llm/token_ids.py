"""Token ids of texts by a tokenizer file, a batch at a time.

A space between two other characters always begins a pre-token, so texts are
cut there, and the distinct words of a batch are encoded once, together: joined
by spaces into one text whose tokens fall apart at the words' ends. Where the
file is a byte-level BPE whose ids grow with its merges, that text goes
through tiktoken with the file's own vocabulary, else piece by piece through
the file's library (tokenizers); the ids are the same. Texts with longer runs of white space are cut
into pre-tokens by the tokenizer's own pattern. A text that holds an added token, or characters
outside the range in which the regular expression engines surely agree,
goes through the library whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

from corpusmill.llm.common import text_buffer

CACHE = 300_000           # distinct pieces kept by a worker
# The byte-level pre-tokenizer's pattern: a fixed value of the file format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSURE = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")
_RUNS = [a + b for x in "\t\n\x0b\x0c\r\xa0" for a, b in ((" ", x), (x, " "))] + ["  "]


def _with_runs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds one of _RUNS, or a space at an end."""
    out = np.zeros(len(off) - 1, bool)
    some = off[1:] > off[:-1]
    out[some] = (buf[off[:-1][some]] == 32) | (buf[off[1:][some] - 1] == 32)
    gap = (buf >= 9) & (buf <= 13)
    wide = np.flatnonzero((buf[:-1] == 0xC2) & (buf[1:] == 0xA0)) + 1
    after, before = gap | (buf == 32), gap.copy()
    after[wide - 1] = True                    # first byte of U+00A0
    before[wide] = True                       # its last byte
    space = np.flatnonzero(buf == 32)
    right = space[space + 1 < len(buf)]
    right = right[after[right + 1]]
    left = space[space > 0]
    left = left[before[left - 1]]
    for at, other in ((right, right + 1), (left, left - 1)):
        own = np.searchsorted(off, at, "right") - 1
        out[own[own == np.searchsorted(off, other, "right") - 1]] = True
    return out


def _ends_in_space(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each word, none of them empty, ends in white space of the sure range."""
    last = buf[off[1:] - 1] if len(off) > 1 else buf[:0]
    before = buf[np.maximum(off[1:] - 2, 0)] if len(off) > 1 else buf[:0]
    return ((last >= 9) & (last <= 13)) | ((last == 0xA0) & (before == 0xC2))


class _Cache(dict):
    """Ids by piece; when it is full the older half gives way."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        if len(self) >= CACHE // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary of a byte-level
    file: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.ranked = self._ranked()
        self.known = _Cache(self._pre_token)          # pre-token: ids
        self.spaced = _Cache(self._after_space)       # what follows a space: ids with that space

    def _ranked(self):
        """The vocabulary as byte ranks, where merging by rank is what the
        file's merges do; else None."""
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab = model["vocab"]
        if model.get("type") != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            return None
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ", 1)), -1) for m in model["merges"]]
        byte = {c: b for b, c in self.letters.items()}
        try:
            ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        except KeyError:
            return None
        single = [ranks.get(bytes([b]), 1 << 30) for b in range(256)]
        if any(b <= a for a, b in zip(made, made[1:])) or not made or max(single) >= made[0] or len(ranks) != 256 + len(made):
            return None
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spaced_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + word for words without spaces, one after the other, and
        their numbers. Words are neither empty nor end in white space."""
        if self.ranked is not None and len(words):
            buf, off = text_buffer(words)
            text = np.insert(buf, off[:-1], 32).tobytes().decode()
            ids = self.ranked.encode_to_numpy(text)
            ends = off[1:] + np.arange(1, len(off))
            at = np.cumsum(self.sizes[ids])
            cut = np.searchsorted(at, ends)
            if cut[-1] == len(ids) - 1 and (at[cut] == ends).all():
                return ids.astype(np.uint32), np.diff(cut + 1, prepend=0)
        parts = [self._after_space(w) for w in words.to_pylist()]
        return np.frombuffer(b"".join(parts), "<u4"), np.fromiter((len(x) >> 2 for x in parts), np.int64, len(parts))

    def spaced_counts(self, words: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Characters and tokens of the pre-tokens of " " + word, as spaced_ids."""
        ids, n = self.spaced_ids(words)
        buf, off = text_buffer(words)
        parts = self.split(np.insert(buf, off[:-1], 32).tobytes().decode())
        chars = np.fromiter(map(len, parts), np.int64, len(parts))
        size = np.fromiter((k if p.isascii() else len(p.encode()) for k, p in zip(chars.tolist(), parts)), np.int64, len(parts))
        ends = np.cumsum(size)
        at = np.cumsum(self.sizes[ids])
        cut, words_at = np.searchsorted(at, ends), np.searchsorted(ends, off[1:] + np.arange(1, len(off)))
        return (chars, np.diff(cut + 1, prepend=0)), np.diff(words_at + 1, prepend=0)

    def counts(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of each pre-token."""
        return (np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens)),
                np.fromiter((len(x) >> 2 for x in self.ids_of(pre_tokens)), np.int64, len(pre_tokens)))

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column (null is empty), one after the
        other, and the offsets of each."""
        def easy(words):
            ids, n = self.spaced_ids(words)
            return (ids,), n

        def one(ids: bytes):
            return (np.frombuffer(ids, "<u4"),)
        (ids,), off = self._by_words(column, easy, lambda w: one(self._after_space(w)),
                                     lambda w: one(b"".join(self.ids_of(self.split(w)))), lambda t: one(self.encode(t)), (np.uint32,))
        return ids, off

    def count_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and tokens of all pre-tokens of a string column (null is
        empty; special tokens are ordinary text), and the offsets of each text."""
        def easy(words):
            if self.ranked is not None and len(words):
                return self.spaced_counts(words)
            parts = [self.split(" " + w) for w in words.to_pylist()]
            return self.counts([p for own in parts for p in own]), np.array([len(own) for own in parts], np.int64)
        (chars, tokens), off = self._by_words(column, easy, lambda w: self.counts(self.split(" " + w)), lambda w: self.counts(self.split(w)),
                                              lambda t: self.counts(self.pre_tokens(t)), (np.int64, np.int64))
        return chars, tokens, off

    def _by_words(self, column: pa.Array, easy, rest, first, other, kinds):
        """Values of texts, from values of their distinct words (``easy`` takes
        all words after a space at once, ``rest`` one that ends in white space), of first
        words, and of ``other`` texts that cannot be cut at spaces."""
        column = column.fill_null("").cast(pa.large_string())
        texts = column.to_pylist()
        runs = _with_runs(*text_buffer(column))
        plain = [i for i, t in enumerate(texts) if t and not runs[i] and self.sure(t)]
        words = pc.split_pattern(column.take(pa.array(plain, pa.int64())), " ")
        per = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        ends_in_space = _ends_in_space(*text_buffer(distinct))
        values, n = easy(distinct.filter(pa.array(~ends_in_space)))
        # entries: distinct words after a space, then first words and the other texts by themselves
        held = set(plain)
        extra = [rest(w) for w in distinct.filter(pa.array(ends_in_space)).to_pylist()]
        extra += [first(t.split(" ", 1)[0]) if i in held else other(t) for i, t in enumerate(texts)]
        flat = [np.concatenate([v, *(x[k] for x in extra)]).astype(kind) for k, (v, kind) in enumerate(zip(values, kinds))]
        sizes = np.zeros(len(distinct) + len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(~ends_in_space), np.flatnonzero(ends_in_space), np.arange(len(distinct), len(sizes))])
        sizes[order] = np.concatenate([n, [len(x[0]) for x in extra]])
        starts = np.zeros(len(sizes), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        # one entry per word of a plain text (its first word by itself), one per other text
        count = np.ones(len(texts), np.int64)
        count[plain] = per
        begin = np.cumsum(count) - count
        entry = np.zeros(int(count.sum()), np.int64)
        if plain:
            where = np.repeat(begin[plain] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            entry[where] = coded.indices.to_numpy()
        entry[begin] = len(distinct) + np.arange(len(texts))
        many = sizes[entry]
        stop = np.cumsum(many)
        at = np.repeat(starts[entry] - (stop - many), many) + np.arange(int(stop[-1]) if len(stop) else 0)
        off = np.concatenate(([0], stop))
        return [f[at] for f in flat], off[np.append(begin, len(entry))]

    def whole(self, text: str) -> bytes:
        """Ids by the library alone, as little-endian 32-bit numbers."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def sure(self, text: str) -> bool:
        return not (_UNSURE.search(text) or any(s in text for s in self.special))

    def _pre_token(self, piece: str) -> bytes:
        letters = self.letters
        return array("I", [t.id for t in self.model.tokenize("".join([letters[b] for b in piece.encode()]))]).tobytes()

    def _after_space(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._pre_token(" " + piece)
        return b"".join(map(self.known.__getitem__, self.split(" " + piece)))

    def ids_of(self, pre_tokens: list[str]) -> list[bytes]:
        return list(map(self.known.__getitem__, pre_tokens))

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text; strings of special tokens are ordinary text."""
        if not _UNSURE.search(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        if not self.sure(text):
            return self.whole(text)
        if any(r in text for r in _RUNS) or text[:1] == " " or text[-1:] == " ":
            return b"".join(self.ids_of(self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(self.ids_of(self.split(first))) + b"".join(map(self.spaced.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
