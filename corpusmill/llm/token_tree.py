"""Edit-aware token counts: a segment tree over pre-tokens per document.

A document's pre-tokens are grouped into leaves; a binary tree holds the
characters and tokens below each node. An edit finds its leaves by descending
the tree, re-encodes only these leaves and one leaf of context on either side
(more where the cut into pre-tokens has not met the old one again), writes the
new counts into the same leaves and updates the sums above them. Tokens of
different pre-tokens never depend on each other, so the root always equals the
count of the whole text.

Trees are columns of a DataFrame next to the text, so a corpus keeps them in a
table. Strings of special tokens are ordinary text. Nulls: a null text is
empty (0 tokens); null edits, or parts of one, change nothing; offsets beyond
the text are its end. Rows that repeat are counted each; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, pieces
from corpusmill.llm.token_ids import encoder

LEAF = 32                 # pre-tokens per leaf when a tree is built
CONTEXT = 8               # characters of context at least, before an edit
SLICE = 128
EDIT = "struct<at: int, removed: int, inserted: string>"
TREE = "doc_id long, text string, chars array<int>, tokens array<int>"


class DocumentTree:
    """Sums in heap order: node 1 is the root, leaves start at ``base``."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.chars, self.tokens = text, chars, tokens
        self.base = len(chars) // 2

    @classmethod
    def build(cls, text: str, enc) -> DocumentTree:
        return cls._of(text, *_leaves(*_counts(text, enc)))

    @classmethod
    def _of(cls, text, chars, tokens):
        base = 1 << max(0, len(chars) - 1).bit_length()
        trees = []
        for leaf in (chars, tokens):
            t = np.zeros(2 * base, np.int64)
            t[base:base + len(leaf)] = leaf
            step = base
            while step > 1:
                t[step // 2:step] = t[step:2 * step:2] + t[step + 1:2 * step:2]
                step //= 2
            trees.append(t)
        return cls(text, *trees)

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> int:
        """The leaf that holds a character; the last one for the text's end."""
        node = 1
        while node < self.base:
            node *= 2
            if place >= self.chars[node]:
                if not self.chars[node + 1]:          # nothing to the right
                    continue
                place -= int(self.chars[node])
                node += 1
        return node - self.base

    def start_of(self, leaf: int) -> int:
        """Characters before a leaf."""
        node, total = leaf + self.base, 0
        while node > 1:
            if node % 2:
                total += int(self.chars[node - 1])
            node //= 2
        return total

    def edit(self, at: int, removed: int, inserted: str, enc) -> int:
        """Replace characters; returns the number of pre-tokens encoded again."""
        at = min(max(at, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - at)
        if not removed and not inserted:
            return 0
        lo, hi = self.leaf_at(at), self.leaf_at(at + removed)
        start = self.start_of(lo)
        while lo and at - start < CONTEXT:
            lo -= 1
            start -= int(self.chars[self.base + lo])
        new = self.text[:at] + inserted + self.text[at + removed:]
        grown = len(inserted) - removed
        hi = min(hi + 1, self.base - 1)
        while True:
            end = self.start_of(hi) + int(self.chars[self.base + hi]) + grown
            ahead = len(new)
            if end < len(new):                         # look past the region, to cut its last pre-token rightly
                nxt, ahead = hi + 1, end
                while nxt < self.base and ahead - end < CONTEXT:
                    ahead += int(self.chars[self.base + nxt])
                    nxt += 1
            chars, tokens = _counts(new[start:ahead], enc)
            stop = np.cumsum(chars)
            if end == len(new):
                k = len(chars)
                break
            k = int(np.searchsorted(stop, end - start)) + 1
            if k <= len(stop) and stop[k - 1] == end - start and ahead - end >= min(CONTEXT, len(new) - end):
                break
            hi = min(2 * hi - lo + 1, self.base - 1)    # not in step with the old cut yet
        chars, tokens = chars[:k], tokens[:k]
        self.text = new
        leaves = hi - lo + 1
        if k > 4 * LEAF * leaves:                      # too much for these leaves: new leaves
            own = slice(self.base, 2 * self.base)
            c, t = _leaves(chars, tokens)
            old = self.chars[own], self.tokens[own]
            fresh = self._of(new, *(np.concatenate((o[:lo], x, o[hi + 1:])) for o, x in zip(old, (c, t))))
            self.chars, self.tokens, self.base = fresh.chars, fresh.tokens, fresh.base
            return k
        share = np.arange(k) * leaves // max(k, 1)
        for tree, x in ((self.chars, chars), (self.tokens, tokens)):
            tree[self.base + lo:self.base + hi + 1] = np.bincount(share, x, leaves).astype(np.int64) if k else 0
        a, b = (self.base + lo) // 2, (self.base + hi) // 2
        while a:                                       # sums above the changed leaves
            for tree in (self.chars, self.tokens):
                tree[a:b + 1] = tree[2 * a:2 * b + 2:2] + tree[2 * a + 1:2 * b + 2:2]
            a, b = a // 2, b // 2
        return k


def _counts(text: str, enc) -> tuple[np.ndarray, np.ndarray]:
    """(characters, tokens) of each pre-token."""
    return enc.counts(enc.pre_tokens(text))


def _leaves(chars, tokens):
    cut = np.arange(0, len(chars), LEAF)
    return (np.add.reduceat(chars, cut), np.add.reduceat(tokens, cut)) if len(cut) else (np.zeros(1, np.int64),) * 2


def _lists(values, kind):
    off = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def build_trees(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, chars, tokens): the trees of whole texts."""
    src = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))

    def work(batches):
        enc = encoder(tokenizer)
        for part in pieces(batches):
            texts = part["text"].fill_null("")
            chars, tokens, off = enc.count_batch(texts)        # distinct words of the whole part once
            trees = [DocumentTree._of("", *_leaves(chars[a:b], tokens[a:b])) for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([part["doc_id"], texts,
                                              _lists([t.chars for t in trees], pa.int32()),
                                              _lists([t.tokens for t in trees], pa.int32())], ["doc_id", "text", "chars", "tokens"])

    return src.mapInArrow(work, TREE)


def apply_edits(trees: DataFrame, tokenizer: str, edits: str = "edits") -> DataFrame:
    """Trees with a column of edits (array of at, removed, inserted; offsets in
    characters of the text as the edits before have left it) -> the new trees,
    n_before, n_tokens, n_edits and n_encoded (pre-tokens encoded again)."""
    src = trees.select("doc_id", "text", "chars", "tokens", F.col(edits).cast(f"array<{EDIT}>").alias("edits"))

    def work(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                out, stats = [], []
                for text, c, t, todo in zip(part["text"].to_pylist(), part["chars"], part["tokens"], part["edits"].to_pylist()):
                    tree = DocumentTree(text or "", *(x.values.to_numpy().astype(np.int64) if x.is_valid else np.zeros(2, np.int64) for x in (c, t)))
                    before, k, n = tree.count, 0, 0
                    for e in todo or ():
                        if e is not None:
                            k += tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "", enc)
                            n += 1
                    out.append(tree)
                    stats.append((before, tree.count, n, k))
                cols = list(zip(*stats)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([t.text for t in out], pa.string()), _lists([t.chars for t in out], pa.int32()),
                     _lists([t.tokens for t in out], pa.int32()), *[pa.array(list(x), pa.int64()) for x in cols]],
                    ["doc_id", "text", "chars", "tokens", "n_before", "n_tokens", "n_edits", "n_encoded"])

    return src.mapInArrow(work, TREE + ", n_before long, n_tokens long, n_edits long, n_encoded long")


def revision(trees: DataFrame) -> DataFrame:
    """A second version of every text, as edits that its own characters give:
    20 characters go at a third, the first 24 are pasted upside down in the
    middle, and 12 at three quarters are written in capitals."""
    n = F.length("text")
    edit = lambda at, removed, inserted: F.struct(at.cast("int").alias("at"), F.lit(removed).alias("removed"), inserted.alias("inserted"))
    return trees.withColumn("edits", F.array(
        edit(F.floor(n / 3), 20, F.lit("")),
        edit(F.floor(n / 2), 0, F.reverse(F.substring("text", 1, 24))),
        edit(F.floor(n * 3 / 4), 12, F.upper(F.substring(F.col("text"), F.floor(n * 3 / 4).cast("int") + 1, F.lit(12))))))
