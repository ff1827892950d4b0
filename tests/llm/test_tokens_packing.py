import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import edge_docs, near_docs, no_docs
from corpusmill.llm import packing as P
from corpusmill.llm import token_tree as T
from corpusmill.llm.token_ids import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the ", " of", "\n", "  ", " \n ", "'s", "don't", "12", "é", "ß x", "...", "   ", "<|endoftext|>", "日本", " ", "a", "\x1c", "\xa0"]


@pytest.fixture(scope="module")
def enc():
    return Encoder(PATH)


def test_ids_equal_the_library(enc):
    rng = random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))
        assert enc.encode(t) == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def library_ids(enc, texts):
    return [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def batch_ids(enc, texts):
    ids, off = enc.encode_batch(pa.array(texts, pa.string()))
    assert len(off) == len(texts) + 1 and off[0] == 0 and off[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(off, off[1:])]


@pytest.mark.parametrize("ranked", [True, False])
def test_batches_of_texts_have_the_library_s_ids(ranked):
    enc = Encoder(PATH)
    assert enc.ranked is not None
    if not ranked:
        enc.ranked = None                    # files whose merges are not in the order of their ids
    rng = random.Random(6)
    for _ in range(120):
        texts = ["".join(rng.choice(PARTS + [" '", " 's", "\t", "x\n", "word" + str(rng.randrange(50))]) for _ in range(rng.randrange(12)))
                 for _ in range(rng.randrange(25))] + [None] * rng.randrange(2)
        assert batch_ids(enc, texts) == library_ids(enc, texts), texts
    for texts in ([], [""], [None, None], [" "], ["a\n"], ["a b\xa0", "b\x0b c"], ["one"], ["x " * 3000 + "end"], ["\u0130stanbul \u01c5 \u0149x"]):
        assert batch_ids(enc, texts) == library_ids(enc, texts), texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0x2FF), max_size=30), max_size=6))
def test_any_latin_batch_has_the_library_s_ids(texts):
    from corpusmill.llm.token_ids import encoder
    enc = encoder(PATH)
    assert batch_ids(enc, texts) == library_ids(enc, texts)


@pytest.mark.parametrize("ranked", [True, False])
def test_batch_counts_are_those_of_each_text(ranked):
    enc, plain = Encoder(PATH), Encoder(PATH)
    if not ranked:
        enc.ranked = None
    rng = random.Random(9)
    for _ in range(60):
        texts = ["".join(rng.choice(PARTS + ["x\n", "\t"]) + rng.choice(["", f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(20)))
                 for _ in range(rng.randrange(20))] + [None]
        chars, tokens, off = enc.count_batch(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, off, off[1:]):
            parts = plain.pre_tokens(t or "")
            assert chars[a:b].tolist() == [len(p) for p in parts]
            assert tokens[a:b].tolist() == [len(x) >> 2 for x in plain.ids_of(parts)]


def test_tree_counts_equal_whole_counts_after_edits():
    enc = Encoder(PATH)
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    full = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    rng = random.Random(5)
    for _ in range(80):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(400)))
        tree = T.DocumentTree.build(t, enc)
        assert tree.count == full(t)
        for _ in range(5):
            at, gone = rng.randrange(len(t) + 3), rng.choice([0, 0, 1, 3, 50, 500])
            new = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 300])))
            tree.edit(at, gone, new, enc)
            t = t[:min(at, len(t))] + new + t[min(at, len(t)) + gone:]
            assert tree.text == t and tree.count == full(t) and tree.chars[1] == len(t)


def test_small_edit_encodes_little(enc):
    tree = T.DocumentTree.build("some words here " * 20_000, enc)
    assert tree.edit(100_000, 3, "xyz", enc) < 10 * T.LEAF


def test_edits_of_a_table(spark):
    out = T.apply_edits(T.revision(T.build_trees(edge_docs(spark), PATH)), PATH).collect()
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    assert len(out) == edge_docs(spark).count()
    for r in out:
        assert r.n_tokens == len(plain.encode(r.text, add_special_tokens=False).ids)
    assert T.apply_edits(T.revision(T.build_trees(no_docs(spark), PATH)), PATH).count() == 0


def _best(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, bins + [items[i]])
    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(1)
    for _ in range(400):
        capacity = int(rng.integers(5, 25))
        items = rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist()
        count = np.bincount(items, minlength=capacity + 1)
        used = sum(n for _, n in P.reduce_instance(count, capacity))
        rest = [w for w in range(capacity + 1) for _ in range(count[w])]
        assert used + (_best(rest, capacity) if rest else 0) == _best(items, capacity)


def test_plan_is_gapless_and_complete():
    rng = np.random.default_rng(4)
    for _ in range(200):
        items = rng.integers(1, 33, rng.integers(1, 60)).tolist()
        seats = defaultdict(list)
        ranks = defaultdict(set)
        for length, first, copies, times, seq, off in P.plan({int(k): int(v) for k, v in zip(*np.unique(items, return_counts=True))}, 32):
            for k in range(copies * times):
                seats[seq + k % times].append((off + length * (k // times), length))
                ranks[length].add(first + k)
        assert all(ranks[w] == set(range(items.count(w))) for w in set(items))
        for s in seats.values():
            end = 0
            for off, length in sorted(s):
                assert off == end
                end += length
            assert end <= 32


def _check(df, out, capacity=2048):
    lib = Tokenizer.from_file(PATH)
    seats, by = defaultdict(list), defaultdict(list)
    for r in out:
        seats[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for s in seats.values():
        end = 0
        for off, length in sorted(s):
            assert off == end
            end += length
        assert end <= capacity
    want = defaultdict(list)
    for doc, text in df:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        size, start, k = len(ids) % capacity or min(len(ids), capacity), 0, 0
        while start < len(ids):
            want[doc].append((k, start, size, zlib.crc32(np.array(ids[start:start + size], "<u4").tobytes())))
            start, size, k = start + size, capacity, k + 1
    assert {d: sorted(x) for d, x in want.items()} == {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in x) for d, x in by.items()}


def test_pack_round_trip(spark):
    rows, df = near_docs(spark, 2)
    out = P.pack(df, PATH, capacity=64).collect()
    _check(rows, out, 64)
    assert len({r.sequence_id for r in out}) <= 1.02 * -(-sum(r.length for r in out) // 64) + 1
    seqs = {r.sequence_id: r.ids for r in P.sequences(df, PATH, capacity=64).collect()}
    lib = Tokenizer.from_file(PATH)
    total = sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(map(len, seqs.values())) == total and max(map(len, seqs.values())) <= 64


def test_pack_edges(spark):
    _check([(r.doc_id, r.text) for r in edge_docs(spark).collect()], P.pack(edge_docs(spark), PATH).collect())
    assert P.pack(no_docs(spark), PATH).count() == 0
