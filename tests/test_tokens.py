"""Tokenize / truncate / pack: conservation and block edges."""
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import tokens as T


def _runs(spark, lens):
    rows = [(i, [f"t{i}_{j}" for j in range(n)]) for i, n in enumerate(lens)]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


def _check(spark, lens, block, shards, chunk, unique=False):
    b = T.pack(_runs(spark, lens), "id", "tokens", block=block, eos="E", shards=shards, chunk=chunk, unique=unique).collect()
    total = sum(lens) + len(lens)
    assert sum(r.n_tokens for r in b) == total
    per_shard = {}
    for r in b:
        per_shard.setdefault(r.shard, []).append(r)
    for rows in per_shard.values():
        rows.sort(key=lambda r: r.block)
        assert all(r.n_tokens == block for r in rows[:-1])
        assert 0 < rows[-1].n_tokens <= block
    # every run appears contiguous and in id order inside its shard
    flat = {s: [t for r in rows for t in r.tokens] for s, rows in per_shard.items()}
    for s, toks in flat.items():
        ids = [int(t[1:].split("_")[0]) for t in toks if t != "E"]
        assert ids == sorted(ids)


def test_pack_edges(spark):
    for lens in ([3, 4], [7], [8, 8, 0], [20, 1, 0, 5]):
        for chunk in (None, 1, 2):
            _check(spark, lens, 8, 2, chunk)
        _check(spark, lens, 8, 2, 2, unique=True)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.integers(1, 16), st.integers(1, 4))
def test_pack_conserves_tokens(spark, lens, block, shards):
    _check(spark, lens, block, shards, 3)


def test_truncate_mask(spark):
    df = _runs(spark, [0, 5, 600])
    r = {x.id: x for x in T.truncate_tokens(df, "tokens", 512).collect()}
    assert [len(r[i].tokens) for i in range(3)] == [0, 5, 512]
    assert r[2].attention_mask == [1] * 512 and r[0].attention_mask == []


def test_external_tokenizer_hook(spark):
    df = spark.createDataFrame([(1, "a bb ccc")], "id long, text string")

    def factory():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    out = T.tokenize(df, "text", "ids", factory=factory, key="len").first()
    assert out.ids == [1, 2, 3] and "text" not in out.asDict()


def test_training_input_ids_with_an_in_memory_vocabulary(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import WhitespaceSplit

    from corpusmill.plans.corpus_builder import training_input

    vocab = {"[UNK]": 0, "User:": 1, "Assistant:": 2, "hello": 3, "world": 4}

    def factory():
        tok = Tokenizer(WordLevel(vocab, unk_token="[UNK]"))
        tok.pre_tokenizer = WhitespaceSplit()
        return lambda texts: [e.ids for e in tok.encode_batch(texts)]

    recs = spark.createDataFrame([("hello", "world again")], "user_msg string, asst_msg string")
    ext = training_input(recs, 4, factory=factory, key="wordlevel").first()
    assert ext.input_ids == [1, 3, 2, 4] and ext.attention_mask == [1, 1, 1, 1]
    nat = training_input(recs, 512).first()
    assert nat.tokens == ["User:", "hello", "Assistant:", "world", "again"]
    assert len(nat.input_ids) == 5 and nat.input_ids[1] != nat.input_ids[3]
    assert all(0 <= i < (1 << 20) for i in nat.input_ids)


def test_pack_text_ids_conserves_tokens(spark):
    rows = [(f"{i % 7}-{i}", [f"t{i}"] * (i % 11)) for i in range(300)] + [(None, ["n", "n"])]
    df = spark.createDataFrame(rows, "id string, tokens array<string>")
    out = T.pack(df, "id", "tokens", block=16, shards=3, buckets=8).collect()
    got = sorted(t for r in out for t in r.tokens)
    assert got == sorted(t for _, ts in rows for t in [*ts, "</s>"])
    for shard in {r.shard for r in out}:
        sizes = [r.n_tokens for r in sorted((r for r in out if r.shard == shard), key=lambda r: r.block)]
        assert all(n == 16 for n in sizes[:-1])


def test_unique_ids_pack_like_any(spark):
    rows = [(f"{i % 7}-{i}", [f"t{i}_{j}" for j in range(i % 11)]) for i in range(120)] + [(None, ["n", "n"])]
    df = spark.createDataFrame(rows, "id string, tokens array<string>").repartition(3)
    key = lambda d: sorted((r.shard, r.block, r.tokens) for r in d.collect())
    plain = T.pack(df, "id", "tokens", block=16, shards=3, buckets=8)
    joined = T.pack(df, "id", "tokens", block=16, shards=3, buckets=8, unique=True)
    assert key(plain) == key(joined)
    assert T.pack(df.limit(0), "id", "tokens", buckets=8, unique=True).count() == 0


def test_a_repeated_id_fails_the_unique_pack(spark):
    import pytest
    for twice in ("a", None):
        df = spark.createDataFrame([(twice, ["x"]), (twice, ["y"]), ("b", ["z"])], "id string, tokens array<string>")
        with pytest.raises(Exception, match="occurs twice"):
            T.pack(df, "id", "tokens", block=4, shards=1, buckets=4, unique=True).collect()


def test_no_window_holds_token_arrays(spark):
    df = _runs(spark, [3, 4, 5])
    plan = T.pack(df, "id", "tokens", block=8, shards=2, unique=True)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and not any("_t#" in w for w in windows)
    # below the windows only sizes are read from the arrays
    assert "size(tokens" in plan


def test_external_tokenizers_get_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        df = spark.range(5000).selectExpr("id", "string(id) as text").coalesce(1)
        factory = lambda: lambda texts: [[len(texts)] for _ in texts]
        sizes = [r.ids[0] for r in T.tokenize(df, "text", "ids", factory=factory, key="sizes").collect()]
        assert len(sizes) == 5000 and max(sizes) <= 1000
    finally:
        spark.conf.set(key, old)
