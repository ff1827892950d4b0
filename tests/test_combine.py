"""First-wins dedupe, seed floor, caps, union, licence policy."""
import re

from pyspark.sql import functions as F

from corpusmill.functions.text import dedupe_key
from corpusmill.operators import combine, dedupe, policy, report, score
from corpusmill.sources.tables import make_ord

DUP = [  # (ord, instruction)
    (5, "Hello  World and more"), (1, "hello world AND MORE"), (3, "x" * 85 + "tail1"),
    (2, "x" * 85 + "tail2"), (4, "Hello　World and more"), (6, None), (7, ""),
]


def _py_first_wins(rows, casefold=True):
    seen, out = set(), []
    for o, i in sorted(rows):
        k = re.sub(r"\s+", "", i or "")
        k = (k.lower() if casefold else k)[:80]
        if k not in seen:
            seen.add(k)
            out.append(o)
    return out


def test_first_wins_and_partition_invariance(spark):
    df = spark.createDataFrame(DUP, "ord long, instruction string")
    for casefold in (True, False):
        exp = sorted(_py_first_wins(DUP, casefold))
        for parts in (1, 3, 7):
            d = df.repartition(parts)
            for strategy in ("window", "semi"):
                got = sorted(r.ord for r in dedupe.dedupe_first(d, dedupe_key("instruction", casefold, prefix_len=80),
                                                                strategy=strategy).collect())
                assert got == exp


def test_dedupe_idempotent(spark):
    df = spark.createDataFrame(DUP, "ord long, instruction string")
    once = dedupe.dedupe_first(df, dedupe_key("instruction"))
    twice = dedupe.dedupe_first(once, dedupe_key("instruction"))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_report_counts(spark):
    df = spark.createDataFrame([(o, i, "s%d" % (o % 2), i or "") for o, i in DUP],
                               "ord long, instruction string, source string, text string")
    rows = {r.source: r for r in report.collection_report(df, dedupe_key("instruction", prefix_len=80)).collect()}
    assert sum(r.n_collected for r in rows.values()) == len(DUP)
    assert sum(r.n_kept for r in rows.values()) == len(_py_first_wins(DUP))


def _seed(spark, n=3):
    return spark.createDataFrame([(i, f"seed q{i}", f"seed a{i}") for i in range(n)],
                                 "seed_id long, instruction string, response string")


def _collected(spark, n):
    return spark.range(n).select(F.lit("q").alias("instruction"), F.lit("a").alias("response"),
                                 make_ord(F.lit(0), "id").alias("ord"))


def test_floor_modes(spark):
    seed = _seed(spark)
    assert combine.with_floor(_collected(spark, 0), seed, "if_below", 20).count() == 3
    assert combine.with_floor(_collected(spark, 19), seed, "if_below", 20).count() == 22
    assert combine.with_floor(_collected(spark, 20), seed, "if_below", 20).count() == 20
    assert combine.with_floor(_collected(spark, 20), seed, "always").count() == 23
    # seeds sort after every collected row
    rows = combine.with_floor(_collected(spark, 2), seed, "always").orderBy("ord").collect()
    assert [r.instruction for r in rows][-3:] == ["seed q0", "seed q1", "seed q2"]


def test_caps(spark):
    df = spark.createDataFrame([(g, o) for g in ("a", "b") for o in range(10)], "g string, ord long")
    got = combine.cap_per_group(df, "g", 3).collect()
    assert sorted((r.g, r.ord) for r in got) == [(g, o) for g in ("a", "b") for o in range(3)]
    assert [r.ord for r in combine.cap_total(df.where("g = 'b'"), 4).collect()] == [0, 1, 2, 3]


def test_licence_policy(spark):
    pol = policy.policy_table(spark)
    df = spark.createDataFrame([(1, "public_domain"), (2, "proprietary"), (3, "research_only"),
                                (4, "fair_use_summary"), (5, "cc_by")], "id long, license_type string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(policy.license_filter(df, pol, commercial=False)) == [1, 3, 4, 5]
    assert ids(policy.license_filter(df, pol, commercial=True)) == [1, 4, 5]
    assert ids(policy.license_filter(df, pol, commercial=True, unknown="deny")) == [1, 5]
    assert ids(policy.license_filter(df, pol, check=False)) == [1, 2, 3, 4, 5]
    rej = {(r.source, r.reason): r.n_rejected for r in policy.license_rejects(
        df.withColumn("source", F.lit("s")), pol, commercial=True).collect()}
    assert rej == {("s", "scraping_not_permitted"): 1, ("s", "commercial_use_prohibited"): 1}


def test_texts_are_not_dealt_out_by_licence_or_source(spark):
    from corpusmill.operators import pairs
    # nearly all rows have one licence and one source: no task may read all of them
    df = spark.createDataFrame([(i, "cc_by", "s", "text") for i in range(50)] + [(50, None, None, "text"), (51, "unheard_of", "t", "text")],
                               "id long, license_type string, source string, content string")
    dim = spark.createDataFrame([("s", "x")], "source string, license string")
    for out in (policy.license_filter(df, policy.policy_table(spark), commercial=True), pairs.with_provenance(df, dim)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(license_type" not in plan and "hashpartitioning(source#" not in plan.split("BroadcastExchange")[0]
        assert sorted(r.id for r in out.collect()) == list(range(52))


def test_alignment_score_empty_category_is_null(spark):
    df = spark.createDataFrame([(1, "Water flows like WATER; the valley spirit")], "id long, r string")
    cats = {"nature": ["water", "valley spirit", "uncarved block"], "none": []}
    got = {r.category: r.score for r in score.alignment_score(df, "r", cats, keep=["id"]).collect()}
    assert abs(got["nature"] - 2 / 3) < 1e-12 and got["none"] is None


def test_two_level_caps_equal_plain(spark):
    df = spark.range(0, 5000, 1, 12).select(((F.col("id") * 7919) % 5000).alias("ord"),
                                            (F.col("id") % 3).alias("g"))
    for g in (None, 2, 5):
        assert [r.ord for r in combine.cap_total(df, 7, fanout=g).collect()] == list(range(7))
        got = sorted((r.g, r.ord) for r in combine.cap_per_group(df, "g", 4, fanout=g).collect())
        exp = sorted((k, o) for k in range(3) for o in sorted(o for o in range(5000)
                                                             if ((o * pow(7919, -1, 5000)) % 5000) % 3 == k)[:4])
        assert got == exp


def test_whole_keys_keep_texts_that_differ_late(spark):
    rows = [(1, "same start " * 20 + "one"), (2, "same start " * 20 + "two"), (3, "SAME start " * 20 + " one")]
    df = spark.createDataFrame(rows, "ord long, instruction string")
    kept = lambda **k: sorted(r.ord for r in dedupe.dedupe_first(df, dedupe_key("instruction", **k), hash_key=True).collect())
    assert kept() == [1, 2] and kept(prefix_len=80) == [1]


def test_conversation_chunks_join_to_the_text(spark):
    from corpusmill.operators import chat
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(10)] + [(2, 0, "system", "s")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r.text for r in chat.render_conversations(conv, chunk_turns=3).collect()}
    parts = {}
    for r in sorted(chat.render_conversations(conv, chunk_turns=3, assemble=False).collect(),
                    key=lambda r: (r.conv_id, r.chunk)):
        parts.setdefault(r.conv_id, []).append(r.text)
    assert {k: "\n\n".join(v) for k, v in parts.items()} == whole
    assert whole[1].startswith("User: m0\n\nAssistant: m1") and whole[2] == "System: s"


def test_generation_prompt_styles(spark):
    from corpusmill.operators import chat
    df = spark.createDataFrame([(1,)], "id long")
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.lit("Q?").alias("content")))
    m = {"start": "<s>", "role_sep": "\n", "end": "</s>\n"}
    r = df.select(chat.render_chat(msgs, "plain", add_generation_prompt=True).alias("p"),
                  chat.render_chat(msgs, "template", add_generation_prompt=True, markers=m).alias("t")).first()
    assert r.p == "User: Q?\n\nAssistant:"
    assert r.t == "<s>user\nQ?</s>\n<s>assistant\n"


def test_mark_first_flags_the_winners(spark):
    df = spark.createDataFrame(DUP, "ord long, instruction string")
    flagged = {r.ord: r.kept for r in dedupe.mark_first(df, dedupe_key("instruction", prefix_len=80)).collect()}
    winners = set(_py_first_wins(DUP))
    assert flagged == {o: (o in winners) for o, _ in DUP}
