"""Unicode parity of the text functions with the Python expressions they stand for."""
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.constants import LATIN_CLASS
from corpusmill.operators import clean, tokens

WS_ALL = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
ALPHABET = WS_ALL + "aZé中😀[]()c\n\r. -'"


def _one(spark, value, expr_fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr_fn(F.col("v")).alias("o")).first().o


def test_ws_set_is_pythons():
    assert X.WS_CHARS == WS_ALL and len(WS_ALL) == 29


def test_ws_all_strip_key(spark):
    s = "".join(f"{w}x{i}" for i, w in enumerate(WS_ALL)) + WS_ALL
    df = spark.createDataFrame([(WS_ALL + s,)], "v string")
    r = df.select(X.strip("v").alias("s"), X.remove_ws("v").alias("r"),
                  X.dedupe_key("v", prefix_len=1000).alias("k")).first()
    assert r.s == (WS_ALL + s).strip()
    assert r.r == re.sub(r"\s+", "", WS_ALL + s)
    assert r.k == re.sub(r"\s+", "", WS_ALL + s).lower()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=40))
def test_strip_key_tokens_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", X.strip("v").alias("s"), X.dedupe_key("v").alias("k"),
                     X.dedupe_key("v", casefold=False).alias("k2"),
                     tokens.native_tokens("v").alias("t")).collect()
    for r in rows:
        assert r.s == r.v.strip()
        assert r.k == re.sub(r"\s+", "", r.v).lower()[:80]
        assert r.k2 == re.sub(r"\s+", "", r.v)[:80]
        assert list(r.t) == r.v.split()


def test_clip_edges(spark):
    vals = ["a" * n for n in (1399, 1400, 1401, 1499, 1500, 1501, 29, 30)] + ["😀" * 1501]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select("v", X.clip("v", 1400).alias("h"),
                     X.clip("v", 1400, threshold=1500, suffix="...").alias("m"),
                     X.clip("v", 300, suffix="…").alias("l")).collect()
    for r in rows:
        assert r.h == r.v[:1400]
        assert r.m == (r.v[:1400] + "..." if len(r.v) > 1500 else r.v)
        assert r.l == r.v[:300] + "…"


def test_hash_bucket_deterministic_and_spread(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("v"))
    b = df.select(X.hash_bucket("v", 7).alias("b")).groupBy("b").count().collect()
    counts = sorted(r["count"] for r in b)
    assert len(counts) == 7 and counts[0] > 200
    import hashlib
    for v in ("0", "abc", "中文"):
        exp = int(hashlib.md5(v.encode()).hexdigest()[:8], 16) % 7
        assert _one(spark, v, lambda c: X.hash_bucket(c, 7)) == exp


# text, without bracketed notes and copyright tails, without brackets, parentheses and bracket-led lines
CLEANED = [
    ("[12] Plain words [note] stay (c) 1999 someone\nsecond [x] line",
     " Plain words  stay \nsecond  line", " Plain words  stay  1999 someone\nsecond  line"),
    ("  (aside) whole line goes\nkept (in part)", "  (aside) whole line goes\nkept (in part)", "\nkept "),
    ("open [ and\n] closed", "open [ and\n] closed", "open [ and\n] closed"),
    ("a\r[b\rc] d (c) tail\u2028more\x85end", "a\r d ", "a\r d  tail\u2028more\x85end"),
    ("nothing here", "nothing here", "nothing here"),
]


def test_clean_brackets_and_parens(spark):
    df = spark.createDataFrame([(v,) for v, _, _ in CLEANED], "v string")
    rows = df.select("v", X.clean_brackets("v").alias("a"), X.clean_parens("v").alias("b")).collect()
    assert sorted((r.v, r.a, r.b) for r in rows) == sorted(CLEANED)


def test_split_paragraphs_like_python(spark):
    texts = ["a" * 70 + "\n\n" + "b" * 10 + "\n\n\n\n  " + "c" * 61 + "  ", "", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    out = clean.split_paragraphs(df, "t", "\n\n", 60, keep=["id"]).orderBy("id", "pos").collect()
    exp = [(i, p.strip()) for i, t in enumerate(texts) for p in t.split("\n\n") if len(p.strip()) > 60]
    assert [(r.id, r.paragraph) for r in out] == exp


def test_cjk_and_latin_classes(spark):
    from corpusmill.functions.constants import CJK_CLASS
    from corpusmill.operators.filters import script_filter
    cands = ["山" * 20, "山" * 21, "山" * 20 + "'", "山" * 20 + '"', "山" * 20 + "　",
             "山" * 20 + "「", "山" * 20 + "1", "山，。？！；：、（）《》-" * 2]
    df = spark.createDataFrame([(c,) for c in cands], "v string")
    got = {r.v for r in script_filter(df, "v", CJK_CLASS, 21).collect()}
    exp = {"山" * 21, "山" * 20 + "'", "山" * 20 + "　", "山，。？！；：、（）《》-" * 2}
    assert got == exp
    lat = spark.createDataFrame([("Hello, world. It's fine-ish",), ("no; semicolons here ok",)], "v string")
    assert [r.v for r in script_filter(lat, "v", LATIN_CLASS, 21).collect()] == ["Hello, world. It's fine-ish"]


def test_html_escape_and_after_last(spark):
    assert _one(spark, "<a & b>", X.html_escape) == "&lt;a &amp; b&gt;"
    assert _one(spark, "x Assistant: one Assistant:  two ", lambda c: X.after_last(c, "Assistant:")) == "two"
    assert _one(spark, "  no marker ", lambda c: X.after_last(c, "Assistant:")) == "no marker"
