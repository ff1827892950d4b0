"""Source registry (E1), crawl paragraphs, file preview (T2), HTML error split."""
import pytest
from pyspark.sql import functions as F

from corpusmill.session import scratch_dir
from corpusmill.sources import html as H
from corpusmill.sources import jsonl as J
from corpusmill.sources import registry as REG
from corpusmill.sources.crawl import crawl_paragraphs


def test_registry_order_unknown_and_schema(spark):
    @REG.register("t_a")
    def _a(spark):
        return spark.createDataFrame([("a", "1", "en", "x")], "source string, text_id string, language string, content string")

    @REG.register("t_b")
    def _b(spark):
        return spark.createDataFrame([("b", "2", "en", "y")], "source string, text_id string, language string, content string")

    @REG.register("t_bad")
    def _bad(spark):
        return spark.createDataFrame([("b", 2)], "source string, text_id int")

    u = REG.build_sources(spark, ["t_b", "nope", "t_a", "t_b"])
    assert sorted((r.source, r.source_rank) for r in u.collect()) == [("a", 1), ("b", 0)]
    with pytest.raises(ValueError):
        REG.build_sources(spark, ["t_bad"])
    with pytest.raises(ValueError):
        REG.build_sources(spark, ["nope"])


def test_crawl_paragraphs_cleanup_split_cap(spark):
    body = "".join(f"<p>paragraph number {i} with enough words to pass (note) [ref]</p>" for i in range(60))
    page = f"<html><body><nav>[menu] x</nav>{body}</body></html>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    rows = crawl_paragraphs(df, separator="\n", para_sep="\n", min_len=30, cap=50).orderBy("pos").collect()
    assert len(rows) == 50
    assert rows[0].paragraph == "paragraph number 0 with enough words to pass"


def test_preview_lines_physical_order(spark):
    path = scratch_dir(spark, "preview")
    recs = spark.createDataFrame([(i, f"record {i}") for i in range(100)], "ord long, text string")
    recs.repartitionByRange(5, "ord").sortWithinPartitions("ord").write.json(path)
    got = [r.preview for r in J.preview_lines(spark, path, 3, 8).collect()]
    assert got == ["record 0", "record 1", "record 2"]


def test_html_errors_split(spark):
    df = spark.createDataFrame([(1, "<p>ok</p>"), (2, None)], "page_id long, html string")
    assert H.html_errors(df).count() == 0
    assert H.html_passages(df, "p").count() == 1
    r = H._safe("<p>x</p>", 123, "div", "main", "\n", "p", "description")   # selector of a wrong type
    assert r["error"] is not None and r["passages"] is None


SEL = "div.verse, p.line, .block"


def test_selected_source_cjk_whitelist_and_cap(spark, tmp_path):
    ok1, ok2 = "山" * 21, "水，石。" * 6
    bad_short, bad_quote = "山" * 20, "山" * 21 + '"'
    page0 = (f"<body><div class='verse'>{ok1}</div><p class='line'>{bad_short}</p>"
             f"<span class='block'>{bad_quote}</span><p class='line'>{ok2}</p></body>")
    page1 = f"<body><div class='block'>{ok2}</div><p class='x'>{ok1}</p></body>"
    d = str(tmp_path)
    spark.createDataFrame([(0, page0), (1, page1)], "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    from corpusmill.sources.builtin import selected
    got = [(r.text_id, r.content) for r in selected(spark, d, selectors=SEL).orderBy("doc_ord", "pos").collect()]
    assert got == [("0-0", ok1), ("0-3", ok2), ("1-0", ok2)]
    capped = [(r.text_id) for r in selected(spark, d, selectors=SEL, cap=2).orderBy("doc_ord", "pos").collect()]
    assert capped == ["0-0", "0-3"]


def test_abstracts_source_through_the_registry(spark):
    from corpusmill.plans.corpus_builder import build_corpus_from_sources
    from corpusmill.sources import builtin  # noqa: F401
    path = scratch_dir(spark, "abstracts-src")
    spark.createDataFrame([("T one", "An abstract long enough to keep as a passage.", "J1", "cc_by"),
                           ("T two", "short", "J2", "cc_by")],
                          "title string, abstract string, source string, license string").write.json(path)
    c = build_corpus_from_sources(spark, ["abstracts"], {"abstracts": {"path": path}}, seed=None)
    rows = c.collect()
    assert len(rows) == 2                                    # nothing is cut or dropped by default
    r = next(r for r in rows if "long enough" in r.instruction)
    assert r.source == "academic_abstracts" and r.instruction.endswith("\n\nAn abstract long enough to keep as a passage.")
    assert r.response.startswith("A short commentary: An abstract long")


def test_described_source_summary_pairs(spark, tmp_path):
    from corpusmill.plans.corpus_builder import build_corpus_from_sources
    from corpusmill.sources import builtin  # noqa: F401
    long_meta, long_p = "m" * 41, "p" * 41
    pages = [
        (1, f"<head><title>First film</title><meta name='description' content='{long_meta}'></head>"),
        (2, f"<head><title>Second</title><meta name='description' content=''></head>"
            f"<body><p class='description'>{long_p}</p></body>"),
        (3, "<head><title>Short</title><meta name='description' content='too short'></head>"),
        (4, "<head><title>None</title></head><body><p>no description</p></body>"),
    ]
    d = str(tmp_path)
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    rows = build_corpus_from_sources(spark, ["described"], {"described": {"data_dir": d}}, seed=None) \
        .orderBy("ord").collect()
    assert [(r.instruction, r.response) for r in rows] == [
        ("What is covered in 'First film'?", f"'First film' covers: {long_meta}"),
        ("What is covered in 'Second'?", f"'Second' covers: {long_p}"),
    ]


def test_abstracts_of_one_title_are_told_apart(spark):
    from corpusmill.plans.corpus_builder import build_corpus_from_sources
    from corpusmill.sources import builtin, registry  # noqa: F401
    path = scratch_dir(spark, "abstracts-title")
    rows = [("Same", "first abstract", "J1", "cc_by"), ("Same", "second abstract", "J1", "cc_by"), ("Same", "first abstract", "J1", "cc_by")]
    spark.createDataFrame(rows, "title string, abstract string, source string, license string").write.json(path)
    items = registry.build_sources(spark, ["abstracts"], {"abstracts": {"path": path}})
    assert {"license", "attribution"} <= set(items.columns)
    assert build_corpus_from_sources(spark, ["abstracts"], {"abstracts": {"path": path}}, seed=None).count() == 2


def test_ord_outside_its_ranges_fails(spark):
    import pytest
    from corpusmill.sources.tables import make_ord
    ok = spark.createDataFrame([(126, (1 << 36) - 1, (1 << 20) - 1)], "r long, d long, p long").select(make_ord("r", "d", "p").alias("o")).first().o
    assert ok > 0
    for bad in ((0, 1 << 36, 0), (0, 0, 1 << 20), (128, 0, 0), (None, 0, 0), (0, -1, 0), (0, None, 0)):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([bad], "r long, d long, p long").select(make_ord("r", "d", "p").alias("o")).collect()


def test_only_unknown_sources_fall_to_the_seeds(spark):
    from corpusmill.plans.corpus_builder import build_corpus_from_sources
    seed = spark.createDataFrame([(1, "q", "a")], "seed_id long, instruction string, response string")
    assert [r.instruction for r in build_corpus_from_sources(spark, ["nowhere"], {}, seed).collect()] == ["q"]


def test_a_key_listed_twice_in_a_dimension_fails(spark):
    import pytest
    from corpusmill.operators import pairs
    df = spark.createDataFrame([("s",)], "source string")
    dim = spark.createDataFrame([("s", "a"), ("s", "b")], "source string, license string")
    assert pairs.with_provenance(df, dim.limit(1)).first().license in ("a", "b")
    with pytest.raises(Exception, match="duplicate source"):
        pairs.with_provenance(df, dim).collect()
