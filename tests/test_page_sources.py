"""Page sources that share one parse, the floor of one pass, ranges without sampling, counters."""
import glob
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill import cli
from corpusmill.functions import constants as K
from corpusmill.plans import corpus_builder as CB
from corpusmill.session import local_path, path_exists, scratch_dir
from corpusmill.sources import builtin  # noqa: F401
from corpusmill.sources import html as H
from corpusmill.sources import pages as P
from corpusmill.sources import registry as REG
from corpusmill.sources import sinks as S
from corpusmill.sources.tables import SEED_RANK, make_ord, read_table

CHOSEN = ["crawl", "selected", "described"]


def params(d, **more):
    own = {"selected": {"selectors": "p", "char_class": K.LATIN_CLASS}}
    return {n: {"data_dir": d, **own.get(n, {}), **more.get(n, {})} for n in CHOSEN}


def folder(spark, rows):
    d = scratch_dir(spark, "pages-in")
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    return d


def lines_in_order(path):
    """Records of the part files in name order."""
    return [json.loads(x) for f in sorted(glob.glob(local_path(path) + "/part-*")) for x in open(f, encoding="utf-8")]


def rows_of(df):
    cols = ["source_rank", "source", "text_id", "language", "content", "title", "doc_ord", "pos"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_one_scan_one_parse_for_all_page_sources(spark, sf_small):
    pairs = REG.build_sources(spark, CHOSEN, params(sf_small), to_pairs=CB.to_pairs)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet|Scan parquet", plan)) == 1 and len(re.findall(r"MapInArrow|PythonMapInArrow", plan)) == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # projections only: nothing moves before the dedupe
    assert "Exchange" not in plan


def test_together_equals_each_alone(spark, sf_small):
    together = REG.build_sources(spark, CHOSEN, params(sf_small, crawl={"license": "cc_by"}))
    alone = None
    for rank, name in enumerate(CHOSEN):
        df = REG._REGISTRY[name](spark, **params(sf_small)[name]).withColumn("source_rank", F.lit(rank))
        alone = df if alone is None else alone.unionByName(df, allowMissingColumns=True)
    assert rows_of(together) == rows_of(alone) and together.count() > 50
    assert {(r.source, r.license) for r in together.select("source", "license").distinct().collect()} <= {
        ("crawl", "cc_by"), ("selected", None), ("described", None)}


def test_pairs_by_rank_equal_pairs_by_source(spark, sf_small):
    got = REG.build_sources(spark, CHOSEN, params(sf_small), to_pairs=CB.to_pairs)
    want = None
    for rank, name in enumerate(CHOSEN):
        df = REG._REGISTRY[name](spark, **params(sf_small)[name]).withColumn("source_rank", F.lit(rank))
        p = CB.to_pairs(df, REG.pair_style(name))
        want = p if want is None else want.unionByName(p)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(got) == key(want)


def test_edges_of_page_sources(spark):
    long_p = "a long enough passage of plain words to be kept"
    d = folder(spark, [(1, None), (2, ""), (3, "no tags at all"), (3, "no tags at all"), (None, f"<p>{long_p}</p>"),
                       (4, f"<title>T</title><meta name=description content='{'d' * 41}'><body><p>{long_p}<p>{long_p}</body>")])
    got = rows_of(REG.build_sources(spark, CHOSEN, params(d)))
    assert [r for r in got if r[1] == "described"] == [(2, "described", "4", "english", "d" * 41, "T", 4, 0)]
    # an unclosed element holds the next one
    assert [(r[2], r[4]) for r in got if r[1] == "selected" and r[6] == 4] == [("4-0", long_p * 2), ("4-1", long_p)]
    assert REG.build_sources(spark, CHOSEN, params(folder(spark, []))).count() == 0
    with pytest.raises(TypeError):
        REG.build_sources(spark, ["crawl"], {"crawl": {"data_dir": d, "licence": "x"}})


def test_a_source_that_fails_on_a_page_costs_that_page_only(spark):
    def read(doc):
        yield 0, None, "first"
        if H.find(doc, "b"):
            raise RuntimeError("no")
    s = P.PageSource("t", read, lambda pos, title, text, page: P._one(pos, title, text))
    items = P.parsed_items(spark.createDataFrame([(1, "<p>x</p>"), (2, "<b>x</b>")], "page_id long, html string"), [(5, s)])
    assert sorted((r.rank, r.page_id, r.pos, r.body) for r in items.collect()) == [
        (5, 1, 0, "first"), (5, 2, -1, "RuntimeError: no"), (5, 2, 0, "first")]


def test_text_ranges_equal_a_walk_of_the_tree():
    """Strings of an element against a plain recursive builder."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.cur = ["root", [], None]
            self.all = []

        def handle_starttag(self, tag, attrs):
            node = [tag, [], self.cur]
            self.cur[1].append(node)
            self.all.append(node)
            if tag not in H.VOID:
                self.cur = node

        def handle_endtag(self, tag):
            n = self.cur
            while n is not None and n[0] != tag:
                n = n[2]
            if n is not None and n is not self.root:
                self.cur = n[2]

        def handle_data(self, data):
            if self.cur[0] not in H.NON_TEXT:
                self.cur[1].append(data)

    def text(n):
        return "".join(c.strip() if isinstance(c, str) else text(c) for c in n[1])

    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "one ", " two", "<br>", "<script>", "</script>", "\n", "<li>", "</li>"]
    for _ in range(500):
        page = "".join(rng.choice(bits) + rng.choice(["", "", "x"]) for _ in range(rng.randrange(30)))
        walk = Walk()
        walk.feed(page)
        walk.close()
        doc = H.parse(page)
        assert [n.tag for n in doc.order] == [n[0] for n in walk.all]
        plain = [re.sub(r"\s", "", text(n)) for n in walk.all]
        assert [re.sub(r"\s", "", H.get_text(n)) for n in doc.order] == plain, page


def test_unclosed_paragraphs_are_read_in_linear_time():
    doc = H.parse("<body>" + "<p>word" * 20_000)
    assert len(H.get_text(doc.order[1])) == 80_000 and doc.order[-1].end - doc.order[-1].start == 1


# ---------------------------------------------------------------- floor of one pass
def counted_source(spark, n):
    acc = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b

    @REG.register("t_counted")
    def _counted(spark, dup=False):
        kinds = "source string, text_id string, language string, content string, doc_ord long, pos int"
        rows = [("s", str(i), "en", "same" if dup else f"content {i}", i, 0) for i in range(n)]
        return spark.createDataFrame(rows, kinds).repartition(3).mapInArrow(seen, kinds)
    return acc


@pytest.mark.parametrize("n,ordered,seeds", [(25, False, False), (19, True, True), (20, True, False), (3, False, True), (0, True, True)])
def test_floor_is_decided_in_the_writing_pass(spark, n, ordered, seeds):
    acc = counted_source(spark, n)
    seed = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(4)] + [(9, "Q0", "later")], "seed_id long, instruction string, response string")
    path = scratch_dir(spark, "floor")
    got = CB.collect_corpus(spark, ["t_counted"], {}, seed, path, floor="if_below", ordered=ordered,
                            spans=[(0, 0, max(n, 1)), (SEED_RANK, 0, 9)] if ordered else None)
    assert acc.value == n                                   # the source ran once
    assert path_exists(spark, f"{path}/_SUCCESS")
    rows = spark.read.schema(CB.FLAT_SCHEMA).json(path).collect()
    assert len(rows) == got["rows"] == n + (4 if seeds else 0)
    assert got["sources"]["t_counted"] == {"collected": n, "kept": n, "chars": sum(len(r.text) for r in rows if r.source == "s")}
    assert got["sources"]["seed"]["kept"] == (4 if seeds else 0)
    if ordered and rows:
        lines = lines_in_order(path)
        assert [r["source"] for r in lines] == ["s"] * n + ["fallback"] * (4 if seeds else 0)
        assert [r["instruction"].split("\n\n")[-1] for r in lines[:n]] == [f"content {i}" for i in range(n)]


def test_floor_counts_rows_before_the_dedupe(spark):
    counted_source(spark, 30)
    seed = spark.createDataFrame([(1, "q", "a")], "seed_id long, instruction string, response string")
    got = CB.collect_corpus(spark, ["t_counted"], {"t_counted": {"dup": True}}, seed, scratch_dir(spark, "floor"), floor="if_below")
    assert got["rows"] == 1 and got["sources"]["t_counted"]["collected"] == 30 and got["sources"]["seed"]["kept"] == 0


def test_build_command_reports_per_source(spark, sf_small, capsys):
    out = scratch_dir(spark, "cli-report")
    cli.main(["build", "--data-dir", sf_small, "--output", f"{out}/c", "--sources", "titled", "selected", "crawl", "--ordered", "--source-params",
              json.dumps({"titled": {"subset": "SRC1"}, "selected": {"selectors": "p", "char_class": K.LATIN_CLASS, "cap": 7}})])
    got = json.loads(capsys.readouterr().out.splitlines()[0])
    assert got["sources"]["selected"]["collected"] == 7
    docs = read_table(spark, sf_small, "documents", ["doc_id", "source"])
    titled = docs.where(F.contains(F.concat("source", F.lit(" #"), F.col("doc_id").cast("string")), F.lit("src1"))).count()
    assert got["sources"]["titled"]["collected"] == titled > 0
    back = spark.read.json(f"{out}/c")
    assert back.count() == got["rows"] == sum(s["kept"] for s in got["sources"].values())
    assert back.where("source = 'crawl'").count() == got["sources"]["crawl"]["kept"]
    assert back.agg(F.sum(F.length("text"))).first()[0] == got["chars"]


# ---------------------------------------------------------------- ranges
def test_ranges_grow_with_ord_and_need_no_sample(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 3, SEED_RANK]), rng.randrange(500, 1500), rng.randrange(4)) for _ in range(400)]
    spans = [(SEED_RANK, 600, 700), (0, 500, 1500), (3, 0, 3000)]
    df = spark.createDataFrame(rows, "r int, d long, p int").select(make_ord("r", "d", "p").alias("ord"))
    got = sorted((r.ord, r.k) for r in df.select("ord", S.range_of(F.col("ord"), spans, 11).alias("k")).collect())
    ks = [k for _, k in got]
    assert ks == sorted(ks) and set(ks) <= set(range(11)) and len(set(ks)) == 5
    with pytest.raises(Exception, match="no range"):
        df.select(S.range_of(F.col("ord"), [(0, 0, 1)], 4)).collect()
    assert [S.range_of(F.lit(0), [(0, 5, 5)], n) is not None for n in (1, 2)]
    flat = df.select(*[F.col("ord").cast("string").alias(c) for c in S.FLAT_FIELDS], "ord")
    path, acc = scratch_dir(spark, "ranged"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b
    S.sink_jsonl(flat.mapInArrow(seen, flat.schema), path, ordered=True, spans=spans)
    assert acc.value == len(rows)                           # the frame ran once
    written = [int(r["text"]) for r in lines_in_order(path)]
    assert written == sorted(written) and len(written) == len(rows)


def test_store_errors_are_not_taken_for_a_missing_path(spark):
    assert not path_exists(spark, scratch_dir(spark, "nowhere"))
    with pytest.raises(Exception):
        path_exists(spark, "nosuchstore://x/y")


def test_page_sources_get_bounded_batches(spark):
    from corpusmill.sources import pages as P
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        P.parsed_items(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string"), [(0, P.crawl_source())])
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, old)


# ---------------------------------------------------------------- contents through the shuffles
def test_contents_give_the_same_pairs(spark):
    rows = [(r, "s", "en", c, t, i, i % 3) for i, (r, c, t) in enumerate([(0, "one", "T"), (1, "two", None), (0, None, "U"), (1, "", ""), (0, "one", "V")])]
    df = spark.createDataFrame(rows, "source_rank int, source string, language string, content string, title string, doc_ord long, pos int")
    key = lambda d: sorted(map(str, d.select("instruction", "response", "source", "language", "ord").collect()))
    for style in ("echo", "quoted", "summary", "commentary", {0: "quoted", 1: "summary"}, {0: "echo", 1: "echo"}):
        styles = list(style.values()) if isinstance(style, dict) else [style]
        made = CB.to_contents(df, style)
        assert "instruction" not in made.columns and key(CB.with_pairs(made, styles)) == key(CB.to_pairs(df, style))
        seed = spark.createDataFrame([(1, "q", "a"), (2, None, None)], "seed_id long, instruction string, response string")
        both = CB.with_pairs(CB.first_of_key(CB.combine.with_floor(made, seed), styles, True, None), styles)
        plain = CB.combine.with_floor(CB.to_pairs(df, style), seed)
        assert key(both) == key(CB.dedupe.dedupe_first(plain, CB.dedupe_key("instruction"), hash_key=True))


def test_a_content_is_shuffled_once_per_row(spark, monkeypatch):
    counted_source(spark, 30)
    given, sink = [], CB.sinks.sink_jsonl
    monkeypatch.setattr(CB.sinks, "sink_jsonl", lambda df, *a, **k: (given.append(df.columns), sink(df, *a, **k)))
    CB.collect_corpus(spark, ["t_counted"], {}, None, scratch_dir(spark, "lean"), ordered=True)
    assert "content" in given[0] and not {"text", "instruction", "response"} & set(given[0])
