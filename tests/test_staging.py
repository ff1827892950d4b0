"""Staged sources: a failure costs one source, never its last complete version."""
import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusmill import cli
from corpusmill.operators import report
from corpusmill.operators import tokens as T
from corpusmill.plans import corpus_builder as CB
from corpusmill.session import local_path, scratch_dir
from corpusmill.sources import builtin  # noqa: F401
from corpusmill.sources import registry as REG
from corpusmill.sources import staging as S
from corpusmill.sources.tables import read_table

KINDS = "source string, text_id string, language string, content string, doc_ord long, pos int"


def source(spark, name, rows, fail=False):
    @REG.register(name)
    def _build(spark):
        df = spark.createDataFrame([(name, str(i), "en", f"{name} {i}", i, 0) for i in range(rows)], KINDS)
        # fails while it is read, in one row
        return df.withColumn("content", F.when((F.col("doc_ord") == rows - 1) & F.lit(fail), F.raise_error(F.lit("broken row")).cast("string"))
                             .otherwise(F.col("content")))


def texts(df):
    return sorted(r.content for r in df.collect())


def test_failure_while_reading_falls_back_to_the_last_version(spark):
    root = scratch_dir(spark, "st")
    source(spark, "s_a", 3), source(spark, "s_b", 2)
    df, states = S.build_staged(spark, ["s_a", "s_b"], {}, root)
    assert states == {"s_a": "built", "s_b": "built"} and len(texts(df)) == 5
    source(spark, "s_a", 9, fail=True), source(spark, "s_b", 4)
    df, states = S.build_staged(spark, ["s_a", "s_b"], {}, root)
    assert states == {"s_a": "cached", "s_b": "built"}
    assert texts(df) == [f"s_a {i}" for i in range(3)] + [f"s_b {i}" for i in range(4)]
    assert sorted((r.source, r.source_rank) for r in df.select("source", "source_rank").distinct().collect()) == [("s_a", 0), ("s_b", 1)]
    source(spark, "s_a", 1)
    df, states = S.build_staged(spark, ["s_a", "s_b"], {}, root)
    assert states["s_a"] == "built" and texts(df)[0] == "s_a 0" and len(texts(df)) == 5
    assert len(os.listdir(local_path(f"{root}/s_a"))) == 2            # older versions and what failed are gone


def test_a_corrupt_file_falls_back(spark, sf_small):
    root, d = scratch_dir(spark, "st"), scratch_dir(spark, "copy")
    read_table(spark, sf_small, "documents").write.parquet(f"{d}/documents.parquet")
    params = {"documents": {"data_dir": d}}
    df, states = S.build_staged(spark, ["documents"], params, root)
    n = df.count()
    at = local_path(f"{d}/documents.parquet")
    for f in os.listdir(at):
        if f.startswith("part-"):
            with open(os.path.join(at, f), "r+b") as x:               # the footer stays, pages are lost
                x.seek(100)
                x.write(b"\0" * 4000)
        elif f.startswith(".part-"):
            os.truncate(os.path.join(at, f), 0)
    df, states = S.build_staged(spark, ["documents"], params, root)
    assert states == {"documents": "cached"} and df.count() == n > 0


def test_no_version_at_all(spark):
    source(spark, "s_bad", 2, fail=True), source(spark, "s_ok", 2)
    df, states = S.build_staged(spark, ["s_bad", "s_ok"], {}, scratch_dir(spark, "st"))
    assert states == {"s_bad": "failed", "s_ok": "built"} and texts(df) == ["s_ok 0", "s_ok 1"]
    assert S.build_staged(spark, ["s_bad"], {}, scratch_dir(spark, "st")) == (None, {"s_bad": "failed"})
    with pytest.raises(ValueError, match="s_bad"):
        CB.collect_corpus(spark, ["s_bad"], {}, None, scratch_dir(spark, "out"), stage_dir=scratch_dir(spark, "st"))
    seed = spark.createDataFrame([(1, "q", "a")], "seed_id long, instruction string, response string")
    got = CB.collect_corpus(spark, ["s_bad"], {}, seed, scratch_dir(spark, "out"), stage_dir=scratch_dir(spark, "st"))
    assert got["rows"] == 1 and got["staged"] == {"s_bad": "failed"}


def test_expanded_command_stages_and_packs(spark, sf_small, capsys):
    out = scratch_dir(spark, "ex")
    cli.main(["expanded", "--data-dir", sf_small, "--output", f"{out}/nested", "--sources", "documents", "crawl", "described", "--stage-dir", f"{out}/st",
              "--source-params", '{"described": {"license": "cc_by"}, "documents": {"license": "research_only"}}',
              "--pack", f"{out}/packed", "--block", "64", "--shards", "3", "--eos-id", "1"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0]["staged"] == {"documents": "built", "crawl+described": "built"}
    assert lines[1]["failed_texts"] == 0
    nested = spark.read.json(f"{out}/nested")
    n = nested.select(F.sum(F.size(T.native_tokens("text")) + 1)).first()[0]
    b = spark.read.parquet(f"{out}/packed/blocks")
    assert b.agg(F.sum("n_tokens")).first()[0] == n == b.agg(F.sum(F.size("input_ids"))).first()[0]
    short = b.where("n_tokens < 64").groupBy("shard").count().collect()
    assert all(r["count"] == 1 for r in short)
    assert b.select(F.sum(F.size(F.filter("input_ids", lambda x: x == 1)))).first()[0] >= nested.count()


def test_texts_a_tokenizer_cannot_read_are_counted(spark):
    def factory():
        def ids(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad")
            return [[len(w) for w in t.split()] for t in texts]
        return ids
    df = spark.createDataFrame([(i, "a bad one" if i % 5 == 0 else "a good one") for i in range(40)] + [(40, None)], "id long, text string")
    obs = Observation("skips")
    rows = T.tokenize(df, "text", "ids", factory=factory, key="skips", on_error="skip", failed=obs).collect()
    assert sorted(r.id for r in rows) == [i for i in range(41) if i % 5 or i == 40] and report.values(obs) == {"failed": 8}
    with pytest.raises(Exception, match="bad"):
        T.tokenize(df, "text", "ids", factory=factory, key="skips").collect()
