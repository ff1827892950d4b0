"""End-to-end jobs: corpus write with observed totals, sizing helper."""
import json
import os

from corpusmill.plans import catalog as C
from corpusmill.plans import corpus_builder as CB
from corpusmill.session import local_path, scratch_dir, sizing_conf
from corpusmill.sources.tables import read_table, seed_from_benchmark


def test_write_corpus_observes_totals(spark, sf_small):
    corpus = CB.build_corpus(read_table(spark, sf_small, "documents", ["doc_id", "text", "lang", "source"]),
                             seed_from_benchmark(spark, sf_small), C.SOURCES)
    path = scratch_dir(spark, "e2e")
    stats = CB.write_corpus(corpus, path, ordered=True)
    back = spark.read.json(path)
    assert stats["rows"] == back.count() > 0
    assert stats["chars"] == sum(len(r.text) for r in back.select("text").collect())
    # part files in name order are in collection order, every record has the five fields
    files = sorted(f for f in os.listdir(local_path(path)) if f.startswith("part-"))
    recs = [json.loads(line) for f in files for line in open(os.path.join(local_path(path), f), encoding="utf-8")]
    assert all(set(r) == {"instruction", "response", "source", "language", "text"} for r in recs)
    assert recs[-1]["source"] == "fallback"   # seeds come last


def test_sizing_conf_scales_with_input():
    small = sizing_conf(10 << 30)
    big = sizing_conf(100 << 40)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) > 500_000
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


def test_no_machine_local_scratch_on_a_cluster():
    import pytest

    from corpusmill.session import checkpoint_root

    class Conf:
        def __init__(self, d):
            self.d = d

        def get(self, k, default=None):
            return self.d.get(k, default)

    class SC:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Spark:
        sparkContext = SC()
        conf = Conf({})

    with pytest.raises(RuntimeError):
        checkpoint_root(Spark())

    class SharedSC(SC):
        def getCheckpointDir(self):
            return "hdfs://shared/ckpt"

    class Spark2(Spark):
        sparkContext = SharedSC()

    assert checkpoint_root(Spark2()) == "hdfs://shared/ckpt"


def test_flat_sink_utf8_five_fields(spark):
    from corpusmill.operators import pairs
    from corpusmill.sources.sinks import sink_jsonl
    df = spark.createDataFrame([("Qué? 水", None, None, None, 1)],
                               "instruction string, response string, source string, language string, ord long")
    from pyspark.sql import functions as F
    rec = pairs.fill_record(df.withColumn("response", F.lit("a\u2028b")), response_fallback=None)
    path = scratch_dir(spark, "utf8")
    sink_jsonl(rec, path)
    files = [f for f in os.listdir(local_path(path)) if f.startswith("part-")]
    lines = [ln for f in files for ln in open(os.path.join(local_path(path), f), encoding="utf-8").read().split("\n") if ln]
    assert len(lines) == 1
    assert "Qué? 水" in lines[0]                      # not \\u-escaped
    obj = json.loads(lines[0])
    assert list(obj) == ["instruction", "response", "source", "language", "text"]
    assert obj["response"] == "a b" and obj["source"] == "fallback" and obj["language"] == "english"
