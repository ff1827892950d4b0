import os

import corpus_pipeline
from corpusmill.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0.5 * n < docs.count() <= n
        n = docs.count()
    name, stage = corpus_pipeline.STAGES[-1]
    out = stage(spark, docs, SF)
    assert out.select("doc_id").distinct().count() == n
    assert {"sequence_id", "offset", "length"} <= set(out.columns)
    assert corpus_pipeline.run(spark, SF).count() == out.count()
    common.sweep(spark)


def test_scratch_tables_can_be_swept(spark):
    t = common.written(spark.range(5), "t")
    path = t._scratch_path.removeprefix("file:")
    assert os.path.isdir(path)
    common.sweep(spark)
    assert not os.path.isdir(path)


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_components_of_hard_shapes(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 60)]
    ring = [(1000 + i, 1000 + (i + 7) % 30) for i in range(30)]
    edges = spark.createDataFrame(chain + star + ring + [(5, 5), (7, 1)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in common.components(edges).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)} | {1000 + i: 1000 for i in range(30)}
    assert got == want
    assert common.components(edges.limit(0)).count() == 0
