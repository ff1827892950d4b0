"""A key / run / shard holding a third of all rows: results stay exact and
the shuffle does not receive the hot group whole."""
import re

from pyspark.sql import functions as F

from corpusmill.functions.text import dedupe_key
from corpusmill.operators import dedupe, runlog, tokens


def _shuffle_records(df) -> int:
    """Records written by all shuffles of the executed (adaptive) plan."""
    plan = df._jdf.queryExecution().executedPlan()
    root = plan.finalPhysicalPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan
    total, stack = 0, [root]
    while stack:
        n = stack.pop()
        cls = n.getClass().getSimpleName()
        if cls == "ShuffleQueryStageExec":
            ex = n.plan()
            m = ex.metrics()
            if m.contains("shuffleRecordsWritten"):
                total += int(m.apply("shuffleRecordsWritten").value())
            stack.append(ex)
            continue
        ch = n.children()
        for i in range(ch.size()):
            stack.append(ch.apply(i))
    return total


def test_hot_key_dedupe_ships_one_row_per_partition(spark):
    n, parts = 3000, 6
    df = spark.range(0, n, 1, parts).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit("THE SAME   text"))
         .otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("t"))
    out = dedupe.dedupe_first(df, dedupe_key("t"))
    rows = out.collect()
    assert len(rows) == 2000 + 1 and min(r.ord for r in rows if r.t.startswith("THE")) == 0
    shuffled = _shuffle_records(out)
    assert 0 < shuffled <= 2000 + parts          # hot key: at most one row per map partition


def test_hot_run_carry_forward_matches_plain_window(spark):
    lines = []
    for i in range(3000):
        run = 0 if i % 3 == 0 else i % 50 + 1     # run 0 holds a third of all lines
        lines.append((run, i, f"{i % 100}%|#| {i}/3000 [00:01<00:02, 1it/s]" if i % 7 == 0
                      else ("{'loss': %d.5}" % (i % 9) if i % 5 == 0 else "noise")))
    df = runlog.parse_progress(spark.createDataFrame(lines, "run_id long, line_no long, line string"))
    df = df.select("run_id", "line_no", *runlog.PROGRESS_COLS)
    seg = runlog.carry_forward(df, chunk=64)
    plain = runlog.carry_forward(df, chunk=None)
    assert seg.exceptAll(plain).count() == 0 and plain.exceptAll(seg).count() == 0
    # the hot run is spread over many window partitions (coalescing off so
    # that the tiny test data keeps its shuffle partitions)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        tagged = runlog.carry_forward(df, chunk=64).select("run_id", F.spark_partition_id().alias("p"))
        per_part = tagged.where("run_id = 0").groupBy("p").count().collect()
    finally:
        spark.conf.set(key, old)
    assert len(per_part) > 1 and max(r["count"] for r in per_part) < 1000


def test_pack_with_one_huge_run(spark):
    lens = [3000] + [5] * 40                      # one run holds most tokens
    rows = [(i, [f"t{i}_{j}" for j in range(n)]) for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    blocks = tokens.pack(df, "id", "tokens", block=128, eos="E", shards=3, chunk=4).collect()
    assert sum(b.n_tokens for b in blocks) == sum(lens) + len(lens)
    assert max(b.n_tokens for b in blocks) <= 128
    big = [t for b in sorted(blocks, key=lambda b: (b.shard, b.block)) for t in b.tokens if t.startswith("t0_")]
    assert big == [f"t0_{j}" for j in range(3000)]
    assert all(re.match(r"t\d+_\d+|E", t) for b in blocks for t in b.tokens)
