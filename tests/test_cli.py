"""Command line on the sf0.001 tables (same session, in-process)."""
import json

from corpusmill import cli
from corpusmill.operators import runlog as R
from corpusmill.session import scratch_dir
from corpusmill.sources.tables import read_table


def test_build_format_runlog(spark, sf_small, capsys):
    out = scratch_dir(spark, "cli")
    cli.main(["build", "--data-dir", sf_small, "--output", f"{out}/corpus", "--ordered", "--preview"])
    printed = capsys.readouterr().out
    stats = json.loads(printed.splitlines()[0])
    assert stats["rows"] == spark.read.json(f"{out}/corpus").count() > 0
    assert '"instruction": ' in printed

    cli.main(["format", "--input", f"{out}/corpus", "--output", f"{out}/tokens", "--max-tokens", "64"])
    toks = spark.read.parquet(f"{out}/tokens")
    assert toks.count() == stats["rows"]
    assert toks.selectExpr("max(size(tokens))").first()[0] <= 64

    ev = read_table(spark, sf_small, "events")
    R.run_log_from_events(ev).write.parquet(f"{out}/log")
    R.run_exits_from_events(ev).write.parquet(f"{out}/exits")
    cli.main(["runlog", "--log", f"{out}/log", "--exits", f"{out}/exits", "--output", f"{out}/rl", "--epochs", "3"])
    n_runs = ev.select("user_id").distinct().count()
    assert spark.read.parquet(f"{out}/rl/outcome").count() == n_runs
    assert spark.read.parquet(f"{out}/rl/display").count() == n_runs
    assert spark.read.parquet(f"{out}/rl/errors").count() > 0

    cli.main(["runlog", "--log", f"{out}/log", "--output", f"{out}/rs", "--stream", "--once"])
    s = {r.run_id: r.pct for r in spark.read.parquet(f"{out}/rs/latest").collect()}
    b = {r.run_id: r.pct for r in spark.read.parquet(f"{out}/rl/latest").collect()}
    assert s == b


def test_expanded_with_licence_map(spark, sf_small):
    out = scratch_dir(spark, "cli-expanded")
    lic = f"{out}/lic"
    spark.createDataFrame([("crawl", "proprietary")], "source string, license_type string").write.json(lic)
    cli.main(["expanded", "--data-dir", sf_small, "--output", f"{out}/nested", "--sources", "documents", "crawl",
              "--license-map", lic, "--style", "chat", "--markers", '{"start": "<t>", "end": "</t>\\n"}'])
    back = spark.read.json(f"{out}/nested")
    n_docs = read_table(spark, sf_small, "documents", ["doc_id"]).count()
    assert back.count() == n_docs                      # crawl is proprietary: dropped
    assert back.where("meta.source = 'crawl'").count() == 0
    assert back.first().text.startswith("<t>user\n")


def test_build_seeds_only(spark, sf_small, capsys):
    out = scratch_dir(spark, "cli-seeds")
    cli.main(["build", "--data-dir", sf_small, "--output", f"{out}/c", "--no-scrape"])
    stats = json.loads(capsys.readouterr().out.splitlines()[0])
    seeds = read_table(spark, sf_small, "benchmark", ["text"])
    import re
    keys = {re.sub(r"\s+", "", r.text).lower() for r in seeds.collect()}
    assert stats["rows"] == len(keys)                        # seeds, first-wins on the key
    back = spark.read.json(f"{out}/c")
    assert {r.source for r in back.select("source").distinct().collect()} == {"fallback"}
