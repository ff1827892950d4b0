"""Command line: ``python -m corpusmill <command> ...``.

  build     sources -> pairs -> seed floor -> first-wins dedupe -> flat JSONL
  format    flat/plain JSONL -> chat text -> tokens (parquet)
  expanded  sources with provenance -> licence filter -> nested JSONL
  runlog    run-log lines -> latest progress, outcome, display, error excerpts
            (batch, or ``--stream`` with Structured Streaming)

Every command builds one lazy plan and runs it with a single write; reads
and writes take any Hadoop path (local, HDFS, object stores).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import Window
from pyspark.sql import functions as F


# registered sources that read the tables of --data-dir
TABLE_SOURCES = ("documents", "titled", "crawl", "selected", "described")


def _session(args):
    from corpusmill.session import build_session, sizing_conf
    extra = sizing_conf(int(args.input_gb * (1 << 30))) if args.input_gb else None
    return build_session(args.master, app=f"corpusmill-{args.cmd}", extra=extra)


def _seed(spark, args):
    from corpusmill.sources.tables import read_table
    if not args.seed_table:
        return None
    t = read_table(spark, args.data_dir, args.seed_table)
    cols = set(t.columns)
    resp = "response" if "response" in cols else "text"
    instr = "instruction" if "instruction" in cols else "text"
    key = "seed_id" if "seed_id" in cols else ("item_id" if "item_id" in cols else None)
    if key is None:
        # a rank by content: the same number in every run, without gaps
        one = t.select(F.col(instr).alias("instruction"), F.col(resp).alias("response")).dropDuplicates()
        rank = F.row_number().over(Window.orderBy(F.xxhash64("instruction", "response"), "instruction", "response"))
        return one.withColumn("seed_id", rank - 1) if args.small_seed else _refuse_seed(args.seed_table)
    return t.select(F.col(key).alias("seed_id"), F.col(instr).alias("instruction"), F.col(resp).alias("response"))


def _refuse_seed(name):
    raise SystemExit(f"table {name} has neither seed_id nor item_id; add a key column, or pass --small-seed "
                     "for a seed table that one task can number")


def _source_params(args) -> dict:
    """Parameters by source: the data folder, then what --source-params says."""
    params = {name: {"data_dir": args.data_dir} for name in TABLE_SOURCES}
    for name, more in json.loads(args.source_params or "{}").items():
        params.setdefault(name, {}).update(more)
    return params


def _spans(spark, args, chosen, seed):
    """Document ordinals of every chosen source and the seeds, from one narrow
    column each: what an ordered write splits by."""
    from corpusmill.sources.registry import chosen_builders
    from corpusmill.sources.tables import DOC_BITS, SEED_RANK, read_table
    ids = {"documents": ("documents", "doc_id"), "titled": ("documents", "doc_id"), "crawl": ("pages", "page_id"),
           "selected": ("pages", "page_id"), "described": ("pages", "page_id")}

    def ends(df, col):
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        return (0, 0) if r.lo is None else (int(r.lo), int(r.hi))
    out = []
    for rank, name in enumerate(chosen_builders(chosen)):
        if name in ids:
            table, col = ids[name]
            out.append((rank, *ends(read_table(spark, args.data_dir, table, [col]), col)))
        else:
            out.append((rank, 0, (1 << DOC_BITS) - 1))          # a hash
    return out + ([(SEED_RANK, *ends(seed, "seed_id"))] if seed is not None else [])


def cmd_build(args):
    from corpusmill.plans.corpus_builder import collect_corpus
    from corpusmill.sources import builtin  # noqa: F401
    from corpusmill.session import path_exists
    from corpusmill.sources.jsonl import first_lines
    spark = _session(args)
    chosen = [] if args.no_scrape else args.sources
    params = _source_params(args)
    if args.abstracts:
        params.setdefault("abstracts", {})["path"] = args.abstracts
    if args.reuse and path_exists(spark, f"{args.output.rstrip('/')}/_SUCCESS"):
        print(json.dumps({"output": args.output, "reused": True}))
        return
    seed = _seed(spark, args)
    stats = collect_corpus(spark, chosen, params, seed, args.output, casefold=not args.exact_key, floor=args.floor,
                           floor_n=args.floor_n, prefix_len=args.prefix_key, ordered=args.ordered,
                           spans=_spans(spark, args, chosen, seed) if args.ordered else None, stage_dir=args.stage_dir)
    print(json.dumps({"output": args.output, **stats}))
    if args.preview:
        first = first_lines(spark, args.output, 5).select(
            F.substring(F.get_json_object("value", "$.instruction"), 1, 100).alias("i"),
            F.substring(F.get_json_object("value", "$.response"), 1, 100).alias("r"))
        for row in first.collect():                         # at most 5 rows
            print(json.dumps({"instruction": row.i, "response": row.r}, ensure_ascii=False))


def cmd_format(args):
    from corpusmill.plans.corpus_builder import training_input
    from corpusmill.sources.jsonl import scan_two_format, write_rejects
    spark = _session(args)
    recs = scan_two_format(spark, args.input, on_error=args.on_error)
    if args.on_error == "rejects":
        n = write_rejects(spark, args.input, args.output.rstrip("/") + "-rejects")
        print(json.dumps({"rejects": args.output.rstrip("/") + "-rejects", "lines": n}))
    training_input(recs, args.max_tokens).select("input_ids", "attention_mask", "tokens") \
        .write.mode("overwrite").parquet(args.output)


def cmd_expanded(args):
    from corpusmill.operators import policy
    from corpusmill.plans.corpus_builder import format_expanded
    from corpusmill.sources import builtin  # noqa: F401
    from corpusmill.sources.registry import build_sources
    from corpusmill.sources.tables import make_ord
    from corpusmill.sources.sinks import sink_nested
    from corpusmill.sources.staging import build_staged
    spark = _session(args)
    if args.stage_dir:
        items, states = build_staged(spark, args.sources, _source_params(args), args.stage_dir)
        print(json.dumps({"staged": states}))
        if items is None:
            raise SystemExit("no source could be read")
    else:
        items = build_sources(spark, args.sources, _source_params(args))
    if args.license_map:
        # (source, license_type, attribution, ...): a user file, so no broadcast
        # hint - AQE broadcasts it only when its measured size is small
        lic = spark.read.json(args.license_map)
        items = items.join(lic, "source", "left")
    if "license_type" not in items.columns:                # the sources' own licence, if they state one
        own = F.col("license") if "license" in items.columns else F.lit(None).cast("string")
        items = items.withColumn("license_type", own)
    kept = policy.license_filter(items, policy.policy_table(spark), commercial=args.commercial,
                                 check=not args.no_license_check)
    markers = json.loads(args.markers) if args.markers else None
    ord_ = make_ord("source_rank", "doc_ord", "pos").alias("ord")
    text = format_expanded(kept, style=args.style, markers=markers)
    sink_nested(text.drop("source_rank", "doc_ord", "pos"), args.output)
    if args.pack:
        _pack(spark, args, text.select(ord_, "text"))


def _pack(spark, args, texts):
    """Packed training sequences of the formatted texts: token ids in blocks of
    ``--block``, in collection order inside a shard; texts that the tokenizer cannot read are counted."""
    from pyspark.sql import Observation

    from corpusmill.operators import report, tokens
    failed = Observation("failed")
    if args.tokenizer:
        path = args.tokenizer
        ids = tokens.tokenize(texts, "text", "ids", factory=lambda: _file_tokenizer(path), key=path, on_error="skip", failed=failed)
    else:
        ids = tokens.tokenize(texts, "text", "tokens").select("ord", tokens.hashed_ids("tokens").alias("ids"))
    # the ids are read twice (lengths, tokens): written once, so that texts are tokenized once
    ids.select("ord", "ids").write.mode("overwrite").parquet(f"{args.pack}/_ids")
    n_failed = report.values(failed).get("failed", 0) if args.tokenizer else 0
    ids = spark.read.parquet(f"{args.pack}/_ids")
    tokens.pack(ids, "ord", "ids", block=args.block, eos=args.eos_id, shards=args.shards, chunk=1 << 36) \
        .select("shard", "block", F.col("tokens").alias("input_ids"), "n_tokens").write.mode("overwrite").parquet(f"{args.pack}/blocks")
    print(json.dumps({"packed": f"{args.pack}/blocks", "failed_texts": int(n_failed)}))


def _file_tokenizer(path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def _write_live(spark, args, exits):
    """The live tables' current rows as ``latest`` and ``errors``."""
    from corpusmill.streaming import live
    for name, rows in (("latest", live.latest(spark, f"{args.output}/live")), ("errors", live.errors(spark, f"{args.output}/live", exits))):
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{args.output}/{name}")
    print(json.dumps(live.stats(spark, f"{args.output}/live")))


def cmd_runlog(args):
    from corpusmill.operators import runlog as R
    spark = _session(args)
    exits = spark.read.parquet(args.exits) if args.exits else None
    if args.current:
        return _write_live(spark, args, exits)
    if args.stream:
        from corpusmill.streaming import live
        stream = spark.readStream.schema(live.LOG_SCHEMA).parquet(args.log)
        q = live.start_live(stream, f"{args.output}/live", f"{args.output}/_checkpoint",
                            trigger={"availableNow": True} if args.once else {"processingTime": "10 seconds"},
                            watermark=args.watermark)
        q.awaitTermination()
        return _write_live(spark, args, exits)
    log = spark.read.parquet(args.log)
    # one pass over the log for the per-run state; later outputs read the
    # small written table instead of parsing the log again
    R.progress_latest(R.parse_progress(log)).write.mode("overwrite").parquet(f"{args.output}/latest")
    latest = spark.read.parquet(f"{args.output}/latest")
    if exits is not None:
        out = R.run_outcome(latest, exits)
        out.write.mode("overwrite").parquet(f"{args.output}/outcome")
        R.progress_display(spark.read.parquet(f"{args.output}/outcome").drop("rc", "status"), args.epochs) \
            .write.mode("overwrite").parquet(f"{args.output}/display")
        R.error_excerpt(log, exits).write.mode("overwrite").parquet(f"{args.output}/errors")


def main(argv=None):
    p = argparse.ArgumentParser(prog="corpusmill")
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    p.add_argument("--input-gb", type=float, default=None, help="input size: sets split and shuffle partition sizes")
    sub = p.add_subparsers(dest="cmd", required=True)

    b = sub.add_parser("build", help="build the flat instruction corpus")
    b.add_argument("--data-dir", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--sources", nargs="+", default=["documents", "crawl"])
    b.add_argument("--source-params", default=None,
                   help='parameters by source as JSON, e.g. {"selected": {"cap": 500}, "titled": {"subset": "poems"}}')
    b.add_argument("--stage-dir", default=None, help="stage every source here; one that fails is taken from its last version")
    b.add_argument("--abstracts", default=None, help="abstracts JSONL path (source 'abstracts')")
    b.add_argument("--seed-table", default="benchmark", help="table of seed pairs ('' for none)")
    b.add_argument("--reuse", action="store_true", help="keep a complete corpus that is already at --output")
    b.add_argument("--small-seed", action="store_true", help="number the rows of a seed table without a key")
    b.add_argument("--prefix-key", type=int, default=None, help="dedupe on this many leading characters of the key")
    b.add_argument("--no-scrape", action="store_true", help="seed corpus only")
    b.add_argument("--floor", choices=["always", "if_below"], default="always")
    b.add_argument("--floor-n", type=int, default=20, help="rows below which if_below adds the seeds")
    b.add_argument("--exact-key", action="store_true", help="case-sensitive dedupe key")
    b.add_argument("--ordered", action="store_true", help="write in collection order")
    b.add_argument("--preview", action="store_true")
    b.set_defaults(fn=cmd_build)

    f = sub.add_parser("format", help="JSONL -> tokenized training input")
    f.add_argument("--input", required=True)
    f.add_argument("--output", required=True)
    f.add_argument("--max-tokens", type=int, default=512)
    f.add_argument("--on-error", choices=["fail", "rejects"], default="fail")
    f.set_defaults(fn=cmd_format)

    e = sub.add_parser("expanded", help="licence-checked nested JSONL")
    e.add_argument("--data-dir", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--sources", nargs="+", default=["documents", "crawl"])
    e.add_argument("--source-params", default=None,
                   help='parameters by source as JSON, e.g. {"crawl": {"cap": 80}, "documents": {"license": "cc_by"}}')
    e.add_argument("--license-map", default=None, help="JSON table: source -> license_type, ...")
    e.add_argument("--commercial", action="store_true")
    e.add_argument("--no-license-check", action="store_true")
    e.add_argument("--stage-dir", default=None, help="stage every source here; one that fails is taken from its last version")
    e.add_argument("--pack", default=None, help="also write packed token ids to this folder")
    e.add_argument("--tokenizer", default=None, help="tokenizer file for --pack (default: hashed ids of words)")
    e.add_argument("--block", type=int, default=2048)
    e.add_argument("--shards", type=int, default=64)
    e.add_argument("--eos-id", type=int, default=0)
    e.add_argument("--style", choices=["plain", "chat"], default="plain")
    e.add_argument("--markers", default=None, help='chat markers as JSON, e.g. {"start": "...", "end": "..."}')
    e.set_defaults(fn=cmd_expanded)

    r = sub.add_parser("runlog", help="run-log analytics")
    r.add_argument("--log", default=None, help="parquet: run_id, line_no, ts, line")
    r.add_argument("--exits", default=None, help="parquet: run_id, rc")
    r.add_argument("--output", required=True)
    r.add_argument("--epochs", type=int, default=1)
    r.add_argument("--stream", action="store_true")
    r.add_argument("--once", action="store_true", help="stream what is there, then stop")
    r.add_argument("--current", action="store_true", help="write latest and errors of a stream that runs into --output")
    r.add_argument("--watermark", default=None, help="count lines older than this as late, e.g. '1 hour'")
    r.set_defaults(fn=cmd_runlog)

    args = p.parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main(sys.argv[1:])
