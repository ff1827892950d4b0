"""Run-log analytics.

A run log is ``(run_id, line_no, ts, line)``; exits are ``(run_id, rc)``.
Progress lines are parsed with JVM regexes; state "after each line" is a
segmented carry-forward window, and the latest state per run is one
aggregate with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import constants as K
from corpusmill.functions.constants import EPOCH_BAR, EPOCH_FLOAT, LOSS, PLAIN_BAR  # noqa: F401
from corpusmill.functions.text import html_escape, strip

NUM_SCI = r"([\d.]+(?:[eE][-+]?\d+)?)"

PROGRESS_COLS = ["epoch_cur", "epoch_total", "pct", "step_cur", "step_total",
                 "elapsed", "eta", "loss", "epoch_float"]


def run_log_from_events(events: DataFrame) -> DataFrame:
    """Fixture adapter: a run log derived from the ``events`` table.

    run_id = user_id, line_no = event_id; the line shape is chosen by
    ``event_id % 5`` (epoch bar, plain bar, metrics dict, error text, other
    text) and filled with integers derived from event_id / value.
    """
    e = F.col("event_id")
    s = lambda x: x.cast("string")
    two = lambda x: F.lpad(s(x), 2, "0")
    v100 = F.floor(F.col("value") * 100).cast("bigint")
    shape = e % 5
    epoch_bar = F.concat(F.lit("Epoch "), s(e % 3 + 1), F.lit("/3:  "), s(e % 101), F.lit("%|###| "),
                         s(e % 151), F.lit("/150 ["), two(e % 60), F.lit(":"), two(e % 59),
                         F.lit("<"), two(e % 58), F.lit(":"), two(e % 57), F.lit(", 1.25it/s]"))
    plain_bar = F.concat(F.when(e % 2 == 0, F.lit("  ")).otherwise(F.lit("")), s(e % 100),
                         F.lit("%|##| "), s(e % 77), F.lit("/77 [00:"), two(e % 60), F.lit("<01:"),
                         two(e % 53), F.lit(", 2.50it/s]"))
    metrics = F.concat(F.lit("{'loss': "), s(e % 7), F.lit("."), F.lpad(s(v100 % 10000), 4, "0"),
                       F.lit(", 'learning_rate': 2e-05, 'epoch': "), s(e % 3), F.lit("."), s(e % 10),
                       F.lit("}"))
    err = (F.when(F.floor(e / 5) % 3 == 0, F.lit("Traceback (most recent call last):"))
             .when(F.floor(e / 5) % 3 == 1, F.concat(F.lit("ValueError: bad shape <"), s(v100), F.lit("> & more")))
             .otherwise(F.concat(F.lit("  File \"train.py\", line "), s(e % 400))))
    other = F.concat(F.lit("Saving checkpoint step "), s(e), F.lit(" to <out> & logs"))
    line = (F.when(shape == 0, epoch_bar).when(shape == 1, plain_bar).when(shape == 2, metrics)
              .when(shape == 3, err).otherwise(other))
    return events.select(F.col("user_id").alias("run_id"), e.alias("line_no"), "ts", line.alias("line"))


def run_exits_from_events(events: DataFrame) -> DataFrame:
    """Fixture adapter: exit code per run (rc = run_id % 2)."""
    return events.select(F.col("user_id").alias("run_id")).distinct() \
                 .select("run_id", (F.col("run_id") % 2).cast("int").alias("rc"))


def parse_progress(df: DataFrame, col: str = "line", sci: bool = False) -> DataFrame:
    """Parse progress fields of each line (L1).

    Precedence: a line with an epoch-prefixed bar sets 7 fields; else a
    line-leading bar sets 5; else loss and epoch number are read
    independently. A bar line never sets the loss. Values that do not
    parse (``1.2.3``) become NULL; ``sci=True`` also reads exponents.
    """
    line = F.col(col)
    is_e = line.rlike(EPOCH_BAR)
    is_p = ~is_e & line.rlike(PLAIN_BAR)
    is_m = ~is_e & ~is_p

    def g(pat, i):
        return F.regexp_extract(line, pat, i)

    def num(pat):
        return F.when(line.rlike(pat), g(pat, 1))

    loss_pat = LOSS.replace(r"([\d.]+)", NUM_SCI) if sci else LOSS
    ep_pat = EPOCH_FLOAT.replace(r"([\d.]+)", NUM_SCI) if sci else EPOCH_FLOAT
    sel = {
        "epoch_cur": F.when(is_e, g(EPOCH_BAR, 1)),
        "epoch_total": F.when(is_e, g(EPOCH_BAR, 2)),
        "pct": F.when(is_e, g(EPOCH_BAR, 3)).when(is_p, g(PLAIN_BAR, 1)),
        "step_cur": F.when(is_e, g(EPOCH_BAR, 4)).when(is_p, g(PLAIN_BAR, 2)),
        "step_total": F.when(is_e, g(EPOCH_BAR, 5)).when(is_p, g(PLAIN_BAR, 3)),
        "elapsed": F.when(is_e, strip(g(EPOCH_BAR, 6))).when(is_p, strip(g(PLAIN_BAR, 4))),
        "eta": F.when(is_e, strip(g(EPOCH_BAR, 7))).when(is_p, strip(g(PLAIN_BAR, 5))),
        "loss": F.when(is_m, num(loss_pat)),
        "epoch_float": F.when(is_m, num(ep_pat)),
    }
    typed = []
    for name, expr in sel.items():
        if name in ("elapsed", "eta"):
            typed.append(expr.alias(name))
        elif name in ("loss", "epoch_float"):
            typed.append(expr.try_cast("double").alias(name))
        else:
            typed.append(expr.try_cast("int").alias(name))
    kind = F.when(is_e, F.lit("epoch_bar")).when(is_p, F.lit("bar")) \
            .when(line.rlike(loss_pat) | line.rlike(ep_pat), F.lit("metrics"))
    return df.select("*", *typed, kind.alias("kind"))


def carry_forward(df: DataFrame, by: str = "run_id", ord_col: str = "line_no",
                  cols: list[str] = PROGRESS_COLS, chunk: int | None = 1 << 20) -> DataFrame:
    """Progress state after each line: last non-NULL value so far.

    With ``chunk`` set (the default), every run is cut into segments of
    ``chunk`` consecutive line numbers, and one window partitioned by
    (run, segment) computes, for every line, both the running value inside
    its segment and the segment's final value. The final values of earlier
    segments (one row per segment, read from the same window output) give
    each segment its carry-in through a small running window. The input is
    parsed and shuffled once, and a run holding a third of all lines is
    spread over many tasks.
    """
    if chunk is None:
        w = Window.partitionBy(by).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*[c for c in df.columns if c not in cols],
                         *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])
    keep = [c for c in df.columns if c not in cols]
    # a struct is never NULL, so a NULL run is its own group (as in a plain
    # window) and the join below is a plain equality on the window's own keys:
    # both branches read one shuffle of the parsed input and it is kept
    d = df.withColumn("_run", F.struct(F.col(by))) \
          .withColumn("_seg", F.coalesce(F.expr(f"`{ord_col}` div {chunk}"), F.lit(-1)))
    ws = Window.partitionBy("_run", "_seg").orderBy(ord_col)
    run_w = ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_w = ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = d.select(*keep, "_run", "_seg",
                     *[F.last(c, ignorenulls=True).over(run_w).alias(c) for c in cols],
                     *[F.last(c, ignorenulls=True).over(all_w).alias("_end_" + c) for c in cols],
                     F.max(ord_col).over(all_w).alias("_seg_max"))
    ends = local.where(F.col(ord_col) == F.col("_seg_max")).select("_run", "_seg", *["_end_" + c for c in cols])
    wp = Window.partitionBy("_run").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_run", "_seg", *[F.last("_end_" + c, ignorenulls=True).over(wp).alias("_in_" + c)
                                      for c in cols])
    carry = carry.withColumnRenamed("_run", "_c_run").withColumnRenamed("_seg", "_c_seg")
    cond = (local["_run"] == carry["_c_run"]) & (local["_seg"] == carry["_c_seg"])
    j = local.join(carry, cond, "left")
    return j.select(*keep, *[F.coalesce(F.col(c), F.col("_in_" + c)).alias(c) for c in cols])


def progress_latest(parsed: DataFrame, by: str = "run_id", ord_col: str = "line_no",
                    cols: list[str] = PROGRESS_COLS, line_col: str = "line") -> DataFrame:
    """Latest value of every progress field per run (L2).

    Numbers are ``max_by`` with a NULL ordering for lines that do not set the
    field: fixed-width buffers, so a hash aggregate, partial before the shuffle. The strings
    (elapsed, eta; a bar sets both) have no such buffer: the hash aggregate
    keeps the number of the last line that sets them, and they are read from
    those lines, one per run, which alone are parsed again. Of lines that repeat a
    number the largest text counts."""
    kinds = {f.name: f.dataType.simpleString() for f in parsed.schema}
    texts = [c for c in cols if kinds[c] == "string"]
    values = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ord_col))).alias(c) for c in cols if c not in texts]
    if not texts:
        return parsed.groupBy(by).agg(*values).select(by, *cols)
    some = F.coalesce(*[F.col(c) for c in texts]).isNotNull()
    won = parsed.groupBy(by).agg(*values, F.max(F.when(some, F.col(ord_col))).alias("_at")).withColumnRenamed(by, "_by")
    lines = parsed.select(by, ord_col, *([line_col] if line_col in kinds else texts))
    last = won.select(F.col("_by").alias("_run"), "_at").where("_at is not null")
    rows = lines.join(last, lines[by].eqNullSafe(last["_run"]) & (lines[ord_col] == last["_at"])).drop("_run", "_at")
    if line_col in kinds:
        rows = parse_progress(rows, line_col)
    first = Window.partitionBy(by).orderBy(*[F.col(c).desc_nulls_last() for c in texts])
    rows = rows.where(some).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col(by).alias("_run"), *texts)
    return won.join(rows, won["_by"].eqNullSafe(rows["_run"]), "left").select(F.col("_by").alias(by), *cols)


def tail_n(df: DataFrame, by: str = "run_id", ord_col: str = "line_no", n: int = K.TAIL_LINES,
           fanout: int | None = None) -> DataFrame:
    """Last ``n`` lines per run (W2); planned with WindowGroupLimit (and, with
    ``fanout``, a first level per partition bucket, see ``combine``)."""
    from corpusmill.operators.combine import _local_top
    if fanout:
        df = _local_top(df, [by], n, ord_col, fanout, desc=True)
    w = Window.partitionBy(by).orderBy(F.col(ord_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _prefix_rx(prefixes) -> str:
    return r"\A(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"


def error_start(lines, prefixes=K.ERROR_PREFIXES) -> Column:
    """Line number of the last tail line whose stripped text opens with an
    error prefix (NULL when none), from ``ARRAY<STRUCT<o, l>>``."""
    arr = F.col(lines) if isinstance(lines, str) else lines
    rx = _prefix_rx(prefixes)
    return F.array_max(F.transform(F.filter(arr, lambda x: strip(x["l"]).rlike(rx)), lambda x: x["o"]))


def excerpt_from_lines(lines, prefixes=K.ERROR_PREFIXES, start=None) -> Column:
    """Error excerpt from an ordered ``ARRAY<STRUCT<o: line number, l: line>>``
    (a run's tail): start at the last line whose stripped text opens with an
    error prefix (none: the whole tail), join, strip, escape; an empty
    result falls back to the whole tail, then to a fixed message.

    ``start`` is that line number when the caller has it already (the batch
    path computes it as a codegen'd aggregate); otherwise it is searched in
    the array, which suits the few rows of a streaming tail.
    """
    arr = F.col(lines) if isinstance(lines, str) else lines
    if start is None:
        start = error_start(arr, prefixes)
    from_err = F.filter(arr, lambda x: start.isNull() | (x["o"] >= start))
    snippet = strip(F.array_join(F.transform(from_err, lambda x: x["l"]), "\n"))
    whole = strip(F.array_join(F.transform(arr, lambda x: x["l"]), "\n"))
    text = F.when(snippet != "", snippet).when(whole != "", whole).otherwise(F.lit(K.NO_OUTPUT_MESSAGE))
    return html_escape(text)


def error_excerpt(log: DataFrame, exits: DataFrame | None = None, by: str = "run_id",
                  ord_col: str = "line_no", col: str = "line", prefixes=K.ERROR_PREFIXES,
                  n: int = K.TAIL_LINES, failed_only: bool = True) -> DataFrame:
    """Error excerpt per (failed) run (L4) from its last ``n`` lines; every
    group holds at most ``n`` lines (see ``excerpt_from_lines``)."""
    tail = tail_n(log.select(by, ord_col, col), by, ord_col, n)
    is_err = strip(F.col(col)).rlike(_prefix_rx(prefixes))
    g = tail.groupBy(by).agg(
        F.max(F.when(is_err, F.col(ord_col))).alias("_start"),
        F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(col).alias("l")))).alias("_lines"))
    out = g.select(by, excerpt_from_lines("_lines", prefixes, start=F.col("_start")).alias("excerpt"))
    if exits is not None and failed_only:
        out = out.join(exits.where(F.col("rc") != 0).select(by), by, "left_semi")
    return out


def run_outcome(latest: DataFrame, exits: DataFrame, by: str = "run_id") -> DataFrame:
    """Exit 0: complete with pct forced to 100; otherwise failed."""
    j = exits.join(latest, by, "left")
    ok = F.col("rc") == 0
    return j.select(by, "rc",
                    F.when(ok, F.lit("complete")).otherwise(F.lit("failed")).alias("status"),
                    F.when(ok, F.lit(100)).otherwise(F.col("pct")).alias("pct"),
                    *[c for c in latest.columns if c not in (by, "pct")])


def progress_display(latest: DataFrame, total_epochs: int = 1, by: str = "run_id",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Display values of a progress card (L6): defaults for missing fields,
    4-decimal loss, percent label only above 6; ``idle`` when no progress
    field was ever set (the card shows the waiting state then)."""
    dash = "—"
    pct = F.coalesce(F.col("pct"), F.lit(0))

    def or_q(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("?"))

    def or_dash(c):
        return F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(dash)).otherwise(F.col(c))

    present = [c for c in PROGRESS_COLS if c in latest.columns]
    idle = F.lit(True)
    for c in present:
        idle = idle & F.col(c).isNull()
    return latest.select(
        by,
        *keep,
        idle.alias("idle"),
        pct.alias("pct"),
        F.concat(or_q("epoch_cur"), F.lit("/"),
                 F.coalesce(F.col("epoch_total").cast("string"), F.lit(str(total_epochs)))).alias("epoch_label"),
        F.concat(or_q("step_cur"), F.lit("/"), or_q("step_total")).alias("step_label"),
        F.when(F.col("loss").isNull(), F.lit(dash)).otherwise(F.format_string("%.4f", F.col("loss"))).alias("loss_label"),
        or_dash("elapsed").alias("elapsed_label"),
        or_dash("eta").alias("eta_label"),
        F.when(pct > 6, F.concat(pct.cast("string"), F.lit("%"))).otherwise(F.lit("")).alias("pct_label"),
    )

