"""End-to-end jobs as lazy DataFrame plans.

* ``build_corpus`` - dataset builder: sources -> pairs -> seed floor ->
  first-wins dedupe -> flat record (one plan; one job at the write).
* ``training_input`` - corpus JSONL -> chat text -> tokens, truncated.
* ``expanded_corpus`` - sources with provenance -> licence filter ->
  formatted text -> nested records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import constants as K
from corpusmill.functions.text import clip, dedupe_key, hash_bucket, pick
from corpusmill.operators import chat, combine, dedupe, pairs, policy, report, tokens
from corpusmill.sources import sinks
from corpusmill.sources.jsonl import first_lines
from corpusmill.sources.tables import SEED_RANK, make_ord, rank_map


FLAT_SCHEMA = ", ".join(f"{c} string" for c in sinks.FLAT_FIELDS)


def documents_as_passages(docs: DataFrame, source_order: list[str]) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.col("lang").alias("language"), F.col("text").alias("content"),
        F.element_at(rank_map(source_order), F.col("source")).alias("source_rank"))


def build_corpus(docs: DataFrame, seed: DataFrame, source_order: list[str],
                 templates: list[str] = K.PROMPTS_7, casefold: bool = True,
                 floor: str = "always", floor_n: int = 20, prefix_len: int | None = None,
                 cut: int | None = None, min_len: int | None = None) -> DataFrame:
    """Flat instruction records with ``ord``; commentary-style pairs.

    By default whole texts are kept, and two records are the same only when
    their whole keys are; ``prefix_len``, ``cut`` and ``min_len`` switch the
    prefix rule, the content cut and the length filter on.

    The dedupe key is computed before the shuffle, but the pair texts are
    built from the survivors: the dedupe shuffle carries the content,
    a template bucket and a SHA-256 of the key, not the instruction and response strings.
    """
    p = pairs.commentary_content(documents_as_passages(docs, source_order), "content", cut, min_len)
    tb = hash_bucket("content", len(templates))
    prompt = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("_tb") + 1).cast("int"))
    p = p.select("source", "language", "content", tb.alias("_tb"),
                 make_ord("source_rank", "doc_id").alias("ord"))
    key = lambda c: F.unhex(F.sha2(dedupe_key(c, casefold=casefold, prefix_len=prefix_len), 256))
    p = p.withColumn("_k", key(pairs.commentary_instruction("content", prompt=prompt)))
    allp = combine.with_floor(p, seed, mode=floor, n=floor_n)
    allp = allp.withColumn("_k", F.coalesce(F.col("_k"), key("instruction")))
    kept = dedupe.dedupe_first(allp, F.col("_k"))
    built = kept.select(
        F.coalesce(F.col("instruction"), pairs.commentary_instruction("content", prompt=prompt)).alias("instruction"),
        F.coalesce(F.col("response"), pairs.commentary_response("content")).alias("response"),
        "source", "language", "ord")
    return pairs.fill_record(built, response_fallback=None)


def to_pairs(df: DataFrame, style: "str | dict[int, str]", templates: list[str] = K.PROMPTS_7) -> DataFrame:
    """Passages (with source_rank, doc_ord, pos) -> pairs in a source's style, with ``ord``.
    Sources that share one frame have a style per rank."""
    if isinstance(style, dict):
        styled, instruction, response = df, None, None
        for name in dict.fromkeys(style.values()):
            styled = _styled(styled, name, templates).withColumnsRenamed({"instruction": f"_i_{name}", "response": f"_r_{name}"})
            own = F.col("source_rank").isin([r for r, s in style.items() if s == name])
            i, r = F.col(f"_i_{name}"), F.col(f"_r_{name}")
            instruction = F.when(own, i) if instruction is None else instruction.when(own, i)
            response = F.when(own, r) if response is None else response.when(own, r)
        p = styled.withColumn("instruction", instruction).withColumn("response", response)
    else:
        p = _styled(df, style, templates)
    return p.select("instruction", "response", "source", "language",
                    make_ord("source_rank", "doc_ord", "pos").alias("ord"))


TITLED = ("quoted", "summary")         # pair styles that read the title


def to_contents(df: DataFrame, style: "str | dict[int, str]", templates: list[str] = K.PROMPTS_7) -> DataFrame:
    """Like ``to_pairs``, with content, title and the name of the style in place
    of the pair: a pair holds the content twice, so it is made (``with_pairs``)
    behind the shuffles."""
    to_pairs(df, style, templates)                      # a source without the columns of its style fails here
    by_rank = style if isinstance(style, dict) else None
    named = F.lit(style)
    if by_rank:
        named = F.element_at(F.create_map(*[F.lit(x) for r, s in by_rank.items() for x in (r, s)]), F.col("source_rank"))
    titled = any(s in TITLED for s in (by_rank.values() if by_rank else [style]))
    return df.select("content", (F.col("title") if titled else F.lit(None)).cast("string").alias("title"), named.alias("_style"),
                     "source", "language", make_ord("source_rank", "doc_ord", "pos").alias("ord"))


def _pair_columns(df: DataFrame, styles: list[str], templates: list[str]) -> tuple[DataFrame, dict]:
    """A frame with the rows' own pairs (``_own_*``) and those of every style
    beside them, and the columns of the pair that each row gets."""
    pair = {c: F.col(f"_own_{c}") for c in ("instruction", "response")}
    p = df.withColumns({f"_own_{c}": F.col(c) if c in df.columns else F.lit(None).cast("string") for c in pair})
    if "_style" not in df.columns:
        return p, pair
    pair = {c: F.when(F.col("_style").isNull(), x) for c, x in pair.items()}
    for name in dict.fromkeys(styles):
        p = _styled(p, name, templates).withColumnsRenamed({c: f"_{name}_{c}" for c in pair})
        pair = {c: x.when(F.col("_style") == name, F.col(f"_{name}_{c}")) for c, x in pair.items()}
    return p, pair


def with_pairs(df: DataFrame, styles: list[str], templates: list[str] = K.PROMPTS_7) -> DataFrame:
    """Rows of ``to_contents`` with their instruction and response; rows
    without a style (seeds) keep the ones they have."""
    p, pair = _pair_columns(df, styles, templates)
    return p.select(*[c for c in df.columns if c not in pair], *[x.alias(c) for c, x in pair.items()])


def first_of_key(df: DataFrame, styles: list[str], casefold: bool, prefix_len: int | None,
                 templates: list[str] = K.PROMPTS_7) -> DataFrame:
    """First-wins rows of ``to_contents`` (or pairs) by the key of their
    instruction; the shuffle holds a SHA-256 of it."""
    p, pair = _pair_columns(df, styles, templates)
    key = F.unhex(F.sha2(dedupe_key(pair["instruction"], casefold=casefold, prefix_len=prefix_len), 256))
    keyed = p.select(*[F.col(f"_own_{c}").alias(c) if c in pair else c for c in df.columns], key.alias("_k"))
    return dedupe.dedupe_first(keyed, F.col("_k")).drop("_k")


def _styled(df: DataFrame, style: str, templates: list[str]) -> DataFrame:
    if style == "quoted":
        return pairs.pair_quoted(df, "content", "title", templates)
    if style == "summary":
        return pairs.pair_summary(df, "title", "content")
    if style == "commentary":
        return pairs.pair_commentary(df, "content", templates, cut=None, min_len=None)
    return pairs.pair_echo(df, "content", templates)


def build_corpus_from_sources(spark, chosen: list[str], params: dict, seed: DataFrame | None,
                              casefold: bool = True, floor: str = "always", floor_n: int = 20,
                              prefix_len: int | None = None) -> DataFrame:
    """Dataset builder over registered sources: every chosen source becomes
    pairs in its own style, in the chosen order; seeds are appended (always,
    or only below ``floor_n``); first-wins dedupe; flat record with ``ord``.
    ``chosen=[]``, or only unknown names, with a seed is the seeds-only build."""
    from corpusmill.sources import registry
    if registry.chosen_builders(chosen) or seed is None:
        allp = registry.build_sources(spark, chosen, params, to_pairs=to_contents)
        if seed is not None:
            allp = combine.with_floor(allp, seed, mode=floor, n=floor_n)
    else:
        allp = combine.seed_rows(seed)
    styles = [registry.pair_style(n) for n in registry.chosen_builders(chosen)]
    kept = first_of_key(allp, styles, casefold, prefix_len)
    return pairs.fill_record(with_pairs(kept, styles), response_fallback=None)


def format_expanded(items: DataFrame, templates: list[str] = K.PROMPTS_5, style: str = "plain",
                    lead: str = K.MESSAGE_LEAD, markers: dict | None = None, cut: int | None = None,
                    threshold: int | None = None) -> DataFrame:
    """Formatted training text for expanded items (template by ``text_id``);
    with ``cut`` content longer than ``threshold`` is cut and marked '...'."""
    content = F.col("content") if cut is None else clip("content", cut, threshold=threshold, suffix="...")
    instr = pick(F.coalesce(F.col("text_id"), F.lit("")), templates)
    if style == "chat":
        text = chat.render_chat(pairs.to_messages(instr, content, lead), "template", markers=markers)
    else:
        text = F.concat(F.lit("User: "), instr, F.lit("\n"), content, F.lit("\n\nAssistant: "),
                        F.lit(lead), clip(content, 200, suffix="..."))
    return items.withColumn("text", text)


def expanded_corpus(items: DataFrame, policy_df: DataFrame, commercial: bool = False,
                    check: bool = True, style: str = "plain") -> DataFrame:
    kept = policy.license_filter(items, policy_df, "license_type", commercial=commercial, check=check)
    return format_expanded(kept, style=style)


def training_input(records: DataFrame, max_tokens: int = 512, factory=None, key: str = "default",
                   vocab_size: int = 1 << 20) -> DataFrame:
    """(user, assistant) messages -> plain chat text -> ``input_ids`` and
    ``attention_mask`` truncated to a budget, no padding.

    With ``factory`` (an external tokenizer, see ``tokens.external_ids``)
    the ids come from it; otherwise the text is split natively and every
    token gets its hashed id (``tokens`` is kept alongside).
    """
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("user_msg").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("asst_msg").alias("content")))
    t = records.withColumn("text", chat.render_chat(msgs, "plain"))
    if factory is not None:
        t = tokens.tokenize(t, "text", "input_ids", factory=factory, key=key)
        return tokens.truncate_tokens(t, "input_ids", max_tokens)
    t = tokens.tokenize(t, "text", "tokens")
    t = t.withColumn("input_ids", tokens.hashed_ids("tokens", vocab_size))
    return tokens.truncate_tokens(t, "tokens", max_tokens, also=("input_ids",))


def write_corpus(df: DataFrame, path: str, ordered: bool = False) -> dict:
    """Write the flat corpus and return its row and character totals,
    gathered by ``observe`` during the write itself (no extra job)."""
    holder = {}

    def watch(d):
        holder["df"], holder["obs"] = report.observed(d)
        return holder["df"]

    sinks.sink_jsonl(df, path, ordered=ordered, watch=watch)
    return {"rows": 0, **report.values(holder["obs"])}


def collect_corpus(spark, chosen: list[str], params: dict, seed: DataFrame | None, path: str, casefold: bool = True,
                   floor: str = "always", floor_n: int = 20, prefix_len: int | None = None, ordered: bool = False,
                   spans: list[tuple[int, int, int]] | None = None, stage_dir: str | None = None) -> dict:
    """Build the corpus of registered sources, write it, and return its report:
    rows collected, rows and characters kept per source (A2), from counters of
    the write itself.

    ``if_below`` (U3) decides in the same pass: the sources are written with
    their number counted, without the mark of a complete folder; only when
    fewer than ``floor_n`` rows were collected are they (so few rows) written
    again with the seeds. The sources are scanned and parsed once.

    With ``stage_dir`` every source is staged there first (D4): one that fails
    is taken from its last complete version, or left out; the report says which.
    """
    from corpusmill.sources import registry, staging
    names = registry.chosen_builders(chosen)
    ranks = dict(enumerate(names)) | ({SEED_RANK: "seed"} if seed is not None else {})
    styles = [registry.pair_style(n) for n in names]

    def write(rows: DataFrame, mark: bool, spans=spans) -> tuple[dict, dict]:
        seen, kept = report.Counters(ranks, "collected"), report.Counters(ranks, "kept", "text")
        first = first_of_key(seen.watch(rows), styles, casefold, prefix_len)
        sinks.sink_jsonl(first, path, ordered=ordered, watch=kept.watch, spans=spans, mark=mark,
                         record=lambda df: pairs.fill_record(with_pairs(df, styles), response_fallback=None))
        return seen.read(), kept.read()

    states = {}
    if names and stage_dir:
        first, states = staging.build_staged(spark, chosen, params, stage_dir, to_pairs)
    else:
        first = registry.build_sources(spark, chosen, params, to_pairs=to_contents) if names else None
    later = floor == "if_below" and seed is not None and first is not None
    if floor not in ("always", "if_below"):
        raise ValueError(f"unknown floor mode {floor!r}")
    if first is None and seed is None:
        raise ValueError(f"none of the sources {chosen} is registered" + (f" and readable: {states}" if states else ""))
    rows = combine.seed_rows(seed) if first is None else first if later or seed is None else combine.with_floor(first, seed)
    seen, kept = write(rows, mark=not later)
    if later:
        n_kept, n_seen = sum(s["rows"] for s in kept.values()), sum(s["rows"] for s in seen.values())
        if n_kept < floor_n <= n_seen:
            n_seen = first.limit(floor_n).count()       # a stage that ran twice after a loss may have counted twice
        if n_seen < floor_n:
            # fewer than floor_n rows, read back in their order
            lines = first_lines(spark, path, floor_n).select(F.from_json("value", FLAT_SCHEMA).alias("r")).select("r.*").collect()
            few = spark.createDataFrame([(*r, i) for i, r in enumerate(lines)], FLAT_SCHEMA + ", ord bigint").drop("text")
            again = spans and [(0, 0, floor_n), *[s for s in spans if s[0] == SEED_RANK]]
            of_seed, with_seed = write(few.unionByName(combine.seed_rows(seed), allowMissingColumns=True), mark=True, spans=again)
            seen["seed"], kept["seed"] = of_seed["seed"], with_seed["seed"]
        else:
            sinks.complete(spark, path)
    return {"rows": sum(s["rows"] for s in kept.values()), "chars": sum(s["chars"] for s in kept.values()),
            "sources": {name: {"collected": seen[name]["rows"], "kept": kept[name]["rows"], "chars": kept[name]["chars"]} for name in kept},
            **({"staged": states} if states else {})}
