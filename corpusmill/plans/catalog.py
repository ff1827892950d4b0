"""Registered queries: one per operator of the inventory, on the given tables.

Every query reads whole tables from ``sf_dir`` (or data Spark derives from
them) and returns a DataFrame whose columns are aliased exactly like the
matching oracle SQL in ``corpusmill.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import constants as K
from corpusmill.functions import text as X
from corpusmill.operators import (chat, clean, combine, dedupe, filters, pairs, policy, report,
                                  runlog, score, tokens)
from corpusmill.plans import corpus_builder as CB
from corpusmill.session import scratch_dir
from corpusmill.sources import builtin  # noqa: F401  (registers the built-in sources)
from corpusmill.sources import crawl as CR
from corpusmill.sources import html as H
from corpusmill.sources import jsonl as J
from corpusmill.sources import registry as REG
from corpusmill.sources import sinks as S
from corpusmill.sources.tables import SEED_RANK, make_ord, rank_map, read_table, scan_pages, scan_passages, \
    seed_from_benchmark, select_sources

# ---------------------------------------------------------------- fixture setup
SOURCES = [f"src{i}" for i in range(20)]
LICENSE_CYCLE = ["public_domain", "cc_by", "cc_by_sa", "research_only", "proprietary", "fair_use_summary"]
LANG_ORDER = ["en", "fr", "de", "es"]
CHOSEN = ["src3", "src1", "src7", "unknown_src", "src1"]
CATEGORIES = {
    "english_function_words": ["the", "of", "and"],
    "french_function_words": ["le", "la", "des"],
    "german_function_words": ["der", "die", "und"],
    "long_words": ["ingthe", "mentre"],
    "empty": [],
}
SEARCH_BASE = "https://example.org/search/?q="
PACK_BLOCK, PACK_SHARDS, EOS = 256, 4, "</s>"
PACK_ORDER = 1 << 12         # text ids are packed in the order of so many md5 buckets


def license_of(source_col: str = "source"):
    """Fixture map source -> licence type (cycle over six types, one unknown)."""
    idx = F.substring(F.col(source_col), 4, 3).cast("int") % len(LICENSE_CYCLE)
    return F.element_at(F.array(*[F.lit(x) for x in LICENSE_CYCLE]), idx + 1)


def source_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, LICENSE_CYCLE[i % len(LICENSE_CYCLE)], f"Collection {s} (archive)",
             "metadata_only" if i % 5 == 4 else None, f"Volume {i}")
            for i, s in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "source string, license string, attribution string, "
                                       "modality string, title string")


def _docs(spark, d, cols=("doc_id", "text", "lang", "source")):
    return read_table(spark, d, "documents", list(cols))


def _ranked_docs(spark, d):
    return _docs(spark, d).withColumn("source_rank", F.element_at(rank_map(SOURCES), F.col("source")))


def _run_log(spark, d):
    return runlog.run_log_from_events(read_table(spark, d, "events", ["event_id", "ts", "user_id", "value"]))


def _exits(spark, d):
    return runlog.run_exits_from_events(read_table(spark, d, "events", ["user_id"]))


# ---------------------------------------------------------------- sources
def q_scan_pages(spark, d):
    return scan_pages(spark, d)


def q_scan_passages(spark, d):
    return scan_passages(_docs(spark, d))


def q_select_sources(spark, d):
    return select_sources(_docs(spark, d, ("doc_id", "source")), CHOSEN, known=SOURCES) \
        .select("doc_id", "source", "source_rank")


def _jsonl_lines(docs: DataFrame) -> DataFrame:
    """Two-format JSONL lines derived from every document (its shape chosen
    by doc_id % 4), plus blank / whitespace-only lines."""
    k = F.col("doc_id") % 4
    nul = {"ignoreNullFields": "false"}
    rich = F.to_json(F.struct("doc_id", F.concat(F.lit("Question "), F.col("doc_id").cast("string")).alias("instruction"),
                              F.col("text").alias("response")))
    plain = F.to_json(F.struct("doc_id", "text"))
    rich_null = F.to_json(F.struct("doc_id", F.lit(None).cast("string").alias("instruction"),
                                   F.col("text").alias("response")), nul)
    other = F.to_json(F.struct("doc_id", F.lit("orphan").alias("instruction"), F.col("text").alias("body")))
    line = F.when(k == 0, rich).when(k == 1, plain).when(k == 2, rich_null).otherwise(other)
    # every document also contributes one empty or whitespace-only line
    blanks = docs.select(F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit(" \t ")).alias("value"))
    return docs.select(line.alias("value")).unionByName(blanks)


def q_scan_jsonl_two_format(spark, d):
    path = scratch_dir(spark, "two-format")
    _jsonl_lines(_docs(spark, d, ("doc_id", "text"))).write.text(path)
    return J.scan_two_format(spark, path, K.PROMPTS_4, extra_fields="doc_id bigint") \
        .select("doc_id", "rich", "user_msg", "asst_msg")


def q_scan_abstracts(spark, d):
    path = scratch_dir(spark, "abstracts")
    docs = _docs(spark, d)
    docs.select(F.concat(F.lit("Study "), F.col("doc_id").cast("string"), F.lit(" of "), F.col("source")).alias("title"),
                F.col("text").alias("abstract"), F.col("source"), license_of().alias("license")) \
        .write.json(path)
    return J.scan_abstracts(spark, path)


def q_reuse_or_build(spark, d):
    path = scratch_dir(spark, "corpus")

    def build():
        return _flagship(spark, d).select(*S.FLAT_FIELDS)

    J.reuse_or_build(spark, path, build)             # first call builds and writes
    return J.reuse_or_build(spark, path, build, schema=", ".join(f"{c} string" for c in S.FLAT_FIELDS))


# ---------------------------------------------------------------- sinks
def _flagship(spark, d):
    return CB.build_corpus(_docs(spark, d), seed_from_benchmark(spark, d), SOURCES)


def q_build_corpus_prefix_key(spark, d):
    """The collector's own rule: 80-character key, content cut, short content dropped."""
    c = CB.build_corpus(_docs(spark, d), seed_from_benchmark(spark, d), SOURCES, prefix_len=80, cut=1400, min_len=30)
    return c.select(*S.FLAT_FIELDS)


def q_build_corpus(spark, d):
    return _flagship(spark, d).select(*S.FLAT_FIELDS)


def q_build_corpus_exact_key(spark, d):
    """Training-path variant: case-sensitive key, seeds only below 20 rows."""
    c = CB.build_corpus(_docs(spark, d), seed_from_benchmark(spark, d), SOURCES, casefold=False,
                        floor="if_below", floor_n=20)
    return c.select(*S.FLAT_FIELDS)


def q_sink_jsonl(spark, d):
    path = scratch_dir(spark, "flat-jsonl")
    S.sink_jsonl(_flagship(spark, d), path, ordered=True)
    return spark.read.schema(", ".join(f"{c} string" for c in S.FLAT_FIELDS)).json(path)


def _expanded_items(spark, d):
    docs = _docs(spark, d)
    items = docs.select("source", F.col("doc_id").cast("string").alias("text_id"),
                        F.col("lang").alias("language"), F.col("text").alias("content"))
    # meta keys in item order: source, text_id, language, [title], license, attribution, [modality]
    dim = source_dim(spark).select("source",
                                   F.when(F.substring("source", 4, 3).cast("int") % 2 == 0, F.col("title")).alias("title"),
                                   "license", "attribution", "modality")
    return pairs.with_provenance(items, dim)


def q_sink_nested_meta(spark, d):
    path = scratch_dir(spark, "nested-jsonl")
    items = CB.format_expanded(_expanded_items(spark, d))
    S.sink_nested(items, path)
    back = spark.read.schema("text string, meta struct<source string, text_id string, language string, "
                             "title string, license string, attribution string, modality string>").json(path)
    return back.select("text", "meta.*")


# ---------------------------------------------------------------- html
def _pages(spark, d):
    return read_table(spark, d, "pages", ["page_id", "html"])


def q_html_passages(spark, d):
    return H.html_passages(_pages(spark, d), "p")


def q_html_main_text(spark, d):
    return H.html_main_text(_pages(spark, d))


def _described_pages(spark, d):
    """Pages with a description meta tag, a description paragraph, both or neither (page_id % 4)."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    meta = F.concat(F.lit('<meta name="description" content="Overview of page '), n, F.lit(' with enough words to be kept here">'))
    para = F.concat(F.lit('<p class="description">Paragraph on page '), n, F.lit(', long enough to pass the length test</p>'))
    none = F.lit("")
    return _pages(spark, d).select("page_id", F.concat(F.when((k == 0) | (k == 2), meta).otherwise(none),
                                                       F.when((k == 1) | (k == 2), para).otherwise(none), "html").alias("html"))


def q_html_description(spark, d):
    """Both orders: the meta tag first (with the length test), the paragraph first."""
    pages = _described_pages(spark, d)
    return H.html_description(pages, "meta").withColumn("prefer", F.lit("meta")).unionByName(
        H.html_description(pages, "p", min_len=None).withColumn("prefer", F.lit("p")))


def q_html_errors_split(spark, d):
    """Main texts and parse errors of one pass over the pages."""
    return H.html_main_text(_pages(spark, d), errors=True).select("page_id", "main_text", "error")


def q_jsonl_rejects(spark, d):
    path = scratch_dir(spark, "rejects")
    ids = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("doc_id", "text"))).otherwise(F.concat(F.lit('{"broken": '), ids))
    _docs(spark, d, ("doc_id", "text")).select(line.alias("value")).write.text(path)
    return J.rejects(spark, path)


def _bracketed(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("text"), F.lit(" (c) "),
                                          F.col("lang")).alias("t"))


def q_clean_brackets(spark, d):
    return clean.cleanup(_bracketed(spark, d), "t", "brackets", out="cleaned").select("doc_id", "cleaned")


def q_clean_parens(spark, d):
    docs = _docs(spark, d)
    t = F.concat(F.lit("("), F.col("source"), F.lit(") "), F.col("text"), F.lit("\n  ["), F.col("lang"),
                 F.lit("] trailing words\n(c) "), F.col("doc_id").cast("string"), F.lit(" end [x"))
    return clean.cleanup(docs.select("doc_id", t.alias("t")), "t", "parens", out="cleaned").select("doc_id", "cleaned")


def q_split_paragraphs(spark, d):
    return clean.split_paragraphs(_docs(spark, d, ("doc_id", "text")), "text", para_sep="\n", min_len=60,
                                  keep=["doc_id"])


# ---------------------------------------------------------------- filters
def q_script_filter(spark, d):
    lines = clean.split_paragraphs(_docs(spark, d, ("doc_id", "text")), "text", para_sep="\n", min_len=-1,
                                   keep=["doc_id"], out="line")
    return filters.script_filter(lines, "line", K.LATIN_CLASS, min_len=21).select("doc_id", "pos")


def q_min_length(spark, d):
    docs = _docs(spark, d, ("doc_id", "text")).select("doc_id", X.clip("text", 1400).alias("content"))
    return filters.min_length(docs, "content", 30).select("doc_id", F.length("content").alias("content_len"))


def q_subset_contains(spark, d):
    return filters.subset_contains(read_table(spark, d, "part", ["p_partkey", "p_name"]), "p_name", "RED")


def _licensed_docs(spark, d):
    return _docs(spark, d, ("doc_id", "source")).withColumn("license_type", license_of())


def q_license_filter(spark, d):
    return policy.license_filter(_licensed_docs(spark, d), policy.policy_table(spark), commercial=True)


def q_license_filter_noncommercial(spark, d):
    return policy.license_filter(_licensed_docs(spark, d), policy.policy_table(spark), commercial=False)


def q_license_rejects(spark, d):
    return policy.license_rejects(_licensed_docs(spark, d), policy.policy_table(spark), commercial=True)


# ---------------------------------------------------------------- projections
def q_truncate_variants(spark, d):
    t = "text"
    return _docs(spark, d, ("doc_id", "text")).select(
        "doc_id",
        X.clip(t, 1400).alias("hard_cut"),
        X.clip(t, 1400, threshold=1500, suffix="...").alias("cut_marked"),
        X.clip(t, 300, suffix="…").alias("lead300"),
        X.clip(t, 200, suffix="...").alias("lead200"),
        X.clip(t, 120).alias("preview120"),
        X.clip(t, 100).alias("preview100"))


def q_template_assign(spark, d):
    docs = _docs(spark, d, ("doc_id", "text"))
    return docs.select("doc_id", X.pick("text", K.PROMPTS_7).alias("prompt7"),
                       X.pick(F.col("doc_id").cast("string"), K.PROMPTS_5).alias("prompt5"),
                       X.pick("text", K.PROMPTS_4).alias("prompt4"))


def q_pair_echo(spark, d):
    return pairs.pair_echo(_docs(spark, d, ("doc_id", "text")), "text").select("doc_id", "instruction", "response")


def _titled_docs(spark, d):
    kv = []
    for i, s in enumerate(SOURCES):
        kv += [F.lit(s), F.lit(f"Volume {i}")]
    return _docs(spark, d, ("doc_id", "text", "source")).withColumn(
        "title", F.element_at(F.create_map(*kv), F.col("source")))


def q_pair_quoted(spark, d):
    return pairs.pair_quoted(_titled_docs(spark, d), "text", "title").select("doc_id", "instruction", "response")


def q_pair_commentary(spark, d):
    return pairs.pair_commentary(_docs(spark, d, ("doc_id", "text")), "text").select("doc_id", "instruction", "response")


def q_pair_summary(spark, d):
    part = read_table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand", "p_size"])
    part = part.withColumn("summary", F.concat(F.col("p_type"), F.lit(" item of "), F.col("p_brand"),
                                               F.lit(", size "), F.col("p_size").cast("string")))
    return pairs.pair_summary(part, "p_name", "summary").select("p_partkey", "instruction", "response")


def q_text_ids(spark, d):
    part = read_table(spark, d, "part", ["p_partkey", "p_name"])
    return part.select("p_partkey", X.short_id("p_name").alias("short_id"), X.slug("p_name").alias("slug"),
                       X.query_url(SEARCH_BASE, "p_name").alias("query_url"))


def q_provenance(spark, d):
    return _expanded_items(spark, d).select("text_id", "source", "license", "attribution", "modality", "title")


def q_render_sections(spark, d):
    docs = _docs(spark, d, ("doc_id", "text"))
    return docs.select("doc_id", pairs.render_sections(X.pick("text", K.PROMPTS_7), "text").alias("text"))


def q_default_fill(spark, d):
    docs = _docs(spark, d)
    labels = read_table(spark, d, "labels", ["doc_id", "quality", "toxic"])
    raw = docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.col("text")).alias("instruction"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("ok "), F.col("lang"))).alias("response"),
        F.when(F.col("quality").isNotNull(), F.col("source")).alias("source"),
        F.when(F.col("toxic") == 1, F.col("lang")).alias("language"),
        F.col("lang").alias("text"))
    return pairs.fill_record(raw, response_fallback="text", keep=["doc_id"])


def q_dedupe_key(spark, d):
    docs = _docs(spark, d, ("doc_id", "text"))
    return docs.select("doc_id", X.dedupe_key("text", prefix_len=80).alias("key_folded"),
                       X.dedupe_key("text", casefold=False, prefix_len=80).alias("key_exact"),
                       F.md5(X.dedupe_key("text")).alias("whole_key_md5"))


def _conversations(spark, d):
    return read_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])


def q_render_chat(spark, d):
    return chat.render_conversations(_conversations(spark, d), "plain")


def q_render_prompt(spark, d):
    """Every user turn as a one-message prompt ending at the assistant header."""
    users = _conversations(spark, d).where(F.col("role") == "user")
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return users.select("conv_id", "turn", chat.render_chat(msgs, "plain", add_generation_prompt=True).alias("prompt"))


def q_extract_answer(spark, d):
    r = chat.render_conversations(_conversations(spark, d), "plain")
    return r.select("conv_id", chat.extract_answer("text").alias("answer"))


def q_html_escape(spark, d):
    p = _pages(spark, d).select("page_id", X.html_escape("html").alias("e"))
    return p.select("page_id", F.length("e").alias("escaped_len"), F.md5("e").alias("escaped_md5"))


def q_messages_build(spark, d):
    docs = _docs(spark, d, ("doc_id", "text"))
    instr = X.pick(F.col("doc_id").cast("string"), K.PROMPTS_5)
    return docs.select("doc_id", chat.render_chat(pairs.to_messages(instr, F.col("text")), "plain").alias("text"))


# ---------------------------------------------------------------- aggregations
def _ord_docs(spark, d):
    return _ranked_docs(spark, d).withColumn("ord", make_ord("source_rank", "doc_id"))


def q_dedupe_first_wins(spark, d):
    docs = _ord_docs(spark, d)
    return dedupe.dedupe_first(docs, X.dedupe_key("text"), hash_key=True).select("doc_id", "source")


def q_dedupe_semi_join(spark, d):
    """First-wins by aggregate and left-semi join (J4), whole key."""
    docs = _ord_docs(spark, d)
    return dedupe.dedupe_first(docs, X.dedupe_key("text"), hash_key=True, strategy="semi").select("doc_id", "source")


def q_dedupe_whole_text(spark, d):
    """Exact-duplicate removal on the whole text (SHA-256 of the full string
    as the key), first in collection order wins."""
    docs = _ord_docs(spark, d)
    return dedupe.dedupe_first(docs, F.coalesce(F.col("text"), F.lit("")), hash_key=True).select("doc_id", "source")


def q_collection_report(spark, d):
    docs = _ord_docs(spark, d)
    return report.collection_report(docs, X.dedupe_key("text"), "text")


def q_alignment_score(spark, d):
    conv = _conversations(spark, d).where(F.col("role") == "assistant")
    return score.alignment_score(conv, "text", CATEGORIES, keep=["conv_id", "turn"])


# ---------------------------------------------------------------- windows / sort / set
def _paragraph_passages(spark, d):
    docs = _ranked_docs(spark, d)
    p = clean.split_paragraphs(docs, "text", para_sep="\n", min_len=30,
                               keep=["doc_id", "source", "source_rank"])
    return p.withColumn("ord", make_ord("source_rank", "doc_id", "pos"))


def q_cap_per_group(spark, d):
    return combine.cap_per_group(_paragraph_passages(spark, d), "source", 50).select("source", "doc_id", "pos")


def q_cap_per_text(spark, d):
    return clean.split_paragraphs(_docs(spark, d, ("doc_id", "text")), "text", para_sep="\n", min_len=30, keep=["doc_id"],
                                  cap=3).select("doc_id", "pos")


def q_cap_global(spark, d):
    docs = _ord_docs(spark, d).where(F.length("text") > 20)
    return combine.cap_total(docs, 500).select("doc_id", "source")


def q_preview(spark, d):
    return combine.preview(_flagship(spark, d), 5, 100, suffix="")


def q_union_sources(spark, d):
    docs = _docs(spark, d, ("doc_id", "text", "lang"))
    frames = [docs.where(F.col("lang") == lg).withColumn("ord", make_ord(F.lit(i), "doc_id"))
              for i, lg in enumerate(LANG_ORDER)]
    u = combine.union_sources(frames)
    return u.select("doc_id", "lang", "ord")


def _echo_pairs(spark, d):
    docs = _ranked_docs(spark, d)
    p = pairs.pair_echo(docs, "text")
    return p.select("instruction", "response", make_ord("source_rank", "doc_id").alias("ord"))


def q_seed_floor_always(spark, d):
    return combine.with_floor(_echo_pairs(spark, d), seed_from_benchmark(spark, d), "always") \
        .select("ord", "instruction")


def _small_collected(spark, d, table, key, name):
    t = read_table(spark, d, table, [key, name])
    return t.select(F.col(name).alias("instruction"), F.col(name).alias("response"),
                    make_ord(F.lit(0), key).alias("ord"))


def q_seed_floor_below(spark, d):
    return combine.with_floor(_small_collected(spark, d, "nation", "n_nationkey", "n_name"),
                              seed_from_benchmark(spark, d), "if_below", 20).select("ord", "instruction")


def q_seed_floor_below_small(spark, d):
    return combine.with_floor(_small_collected(spark, d, "region", "r_regionkey", "r_name"),
                              seed_from_benchmark(spark, d), "if_below", 20).select("ord", "instruction")


# ---------------------------------------------------------------- tokens
def _tokens(spark, d):
    return tokens.tokenize(_docs(spark, d, ("doc_id", "text")), "text", "tokens")


def q_tokenize(spark, d):
    t = _tokens(spark, d)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("joined"))


def _length_tokenizer():
    """An external tokenizer with an in-memory vocabulary: a word's id is its length."""
    return lambda texts: [[len(w) for w in t.split(" ")] for t in texts]


def q_tokenize_external(spark, d):
    t = tokens.tokenize(_docs(spark, d, ("doc_id", "text")), "text", "ids", factory=_length_tokenizer, key="length")
    return t.select("doc_id", F.size("ids").alias("n_ids"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("joined"))


def _strict_tokenizer():
    """The length tokenizer, unable to read texts whose first word is a single letter."""
    def ids(texts):
        if any(len(t.split(" ")[0]) == 1 for t in texts):
            raise ValueError("cannot read")
        return [[len(w) for w in t.split(" ")] for t in texts]
    return ids


def q_tokenize_skips(spark, d):
    """Texts that an external tokenizer cannot read are left out; the others
    of their batch stay (E3)."""
    t = tokens.tokenize(_docs(spark, d, ("doc_id", "text")), "text", "ids", factory=_strict_tokenizer, key="strict", on_error="skip")
    return t.select("doc_id", F.size("ids").alias("n_ids"))


def q_token_truncate(spark, d):
    t = tokens.truncate_tokens(_tokens(spark, d), "tokens", 512)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                    F.array_join("tokens", " ").alias("joined"))


def q_pack_sequences(spark, d):
    b = tokens.pack(_tokens(spark, d), "doc_id", "tokens", block=PACK_BLOCK, eos=EOS, shards=PACK_SHARDS, unique=True)
    return b.select("shard", "block", "n_tokens", F.array_join("tokens", " ").alias("joined"))


def q_expanded_packed(spark, d):
    """Formatted texts of the expanded corpus, tokenized and packed; their ids are text."""
    items = _expanded_items(spark, d).withColumnRenamed("license", "license_type")
    out = CB.expanded_corpus(items, policy.policy_table(spark), commercial=True).select("text_id", "text")
    b = tokens.pack(tokens.tokenize(out, "text", "tokens"), "text_id", "tokens", block=PACK_BLOCK, eos=EOS, shards=1,
                    buckets=PACK_ORDER, unique=True)
    return b.select("block", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


# ---------------------------------------------------------------- run log
def _parsed(spark, d):
    return runlog.parse_progress(_run_log(spark, d))


INT_FIELDS = ["epoch_cur", "epoch_total", "pct", "step_cur", "step_total"]


def _ints_as_double(df):
    """Nullable integer fields presented as DOUBLE so that both engines hand
    the comparison the same column type (NULL -> NaN on both sides)."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in INT_FIELDS else F.col(c) for c in df.columns])


def q_log_parse(spark, d):
    return _ints_as_double(_parsed(spark, d).select("run_id", "line_no", "kind", *runlog.PROGRESS_COLS))


def q_progress_forward_fill(spark, d):
    p = _parsed(spark, d).select("run_id", "line_no", *runlog.PROGRESS_COLS)
    return _ints_as_double(runlog.carry_forward(p, "run_id", "line_no", runlog.PROGRESS_COLS))


def q_progress_latest(spark, d):
    return runlog.progress_latest(_parsed(spark, d))


def q_tail_n(spark, d):
    return runlog.tail_n(_run_log(spark, d), "run_id", "line_no", 30).select("run_id", "line_no")


def q_error_excerpt(spark, d):
    return runlog.error_excerpt(_run_log(spark, d), _exits(spark, d))


def q_run_outcome(spark, d):
    return runlog.run_outcome(runlog.progress_latest(_parsed(spark, d)), _exits(spark, d)) \
        .select("run_id", "rc", "status", "pct", "epoch_cur", "step_cur", "loss")


def q_progress_display(spark, d):
    return runlog.progress_display(runlog.progress_latest(_parsed(spark, d)), total_epochs=3)


def q_tail_stream(spark, d):
    from corpusmill.streaming.tail import run_tail_stream_once
    return run_tail_stream_once(spark, _run_log(spark, d))


def q_progress_stream(spark, d):
    from corpusmill.streaming.progress import run_progress_stream_once
    return run_progress_stream_once(spark, _run_log(spark, d))


def q_live_runlog(spark, d):
    """Progress, tail and error excerpt of every run from one stream of several
    micro-batches, out of the live tables."""
    from corpusmill.streaming import live
    root = live.run_live_once(spark, _run_log(spark, d), files_per_batch=2, every=2)
    tails = live.tail_table(spark, root).read().groupBy("run_id").agg(F.count("*").cast("int").alias("n_lines"))
    return live.latest(spark, root).join(live.errors(spark, root), "run_id").join(tails, "run_id")


# ---------------------------------------------------------------- end-to-end plans
def q_training_input(spark, d):
    path = scratch_dir(spark, "train-input")
    S.sink_jsonl(_flagship(spark, d), path)
    recs = J.scan_two_format(spark, path, K.PROMPTS_4)
    t = CB.training_input(recs, 512)
    return t.select(F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), F.size("tokens").alias("n_tokens"))


CHAT_MARKERS = {"start": "<|turn|>", "role_sep": "\n", "end": "<|end|>\n"}


def q_expanded_corpus_chat(spark, d):
    items = _expanded_items(spark, d).withColumnRenamed("license", "license_type")
    kept = policy.license_filter(items, policy.policy_table(spark), commercial=True)
    return CB.format_expanded(kept, style="chat", markers=CHAT_MARKERS).select("text_id", "source", "text")


def q_expanded_corpus(spark, d):
    items = _expanded_items(spark, d).withColumnRenamed("license", "license_type")
    out = CB.expanded_corpus(items, policy.policy_table(spark), commercial=True)
    return out.select("text_id", "source", "text")


def q_expanded_corpus_cut(spark, d):
    """The collector's own cut: content over 1500 is cut to 1400 and marked."""
    items = _expanded_items(spark, d).withColumnRenamed("license", "license_type")
    kept = policy.license_filter(items, policy.policy_table(spark), commercial=True)
    return CB.format_expanded(kept, cut=1400, threshold=1500).select("text_id", "source", "text")


# ---------------------------------------------------------------- plug-in sources, crawl, preview, run report
def q_crawl_paragraphs(spark, d):
    return CR.crawl_paragraphs(_pages(spark, d), separator="\n", para_sep="\n", min_len=30, cap=50)


def q_registry_sources(spark, d):
    u = REG.build_sources(spark, ["crawl", "documents", "not_registered", "crawl"],
                          {"crawl": {"data_dir": d}, "documents": {"data_dir": d}})
    return u.select("source_rank", "source", "text_id", make_ord("source_rank", "doc_ord", "pos").alias("ord"),
                    F.md5("content").alias("content_md5"))


def q_build_from_sources(spark, d):
    params = {"crawl": {"data_dir": d}, "documents": {"data_dir": d}}
    c = CB.build_corpus_from_sources(spark, ["crawl", "documents"], params, seed_from_benchmark(spark, d))
    return c.select(*S.FLAT_FIELDS)


def q_expanded_from_sources(spark, d):
    """Registered sources with their provenance, licence-checked, commercial off and on."""
    params = {"titled": {"data_dir": d, "subset": "SRC1", "license": "cc_by", "attribution": "Titled collection"},
              "documents": {"data_dir": d, "license": "research_only", "modality": "text"},
              "crawl": {"data_dir": d, "style": "brackets", "min_len": 60, "cap": 80, "license": "public_domain"}}
    items = REG.build_sources(spark, ["titled", "documents", "crawl"], params).withColumnRenamed("license", "license_type")
    out = []
    for commercial in (False, True):
        kept = policy.license_filter(items, policy.policy_table(spark), commercial=commercial)
        out.append(CB.format_expanded(kept).select("source_rank", "text_id", "license_type", "attribution", "modality",
                                                   F.md5("text").alias("text_md5"), F.lit(commercial).alias("commercial")))
    return out[0].unionByName(out[1])


def q_staged_sources(spark, d):
    """Sources staged twice; the second time the pages cannot be read, so the
    crawl comes from its first version (D4)."""
    from corpusmill.sources.staging import build_staged
    root, bad = scratch_dir(spark, "staged"), scratch_dir(spark, "bad-pages")
    spark.createDataFrame([("no parquet",)], "value string").write.text(f"{bad}/pages.parquet")
    out = None
    for pages_dir in (d, bad):
        params = {"crawl": {"data_dir": pages_dir}, "documents": {"data_dir": d}}
        out, states = build_staged(spark, ["crawl", "documents"], params, root)
    cached = F.array(*[F.lit(k) for k, v in states.items() if v == "cached"])
    return out.select("source_rank", "source", "text_id", F.md5("content").alias("content_md5"),
                      (F.array_contains(cached, "crawl") & (F.col("source_rank") == 0)).alias("cached"))


def q_selected_passages(spark, d):
    from corpusmill.sources.builtin import selected
    return selected(spark, d, selectors="p", char_class=K.LATIN_CLASS, min_len=21, language="english")


def q_page_sources(spark, d):
    """Three page sources of one scan and one parse of every page."""
    dir_ = scratch_dir(spark, "titled-pages")
    head = F.concat(F.lit("<head><title>Page "), F.col("page_id").cast("string"), F.lit("</title><meta name='description' content='"),
                    F.lit("Overview of page "), F.col("page_id").cast("string"), F.lit(" with enough words to be kept here'></head>"))
    _pages(spark, d).select("page_id", F.concat(head, F.col("html")).alias("html")).write.parquet(f"{dir_}/pages.parquet")
    params = {"crawl": {"data_dir": dir_, "license": "public_domain"}, "described": {"data_dir": dir_, "license": "cc_by"},
              "selected": {"data_dir": dir_, "selectors": "p", "char_class": K.LATIN_CLASS, "language": "english"}}
    u = REG.build_sources(spark, ["described", "crawl", "selected"], params)
    return u.select("source_rank", "source", "text_id", "language", "title", "license", F.md5("content").alias("content_md5"),
                    make_ord("source_rank", "doc_ord", "pos").alias("ord"))


def q_collect_corpus(spark, d):
    """Two written builds whose floor is decided in the pass that writes the
    sources: one above the floor, one below it (the first regions only)."""
    out = None
    seed = seed_from_benchmark(spark, d)
    n_seed = int(seed.agg(F.max("seed_id")).first()[0] or 0)
    few = scratch_dir(spark, "few-documents")
    read_table(spark, d, "region", ["r_regionkey", "r_name"]).select(
        F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("text"), F.lit("en").alias("lang"), F.lit("regions").alias("source")) \
        .write.parquet(f"{few}/documents.parquet")
    for name, data_dir in (("many", d), ("few", few)):
        path = scratch_dir(spark, f"collected-{name}")
        top = int(read_table(spark, data_dir, "documents", ["doc_id"]).agg(F.max("doc_id")).first()[0] or 0)
        CB.collect_corpus(spark, ["documents"], {"documents": {"data_dir": data_dir}}, seed, path, floor="if_below", ordered=True,
                          spans=[(0, 0, top), (SEED_RANK, 0, n_seed)])
        back = spark.read.schema(", ".join(f"{c} string" for c in S.FLAT_FIELDS)).json(path).withColumn("corpus", F.lit(name))
        out = back if out is None else out.unionByName(back)
    return out


def q_preview_file(spark, d):
    """The first lines of an ordered corpus; its ranges come from the ids alone."""
    path = scratch_dir(spark, "preview-jsonl")
    top = read_table(spark, d, "documents", ["doc_id"]).agg(F.max("doc_id")).first()[0] or 0
    seeds = read_table(spark, d, "benchmark", ["item_id"]).agg(F.max("item_id")).first()[0] or 0
    S.sink_jsonl(_flagship(spark, d), path, ordered=True,
                 spans=[(i, 0, int(top)) for i in range(len(SOURCES))] + [(SEED_RANK, 0, int(seeds))])
    return J.preview_lines(spark, path, 3, 120)


def q_run_report(spark, d):
    parsed = _parsed(spark, d)
    latest = runlog.progress_latest(parsed)
    out = runlog.run_outcome(latest, _exits(spark, d))
    disp = runlog.progress_display(out, total_epochs=3, keep=("status",))   # one frame, no self-join
    errs = runlog.error_excerpt(_run_log(spark, d), _exits(spark, d))
    return (disp.join(errs, "run_id", "left")
               .select("run_id", "status", "pct", "epoch_label", "step_label", "loss_label", "eta_label",
                       "pct_label", "excerpt"))


QUERIES = {
    "scan_pages": q_scan_pages,
    "scan_passages": q_scan_passages,
    "select_sources": q_select_sources,
    "scan_jsonl_two_format": q_scan_jsonl_two_format,
    "scan_abstracts": q_scan_abstracts,
    "reuse_or_build": q_reuse_or_build,
    "build_corpus": q_build_corpus,
    "build_corpus_exact_key": q_build_corpus_exact_key,
    "build_corpus_prefix_key": q_build_corpus_prefix_key,
    "sink_jsonl": q_sink_jsonl,
    "sink_nested_meta": q_sink_nested_meta,
    "html_passages": q_html_passages,
    "html_main_text": q_html_main_text,
    "html_description": q_html_description,
    "html_errors_split": q_html_errors_split,
    "jsonl_rejects": q_jsonl_rejects,
    "clean_brackets": q_clean_brackets,
    "clean_parens": q_clean_parens,
    "split_paragraphs": q_split_paragraphs,
    "script_filter": q_script_filter,
    "min_length": q_min_length,
    "subset_contains": q_subset_contains,
    "license_filter": q_license_filter,
    "license_filter_noncommercial": q_license_filter_noncommercial,
    "license_rejects": q_license_rejects,
    "truncate_variants": q_truncate_variants,
    "template_assign": q_template_assign,
    "pair_echo": q_pair_echo,
    "pair_quoted": q_pair_quoted,
    "pair_commentary": q_pair_commentary,
    "pair_summary": q_pair_summary,
    "text_ids": q_text_ids,
    "provenance": q_provenance,
    "render_sections": q_render_sections,
    "default_fill": q_default_fill,
    "dedupe_key": q_dedupe_key,
    "render_chat": q_render_chat,
    "render_prompt": q_render_prompt,
    "extract_answer": q_extract_answer,
    "html_escape": q_html_escape,
    "messages_build": q_messages_build,
    "dedupe_first_wins": q_dedupe_first_wins,
    "dedupe_whole_text": q_dedupe_whole_text,
    "dedupe_semi_join": q_dedupe_semi_join,
    "collection_report": q_collection_report,
    "alignment_score": q_alignment_score,
    "cap_per_group": q_cap_per_group,
    "cap_per_text": q_cap_per_text,
    "cap_global": q_cap_global,
    "preview": q_preview,
    "union_sources": q_union_sources,
    "seed_floor_always": q_seed_floor_always,
    "seed_floor_below": q_seed_floor_below,
    "seed_floor_below_small": q_seed_floor_below_small,
    "tokenize": q_tokenize,
    "tokenize_external": q_tokenize_external,
    "tokenize_skips": q_tokenize_skips,
    "token_truncate": q_token_truncate,
    "pack_sequences": q_pack_sequences,
    "expanded_packed": q_expanded_packed,
    "log_parse": q_log_parse,
    "progress_forward_fill": q_progress_forward_fill,
    "progress_latest": q_progress_latest,
    "tail_n": q_tail_n,
    "error_excerpt": q_error_excerpt,
    "run_outcome": q_run_outcome,
    "progress_display": q_progress_display,
    "progress_stream": q_progress_stream,
    "tail_stream": q_tail_stream,
    "live_runlog": q_live_runlog,
    "training_input": q_training_input,
    "expanded_corpus": q_expanded_corpus,
    "expanded_corpus_chat": q_expanded_corpus_chat,
    "expanded_corpus_cut": q_expanded_corpus_cut,
    "crawl_paragraphs": q_crawl_paragraphs,
    "registry_sources": q_registry_sources,
    "build_from_sources": q_build_from_sources,
    "expanded_from_sources": q_expanded_from_sources,
    "selected_passages": q_selected_passages,
    "page_sources": q_page_sources,
    "staged_sources": q_staged_sources,
    "collect_corpus": q_collect_corpus,
    "preview_file": q_preview_file,
    "run_report": q_run_report,
}
