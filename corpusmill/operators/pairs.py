"""Instruction/response pair builders, provenance, rendering, defaults.

All builders are plain column expressions: one projection, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import constants as K
from corpusmill.functions.text import _c, clip, pick


def template_assign(df: DataFrame, key_col: str, templates: list[str],
                    out: str = "prompt") -> DataFrame:
    """Deterministic template per row, chosen by the md5 bucket of ``key_col``."""
    return df.withColumn(out, pick(key_col, templates))


def pair_echo(df: DataFrame, content_col: str = "content",
              templates: list[str] = K.PROMPTS_7, lead: str = K.ECHO_LEAD) -> DataFrame:
    """Prompt + blank line + content; response = lead + content."""
    c = F.col(content_col)
    prompt = pick(c, templates)
    return df.withColumn("instruction", F.concat(prompt, F.lit("\n\n"), c)) \
             .withColumn("response", F.concat(F.lit(lead), c))


def pair_quoted(df: DataFrame, content_col: str = "content", title_col: str = "title",
                templates: list[str] = K.PROMPTS_7,
                lead_before: str = "A passage from ",
                lead_after: str = ", read as one of the work's recurring themes.") -> DataFrame:
    """Content in double quotes; response = lead that names the work."""
    c = F.col(content_col)
    prompt = pick(c, templates)
    return df.withColumn("instruction", F.concat(prompt, F.lit('\n\n"'), c, F.lit('"'))) \
             .withColumn("response", F.concat(F.lit(lead_before), F.col(title_col), F.lit(lead_after)))


def commentary_content(df: DataFrame, content_col: str = "content", cut: int | None = None,
                       min_len: int | None = None) -> DataFrame:
    """Content cut to ``cut`` code points; rows shorter than ``min_len`` after
    the cut dropped (F2). Neither by default."""
    if cut is not None:
        df = df.withColumn(content_col, clip(content_col, cut))
    return df if min_len is None else df.where(F.length(F.col(content_col)) >= min_len)


def commentary_instruction(content, templates: list[str] = K.PROMPTS_7, prompt=None) -> Column:
    """Prompt (chosen by the content's bucket unless given) + blank line + content."""
    c = _c(content)
    return F.concat(pick(c, templates) if prompt is None else prompt, F.lit("\n\n"), c)


def commentary_response(content, lead: str = K.COMMENTARY_LEAD, answer_len: int = 300,
                        answer_suffix: str = "…") -> Column:
    """Lead + first ``answer_len`` code points + ellipsis."""
    return F.concat(F.lit(lead), clip(_c(content), answer_len, suffix=answer_suffix))


def pair_commentary(df: DataFrame, content_col: str = "content",
                    templates: list[str] = K.PROMPTS_7, lead: str = K.COMMENTARY_LEAD,
                    cut: int | None = 1400, min_len: int | None = 30, answer_len: int = 300,
                    answer_suffix: str = "…") -> DataFrame:
    """Content cut to 1400; rows shorter than 30 after the cut are dropped;
    response = lead + first 300 + ellipsis (P5, F2)."""
    out = commentary_content(df, content_col, cut, min_len)
    c = F.col(content_col)
    return out.withColumn("instruction", commentary_instruction(c, templates)) \
              .withColumn("response", commentary_response(c, lead, answer_len, answer_suffix))


def pair_summary(df: DataFrame, title_col: str, summary_col: str,
                 question: tuple[str, str] = ("What is covered in '", "'?"),
                 answer: tuple[str, str] = ("'", "' covers: ")) -> DataFrame:
    """Question from a title, answer from a summary."""
    t, s = F.col(title_col), F.col(summary_col)
    return df.withColumn("instruction", F.concat(F.lit(question[0]), t, F.lit(question[1]))) \
             .withColumn("response", F.concat(F.lit(answer[0]), t, F.lit(answer[1]), s))


def with_provenance(df: DataFrame, source_dim: DataFrame, on: str = "source") -> DataFrame:
    """Attach per-source licence / attribution / modality.

    The dimension has one row per source and is broadcast: dealt out by source,
    the passages of a large one would be read by one task. A key that occurs
    twice in the dimension fails the job, as it would multiply rows.
    """
    return df.join(F.broadcast(unique_keys(source_dim, on)), on, "left")


def unique_keys(dim: DataFrame, key: str) -> DataFrame:
    """The dimension with one row per key; fails when a key occurs twice."""
    rest = [c for c in dim.columns if c != key]
    one = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    r = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key)))).otherwise(F.col("_r"))
    return one.select(F.col(key), r.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def render_sections(instruction, response) -> Column:
    """Two headed sections: instruction, blank line, response."""
    return F.concat(F.lit(K.SECTION_INSTRUCTION), _c(instruction),
                    F.lit(K.SECTION_RESPONSE), _c(response))


def fill_record(df: DataFrame, response_fallback: str | None = "text",
                keep: list[str] | tuple[str, ...] = ("ord",)) -> DataFrame:
    """Output record with defaults filled (P10).

    ``response`` falls back to ``response_fallback`` when absent, but the
    rendered ``text`` uses the raw response (empty when absent), as the
    corpus writer does.
    """
    cols = set(df.columns)

    def get(name):
        return F.col(name) if name in cols else F.lit(None).cast("string")

    instr = F.coalesce(get("instruction"), F.lit(""))
    resp_raw = F.coalesce(get("response"), F.lit(""))
    if response_fallback:
        resp = F.coalesce(get("response"), get(response_fallback), F.lit(""))
    else:
        resp = resp_raw
    return df.select(
        *[c for c in keep if c in cols],
        instr.alias("instruction"),
        resp.alias("response"),
        F.coalesce(get("source"), F.lit(K.DEFAULT_SOURCE)).alias("source"),
        F.coalesce(get("language"), F.lit(K.DEFAULT_LANGUAGE)).alias("language"),
        render_sections(instr, resp_raw).alias("text"),
    )


def to_messages(instruction, content, lead: str = K.MESSAGE_LEAD, answer_len: int = 200) -> Column:
    """[user: instruction + blank line + content, assistant: lead + first 200 + '...']."""
    c = _c(content)
    user = F.struct(F.lit("user").alias("role"),
                    F.concat(_c(instruction), F.lit("\n\n"), c).alias("content"))
    asst = F.struct(F.lit("assistant").alias("role"),
                    F.concat(F.lit(lead), clip(c, answer_len, suffix="...")).alias("content"))
    return F.array(user, asst)
