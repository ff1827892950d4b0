"""Chat rendering (P12) and answer extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import _c, after_last

PLAIN_LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
PLAIN_SEP = "\n\n"


def _label(role: Column, labels: dict[str, str]) -> Column:
    kv = []
    for k, v in labels.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), role), role)


def render_message(role, content, style: str = "plain", markers: dict | None = None,
                   labels: dict[str, str] = PLAIN_LABELS) -> Column:
    """One message as text.

    ``plain``: ``Label: content``. ``template``: ``start + role + '\\n' +
    content + end`` with the marker strings of the model's chat template
    passed in ``markers`` (they live in the tokenizer files, not here).
    """
    r, c = _c(role), _c(content)
    if style == "plain":
        return F.concat(_label(r, labels), F.lit(": "), c)
    m = markers or {}
    return F.concat(F.lit(m.get("start", "")), r, F.lit(m.get("role_sep", "\n")), c,
                    F.lit(m.get("end", "\n")))


def _separator(style: str) -> str:
    return PLAIN_SEP if style == "plain" else ""


def generation_suffix(style: str = "plain", markers: dict | None = None) -> str:
    if style == "plain":
        return PLAIN_SEP + "Assistant:"
    m = markers or {}
    return m.get("start", "") + "assistant" + m.get("role_sep", "\n")


def render_chat(messages, style: str = "plain", add_generation_prompt: bool = False,
                markers: dict | None = None) -> Column:
    """Render an ``ARRAY<STRUCT<role, content>>`` column as one string."""
    parts = F.transform(_c(messages), lambda m: render_message(m["role"], m["content"], style, markers))
    out = F.array_join(parts, _separator(style))
    if add_generation_prompt:
        out = F.concat(out, F.lit(generation_suffix(style, markers)))
    return out


def render_conversations(conv: DataFrame, style: str = "plain", add_generation_prompt: bool = False,
                         markers: dict | None = None, chunk_turns: int = 256,
                         assemble: bool = True) -> DataFrame:
    """Render one text per conversation from message rows (conv_id, turn, role, text).

    Messages are rendered row by row, then concatenated in two levels:
    first per (conversation, block of ``chunk_turns`` turns), then the
    blocks per conversation. A very long conversation is thus assembled by
    many tasks; only one string per block reaches the final step. With
    ``assemble=False`` the blocks are returned as rows (conv_id, chunk,
    text; joined with the separator in chunk order they give the text), so
    no row grows with the length of a conversation.
    """
    sep = _separator(style)
    piece = render_message("role", "text", style, markers)
    chunks = (conv.select("conv_id", "turn", piece.alias("piece"))
                  .groupBy("conv_id", F.floor(F.col("turn") / chunk_turns).alias("chunk"))
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))),
                                                lambda s: s["piece"]), sep).alias("piece")))
    if not assemble:
        return chunks.withColumnRenamed("piece", "text")
    out = (chunks.groupBy("conv_id")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))),
                                               lambda s: s["piece"]), sep).alias("text")))
    if add_generation_prompt:
        out = out.withColumn("text", F.concat("text", F.lit(generation_suffix(style, markers))))
    return out


def extract_answer(col, marker: str = "Assistant:") -> Column:
    """Text after the last assistant marker, stripped; the whole text if absent."""
    return after_last(col, marker)
