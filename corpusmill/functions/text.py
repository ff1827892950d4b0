"""Column-level text functions (all JVM-side, inside whole-stage codegen).

Python and Java disagree on several regex and whitespace details; the
helpers here pin the Python behaviour the corpus rules were written for:

* whitespace is the 29-code-point Unicode set of ``str.isspace`` (Java's
  ``\\s`` covers 6 of them and ``trim`` only strips U+0020);
* ``.`` must stop only at ``\\n`` (Java's ``.`` also stops at ``\\r``,
  U+0085, U+2028, U+2029 unless ``(?d)`` is set);
* anchors are ``\\A`` / ``\\z`` (Java's ``$`` tolerates trailing line ends).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.constants import CLEAN_BRACKETS, CLEAN_PARENS, WS, WS_CHARS, WS_RANGES  # noqa: F401  (fixed values)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace.

    ``btrim`` with the explicit 29-character set is a native string scan
    (no regex), several times faster than an anchored ``regexp_replace``.
    """
    return F.btrim(_c(col), F.lit(WS_CHARS))


def remove_ws(col) -> Column:
    """Python ``re.sub(r"\\s+", "", x)``: delete every whitespace character."""
    return F.translate(_c(col), WS_CHARS, "")


def is_blank(col) -> Column:
    """True when the string is empty or only whitespace (Python ``not x.strip()``)."""
    return strip(col) == F.lit("")


def clip(col, keep: int, threshold: int | None = None, suffix: str = "") -> Column:
    """Truncation family.

    * ``clip(c, 1400)`` - hard cut to 1400 code points;
    * ``clip(c, 300, suffix='...')`` - first 300 plus suffix, always;
    * ``clip(c, 1400, threshold=1500, suffix='...')`` - cut only when longer
      than the threshold, then add the suffix.
    """
    c = _c(col)
    cut = F.substring(c, 1, keep)
    if suffix:
        cut = F.concat(cut, F.lit(suffix))
    if threshold is None:
        return cut
    return F.when(F.length(c) > threshold, cut).otherwise(c)


def hash_bucket(col, n: int) -> Column:
    """Deterministic bucket in [0, n): first 32 bits of md5 as an integer.

    Stands in for a per-process salted string hash; the same value is
    computed in SQL as ``('0x' || substr(md5(x), 1, 8))::BIGINT % n``.
    """
    hi = F.conv(F.substring(F.md5(_c(col)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(hi, F.lit(n))


def pick(col_key, choices: list[str]) -> Column:
    """Choose one of ``choices`` by the md5 bucket of ``col_key``."""
    arr = F.array(*[F.lit(s) for s in choices])
    return F.element_at(arr, (hash_bucket(col_key, len(choices)) + 1).cast("int"))


def dedupe_key(col, casefold: bool = True, prefix_len: int | None = None,
               fallback=None) -> Column:
    """Whitespace-free, optionally case-folded text; with ``prefix_len`` only
    its first code points (the prefix rule merges texts that differ later)."""
    c = _c(col)
    if fallback is not None:
        c = F.coalesce(c, _c(fallback))
    c = F.coalesce(c, F.lit(""))
    k = remove_ws(c)
    if casefold:
        k = F.lower(k)
    return k if prefix_len is None else F.substring(k, 1, prefix_len)


def short_id(col) -> Column:
    """First 8 hex digits of md5."""
    return F.substring(F.md5(_c(col)), 1, 8)


def slug(col) -> Column:
    """Lower case, spaces to underscores."""
    return F.replace(F.lower(_c(col)), F.lit(" "), F.lit("_"))


def query_url(base: str, col) -> Column:
    """Search URL with spaces as ``+``."""
    return F.concat(F.lit(base), F.replace(_c(col), F.lit(" "), F.lit("+")))


def html_escape(col) -> Column:
    """Escape ``&`` first, then ``<`` and ``>``."""
    c = F.replace(_c(col), F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def after_last(col, marker: str) -> Column:
    """Text after the last ``marker``, stripped; the whole text if absent."""
    return strip(F.substring_index(_c(col), marker, -1))


def clean_brackets(col) -> Column:
    """Delete ``[...]`` (shortest) and ``(c)`` up to the end of the line."""
    return F.regexp_replace(_c(col), CLEAN_BRACKETS, "")


def clean_parens(col) -> Column:
    """Delete ``[...]``, ``(...)`` and whole lines that open with a bracket."""
    return F.regexp_replace(_c(col), CLEAN_PARENS, "")


def whole_match(col, char_class: str) -> Column:
    """True when every character of the text is in ``char_class``."""
    return _c(col).rlike(rf"\A{char_class}+\z")
