"""Independent DuckDB formulations of the registered queries.

Each string runs on DuckDB with the fixture tables registered as views.
The SQL is written from the operator semantics (not generated from the
Spark plans); only parameters (templates, leads, fixture maps) are shared.
Differences the SQL has to respect: RE2 instead of Java regex (``.``
already stops only at ``\\n``; no ``(?d)``), 1-based list subscripts,
``regexp_replace(..., 'g')`` for global replacement, ``chr(10)`` for
newlines.
"""

from __future__ import annotations

from corpusmill.functions import constants as K
from corpusmill.functions.text import WS
from corpusmill.operators import runlog as R
from corpusmill.plans import catalog as C
from corpusmill.sources.html import VOID

NL = "chr(10)"


def lit(s: str) -> str:
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return f" || {NL} || ".join(quoted) if len(parts) > 1 else quoted[0]


def lst(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def bucket(x: str, n: int) -> str:
    return f"((('0x' || substr(md5({x}), 1, 8))::BIGINT) % {n})"


def pick(x: str, items) -> str:
    return f"({lst(items)})[{bucket(x, len(items))} + 1]"


def clip(x: str, keep: int, threshold: int | None = None, suffix: str = "") -> str:
    cut = f"substring({x}, 1, {keep})" + (f" || {lit(suffix)}" if suffix else "")
    if threshold is None:
        return f"({cut})"
    return f"(CASE WHEN length({x}) > {threshold} THEN {cut} ELSE {x} END)"


def key(x: str, casefold: bool = True, prefix: int | None = None) -> str:
    inner = f"regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g')"
    inner = f"lower({inner})" if casefold else inner
    return f"substring({inner}, 1, {prefix})" if prefix else inner


def ordx(rank: str, doc: str, pos: str = "0") -> str:
    return f"((({rank})::BIGINT << 56) + (({doc})::BIGINT << 20) + ({pos}))"


RANK = "CAST(substr(source, 4) AS BIGINT)"
SRCI = "CAST(substr(source, 4) AS INTEGER)"
LICENSE = f"({lst(C.LICENSE_CYCLE)})[{SRCI} % {len(C.LICENSE_CYCLE)} + 1]"
SECTIONS = lambda i, r: f"({lit(K.SECTION_INSTRUCTION)} || {i} || {lit(K.SECTION_RESPONSE)} || {r})"


# ---------------------------------------------------------------- corpus
CUT, WHOLE = "substring(text, 1, 1400) AS content", "text AS content"
SHORT = " WHERE length(content) >= 30\n"
FLAGSHIP_PREFIX = f"""
WITH d AS (
  SELECT doc_id, source, lang AS language, {CUT}, {RANK} AS rk FROM documents
), p AS (
  SELECT {pick('content', K.PROMPTS_7)} || {NL} || {NL} || content AS instruction,
         {lit(K.COMMENTARY_LEAD)} || substring(content, 1, 300) || {lit('…')} AS response,
         source, language, {ordx('rk', 'doc_id')} AS ord
  FROM d WHERE length(content) >= 30
), s AS (
  SELECT text AS instruction, text AS response, CAST(NULL AS VARCHAR) AS source,
         CAST(NULL AS VARCHAR) AS language, {ordx('127', 'item_id')} AS ord FROM benchmark
), a AS (SELECT * FROM p UNION ALL SELECT * FROM s),
k AS (SELECT *, {key('instruction', prefix=80)} AS dk FROM a),
w AS (SELECT dk, min(ord) AS ord FROM k GROUP BY dk)
SELECT coalesce(instruction, '') AS instruction, coalesce(response, '') AS response,
       coalesce(source, 'fallback') AS source, coalesce(language, 'english') AS language,
       {SECTIONS("coalesce(instruction, '')", "coalesce(response, '')")} AS text
FROM k WHERE ord IN (SELECT ord FROM w)
"""
FLAGSHIP = (FLAGSHIP_PREFIX.replace(CUT, WHOLE).replace(SHORT, "\n")
            .replace(key("instruction", prefix=80), key("instruction")))

EXPANDED_CONTENT = "(CASE WHEN length(text) > 1500 THEN substring(text, 1, 1400) || '...' ELSE text END)"
EXPANDED_TEXT = (f"'User: ' || {pick('CAST(doc_id AS VARCHAR)', K.PROMPTS_5)} || {NL} || ec || {NL} || {NL} "
                 f"|| 'Assistant: ' || {lit(K.MESSAGE_LEAD)} || substring(ec, 1, 200) || '...'")
EXPANDED_ITEMS = f"""
SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS text_id, lang AS language, text AS content,
       text AS ec,
       {LICENSE} AS license,
       'Collection ' || source || ' (archive)' AS attribution,
       CASE WHEN {SRCI} % 5 = 4 THEN 'metadata_only' END AS modality,
       CASE WHEN {SRCI} % 2 = 0 THEN 'Volume ' || CAST({SRCI} AS VARCHAR) END AS title
FROM documents
"""

# ---------------------------------------------------------------- html
UNESCAPE = lambda x: ("replace(replace(replace(replace(replace(replace(replace(" + x +  # noqa: E731
                      ", '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), "
                      "'&#39;', ''''), '&amp;', '&')")
HTML_MAIN = f"""
WITH b AS (
  SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)</body>.*', '') AS body
  FROM pages
), c AS (
  SELECT page_id,
         regexp_replace(regexp_replace(regexp_replace(body,
            '(?s)<script[^>]*>.*?</script>', '<>', 'g'),
            '(?s)<style[^>]*>.*?</style>', '<>', 'g'),
            '(?s)<!--.*?-->', '<>', 'g') AS body
  FROM b
), c2 AS (
  -- a known entity name ended by a character that cannot continue a name
  -- is a complete reference even without ';' (one cut off at the end of a
  -- truncated page is not)
  SELECT page_id, regexp_replace(body, '&(amp|quot|copy|middot|lt|gt)([^-.a-zA-Z0-9;])', '&\\1;\\2', 'g') AS body
  FROM c
), parts AS (
  SELECT page_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i
  FROM (SELECT page_id, string_split_regex(body, '<[^>]*>') AS pieces FROM c2)
), s AS (SELECT page_id, i, {strip(UNESCAPE('piece'))} AS s FROM parts)
SELECT page_id, string_agg(s, {NL} ORDER BY i) AS main_text FROM s WHERE s <> '' GROUP BY page_id
"""

# ---------------------------------------------------------------- run log
_E = "event_id"
TWO = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
S_ = lambda x: f"CAST({x} AS VARCHAR)"
V100 = "CAST(floor(value * 100) AS BIGINT)"
RUN_LOG = f"""
SELECT user_id AS run_id, event_id AS line_no, ts,
  CASE event_id % 5
    WHEN 0 THEN 'Epoch ' || {S_('event_id % 3 + 1')} || '/3:  ' || {S_('event_id % 101')} || '%|###| '
                || {S_('event_id % 151')} || '/150 [' || {TWO('event_id % 60')} || ':' || {TWO('event_id % 59')}
                || '<' || {TWO('event_id % 58')} || ':' || {TWO('event_id % 57')} || ', 1.25it/s]'
    WHEN 1 THEN (CASE WHEN event_id % 2 = 0 THEN '  ' ELSE '' END) || {S_('event_id % 100')} || '%|##| '
                || {S_('event_id % 77')} || '/77 [00:' || {TWO('event_id % 60')} || '<01:' || {TWO('event_id % 53')}
                || ', 2.50it/s]'
    WHEN 2 THEN '{{''loss'': ' || {S_('event_id % 7')} || '.' || lpad({S_(V100 + ' % 10000')}, 4, '0')
                || ', ''learning_rate'': 2e-05, ''epoch'': ' || {S_('event_id % 3')} || '.' || {S_('event_id % 10')} || '}}'
    WHEN 3 THEN CASE (event_id // 5) % 3
                  WHEN 0 THEN 'Traceback (most recent call last):'
                  WHEN 1 THEN 'ValueError: bad shape <' || {S_(V100)} || '> & more'
                  ELSE '  File "train.py", line ' || {S_('event_id % 400')} END
    ELSE 'Saving checkpoint step ' || {S_('event_id')} || ' to <out> & logs'
  END AS line
FROM events
"""
EXITS = "SELECT DISTINCT user_id AS run_id, CAST(user_id % 2 AS INTEGER) AS rc FROM events"

# RE2 versions of the progress patterns ('.' already stops only at '\n').
EB = K.EPOCH_BAR.replace("(?d)", "")
PB = K.PLAIN_BAR.replace("(?d)", "")
LOSS, EPF = K.LOSS, K.EPOCH_FLOAT


def _rx(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


PARSED = f"""
WITH l AS ({RUN_LOG}),
m AS (
  SELECT *, regexp_matches(line, {_rx(EB)}) AS is_e,
         (NOT regexp_matches(line, {_rx(EB)})) AND regexp_matches(line, {_rx(PB)}) AS is_p
  FROM l
)
SELECT run_id, line_no, ts, line,
  TRY_CAST(CASE WHEN is_e THEN regexp_extract(line, {_rx(EB)}, 1) END AS INTEGER) AS epoch_cur,
  TRY_CAST(CASE WHEN is_e THEN regexp_extract(line, {_rx(EB)}, 2) END AS INTEGER) AS epoch_total,
  TRY_CAST(CASE WHEN is_e THEN regexp_extract(line, {_rx(EB)}, 3)
                WHEN is_p THEN regexp_extract(line, {_rx(PB)}, 1) END AS INTEGER) AS pct,
  TRY_CAST(CASE WHEN is_e THEN regexp_extract(line, {_rx(EB)}, 4)
                WHEN is_p THEN regexp_extract(line, {_rx(PB)}, 2) END AS INTEGER) AS step_cur,
  TRY_CAST(CASE WHEN is_e THEN regexp_extract(line, {_rx(EB)}, 5)
                WHEN is_p THEN regexp_extract(line, {_rx(PB)}, 3) END AS INTEGER) AS step_total,
  CASE WHEN is_e THEN {strip('regexp_extract(line, ' + _rx(EB) + ', 6)')}
       WHEN is_p THEN {strip('regexp_extract(line, ' + _rx(PB) + ', 4)')} END AS elapsed,
  CASE WHEN is_e THEN {strip('regexp_extract(line, ' + _rx(EB) + ', 7)')}
       WHEN is_p THEN {strip('regexp_extract(line, ' + _rx(PB) + ', 5)')} END AS eta,
  TRY_CAST(CASE WHEN NOT is_e AND NOT is_p AND regexp_matches(line, {_rx(LOSS)})
                THEN regexp_extract(line, {_rx(LOSS)}, 1) END AS DOUBLE) AS loss,
  TRY_CAST(CASE WHEN NOT is_e AND NOT is_p AND regexp_matches(line, {_rx(EPF)})
                THEN regexp_extract(line, {_rx(EPF)}, 1) END AS DOUBLE) AS epoch_float,
  CASE WHEN is_e THEN 'epoch_bar' WHEN is_p THEN 'bar'
       WHEN regexp_matches(line, {_rx(LOSS)}) OR regexp_matches(line, {_rx(EPF)}) THEN 'metrics' END AS kind
FROM m
"""
PCOLS = R.PROGRESS_COLS
LATEST = (f"SELECT run_id, " + ", ".join(f"arg_max({c}, line_no) FILTER (WHERE {c} IS NOT NULL) AS {c}"
                                         for c in PCOLS) + f" FROM ({PARSED}) GROUP BY run_id")
INTS = ["epoch_cur", "epoch_total", "pct", "step_cur", "step_total"]
DBL = lambda c: f"CAST({c} AS DOUBLE) AS {c}" if c in INTS else c
FFILL = (f"SELECT run_id, line_no, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY line_no "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in PCOLS) + f" FROM ({PARSED})")
FFILL = f"SELECT run_id, line_no, {', '.join(DBL(c) for c in PCOLS)} FROM ({FFILL})"
ERR_RX = _rx(r"\A(?:" + "|".join(K.ERROR_PREFIXES) + ")")
EXCERPT = f"""
WITH t AS (
  SELECT run_id, line_no, line FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS rn FROM ({RUN_LOG})
  ) WHERE rn <= 30
), s AS (
  SELECT run_id, max(line_no) FILTER (WHERE regexp_matches({strip('line')}, {ERR_RX})) AS st FROM t GROUP BY run_id
), g AS (
  SELECT t.run_id,
         {strip(f"string_agg(line, {NL} ORDER BY line_no) FILTER (WHERE s.st IS NULL OR line_no >= s.st)")} AS snip,
         {strip(f"string_agg(line, {NL} ORDER BY line_no)")} AS whole
  FROM t JOIN s USING (run_id) GROUP BY t.run_id
)
SELECT run_id,
  replace(replace(replace(
    CASE WHEN coalesce(snip, '') <> '' THEN snip WHEN whole <> '' THEN whole ELSE {lit(K.NO_OUTPUT_MESSAGE)} END,
    '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS excerpt
FROM g WHERE run_id IN (SELECT run_id FROM ({EXITS}) WHERE rc <> 0)
"""

# ---------------------------------------------------------------- tokens
TOK_RX = "'[^" + WS[1:-1] + "]+'"
TOKENS = f"SELECT doc_id, regexp_extract_all(text, {TOK_RX}) AS tokens FROM documents"
PACK = f"""
WITH r AS (
  SELECT {bucket('CAST(doc_id AS VARCHAR)', C.PACK_SHARDS)} AS shard, doc_id,
         list_append(tokens, {lit(C.EOS)}) AS t FROM ({TOKENS})
), r2 AS (
  SELECT *, sum(len(t)) OVER (PARTITION BY shard ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len(t) AS st FROM r
), toks AS (
  SELECT shard, st + i AS off, tok FROM (
    SELECT shard, st, unnest(t) AS tok, unnest(range(len(t))) AS i FROM r2)
)
SELECT shard, CAST(off // {C.PACK_BLOCK} AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n_tokens,
       string_agg(tok, ' ' ORDER BY off) AS joined
FROM toks GROUP BY shard, off // {C.PACK_BLOCK}
"""

# ---------------------------------------------------------------- chat
LABEL = "CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END"
CHAT = (f"SELECT conv_id, string_agg({LABEL} || ': ' || text, {NL} || {NL} ORDER BY turn) AS text "
        f"FROM conversations GROUP BY conv_id")

# ---------------------------------------------------------------- policy
POLICY = """(VALUES ('public_domain', NULL, NULL), ('cc_by', NULL, NULL), ('cc_by_sa', NULL, NULL),
                     ('research_only', NULL, false), ('proprietary', false, NULL))
            AS pol(lt, scraping_allowed, commercial_use)"""
LIC_DOCS = f"SELECT doc_id, source, {LICENSE} AS license_type FROM documents"


def _categories_values() -> str:
    rows = []
    for name, kws in C.CATEGORIES.items():
        rows.append(f"({lit(name)}, CAST({lst(kws) if kws else '[]'} AS VARCHAR[]))")
    return "(VALUES " + ", ".join(rows) + ") AS cat(category, keywords)"


PARAS = f"""
SELECT doc_id, source, pos, p AS paragraph FROM (
  SELECT doc_id, source, CAST(pos AS INTEGER) AS pos, {strip('raw')} AS p FROM (
    SELECT doc_id, source, unnest(parts) AS raw, unnest(range(len(parts))) AS pos
    FROM (SELECT doc_id, source, string_split(text, {NL}) AS parts FROM documents)))
"""


# ---------------------------------------------------------------- selector passages (tree rules)
# An open-element stack simulated with a recursive CTE: the page body is cut
# into tag and text tokens (script/style/comments become a no-op token that
# still separates text), one token per iteration updates the stack (start
# tag pushes unless void or self-closing; an end tag pops up to the most
# recent open element of its name, or is ignored), and every text token
# belongs to all <p> elements open at that point.
VOID_SQL = ", ".join(f"'{v}'" for v in sorted(VOID))
P_PASSAGES = f"""
WITH RECURSIVE
src AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(html, '(?s)<body[^>]*>(.*)', 1),
      '(?s)<script[^>]*>.*?</script>', '<!>', 'g'),
      '(?s)<style[^>]*>.*?</style>', '<!>', 'g'),
      '(?s)<!--.*?-->', '<!>', 'g'),
      '&(amp|quot|copy|middot|lt|gt)([^-.a-zA-Z0-9;])', '&\\1;\\2', 'g') AS body
  FROM pages
), toks AS (
  SELECT page_id, CAST(i AS INTEGER) AS i, tok FROM (
    SELECT page_id, unnest(tl) AS tok, unnest(range(1, len(tl) + 1)) AS i
    FROM (SELECT page_id, regexp_extract_all(body, '<[^>]*>|[^<]+') AS tl FROM src))
), cls AS (
  SELECT page_id, i, tok,
         CASE WHEN tok LIKE '</%' THEN 'end' WHEN tok LIKE '<!%' THEN 'skip'
              WHEN tok LIKE '<%' THEN 'start' ELSE 'text' END AS kind,
         lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name,
         tok LIKE '%/>' AS selfclose
  FROM toks
), plist AS (
  SELECT page_id, list({{'kind': kind, 'name': name, 'sc': selfclose}} ORDER BY i) AS tl FROM cls GROUP BY page_id
), st(page_id, i, stack) AS (
  SELECT page_id, 0, CAST([] AS STRUCT(id INTEGER, tag VARCHAR)[]) FROM plist
  UNION ALL
  SELECT st.page_id, st.i + 1,
    CASE
      WHEN p.tl[st.i + 1].kind = 'start' AND NOT p.tl[st.i + 1].sc AND p.tl[st.i + 1].name NOT IN ({VOID_SQL})
        THEN list_append(st.stack, {{'id': st.i + 1, 'tag': p.tl[st.i + 1].name}})
      WHEN p.tl[st.i + 1].kind = 'end'
           AND list_position(list_reverse(list_transform(st.stack, lambda x: x.tag)), p.tl[st.i + 1].name) > 0
        THEN st.stack[1:len(st.stack) - list_position(list_reverse(list_transform(st.stack, lambda x: x.tag)),
                                                      p.tl[st.i + 1].name)]
      ELSE st.stack END
  FROM st JOIN plist p ON p.page_id = st.page_id
  WHERE st.i < len(p.tl)
), texts AS (
  SELECT c.page_id, c.i, unnest(list_filter(st.stack, lambda x: x.tag = 'p')).id AS p_id,
         {strip(UNESCAPE('c.tok'))} AS t
  FROM cls c JOIN st ON st.page_id = c.page_id AND st.i = c.i
  WHERE c.kind = 'text'
), agg AS (
  SELECT page_id, p_id, string_agg(t, '' ORDER BY i) FILTER (WHERE t <> '') AS passage FROM texts GROUP BY page_id, p_id
), ps AS (
  SELECT page_id, i AS p_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos
  FROM cls WHERE kind = 'start' AND name = 'p'
)
SELECT ps.page_id, CAST(ps.pos AS INTEGER) AS pos, coalesce(agg.passage, '') AS passage
FROM ps LEFT JOIN agg ON agg.page_id = ps.page_id AND agg.p_id = ps.p_id
"""


def oracle_sql() -> dict[str, str]:
    q = {}
    q["scan_pages"] = ("SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, "
                       "regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS route, "
                       "CAST(length(html) AS INTEGER) AS html_chars FROM pages")
    q["scan_passages"] = ("SELECT source, CAST(doc_id AS VARCHAR) AS text_id, "
                          "source || ' #' || CAST(doc_id AS VARCHAR) AS title, coalesce(text, '') AS content, "
                          "lang AS language FROM documents")
    q["select_sources"] = ("SELECT doc_id, source, CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 "
                           "WHEN 'src7' THEN 2 END AS source_rank FROM documents "
                           "WHERE source IN ('src3', 'src1', 'src7')")
    q["scan_jsonl_two_format"] = f"""
SELECT doc_id, doc_id % 4 IN (0, 2) AS rich,
  CASE doc_id % 4 WHEN 0 THEN 'Question ' || CAST(doc_id AS VARCHAR) WHEN 2 THEN NULL
                  WHEN 1 THEN {pick('text', K.PROMPTS_4)} ELSE {pick("''", K.PROMPTS_4)} END AS user_msg,
  CASE doc_id % 4 WHEN 3 THEN '' ELSE text END AS asst_msg
FROM documents"""
    q["scan_abstracts"] = f"""
SELECT 'academic_abstracts' AS source, substr(md5(title), 1, 8) AS text_id, 'english' AS language,
       text AS content, title, license, 'Abstract: ' || source || '; ' || title AS attribution
FROM (SELECT *, 'Study ' || CAST(doc_id AS VARCHAR) || ' of ' || source AS title, {LICENSE} AS license
      FROM documents)"""
    q["reuse_or_build"] = FLAGSHIP
    q["build_corpus"] = FLAGSHIP
    q["build_corpus_prefix_key"] = FLAGSHIP_PREFIX
    q["sink_jsonl"] = FLAGSHIP
    q["sink_nested_meta"] = (f"SELECT {EXPANDED_TEXT} AS text, source, text_id, language, license, attribution, "
                             f"modality, title FROM ({EXPANDED_ITEMS})")
    q["html_main_text"] = HTML_MAIN
    q["clean_brackets"] = ("SELECT doc_id, regexp_replace('[' || source || '] ' || text || ' (c) ' || lang, "
                           "'\\[.*?\\]|\\(c\\).*', '', 'g') AS cleaned FROM documents")
    q["clean_parens"] = (f"SELECT doc_id, regexp_replace('(' || source || ') ' || text || {NL} || '  [' || lang "
                         f"|| '] trailing words' || {NL} || '(c) ' || CAST(doc_id AS VARCHAR) || ' end [x', "
                         f"'(?m)\\[.*?\\]|\\(.*?\\)|^{WS}*[\\[\\(].*?[\\]\\)].*$', '', 'g') AS cleaned FROM documents")
    q["split_paragraphs"] = f"SELECT doc_id, pos, paragraph FROM ({PARAS}) WHERE length(paragraph) > 60"
    latin = K.LATIN_CLASS
    q["script_filter"] = (f"SELECT doc_id, pos FROM ({PARAS}) WHERE length(paragraph) >= 21 "
                          f"AND regexp_matches(paragraph, {_rx(chr(92) + 'A' + latin + '+' + chr(92) + 'z')})")
    q["min_length"] = ("SELECT doc_id, CAST(length(substring(text, 1, 1400)) AS INTEGER) AS content_len FROM documents "
                       "WHERE length(substring(text, 1, 1400)) >= 30")
    q["subset_contains"] = "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')"
    q["license_filter"] = (f"SELECT doc_id, source, license_type FROM ({LIC_DOCS}) d LEFT JOIN {POLICY} "
                           f"ON d.license_type = pol.lt WHERE coalesce(scraping_allowed, true) "
                           f"AND coalesce(commercial_use, true)")
    q["license_filter_noncommercial"] = (f"SELECT doc_id, source, license_type FROM ({LIC_DOCS}) d "
                                         f"LEFT JOIN {POLICY} ON d.license_type = pol.lt "
                                         f"WHERE coalesce(scraping_allowed, true)")
    q["license_rejects"] = (f"SELECT source, reason, count(*) AS n_rejected FROM ("
                            f"SELECT source, CASE WHEN scraping_allowed = false THEN 'scraping_not_permitted' "
                            f"WHEN commercial_use = false THEN 'commercial_use_prohibited' END AS reason "
                            f"FROM ({LIC_DOCS}) d LEFT JOIN {POLICY} ON d.license_type = pol.lt) "
                            f"WHERE reason IS NOT NULL GROUP BY source, reason")
    q["truncate_variants"] = (f"SELECT doc_id, {clip('text', 1400)} AS hard_cut, "
                              f"{clip('text', 1400, 1500, '...')} AS cut_marked, "
                              f"{clip('text', 300, None, '…')} AS lead300, {clip('text', 200, None, '...')} AS lead200, "
                              f"{clip('text', 120)} AS preview120, {clip('text', 100)} AS preview100 FROM documents")
    q["template_assign"] = (f"SELECT doc_id, {pick('text', K.PROMPTS_7)} AS prompt7, "
                            f"{pick('CAST(doc_id AS VARCHAR)', K.PROMPTS_5)} AS prompt5, "
                            f"{pick('text', K.PROMPTS_4)} AS prompt4 FROM documents")
    q["pair_echo"] = (f"SELECT doc_id, {pick('text', K.PROMPTS_7)} || {NL} || {NL} || text AS instruction, "
                      f"{lit(K.ECHO_LEAD)} || text AS response FROM documents")
    q["pair_quoted"] = (f"SELECT doc_id, {pick('text', K.PROMPTS_7)} || {NL} || {NL} || '\"' || text || '\"' "
                        f"AS instruction, 'A passage from Volume ' || CAST({SRCI} AS VARCHAR) || "
                        f"{lit(', read as one of the work' + chr(39) + 's recurring themes.')} AS response "
                        f"FROM documents")
    q["pair_commentary"] = (f"SELECT doc_id, {pick('c', K.PROMPTS_7)} || {NL} || {NL} || c AS instruction, "
                            f"{lit(K.COMMENTARY_LEAD)} || substring(c, 1, 300) || '…' AS response "
                            f"FROM (SELECT doc_id, substring(text, 1, 1400) AS c FROM documents) "
                            f"WHERE length(c) >= 30")
    q["pair_summary"] = ("SELECT p_partkey, 'What is covered in ''' || p_name || '''?' AS instruction, "
                         "'''' || p_name || ''' covers: ' || p_type || ' item of ' || p_brand || ', size ' "
                         "|| CAST(p_size AS VARCHAR) AS response FROM part")
    q["text_ids"] = (f"SELECT p_partkey, substr(md5(p_name), 1, 8) AS short_id, "
                     f"replace(lower(p_name), ' ', '_') AS slug, "
                     f"{lit(C.SEARCH_BASE)} || replace(p_name, ' ', '+') AS query_url FROM part")
    q["provenance"] = f"SELECT text_id, source, license, attribution, modality, title FROM ({EXPANDED_ITEMS})"
    q["render_sections"] = f"SELECT doc_id, {SECTIONS(pick('text', K.PROMPTS_7), 'text')} AS text FROM documents"
    q["default_fill"] = f"""
WITH r AS (
  SELECT d.doc_id, CASE WHEN quality = 1 THEN text END AS instruction,
         CASE WHEN toxic = 0 THEN 'ok ' || lang END AS response,
         CASE WHEN quality IS NOT NULL THEN source END AS source,
         CASE WHEN toxic = 1 THEN lang END AS language, lang AS body
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
SELECT doc_id, coalesce(instruction, '') AS instruction, coalesce(response, body, '') AS response,
       coalesce(source, 'fallback') AS source, coalesce(language, 'english') AS language,
       {SECTIONS("coalesce(instruction, '')", "coalesce(response, '')")} AS text
FROM r"""
    q["dedupe_key"] = (f"SELECT doc_id, {key('text', prefix=80)} AS key_folded, {key('text', False, 80)} AS key_exact, "
                       f"md5({key('text')}) AS whole_key_md5 FROM documents")
    q["render_chat"] = CHAT
    last_part = "string_split(text, 'Assistant:')[-1]"
    q["render_prompt"] = (f"SELECT conv_id, turn, 'User: ' || text || {NL} || {NL} || 'Assistant:' AS prompt "
                          f"FROM conversations WHERE role = 'user'")
    q["extract_answer"] = f"SELECT conv_id, {strip(last_part)} AS answer FROM ({CHAT})"
    q["html_escape"] = ("SELECT page_id, CAST(length(e) AS INTEGER) AS escaped_len, md5(e) AS escaped_md5 FROM ("
                        "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e "
                        "FROM pages)")
    q["messages_build"] = (f"SELECT doc_id, 'User: ' || {pick('CAST(doc_id AS VARCHAR)', K.PROMPTS_5)} || {NL} || {NL} "
                           f"|| ec || {NL} || {NL} || 'Assistant: ' || {lit(K.MESSAGE_LEAD)} || substring(ec, 1, 200) "
                           f"|| '...' AS text FROM (SELECT doc_id, text AS ec FROM documents)")
    dd = (f"WITH k AS (SELECT doc_id, source, text, {ordx(RANK, 'doc_id')} AS ord, {key('text')} AS dk "
          f"FROM documents), w AS (SELECT dk, min(ord) AS ord FROM k GROUP BY dk)")
    q["dedupe_first_wins"] = f"{dd} SELECT doc_id, source FROM k WHERE ord IN (SELECT ord FROM w)"
    q["dedupe_semi_join"] = q["dedupe_first_wins"]
    q["dedupe_whole_text"] = (f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER ("
                              f"PARTITION BY coalesce(text, '') ORDER BY {ordx(RANK, 'doc_id')}) AS rn FROM documents) "
                              f"WHERE rn = 1")
    q["collection_report"] = (f"{dd} SELECT source, count(*) AS n_collected, "
                              f"CAST(sum(CASE WHEN ord IN (SELECT ord FROM w) THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, "
                              f"CAST(sum(CASE WHEN ord IN (SELECT ord FROM w) THEN length(text) ELSE 0 END) AS BIGINT) "
                              f"AS kept_chars FROM k GROUP BY source")
    q["alignment_score"] = (f"SELECT conv_id, turn, category, CASE WHEN len(keywords) = 0 THEN NULL ELSE "
                            f"CAST(len(list_filter(keywords, lambda k: contains(lower(text), k))) AS DOUBLE) / "
                            f"CAST(len(keywords) AS DOUBLE) END AS score "
                            f"FROM conversations, {_categories_values()} WHERE role = 'assistant'")
    paras30 = f"SELECT *, {ordx(RANK, 'doc_id', 'pos')} AS ord FROM ({PARAS}) WHERE length(paragraph) > 30"
    q["cap_per_group"] = (f"SELECT source, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY source "
                          f"ORDER BY ord) AS rn FROM ({paras30})) WHERE rn <= 50")
    q["cap_per_text"] = (f"SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id "
                         f"ORDER BY ord) AS rn FROM ({paras30})) WHERE rn <= 3")
    q["cap_global"] = (f"SELECT doc_id, source FROM documents WHERE length(text) > 20 "
                       f"ORDER BY {ordx(RANK, 'doc_id')} LIMIT 500")
    q["preview"] = (f"SELECT ord, substring(instruction, 1, 100) AS instruction, substring(response, 1, 100) "
                    f"AS response FROM ({FLAGSHIP.replace('SELECT coalesce(instruction', 'SELECT ord, coalesce(instruction')}) "
                    f"ORDER BY ord LIMIT 5")
    lang_rank = "CASE lang " + " ".join(f"WHEN '{lg}' THEN {i}" for i, lg in enumerate(C.LANG_ORDER)) + " END"
    q["union_sources"] = (f"SELECT doc_id, lang, {ordx(lang_rank, 'doc_id')} AS ord FROM documents "
                          f"WHERE lang IN ({', '.join(repr(x) for x in C.LANG_ORDER)})")
    q["seed_floor_always"] = (f"SELECT {ordx(RANK, 'doc_id')} AS ord, {pick('text', K.PROMPTS_7)} || {NL} || {NL} "
                              f"|| text AS instruction FROM documents UNION ALL "
                              f"SELECT {ordx('127', 'item_id')} AS ord, text AS instruction FROM benchmark")
    for name, table, k_, n_ in (("seed_floor_below", "nation", "n_nationkey", "n_name"),
                                ("seed_floor_below_small", "region", "r_regionkey", "r_name")):
        q[name] = (f"SELECT {ordx('0', k_)} AS ord, {n_} AS instruction FROM {table} UNION ALL "
                   f"SELECT {ordx('127', 'item_id')} AS ord, text AS instruction FROM benchmark "
                   f"WHERE (SELECT count(*) FROM (SELECT 1 FROM {table} LIMIT 20)) < 20")
    q["tokenize"] = (f"SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS joined "
                     f"FROM ({TOKENS})")
    q["token_truncate"] = (f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(t) AS INTEGER) AS mask_sum, "
                           f"array_to_string(t, ' ') AS joined FROM (SELECT doc_id, tokens[1:512] AS t FROM ({TOKENS}))")
    q["pack_sequences"] = PACK
    q["log_parse"] = f"SELECT run_id, line_no, kind, {', '.join(DBL(c) for c in PCOLS)} FROM ({PARSED})"
    q["progress_forward_fill"] = FFILL
    q["progress_latest"] = LATEST
    q["tail_n"] = (f"SELECT run_id, line_no FROM (SELECT run_id, line_no, row_number() OVER (PARTITION BY run_id "
                   f"ORDER BY line_no DESC) AS rn FROM ({RUN_LOG})) WHERE rn <= 30")
    q["error_excerpt"] = EXCERPT
    q["run_outcome"] = (f"SELECT e.run_id, e.rc, CASE WHEN rc = 0 THEN 'complete' ELSE 'failed' END AS status, "
                        f"CASE WHEN rc = 0 THEN 100 ELSE pct END AS pct, epoch_cur, step_cur, loss "
                        f"FROM ({EXITS}) e LEFT JOIN ({LATEST}) l ON e.run_id = l.run_id")
    q["progress_display"] = f"""
SELECT run_id, ({' AND '.join(c + ' IS NULL' for c in PCOLS)}) AS idle, coalesce(pct, 0) AS pct,
  coalesce(CAST(epoch_cur AS VARCHAR), '?') || '/' || coalesce(CAST(epoch_total AS VARCHAR), '3') AS epoch_label,
  coalesce(CAST(step_cur AS VARCHAR), '?') || '/' || coalesce(CAST(step_total AS VARCHAR), '?') AS step_label,
  CASE WHEN loss IS NULL THEN '—' ELSE printf('%.4f', loss) END AS loss_label,
  CASE WHEN elapsed IS NULL OR elapsed = '' THEN '—' ELSE elapsed END AS elapsed_label,
  CASE WHEN eta IS NULL OR eta = '' THEN '—' ELSE eta END AS eta_label,
  CASE WHEN coalesce(pct, 0) > 6 THEN CAST(coalesce(pct, 0) AS VARCHAR) || '%' ELSE '' END AS pct_label
FROM ({LATEST})"""
    q["expanded_corpus_cut"] = (f"SELECT text_id, source, {EXPANDED_TEXT} AS text FROM (SELECT * REPLACE ({EXPANDED_CONTENT.replace('text', 'content')} AS ec) "
                                f"FROM ({EXPANDED_ITEMS})) i LEFT JOIN {POLICY} ON i.license = pol.lt "
                                f"WHERE coalesce(scraping_allowed, true) AND coalesce(commercial_use, true)")
    q["expanded_corpus"] = (f"SELECT text_id, source, {EXPANDED_TEXT} AS text FROM ({EXPANDED_ITEMS}) i "
                            f"LEFT JOIN {POLICY} ON i.license = pol.lt "
                            f"WHERE coalesce(scraping_allowed, true) AND coalesce(commercial_use, true)")
    crawl = f"""
WITH m AS ({HTML_MAIN}),
c AS (SELECT page_id, regexp_replace(main_text, '(?m)\\[.*?\\]|\\(.*?\\)|^{WS}*[\\[\\(].*?[\\]\\)].*$', '', 'g') AS t
      FROM m),
p AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {strip('raw')} AS paragraph FROM (
        SELECT page_id, unnest(parts) AS raw, unnest(range(len(parts))) AS pos
        FROM (SELECT page_id, string_split(t, {NL}) AS parts FROM c)))
SELECT page_id, pos, paragraph FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM p WHERE length(paragraph) > 30)
"""
    q["crawl_paragraphs"] = crawl + "WHERE rn <= 50"
    q["registry_sources"] = (f"SELECT 0 AS source_rank, 'crawl' AS source, CAST(page_id AS VARCHAR) || '-' || "
                             f"CAST(pos AS VARCHAR) AS text_id, {ordx('0', 'page_id', 'pos')} AS ord, "
                             f"md5(paragraph) AS content_md5 FROM ({crawl}) UNION ALL "
                             f"SELECT 1 AS source_rank, source, CAST(doc_id AS VARCHAR) AS text_id, "
                             f"{ordx('1', 'doc_id')} AS ord, md5(coalesce(text, '')) AS content_md5 FROM documents")
    brackets = crawl.replace("'(?m)\\[.*?\\]|\\(.*?\\)|^" + WS + "*[\\[\\(].*?[\\]\\)].*$'", "'\\[.*?\\]|\\(c\\).*'") \
        .replace("length(paragraph) > 30", "length(paragraph) > 60") + "WHERE rn <= 80"
    said = lambda c, i: (f"md5('User: ' || {pick(i, K.PROMPTS_5)} || {NL} || {c} || {NL} || {NL} || 'Assistant: ' || "  # noqa: E731
                         f"{lit(K.MESSAGE_LEAD)} || substring({c}, 1, 200) || '...')")
    did, pid = "CAST(doc_id AS VARCHAR)", "(CAST(page_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR))"
    parts = f"""
SELECT 0 AS source_rank, {did} AS text_id, 'cc_by' AS license_type, 'Titled collection' AS attribution, CAST(NULL AS VARCHAR) AS modality,
       {said("coalesce(text, '')", did)} AS text_md5 FROM documents WHERE contains(lower(source || ' #' || {did}), 'src1')
UNION ALL SELECT 1, {did}, 'research_only', NULL, 'text', {said("coalesce(text, '')", did)} FROM documents
UNION ALL SELECT 2, {pid}, 'public_domain', NULL, NULL, {said('paragraph', pid)} FROM ({brackets})"""
    q["expanded_from_sources"] = (f"WITH i AS ({parts}) SELECT i.*, false AS commercial FROM i LEFT JOIN {POLICY} ON i.license_type = pol.lt "
                                  f"WHERE coalesce(scraping_allowed, true) UNION ALL "
                                  f"SELECT i.*, true AS commercial FROM i LEFT JOIN {POLICY} ON i.license_type = pol.lt "
                                  f"WHERE coalesce(scraping_allowed, true) AND coalesce(commercial_use, true)")
    lead_after = ", read as one of the work's recurring themes."
    q["build_from_sources"] = f"""
WITH c AS ({crawl}),
p AS (
  SELECT {pick('paragraph', K.PROMPTS_7)} || {NL} || {NL} || '"' || paragraph || '"' AS instruction,
         'A passage from Page ' || CAST(page_id AS VARCHAR) || {lit(lead_after)} AS response,
         'crawl' AS source, 'english' AS language, {ordx('0', 'page_id', 'pos')} AS ord FROM c
  UNION ALL
  SELECT {pick("coalesce(text, '')", K.PROMPTS_7)} || {NL} || {NL} || coalesce(text, '') AS instruction,
         {lit(K.ECHO_LEAD)} || coalesce(text, '') AS response, source, lang AS language,
         {ordx('1', 'doc_id')} AS ord FROM documents
  UNION ALL
  SELECT text, text, NULL, NULL, {ordx('127', 'item_id')} FROM benchmark
), k AS (SELECT *, {key('instruction')} AS dk FROM p),
w AS (SELECT dk, min(ord) AS ord FROM k GROUP BY dk)
SELECT coalesce(instruction, '') AS instruction, coalesce(response, '') AS response,
       coalesce(source, 'fallback') AS source, coalesce(language, 'english') AS language,
       {SECTIONS("coalesce(instruction, '')", "coalesce(response, '')")} AS text
FROM k WHERE ord IN (SELECT ord FROM w)"""
    flag_ord = FLAGSHIP.replace('SELECT coalesce(instruction', 'SELECT ord, coalesce(instruction')
    q["preview_file"] = f"SELECT substring(text, 1, 120) AS preview FROM ({flag_ord}) ORDER BY ord LIMIT 3"
    q["run_report"] = f"""
WITH o AS (
  SELECT e.run_id, CASE WHEN rc = 0 THEN 'complete' ELSE 'failed' END AS status,
         CASE WHEN rc = 0 THEN 100 ELSE pct END AS pct, epoch_cur, epoch_total, step_cur, step_total, loss, eta
  FROM ({EXITS}) e LEFT JOIN ({LATEST}) l ON e.run_id = l.run_id
), er AS ({EXCERPT})
SELECT o.run_id, status, coalesce(pct, 0) AS pct,
  coalesce(CAST(epoch_cur AS VARCHAR), '?') || '/' || coalesce(CAST(epoch_total AS VARCHAR), '3') AS epoch_label,
  coalesce(CAST(step_cur AS VARCHAR), '?') || '/' || coalesce(CAST(step_total AS VARCHAR), '?') AS step_label,
  CASE WHEN loss IS NULL THEN '—' ELSE printf('%.4f', loss) END AS loss_label,
  CASE WHEN eta IS NULL OR eta = '' THEN '—' ELSE eta END AS eta_label,
  CASE WHEN coalesce(pct, 0) > 6 THEN CAST(coalesce(pct, 0) AS VARCHAR) || '%' ELSE '' END AS pct_label,
  er.excerpt
FROM o LEFT JOIN er ON o.run_id = er.run_id"""
    q["build_corpus_exact_key"] = (FLAGSHIP.replace(key('instruction'), key('instruction', False))
                                   .replace("FROM benchmark\n",
                                            "FROM benchmark WHERE (SELECT count(*) FROM (SELECT 1 FROM p LIMIT 20)) < 20\n"))
    m = C.CHAT_MARKERS
    turn = lambda role, content: (f"{lit(m['start'])} || '{role}' || {lit(m['role_sep'])} || {content} "  # noqa: E731
                                  f"|| {lit(m['end'])}")
    instr5 = pick('CAST(doc_id AS VARCHAR)', K.PROMPTS_5)
    chat_text = (turn('user', f"{instr5} || {NL} || {NL} || ec") + " || "
                 + turn('assistant', f"{lit(K.MESSAGE_LEAD)} || substring(ec, 1, 200) || '...'"))
    q["expanded_corpus_chat"] = (f"SELECT text_id, source, {chat_text} AS text FROM ({EXPANDED_ITEMS}) i "
                                 f"LEFT JOIN {POLICY} ON i.license = pol.lt "
                                 f"WHERE coalesce(scraping_allowed, true) AND coalesce(commercial_use, true)")
    rendered = (f"SELECT 'User: ' || instruction || {NL} || {NL} || 'Assistant: ' || response AS text "
                f"FROM ({FLAGSHIP})")
    toks = f"SELECT regexp_extract_all(text, {TOK_RX})[1:512] AS t FROM ({rendered})"
    q["expanded_packed"] = (f"WITH r AS (SELECT {bucket('text_id', C.PACK_ORDER)} AS b, text_id, "
                            f"list_append(regexp_extract_all(text, {TOK_RX}), {lit(C.EOS)}) AS t FROM ({q['expanded_corpus']})), "
                            f"r2 AS (SELECT *, sum(len(t)) OVER (ORDER BY b, text_id ROWS UNBOUNDED PRECEDING) - len(t) AS st FROM r), "
                            f"k AS (SELECT st + i AS off, tok FROM (SELECT st, unnest(t) AS tok, unnest(range(len(t))) AS i FROM r2)) "
                            f"SELECT CAST(off // {C.PACK_BLOCK} AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n_tokens, "
                            f"md5(string_agg(tok, ' ' ORDER BY off)) AS tokens_md5 FROM k GROUP BY off // {C.PACK_BLOCK}")
    q["training_input"] = (f"SELECT md5(array_to_string(t, ' ')) AS tokens_md5, CAST(len(t) AS INTEGER) AS n_tokens "
                           f"FROM ({toks})")
    q["html_passages"] = P_PASSAGES
    latin_rx = _rx(chr(92) + 'A' + K.LATIN_CLASS + '+' + chr(92) + 'z')
    q["selected_passages"] = (f"SELECT 'selected' AS source, CAST(page_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) "
                              f"AS text_id, 'english' AS language, passage AS content, page_id AS doc_ord, pos "
                              f"FROM ({P_PASSAGES}) WHERE length(passage) >= 21 AND regexp_matches(passage, {latin_rx})")
    overview = "'Overview of page ' || CAST(page_id AS VARCHAR) || ' with enough words to be kept here'"
    q["page_sources"] = (f"SELECT 0 AS source_rank, 'described' AS source, CAST(page_id AS VARCHAR) AS text_id, 'english' AS language, "
                         f"'Page ' || CAST(page_id AS VARCHAR) AS title, 'cc_by' AS license, md5({overview}) AS content_md5, "
                         f"{ordx('0', 'page_id')} AS ord FROM pages UNION ALL "
                         f"SELECT 1, 'crawl', CAST(page_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR), 'english', "
                         f"'Page ' || CAST(page_id AS VARCHAR), 'public_domain', md5(paragraph), {ordx('1', 'page_id', 'pos')} FROM ({crawl}) UNION ALL "
                         f"SELECT 2, 'selected', text_id, language, NULL, NULL, md5(content), {ordx('2', 'doc_ord', 'pos')} "
                         f"FROM ({q['selected_passages']})")
    echo = lambda t, src, lang, o: (f"SELECT {pick(t, K.PROMPTS_7)} || {NL} || {NL} || {t} AS instruction, {lit(K.ECHO_LEAD)} || {t} AS response, "  # noqa: E731
                                    f"{src} AS source, {lang} AS language, {o} AS ord")
    first = lambda rows: (f"SELECT coalesce(instruction, '') AS instruction, coalesce(response, '') AS response, "  # noqa: E731
                          f"coalesce(source, 'fallback') AS source, coalesce(language, 'english') AS language, "
                          f"{SECTIONS("coalesce(instruction, '')", "coalesce(response, '')")} AS text FROM (SELECT *, row_number() OVER ("
                          f"PARTITION BY {key('instruction')} ORDER BY ord) AS rn FROM ({rows})) WHERE rn = 1")
    many = echo("coalesce(text, '')", "source", "lang", ordx('0', 'doc_id')) + " FROM documents"
    few = (echo("r_name", "'regions'", "'en'", ordx('0', 'r_regionkey')) + " FROM region UNION ALL "
           f"SELECT text, text, NULL, NULL, {ordx('127', 'item_id')} FROM benchmark")
    q["collect_corpus"] = f"SELECT *, 'many' AS corpus FROM ({first(many)}) UNION ALL SELECT *, 'few' AS corpus FROM ({first(few)})"
    meta = "'Overview of page ' || CAST(page_id AS VARCHAR) || ' with enough words to be kept here'"
    para = "'Paragraph on page ' || CAST(page_id AS VARCHAR) || ', long enough to pass the length test'"
    q["html_description"] = (f"SELECT page_id, CASE WHEN page_id % 4 = 1 THEN {para} ELSE {meta} END AS summary, 'meta' AS prefer "
                             f"FROM pages WHERE page_id % 4 < 3 UNION ALL "
                             f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN {meta} ELSE {para} END AS summary, 'p' AS prefer "
                             f"FROM pages WHERE page_id % 4 < 3")
    q["html_errors_split"] = f"SELECT page_id, main_text, CAST(NULL AS VARCHAR) AS error FROM ({HTML_MAIN})"
    q["jsonl_rejects"] = "SELECT '{\"broken\": ' || CAST(doc_id AS VARCHAR) AS value FROM documents WHERE doc_id % 2 <> 0"
    q["tokenize_external"] = ("SELECT doc_id, CAST(len(w) AS INTEGER) AS n_ids, array_to_string(list_transform(w, lambda x: "
                              "CAST(length(x) AS VARCHAR)), ' ') AS joined FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
    q["tokenize_skips"] = ("SELECT doc_id, CAST(len(w) AS INTEGER) AS n_ids FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) "
                           "WHERE length(w[1]) <> 1")
    q["staged_sources"] = f"SELECT source_rank, source, text_id, content_md5, source_rank = 0 AS cached FROM ({q['registry_sources']})"
    q["progress_stream"] = (f"SELECT l.*, m.last_line FROM ({LATEST}) l JOIN ("
                            f"SELECT user_id AS run_id, max(event_id) AS last_line FROM events GROUP BY user_id) m "
                            f"ON l.run_id = m.run_id")
    all_runs = EXCERPT.replace(f"FROM g WHERE run_id IN (SELECT run_id FROM ({EXITS}) WHERE rc <> 0)", "FROM g")
    q["tail_stream"] = (f"SELECT e.run_id, CAST(least(c.n, 30) AS INTEGER) AS n_lines, e.excerpt FROM ({all_runs}) e "
                        f"JOIN (SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY user_id) c "
                        f"ON e.run_id = c.run_id")
    q["live_runlog"] = (f"SELECT p.*, t.n_lines, t.excerpt FROM ({q['progress_stream']}) p "
                        f"JOIN ({q['tail_stream']}) t ON t.run_id = p.run_id")
    return {k: v.strip() for k, v in q.items()}
