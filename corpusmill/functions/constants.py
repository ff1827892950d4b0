"""Fixed values and neutral default parameters.

Everything that must equal the corpus rules for right results is stated
here, together: the whitespace set, the script class, passage selectors,
progress-line patterns, error prefixes, the licence policy table, record
sections and defaults.

The character class and the escape/prefix lists below are fixed values:
they must equal the rules the corpus format was defined with. Prompt
wording, leads and seed pairs are *data*: the defaults here are our own
neutral examples and every operator takes them as parameters.
"""

# The Unicode whitespace set of Python's str.isspace / re \s
# (29 code points), as code-point ranges, as a Java/RE2 character class,
# and as a plain string for btrim / translate.
WS_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
             (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WS = (r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS_CHARS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))

# Fixed cleanup patterns (Java syntax): bracketed notes and a copyright tail;
# brackets, parentheses and lines that open with either.
CLEAN_BRACKETS = r"(?d)\[.*?\]|\(c\).*"
CLEAN_PARENS = rf"(?md)\[.*?\]|\(.*?\)|^{WS}*[\[\(].*?[\]\)].*$"

# Script whitelist for classical passages — CJK unified
# ideographs, Unicode whitespace, and the punctuation ， 。 ？ ！ ； ： 、 ' （ ） 《 》 -
CJK_CLASS = (r"[\x{4e00}-\x{9fff}\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}"
             r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
             r"，。？！；：、'（）《》\-]")

# CSS-like selectors of the passage elements on classical-text
# pages (tag.class, tag.class, .class; matches are taken in document order).
PASSAGE_SELECTORS = "div.ctext, p.chinese, .passage"

# Latin stand-in class used on the fixture tables (letters, whitespace, . , ' -).
LATIN_CLASS = (r"[\p{L}\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}"
               r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,'\-]")

# Progress-line patterns (tqdm bar with epoch prefix, plain
# bar at line start, trainer metrics keys), written for Java regex with
# (?d) so that '.' stops only at '\n'; WS stands for Python's \s.
EPOCH_BAR = (rf"(?d)[Ee]poch{WS}+(\d+){WS}*/{WS}*(\d+).*?(\d+)%\|.*?\|{WS}*(\d+)/(\d+){WS}*"
             rf"\[([^<]+)<([^,\]]+)")
PLAIN_BAR = rf"(?d)\A{WS}*(\d+)%\|.*?\|{WS}*(\d+)/(\d+){WS}*\[([^<]+)<([^,\]]+)"
LOSS = rf"'loss':{WS}*([\d.]+)"
EPOCH_FLOAT = rf"'epoch':{WS}*([\d.]+)"

# The licence policy table (license_type, scraping_allowed,
# commercial_use, attribution_required, share_alike, citation_required,
# fair_use_summary_only, years_before, regions; None = flag not stated).
POLICY_ROWS = [
    ("public_domain", None, None, None, None, None, None, 1928, ["US", "global_classics"]),
    ("cc_by", None, None, True, False, None, None, None, None),
    ("cc_by_sa", None, None, True, True, None, None, None, None),
    ("research_only", None, False, None, None, True, None, None, None),
    ("proprietary", False, None, None, None, None, True, None, None),
]

# Line prefixes that open an error block in a run log.
ERROR_PREFIXES = ("Traceback", "Error", "RuntimeError", "ModuleNotFoundError",
                  "ImportError", "ValueError", "KeyError", "Exception")

# Number of log lines kept for an error report, section
# headers of the flat record, and record defaults.
TAIL_LINES = 30
SECTION_INSTRUCTION = "### Instruction:\n"
SECTION_RESPONSE = "\n\n### Response:\n"
DEFAULT_SOURCE = "fallback"
DEFAULT_LANGUAGE = "english"
NO_OUTPUT_MESSAGE = "No output captured."

# Own neutral defaults (parameters, not fixed values).
PROMPTS_7 = [
    "Summarise the main idea of this passage:",
    "What does the following passage suggest?",
    "Explain the passage below in plain words:",
    "Which lesson could a reader take from this text?",
    "Describe the point the writer makes here:",
    "How would you paraphrase this passage?",
    "Comment on the following text:",
]
PROMPTS_5 = PROMPTS_7[:5]
PROMPTS_4 = [
    "Read this passage and respond to it:",
    "What is this text about?",
    "Discuss the following passage:",
    "Give a short reflection on this text:",
]
ECHO_LEAD = "This passage states, in its own words: "
COMMENTARY_LEAD = "A short commentary: "
MESSAGE_LEAD = "In brief: "
ABSTRACTS_SOURCE = "academic_abstracts"
