"""Write docs/PLANS.md: the physical plan tree of the headline queries.

Usage: python tools/explain_plans.py [sf_dir]
"""

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ["build_corpus", "dedupe_first_wins", "collection_report", "cap_per_group", "cap_global",
           "html_main_text", "crawl_paragraphs", "pack_sequences", "render_chat", "alignment_score",
           "progress_forward_fill", "progress_latest", "error_excerpt", "license_filter",
           "seed_floor_below", "expanded_corpus"]


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n\n")[0]
    keep = [ln for ln in text.splitlines() if ln.startswith(("PushedFilters", "ReadSchema"))]
    return head.strip() + ("\n\n" + "\n".join(sorted(set(keep))) if keep else "")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from corpusmill.plans.catalog import QUERIES as Q
    from corpusmill.session import build_session
    spark = build_session("local[8]", shuffle_partitions=16)
    out = ["# Physical plans of the headline queries",
           "",
           f"`python tools/explain_plans.py {sf_dir}` (AQE on; the adaptive plan may still change joins",
           "to broadcast or coalesce partitions at run time). Scan lines list the pushed filters and the",
           "pruned read schema.", ""]
    for name in QUERIES:
        out += [f"## {name}", "", "```", tree(Q[name](spark, sf_dir)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
