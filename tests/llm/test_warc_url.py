import hashlib
import random

import pytest

from corpusmill.llm import url_trie as U
from corpusmill.llm import warc as A

PAGES = "page_id long, url string, html string, digest string, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(2)


def test_archive_round_trip(spark):
    big, tiny = "<p>" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "short"
    rows = [(5, "http://a b/é?x%20", big), (2, "http://a/2", big), (9, None, big), (3, "u", tiny), (4, "u", tiny), (6, "u", None), (7, "u", ""),
            (None, "n", big), (2, "http://a/2", big), (10, "http://long", "é" * 400_000)]
    out = A.pages_through_warc(pages(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.payload_ok for r in out)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = b == big.encode() and i != 2
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    assert {r.target_uri for r in out if r.page_id == 5} == {"http://a b/é?x%20"}
    assert A.pages_through_warc(pages(spark, rows[:0])).count() == 0


def test_arc_versions_and_bad_input():
    for v in (1, 2):
        data = A.arc_archive([("http://x/ y", b"a\nb"), (None, b"")], v)
        got = list(A.arc_records(data))
        assert [g["URL"] for g in got] == ["http://x/%20y", "-"] and got[0]["block"].endswith(b"\r\n\r\na\nb")
        assert A.warc_date(got[0]["Archive-date"]) == "2000-01-01T00:00:00Z"
        with pytest.raises(ValueError):
            list(A.arc_records(data[:-4]))
    with pytest.raises(ValueError):
        list(A.arc_records(b"http://x 0.0.0.0 2000 text/html 3\nabc\n"))


RULES = [U.rule("allow", "com/"), U.rule("block", "example.com/en/"), U.rule("allow", "www.example.com/en/"), U.rule("block", "net/es/"),
         U.rule("block", "net/fr/")]


def slow(rules, url, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r.host), len(r.path), r.verdict, r.name) for r in rules
            if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_trie_equals_scan_of_all_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "b.com", "a.b.com", "net", "x.net", "com.net", ""]
    paths = ["", "/", "/en/", "/en", "/e", "/en/a", "/en/a/", "//"]
    rules = list({(h, p): U.Rule(h, p, rng.choice(["allow", "block"])) for h, p in [(rng.choice(hosts), rng.choice(paths)) for _ in range(25)]}.values())
    urls = [None, "", "com/", "http://", "HTTP://A.B.COM/en/a/b", "://COM", "x://a.b.com?en/", "x://a.b.com#/", "x://é.com/en/", "http://a.b.com:80/en/"]
    urls += [f"http://{rng.choice(['', 'z.', 'Q.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/', '#f', 'x', 'b/c'])}" for _ in range(300)]
    df = pages(spark, [(i, u, "") for i, u in enumerate(urls)])
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    want = {i: slow(rules, u, "block") for i, u in enumerate(urls)}
    for out in (U.judge_urls(df, rules, default="block"), U.judge_urls_by_join(df, table, default="block")):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == want


def test_contract_rules_and_edges(spark):
    rows = [(1, "http://www.example.com/en/x", ""), (2, "http://b.example.com/en/", ""), (3, "http://example.com/en", ""), (4, "http://q.net/fr/1", ""),
            (5, "http://q.net/de/1", ""), (None, None, None), (1, "http://www.example.com/en/x", "")]
    got = sorted((str(r.page_id), str(r.rule), r.verdict) for r in U.judge_urls(pages(spark, rows), RULES).collect())
    assert got == [("1", "www.example.com/en/", "allow")] * 2 + [("2", "example.com/en/", "block"), ("3", "com/", "allow"), ("4", "net/fr/", "block"),
                                                                 ("5", "None", "allow"), ("None", "None", "allow")]
    assert U.judge_urls(pages(spark, rows[:0]), RULES).count() == 0
    both = [U.rule("allow", "a.com/x"), U.rule("block", "a.com/x")]
    assert U.judge_urls(pages(spark, [(1, "h://a.com/x", "")]), both).first().verdict == "block"
