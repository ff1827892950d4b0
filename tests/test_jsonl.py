"""Two-format JSONL scan: key presence, blank lines, malformed lines."""
import json
import os

import pytest

from corpusmill.functions import constants as K
from corpusmill.session import scratch_dir
from corpusmill.sources import jsonl as J


def _write(spark, lines):
    path = scratch_dir(spark, "jsonl-test")
    os.makedirs(path.replace("file:", ""), exist_ok=True)
    with open(os.path.join(path.replace("file:", ""), "part-0.jsonl"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


MIXED = [
    json.dumps({"instruction": "I1", "response": "R1"}),
    json.dumps({"text": "plain one"}),
    "",
    "   \t ",
    json.dumps({"instruction": None, "response": "R3"}),
    json.dumps({"instruction": "only instruction", "text": "T4"}),
    json.dumps({"text": "with separator"}, ensure_ascii=False),
]


def test_two_format(spark):
    path = _write(spark, MIXED)
    rows = J.scan_two_format(spark, path).collect()
    got = [(r.rich, r.user_msg, r.asst_msg) for r in rows]
    import hashlib
    pick = lambda t: K.PROMPTS_4[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 4]
    exp = sorted([(True, "I1", "R1"), (False, pick("plain one"), "plain one"), (True, None, "R3"),
                  (False, pick("T4"), "T4"), (False, pick("with separator"), "with separator")],
                 key=lambda x: (x[0], x[1] or "", x[2]))
    assert sorted(got, key=lambda x: (x[0], x[1] or "", x[2])) == exp


def test_malformed_fails_or_rejects(spark):
    path = _write(spark, MIXED + ["{not json"])
    with pytest.raises(Exception):
        J.scan_two_format(spark, path).collect()
    assert J.scan_two_format(spark, path, on_error="rejects").count() == 5
    assert J.rejects(spark, path).count() == 1


def test_reuse_or_build(spark):
    path = scratch_dir(spark, "reuse")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", "b")], "instruction string, response string")

    assert J.reuse_or_build(spark, path, build).count() == 1
    assert J.reuse_or_build(spark, path, build).count() == 1
    assert len(calls) == 1


def test_read_or_cache(spark):
    cache = scratch_dir(spark, "cache")
    spark.createDataFrame([("t", "c")], "title string, content string").write.json(cache)
    missing = scratch_dir(spark, "missing")
    got = J.read_or_cache(spark, lambda: spark.read.parquet(missing), cache, "title string, content string")
    assert [tuple(r) for r in got.collect()] == [("t", "c")]
    ok = J.read_or_cache(spark, lambda: spark.range(2), cache)
    assert ok.count() == 2
    with pytest.raises(Exception):
        J.read_or_cache(spark, lambda: spark.read.parquet(missing), missing)


def test_an_interrupted_corpus_is_rebuilt(spark):
    from corpusmill.session import local_path, scratch_dir
    path = scratch_dir(spark, "half")
    spark.createDataFrame([("part",)], "text string").write.json(path)
    os.remove(os.path.join(local_path(path), "_SUCCESS"))
    whole = lambda: spark.createDataFrame([("a",), ("b",)], "text string")
    assert J.reuse_or_build(spark, path, whole, schema="text string").count() == 2
    assert J.reuse_or_build(spark, path, lambda: 1 / 0, schema="text string").count() == 2


def test_rejected_lines_are_written(spark):
    from corpusmill.session import scratch_dir
    path = scratch_dir(spark, "rej")
    spark.createDataFrame([('{"text": "x"}',), ("{broken",), (" ",)], "value string").write.text(f"{path}/in")
    assert J.write_rejects(spark, f"{path}/in", f"{path}/out") == 1
    assert [r.value for r in spark.read.text(f"{path}/out").collect()] == ["{broken"]


def test_edge_lines_are_read_like_json(spark):
    """Each line against the standard library's reader."""
    odd = ['{"instruction": "a\\u00e9", "response": 5}', '{"text": {"k": [1, 2]}}', '{"text": true}', "{}", '{"text": "x", "text": "y"}',
           '{"instruction": "i", "response": null}', '{"response": "r"}']
    bad = ["[1]", "5", '"s"', "null", '{"text": "x"', '{"text": 1} junk', "{'text': 1}", '{"text": "raw\ttab"}', '{"text": 1,}', "{a: 1}"]
    path = _write(spark, odd + bad)
    rows = J.scan_two_format(spark, path, on_error="rejects").collect()
    got = sorted((r.rich, str(r.asst_msg)) for r in rows)
    want = []
    for line in odd:
        o = json.loads(line)
        rich = "instruction" in o and "response" in o
        v = o["response"] if rich else o.get("text", "")
        want.append((rich, v if isinstance(v, str) else str(None) if v is None else json.dumps(v, separators=(",", ":"))))
    assert got == sorted(want)
    assert sorted(r.value for r in J.rejects(spark, path).collect()) == sorted(bad)
    for line in bad:
        with pytest.raises(Exception, match="malformed"):
            J.scan_two_format(spark, _write(spark, [line])).collect()


def test_a_line_is_parsed_once(spark):
    path = _write(spark, MIXED)
    for mode in ("fail", "rejects"):
        df = J.scan_two_format(spark, path, on_error=mode, extra_fields="doc_id bigint, note string")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and "json_object_keys" not in plan
        assert df.columns == ["doc_id", "note", "rich", "user_msg", "asst_msg"] and df.count() == 5
