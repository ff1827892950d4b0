import hashlib
import random
import zlib

import pytest

from corpusmill.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, `n.x` int, weight string"


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            token = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
            convs.setdefault(c, []).append(((t is not None, t or 0, token), (r, x)))
    convs = {c: [v for _, v in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = convs.get(base, [])[:h] + own[h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    for seq in members:
        own = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += own
            leaves[seq[:d]] += seq not in kids
    out = []
    for seq, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(paths[c]) == len(seq))
        out.append((min(ms), len(seq), min(members[seq[:-1]]) if seq else None, len(ms), len(kids.get(seq, [])),
                    leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def case(seed, n=60, hot=True):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), n):
        for t in range(rng.choice([1, 1, 2, 3, 7, 9, 12])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]),
                         rng.choice(["a", "b", "é", "", None, "longer text"])))
    rows += rows[:5] + [(None, 0, "user", "x")]
    if hot:
        for c in range(300, 360):                         # exact copies, and one long conversation
            rows += [(c, t, "user", "same") for t in range(10)]
        rows += [(500, t, "user", f"t{t % 3}") for t in range(150)] + [(505, t, "user", f"t{t % 3}") for t in range(150)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "d", 1, "w") for r in rows], SCHEMA).repartition(5)
    out = T.prefix_trie(df, **how)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"run": 4, "most": 6, "chunk": 3}), (3, {"run": 2, "most": 1, "chunk": 1})])
def test_against_brute_force(spark, seed, how):
    rows = case(seed, hot=seed != 3)
    assert run(spark, rows, **how) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    one = [(5, None, None, None)]
    assert run(spark, one) == brute(one)
    rows = [(c, 0, "user", "x" * 100_000) for c in range(7)] + [(1, 1, "user", "y")] * 3
    assert run(spark, rows) == brute(rows)


def test_runs_give_one_name_per_sequence(spark):
    rows = [(c, p, bytes([(p * p) % 5 if c < 3 or p < 40 else 7])) for c in range(4) for p in range(60)]
    got = T.prefix_names(spark.createDataFrame(rows, "conv_id long, pos long, token binary"), run=3).collect()
    name = {(r.conv_id, r.pos): bytes(r.name) for r in got}
    above = {(r.conv_id, r.pos): r.above and bytes(r.above) for r in got}
    assert len({name[0, p] for p in range(60)}) == 60
    for p in range(60):
        assert name[0, p] == name[1, p] == name[2, p] and (name[3, p] == name[0, p]) == (p < 40)
        assert above[3, p] == (name[3, p - 1] if p else None)
