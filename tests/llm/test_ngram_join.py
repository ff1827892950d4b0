import re

from tests.llm.cases import edge_docs, near_docs, no_docs
from corpusmill.llm import ngram_join as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_classes_equal_all_pairs(spark):
    for seed in (1, 2):
        rows, df = near_docs(spark, seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(df).collect()}
        assert got == brute(rows)


def test_small_blocks_give_the_same(spark):
    rows, df = near_docs(spark, 5)
    got = {r.doc_id: r.component_id for r in J.jaccard_classes(df, block_tokens=300, percent=50).collect()}
    assert got == {k: v[1] for k, v in brute(rows, 50).items()}


def test_chain_of_links_and_hot_group(spark):
    # each text links with the next only; 200 near copies of one text
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(base[i * 2:i * 2 + 60])) for i in range(10)]
    hot = [f"h{i}" for i in range(80)]
    rows += [(100 + i, " ".join(hot[:40] + [f"x{i}"] + hot[40:])) for i in range(200)]
    got = {r.doc_id: r.component_id for r in J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in brute(rows).items()}


def test_edges(spark):
    got = {}
    for r in J.jaccard_classes(edge_docs(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[1] == [(1, 1), (1, 1)] and got[12] == [(1, 1)]
    assert got[2] == got[8] == [(0, 2)] or (got[2] == [(0, 2)] and got[8] == [(0, 8)])
    assert got[3] == [(0, 3)]
    assert len(got[None]) == 2 and all(c is None for _, c in got[None])
    assert got[4][0][1] == 4 and got[13][0][1] == 4 and got[9][0][1] == 4
    assert got[7][0][1] == 6                              # two very long texts
    assert len(got[5]) == 3
    assert J.jaccard_classes(no_docs(spark)).count() == 0


def test_stage_keeps_one_of_each_class(spark):
    rows, df = near_docs(spark, 7)
    kept = {r.doc_id for r in J.stage(spark, df, None).collect()}
    assert kept == {c for _, c in brute(rows).values()}
    assert J.stage(spark, edge_docs(spark), None).columns == edge_docs(spark).columns
