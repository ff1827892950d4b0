import numpy as np

from corpusmill.llm import embed_cells as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component_id string"


def rows(seed=1, n=250, dim=12):
    rng = np.random.default_rng(seed)
    out, k = [], 0
    centre = rng.normal(size=(n, dim))
    for i in range(n):
        for _ in range(int(rng.choice([1, 1, 2, 6]))):
            v = centre[i] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.12])
            out.append((k * 13 % 7919, [float(np.float32(x)) for x in v * rng.uniform(0.5, 3)], int(rng.integers(0, 2)) if i % 9 else None))
            k += 1
    return out


def brute(data, t=0.98):
    ids = [r[0] for r in data]
    ok = [r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0
          and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = [0] * len(data)
    for i in range(len(data)):
        for j in range(len(data)):
            if i != j and ok[i] and ok[j] and data[i][2] == data[j][2] and len(data[i][1]) == len(data[j][1]):
                a, b = np.array(data[i][1], float), np.array(data[j][1], float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= t:
                    links[i] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x) if x is not None else None
    return sorted((ids[i], links[i], low[find(i)], low[find(i)] == ids[i]) for i in range(len(data)))


def run(spark, data, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in E.embedding_classes(df, **how).collect())


def test_equals_all_pairs(spark):
    data = rows()
    assert run(spark, data) == brute(data)


def test_many_cells_and_blocks_give_the_same(spark):
    data = rows(2)
    assert run(spark, data, per_cell=20, block_rows=16) == brute(data)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-0.0, 1.0], 3),
            (13, [0.0, 1.0], 3), (14, [1e-30, 0.0], 1), (15, [1e30, 0.0], 1)]
    assert run(spark, data) == brute(data)
    got = run(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)])
    assert got == [(1, 1, 1, True)] * 2
    null = E.embedding_classes(spark.createDataFrame([(None, [1.0], 1, "x", "y")], SCHEMA)).collect()
    assert [tuple(r) for r in null] == [(None, 0, None, True)]
    assert E.embedding_classes(spark.createDataFrame([], SCHEMA)).count() == 0
