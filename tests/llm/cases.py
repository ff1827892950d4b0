"""Small inputs that every operator must stand."""

import random

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, piece string, score string, a string, `x.y` string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edge_rows():
    rng = random.Random(11)
    long = words(rng, 60_000, 50_000)
    base = words(rng, 120)
    texts = [(1, "a b c"), (1, "a b c"), (2, ""), (3, None), (None, base), (None, None), (4, base), (5, base), (5, base),
             (6, long), (7, long + " tail"), (8, " \t\n "), (9, base + " one more"), (10, "x" * 5000), (11, "\x00\x01 é ß 日本 <|endoftext|>"),
             (5, "another text under the same id " + words(rng, 80)), (12, "A B C"), (13, base.upper())]
    return [(i, t, None, "s", None, "c", "p", "s", "a", "b") for i, t in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def near_docs(spark, seed=3, n=60):
    """Random texts, exact copies, copies with a few words changed, and passages
    that several documents share."""
    rng = random.Random(seed)
    rows, k = [], 0
    passages = [words(rng, 55, 5000) for _ in range(4)]
    for _ in range(n):
        t = words(rng, rng.choice([3, 5, 8, 60, 150]), 5000)
        if rng.random() < 0.4:
            t = words(rng, rng.randrange(40), 5000) + " " + rng.choice(passages) + " " + words(rng, rng.randrange(40), 5000)
        own = [t]
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = t.split(" ")
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            own.append(" ".join(w))
        for x in own:
            rows.append((k * 7 % 1009, x))
            k += 1
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
