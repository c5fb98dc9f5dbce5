import random

import pytest

from terrapanel.llm.graph import components
from terrapanel.llm.ngram_join import similar_components


def brute(rows, size, percent, words):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((key, len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS cls", "2 AS row_id")
    return sorted((tuple(r) for r in similar_components(df, **options).collect()), key=repr)


def random_rows(n, seed=5):
    draw = random.Random(seed)
    base = [[draw.choice("abcdefghijklmnop") * draw.randint(1, 3) for _ in range(draw.randint(1, 60))] for _ in range(12)]
    common = [f"zz{i}" for i in range(15)]
    rows = []
    for i in range(n):
        w = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = draw.choice("abcdxyz")
        if draw.random() < 0.4:
            w = w[:draw.randint(0, len(w))] + common + w[len(w) // 2:]
        text = " ".join(w)
        rows.append((i if draw.random() < 0.95 else None, None if draw.random() < 0.03 else text.upper() if draw.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("size,percent,heavy", [(3, 90, 4), (5, 80, 3)])
def test_matches_brute_force(spark, brute_words, size, percent, heavy):
    rows = random_rows(250)
    assert run(spark, rows, size=size, percent=percent, heavy=heavy) == brute(rows, size, percent, brute_words)


def test_edge_cases(spark, brute_words):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b\x0b"), (5, "É"), (5, "É"), (None, "É"), (None, None), (8, long), (7, long + " more"), (9, "é")]
    assert run(spark, rows, size=3, percent=90) == brute(rows, 3, 90, brute_words)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 90, 90: 90}
