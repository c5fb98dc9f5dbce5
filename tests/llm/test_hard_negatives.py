import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import hard_negatives

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, asks, positives=5, negatives=10, low=30, high=90):
    kept = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [math.floor(256 * x) for x in vector], label))
    limit = (1 << 63) - 1
    last = lambda key: (key is None, key or 0)
    out = []
    for i, (key, q, label) in enumerate(kept):
        if key is None or not asks(key):
            continue
        scores = [(max(-limit - 1, min(limit, sum(a * b for a, b in zip(q, other)))), k, l) for j, (k, other, l) in enumerate(kept) if j != i]
        scores.sort(key=lambda x: (-x[0], last(x[1])))
        for p, pk, _ in [x for x in scores if x[2] == label][:positives]:
            window = [x for x in scores if x[2] != label and low * p <= 100 * x[0] <= high * p][:negatives]
            out += [(key, pk, rank + 1, k, p, s) for rank, (s, k, _) in enumerate(window)]
    return sorted(out, key=repr)


def run(spark, rows, asks, **more):
    df = spark.createDataFrame(rows, VECTORS).withColumns({"key": F.lit(1), "row": F.lit("x"), "block": F.lit(2), "asks": F.lit(False)})
    return sorted((tuple(r) for r in hard_negatives.mine(df, asks(F.col("vec_id")), **more).collect()), key=repr)


def vectors(n, dims, seed, labels=3):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims)) * rng.gamma(1.0, 1.0, dims)
    v[: n // 3] = v[0]  # a third of the rows is one vector
    return [(int(i), [float(x) for x in row], int(rng.integers(labels))) for i, row in enumerate(v)]


@pytest.mark.parametrize("dims,seed", [(3, 1), (20, 2), (70, 3)])
def test_brute_force(spark, dims, seed):
    rows = vectors(400, dims, seed)
    assert run(spark, rows, lambda k: k % 20 == 0, block_rows=70) == brute(rows, lambda k: k % 20 == 0)


def test_edge_cases(spark):
    rows = vectors(60, 5, 4) + [(100, None, 1), (110, [1.0, float("nan")], 1), (120, [float("inf")], 0), (130, [None, 1.0], 0), (140, [1.0] * 5, None), (None, [2.0] * 5, 1),
                                (150, [], 1), (160, [0.5], 2), (170, [0.0] * 5, 0), (180, [3.0] * 9, 9), (20, [1.0] * 5, 1), (20, [1.0] * 5, 1)]
    asks = lambda k: k % 10 == 0
    assert run(spark, rows, asks, block_rows=20) == brute(rows, asks)
    assert run(spark, rows[:0], asks) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1)], asks) == []


def test_large_components(spark):
    rows = [(i, [s * 1e14, float(i), 1e18 if i == 9 else 1.0], i % 2) for i, s in enumerate(random.Random(5).choices([-1, 1, 2], k=40))]
    asks = lambda k: k % 8 == 0
    assert run(spark, rows, asks) == brute(rows, asks)


def test_index_leaves_out_dimensions_and_keeps_pairs():
    rng = np.random.default_rng(6)
    y, a = np.floor(rng.standard_normal((500, 40)) * np.linspace(200, 1, 40)), np.floor(rng.standard_normal((30, 40)) * np.linspace(200, 1, 40))
    truth = a @ y.T
    for share in (0.9, 0.99, 0.999):
        t = np.quantile(truth, share)
        index = hard_negatives.Index(y, float(np.sqrt((a ** 2).sum(axis=1)).max()), t)
        i, k, score = index.search(a, np.full(len(a), t))
        assert set(zip(i, k)) == set(zip(*np.nonzero(truth >= t))) and (truth[i, k] == score).all()
        assert index.posted.sum() < y.size
