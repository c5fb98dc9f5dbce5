import inspect
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.llm.ann import nearest


def brute(rows, k):
    out = {}
    for name, v in rows:
        if name % 20 == 0:
            scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), other) for other, w in rows if other != name)[:k]
            out[name] = [other for _, other in scored]
    return out


def run(df, **options):
    out = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r)
    return out


@pytest.mark.parametrize("sf,options", [("sf0.01", {}), ("sf0.1", {"block": 700, "query_block": 40})])
def test_recall(spark, sf, options):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = run(df, **options), brute(rows, 20)
    assert got.keys() == want.keys()
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r["vec_id"] for r in found}
        assert all(abs(r["score"] - vectors[q] @ vectors[r["vec_id"]]) < 1e-12 for r in found)
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(found, found[1:]))
    assert np.mean([len({r["vec_id"] for r in got[q]} & set(want[q])) / 20 for q in want]) >= (1 if sf == "sf0.01" else 0.9)


def made(n, seed):
    """Unit vectors of 64 components around a few hundred centres, some of them far out, and their frame."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(300, 64))[draw.integers(300, size=n)] * draw.uniform(0, 0.6, size=(n, 1)) + draw.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return draw.permutation(n), x


def recall(spark, ids, x, step=1):
    table = pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    got = run(spark.createDataFrame(table).repartition(8))
    hits, wide = [], x.astype(float)
    for q in np.flatnonzero(ids % 20 == 0)[::step]:
        scores = wide @ wide[q]
        scores[q] = -np.inf
        best = np.argpartition(-scores, 40)[:40]
        hits.append(np.isin(ids[best[np.lexsort([ids[best], -scores[best]])[:20]]], [r["vec_id"] for r in got[ids[q]]]).mean())
    return np.mean(hits)


def test_recall_at_production_parameters(spark):
    assert recall(spark, *made(10_256, 11)) >= 0.9


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 5.0]), (20, [-1.0, 5.0]), (10, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS part", "'x' AS v", "2 AS score")
    got = {q: [(r["vec_id"], r["score"]) for r in found] for q, found in run(df).items()}
    assert got == {0: [(1, 2.0), (2, 2.0), (10, 0.5), (20, -1.0)], 20: [(10, 2.0), (0, -1.0), (1, -2.0), (2, -2.0)]}
    assert run(df.limit(0)) == {}


def test_lengths_matter_for_inner_products(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=8) * draw.uniform(0.1, 4)).tolist()) for i in range(3000)]
    got, want = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=150, block=1500), brute(rows, 20)
    assert np.mean([len({r["vec_id"] for r in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9


def test_copies_keep_their_smallest_ids(spark):
    # A third of the block is one vector, several times as many rows as are compared.
    draw = np.random.default_rng(5)
    unit = draw.normal(size=(2001, 8))
    unit, ids = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).tolist(), draw.permutation(3000).tolist()
    rows = [(i, unit[max(0, n - 999)]) for n, i in enumerate(ids)]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), share=0.12, least=50, block=3000)
    copies = set(ids[:1000])
    for q in copies & got.keys():
        assert [r["vec_id"] for r in got[q]] == sorted(copies - {q})[:20]
    assert copies & got.keys()


def test_recall_on_full_blocks_with_one_share(spark):
    assert inspect.signature(nearest).parameters["least"].default == 0
    assert recall(spark, *made(60_000, 12), step=20) >= 0.9
