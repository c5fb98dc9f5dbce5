import collections
import math

from pyspark.sql import functions as F

from terrapanel.llm.lm import backoff_scores


def brute(rows, words, backoff=0.4):
    texts = [words(t) for _, t in rows]
    single = collections.Counter(w for t in texts for w in t)
    pairs = collections.Counter(p for t in texts for p in zip(t, t[1:]))
    total, out = sum(single.values()), []
    for (key, _), t in zip(rows, texts):
        mine, mine2, score, backed = collections.Counter(t), collections.Counter(zip(t, t[1:])), 0.0, 0
        for i, w in enumerate(t):
            alone = (single[w] - mine[w] or backoff) / max(total - len(t), 1)
            others = pairs[t[i - 1], w] - mine2[t[i - 1], w] if i else 0
            backed += i > 0 and not others
            score += math.log(others / (single[t[i - 1]] - mine[t[i - 1]]) if others else alone * (backoff if i else 1))
        out.append((key, len(t), backed, round(score, 5) + 0.0))
    return sorted(out, key=repr)


def run(df, chunk_bytes):
    return sorted(((r[0], r[1], r[2], round(r[3], 5) + 0.0) for r in backoff_scores(df, chunk_bytes=chunk_bytes).collect()), key=repr)


def test_edge_cases(spark, brute_words):
    rows = [(1, None), (2, ""), (3, "a b c a b"), (4, "A B x"), (None, "a b c a b"), (5, "zz"), (5, "zz"), (6, "alone yet"), (7, "a b " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit(1), "n_words": F.lit("x")})
    assert run(df, 20) == brute(rows, brute_words)
    assert run(df.limit(0), 20) == []


def test_documents(spark, brute_words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(docs, 1 << 17) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], brute_words)
