import collections

import pytest

from terrapanel.llm import mixing


@pytest.mark.parametrize("share", [{"a": 3, "b": 2, "c": 5}, {"a": 700, "b": 1, "c": 299}, {"a": 333, "b": 333, "c": 334}, {chr(97 + i): i + 1 for i in range(20)}])
def test_every_prefix_is_within_one_block(share):
    period, done = mixing.schedule(share), collections.Counter()
    for t, s in enumerate(period):
        done[s] += 1
        assert all(abs(done[x] - share[x] * (t + 1) / len(period)) < 1 for x in share)
    assert done == share


def check(rows, total, block):
    rows = sorted(rows, key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(total))
    assert all(a["slot"] <= b["slot"] for a, b in zip(rows, rows[1:]))
    blocks = collections.Counter((r["stream"], r["block"], r["slot"]) for r in rows)
    assert max(blocks.values(), default=0) <= block and len(blocks) == len({k[2] for k in blocks})
    return rows


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    rows = check(mixing.mix(docs, block_rows=4, keep=("text",)).collect(), 1000, 4)
    assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in docs.collect()}
    # While every source lasts, each has its share of blocks within one.
    share = mixing.units({s: c ** 0.5 for s, c in counts.items()}, 1000)
    last = {s: max(r["slot"] for r in rows if r["source"] == s) for s in counts}
    done = collections.Counter()
    for slot, stream in sorted({(r["slot"], r["stream"]) for r in rows}):
        done[stream] += 1
        if slot < min(last.values()):
            assert all(abs(done[s] - share[s] * (slot + 1) / 1000) < 1 for s in share)


def test_hot_source_spreads(spark):
    docs = spark.range(0, 30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('s', id % 50), 'hot') AS source")
    placed = mixing.numbered(docs, docs["source"], [docs["doc_id"]], 30_000)
    assert sorted(r["n"] for r in placed.where("source = 'hot'").collect()) == list(range(20_000))
    check(mixing.mix(docs).collect(), 30_000, 16)


def test_edge_cases(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "x"), (3, "y"), (3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 AS n", "2 AS slot", "3 AS stream", "4 AS units")
    check(mixing.mix(df, block_rows=1, slots=4).collect(), 6, 1)
    assert {r["stream"] for r in check(mixing.mix(df, weights={"x": 1.0, "absent": 2.0}, block_rows=2).collect(), 6, 2)} == {"x", ""}
    assert mixing.mix(df.limit(0)).collect() == []
    assert {r["stream"] for r in check(mixing.mix(df, most_sources=1).collect(), 6, 16)} == {"y", ""}


@pytest.mark.parametrize("weights", [{"a": 0.5} | {f"s{i:03d}": 0.5 / 19 for i in range(19)}, {"a": 0.5} | {f"s{i:03d}": 0.5 / 399 for i in range(399)}, {"a": 0.9999, "b": 0.0001}])
def test_requested_weights_are_scheduled(weights):
    period, done = mixing.schedule(mixing.units(weights, mixing.period_slots(weights, 1000))), collections.Counter()
    total = sum(weights.values())
    for t, s in enumerate(period):
        done[s] += 1
        # One block of the schedule, and what rounding to the period may add by then.
        assert all(abs(done[x] - w / total * (t + 1)) < 1 + (t + 1) / len(period) for x, w in weights.items() if x in ("a", "b", s))


def test_explicit_weights_of_a_table(spark):
    docs = spark.range(0, 40_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'a', concat('s', id % 19)) AS source")
    weights = {"a": 0.5} | {f"s{i}": 0.5 / 19 for i in range(19)}
    slots = {(r["slot"], r["stream"]) for r in mixing.mix(docs, weights=weights).select("slot", "stream").collect()}
    assert abs(sum(s == "a" for t, s in slots if t < 1000) - 500) <= 1
