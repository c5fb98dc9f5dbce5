import hashlib
import unicodedata

from pyspark.sql import functions as F

from terrapanel.llm import spotsigs

ANCHORS = set(spotsigs.ANCHORS)


def signatures(text):
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    out = set()
    for i, w in enumerate(words[:-1]):
        if w in ANCHORS and words[i + 1] not in ANCHORS:
            chain = [x for x in words[i + 1:] if x not in ANCHORS][:2]
            if len(chain) == 2:
                out.add((w, *chain))
    return frozenset(out) or frozenset([tuple(words)] if words else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = map(signatures, (text, edited, after))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(a), len(b), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    return sorted(out)


def run(df):
    out = spotsigs.digest(spotsigs.with_edits(df)).collect()
    return sorted((r[0], r[1], r[2], len(r[3]) // 8, len(r[4]) // 8, round(r[5], 9), round(r[6], 9)) for r in out)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"id": F.lit(1), "sigs": F.lit("x"), "mark": F.lit(0)})
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "The cat sat on the mat and the dog"), (4, "the the"), (5, "é"), (9, "😀😀a b the c d"), (10, "the cat of house and tree " * 20_000)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert run(spark.createDataFrame(rows[2:3], "doc_id long, text string")) == brute(rows[2:3])
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_repeated_and_null_keys(spark):
    rows = [(5, "the cat sat here"), (5, "the cat sat here"), (5, "other"), (None, "x the y z"), (None, "x the y z")]
    out = spotsigs.digest(spotsigs.with_edits(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(out) == 5
    assert len({tuple(r) for r in out}) == 3


def test_successors_form_one_cycle(spark):
    keys = spark.range(0, 3000).selectExpr("id * 7 AS id", "id AS mark")
    after = {(r["id"], r["mark"]): (r["next_id"], r["next_mark"]) for r in spotsigs.successors(keys).collect()}
    assert all(after[(i * 7, i)] == (((i - 1) % 3000) * 7, (i - 1) % 3000) for i in range(3000))


def test_similar_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r[0], r[1]) for r in spotsigs.similar_pairs(spotsigs.fingerprints(docs)).collect()}
    classes = {}
    for r in docs.collect():
        s = signatures(r["text"])
        classes[s] = min(classes.get(s, r["doc_id"]), r["doc_id"])
    items = sorted((key, s) for s, key in classes.items() if s)
    assert got == {(a, b) for i, (b, y) in enumerate(items) for a, x in items[:i] if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and jaccard(x, y) >= 0.8}
