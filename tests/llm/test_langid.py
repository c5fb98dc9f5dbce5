import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import langid


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.identify(docs, ~langid.held_out(), keep=("lang", "text")).withColumn("held_out", langid.held_out()).collect()


def test_held_out_accuracy(predicted):
    held = [r for r in predicted if r["held_out"]]
    assert len(held) > 150
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in predicted)


def test_predictions_do_not_depend_on_place(spark, predicted):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    again = langid.identify(docs.repartition(3, "text"), ~langid.held_out()).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in again} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in predicted}


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "12 34 !", "en"), (None, "the dog", None), (1, "the cat and the dog", "en"),
            (7, "der " * 200_000, None)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), keep=("lang",)).collect()
    assert len(out) == len(rows)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 5)} == {"und"} and all(r["score"] == 0 for r in out if r["doc_id"] in (3, 4, 5))
    assert {r["lang_pred"] for r in out if r["doc_id"] == 7} == {"de"}


def test_no_or_one_language(spark):
    rows = [(1, "abc", None), (2, "def", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert {(r["lang_pred"], round(r["score"], 6)) for r in langid.identify(docs, F.lit(True)).collect()} == {("xx", 1.0)}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_codewords_differ():
    for k in (2, 4, 7, 30):
        code = langid.codewords(k)
        apart = (code.shape[1] - code @ code.T) / 2
        assert code.shape[0] == k and apart[~np.eye(k, dtype=bool)].min() >= 1


def test_ambiguous_between_codewords():
    model = langid.Model(["a", "b"], langid.codewords(2), np.zeros((1, langid.BUCKETS), np.int32), 1.0, np.zeros(1), np.ones((2, 1)), 0.02)
    best, score, unsure = model.decode(np.array([[0], [50]]), np.array([1, 1]))
    assert unsure.tolist() == [True, False] and score[0] == 0.5
