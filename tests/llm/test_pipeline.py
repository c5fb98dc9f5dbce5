import collections
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from terrapanel.llm import langid, mixing
from terrapanel.session import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(100_001, None, None, None, None), (100_002, "", "en", "src1", 0), (100_003, "12 34 !!", "en", "src1", 8), (None, "the cat and the dog of the house was here " * 3, None, None, 3),
       (None, "the cat and the dog of the house was here " * 3, "en", "src2", 3), (100_004, "that was the house of the cat and it is by the river in this town", "en", "src1", None),
       (100_004, "that was the house of the cat and it is by the river in this town", "en", "src1", None)]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame(ODD, SCHEMA)).withColumns({"component_id": F.lit(1), "position": F.lit("x"), "kept_0": F.lit(2)})
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], "")))
    return tables


def rows(df):
    return collections.Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_columns(stages):
    assert all(t.columns == list(corpus_pipeline.COLUMNS) for t in stages[1:-1]) and stages[-1].columns == ["doc_id", "n_tokens", "ids"]
    assert len(corpus_pipeline.STAGES) == 5


def test_language_drops_only_rejected_rows(stages):
    gone = rows(stages[0]) - rows(stages[1])
    assert not rows(stages[1]) - rows(stages[0])
    rejected = {r["doc_id"] for r in langid.identify(stages[0], ~langid.held_out()).where("lang_pred = 'und' OR ambiguous").collect()}
    assert {r[0] for r in gone} == rejected == {100_001, 100_002, 100_003}


def test_near_duplicates_keep_one_of_each_group(stages, brute_words):
    before = list(rows(stages[1]).elements())
    sets = []
    for r in before:
        w = brute_words(r[1])
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]))
    parent = list(range(len(before)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(before):
        groups[root(i)].append(r)
    kept = rows(stages[2])
    assert sum(kept.values()) == len(groups) < len(before)
    for group in groups.values():
        ids = [r[0] for r in group if r[0] is not None]
        assert [r for r in group if r in kept][0][0] == (min(ids) if ids else None)


def test_surrogates_replace_personal_data_only(stages):
    before, after = ({r["doc_id"]: r for r in t.collect()} for t in stages[2:4])
    assert before.keys() == after.keys()
    changed = 0
    for key, r in after.items():
        real = re.findall(r"[\w.]+@mail\d\.example\.com|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}", before[key]["text"])
        assert not [x for x in real if x in r["text"]] and r["n_chars"] == len(r["text"])
        assert real or r["text"] == before[key]["text"]
        changed += bool(real)
    assert changed


def test_mixture_is_the_schedule_in_order(stages):
    before, after = rows(stages[3]), [tuple(r) for r in stages[4].collect()]
    assert before == collections.Counter(after)
    counts = collections.Counter(r[3] or "" for r in after)
    share = mixing.units({s: c ** 0.5 for s, c in counts.items()}, 1000)
    left, order, period = dict(counts), [], mixing.schedule(share)
    while any(left.values()):
        for s in period:
            take = min(16, left[s])
            order += [s] * take
            left[s] -= take
    assert [r[3] or "" for r in after] == order


def test_tokens_match_the_library(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    out = stages[5].collect()
    assert {r["doc_id"] for r in out} == texts.keys() and len(out) == len(texts)
    for r in out:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""))
    assert docs.count() == 0


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""))
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in out.collect()) == collections.Counter((r["doc_id"], bytes(r["ids"])) for r in docs.collect())


def test_one_id_on_different_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    given = [(3, a), (5, b), (5, f"{a} more"), (9, f"{b} more"), (7, c), (7, f"{c} more"), (None, d), (None, f"{d} more"), (4, d), (6, None), (6, "")]
    docs = materialise(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], SCHEMA))
    kept = [(r[0], r[1]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert {x for x in kept if x[0] != 7} == {(3, a), (5, b), (4, d), (6, None), (6, "")}
    assert len(kept) == 6 and len([x for x in kept if x[0] == 7]) == 1


def test_tokens_keep_the_order_of_several_files(spark, tmp_path):
    docs = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), cast(id as int)) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    docs.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/mixed")
    read = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(read.inputFiles()) == 6 and [r["doc_id"] for r in read.select("doc_id").collect()] != list(range(600))
    out = corpus_pipeline.tokens(spark, read, "")
    assert [r["doc_id"] for r in out.collect()] == list(range(600))
