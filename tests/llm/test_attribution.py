import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrapanel.llm import attribution

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def rows_of(df, **options):
    return attribution.attribute(df, PATH, public_tokenizers.PATTERN, **options).collect()


def brute(library, source, lang, text):
    """The rendered document, its sections as (start, end), and the library's encoding of it."""
    whole = "".join(f"{f}: {v}\n" for f, v in (("source", source), ("lang", lang)) if v is not None) + (text or "")
    sections, at = [], 0
    for line in whole.split("\n"):
        end = min(at + len(line) + 1, len(whole))
        if end > at:
            sections.append((at, end))
        at = end
    return whole, sections, library.encode(whole, add_special_tokens=False)


def test_start_rule_matches_library_offsets(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = collections.defaultdict(list)
    for r in rows_of(docs, rule="start"):
        got[r["doc_id"]].append((r["start"], r["end"], r["tokens"]))
    for d in docs.collect():
        whole, sections, encoding = brute(library, d["source"], d["lang"], d["text"])
        if any(c in whole for c in "\r\x0b\x0c\x1c\x1d\x1e\x85  "):
            continue
        starts = [s for s, _ in encoding.offsets]
        want = np.bincount(np.searchsorted([e for _, e in sections], starts, side="right"), minlength=len(sections))
        assert sorted(got[d["doc_id"]]) == [(a, b, float(n)) for (a, b), n in zip(sections, want)]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_counts_add_up(spark, library, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 AS key", "'x' AS body", "2 AS tokens")
    sums = collections.Counter()
    for r in rows_of(docs, rule=rule):
        sums[r["doc_id"]] += r["tokens"]
    for d in docs.collect():
        whole, _, encoding = brute(library, d["source"], d["lang"], d["text"])
        assert abs(sums[d["doc_id"]] - len(encoding.ids)) < 1e-6


def test_crossing_tokens():
    tokens, sections = np.array([3, 8, 9]), np.array([4, 6, 9])
    assert [attribution.allocate(tokens, sections, r)[0].tolist() for r in attribution.RULES] == [[2, 0, 1], [1, 1, 1], [1.2, 0.4, 1.4]]
    assert attribution.allocate(tokens, sections, "start")[1].tolist() == [1, 1, 1]


def test_edge_cases(spark):
    rows = [(1, None, None, None), (2, "", None, None), (3, None, "s", None), (None, "a\n\nb", None, "en"), (None, "a\n\nb", None, "en"), (6, "é😀\n" * 50_000, None, None), (7, "\n", None, None)]
    got = rows_of(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    count = collections.Counter(r["doc_id"] for r in got)
    assert count == {3: 1, None: 8, 6: 50_000, 7: 1}
    assert [(r["start"], r["end"]) for r in got if r["doc_id"] == 6][-1] == (149_997, 150_000)
    assert rows_of(spark.createDataFrame([], "doc_id long, text string, source string, lang string")) == []
