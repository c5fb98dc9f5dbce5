import re

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from terrapanel.llm import queries

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline"]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    out = compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF, duck(SF))
    assert out.startswith("ok"), out


def test_columns(spark):
    columns = {
        "op1_spot_signatures": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op3_language_codes": ["doc_id", "held_out", "lang_pred", "score"], "op4_trigram_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op6_bpe_automaton": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op8_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
        "op10_permutation_index": ["query_id", "rank", "vec_id", "score"],
        "op11_source_audit": ["lang", "source", "part", "item", "value", "rank"], "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
        "op13_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]}
    for name, wanted in columns.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns[:len(wanted)] == wanted, name
