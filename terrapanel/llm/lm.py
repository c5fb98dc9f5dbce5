"""Stupid-backoff scores of documents against the bigram counts of the whole table.

Documents are grouped in chunks of bounded size by hash. Every chunk explodes its texts into words and word pairs and sends its
distinct n-grams with their counts to the count tables, which are partitioned by n-gram hash. There the chunks' n-grams are joined with the
table's totals, and the totals go back to the chunks, where each document's scores are summed. N-grams travel packed, one row for a
chunk and table partition, so a frequent n-gram is one entry for each chunk however often it occurs.

A document is scored by what the rest of the table holds: its own counts are taken off first. A word after another one scores
count(pair) / count(first) if others have the pair, else ``backoff`` times count(word) / all words, a word that
no other has counting as ``backoff`` of one. The first word has no pair and scores by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.words import WEIGHTS, chunks, mixed, word_hashes

#: Bytes of text to a chunk, and to a partition of the count tables.
CHUNK_BYTES = 8 << 20

ASKED = "bucket int, chunk int, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWERED = "chunk int, bucket int, total long, words binary, pairs binary"
SCORED = "doc_id long, n_words long, n_backed_off long, log_score double"


def _ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their rows, and whether a word has one before it in its row; the hash of that pair (else 0)."""
    words, rows, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    for first, n, data, offsets in chunks(column):
        found, firsts = word_hashes(data, offsets)
        words.append(found)
        rows.append(np.repeat(np.arange(first, first + n), np.diff(firsts)))
    words, rows = np.concatenate(words), np.concatenate(rows)
    inner = np.zeros(len(words), dtype=bool)
    inner[1:] = rows[1:] == rows[:-1]
    pairs = np.zeros(len(words), dtype=np.uint64)
    pairs[1:] = mixed(words[:-1] * WEIGHTS[40] + words[1:] * WEIGHTS[41])
    return words, rows, inner, pairs


def _shares(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted hashes go over to the next of ``buckets`` equal ranges of hashes."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0 ** 64 / buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _asking(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        words, _, inner, pairs = _ngrams(table.column("text").combine_chunks())
        parts = []
        for keys in (words, pairs[inner]):
            keys, counts = np.unique(keys, return_counts=True)
            cuts = _shares(keys, buckets)
            parts.append([[x[cuts[i]:cuts[i + 1]].tobytes() for i in range(buckets)] for x in (keys, counts.astype(np.uint32))])
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array(range(buckets), pa.int32()), "chunk": pa.array([chunk] * buckets, pa.int32()),
                         "words": pa.array(parts[0][0], pa.binary()), "word_counts": pa.array(parts[0][1], pa.binary()),
                         "pairs": pa.array(parts[1][0], pa.binary()), "pair_counts": pa.array(parts[1][1], pa.binary())})
    return run


def _totals(keys: list[bytes], counts: list[bytes]) -> tuple[list[bytes], int]:
    """The table's totals for the keys of each chunk, and the sum of all counts."""
    joined = np.frombuffer(b"".join(keys), np.uint64)
    own = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
    order = np.argsort(joined, kind="stable")
    firsts = np.flatnonzero(np.append(True, joined[order][1:] != joined[order][:-1])) if len(joined) else np.empty(0, np.int64)
    sums = np.add.reduceat(own[order], firsts) if len(joined) else firsts
    total = np.empty(len(joined), dtype=np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(firsts, len(joined))))
    cuts = np.cumsum([len(k) // 8 for k in keys])[:-1]
    return [x.tobytes() for x in np.split(total, cuts)], int(own.sum())


def _counting(table: pa.Table) -> pa.Table:
    column = {name: table.column(name).to_pylist() for name in table.column_names}
    words, total = _totals(column["words"], column["word_counts"])
    pairs, _ = _totals(column["pairs"], column["pair_counts"])
    n = table.num_rows
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "total": pa.array([total] * n, pa.int64()),
                     "words": pa.array(words, pa.binary()), "pairs": pa.array(pairs, pa.binary())})


def _own(rows: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """How often each entry's place occurs in its row."""
    _, back, counts = np.unique(rows * np.int64(size) + places, return_inverse=True, return_counts=True)
    return counts[back]


def _scoring(backoff: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, rows, inner, pairs = _ngrams(docs.column("text").combine_chunks())
        answers = answers.sort_by("bucket")
        n = docs.num_rows
        all_words = int(np.sum(answers.column("total").to_numpy()))
        of_word, of_pair = (np.frombuffer(b"".join(answers.column(c).to_pylist()), np.int64) for c in ("words", "pairs"))
        keys, place = np.unique(words, return_inverse=True)
        count = of_word[place] - _own(rows, place, len(keys))
        keys, pair_place = np.unique(pairs[inner], return_inverse=True)
        pair = np.zeros(len(words), dtype=np.int64)
        pair[inner] = of_pair[pair_place] - _own(rows[inner], pair_place, len(keys))
        lengths = np.bincount(rows, minlength=n)
        rest = np.maximum(all_words - lengths, 1)[rows]
        alone = np.where(count > 0, count, backoff) / rest
        known = pair > 0
        before = np.ones(len(words))
        before[1:] = np.maximum(count[:-1], 1)
        score = np.where(known, pair / before, np.where(inner, backoff, 1.0) * alone)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(lengths, pa.int64()),
                         "n_backed_off": pa.array(np.bincount(rows, weights=inner & ~known, minlength=n).astype(np.int64)),
                         "log_score": pa.array(np.bincount(rows, weights=np.log(score), minlength=n).astype(np.float64))})
    return run


def backoff_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", backoff: float = 0.4, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_words, n_backed_off, log_score) for every row of ``docs``: the natural logarithm of the product of its scores.

    A null or wordless text has no words and scores 0. Repeated rows are documents of their own and count for each other, and null keys
    are scored like any other; a row alone in its table backs off throughout. Other columns are not read.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(size // chunk_bytes) + 1
    placed = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    asked = placed.groupBy("chunk").applyInArrow(_asking(parts), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(_counting, ANSWERED)
    return placed.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_scoring(backoff), SCORED).withColumnRenamed("doc_id", key)
