"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary classifier for each bit, a logistic regression on hashed byte n-gram
frequencies, is fitted to tell the languages with a 1 there from those with a 0. A text gets the language whose codeword has
the least loss, every bit weighted by how well it did on that language in the sample; a lead under ``margin`` is ambiguous.

The fit uses a bounded sample of labelled rows (``sample_rows``, excerpts of ``sample_chars``, at most ``most_languages``
languages), shared equally among the languages and taken by a hash of the key. Predictions read whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from terrapanel.llm.words import LOWER, chunks, slices

BUCKETS = 1 << 13
ORDERS = (2, 3)
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
STEP = 1 << 16
#: Largest weight as an integer: a step of them fits in 32 bits.
STEPS_OF_WEIGHT = (1 << 14) - 1

FOUND = ("lang_pred", "score", "ambiguous")


def ngram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte but the last order - 1."""
    low = LOWER[data].astype(np.uint32)
    h = np.full(len(low) - order + 1, order, dtype=np.uint32)
    for j in range(order):
        h = (h ^ low[j:j + len(h)]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13)


def row_sums(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sum of the weights (k x BUCKETS, integers) of its n-grams, and their number; n-grams do not cross rows.

    Sums of integers do not depend on where a row lies in its batch, so equal texts get equal sums.
    """
    rows = len(offsets) - 1
    sums, counts = np.zeros((rows, len(weights)), dtype=np.int64), np.zeros(rows, dtype=np.int64)
    for order in ORDERS:
        first, last = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - order + 1)
        counts += last - first
        for at in range(0, len(data) - order + 1, STEP):
            # The grams that start in this step, with the bytes they need after it.
            gram = ngram_buckets(data[at:at + STEP + order - 1], order)
            a, b = np.searchsorted(last, at, side="right"), np.searchsorted(first, at + len(gram))
            some = a + np.flatnonzero(np.minimum(last[a:b], at + len(gram)) > np.maximum(first[a:b], at))
            bounds = np.column_stack([np.maximum(first[some], at), np.minimum(last[some], at + len(gram))]).ravel() - at
            if len(bounds):
                gram = np.append(gram, np.uint32(0))
                for bit, row in enumerate(weights):
                    sums[some, bit] += np.add.reduceat(row[gram], bounds)[::2]
    return sums, counts


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: the exhaustive code up to 7 languages, beyond it the best-spread of some random codes."""
    if k <= 7:
        columns = [[1] + [1 if bits >> j & 1 else -1 for j in range(k - 1)] for bits in range(2 ** (k - 1) - 1)] if k > 1 else [[1]]
        return np.array(columns).T
    draws, best = np.random.default_rng(seed), None
    for _ in range(50):
        code = draws.choice([-1, 1], (k, int(np.ceil(10 * np.log2(k)))))
        code = code[:, np.abs(code.sum(0)) < k]
        spread = ((code.shape[1] - code @ code.T) / 2 + np.eye(k) * k * 100).min()
        if best is None or spread > best[0]:
            best = spread, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    #: Bits x BUCKETS, in units of ``unit``.
    weights: np.ndarray
    unit: float
    bias: np.ndarray
    trust: np.ndarray
    margin: float

    def decode(self, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score, and whether it is ambiguous, for rows of classifier sums."""
        bits = self.unit * sums / np.maximum(counts, 1)[:, None] + self.bias
        # Loss of each language: the weighted mean over bits of the logistic loss of its codeword's margin.
        loss = np.einsum("rcb,cb->rc", np.logaddexp(0, -bits[:, None, :] * self.code[None]), self.trust)
        near = np.sort(loss, axis=1)
        score = np.exp(-self.code.shape[1] * (loss - near[:, :1]))
        lead = near[:, 1] - near[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return loss.argmin(1), 1 / score.sum(1), lead < self.margin


def fit(texts: list[str], langs: list[str], margin: float, rounds: int = 80) -> Model:
    languages = sorted(set(langs))
    code = codewords(len(languages)) if languages else np.zeros((0, 1))
    y = np.array([languages.index(x) for x in langs], dtype=int)
    x = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        for order in ORDERS:
            if len(data) >= order:
                x[i] += np.bincount(ngram_buckets(data, order), minlength=BUCKETS)
    if len(texts) == 0 or len(languages) == 1:
        return Model(languages, code, np.zeros((code.shape[1], BUCKETS), np.int32), 1.0, np.full(code.shape[1], 9.0), np.ones(code.shape) / code.shape[1], margin)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    scale = 1 / (np.sqrt(x.var(0)) + 1e-4) / np.sqrt(BUCKETS / 16)
    centre = x.mean(0)
    x = (x - centre) * scale
    target = code[y]
    share = 1 / np.bincount(y)[y][:, None] / len(languages)
    w, velocity, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), 0, np.zeros(code.shape[1])
    for _ in range(rounds):
        pull = (target * share / (1 + np.exp(target * (x @ w + bias)))).astype(np.float32)
        velocity = 0.9 * velocity + 0.3 * (x.T @ pull - 1e-4 * w)
        w, bias = w + velocity, bias + 0.3 * pull.sum(0)
    right = ((x @ w + bias) * target > 0)
    trust = np.array([right[y == c].mean(0) for c in range(len(languages))]) + 1e-3
    w = w * scale[:, None]
    unit = float(np.abs(w).max()) / STEPS_OF_WEIGHT or 1.0
    return Model(languages, code, np.round(w.T / unit).astype(np.int32), unit, bias - centre @ w, trust / trust.sum(1, keepdims=True), margin)


def training_sample(docs: DataFrame, usable: Column, key: str, text: str, lang: str, sample_rows: int, sample_chars: int, most_languages: int) -> list:
    """At most ``sample_rows`` (text, lang) rows, about as many of each language, by a hash of the key."""
    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(most_languages).collect()
    if not counts:
        return []
    share = sample_rows // len(counts)
    place = F.pmod(F.xxhash64(F.col(key), F.lit("langid")), F.lit(1_000_000))
    picked = F.lit(False)
    for row in counts:
        picked = picked | ((F.col(lang) == row[0]) & (place < int(1_000_000 * min(1.0, share / row[1]) + 1)))
    sample = known.where(picked).select(place.alias("place"), F.substring(text, 1, sample_chars).alias("text"), F.col(lang).alias("lang"))
    return sample.orderBy("place", "text").limit(sample_rows).collect()


def identify(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 2000,
             sample_chars: int = 3000, most_languages: int = 200, margin: float = 0.02, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score, ambiguous) for every row of ``docs``, learned from its rows where ``usable`` holds.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text when no row is usable. One
    language alone is predicted for all other texts. Equal texts get equal predictions, as nothing but the text counts; null keys
    and repeated rows are predicted like any other. ``keep`` names columns to carry along; others are not read, and a column named like a
    result cannot be kept.
    """
    sample = [r for r in training_sample(docs, usable, key, text, lang, sample_rows, sample_chars, most_languages) if LETTER.search(r["text"])]
    model = docs.sparkSession.sparkContext.broadcast(fit([r["text"] for r in sample], [r["lang"] for r in sample], margin))

    given = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("words"), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep) if c != text])
    kept = [f for f in given.schema if f.name != "words" or text in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            column = batch.column("words")
            for first, rows, data, offsets in chunks(column):
                part = column.slice(first, rows).to_pylist()
                known = np.array([bool(t and m.languages and LETTER.search(t)) for t in part])
                pred, score, ambiguous = np.full(rows, UNDETERMINED, dtype=object), np.zeros(rows), np.zeros(rows, dtype=bool)
                if known.any():
                    best, likeness, unsure = m.decode(*row_sums(m.weights, data, offsets))
                    pred[known] = np.array(m.languages, dtype=object)[best[known]]
                    score[known], ambiguous[known] = likeness[known], unsure[known]
                own = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*(own.column(f.name) for f in kept), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(ambiguous)],
                                                 [*(f.name for f in kept), *FOUND])

    out = given.mapInArrow(run, StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]))
    return out.select(F.col("key").alias(key), *[F.col("words" if c == text else f"kept_{i}").alias(c) for i, c in enumerate(keep)], *FOUND)


def held_out(key: str = "doc_id") -> Column:
    """The rows no model learns from: crc32 of the key as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
