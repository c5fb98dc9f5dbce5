"""Secret scanning through a trigram inverted index, with built-in functions only.

For each rule's pattern a Boolean query over trigrams is derived that every matching text satisfies. Postings
(trigram, document) are made for the trigrams the queries name, intersected for each clause of each query, and the documents that
satisfy a query are checked with its pattern. Rules without mandatory trigrams scan every text.

The index folds case, so it can only propose too many documents.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import checked, located
from terrapanel.session import materialise

#: Strings a part of a pattern may stand for, and clauses a query may have; beyond that the query asks for less.
MOST_STRINGS, MOST_CLAUSES = 64, 256

#: Any text.
Clauses = frozenset
ANY: Clauses = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``value`` has at least ``least`` characters."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


#: The first three are fixed by the contract of the query; a hex run of 24 or more is the same run as one of any length, filtered.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Publicly documented token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{1,80}@"),
)


def _both(x: Clauses, y: Clauses) -> Clauses:
    out = {a | b for a in x for b in y}
    return _short(out) if len(x) * len(y) <= MOST_CLAUSES else min(x, y, key=len)


def _short(clauses: set) -> Clauses:
    """Without clauses that ask for more than another one."""
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def _either(parts: list[Clauses]) -> Clauses:
    out = _short(set().union(*parts))
    return out if len(out) <= MOST_CLAUSES else ANY


def _trigrams(strings: set[str]) -> Clauses:
    return _short({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _needs(exact: set[str] | None, query: Clauses) -> Clauses:
    return query if exact is None else _trigrams(exact)


def _times(strings: set[str], n: int) -> set[str] | None:
    out = {""}
    for _ in range(n):
        out = {a + b for a in out for b in strings}
        if len(out) > MOST_STRINGS:
            return None
    return out


def _one(kind, value) -> tuple[set[str] | None, Clauses]:
    """The strings that an element of a parsed pattern stands for (None: too many to list), and else its query."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
        return {""}, ANY
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(e is not None for e, _ in parts):
            strings = set().union(*(e for e, _ in parts))
            return (strings, ANY) if len(strings) <= MOST_STRINGS else (None, _trigrams(strings))
        return None, _either([_needs(e, q) for e, q in parts])
    if kind is op.IN:
        chars = set()
        for what, x in value:
            if what is op.LITERAL:
                chars.add(chr(x).lower())
            elif what is op.RANGE and x[1] - x[0] < MOST_STRINGS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        exact, query = _sequence(inner)
        if exact is not None and least == 0 and most == 1:
            return exact | {""}, ANY
        if least == 0:
            return None, ANY
        strings = _times(exact, least) if exact is not None else None
        return (strings, ANY) if strings is not None and least == most else (None, _needs(strings, query) if exact is None or strings is not None else _trigrams(exact))
    return None, ANY


def _sequence(items) -> tuple[set[str] | None, Clauses]:
    run, query, whole = {""}, ANY, True
    for kind, value in items:
        exact, inner = _one(kind, value)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        query, whole = _both(query, _trigrams(run)), False
        query, run = (_both(query, inner), {""}) if exact is None else (query, exact)
    return (run, ANY) if whole else (None, _both(query, _trigrams(run)))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams (in lower case); every text that matches holds all of one of them. An empty set: any text may match."""
    return sorted(_needs(*_sequence(parser.parse(pattern))), key=sorted)


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key) for each of the ``trigrams`` that a text holds, case folded: the inverted index of this vocabulary."""
    low = docs.select(key, F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(key, F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]], key: str = "doc_id") -> DataFrame:
    """(key, rules): a bit for each numbered query that the postings of a document satisfy."""
    spark = index.sparkSession
    terms = [(1 << rule, i, 1 << k, (1 << len(clause)) - 1, t) for rule, clauses in queries.items() for i, clause in enumerate(clauses) for k, t in enumerate(sorted(clause))]
    asked = spark.createDataFrame(terms, "rule long, clause int, bit long, full long, trigram string")
    met = index.join(F.broadcast(asked), "trigram").groupBy(key, "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = full").groupBy(key).agg(F.bit_or("rule").alias("rules"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, secrets) for every row of ``docs``; secrets is an array of (start, kind number, end, kind) by start, then kind.

    Matches are leftmost and do not overlap within a kind; positions are code points, ends exclusive. A null or empty text has
    no secrets. Rows with equal or null keys are scanned each with its own text, and other columns are not read. At most 62
    rules.
    """
    docs = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if frozenset() not in q}
    vocabulary = sorted(set().union(*(c for q in indexed.values() for c in q)))
    if vocabulary:
        proposed = materialise(candidates(postings(docs, vocabulary, key, "text"), indexed, key).withColumnRenamed(key, "proposed"))
        docs = docs.join(checked(proposed), F.col(key).eqNullSafe(F.col("proposed")), "left").drop("proposed")
    else:
        docs = docs.withColumn("rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")

    def spans(i: int, rule: Rule) -> Column:
        hits = F.filter(located(F.col("text"), rule.pattern, rule.value), lambda h: h["value"] >= rule.least)
        out = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(i).alias("number"), h["end"].alias("end"), F.lit(rule.kind).alias("kind")))
        return out if i not in indexed else F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, out).otherwise(none)

    return docs.select(key, "text", F.array_sort(F.concat(*[spans(i, r) for i, r in enumerate(rules)])).alias("secrets"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the three base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("secrets", lambda s: s["number"] < len(BASE))
    counts = [F.size(F.filter("secrets", lambda s: s["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(key, *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
