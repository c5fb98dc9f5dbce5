import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from terrapanel.llm import source_audit
from terrapanel.llm.perfect_hash import PerfectHash, hashed


def brute(rows, least=30, most=50):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        frequency = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in frequency.items() if n >= least}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        total = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10 ** 9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(o, sum(abs(share(c, t) - share(x, t)) for t in kept)) for o, x in counts.items() if o != s]
            terms = [(t, share(c, t) - share(total, t)) for t in kept if c[t] > 0 and share(c, t) > share(total, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank + 1) for rank, (item, value) in enumerate(found if part == "pair" else found[:most])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit(1), "block": F.lit("x"), "kept": F.lit(2)})
    return sorted(tuple(r) for r in source_audit.audit(df, **more).collect())


def sample():
    rows = [("en", f"s{i % 5}", f"Apple pear{i % 7} É{i % 3}x kiwi's " + "plum " * (i % 4)) for i in range(60)]
    rows += [("de", "s1", "x" * 80 + " Äpfel apfel"), ("de", "s2", "x" * 80 + " äpfel"), ("de", "s1", "X" * 80), ("de", None, ""), (None, "s1", "nothing"), ("", None, None), ("fr", "a", "un"), ("fr", "b", "deux")]
    return rows + rows[:7] + [("en", "long", "word other " * 150_000)]


def test_brute_force(spark):
    for least in (2, 8):
        assert run(spark, sample(), least=least) == brute(sample(), least)
    assert run(spark, sample(), least=3, most=2) == brute(sample(), 3, 2)


def test_nothing_kept_and_empty(spark):
    assert run(spark, sample()[:5]) == brute(sample()[:5])
    assert run(spark, sample()[:0]) == []


def test_many_shards_rounds_blocks_and_tiles(spark, monkeypatch):
    """Small bounds, so that each mechanism has several parts; values travel to the workers in the functions' own names."""
    rows = [("en" if i % 3 else "de", f"s{i % 11}", " ".join(chr(97 + (i * k) % 26) * (1 + (i + k) % 9) for k in range(25))) for i in range(120)]
    monkeypatch.setattr(source_audit, "SHARD", 20)
    monkeypatch.setattr(source_audit, "TILE", 4)
    assert run(spark, rows, least=2, broadcast=900) == brute(rows, 2)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in source_audit.audit(docs, least=5).collect())
    assert got == brute([(r["lang"], r["source"], r["text"]) for r in docs.collect()], 5)


def test_perfect_hash():
    keys = [b"%d" % i for i in range(5000)]
    perfect = PerfectHash.build(keys)
    found = perfect.find(pa.array(keys, pa.binary()), hashed(keys))
    assert sorted(found) == list(range(5000)) and perfect.keys.take(pa.array(found)).to_pylist() == keys
    others = [b"x%d" % i for i in range(5000)]
    assert (perfect.find(pa.array(others, pa.binary()), hashed(others)) == -1).all()
    assert (PerfectHash.build([]).find(pa.array(others, pa.binary()), hashed(others)) == -1).all()
