import re

from pyspark.sql import functions as F

from terrapanel.llm import pii

ROWS = [
    (1, "Mail bosbt.42@mail8.example.com or BOSBT.42@Mail8.example.com, ip 42.144.35.254, card 4041894974608795 and 4041 8949 7460 8795."),
    (2, "Mr. John Smith met Mrs Anna Smith, Dr Иванов; +49 30 1234567, 078-05-1120, (555) 123-4567, DE89 3704 0044 0532 0130 00, 4111 1111 1111 1111"),
    (3, "bosbt.42@mail8.example.com again"), (None, None), (4, ""), (5, "Nothing 12 here. 1.2.3 v 3.4.5.6.7 2020-01-02"), (3, "bosbt.42@mail8.example.com again")]


def run(spark, rows, secret="k"):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kind": F.lit(1), "normal": F.lit("x"), "attempt": F.lit(2)})
    return pii.pseudonymise(df, secret)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_format_and_coreference(spark):
    out = run(spark, ROWS)
    assert out.columns == ["doc_id", "text", "kind", "normal", "attempt", "pii_found"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    text = {r["doc_id"]: r["text"] for r in rows}
    m = re.fullmatch(r"Mail (\w+\.\d\d@\w+\.\w+\.com) or (\w+\.\d\d@\w+\.\w+\.com), ip ([\d.]+), card (4\d{15}) and (4\d{3} \d{4} \d{4} \d{4})\.", text[1])
    assert m and m[2].lower() == m[1] and m[2][:5].isupper() and m[4] == m[5].replace(" ", "")
    assert m[1] != "bosbt.42@mail8.example.com" and m[4] != "4041894974608795" and all(0 <= int(x) < 256 for x in m[3].split("."))
    assert text[3] == f"{m[1]} again" and [r["text"] for r in rows].count(text[3]) == 2
    n = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+), Dr ([А-Я][а-я]+); \+\d\d \d\d \d{7}, \d{3}-\d\d-\d{4}, \(\d{3}\) \d{3}-\d{4}, DE\d\d(?: \d{4}){4} \d\d, (4\d{3}(?: \d{4}){3})$", text[2])
    assert n and n[1] in pii.MALE and n[1] != "John" and n[3] in pii.FEMALE and n[3] != "Anna" and n[2] == n[4] != "Smith" and luhn(n[6].replace(" ", ""))
    assert text[None] is None and text[4] == "" and text[5] == ROWS[5][1]


def test_key_decides(spark):
    one, two = ({r["doc_id"]: r["text"] for r in run(spark, ROWS[:1], k).collect()}[1] for k in ("a", "b"))
    assert one != two


def test_collisions_are_drawn_again(spark):
    # Four-digit numbers after a country code leave few surrogates, so first draws meet.
    rows = [(i, f"+1 {i:03d} 55 12") for i in range(1000)]
    out = run(spark, rows).collect()
    assert len({r["text"] for r in out}) == 1000
    assert all(re.fullmatch(r"\+\d \d{3} \d\d \d\d", r["text"]) for r in out)
    entities = spark.createDataFrame([("phone", f"+1{i}") for i in range(60)], "kind string, normal string")
    moved = {r["normal"]: r["attempt"] for r in pii._clashes(entities, "k").collect()}
    first = entities.select("normal", pii.surrogate(F.col("kind"), F.col("normal"), F.lit(0), "k").alias("core")).collect()
    assert len({r["core"] for r in first}) < 60 and moved
    drawn = [r["core"] for r in entities.select("normal", pii.surrogate(F.col("kind"), F.col("normal"), F.coalesce(F.create_map(
        *[F.lit(x) for pair in moved.items() for x in pair])[F.col("normal")], F.lit(0)), "k").alias("core")).collect()]
    assert len(set(drawn)) == 60 and not set(drawn) & {f"+1{i}" for i in range(60)}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.pseudonymise(docs, "k").collect():
        text = before[r["doc_id"]]
        real = {m[0] for m in re.finditer(r"[\w.]+@mail\d\.example\.com|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b", text)}
        assert not [x for x in real if x in r["text"]]
        assert bool(r["pii_found"]) == (r["text"] != text) and len(r["text"]) >= len(text) - 20 * len(r["pii_found"])
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_long_text(spark):
    text = "word 42.144.35.254 " * 5000
    out = run(spark, [(1, text)]).collect()[0]
    assert len(out["pii_found"]) == 5000 and len(set(out["text"].split()[1::2])) == 1


def test_every_script_and_forms_without_another_surrogate(spark):
    mails = ["王小明@邮箱.com", "שלום@דואר.com", "김철수@메일.com", "łñçß@łñ.com", "ሰላም@ሰላ.com", "-@-.com", "_@-.com"]
    out = run(spark, [(i, f"to {m} now") for i, m in enumerate(mails)]).collect()
    got = {r["doc_id"]: re.fullmatch(r"to (\S+@\S+\.com) now", r["text"])[1] for r in out}
    assert len(set(got.values())) == len(mails) and not set(got.values()) & set(mails)
    assert re.fullmatch(r"[\u4e00-\u9fff]{3}@[\u4e00-\u9fff]{2}\.com", got[0]) and re.fullmatch(r"[\uac00-\ud7a3]{3}@[\uac00-\ud7a3]{2}\.com", got[2])
    assert re.fullmatch(r"[\u05d0-\u05ea]{4}@[\u05d0-\u05ea]{4}\.com", got[1]) and got[3].isascii() and got[4].isascii()


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_names_again_genders_and_check_digits(spark):
    out = run(spark, [(1, "Mr John Smith came. Smith said so; SMITH, Smithson and Mrs Fatima Khan's sister Fatima did not."), (2, "Smith elsewhere. GB82 WEST 1234 5698 7654 32, DE00 3704 0044 0532 0130 00")]).collect()
    text = {r["doc_id"]: r["text"] for r in out}
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) said so; SMITH, Smithson and Mrs (\w+) (\w+)'s sister (\w+) did not\.", text[1])
    assert m and m[1] in pii.MALE and m[2] == m[3] != "Smith" and m[4] == m[6] != "Fatima" and m[4].endswith("a") and m[5] != "Khan"
    n = re.fullmatch(r"Smith elsewhere\. (GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d), (DE\d\d(?: \d{4}){4} \d\d)", text[2])
    assert n and mod97(n[1].replace(" ", "")) == 1 and n[1] != "GB82 WEST 1234 5698 7654 32" and n[2] != "DE00 3704 0044 0532 0130 00"
    assert [r["pii_found"] for r in sorted(out)] == [["name", "name"], ["iban", "iban"]]


def test_forms_of_which_most_values_occur(spark):
    """All thousand numbers of a form occur: their surrogates have more digits, and the draws end."""
    entities = spark.createDataFrame([("phone", f"+{i:02d}") for i in range(100)], "kind string, normal string")
    moved = {r["normal"]: r["attempt"] for r in pii._clashes(entities, "k").collect()}
    assert max(moved.values()) < pii.LONGER + 20 and len(moved) == 100


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, f"+1 {i:03d} 55 12") for i in range(1000)], "doc_id long, text string").withColumns(
        {"_pii_doc": F.lit(1), "_pii_attempts": F.lit(2), "_pii_hits": F.lit(3), "pii_found": F.lit("old"), "normal": F.lit(4)})
    out = pii.pseudonymise(df, "k")
    assert out.columns == ["doc_id", "text", "_pii_doc", "_pii_attempts", "_pii_hits", "normal", "pii_found"]
    rows = out.collect()
    assert len({r["text"] for r in rows}) == 1000 and {(r["_pii_doc"], r["_pii_attempts"], r["_pii_hits"]) for r in rows} == {(1, 2, 3)}


def test_brute_force_of_places(spark):
    """Outside what Python's own search finds, every character stays; inside, the format does."""
    import regex
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pattern = regex.compile(pii.PATTERN.replace("(?<![\\p{L}])", "(?<!\\p{L})"))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.pseudonymise(docs, "k").collect():
        found, at = list(pattern.finditer(before[r["doc_id"]])), 0
        assert len(found) == len(r["pii_found"])
        if not any(k == "name" for k in r["pii_found"]):
            gaps = [before[r["doc_id"]][a:b] for a, b in zip([0] + [m.end() for m in found], [m.start() for m in found] + [None])]
            for gap in gaps:
                at = r["text"].index(gap, at) + len(gap)
            assert at == len(r["text"])
