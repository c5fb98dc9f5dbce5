import hashlib
import random

from pyspark.sql import functions as F

from terrapanel.llm import chat

CHATS = "conv_id long, turn long, role string, text string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST] ", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n", "[TURN]", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "\\\\", "<", "[", "é", "😀", "\n", " ", "ok", ""]


def turns_of(rows):
    """Turns of each conversation as read from the rows."""
    out = {}
    for key, turn, role, text in rows:
        out.setdefault(key, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {key: [(role, text) for _, _, role, text in sorted(turns)] for key, turns in out.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, CHATS).withColumns({"key": F.lit(1), "turns": F.lit("x"), "parts": F.lit(None).cast("string"), "formatted": F.lit(2)})
    done = chat.format_chats(df)
    got = {r["conv_id"]: r for r in done.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("said", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    digests = {r["conv_id"]: r for r in chat.digest(done).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for key, turns in want.items():
        r, d = got[key], digests[key]
        assert [(t["role"], t["text"]) for t in r["back"]] == turns, key
        said = [t for role, t in turns if role == "assistant"]
        assert [chat_plain(r["formatted"][s["start"]:s["end"]]) for s in r["loss"]] == said
        assert r["said"] == "".join(said) and d["loss_chars"] == len(r["said"]) and d["formatted_chars"] == len(r["formatted"])
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256(r["said"].encode()).hexdigest() and d["n_turns"] == len(turns)


def chat_plain(escaped):
    out, i = "", 0
    while i < len(escaped):
        i += escaped[i] == "\\"
        out, i = out + escaped[i], i + 1
    return out


def test_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, None, "x"), (3, 1, "", "y"), (3, 2, "tool [TEXT]", "</s>"),
            (None, 0, "user", "lost"), (4, None, "user", "first"), (4, 0, "user", "then"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "system", "only"),
            (7, 0, "user", "</s>[INST] ok [/INST]"), (7, 1, "assistant", "</s>[INST] ok [/INST]")]
    check(spark, rows)
    assert chat.digest(chat.format_chats(spark.createDataFrame([], CHATS))).collect() == []


def test_template(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a [INST] \\"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "tool", "d")]
    out = chat.format_chats(spark.createDataFrame(rows, CHATS)).first()["formatted"]
    assert out == "<<SYS>>\ns\n<</SYS>>\n[INST] a [\\INST] \\\\ [/INST]<s>b[TURN]c</s>[ROLE]tool[TEXT]d[/ROLE]"


def test_any_text_comes_back(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choices(PIECES, k=rng.randrange(8)))
    check(spark, [(c, t, rng.choice(["user", "assistant", "system", text()]), text()) for c in range(300) for t in range(rng.randrange(1, 9))])


def test_long_conversation_and_text(spark):
    rows = [(1, t, ("user", "assistant", "assistant")[t // 200 % 3], f"turn {t} <s>") for t in range(2000)]
    check(spark, rows + [(2, 0, "user", "word [INST] " * 100_000), (2, 1, "assistant", "\\" * 300_000)])
