"""Chat formatting with built-in functions only: turns are collected, sorted, merged and written into one string a conversation.

The template marks what a role says::

    <<SYS>>\\n system \\n<</SYS>>\\n    [INST] user  [/INST]    <s> assistant </s>    [ROLE] any other role [TEXT] text [/ROLE]

Adjacent turns of one role share one pair of marks, with ``[TURN]`` between their texts. Control strings inside texts (and names of roles)
get a backslash after their first character and backslashes are doubled, so no text holds a control string and :func:`read_back` gives every turn
as it was. ``loss`` lists the spans (code points, end exclusive) of what assistants say; :func:`loss_text` reads them, unescaped.

Null roles and texts are empty strings; a null conversation id is a conversation of its own. Turns of equal number are in the order
of role and text, null numbers first, repeated rows stay. Other columns are ignored, and an empty table gives an empty table. A conversation
becomes one string, so one conversation must fit in a row (2 GB); its turns are merged in pieces of ``MERGED`` turns, so its cost is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import let, running

#: Role: what stands before and after its texts.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAMED, CLOSED, NEXT = "[ROLE]", "[TEXT]", "[/ROLE]", "[TURN]"
#: A control string, as its first character and the rest; none begins inside another.
CONTROL = r"(<)(?=/?s>|<SYS>>|</SYS>>)|(\[)(?=/?INST\]|/?ROLE\]|TEXT\]|TURN\])"
#: The texts of one role, as written.
BLOCK = r"(?s)<<SYS>>\n(?:.*?)\n<</SYS>>\n|\[INST\] (?:.*?) \[/INST\]|<s>(?:.*?)</s>|\[ROLE\](?:.*?)\[/ROLE\]"
#: Turns that one aggregation merges.
MERGED = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, of, other: Column) -> Column:
    out = None
    for name, marks in MARKS.items():
        out = F.when(role == name, of(name, marks)) if out is None else out.when(role == name, of(name, marks))
    return out.otherwise(other)


def _opening(role: Column) -> Column:
    return _by_role(role, lambda _, marks: F.lit(marks[0]), F.concat(F.lit(OTHER), escape(role), F.lit(NAMED)))


def _closing(role: Column) -> Column:
    return _by_role(role, lambda _, marks: F.lit(marks[1]), F.lit(CLOSED))


def merged(turns: Column) -> Column:
    """array<(role, texts)> of sorted array<(role, text)>: neighbours of one role in one entry, within each piece of the array."""
    kind = "array<struct<role:string,texts:array<string>>>"

    def add(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        fresh = F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
        return (F.when(F.size(acc) == 0, fresh).when(last["role"] == t["role"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
                .otherwise(F.concat(acc, fresh))).cast(kind)

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / MERGED).cast("int")), lambda b: F.slice(turns, b * MERGED + 1, MERGED))
    return F.flatten(F.transform(pieces, lambda p: F.aggregate(p, F.array().cast(kind), add)))


def _written(blocks: Column) -> Column:
    """array<(part, loss)>: the parts of the string in order; a block that goes on with the role of the one before opens no new marks."""
    def write(b: Column, i: Column) -> Column:
        def part(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("part"), loss.alias("loss"))

        no = F.lit(False)
        before = F.when((i > 0) & (F.get(blocks, i - 1)["role"] == b["role"]), F.lit(NEXT)).otherwise(_opening(b["role"]))
        after = F.when(F.get(blocks, i + 1)["role"] == b["role"], F.lit("")).otherwise(_closing(b["role"]))
        texts = F.flatten(F.transform(b["texts"], lambda t, k: F.array(part(F.when(k > 0, F.lit(NEXT)).otherwise(F.lit("")), no),
                                                                       part(escape(t), b["role"] == "assistant"))))
        return F.concat(F.array(part(before, no)), texts, F.array(part(after, no)))

    return F.flatten(F.transform(blocks, write))


def format_chats(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, formatted, loss): one row a conversation; ``loss`` is array<(start, end)>."""
    texts = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = rows.select(F.col(key).alias("key"), texts.alias("t")).groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = chats.select("key", let(merged(F.col("turns")), _written).alias("parts"))

    def spans(p: Column) -> Column:
        ends = let(running(F.transform(p, lambda x: F.length(x["part"]))), lambda at: F.transform(p, lambda x, i: F.struct(
            (F.get(at, i) - F.length(x["part"])).alias("start"), F.get(at, i).alias("end"), x["loss"].alias("loss"))))
        return F.transform(F.filter(ends, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"]))

    joined = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    return parts.select(F.col("key").alias(key), joined.alias("formatted"), spans(F.col("parts")).alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<(role, text)> of the turns that a formatted string holds."""
    def turns(block: Column) -> Column:
        def inner(before: int | Column, after: int) -> Column:
            return F.substring(block, F.lit(before) + 1, F.length(block) - F.lit(before) - after)

        named = F.instr(block, NAMED) - 1
        found = F.struct(unescape(F.substring(block, F.lit(len(OTHER) + 1), named - len(OTHER))).alias("role"), inner(named + len(NAMED), len(CLOSED)).alias("texts"))
        for name, (before, after) in MARKS.items():
            found = F.when(F.startswith(block, F.lit(before)), F.struct(F.lit(name).alias("role"), inner(len(before), len(after)).alias("texts"))).otherwise(found)
        return let(found, lambda f: F.transform(F.split(f["texts"], r"\[TURN\]", -1), lambda t: F.struct(f["role"].alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(BLOCK), F.lit(0)), turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """What the spans of the loss mask hold, unescaped, joined by nothing. Spans are read in runs of ``MERGED``, each from its own stretch of the string."""
    def read(run: Column) -> Column:
        first = run[0]["start"]
        stretch = F.substring(formatted, first + 1, F.element_at(run, -1)["end"] - first)
        return let(stretch, lambda s: F.array_join(F.transform(run, lambda x: unescape(F.substring(s, x["start"] - first + 1, x["end"] - x["start"]))), ""))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(loss) - 1) / MERGED).cast("int")), lambda b: F.slice(loss, b * MERGED + 1, MERGED))
    return F.when(F.size(loss) == 0, F.lit("")).otherwise(F.array_join(F.transform(runs, read), ""))


def digest(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted strings."""
    out = chats.select(key, F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"),
                       loss_text(F.col("formatted"), F.col("loss")).alias("said"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(key, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"),
                      F.sha2("said", 256).alias("loss_sha256"), "formatted_chars")
