"""Similarity self-join on word n-gram sets: grouped prefix join.

Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct word shingles. Equal sets are
collapsed to one class. Every class has a prefix: the first n - ceil(percent * n / 100) + 1 shingles in a global order that
puts frequent ("heavy") shingles last, so two linked sets share a prefix shingle. Classes with the same prefix and size form one
group, and only groups are posted under the shingles. Linking takes two steps:

1. lists of classes that share one of a few smallest shingles, or their group, are compared with one pivot each, which joins large groups
   of near copies by a number of comparisons linear in their size;
2. posting lists that still hold several components are filtered by the bounds of groups and components, expanded to the
   members of different components, and all that can link are compared.

A pair inside one component adds nothing, so the components are exact; length and position bounds prune pairs before they
are compared on their whole sets. Nothing is capped: ``heavy`` only chooses the order of shingles, any order is right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import checked
from terrapanel.llm.graph import components
from terrapanel.llm.words import shingle_sets, slices
from terrapanel.session import materialise

#: A shingle among the candidates for the prefix of this many classes goes to the end of the order.
HEAVY = 64
#: Rounds of comparing with one pivot a list, and the lists of a class: those of its smallest shingles, and its group.
STAR_ROUNDS, STAR_KEYS = 2, 4
#: Sets from this size on are sketched by 32 bits an item.
WIDE = 4096

LOW = "row_id long, n int, cls long, low array<long>"
SETS = "cls long, items array<long>"
BRIEF = "cls long, items binary"


def prefix_length(n, percent: int):
    """Sets this similar to one of n items share at least ceil(percent n / 100) of them."""
    return n - (n * percent + 99) // 100 + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0), pa.int64()))


def _class_of(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes()) - (1 << 63)


def _low(size: int, percent: int):
    """Per row the class of its set, the set's size, and the smallest hashes, half as many again as the prefix needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, cls, low = [], [], []
            for items in shingle_sets(batch.column("text"), size):
                n.append(len(items))
                cls.append(_class_of(items))
                low.append(items[:3 * prefix_length(len(items), percent) // 2] if len(items) else items)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), _lists(low)], ["row_id", "n", "cls", "low"])
    return run


def _sketched(size: int):
    """Per row its set in brief: the distinct low bits of its shingles, 16 of each or, for large sets, 32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cls, brief = [], []
            for items in shingle_sets(batch.column("text"), size):
                cls.append(_class_of(items))
                brief.append(np.unique(items.astype(np.uint16 if len(items) < WIDE else np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(brief, pa.binary())], ["cls", "items"])
    return run


def _possibly(percent: int):
    """Pairs that can link by their sketches: equal items have equal bits, so common bits and merged items bound the overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y, nx, ny in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "nx", "ny"))):
                bits = np.uint16 if max(nx, ny) < WIDE else np.uint32
                if (nx < WIDE) != (ny < WIDE):
                    x, y = (np.unique(np.frombuffer(v, np.uint16 if n < WIDE else np.uint32).astype(np.uint16)) for v, n in ((x, nx), (y, ny)))
                else:
                    x, y = np.frombuffer(x, bits), np.frombuffer(y, bits)
                most = min(len(np.intersect1d(x, y, assume_unique=True)) + min(nx - len(x), ny - len(y)), nx, ny)
                keep.append(100 * most >= percent * (nx + ny - most))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _whole(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column("text"), size))
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), _lists(sets)], ["cls", "items"])
    return run


class _Corpus:
    """Documents with their classes; whole sets are made anew from the texts of the classes asked for."""

    def __init__(self, docs: DataFrame, key: str, text: str, size: int, percent: int):
        self.size, self.percent = size, percent
        self.docs = docs.select(F.col(key).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))
        # Made twice, so that the smallest hashes are written once, for the classes.
        made = self.docs.mapInArrow(_low(size, percent), LOW)
        self.rows = materialise(made.select("row_id", "n", "cls"))
        self.classes = materialise(made.where("n > 0").groupBy("cls").agg(F.min("row_id").alias("row_id"), F.first("n").alias("n"), F.first("low").alias("low"), F.count(F.lit(1)).alias("copies")))

    def sets(self, wanted: DataFrame, make=_whole, schema: str = SETS) -> DataFrame:
        """(cls, items) of the ``wanted`` (cls) classes, each once: whole sets, or sketches."""
        ids = materialise(self.classes.join(wanted, "cls", "left_semi").select("cls", "row_id"))
        texts = self.docs.join(checked(ids.select("row_id").distinct()), "row_id", "left_semi")
        found = texts.mapInArrow(make(self.size), schema)
        nameless = self.docs.where("row_id IS NULL").mapInArrow(make(self.size), schema)
        return found.unionByName(nameless).join(checked(ids.select("cls")), "cls", "left_semi").dropDuplicates(["cls"])


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Items two sets of these sizes have in common at least when they link."""
    return F.ceil((a + b) * percent / F.lit(100 + percent))


def _tokens(classes: DataFrame) -> DataFrame:
    return classes.select("cls", F.explode("low").alias("token"))


def _light(corpus: _Corpus, busy: DataFrame) -> DataFrame:
    """(cls, n, length, light, busy): how long the prefix is to be, the light shingles among the smallest, as far as the
    prefix needs them, and how many heavy ones there are."""
    length = F.col("n") - F.floor((F.col("n") * corpus.percent + 99) / 100) + 1
    hit = _tokens(corpus.classes).join(checked(busy), "token").groupBy("cls").agg(F.collect_list("token").alias("heavy"))
    joined = corpus.classes.select("cls", "n", "low", length.cast("int").alias("length")).join(hit, "cls", "left")
    light = F.when(F.col("heavy").isNull(), F.col("low")).otherwise(F.array_except("low", "heavy"))
    return (joined.select("cls", "n", "length", light.alias("light"), F.coalesce(F.size("heavy"), F.lit(0)).alias("busy"))
            .select("cls", "n", "length", F.expr("slice(light, 1, length)").alias("light"), F.greatest("busy", F.lit(0)).alias("busy")))


def _prefixes(corpus: _Corpus, heavy: int) -> DataFrame:
    """(cls, n, prefix, busy, grp): each class with its prefix in the order (heavy, hash), and the group of that prefix and size."""
    busy = materialise(_tokens(corpus.classes).groupBy("token").count().where(F.col("count") >= heavy).select("token"))
    short = F.size("light") < F.col("length")
    few = materialise(_light(corpus, busy).where(short).select("cls"))
    # Classes made of heavy shingles for the most part use the others too, so those are counted among these classes.
    more = corpus.sets(few).select(F.explode("items").alias("token"))
    busy = materialise(busy.unionByName(more.groupBy("token").count().where(F.col("count") >= heavy).select("token")).distinct())
    light = _light(corpus, busy)
    few = materialise(light.where(short).select("cls", "n", "length", "busy"))
    items = corpus.sets(few.select("cls")).select("cls", F.explode("items").alias("token"))
    ordered = (items.join(checked(busy.withColumn("is_busy", F.lit(True))), "token", "left").groupBy("cls")
               .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("is_busy", F.lit(False)).alias("is_busy"), "token"))).alias("all")))
    rest = few.join(ordered, "cls").select("cls", "n", F.expr("slice(all.token, 1, length)").alias("prefix"), "busy")
    out = light.where(~short).select("cls", "n", F.col("light").alias("prefix"), "busy").unionByName(rest)
    return materialise(out.withColumn("grp", F.xxhash64("n", "prefix")))


def _verified(corpus: _Corpus, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The links among candidate pairs (a, b), compared on their whole sets, those that their sketches leave.

    Before that, their prefixes must share as many shingles as a link requires: cut to n - overlap + k items each, two linked
    sets' prefixes have k in common.
    """
    one = members.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("x"))
    two = members.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("y"))
    required = F.least(F.size("x") - F.col("na"), F.size("y") - F.col("nb")) + _overlap(F.col("na"), F.col("nb"), corpus.percent)
    pairs = materialise(pairs.distinct().join(one, "a").join(two, "b").where(F.size(F.array_intersect("x", "y")) >= required).select("a", "b", "na", "nb"))

    def with_sets(pairs: DataFrame, make, schema: str) -> DataFrame:
        sets = corpus.sets(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), make, schema)
        return pairs.join(sets.withColumnsRenamed({"cls": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"cls": "b", "items": "y"}), "b")

    brief = with_sets(pairs, _sketched, BRIEF).select("a", "b", "x", "y", F.col("na").alias("nx"), F.col("nb").alias("ny"))
    pairs = materialise(brief.mapInArrow(_possibly(corpus.percent), "a long, b long"))
    both = with_sets(pairs, _whole, SETS)
    linked = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return materialise(linked.where(F.col("shared") * 100 >= (F.col("nx") + F.col("ny") - F.col("shared")) * corpus.percent).select("a", "b"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _labelled(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """``rows`` (with cls) and the component each has so far."""
    if label is None:
        return rows.withColumn("component", F.col("cls"))
    return rows.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def _links(corpus: _Corpus, heavy: int) -> DataFrame:
    members = _prefixes(corpus, heavy)
    # Stars: classes that share one of their smallest shingles, or their group, each against one pivot of the list; first one
    # with many copies and common shingles, then another.
    few = corpus.classes.select("cls", F.explode(F.slice("low", 1, STAR_KEYS)).alias("token"), "copies")
    seats = (few.join(members.select("cls", "busy"), "cls")
             .unionByName(members.join(corpus.classes.select("cls", "copies"), "cls").select("cls", F.col("grp").alias("token"), "copies", "busy")))
    met = seats.groupBy("token").count().where("count > 1").select("token")
    seats = materialise(seats.join(met, "token", "left_semi"))
    links, label = None, None
    for turn in range(STAR_ROUNDS):
        named = _labelled(seats, label)
        weight = F.struct("copies", "busy", "cls") if turn == 0 else F.struct(F.xxhash64("component", F.lit(turn)), "copies", "cls")
        lists = (named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(weight.alias("w")).alias("w"))
                 .where("low <> high").select("token", F.col("w.cls").alias("cls2")))
        found = _verified(corpus, _apart(named.join(lists, "token").where("cls <> cls2").select(*_pair("cls", "cls2")), label), members)
        links = found if links is None else links.unionByName(found)
        label = components(links)

    # Every list of groups that still holds several components, and each group's members with the component they have.
    seated = materialise(_labelled(members.select("cls", "n", "grp"), label))
    span = materialise(seated.groupBy("grp").agg(F.min("cls").alias("cls"), F.min("component").alias("low"), F.max("component").alias("high")))
    posted = span.join(members.select("cls", "prefix"), "cls").select("grp", "low", "high", F.explode("prefix").alias("token"))
    mixed = materialise(posted.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("token"))
    lists = posted.join(checked(mixed), "token", "left_semi").select("token", "grp")
    lists = lists.unionByName(span.where("low <> high").select(F.col("grp").alias("token"), "grp"))
    places = seated.join(members.select("cls", "prefix"), "cls")
    entries = materialise(lists.join(places, "grp").select(
        "token", "cls", "component", "n", F.greatest(F.array_position("prefix", F.col("token")).cast("int") - 1, F.lit(0)).alias("pos")))
    left = F.col("n") - F.col("pos")
    sides = entries.groupBy("token", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(left).alias("left"))
    others = sides.select("token", *[F.col(c).alias(f"{c}2") for c in ("component", "least", "most", "left")])
    # Bounds of two components' members in one list: some two of them can have such lengths and places.
    near = (F.col("most2") * 100 >= F.col("least") * corpus.percent) & (F.col("most") * 100 >= F.col("least2") * corpus.percent)
    across = (sides.join(others, "token").where(F.col("component") < F.col("component2")).where(near)
              .where(F.least("left", "left2") >= _overlap(F.col("least"), F.col("least2"), corpus.percent)).select("token", "component", "component2"))
    other = entries.select("token", F.col("component").alias("component2"), F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    fits = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * corpus.percent
    placed = F.least(left, F.col("n2") - F.col("pos2")) >= _overlap(F.col("n"), F.col("n2"), corpus.percent)
    pairs = across.join(entries, ["token", "component"]).join(other, ["token", "component2"]).where(fits & placed).select(*_pair("cls", "cls2"))
    return links.unionByName(_verified(corpus, pairs, members))


def _apart(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    if label is None:
        return pairs
    pairs = pairs.distinct()
    for end in ("a", "b"):
        pairs = _labelled(pairs.withColumnRenamed(end, "cls"), label).withColumnRenamed("cls", end).withColumnRenamed("component", f"of_{end}")
    return pairs.where("of_a <> of_b").select("a", "b")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, heavy: int = HEAVY) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    A null or wordless text has an empty set, links with nothing and is its own component; a text of fewer than ``size``
    words is one shingle. ``component_id`` is the smallest key that links reach; a row with a null key takes part, and
    gets null only if it reaches no other. Repeated rows and repeated keys are rows like any other, one result each.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    corpus = _Corpus(docs, key, text, size, percent)
    label = components(_links(corpus, heavy)).select(F.col("node").alias("cls"), "component")
    smallest = corpus.classes.select("cls", "row_id").join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    linked = smallest.join(label.select("component").distinct(), "component", "left_semi")
    least = linked.groupBy("component").agg(F.min("row_id").alias("component_id"))
    of_class = (corpus.classes.select("cls", "row_id").join(label.join(least, "component").select("cls", "component_id"), "cls", "left")
                .select("cls", F.coalesce("component_id", "row_id").alias("component_id")))
    rows = corpus.rows.select("row_id", "n", "cls")
    out = rows.where("n > 0").join(of_class, "cls").select("row_id", "n", "component_id")
    empty = rows.where("n = 0").select("row_id", "n", F.col("row_id").alias("component_id"))
    return out.unionByName(empty).select(F.col("row_id").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")
