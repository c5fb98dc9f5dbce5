"""Document fingerprints from spot signatures, with built-in functions only.

An anchor is a common word; where it stands in a text, the next ``chain`` content words (words that are no anchors) form a
signature with it. Of several anchors in a row the last one, next to its chain, signs. The fingerprint is the set of distinct
signature hashes; a text with words but without a complete chain signs once, by all its words.

Words are runs of letters in lower case. Fingerprints are compared by Jaccard similarity. To find similar ones in a table,
``similar_pairs`` partitions them by set length, so that a set meets only the lengths its bound allows, posts the rarest
signatures of each set, and drops pairs whose bound falls below the threshold before comparing whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrapanel.session import materialise

#: Common words of English, French, German and Spanish; a parameter of every function.
ANCHORS = ("the", "a", "an", "is", "was", "of", "to", "and", "in", "that", "it", "for", "on", "with", "as", "be", "by", "this",
           "le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "est", "dans", "en", "pour", "par", "sur", "du", "au",
           "der", "die", "das", "und", "ein", "eine", "ist", "im", "mit", "den", "von", "zu", "auf", "nicht",
           "el", "los", "las", "y", "es", "con", "del", "se", "por", "para", "lo")


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = 2) -> Column:
    """Array of the distinct signature hashes (32 bits) of a text, in order; empty for a null text or one without words."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]++", " "), F.lit(" "))
    # Each anchor is glued to what precedes it: in " cat sat.on.the mat" the tokens start with the content words.
    glued = F.regexp_replace(words, f" ({'|'.join(sorted(anchors, key=lambda a: (a[0], -len(a))))})(?= )", ".$1")
    # An anchor before a complete chain becomes a token of its own, marked by a colon.
    follow = r" ([^ .]++)[^ ]*+" * chain
    signed = F.regexp_replace(glued, rf"\.([^ .]++)(?={follow})", f" :$1:{':'.join(f'${i + 2}' for i in range(chain))}")
    found = F.regexp_extract_all(signed, F.lit(r" :[^ ]++"), F.lit(0))
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]++", " "))
    spots = F.when(F.size(found) > 0, F.transform(found, lambda s: F.hash(s))).when(plain != "", F.array(F.hash(plain)))
    return F.coalesce(F.array_sort(F.array_distinct(spots)), F.array().cast("array<int>"))


def written(sigs: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(sigs, lambda s: F.right(F.concat(F.lit("0000000"), F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; two empty ones are alike."""
    shared = F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.size(F.array_intersect(a, b)))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, 1.0).otherwise(shared / total)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: tuple[str, ...] = ANCHORS, chain: int = 2) -> DataFrame:
    """(key, sigs) for every row of ``docs``, over its whole text."""
    return docs.select(key, signatures(F.coalesce(F.col(text), F.lit("")), anchors, chain).alias("sigs"))


def similar_pairs(prints: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(key, key2, likeness): pairs of rows whose fingerprints (key, sigs) have a likeness of ``threshold`` or more.

    Rows with equal fingerprints are one class and pairs are between classes, each named by its smallest key. Rows without
    signatures, or without a key, pair with nothing.
    """
    classes = materialise(prints.where((F.size("sigs") > 0) & F.col(key).isNotNull()).groupBy("sigs").agg(F.min(key).alias("id")))
    # Partition of a set length: a set of n meets lengths from n x threshold up to n, so those of its partition and the one below.
    part = F.floor(F.ln(F.col("n")) / F.lit(-1).cast("double") / F.ln(F.lit(threshold)))
    posted = classes.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rare = posted.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = posted.join(rare, "sig", "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("ordered"))
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    entries = (kept.select("id", "n", part.cast("int").alias("part"), F.posexplode(F.slice("ordered.sig", F.lit(1), length)).alias("pos", "sig"))
               .join(rare.select("sig"), "sig", "left_semi"))
    index = entries.select("part", "sig", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    probes = entries.withColumn("part", F.explode(F.array("part", F.col("part") - 1)))
    shared = F.ceil((F.col("n") + F.col("n2")) * threshold / (1 + threshold) - 1e-9)
    longer = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") > F.col("id2")))
    pairs = (probes.join(index, ["part", "sig"]).where(longer & (F.col("n2") >= F.col("n") * threshold - 1e-9))
             .where(F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= shared).select("id", "id2").distinct())
    both = pairs.join(classes.select("id", F.col("sigs").alias("a")), "id").join(classes.select(F.col("id").alias("id2"), F.col("sigs").alias("b")), "id2")
    out = both.select(F.least("id", "id2").alias(key), F.greatest("id", "id2").alias(f"{key}2"), likeness(F.col("a"), F.col("b")).alias("likeness"))
    return out.where(F.col("likeness") >= threshold)


def successors(keys: DataFrame) -> DataFrame:
    """(id, mark, next_id, next_mark): for each distinct (id, mark) the next one in descending order, after the last the first.

    Keys are dealt out by range, ordered within each range, and the ends of the ranges joined up; only one row for
    each range meets in one place. A null id comes last.
    """
    order = [F.desc_nulls_last("id"), F.desc("mark")]
    dealt = materialise(keys.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(*order)
    after = dealt.select("*", F.lead(F.struct("id", "mark")).over(own).alias("following"), F.row_number().over(own).alias("place"))
    heads = after.where("place = 1").select("part", F.struct("id", "mark").alias("head"))
    across = Window.orderBy("part")
    first = F.first("head").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    linked = heads.select("part", F.coalesce(F.lead("head").over(across), first).alias("entry"))
    return (after.join(linked, "part").select("id", "mark", F.coalesce("following", "entry").alias("following"))
            .select("id", "mark", F.col("following.id").alias("next_id"), F.col("following.mark").alias("next_mark")))


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: tuple[str, ...] = ANCHORS, chain: int = 2) -> DataFrame:
    """(key, text, edited, sigs, edited_sigs, next_sigs) for every row of ``docs``.

    In the edited text the last half (rounded down) of the code points is replaced by as many first ones of the next document
    in descending order of the key, or all if that has fewer; the last document is followed by the first. A null text is
    empty. Rows that share a key are ordered by a hash of their texts, and repeated rows count as one document in that order;
    null keys come last. One row follows itself. Other columns are not read.
    """
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(words).alias("mark"), words.alias("text"))
    order = successors(base.select("id", "mark"))
    signed = base.select("*", signatures(F.col("text"), anchors, chain).alias("sigs"))
    half = F.length("text") - F.floor(F.length("text") / 2).cast("int")
    lengths = base.select("id", "mark", F.floor(F.length("text") / 2).cast("int").alias("wanted")).distinct()
    want = order.join(lengths, order["id"].eqNullSafe(lengths["id"]) & (order["mark"] == lengths["mark"])).select(
        order["id"].alias("to_id"), order["mark"].alias("to_mark"), "next_id", "next_mark", "wanted")
    heads = (signed.join(want, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("mark") == F.col("next_mark")))
             .select("to_id", "to_mark", F.expr("left(text, wanted)").alias("head"), F.col("sigs").alias("next_sigs")).dropDuplicates(["to_id", "to_mark"]))
    both = signed.join(heads, F.col("id").eqNullSafe(F.col("to_id")) & (F.col("mark") == F.col("to_mark")))
    edited = both.select("id", "text", F.concat(F.left(F.col("text"), half), F.col("head")).alias("edited"), "sigs", "next_sigs")
    return edited.select(F.col("id").alias(key), "text", "edited", "sigs", signatures(F.col("edited"), anchors, chain).alias("edited_sigs"), "next_sigs")


def digest(edits: DataFrame, key: str = "doc_id") -> DataFrame:
    return edits.select(
        key, F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sigs")).alias("fingerprint"), written(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
