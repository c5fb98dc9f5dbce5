"""Divergence of sources: how far the term shares of each source are from those of the other sources and of its language.

A first pass counts, exactly, the documents of each language that hold each term, and keeps the terms with enough of them. The kept terms of a
language are cut into shards, and every shard becomes a minimal perfect hash with its keys. A second pass over the texts gets a round
of shards by broadcast (``BROADCAST`` bytes at most; more rounds if all shards are larger) and counts again: a term leads to a slot, the key
kept there is compared, and the slot of the document's group is incremented. Counts travel as blocks of slots, are summed by block, and all that
follows works on blocks, exactly in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm.perfect_hash import PerfectHash, hashed
from terrapanel.session import materialise

#: Terms of a shard, about; slots of a block; sources of a tile; bytes of shards that a pass may broadcast.
SHARD, BLOCK, TILE, BROADCAST = 1 << 16, 1 << 12, 64, 32 << 20
#: Entries that a task holds before it hands them on; bytes of a text that are cut into terms at once.
HELD, PIECE = 600_000, 1 << 20
#: A longer term is known by its digest, which starts with a byte that no term holds.
LONGEST = 64
#: A share is 1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)).
SCALE, ADDED = 1_000_000_000, 5

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each piece of it: runs of letters A-Z (in lower case) and of characters beyond ASCII."""
    start = 0
    while start < len(text):
        stop = min(start + PIECE, len(text))
        while stop < len(text) and _LETTERS[text[stop]] != 32:
            stop += 1
        yield text[start:stop].translate(_LETTERS).split()
        start = stop


def _known(term: bytes) -> bytes:
    return term if len(term) <= LONGEST else b"\0" + hashlib.sha256(term).digest()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    """(lang, source, text) of a batch; texts one by one, so that only one is copied at a time."""
    texts = batch.column("text")
    for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
        yield lang, source, texts[i].as_py()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, by language; ``whole`` is the text of a term known by its digest."""
    def out():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(counts), pa.string()), "term": pa.array([_known(t) for t in counts], pa.binary()),
                "docs": pa.array(counts.values(), pa.int64()), "whole": pa.array([t if len(t) > LONGEST else None for t in counts], pa.binary())})

    held, size = defaultdict(Counter), 0
    for batch in batches:
        for lang, _, text in _rows(batch):
            found: set[bytes] = set()
            for piece in terms(text):
                found.update(piece)
            size -= len(held[lang])
            held[lang].update(found)
            size += len(held[lang])
            if size >= HELD:
                yield from out()
                held, size = defaultdict(Counter), 0
    yield from out()


SHARDS = "lang string, shard int, n int, levels array<int>, bits binary, seed int, ends binary, keys binary"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    """The perfect hash of one shard in a row: its keys in the order of their slots, one after another."""
    found = PerfectHash.build(table["term"].to_pylist())
    keys = found.keys.to_pylist()
    row = (key[0].as_py(), key[1].as_py(), len(keys), found.levels, found.bits.tobytes(), found.seed, np.cumsum([len(k) for k in keys]).astype(np.int32).tobytes(), b"".join(keys))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["lang", "shard", "n", "levels", "bits", "seed", "ends", "keys"])


def _keys(ends: bytes, keys: bytes) -> pa.Array:
    at = np.concatenate([np.zeros(1, np.int32), np.frombuffer(ends, np.int32)])
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(keys)])


COUNTS = "lang string, source string, block int, total long, slots binary, counts binary"


def _block(lang: str, source: str, block: int, dense: np.ndarray) -> tuple:
    """The slots of a block that are not zero."""
    used = np.nonzero(dense)[0]
    return lang, source, block, int(dense.sum()), used.astype(np.int32).tobytes(), dense[used].tobytes()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "source", "block", "total", "slots", "counts"])


def _recount(shared):
    """Counts of the broadcast shards' terms for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = defaultdict(list)
        for lang, shard, of, offset, kept, levels, bits, seed, ends, keys in shared.value:
            known[lang].append((shard, of, offset, kept, PerfectHash(levels, np.frombuffer(bits, np.uint8), _keys(ends, keys), seed)))

        def out():
            for (lang, source), counts in held.items():
                words, times = [_known(t) for t in counts], np.fromiter(counts.values(), np.int64, len(counts))
                h, words = hashed(words), pa.array(words, pa.binary())
                dense = np.zeros(-(-known[lang][0][3] // BLOCK) * BLOCK, np.int64)
                of = h.view(np.int64) % known[lang][0][1]
                for shard, _, offset, _, perfect in known[lang]:
                    mine = np.nonzero(of == shard)[0]
                    slots = perfect.find(words.take(pa.array(mine)), h[mine])
                    dense[offset + slots[slots >= 0]] += times[mine[slots >= 0]]
                dense = dense.reshape(-1, BLOCK)
                rows = [_block(lang, source, int(b), dense[b]) for b in np.nonzero(dense.any(axis=1))[0]]
                if rows:
                    yield _table(rows)

        held, size = defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in _rows(batch):
                if lang not in known:
                    continue
                group = held[lang, source]
                size -= len(group)
                for piece in terms(text):
                    group.update(piece)
                size += len(group)
                if size >= HELD:
                    yield from out()
                    held, size = defaultdict(Counter), 0
        yield from out()
    return run


def _add(slots: bytes, counts: bytes, into: np.ndarray) -> None:
    into[np.frombuffer(slots, np.int32)] += np.frombuffer(counts, np.int64)


def _sum_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a block of a group, or of a language, from any number of them."""
    total = np.zeros(BLOCK, np.int64)
    for batch in batches:
        for slots, counts in zip(batch.column("slots"), batch.column("counts")):
            _add(slots.as_py(), counts.as_py(), total)
    lang, block, *source = (k.as_py() for k in key)
    yield _table([_block(lang, source[0] if source else None, block, total)])


def _by_block(placed: pa.Table) -> pa.Table:
    """The terms of shards in stretches that do not leave a block."""
    rows = []
    for r in placed.to_pylist():
        keys, start = _keys(r["ends"], r["keys"]), r["offset"]
        for block in range(start // BLOCK, (start + len(keys) - 1) // BLOCK + 1):
            lo, hi = max(start, block * BLOCK), min(start + len(keys), (block + 1) * BLOCK)
            rows.append((r["lang"], block, lo, keys[lo - start:hi - start].to_pylist()))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["lang", "block", "lo", "terms"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _by_block(batch.slice(i, 1))


def _share(counts: np.ndarray, total: int, of: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * of)), exactly."""
    whole, part = np.divmod(counts + ADDED, total + ADDED * of)
    if total + ADDED * of < (1 << 63) // SCALE:
        return 1 + SCALE * whole + SCALE * part // (total + ADDED * of)
    return np.array([1 + SCALE * int(c + ADDED) // (total + ADDED * of) for c in counts], np.int64)


def _block_size(terms_: int, block: int) -> int:
    return min(BLOCK, terms_ - block * BLOCK)


def _differences(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over a block's terms of the absolute differences, for the sources of two tiles."""
    lang, block, first, second = (k.as_py() for k in key)
    shares: dict[int, dict] = defaultdict(dict)
    for r in table.to_pylist():
        dense = np.zeros(BLOCK, np.int64)
        if r["slots"] is not None:
            _add(r["slots"], r["counts"], dense)
        shares[r["tile"]][r["number"]] = _share(dense[:_block_size(r["kept"], block)], r["total"], r["kept"])
    a, b, value = [], [], []
    numbers, others = list(shares[second]), np.array(list(shares[second].values()))
    for number, mine in shares[first].items():
        sums = np.abs(others - mine).sum(axis=1).tolist()
        for x, y, v in zip([number] * len(sums), numbers, sums):
            a += [x, y] if first != second else [x]
            b += [y, x] if first != second else [y]
            value += [v, v] if first != second else [v]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64())})


def _leading(most: int):
    """The terms of each source of a tile whose share is furthest above the language's, with all that tie with the last of ``most``."""
    def run(sources: pa.Table, whole: pa.Table) -> pa.Table:
        out = []
        if sources.num_rows:
            top = whole.to_pylist()[0]
            dense = np.zeros(BLOCK, np.int64)
            _add(top["slots"], top["counts"], dense)
            base = _share(dense[:_block_size(top["kept"], top["block"])], top["total"], top["kept"])
            for r in sources.to_pylist():
                slots = np.frombuffer(r["slots"], np.int32)
                over = _share(np.frombuffer(r["counts"], np.int64), r["total"], r["kept"]) - base[slots]
                best = np.nonzero(over > 0)[0]
                if len(best) > most:
                    best = best[over[best] >= np.partition(over[best], -most)[-most]]
                out += [(r["lang"], r["source"], top["terms"][slots[i]], int(over[i])) for i in best]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
        return pa.Table.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["lang", "source", "term", "value"])
    return run


def _compared(counted: DataFrame, groups: DataFrame, sizes: DataFrame, stretches: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(lang, a, b, value) for pairs of sources and (lang, source, term, value) for leading terms."""
    totals = counted.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    sources = groups.join(sizes, "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    counts = counted.select("lang", "source", "block", "slots", "counts")
    cells = sources.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("kept") - 1) / BLOCK).cast("int")))).join(counts, ["lang", "source", "block"], "left")
    partner = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    keys = ["lang", "block", "first", "second"]
    paired = cells.withColumn("partner", partner).withColumns({"first": F.least("tile", "partner"), "second": F.greatest("tile", "partner")})
    sums = (paired.select(*keys, "tile", "number", "kept", "total", "slots", "counts").groupBy(*keys).applyInArrow(_differences, "lang string, a int, b int, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))

    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("total"))
    words = stretches.groupBy("lang", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "terms"))), lambda x: x["terms"])).alias("terms"))
    whole = (counted.groupBy("lang", "block").applyInArrow(_sum_blocks, COUNTS).select("lang", "block", "slots", "counts")
             .join(of_lang, "lang").join(sizes, "lang").join(words, ["lang", "block"]))
    tiles = groups.groupBy("lang").agg(F.max("tiles").alias("tiles"))
    whole = whole.join(tiles, "lang").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    whole = whole.select(*[F.col(c).alias(c) for c in whole.columns])  # columns of its own: both sides of the cogroup come from the same tables
    mine = cells.where(F.col("slots").isNotNull()).select("lang", "block", "tile", "source", "kept", "total", "slots", "counts")
    keys = ["lang", "block", "tile"]
    leading = mine.groupBy(*keys).cogroup(whole.groupBy(*keys)).applyInArrow(_leading(most), "lang string, source string, term binary, value long")
    return sums, leading


def audit(docs: DataFrame, least: int = 30, most: int = 50, text: str = "text", lang: str = "lang", source: str = "source", broadcast: int = BROADCAST) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows compare a source with each other source of its language, ``term`` rows name
    the ``most`` terms whose share in the source is furthest above that in the language.

    Null texts, languages and sources are empty strings, so all rows without a language are one language. A language keeps the terms that
    at least ``least`` of its documents hold; a language that keeps none has pairs of value 0 and no terms. Repeated rows count each. Ranks go by value
    descending, then item by its UTF-8 bytes. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))],
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    groups = rows.select("lang", "source").distinct().withColumn("number", number).withColumn("tile", F.floor(F.col("number") / TILE).cast("int"))
    groups = materialise(groups.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1))

    found = rows.mapInArrow(_document_counts, "lang string, term binary, docs long, whole binary").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.max("whole").alias("whole"))
    kept = materialise(found.where(F.col("docs") >= least).select("lang", "term", "whole"))
    sizes = materialise(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")))
    of = kept.join(sizes.select("lang", F.ceil(F.col("kept") / SHARD).cast("int").alias("of")), "lang")
    shards = materialise(of.withColumn("shard", F.pmod(F.xxhash64("term"), "of").cast("int")).groupBy("lang", "shard").applyInArrow(_build, SHARDS))
    # windows over one small row a shard; a round of shards ends before it would be too large
    held = F.length("bits") + F.length("ends") + F.length("keys")
    order = Window.partitionBy("lang").orderBy("shard")
    places = shards.select("lang", "shard", "n", held.alias("held")).join(sizes.select("lang", "kept", F.ceil(F.col("kept") / SHARD).cast("int").alias("of")), "lang").select(
        "lang", "shard", "of", "kept", (F.sum("n").over(order) - F.col("n")).alias("offset"), F.floor(F.sum("held").over(Window.orderBy("lang", "shard")) / broadcast).alias("round"))
    placed = materialise(shards.drop("n").join(places, ["lang", "shard"]))

    rounds = [r[0] for r in placed.select("round").distinct().orderBy("round").collect()]
    counted = None
    for n in rounds:
        part = placed.where(F.col("round") == n).select("lang", "shard", "of", "offset", "kept", "levels", "bits", "seed", "ends", "keys").collect()
        shared = spark.sparkContext.broadcast([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in part])
        seen = materialise(rows.mapInArrow(_recount(shared), COUNTS).groupBy("lang", "block", "source").applyInArrow(_sum_blocks, COUNTS))
        shared.unpersist()
        counted = seen if counted is None else counted.unionByName(seen)
    answers = groups.alias("g").join(groups.alias("o"), (F.col("g.lang") == F.col("o.lang")) & (F.col("g.number") != F.col("o.number"))).select(
        "g.lang", "g.source", F.col("g.number").alias("a"), F.col("o.number").alias("b"), F.col("o.source").alias("item"))
    pairs = answers.withColumn("value", F.lit(0).cast("long"))
    terms_ = groups.select("lang", "source", F.lit("").alias("item"), F.lit(0).cast("long").alias("value")).where(F.lit(False))
    if counted is not None:
        if len(rounds) > 1:  # a block may have slots of two rounds
            counted = materialise(counted.groupBy("lang", "block", "source").applyInArrow(_sum_blocks, COUNTS))
        stretches = placed.select("lang", "offset", "ends", "keys").mapInArrow(_stretches, "lang string, block int, lo long, terms array<binary>")
        sums, leading = _compared(counted, groups, sizes, stretches, most)
        pairs = answers.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
        long_terms = kept.where(F.col("whole").isNotNull())
        item = F.coalesce("whole", "term").cast("string").alias("item")
        terms_ = leading.join(long_terms, ["lang", "term"], "left").select("lang", "source", item, "value")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": order}).select(*columns)
    terms_ = terms_.withColumns({"part": F.lit("term"), "rank": order}).where(F.col("rank") <= most).select(*columns)
    return pairs.unionByName(terms_)
