"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are cut into blocks. Block j of a source of weight w (a share of all blocks) is released at slot floor(j / w) and due
by slot ceil((j + 1) / w); of the released blocks the one due first gets the next slot (ties to the block whose window overlaps the
next one's, then the heavier source). In every prefix of the schedule each source's share then deviates from its weight by
less than one block.

Weights are rounded to multiples of 1 / period, by less than one each, so the schedule repeats and may leave the stated weight by less than
one more block in every period. The period has as many slots as the smallest weight needs for one of its own: one period is computed on the driver, a table of ``slots`` rows, and
joined to the blocks. When a source has no more blocks its slots fall away and the others go on in their order: no row is dropped.
Within a source rows are in an order by hash, numbered by counting small ranges of the hash first, so no source meets in one task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows to a range of the hash, about.
RANGE = 4096
#: Slots of a period times streams at most, for the table of a period that the driver holds.
CELLS = 4_000_000


def units(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Weights as whole slots of a period, by largest remainder; one, from the stream with most, where that gives none."""
    given = {s: Fraction(w) for s, w in weights.items()}
    total = sum(given.values())
    exact = {s: w * slots / total for s, w in given.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: (out[s] - exact[s], s))[:slots - sum(out.values())]:
        out[s] += 1
    for s in sorted(s for s, u in out.items() if not u):
        out[max(out, key=lambda x: (out[x], x))] -= 1
        out[s] = 1
    return out


def period_slots(weights: dict[str, float], slots: int) -> int:
    """``slots``, or as many as give the smallest weight one of its own, as far as ``CELLS`` allows."""
    needed = -(-sum(map(Fraction, weights.values())) // Fraction(min(weights.values())))
    return max(slots, 2 * len(weights), min(int(needed), CELLS // len(weights)))


def schedule(share: dict[str, int]) -> list[str]:
    """One period: the source of each slot, by earliest deadline among released blocks."""
    slots = sum(share.values())
    done = dict.fromkeys(share, 0)
    out = []
    for t in range(slots):
        best = None
        for s, u in share.items():
            j = done[s]
            if j < u and j * slots // u <= t:
                due = -(-(j + 1) * slots // u)
                order = (due, (j + 1) * slots % u == 0, -u, s)
                best = min(best, (order, s)) if best else (order, s)
        # The shares fill the period, so some block is always released.
        out.append(best[1])
        done[best[1]] += 1
    return out


def target_weights(docs: DataFrame, source: str, power: float, most: int) -> tuple[dict[str, float], int]:
    """Weights by count to the ``power`` of the ``most`` commonest sources, and of all others together under ''; and how many rows there are."""
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).count()
    top = {r["s"]: r["count"] for r in counts.where("s <> ''").orderBy(F.desc("count"), "s").limit(most).collect()}
    rows = counts.agg(F.sum("count")).first()[0] or 0
    named = dict(top)
    if rows > sum(top.values()):
        named[""] = rows - sum(top.values())
    return {s: float(c) ** power for s, c in named.items()}, rows


def numbered(rows: DataFrame, group: Column, order: list[Column], total: int) -> DataFrame:
    """``rows`` with ``n``, its number from 0 in its group by a hash of the ``order`` columns, ties by them."""
    spread = F.xxhash64(*order)
    part = F.floor(F.pmod(spread, F.lit(1 << 62)) / F.lit((1 << 62) / max(1, -(-total // RANGE)))).cast("long")
    placed = rows.withColumns({"_group": group, "_hash": F.pmod(spread, F.lit(1 << 62)), "_part": part})
    sizes = placed.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_size"))
    # Running sums over the ranges, themselves by ranges of ranges.
    sizes = sizes.withColumn("_wide", F.floor(F.col("_part") / RANGE))
    wide = sizes.groupBy("_group", "_wide").agg(F.sum("_size").alias("_all"))
    before = Window.partitionBy("_group").orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_group", "_wide").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.join(wide.withColumn("_wide_start", F.coalesce(F.sum("_all").over(before), F.lit(0))), ["_group", "_wide"])
              .select("_group", "_part", (F.coalesce(F.sum("_size").over(within), F.lit(0)) + F.col("_wide_start")).alias("_start")))
    own = Window.partitionBy("_group", "_part").orderBy("_hash", *order)
    ranked = placed.withColumn("_rank", F.row_number().over(own) - 1)
    return ranked.join(starts, ["_group", "_part"]).withColumn("n", F.col("_rank") + F.col("_start")).drop("_hash", "_part", "_rank", "_start")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5,
        block_rows: int = 16, slots: int = 1000, most_sources: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, *keep, stream, block, slot, position) for every row of ``docs``, to be read in order of position.

    ``weights`` names target weights of sources (others, and null or empty ones, are one stream '' of weight 1 in all if it has rows); without them the weight is the
    count to the ``power``, with sources beyond the ``most_sources`` commonest in the stream ''. Shares of a period of ``slots``, or of more
    slots if the smallest weight needs them, are the weights by largest remainder; a weight under the number of streams over ``CELLS`` counts as that. ``slot``
    numbers blocks in the schedule, ``position`` the rows in it from 0 without gaps. Rows with equal or null keys are in the order of
    all their columns' hash, and repeated rows hold places of their own. ``keep`` names columns to carry along, and to break ties; others are not read. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)])
    known, total = target_weights(rows, "source", power, most_sources)
    if weights is not None:
        named = {s: float(w) for s, w in weights.items() if w > 0 and s}
        known = named | ({"": 1.0} if set(known) - set(named) else {})
    names = [s for s in known if s]
    share = units(known, period_slots(known, slots)) if known else {}
    period = schedule(share)
    turns: dict[str, int] = {}
    table = []
    for t, s in enumerate(period):
        table.append((s, turns.get(s, 0), t))
        turns[s] = turns.get(s, 0) + 1
    plan = spark.createDataFrame(table, "stream string, turn long, at long")
    shares = spark.createDataFrame(list(share.items()), "stream string, units long")
    named = F.coalesce(F.when(F.col("source").isin(names), F.col("source")), F.lit("")) if names else F.lit("")
    placed = numbered(rows, named, [F.col(c) for c in rows.columns], total).withColumnRenamed("_group", "stream")
    # The tables of the period have at most max(slots, CELLS / streams) rows.
    block = placed.withColumn("block", F.floor(F.col("n") / block_rows)).join(F.broadcast(shares), "stream")
    block = block.withColumns({"turn": F.col("block") % F.col("units"), "round": F.floor(F.col("block") / F.col("units"))})
    slotted = block.join(F.broadcast(plan), ["stream", "turn"]).withColumn("slot", F.col("round") * len(period) + F.col("at"))
    # Rows before a slot: full rounds and turns of every stream, as far as it has rows.
    had = {r["stream"]: r["n"] for r in rows.groupBy(named.alias("stream")).agg(F.count(F.lit(1)).alias("n")).collect()}
    passed = {s: 0 for s in share}
    before = []
    for t, s in enumerate(period):
        before.append((t, [passed[x] for x in share]))
        passed[s] += 1
    counts = spark.createDataFrame(before, "at long, passed array<long>")
    limits = F.array(*[F.lit(had.get(s, 0)).cast("long") for s in share]) if share else F.array().cast("array<long>")
    per_round = F.array(*[F.lit(u).cast("long") for u in share.values()]) if share else F.array().cast("array<long>")
    earlier = F.zip_with(F.zip_with(per_round, F.col("passed"), lambda u, p: (F.col("round") * u + p) * block_rows), limits, lambda n, most: F.least(n, most))
    at = F.aggregate(earlier, F.lit(0).cast("long"), lambda a, b: a + b) + F.col("n") % block_rows
    return slotted.join(F.broadcast(counts), "at").select(F.col("key").alias(key), F.col("source").alias(source), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "stream", "block", "slot", at.alias("position"))
