"""Distance, nearest and contiguity joins on planar coordinates (metres).

Candidates come from equi-joins on grid cells, so there is no all-pairs product. Crowded cells and vertices are dealt to several
tasks (``joins.dealt_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.joins import dealt_join, with_scalars
from terrapanel.session import materialise


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))


def _half_ring() -> Column:
    """The cell itself and the four neighbours after it; the other four follow by symmetry."""
    steps = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps]))


def distance_pairs(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """All ordered pairs (src, dst, distance) within ``radius``, self excluded.

    Each unordered pair is found once, then mirrored.
    """
    p = points.select(F.col(key).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    right = p.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"),
                     _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    left = (p.withColumn("step", _half_ring())
            .select("id", "x", "y", "step", (_cell(F.col("x"), radius) + F.col("step.dx")).alias("cx"),
                    (_cell(F.col("y"), radius) + F.col("step.dy")).alias("cy")))
    here = (F.col("step.dx") == 0) & (F.col("step.dy") == 0)
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    once = (dealt_join(left, right, ["cx", "cy"])
            .where(F.when(here, F.col("id") < F.col("id2")).otherwise(F.lit(True)))
            .withColumn("distance", d).where(F.col("distance") <= radius))
    both = F.array(F.struct(F.col("id").alias("src"), F.col("id2").alias("dst")),
                   F.struct(F.col("id2").alias("src"), F.col("id").alias("dst")))
    return once.select(F.explode(both).alias("e"), "distance").select("e.src", "e.dst", "distance")


def location_exposure(points: DataFrame, key: str, x: str, y: str, measures: list[str], radius: float,
                      weight: Column | None = None) -> DataFrame:
    """Per point: sum of weight(distance) * measure over all other points within ``radius``.

    Points are first summed by exact location, so any number of co-located points is one row in
    the pair join; a point's own value is taken out again at the end. ``weight`` is an expression
    in ``distance`` (default 1) and is evaluated at distance zero for co-located points.
    """
    w = weight if weight is not None else F.lit(1.0)
    sums = {m: F.sum(F.col(m).cast("double")) for m in measures}
    loc = points.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(
        *[s.alias(f"s_{m}") for m, s in sums.items()], F.count(F.lit(1)).cast("double").alias("s_n"))
    loc = loc.withColumn("loc", F.struct("x", "y"))
    names = [*measures, "n"]
    pairs = distance_pairs(loc, "loc", "x", "y", radius)
    around = (pairs.join(loc.select(F.col("loc").alias("dst"), *[f"s_{m}" for m in names]), "dst")
              .groupBy(F.col("src").alias("loc")).agg(*[F.sum(w * F.col(f"s_{m}")).alias(f"a_{m}") for m in names]))
    at_zero = loc.withColumn("distance", F.lit(0.0)).withColumn("w0", w)
    per_loc = at_zero.join(around, "loc", "left").select(
        "x", "y", "w0", *[(F.coalesce(F.col(f"a_{m}"), F.lit(0.0)) + F.col("w0") * F.col(f"s_{m}")).alias(f"t_{m}") for m in names])
    own = points.withColumn("n", F.lit(1.0)).select(key, F.col(x).alias("x"), F.col(y).alias("y"),
                                                   *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in names])
    joined = own.join(per_loc, ["x", "y"])
    return joined.select(key, *[(F.col(f"t_{m}") - F.col("w0") * F.col(m)).alias(f"nbr_{m}") for m in names])


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(len2, F.lit(0.0))))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _pieces(size: Column | float) -> Column:
    """Parts of at most one cell's length and width that a segment is cut into."""
    longest = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    return F.greatest(F.lit(1), F.ceil(longest / size)).cast("int")


def _register(targets: DataFrame, size: float) -> DataFrame:
    """Targets in the grid cells along them: those of the bounding boxes of short pieces, so their number grows with the length."""
    def at(a: str, b: str, step: Column) -> Column:
        return F.col(a) + (F.col(b) - F.col(a)) * step / F.col("__k")

    def span(a: str, b: str) -> Column:
        one, two = _cell(at(a, b, F.col("__i")), size), _cell(at(a, b, F.col("__i") + 1), size)
        return F.sequence(F.least(one, two), F.greatest(one, two))
    cut = targets.withColumn("__k", _pieces(size)).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    return cut.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by"))).drop("__k", "__i")


def _distinct_shapes(segments: DataFrame, second: bool) -> DataFrame:
    """One row for each geometry with its smallest target, and with ``second`` another for the next one: copies cannot be nearer."""
    shape = ["ax", "ay", "bx", "by"]
    first = segments.groupBy(*shape).agg(F.min("target").alias("target"))
    if not second:
        return first
    least = first.withColumnRenamed("target", "__least")
    rest = segments.join(least, shape).where(F.col("target") > F.col("__least")).groupBy(*shape).agg(F.min("target").alias("target"))
    return first.unionByName(rest)


def _cell_size(segments: DataFrame, extent: float, n: int, crowd: int, levels: int = 12) -> float:
    """The coarsest of some cell sizes at which no cell holds more than ``crowd`` midpoints; the finest whose registered pieces stay
    a small multiple of the segments, where shared midpoints leave none. One job looks at all sizes."""
    sizes = [extent / max(1.0, n ** 0.5) / 4.0 ** i for i in range(levels)]
    tried = segments.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("size", F.get(F.array(*map(F.lit, sizes)), F.col("level")))
    middle = [F.floor((F.col(a) + F.col(b)) / 2 / F.col("size")).alias(f"c{a[-1]}") for a, b in (("ax", "bx"), ("ay", "by"))]
    cells = tried.select("level", *middle, _pieces(F.col("size")).cast("double").alias("k")).groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    seen = {r["level"]: r for r in cells.groupBy("level").agg(F.max("n").alias("busiest"), F.sum("k").alias("pieces")).collect()}
    fit = [i for i in range(levels) if seen[i]["pieces"] <= 8 * n] or [0]
    return sizes[next((i for i in fit if seen[i]["busiest"] <= crowd), fit[-1])]


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, x: str, y: str,
                    exclude_same: bool = False, crowd: int = 64) -> DataFrame:
    """(key, target, distance): nearest segment (target, ax, ay, bx, by); ties by distance, then target.

    Equal segments count once. The grid starts with few segments to a cell and doubles for points still unmatched. A match
    counts only when it is no farther than one cell, which the 3x3 ring is guaranteed to cover.
    """
    p = points.select(key, F.col(x).alias("x"), F.col(y).alias("y"))
    segments = materialise(_distinct_shapes(segments.select("target", "ax", "ay", "bx", "by"), exclude_same))
    box = segments.agg(F.count(F.lit(1)).alias("n"), F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"),
                       F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1")).first()
    if not box["n"]:
        return p.select(key, F.lit(None).cast("long").alias("target"), F.lit(None).cast("double").alias("distance"))
    extent = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-6)
    size = _cell_size(segments, extent, box["n"], crowd)
    d = segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    ring = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    left, found = p, None
    while True:
        cells = (left.withColumn("s", ring).select(key, "x", "y", (_cell(F.col("x"), size) + F.col("s.dx")).alias("cx"),
                                                   (_cell(F.col("y"), size) + F.col("s.dy")).alias("cy")))
        near = cells.join(_register(segments, size), ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= size)
        if exclude_same:
            near = near.where(F.col(key) != F.col("target"))
        best = near.groupBy(key).agg(F.min(F.struct("distance", "target")).alias("m")).select(key, "m.target", "m.distance")
        level = materialise(left.join(best, key, "left"))
        hit = level.where(F.col("target").isNotNull()).select(key, "target", "distance")
        found = hit if found is None else found.unionByName(hit)
        left = level.where(F.col("target").isNull()).select(key, "x", "y")
        if left.isEmpty():
            return found
        reach = left.agg(F.max(F.greatest(F.abs(F.col("x") - box["x0"]), F.abs(F.col("x") - box["x1"]),
                                          F.abs(F.col("y") - box["y0"]), F.abs(F.col("y") - box["y1"])))).first()[0]
        if size > 4.0 * (reach + extent):
            none = left.select(key, F.lit(None).cast(dict(found.dtypes)["target"]).alias("target"), F.lit(None).cast("double").alias("distance"))
            return found.unionByName(none)
        size *= 2.0


def nearest_point(points: DataFrame, targets: DataFrame, key: str, target_key: str, x: str, y: str,
                  exclude_same: bool = False) -> DataFrame:
    """Nearest target point; co-located targets collapse to the smallest id first."""
    t = targets.groupBy(F.col(x).alias("ax"), F.col(y).alias("ay"))
    if exclude_same:
        # a point's own location may hold others: keep the two smallest ids
        ids = t.agg(F.min(target_key).alias("i1"), F.max(target_key).alias("i2"))
        seg = ids.select(F.explode(F.array_distinct(F.array("i1", "i2"))).alias("target"), "ax", "ay")
    else:
        seg = t.agg(F.min(target_key).alias("target")).select("target", "ax", "ay")
    return nearest_segment(points, seg.withColumns({"bx": F.col("ax"), "by": F.col("ay")}), key, x, y, exclude_same)


# --- polygons: (id, rings array<array<struct<x,y>>>), first point repeated at the end or not ---

def open_rings(shapes: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, ring): one row per ring without the closing vertex."""
    r = F.explode(rings)
    one = shapes.select(F.col(key), r.alias("ring"))
    closed = F.col("ring")[0] == F.element_at("ring", -1)
    return one.select(key, F.when(closed, F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring")).alias("ring"))


def ring_edges(rings: DataFrame, keys: list[str]) -> DataFrame:
    nxt = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    e = rings.where(F.size("ring") >= 2).select(*keys, F.explode(F.arrays_zip(F.col("ring").alias("a"), nxt.alias("b"))).alias("e"))
    return e.select(*keys, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def shape_areas(shapes: DataFrame, key: str, rings: str) -> DataFrame:
    """Shoelace area; hole rings wound against the outer ring subtract."""
    e = ring_edges(open_rings(shapes, key, rings), [key])
    return e.groupBy(key).agg((F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2).alias("area"))


def point_in_shape(points: DataFrame, shapes: DataFrame, key: str, x: str, y: str, shape_key: str, rings: str, cell: float) -> DataFrame:
    """(key, shape): points strictly covered by ray-crossing parity, candidates by bounding-box cells."""
    e = ring_edges(open_rings(shapes, shape_key, rings), [shape_key])
    box = e.groupBy(F.col(shape_key).alias("shape")).agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    tiles = (box.withColumn("cx", F.explode(F.sequence(_cell(F.col("x0"), cell), _cell(F.col("x1"), cell))))
             .withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), cell), _cell(F.col("y1"), cell)))))
    p = points.select(key, F.col(x).alias("x"), F.col(y).alias("y"), _cell(F.col(x), cell).alias("cx"), _cell(F.col(y), cell).alias("cy"))
    near = p.join(tiles, ["cx", "cy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    # edges meet only the points of the horizontal strips they cross
    strips = F.sequence(_cell(F.least("ay", "by"), cell), _cell(F.greatest("ay", "by"), cell))
    e = e.withColumnRenamed(shape_key, "shape").where("ay <> by").withColumn("cy", F.explode(strips))
    at = F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    crossed = near.select(key, "shape", "x", "y", "cy").join(e, ["shape", "cy"]).where(spans & (F.col("x") < at))
    return crossed.groupBy(key, "shape").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").select(key, "shape")


def nearest_shape(points: DataFrame, shapes: DataFrame, key: str, x: str, y: str, shape_key: str, rings: str, cell: float) -> DataFrame:
    """Nearest polygon, distance zero inside; ties by distance, then id."""
    inside = (point_in_shape(points, shapes, key, x, y, shape_key, rings, cell).groupBy(key).agg(F.min("shape").alias("target"))
              .withColumn("distance", F.lit(0.0)))
    rest = points.join(inside, key, "left_anti")
    seg = ring_edges(open_rings(shapes, shape_key, rings), [shape_key]).withColumnRenamed(shape_key, "target")
    return inside.unionByName(nearest_segment(rest, seg, key, x, y))


def contiguity(shapes: DataFrame, key: str, rings: str, digits: int = 3) -> DataFrame:
    """Directed pairs (src, dst) of shapes sharing a boundary vertex after rounding."""
    v = open_rings(shapes, key, rings).select(F.col(key).alias("id"), F.explode("ring").alias("v"))
    v = v.select("id", F.round("v.x", digits).alias("vx"), F.round("v.y", digits).alias("vy")).distinct()
    a, b = v.withColumnRenamed("id", "src"), v.withColumnRenamed("id", "dst")
    return dealt_join(a, b, ["vx", "vy"]).where("src <> dst").select("src", "dst").distinct()


def attach_islands(edges: DataFrame, points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Link entities without an edge to their nearest neighbour, both ways, labelled."""
    alone = points.join(edges.select(F.col("src").alias(key)).distinct(), key, "left_anti")
    near = nearest_point(alone, points, key, key, x, y, exclude_same=True).where(F.col("target").isNotNull())
    both = F.array(F.struct(F.col(key).alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col(key).alias("dst")))
    extra = near.select(F.explode(both).alias("e")).select("e.src", "e.dst").distinct().withColumn("edge_type", F.lit("island_fallback"))
    return edges.select("src", "dst").withColumn("edge_type", F.lit("queen")).unionByName(extra)


# --- overlay area ---

def _clip(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """Clip a ring at one axis-parallel line; degenerate edges along the line carry no area.

    The one-element transform binds the ring once, so nested clips are not expanded repeatedly.
    """
    other = "y" if axis == "x" else "x"

    def inside(p: Column) -> Column:
        return (p[axis] >= bound) if keep_above else (p[axis] <= bound)

    def step(a: Column, b: Column) -> Column:
        t = (bound - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        cut = a[other] + t * (b[other] - a[other])
        hit = (F.struct(bound.alias("x"), cut.alias("y")) if axis == "x" else F.struct(cut.alias("x"), bound.alias("y")))
        none = F.slice(F.array(b), 1, 0)
        return (F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(hit))
                .when(inside(b), F.array(hit, b)).otherwise(none))

    def clip_one(r: Column) -> Column:
        nxt = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        return F.flatten(F.zip_with(r, nxt, step))

    return F.transform(F.array(ring), clip_one)[0]


def _cut(pieces: DataFrame, size: float) -> DataFrame:
    """Rings cut to the tiles of a grid that their bounding boxes touch: the columns of ``pieces`` with the cut ``ring``, tx and ty."""
    edge = F.lit(float(size))

    def span(axis: str) -> Column:
        v = F.transform("ring", lambda p: p[axis])
        return F.sequence(F.floor(F.array_min(v) / edge), F.floor(F.array_max(v) / edge))

    t = pieces.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    for axis, tile in (("x", "tx"), ("y", "ty")):
        t = t.withColumn("ring", _clip(F.col("ring"), axis, F.col(tile) * edge, True))
        t = t.withColumn("ring", _clip(F.col("ring"), axis, (F.col(tile) + 1) * edge, False))
    return t.where(F.size("ring") >= 3)


#: Edges that a tile may hold before it is split if they are slanted or of many heights, and in any case; how often tiles are halved at most.
BUSY, FULL, HALVINGS = 1024, 1 << 15, 12


def _ring_pieces(shapes: DataFrame, key: Column, rings: str, side: int, cell: float) -> DataFrame:
    """(side, id, ring, tx, ty) of every ring cut to the grid."""
    named = shapes.select(key.alias("id"), F.col(rings).alias("rings"))
    r = open_rings(named, "id", "rings").select(F.lit(side).alias("side"), "id", F.transform("ring", lambda p: F.struct(
        p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring"))
    return _cut(r.where(F.size("ring") >= 3).repartition("id"), cell)


def _lengths(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """+1 where a part begins along the line and -1 where it ends, for crossings in any order: its edges take turns."""
    order = np.lexsort((x, part))
    first = np.searchsorted(part[order], part[order])
    turn = np.empty(len(x))
    turn[order] = 1.0 - 2.0 * ((np.arange(len(x)) - first) % 2)
    return turn


def _crossings(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> Iterator[np.ndarray]:
    """Heights at which edges cross. Upright edges do not cross one another, so only slanted ones look for others, among those whose widths meet theirs."""
    dx, dy = x2 - x1, y2 - y1
    left, right = np.minimum(x1, x2), np.maximum(x1, x2)
    order = np.argsort(left, kind="stable")
    starts = left[order]
    for i in np.flatnonzero(dx != 0):
        j = order[:np.searchsorted(starts, right[i], side="right")]
        j = j[(right[j] >= left[i]) & (y1[j] < y2[i]) & (y2[j] > y1[i])]
        den = dx[i] * dy[j] - dx[j] * dy[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = y1[i] + dy[i] * ((x1[j] - x1[i]) * dy[j] - (y1[j] - y1[i]) * dx[j]) / np.where(den == 0, np.nan, den)
        yield y[(y > np.maximum(y1[j], y1[i])) & (y < np.minimum(y2[j], y2[i]))]


def _covered(key: tuple, table: pa.Table) -> pa.Table:
    """Area of the layer inside each shape of a tile, and (id null) of the layer itself; parts that overlap count once.

    Between two neighbouring heights of vertices or crossings no edges cross, so areas are lengths at the middle times the height.
    """
    side = table["side"].to_numpy()
    coded = table["id"].combine_chunks().dictionary_encode()
    part, names = coded.indices.to_numpy(), coded.dictionary
    x1, y1, x2, y2 = (table[c].to_numpy() for c in ("ax", "ay", "bx", "by"))
    up = y2 > y1
    x1, x2, y1, y2 = np.where(up, x1, x2), np.where(up, x2, x1), np.where(up, y1, y2), np.where(up, y2, y1)
    dx, dy = x2 - x1, y2 - y1
    heights = np.unique(np.concatenate([y1, y2, *_crossings(x1, y1, x2, y2)]))
    area, whole = np.zeros(len(names)), 0.0
    for low, high in zip(heights, heights[1:]):
        mid = (low + high) / 2
        at = np.nonzero((y1 <= mid) & (y2 >= mid))[0]
        x = x1[at] + (mid - y1[at]) * dx[at] / dy[at]
        layer, shape = side[at] == 1, side[at] == 0
        if not layer.any():
            continue
        order = np.argsort(x[layer], kind="stable")
        cuts, inside = x[layer][order], np.cumsum(_lengths(x[layer], part[at][layer])[order])
        length = np.concatenate([[0.0], np.cumsum(np.where(inside[:-1] > 0, np.diff(cuts), 0.0))])
        whole += (high - low) * length[-1]
        if shape.any():
            ends = -_lengths(x[shape], part[at][shape]) * np.interp(x[shape], cuts, length)
            area += (high - low) * np.bincount(part[at][shape], ends, len(names))
    met = np.nonzero(area)[0]
    return pa.table({"id": pa.concat_arrays([names.take(pa.array(met)), pa.nulls(1, names.type)]), "met": np.append(area[met], whole)})


def _busy_tiles(pieces: DataFrame) -> DataFrame:
    """(tx, ty) of tiles with too much work: a task passes a tile's edges once for each height of a vertex and each slanted edge."""
    e = ring_edges(pieces, ["tx", "ty"]).where("ay <> by")
    seen = e.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("ay").alias("heights"), F.count_if(F.col("ax") != F.col("bx")).alias("slanted"))
    work = F.col("n") * (F.col("heights") + F.col("slanted"))
    return seen.where((F.col("n") > FULL) | ((F.col("n") > BUSY) & (work > BUSY * BUSY))).select("tx", "ty")


def layer_cover(shapes: DataFrame, layer: DataFrame, key: str, rings: str, layer_rings: str, cell: float = 10_000.0) -> DataFrame:
    """(id, met): area of each shape that the layer covers, and in the row without id the layer's whole area; parts of the layer that overlap count once.

    Both sides are cut to the tiles of a grid. A tile with too many edges is cut into quarters, again and again, so that no tile gathers
    a busy place; the tiles are then independent of one another. Upright edges of few heights cost a sort, so a tile may hold many of them.
    """
    kind = dict(shapes.dtypes)[key]
    parts = layer.withColumn("__part", F.monotonically_increasing_id().cast("string"))
    whole = _ring_pieces(shapes, F.col(key).cast("string"), rings, 0, cell).unionByName(_ring_pieces(parts, F.col("__part"), layer_rings, 1, cell))
    open_, size, out = materialise(whole), float(cell), None
    for halving in range(HALVINGS + 1):
        busy = materialise(_busy_tiles(open_)) if halving < HALVINGS else None
        split = busy is not None and not busy.isEmpty()
        now = open_.join(busy, ["tx", "ty"], "left_anti") if split else open_
        e = ring_edges(now, ["side", "id", "tx", "ty"]).where("ay <> by")
        found = e.groupBy("tx", "ty").applyInArrow(_covered, "id string, met double")
        out = found if out is None else out.unionByName(found)
        if not split:
            break
        size /= 2
        open_ = materialise(_cut(open_.join(busy, ["tx", "ty"], "left_semi").drop("tx", "ty"), size))
    return out.groupBy("id").agg(F.sum("met").alias("met")).select(F.col("id").cast(kind).alias(key), "met")


def overlay_share(shapes: DataFrame, layer: DataFrame, key: str, rings: str, layer_rings: str, cell: float = 10_000.0, out: str = "share") -> DataFrame:
    """(key, area, overlap_area, share): area(shape ∩ layer) / area(shape), in [0, 1]; zero where they do not meet.

    Shapes and layer parts are polygons with holes (even-odd); parts of the layer may overlap, and their union counts.
    """
    met = layer_cover(shapes, layer, key, rings, layer_rings, cell).where(F.col(key).isNotNull())
    return (shape_areas(shapes, key, rings).join(met, key, "left")
            .select(key, "area", F.coalesce("met", F.lit(0.0)).alias("overlap_area"),
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("met", F.lit(0.0)) / F.nullif(F.col("area"), F.lit(0.0)))).alias(out)))


def layer_reconciliation(shapes: DataFrame, layer: DataFrame, key: str, rings: str, layer_key: str, layer_rings: str, official: float, cell: float = 10_000.0) -> DataFrame:
    """One row: polygons of a layer, their summed and their dissolved area, what was counted twice, the area inside the shapes, and ratios to an official total and to the dissolved area."""
    summed = shape_areas(layer, layer_key, layer_rings).agg(F.count(F.lit(1)).alias("n_polygons"), F.sum("area").alias("summed_area"))
    cover = layer_cover(shapes, layer, key, rings, layer_rings, cell)
    found = cover.agg(F.sum(F.when(F.col(key).isNull(), F.col("met"))).alias("dissolved_area"), F.sum(F.when(F.col(key).isNotNull(), F.col("met"))).alias("area_inside"))
    return with_scalars(summed, found).select("n_polygons", "summed_area", "dissolved_area", (F.col("summed_area") - F.col("dissolved_area")).alias("double_counted"), "area_inside",
                                              (F.col("summed_area") / F.lit(float(official))).alias("summed_vs_official"), (F.col("area_inside") / F.col("dissolved_area")).alias("share_inside"))
