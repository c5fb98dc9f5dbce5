"""Sums over the points within a radius, without a row for every pair, and lists of links that are made where their points meet.

The links of n points in a given area grow with n squared, their sums only with n. Points meet on the tiles of a grid, and a task multiplies the
indicator "within the radius" of a block of points with the values of the others; only the sums leave it. Crowded tiles are dealt to several tasks.
Lists (``links``, ``second_links``) leave their task once and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.session import materialise

#: Sources of a task, other points of a task, points of a small cell, and entries of an indicator held at once.
SOURCES, OTHERS, CELL, ENTRIES = 1 << 14, 1 << 17, 48, 1 << 21
#: Points of a small cell for forms, and points at its rim that are compared with it together.
FORM, RIM = 80, 1 << 11
#: Points of a side of a task that lists links, and middles that one looks at together.
LISTED, MIDDLES = 2048, 8192
#: Entries of an indicator whose links are written together.
CHUNK = 1 << 19
#: Tasks that deal the points of lists to the tiles they meet on: one point makes many rows.
DEALERS = 128


@dataclass(frozen=True)
class Proximity:
    """Links between all points (id, x, y, group) of different ids within ``radius``; with ``across`` only those between groups, with ``scale`` weighted by exp(-distance / scale).

    As a list it has only the links (src, dst) that satisfy ``kept``, each ``times`` times, with a flag for each (name, radius) of ``radii`` where it is weighted; sums take all links once.
    """

    nodes: DataFrame
    radius: float
    across: bool = False
    scale: float | None = None
    kept: str | None = None
    times: int = 1
    radii: tuple[tuple[str, float], ...] = ()

    def where(self, condition: str) -> Proximity:
        return replace(self, kept=f"({self.kept}) AND ({condition})" if self.kept else condition)

    def unionByName(self, other: Proximity) -> Proximity:
        if replace(other, times=self.times) != self:
            raise ValueError("only lists of the same links can be put together")
        return replace(self, times=self.times + other.times)

    def grouped(self, attributes: DataFrame, key: str, group: str) -> Proximity:
        """With the group of each point; points without attributes have no links."""
        a = attributes.select(F.col(key).alias("id"), F.col(group).cast("string").alias("group"))
        return replace(self, nodes=self.nodes.drop("group").join(a, "id"))

    def distinct(self) -> Proximity:
        return replace(self, nodes=self.nodes.distinct())


def proximity(points: DataFrame, key: str, x: str, y: str, radius: float) -> Proximity:
    """The links that ``spatial.distance_pairs`` lists; points without id or place have none."""
    p = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(None).cast("string").alias("group"))
    return Proximity(p.dropna(subset=["id", "x", "y"]), float(radius))


@dataclass
class Places:
    """Places of points with numbers for their ids and groups."""

    x: np.ndarray
    y: np.ndarray
    id: np.ndarray
    group: np.ndarray

    def take(self, at) -> Places:
        return Places(self.x[at], self.y[at], self.id[at], self.group[at])


def _near(a: Places, b: Places, radius: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``b`` are linked to each of ``a``, and the squares of all distances."""
    dx, dy = a.x[:, None] - b.x, a.y[:, None] - b.y
    squares = dx * dx + dy * dy
    near = squares <= radius * radius
    brink = np.abs(squares - radius * radius) <= 1e-12 * radius * radius
    if brink.any():
        near[brink] = np.hypot(dx[brink], dy[brink]) <= radius
    near &= a.id[:, None] != b.id
    if across:
        near &= a.group[:, None] != b.group
    return near, squares


def _weights(a: Places, b: Places, radius: float, across: bool, scale: float | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Which of ``b`` are linked to each of ``a``, as zeros and ones, and the weights of the links."""
    near, squares = _near(a, b, radius, across)
    return near.astype(float), None if scale is None else np.where(near, np.exp(-np.sqrt(squares) / scale), 0.0)


def near_sums(a: Places, b: Places, plain: np.ndarray, weighted: np.ndarray, radius: float, across: bool = False, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``plain`` and ``weighted`` (one a point of ``b``) summed over the links of each point of ``a``.

    Both sides lie in small cells. Cells wholly within the radius give their totals where all their links count alike; only cells at its rim
    are compared point by point.
    """
    out, heavy = np.zeros((len(a.x), plain.shape[1])), np.zeros((len(a.x), weighted.shape[1]))
    if not len(a.x) or not len(b.x):
        return out, heavy
    if scale is None:
        both = _alike(a, b, np.hstack([plain, weighted]), radius, across)
        return both[:, :plain.shape[1]], both[:, plain.shape[1]:]
    for rows, cand, _ in _meetings(a, b, radius, False):
        for part in np.array_split(rows, max(1, -(-len(rows) * len(cand) // ENTRIES))):
            near, w = _weights(a.take(part), b.take(cand), radius, across, scale)
            out[part], heavy[part] = near @ plain[cand], w @ weighted[cand]
    return out, heavy


def _alike(a: Places, b: Places, values: np.ndarray, radius: float, across: bool) -> np.ndarray:
    """The sums where every link counts one."""
    out = np.zeros((len(a.x), values.shape[1]))
    whole = not across and len(np.unique(b.id)) == len(np.unique(np.stack([b.id, b.x, b.y]), axis=1).T)
    order, starts = None, None
    for rows, cand, inner in _meetings(a, b, radius, whole):
        if whole and order is None:
            order, starts = inner[0]
            totals = np.add.reduceat(values[order], starts, axis=0)
        base = totals[inner[1]].sum(axis=0) if whole else 0.0
        if not len(cand):
            out[rows] = base
            continue
        other, v = b.take(cand), values[cand]
        for part in np.array_split(rows, max(1, -(-len(rows) * len(cand) // ENTRIES))):
            near, _ = _weights(a.take(part), other, radius, across, None)
            out[part] = near @ v + base
    return out


def _meetings(a: Places, b: Places, radius: float, whole: bool):
    """For each small cell of ``a``: its points, the points of ``b`` to compare, and (``whole``) the cells of ``b`` that lie within the radius altogether."""
    spans = [max(float(np.ptp(v)), radius) / radius for v in (b.x, b.y)]
    size = radius / np.clip(np.sqrt(len(b.x) / (spans[0] * spans[1]) / CELL), 1, 32)
    ax, ay, bx, by = (np.floor(v / size) for v in (a.x, a.y, b.x, b.y))
    order = np.lexsort((bx, by))
    cx, cy = bx[order], by[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(cx) != 0) | (np.diff(cy) != 0)]))
    ends = np.append(starts[1:], len(order))
    cx, cy = cx[starts], cy[starts]
    mine = np.lexsort((ax, ay))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(ax[mine]) != 0) | (np.diff(ay[mine]) != 0)]))
    for rows in np.split(mine, first[1:]):
        i, j = np.abs(cx - ax[rows[0]]), np.abs(cy - ay[rows[0]])
        meet = np.hypot(np.maximum(i - 1, 0), np.maximum(j - 1, 0)) * size <= radius * (1 + 1e-9)
        inner = meet & (np.hypot(i + 1, j + 1) * size <= radius * (1 - 1e-9)) & ((i > 0) | (j > 0)) if whole else None
        at = np.flatnonzero(meet & ~inner if whole else meet)
        cand = np.concatenate([order[starts[k]:ends[k]] for k in at]) if len(at) else np.empty(0, np.int64)
        yield rows, cand, ((order, starts), np.flatnonzero(inner)) if whole else None


def near_forms(p: Places, shares: np.ndarray, values: np.ndarray, radius: float, part: int = 0, parts: int = 1) -> np.ndarray:
    """For every column of ``values`` (one row a point) the sum over all links of the one point's share times its value times the other's value.

    A link is taken once for both its directions. Cells wholly within the radius of each other give their totals, as do points within the radius of a whole
    cell; only the points at the rim of a cell are compared with it. Of several ``parts`` each takes the links of some of the cells.
    """
    by_id = np.argsort(p.id, kind="stable")
    ids, x, y = p.id[by_id], p.x[by_id], p.y[by_id]
    again = ids[1:] == ids[:-1]
    if not len(ids) or (again & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))).any():
        mine = np.arange(part, len(ids), parts)
        around, _ = near_sums(p.take(mine), p, values, np.zeros((len(ids), 0)), radius)
        return (shares[mine, None] * values[mine] * around).sum(axis=0)
    size, order = in_cells(p, radius)
    if (np.diff(order) != 1).any():
        p, shares, values = p.take(order), shares[order], values[order]
    cx, cy = np.floor(p.x / size), np.floor(p.y / size)
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(cx) != 0) | (np.diff(cy) != 0)]))
    ends = np.append(starts[1:], len(cx))
    cx, cy = cx[starts], cy[starts]
    totals = np.add.reduceat(values, starts, axis=0)
    shared = np.stack([shares[s:e] @ values[s:e] for s, e in zip(starts, ends)])
    most = np.searchsorted(cy, cy + radius / size * (1 + 1e-9) + 1, side="right")
    out = np.zeros(values.shape[1])
    for k in range(part, len(starts), parts):
        mine = slice(starts[k], ends[k])
        later = slice(k + 1, most[k])
        i, j = np.abs(cx[later] - cx[k]), cy[later] - cy[k]
        meet = np.hypot(np.maximum(i - 1, 0), np.maximum(j - 1, 0)) * size <= radius * (1 + 1e-9)
        inner = meet & (np.hypot(i + 1, j + 1) * size <= radius * (1 - 1e-9))
        # a cell's points are all linked to each other, and points of one id stand in one cell
        out += shared[k] * totals[k] - _own(p.id[mine], shares[mine], values[mine])
        at = np.flatnonzero(inner) + k + 1
        total, own = totals[at].sum(axis=0), shared[at].sum(axis=0)
        at = np.flatnonzero(meet & ~inner) + k + 1
        cand = np.concatenate([np.arange(starts[c], ends[c]) for c in at]) if len(at) else np.empty(0, np.int64)
        x, y, box = p.x[cand], p.y[cand], (p.x[mine].min(), p.x[mine].max(), p.y[mine].min(), p.y[mine].max())
        least = np.maximum(np.maximum(box[0] - x, x - box[1]), 0) ** 2 + np.maximum(np.maximum(box[2] - y, y - box[3]), 0) ** 2
        largest = np.maximum(box[1] - x, x - box[0]) ** 2 + np.maximum(box[3] - y, y - box[2]) ** 2
        within = largest <= radius * radius * (1 - 1e-9)
        some = cand[within]
        for at in np.array_split(some, -(-len(some) // OTHERS) or 1):
            v = values[at]
            total, own = total + v.sum(axis=0), own + shares[at] @ v
        out += shared[k] * total + totals[k] * own
        rim = cand[~within & (least <= radius * radius * (1 + 1e-9))]
        for at in np.array_split(rim, -(-len(rim) // RIM) or 1):
            v = values[at]
            for rows in np.array_split(np.arange(mine.start, mine.stop), -(-(mine.stop - mine.start) * len(at) // ENTRIES) or 1):
                out += np.einsum("ij,ij->j", values[rows], _both_shares(p, shares, rows, at, radius) @ v)
    return out


def in_cells(p: Places, radius: float) -> tuple[float, np.ndarray]:
    """The size of small cells, at most half the radius, and the order in which the points of one follow one another."""
    spans = [max(float(np.ptp(v)), radius) / radius for v in (p.x, p.y)] if len(p.x) else [1.0, 1.0]
    size = radius / np.clip(np.sqrt(len(p.x) / (spans[0] * spans[1]) / FORM), 2, 64)
    return size, np.lexsort((p.x, np.floor(p.x / size), np.floor(p.y / size)))


def _own(ids: np.ndarray, shares: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What the points of a cell would give with themselves and points of their id."""
    firsts, which = np.unique(ids, return_inverse=True)
    if len(firsts) == len(ids):
        return shares @ (values * values)
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(len(firsts)))
    one, other = (np.add.reduceat(v[order], starts, axis=0) for v in (shares[:, None] * values, values))
    return (one * other).sum(axis=0)


def _both_shares(p: Places, shares: np.ndarray, rows: np.ndarray, others: np.ndarray, radius: float) -> np.ndarray:
    """The shares of both points where ``rows`` and ``others`` (of other cells) are linked, else zero."""
    x, y = (v[rows] - v[rows[0]] for v in (p.x, p.y))
    ox, oy = (v[others] - v[rows[0]] for v in (p.x, p.y))
    squares = np.stack([x, y, x * x + y * y, np.ones(len(x))], axis=1) @ np.stack([-2 * ox, -2 * oy, np.ones(len(ox)), ox * ox + oy * oy])
    near, wide = (squares <= radius * radius * (1 + e) for e in (-1e-12, 1e-12))
    if np.count_nonzero(near) != np.count_nonzero(wide):
        a, b = np.nonzero(near != wide)
        near[a, b] = np.hypot(p.x[rows[a]] - p.x[others[b]], p.y[rows[a]] - p.y[others[b]]) <= radius
    both = np.add(shares[rows, None], shares[others], out=squares)
    return np.multiply(both, near, out=both)


def indicator_product(a: Places, b: Places, plain: np.ndarray, weighted: np.ndarray, radius: float, across: bool = False, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``near_sums`` from the definition: every point against every other."""
    out, heavy = np.zeros((len(a.x), plain.shape[1])), np.zeros((len(a.x), weighted.shape[1]))
    for rows in np.array_split(np.arange(len(a.x)), max(1, -(-len(a.x) * len(b.x) // ENTRIES))):
        distance = np.hypot(a.x[rows, None] - b.x, a.y[rows, None] - b.y)
        linked = (distance <= radius) & (a.id[rows, None] != b.id) & ((a.group[rows, None] != b.group) | (not across))
        out[rows] = linked.astype(float) @ plain
        heavy[rows] = (linked * (1.0 if scale is None else np.exp(-distance / scale))) @ weighted
    return out, heavy


def codes(columns: list[pa.ChunkedArray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the distinct values of all columns together (nulls are values), and the number of each row's."""
    code = np.zeros(n, np.int64)
    for c in columns:
        one = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        code = np.unique(code * (int(one.max(initial=0)) + 1) + one, return_inverse=True)[1]
    return np.unique(code, return_index=True, return_inverse=True)[1:]


def places(*tables: pa.Table) -> list[Places]:
    """Places of tables (id, x, y, group) under common numbers."""
    both = pa.concat_tables([t.select(["id", "group"]) for t in tables])
    ends = np.cumsum([len(t) for t in tables])[:-1]
    ids, groups = (np.split(codes([both[c]], len(both))[1], ends) for c in ("id", "group"))
    return [Places(t["x"].to_numpy(), t["y"].to_numpy(), i, g) for t, i, g in zip(tables, ids, groups)]


def _summed(by: list[str], weighted: list[str], plain: list[str], radius: float, across: bool, scale: float | None, product: Callable):
    """Sums of a task's other points for its sources and each group of ``by``; only groups with a link are kept."""
    def run(key: tuple, sources: pa.Table, others: pa.Table) -> pa.Table:
        firsts, node = codes([others[c] for c in ("id", "x", "y", "group")], len(others))
        groups, at = codes([others[f"__by{i}"] for i in range(len(by))], len(others))
        n, m = len(firsts), len(groups)

        def spread(columns: list[str]) -> np.ndarray:
            v = [np.bincount(node * m + at, others[c].to_numpy(), n * m).reshape(n, m) for c in columns]
            return np.stack(v, axis=1).reshape(n, len(columns) * m) if v else np.zeros((n, 0))
        a, b = places(sources, others.take(pa.array(firsts)))
        light, heavy = product(a, b, spread(plain), spread(weighted), radius, across, scale)
        light, heavy = light.reshape(len(a.x), len(plain), m), heavy.reshape(len(a.x), len(weighted), m)
        row, group = np.nonzero(light[:, 0, :] > 0.5)
        names = [f"__by{i}" for i in range(len(by))]
        out = {"id": sources["id"].take(pa.array(row)), **{c: others[c].take(pa.array(groups[group])) for c in names}}
        out |= {c: pa.array(light[row, k, group]) for k, c in enumerate(plain)} | {c: pa.array(heavy[row, k, group]) for k, c in enumerate(weighted)}
        return pa.table(out)
    return run


def _dealt(nodes: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sources and their possible neighbours with the keys of the tasks they meet in.

    A row of ``others`` goes to its tile and the eight around, once for each part of the sources there. Parts of sources are therefore large, down to an
    eighth of that where points have so many rows that a task's sums would grow with them, and crowded tiles get their tasks from the parts of ``others``.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))

    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("step", steps).withColumns({"tx": F.col("tx") + F.col("step.i"), "ty": F.col("ty") + F.col("step.j")}).drop("step")
    # one row a tile: into how many parts its sources and their possible neighbours are dealt
    tiles = nodes.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).join(others.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("rows")), ["tx", "ty"], "left")
    met = around(tiles).groupBy("tx", "ty").agg(F.sum("n").alias("__points"), F.sum("rows").alias("__rows")).where("__rows > 0")
    most = F.greatest(F.least(OTHERS * F.col("__points") / F.col("__rows"), F.lit(SOURCES)), F.lit(SOURCES / 8))
    parts = materialise(tiles.join(met, ["tx", "ty"]).select("tx", "ty", F.ceil(F.col("n") / most).cast("int").alias("__sources"), F.ceil(F.col("__rows") / OTHERS).cast("int").alias("__others")))
    keys = ["tx", "ty", "__s", "__o"]

    def dealt(df: DataFrame, mine: str, own: str, other: str, theirs: str) -> DataFrame:
        at = df.join(F.broadcast(parts), ["tx", "ty"])
        return (at.withColumn(mine, F.pmod(F.xxhash64("id", "x", "y"), F.col(own)).cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("__sources", "__others"))
    return dealt(nodes, "__s", "__sources", "__others", "__o"), dealt(around(others), "__o", "__others", "__sources", "__s"), keys


def neighbour_sums(graph: Proximity, values: DataFrame, entity: str, by: list[str], weighted: dict[str, Column], plain: dict[str, Column], product: Callable = near_sums) -> DataFrame:
    """(entity, by, sums, __links) over the neighbours' rows of ``values``: ``weighted`` times the links' weights, ``plain`` as they are, NULL as zero.

    Only entities and groups with a row of a neighbour are listed. Repeated points and rows count as often as they stand there.
    """
    if graph.kept or graph.times != 1:
        raise ValueError("sums take all links once")
    size, nodes = graph.radius, graph.nodes
    kinds = dict(values.dtypes)
    plain = {"__links": F.lit(1), **plain}
    cells = {"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)}
    nodes = materialise(nodes.withColumns(cells))
    figures = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in {**plain, **weighted}.items()]
    rows = values.select(F.col(entity).alias("id"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *figures)
    others = materialise(nodes.join(rows, "id"))
    left, right, keys = _dealt(nodes, others)
    kind = dict(nodes.dtypes)["id"]
    schema = ", ".join([f"id {kind}", *[f"__by{i} {kinds[c]}" for i, c in enumerate(by)], *[f"`{c}` double" for c in (*plain, *weighted)]])
    run = _summed(by, list(weighted), list(plain), graph.radius, graph.across, graph.scale, product)
    # a fixed number of partitions: few bytes make much work here, so they are not to be put together by their size
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.repartition(tasks, *keys).groupBy(*keys) for df in (left, right))
    sums = left.cogroup(right).applyInArrow(run, schema)
    total = sums.groupBy("id", *[f"__by{i}" for i in range(len(by))]).agg(*[F.sum(c).alias(c) for c in (*plain, *weighted)])
    return total.select(F.col("id").alias(entity), *[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)], *plain, *weighted)


def places_differ(graph: Proximity) -> bool:
    """Whether an id stands at several places or in several groups."""
    return bool(graph.nodes.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") > 1).alias("several")).first()["several"])


def _apart(dx: Column, dy: Column, size: float) -> Column:
    """The least distance of two tiles so many tiles apart."""
    return F.hypot(F.greatest(F.abs(dx) - 1, F.lit(0)), F.greatest(F.abs(dy) - 1, F.lit(0))) * size


def _tiled(graph: Proximity) -> tuple[DataFrame, float]:
    """Distinct points with their number of rows and their tile, and the size of the tiles, by which a tile has some hundred points or more."""
    nodes = graph.nodes.groupBy("id", "x", "y", "group").agg(F.count(F.lit(1)).alias("copies"))
    seen = nodes.groupBy(F.floor(F.col("x") / graph.radius), F.floor(F.col("y") / graph.radius)).agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("n")).first()["n"]
    size = graph.radius * 2.0 ** float(np.clip(np.floor(np.log2(LISTED / (seen or 1.0)) / 2), -2, 6))
    stored = materialise(nodes.withColumns({"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)}))
    return stored.repartition(DEALERS, "id", "x", "y"), size


def _meeting_tiles(nodes: DataFrame, size: float, reach: float) -> DataFrame:
    """(tx, ty, ox, oy, __sources, __others): tiles with points that may be within ``reach``, and the parts that the points of each are dealt to."""
    parts = nodes.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("int").alias("n"))
    other = _around_tiles(parts.select("tx", "ty", F.col("n").alias("__sources")), size, reach, "ox", "oy")
    return materialise(other.join(parts.select(F.col("tx").alias("ox"), F.col("ty").alias("oy"), F.col("n").alias("__others")), ["ox", "oy"]))


def _around_tiles(tiles: DataFrame, size: float, reach: float, x: str, y: str) -> DataFrame:
    """Each tile with every tile that comes within ``reach`` of it."""
    far = int(reach / size * (1 + 1e-9)) + 1
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-far, far + 1) for j in range(-far, far + 1)])
    out = tiles.withColumn("step", F.explode(steps)).where(_apart(F.col("step.i"), F.col("step.j"), size) <= reach * (1 + 1e-9))
    return out.withColumns({x: F.col("tx") + F.col("step.i"), y: F.col("ty") + F.col("step.j")}).drop("step")


def _listed_where_met(nodes: DataFrame, tiles: DataFrame, middles: DataFrame | None, run: Callable, own: list[str] = [], more: str = "") -> DataFrame:
    """Rows that ``run`` makes of a part of the points of one tile and a part of those of another, with ``middles`` (of both tiles) beside the latter.

    The former have their columns ``own`` too, and the rows the columns ``more`` after those of every list.
    """
    keys, point = ["tx", "ty", "ox", "oy", "__s", "__o"], ["id", "x", "y", "group", "copies"]

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("id", "x", "y"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = nodes.join(tiles, ["tx", "ty"]).withColumn("__s", part("__sources")).withColumn("__o", every("__others")).select(*keys, *point, *own)
    ends = nodes.withColumnsRenamed({"tx": "ox", "ty": "oy"}).join(tiles, ["ox", "oy"])
    right = ends.withColumn("__o", part("__others")).withColumn("__s", every("__sources")).select(*keys, *point, F.lit(False).alias("middle"))
    if middles is not None:
        right = right.unionByName(middles.withColumn("__s", every("__sources")).withColumn("__o", every("__others")).select(*keys, *point, F.lit(True).alias("middle")))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # its own columns, though both sides come from one table
    # few rows make many: a task for each meeting, as far as that goes
    n = min(max(int(tiles.agg(F.sum(F.col("__sources") * F.col("__others"))).first()[0] or 1), 1), 1024)
    kind = dict(nodes.dtypes)["id"]
    met = left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys))
    return met.applyInArrow(run, f"src {kind}, dst {kind}, copies long{more}")


def _rows_of(found: np.ndarray, sources: pa.Table, others: pa.Table) -> pa.Table:
    row, col = np.nonzero(found)
    copies = sources["copies"].to_numpy()[row] * others["copies"].to_numpy()[col]
    return pa.table({"src": sources["id"].take(pa.array(row)), "dst": others["id"].take(pa.array(col)), "copies": pa.array(copies)})


def _indicator(a: Places, b: Places, radius: float, across: bool = False) -> np.ndarray:
    """``_near`` made in parts."""
    out = np.empty((len(a.x), len(b.x)), bool)
    step = max(1, ENTRIES // max(1, len(b.x)))
    for at in range(0, len(a.x), step):
        out[at:at + step] = _near(a.take(slice(at, at + step)), b, radius, across)[0]
    return out


def links(graph: Proximity) -> DataFrame:
    """The list (src, dst) of the links. Each is made in the task where its tiles meet."""
    radius, across = graph.radius, graph.across

    def run(key: tuple, sources: pa.Table, others: pa.Table) -> pa.Table:
        if not len(sources) or not len(others):
            return (sources if len(sources) else others).slice(0, 0).select(["id", "id", "copies"]).rename_columns(["src", "dst", "copies"])
        return _rows_of(_indicator(*places(sources, others), radius, across), sources, others)
    nodes, size = _tiled(graph)
    return _repeated(_listed_where_met(nodes, _meeting_tiles(nodes, size, radius), None, run), graph, nodes).select("src", "dst")


def _repeated(found: DataFrame, graph: Proximity, nodes: DataFrame) -> DataFrame:
    """The links that satisfy the condition of the list, as often as they stand in it."""
    if graph.times > 1 or (nodes.agg(F.max("copies")).first()[0] or 1) > 1:
        found = found.withColumn("copies", F.explode(F.array_repeat(F.lit(1), (F.col("copies") * graph.times).cast("int"))))
    return found.where(graph.kept) if graph.kept else found


def measured_links(graph: Proximity, totals: DataFrame | None = None) -> DataFrame:
    """The list (src, dst, distance, share) of the links; the share is the link's weight by its source's total (id, total), NULL without ``totals`` or where that is zero."""
    radius, across, scale = graph.radius, graph.across, graph.scale

    def run(key: tuple, sources: pa.Table, others: pa.Table) -> pa.Table:
        if not len(sources) or not len(others):
            nothing = (sources if len(sources) else others).slice(0, 0).select(["id", "id", "copies", "x", "y"])
            return nothing.rename_columns(["src", "dst", "copies", "distance", "share"])
        a, b = places(sources, others)
        total = sources["total"].to_numpy()
        total, out = np.where(total == 0, np.nan, total), []
        step = max(1, CHUNK // len(b.x))
        for at in range(0, len(a.x), step):
            found, squares = _near(a.take(slice(at, at + step)), b, radius, across)
            distance, links = np.sqrt(squares[found]), _rows_of(found, sources.slice(at, step), others)
            share = np.exp(-distance / scale) / np.repeat(total[at:at + step], found.sum(axis=1)) if scale else np.full(len(distance), np.nan)
            out.append(links.append_column("distance", pa.array(distance)).append_column("share", pa.array(share, from_pandas=True)))
        return pa.concat_tables(out)
    nodes, size = _tiled(graph)
    with_totals = nodes.withColumn("total", F.lit(None).cast("double")) if totals is None else nodes.join(totals, "id", "left")
    out = _listed_where_met(materialise(with_totals).repartition(DEALERS, "id", "x", "y"), _meeting_tiles(nodes, size, radius), None, run, ["total"], ", distance double, share double")
    return _repeated(out, graph, nodes).select("src", "dst", "distance", "share")


def second_reached(a: Places, middles: Places, b: Places, radius: float) -> np.ndarray:
    """Which of ``b`` are linked to each of ``a`` by one of ``middles`` and not directly.

    A few middles of every small cell decide most pairs; for the rest, sources of a small cell are taken together with the middles that reach any of their pairs.
    """
    found = np.zeros((len(a.x), len(b.x)), bool)
    todo = ~_indicator(a, b, radius) & _indicator(a, b, 2 * radius * (1 + 1e-9))
    cell = np.unique(np.stack([np.floor(v / (radius / 16)) for v in (middles.x, middles.y)]), axis=1, return_index=True)[1]
    some = middles.take(cell)
    for at in range(0, len(cell), MIDDLES):
        m = some.take(slice(at, at + MIDDLES))
        found |= _indicator(a, m, radius).astype(np.float32) @ _indicator(m, b, radius).astype(np.float32) > 0.5
    found &= todo
    todo &= ~found
    mine = np.unique(np.stack([np.floor(v / (radius / 8)) for v in (a.x, a.y)]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(mine, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(mine[order])) + 1)
    for at in range(0, len(middles.x), MIDDLES):
        rows, cols = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
        if not len(rows):
            break
        m = middles.take(slice(at, at + MIDDLES))
        # only middles that reach both sides
        boxes = [np.hypot(np.maximum(np.maximum(s.x.min() - m.x, m.x - s.x.max()), 0), np.maximum(np.maximum(s.y.min() - m.y, m.y - s.y.max()), 0)) for s in (a.take(rows), b.take(cols))]
        m = m.take(np.flatnonzero((boxes[0] <= radius * (1 + 1e-9)) & (boxes[1] <= radius * (1 + 1e-9))))
        first, second = _indicator(a, m, radius), _indicator(m, b, radius)
        for g in groups:
            open_cols = np.flatnonzero(todo[g].any(axis=0))
            use = np.flatnonzero(first[g].any(axis=0)) if len(open_cols) else open_cols
            if not len(use):
                continue
            ahead = second[np.ix_(use, open_cols)]
            use, ahead = use[ahead.any(axis=1)], ahead[ahead.any(axis=1)]
            hit = first[np.ix_(g, use)].astype(np.float32) @ ahead.astype(np.float32) > 0.5
            at_both = np.ix_(g, open_cols)
            hit &= todo[at_both]
            found[at_both] |= hit
            todo[at_both] &= ~hit
    return found


def second_links(graph: Proximity) -> DataFrame:
    """(src, dst) once for each two points that are not linked but have a neighbour in common. No id stands at several places (``places_differ``)."""
    radius = graph.radius

    def run(key: tuple, sources: pa.Table, others: pa.Table) -> pa.Table:
        ends = others.filter(pc.invert(others["middle"])) if len(others) else others
        if not len(sources) or not len(ends):
            return (sources if len(sources) else others).slice(0, 0).select(["id", "id", "copies"]).rename_columns(["src", "dst", "copies"])
        a, b, middles = places(sources, ends, others.filter(others["middle"]))
        return _rows_of(second_reached(a, middles, b, radius) & (a.id[:, None] != b.id), sources, ends)
    nodes, size = _tiled(graph.distinct())
    tiles = _meeting_tiles(nodes, size, 2 * radius)
    between = _around_tiles(tiles, size, radius, "mx", "my").where(_apart(F.col("mx") - F.col("ox"), F.col("my") - F.col("oy"), size) <= radius * (1 + 1e-9))
    middles = nodes.withColumnsRenamed({"tx": "mx", "ty": "my"}).join(between, ["mx", "my"])
    return _listed_where_met(nodes, tiles, middles, run).select("src", "dst")
