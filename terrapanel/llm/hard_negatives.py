"""Hard-negative mining by threshold joins over an inverted index with norm bounds (in the manner of L2AP).

Rows are cut into blocks; each block is an inverted index over dimensions, taken in the order of their weight in the block. A row posts
its leading dimensions only: those from which on its suffix norm, times the largest norm of an anchor, cannot reach the lowest threshold are left out and
kept for verification. Anchors accumulate partial scores dimension by dimension; after each few dimensions a pair goes whose partial score plus
the product of the norms that remain stays under the anchor's threshold. Survivors get the exact score.

Two searches follow one another, each in rounds. An anchor's positives are its best rows of its label; its threshold falls from round to
round until so many are found. A positive's negatives are the best rows of other labels inside a window given by the positive's score;
thresholds fall from the top of the window until it is filled or ends. Anchors that are done take no part in later rounds, and a
last round without threshold ends every search, so results are exact. Blocks return no more than a window needs, whatever the number of ties.

The anchors are a stated set of queries: groups of them meet blocks of rows, and no pair of rows is ever emitted by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.session import materialise

#: Rows of a block, and anchors of a group, at most about; anchors that a block takes at once.
BLOCK_ROWS, GROUP_ANCHORS, TILE = 8192, 16384, 64
#: Dimensions between two prunings.
STEP = 16
#: Thresholds of the rounds: shares of the largest possible score, and of the positive's score.
POSITIVE_ROUNDS, NEGATIVE_ROUNDS = (0.5, 0.35, 0.2), (0.8, 0.6)
#: Products below this are exact in doubles; larger ones are taken as whole numbers of any size.
EXACT = float(1 << 53)
SLACK = 1 - 1e-9

HITS = "anchor long, slot int, row long, key long, score long"


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 * x) of every component, shorter vectors filled with zeros."""
    out, sizes = np.zeros((len(vectors), width)), pc.list_value_length(vectors).to_numpy()
    out[np.arange(width) < sizes[:, None]] = pc.list_flatten(vectors).to_numpy()
    return np.floor(256.0 * out)


def _whole(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in v] for v in values], dtype=object).reshape(values.shape)


class Index:
    """Inverted index of a block: dimension d posts the first ``posted[d]`` rows, as rows are sorted by the number of dimensions they post."""

    def __init__(self, vectors: np.ndarray, largest: float, least: float):
        order = np.argsort(-(vectors ** 2).sum(axis=0), kind="stable")
        y = vectors[:, order]
        suffix = np.sqrt(np.cumsum((y ** 2)[:, ::-1], axis=1))[:, ::-1]
        kept = (suffix * largest >= least * SLACK).sum(axis=1) if least > 0 else np.full(len(y), y.shape[1])
        self.rows = np.argsort(-kept, kind="stable")
        self.dims, self.y = order, y[self.rows]
        self.rest = np.hstack([suffix[self.rows], np.zeros((len(y), 1))])
        self.posted = (kept[self.rows][:, None] > np.arange(y.shape[1])).sum(axis=0)
        self.kept = kept[self.rows]

    def search(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs that reach the anchor's threshold."""
        a = anchors[:, self.dims]
        rest = np.sqrt(np.cumsum((a ** 2)[:, ::-1], axis=1))[:, ::-1]
        rest, width = np.hstack([rest, np.zeros((len(a), 1))]), self.y.shape[1]
        n = int(self.posted[0]) if width else len(self.y)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        part, need = np.zeros((len(a), n)), thresholds[:, None] * np.where(thresholds > 0, SLACK, 1 / SLACK)[:, None]
        left, d = None, 0
        while d < width and left is None:
            stop = min(d + STEP, width)
            for lo, hi in self._runs(d, stop):
                c = int(self.posted[lo])
                part[:, :c] += a[:, lo:hi] @ self.y[:c, lo:hi].T
            d = stop
            # a row that posted fewer dimensions still has its own suffix to come
            at = np.minimum(self.kept[:n], d)
            live = part + rest[:, at] * self.rest[np.arange(n), at] >= need
            if live.mean() < 0.125 or d == width:
                left = np.nonzero(live)
        i, k = left if left is not None else np.nonzero(np.ones_like(part, dtype=bool))
        score, done = part[i, k], np.minimum(self.kept[k], d)
        while d < width and len(i):
            stop = min(d + STEP, width)
            use = (np.arange(d, stop) < self.kept[k][:, None])
            score = score + np.einsum("pd,pd,pd->p", a[i, d:stop], self.y[k, d:stop], use)
            done, d = np.minimum(self.kept[k], stop), stop
            live = score + rest[i, done] * self.rest[k, done] >= need[i, 0]
            i, k, score, done = i[live], k[live], score[live], done[live]
        # verification: the dimensions that the index left out
        short = np.nonzero(done < width)[0]
        for s in np.array_split(short, len(short) * width // (1 << 22) + 1):
            out = np.arange(width) >= done[s][:, None]
            score[s] += np.einsum("pd,pd,pd->p", a[i[s]], self.y[k[s]], out)
        live = score >= thresholds[i]
        return i[live], self.rows[k[live]], score[live]

    def _runs(self, start: int, stop: int) -> Iterator[tuple[int, int]]:
        """Stretches of dimensions that post the same rows."""
        lo = start
        for d in range(start + 1, stop + 1):
            if d == stop or self.posted[d] != self.posted[lo]:
                yield lo, d
                lo = d


def _pairs(y: np.ndarray, a: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    largest = float(np.sqrt((a ** 2).sum(axis=1)).max())
    if largest * float(np.sqrt((y ** 2).sum(axis=1)).max()) < EXACT:
        index = Index(y, largest, float(thresholds.min()))
        for s in range(0, len(a), TILE):
            i, k, score = index.search(a[s:s + TILE], thresholds[s:s + TILE])
            yield i + s, k, score.astype(np.int64)
        return
    y, a = _whole(y), _whole(a)
    for i in range(len(a)):
        score = (y * a[i]).sum(axis=1)
        k = np.nonzero(score >= thresholds[i])[0]
        yield np.full(len(k), i), k, np.array([max(-1 << 63, min(int(x), (1 << 63) - 1)) for x in score[k]], dtype=np.int64)


def _joined(columns: list[str], work):
    """A cogroup of one block of rows and one group of anchors, as arrays; ``work`` gives (anchor, slot, place of the row, score)."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        info = {c: rows[c].to_numpy() for c in ("row", "label")} | {"missing": rows["key"].is_null().to_numpy(), "key": rows["key"].fill_null(0).to_numpy()}
        if rows.num_rows and anchors.num_rows:
            width = max(int(pc.max(pc.list_value_length(t["vector"])).as_py()) for t in (rows, anchors))
            mine = {c: anchors[c].to_pandas() if c in ("best", "scores") else anchors[c].to_numpy() for c in columns}
            found += work(_matrix(rows["vector"], width), _matrix(anchors["vector"], width), info, mine)
        anchor, slot, at, score = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        return pa.table({"anchor": anchor, "slot": slot.astype(np.int32), "row": info["row"][at], "key": pa.array(info["key"][at], mask=info["missing"][at]), "score": score})
    return run


def _sorted(rows: dict, i: np.ndarray, k: np.ndarray, score: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept pairs by anchor, highest score first, ties by smaller id, a missing id last."""
    i, k, score = i[kept], k[kept], score[kept]
    o = np.lexsort((rows["row"][k], rows["key"][k], rows["missing"][k], -score, i))
    return i[o], k[o], score[o]


def _search_positives(wanted: int):
    def work(y, a, rows, anchors):
        for i, k, score in _pairs(y, a, anchors["threshold"].astype(float)):
            i, k, score = _sorted(rows, i, k, score, (rows["label"][k] == anchors["label"][i]) & (rows["row"][k] != anchors["anchor"][i]))
            first = np.arange(len(i)) - np.searchsorted(i, i) < wanted
            yield anchors["anchor"][i[first]], np.zeros(first.sum()), k[first], score[first]
    return work


def _search_negatives(wanted: int, low: int, high: int):
    def work(y, a, rows, anchors):
        for i, k, score in _pairs(y, a, anchors["threshold"].astype(float)):
            i, k, score = _sorted(rows, i, k, score, rows["label"][k] != anchors["label"][i])
            for x in np.unique(i):
                lo, hi = np.searchsorted(i, [x, x + 1])
                falling = -score[lo:hi]
                for slot, best in zip(anchors["best"].iloc[x], anchors["scores"].iloc[x]):
                    # in whole numbers: 100 s <= high p and 100 s >= low p
                    start = lo + np.searchsorted(falling, -(high * int(best) // 100))
                    stop = min(lo + np.searchsorted(falling, -(-(-low * int(best) // 100)), side="right"), start + wanted)
                    if start < stop:
                        yield np.full(stop - start, anchors["anchor"][x]), np.full(stop - start, slot), k[start:stop], score[start:stop]
    return work


def _best(hits: DataFrame, by: list[str], wanted: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _round(rows: DataFrame, anchors: DataFrame, blocks: int, columns: list[str], work) -> DataFrame:
    """Hits of the open anchors in every block of rows."""
    groups = -(-anchors.count() // GROUP_ANCHORS)
    left = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = (anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    keys = ["block", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_joined(columns, work), HITS)


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only, also after scaling."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256.0) < F.lit(float("inf"))))


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row where ``anchors`` holds.

    A score is the inner product of the vectors floor(256 * x). Positives are the ``positives`` best other rows of the anchor's label; for each
    the first ``negatives`` rows of other labels follow with low % <= negative / positive <= high %, in whole numbers. Higher scores
    come first, ties by smaller id. Rows with a null label, a null vector or a component that is null or not finite take no
    part. Rows with one id are rows of their own, a null id comes last in ties (and is no anchor where ``anchors`` is null). A shorter
    vector counts as filled up with zeros. Scores beyond 64 bits stand at the limit. An empty table, or none of another label, gives no rows;
    other columns are ignored.
    """
    found = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"),
                           F.coalesce(anchors, F.lit(False)).alias("asks")).where(F.col("label").isNotNull() & finite(F.col("vector")))
    rows = materialise(found.withColumn("row", F.monotonically_increasing_id()))
    n, parallel = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // block_rows), min(parallel, n // 1024))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256.0), F.lit(2.0))))
    longest = rows.agg(F.max(norm)).first()[0] or 0.0
    asked = materialise(rows.where("asks").select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"), "label", "vector", (norm * longest).alias("most")))
    rows = rows.select("row", "key", "label", "vector", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    none = F.lit(float("-inf"))

    best, open_ = None, asked
    for share in (*POSITIVE_ROUNDS, None):
        if open_.isEmpty():
            break
        limit = none if share is None else F.col("most") * share
        hits = _round(rows, open_.select("anchor", "label", "vector", limit.alias("threshold")), blocks, ["anchor", "label", "threshold"], _search_positives(positives))
        top = materialise(_best(hits, ["anchor"], positives))
        full = top.groupBy("anchor").count().where(F.col("count") >= (1 if share is None else positives)).select("anchor")
        done = top.join(full, "anchor")
        best = done if best is None else best.unionByName(done)
        open_ = materialise(open_.join(full, "anchor", "left_anti"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if best is None:
        return rows.sparkSession.createDataFrame([], schema)
    best = materialise(best.select("anchor", F.col("rank").alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")))

    answers, open_ = None, best.where("positive_score >= 0")
    for share in (*NEGATIVE_ROUNDS, None):
        if open_.isEmpty():
            break
        # in the last round the window itself ends the search
        limit = F.floor(F.col("positive_score") * ((low / 100 if share is None else share) * SLACK)) - 1
        waiting = open_.groupBy("anchor").agg(F.min(limit).cast("double").alias("threshold"), F.collect_list(F.struct("slot", "positive_score")).alias("p"))
        waiting = materialise(waiting.join(asked.select("anchor", "label", "vector"), "anchor").select(
            "anchor", "label", "vector", "threshold", F.col("p.slot").alias("best"), F.col("p.positive_score").alias("scores")))
        hits = _round(rows, waiting, blocks, ["anchor", "label", "threshold", "best", "scores"], _search_negatives(negatives, low, high))
        keys = ["anchor", "slot"]
        top = materialise(_best(hits, keys, negatives))
        full = top.groupBy(*keys).count().where(F.col("count") >= (1 if share is None else negatives)).select(*keys)
        done = top.join(full, keys)
        answers = done if answers is None else answers.unionByName(done)
        open_ = materialise(open_.join(full, keys, "left_anti"))
    if answers is None:
        return rows.sparkSession.createDataFrame([], schema)
    out = answers.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
    return (out.join(best, ["anchor", "slot"]).join(asked.select("anchor", "anchor_id"), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
