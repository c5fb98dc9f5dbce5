"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. It is posted in the inverted file of each of its first
``posted`` pivots, with its place there. A query collects the files of its own pivots and ranks vectors by the footrule
distance between the two orders, a pivot not among the first ``posted`` counting as at place ``posted``; the closest
``share`` of them, and all that tie with the last of these, are compared by exact inner product.

Equal vectors are one class, indexed once with the smallest of its ids, as many as an answer can hold. So copies take no other
vector's place among the compared, and none of them is cut before the order by id.

Inner products are made angular by one more component, which gives every row the length of the longest row (it is zero for
queries). Pivots come from a bounded sample of rows by hash. The index is cut into blocks of about ``block`` rows by
hash and the queries into blocks too; every pair of blocks is one task's group, of bounded size. A block holds its part of every
pivot's file, as one row of weights (posted - place) for each pivot, so a hot pivot spreads over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _usable(vector: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """(vec_id, v, ids): each distinct vector with its ``most`` smallest ids in order, and the first of them as its name."""
    # The limit on row numbers also holds before the shuffle, so copies of one vector do not meet in one task.
    own = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    first = rows.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "v", "ids")


def choose_pivots(vectors: DataFrame, length: float, pivots: int) -> np.ndarray:
    """Unit pivots, spread out, from a sample of at most four times as many rows, the first by a hash of key and vector."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(4 * pivots).collect()
    x = _lifted(np.array([r[0] for r in rows], dtype=np.float64), length)
    chosen, far = [0], 1 - x @ x[0]
    while len(chosen) < min(pivots, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    return x[chosen]


def _lifted(x: np.ndarray, length: float) -> np.ndarray:
    """Rows over ``length``, with the component that makes them unit vectors."""
    x = x / length
    rest = 1 - np.einsum("ij,ij->i", x, x)
    return np.column_stack([x, np.sqrt(np.maximum(rest, 0))])


def posting_weights(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """For each row and pivot ``posted`` less the pivot's place in the row's order; 0 if it is not among the first ones."""
    near = x @ pivots.T
    order = np.argsort(-near, axis=1, kind="stable")[:, :posted]
    out = np.zeros(near.shape, dtype=np.uint8)
    np.put_along_axis(out, order, np.arange(posted, posted - order.shape[1], -1, dtype=np.uint8)[None], axis=1)
    return out


def _search(pivots: np.ndarray, posted: int, share: float, least: int, k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and queries.num_rows:
            lists = index.column("ids").combine_chunks()
            members, starts = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            ids, x = members[starts[:-1]], _matrix(index.column("v")).astype(np.float64)
            names, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("v")).astype(np.float64)
            files = np.ascontiguousarray(_matrix(index.column("posting")).T).view(np.uint8)
            plain = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
            asked = posting_weights(plain, pivots, posted)
            take = min(len(ids), max(least, k + 1, int(np.ceil(share * len(ids)))))
            for name, vector, weight in zip(names, q, asked):
                mine = np.flatnonzero(weight)
                # The footrule of two such orders is a constant less twice what they share: the smaller weight at each pivot.
                likeness = np.minimum(files[mine], weight[mine][:, None]).sum(axis=0, dtype=np.uint32)
                near = np.flatnonzero(likeness >= np.partition(likeness, len(ids) - take)[len(ids) - take])
                score = (x[near] * vector).sum(axis=1)
                # One class more than asked for: the query's own may hold nothing else.
                best = np.lexsort([ids[near], -score])[:k + 1]
                near, score = near[best], score[best]
                hits = np.concatenate([members[starts[i]:starts[i + 1]] for i in near])
                score = np.repeat(score, starts[near + 1] - starts[near])[hits != name]
                hits = hits[hits != name]
                best = np.lexsort([hits, -score])[:k]
                found.append((np.full(len(best), name), hits[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = 128, posted: int = 96,
            share: float = 0.75, least: int = 0, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row where ``is_query`` (a condition on the key) holds.

    Largest inner product in double precision, ties to the smaller key; all candidates if fewer than k. Every row but the
    query's own is a candidate. Rows with a null key, and vectors that are null, empty, zero or hold null or non-finite
    components take no part; nor do those of another length than most have. A key that repeats counts once, with its
    smallest vector. ``share`` of the distinct vectors of each block is compared exactly, whatever the size of the table, and at least
    ``least`` and as many as an answer can hold. No rows in, no rows out; other columns are not read.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable("v"))
    usual = given.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("length"))
    most = usual.orderBy(F.desc("n"), "dims").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not most:
        return spark.createDataFrame([], result)
    dims, rows, length = most[0]
    given = given.where(F.size("v") == dims).groupBy("vec_id").agg(F.min("v").alias("v"))
    classes = _classes(given, k + 1)
    chosen = choose_pivots(classes, length, pivots)

    def posting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = posting_weights(_lifted(_matrix(batch.column(1)), length), chosen, posted).view(np.int8)
            flat = pa.array(weights.ravel(), pa.int8())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(chosen)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["vec_id", "v", "ids", "posting"])

    index = classes.mapInArrow(posting, "vec_id long, v array<double>, ids array<long>, posting array<byte>")
    parts, asked = -(-rows // block), given.where(is_query)
    query_parts = max(1, -(-asked.count() // query_block))
    cell = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(parts)).cast("int")
    query_cell = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(query_parts)).cast("int")
    left = index.withColumn("part", cell).withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    right = asked.withColumn("query_part", query_cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = left.groupBy("part", "query_part").cogroup(right.groupBy("part", "query_part")).applyInArrow(_search(chosen, posted, share, least, k), FOUND)
    # At most k rows of each block meet for a query: the built-in ordered aggregate keeps them together.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")
