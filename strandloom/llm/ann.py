"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. Vectors are dealt to blocks, and each
block posts its vectors in one inverted file a pivot, with the pivot's place in the vector's order.
A query adds up, over the files of its own nearest pivots, what each posting takes off the footrule
distance of the two orders; the vectors of the least distance are measured exactly, and the blocks'
best are merged. Which share of a block is measured follows from pilot vectors whose true neighbours
are known, so that the recall asked for holds at any size. Pivots are a bounded sample by hash;
every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, materialize, tune_batches

#: Pivots at most, and pivots in an order.
PIVOTS, ORDER = 2048, 64
#: Share of true neighbours that the pilots must find, pilots, and vectors of a block measured at least.
RECALL, PILOTS, LEAST = 0.97, 64, 64
#: Vectors of a block and queries that meet it together, about; both are expectations, not caps.
BLOCK, QUERIES = 16384, 4096


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _orders(rows: DataFrame, pivots: np.ndarray, order: int) -> DataFrame:
    """rows with v as packed 32-bit floats and their nearest pivots in order, as packed bytes of 16 bits."""
    names = [c for c in rows.columns if c != "v"]
    square = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, pivots.shape[1]))
            near = np.argsort(square[None] - 2 * x @ pivots.T, axis=1, kind="stable")[:, :order].astype("<u2")
            raw = x.astype("<f8")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([r.tobytes() for r in near], pa.binary())], names=[*names, "v", "near"])

    kinds = dict(rows.dtypes)
    return rows.select(*names, "v").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", v binary, near binary")


class _Block:
    """Inverted files of some vectors' orders."""

    def __init__(self, near: list[bytes], raw: list[bytes], pivots: int) -> None:
        orders = np.frombuffer(b"".join(near), "<u2").reshape(len(near), -1)
        self.v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
        self.length = orders.shape[1]
        by_pivot = np.argsort(orders, axis=None, kind="stable")
        self.posted, self.place = np.divmod(by_pivot, self.length)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(orders.ravel(), minlength=pivots))))

    def closeness(self, near: bytes) -> np.ndarray:
        """What the pivots shared with a query's order take off the footrule distance, for each vector; absent pivots stand behind the last."""
        own = np.frombuffer(near, "<u2").astype(np.int64)
        first, size = self.start[own], self.start[own + 1] - self.start[own]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        gain = self.length - np.maximum(self.place[at], np.repeat(np.arange(len(own)), size))
        return np.bincount(self.posted[at], gain, minlength=len(self.v))

    def distance(self, raw: bytes, some) -> np.ndarray:
        return np.sqrt(((self.v[some] - np.frombuffer(raw, "<f8")) ** 2).sum(1))


def _share(index: DataFrame, pilots: list, k: int, pivots: int, recall: float) -> float:
    """Share of a block that has to be measured for the pilots to find `recall` of their k nearest others."""
    schema = pa.schema([("pilot", pa.int64()), ("cid", pa.int64()), ("d", pa.float64()), ("behind", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            block, cid = _Block(b.column("near").to_pylist(), b.column("v").to_pylist(), pivots), b.column("cid").to_numpy()
            for p in pilots:
                close, d = block.closeness(bytes(p.near)), block.distance(bytes(p.v), slice(None))
                best = np.argsort(np.where(cid == p.cid, np.inf, d), kind="stable")[:k]
                best = best[cid[best] != p.cid]
                rising = np.sort(close)
                behind = 1 - np.searchsorted(rising, close[best], "left") / len(close)
                yield batch(schema, [p.cid] * len(best), cid[best], d[best], behind)

    tune_batches(index.sparkSession, BLOCK)
    seen = index.select("cid", "v", "near").mapInArrow(run, "pilot long, cid long, d double, behind double")
    nearest_of = W.partitionBy("pilot").orderBy("d", "cid")
    found = [r.behind for r in seen.withColumn("r", F.row_number().over(nearest_of)).where(F.col("r") <= k).collect()]  # pilots * k rows
    return float(np.quantile(found, recall)) if found else 1.0


def nearest(
    vectors: DataFrame, queries: Column, *, k: int = 10, pivots: int = PIVOTS, order: int = ORDER, recall: float = RECALL, least: int = LEAST, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors that satisfies queries.

    vectors needs vec_id and embedding; others are ignored. score is the Euclidean distance in double
    precision, ties go to the smaller id, and rows with the query's own id are no candidates. Rows
    without an id, with an unusable vector, or of another length than most take no part. Equal vectors
    are indexed once, with the k + 1 smallest ids, which are all that an answer can hold of them. An id
    with several vectors asks with each and stands where the nearest of them does.
    """
    spark = vectors.sparkSession
    tune_batches(spark, 2048)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes.d)
    first = W.partitionBy("v").orderBy("vec_id")
    held = rows.select("vec_id", "v").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = held.groupBy("v").agg(F.min("vec_id").alias("cid"), F.array_distinct(F.sort_array(F.collect_list("vec_id"))).alias("ids"))
    classes = materialize(classes, "vectors")
    chosen = np.array([r.v for r in classes.orderBy(F.xxhash64("cid"), "cid").limit(pivots).collect()])
    order, n_pivots = min(order, len(chosen)), len(chosen)

    index = materialize(_orders(classes.select("cid", "ids", "v"), chosen, order), "orders")
    asked = materialize(_orders(rows.where("asks").select(F.col("vec_id").alias("query_id"), "v"), chosen, order), "queries")
    pilots = index.orderBy(F.xxhash64("cid", F.lit(1)), "cid").select("cid", "v", "near").limit(PILOTS).collect()
    share = _share(index, pilots, k, n_pivots, recall)
    blocks, readers = max(1, -(-index.count() // block)), max(1, -(-asked.count() // QUERIES))

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = index.withColumn("i", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int")).withColumn("j", spread(readers))
    right = asked.withColumn("j", F.pmod(F.xxhash64("query_id", "v"), F.lit(readers)).cast("int")).withColumn("i", spread(blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(posts: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if posts.num_rows and asks.num_rows:
            held, ids = _Block(posts["near"].to_pylist(), posts["v"].to_pylist(), n_pivots), posts["ids"].to_pylist()
            n = len(ids)
            best = min(n, max(least, int(np.ceil(share * n))))
            for query, raw, own in zip(asks["query_id"].to_pylist(), asks["v"].to_pylist(), asks["near"].to_pylist()):
                close = held.closeness(own)
                some = np.flatnonzero(close >= np.partition(close, n - best)[n - best])  # ties of the last are measured too
                d = held.distance(raw, some)
                edge = np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)]  # the query's own class may be one of k + 1
                found = sorted((float(x), i) for x, c in zip(d[d <= edge], some[d <= edge]) for i in ids[c] if i != query)
                out += [(query, i, x) for x, i in found[:k]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = W.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
