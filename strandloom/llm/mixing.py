"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents in a seeded permuted order. A target asks for a number
of blocks of each source, whole passes first; these exact quotas are split down a binary tree over
the output shards, each node drawing its left child's share without replacement. A shard so owns
disjoint stretches of each source's permuted blocks, and shuffles its documents locally.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, batch, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a block and blocks of a shard, about; both are expectations, not caps.
BLOCK_DOCS, SHARD_BLOCKS = 256, 64
#: Blocks in all, at most, as numpy's draws go up to 1e9: blocks of larger corpora hold more documents.
BLOCKS = 400_000_000
#: Sources whose facts are broadcast, at most; more are joined by a shuffle.
BROADCAST = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess shared out again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] >= most * sizes[i]}
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free -= full
    return out


def split_quotas(quotas: Sequence[int], shard: int, shards: int, seed: int) -> tuple[list[int], list[int]]:
    """(first draw, number of draws) of a shard for each source, by walking down the splitting tree.

    Every shard walks the same nodes with the same seeds, so the shards' draws are disjoint and
    exhaust the quotas without any shard knowing another.
    """
    left, size, have = 0, shards, np.array(quotas, np.int64)
    before = np.zeros(len(have), np.int64)
    while size > 1:
        half = size // 2
        draw = np.random.default_rng([seed, left, size]).multivariate_hypergeometric(have, int(have.sum()) * half // size, method="marginals")
        if shard < left + half:
            have, size = draw, half
        else:
            before, have = before + draw, have - draw
            left, size = left + half, size - half
    return before.tolist(), have.tolist()


def _mix(*columns: Column | str, seed: int) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


#: Orders that fill() tries besides the one by falling size.
TRIES = 64


def fill(rows: Sequence[tuple[int, int]], room: int) -> list[int]:
    """How many of each (size, copies) to take so that the sum ends near room.

    Each order takes all that still fit, and one more if that ends nearer; the first nearest of some
    beginnings of the given order, and of falling sizes, is kept.
    """

    def take(order: Sequence[int]) -> tuple[int, list[int]]:
        out, left = [0] * len(rows), room
        for i in order:
            size, copies = rows[i]
            out[i] = min(copies, left // size) if size else copies
            left -= out[i] * size
        rest = [i for i in order if out[i] < rows[i][1]]
        if rest and rows[i := min(rest, key=lambda x: rows[x][0])][0] < 2 * left:
            out[i] += 1
            left -= rows[i][0]
        return abs(left), out

    n = len(rows)
    falling = sorted(range(n), key=lambda i: -rows[i][0])
    orders = [[*range(a, n), *range(a)] for a in range(0, n, max(1, n // TRIES))]
    return min((take(o) for o in [*orders, falling]), key=lambda x: x[0])[1] if n else []


def _edge_takes(edge: DataFrame) -> DataFrame:
    """(sid, room, key, size) of the documents of each source's edge block -> (sid, key, size, takes); equal ones are one row with their number.

    A group is one block of a source, about BLOCK_DOCS distinct documents.
    """
    schema = pa.schema([("sid", pa.int32()), ("key", pa.int64()), ("size", pa.int64()), ("takes", pa.int64())])

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("size", "ascending")])
        size, copies = t["size"].to_pylist(), t["n"].to_pylist()
        takes = fill(list(zip(size, copies)), t["room"][0].as_py()) if t.num_rows else []
        return pa.Table.from_arrays([t["sid"], t["key"], t["size"], pa.chunked_array([pa.array(takes, pa.int64())])], schema=schema)

    counted = edge.groupBy("sid", "room", "key", "size").agg(F.count("*").alias("n"))
    return counted.groupBy("sid").applyInArrow(choose, "sid int, key long, size long, takes long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents with their places in the mix.

    docs needs doc_id, text and source; of its other columns those in keep stay. Returns one row per document:
    doc_id, source, size (words), source_size, target, and draws, an array of (shard, place) with one
    entry for each time the document is taken, always whole. A source's taken words come as near its
    target as the documents of one of its blocks can fill what is left. Sources are ranked by code point,
    null last, and get the weights in turn. The driver holds one row per source. Null texts have size 0;
    equal rows are in one block, and as many of them are taken as the mix asks for. No document is taken
    more than `most` times, rounded up. options: weights, share, most, seed and keep, as for _mixed().
    """
    return _mixed(docs, **options)[0]


def _mixed(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, keep: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """mix(), and the number of shards."""
    order_of = F.struct(F.col("source").isNull().alias("no"), "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), _mix("doc_id", "text", seed=seed).alias("key"), *keep)
    sized = materialize(full.drop(*keep), "sizes")
    found = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).orderBy(order_of).collect()
    goal = targets([r.words for r in found], [weights[i % len(weights)] for i in range(len(found))], share * sum(r.words for r in found), most)
    block_docs = max(BLOCK_DOCS, int(most + 1) * sum(r.n for r in found) // BLOCKS)
    facts = docs.sparkSession.createDataFrame(
        [(i, r.source, r.words, t, max(1, -(-r.n // block_docs)), int(t // r.words) if r.words else 0, int(t - t // r.words * r.words) if r.words else 0) for i, (r, t) in enumerate(zip(found, goal))],
        "sid int, source string, source_size long, target double, blocks long, passes long, rest long",
    )
    facts = F.broadcast(facts) if len(found) <= BROADCAST else facts
    full = full if keep else sized
    rows = full.join(facts, full.source.eqNullSafe(facts.source)).drop(facts.source).withColumn("block", F.pmod("key", "blocks"))

    # blocks in permuted order with the words before each: sums inside bands of the order, and of whole bands before
    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    blocks = materialize(blocks.withColumn("h", _mix("sid", "block", seed=seed + 1)).withColumn("band", F.shiftright("h", 54)), "blocks")
    band, source = W.partitionBy("sid").orderBy("band"), W.partitionBy("sid")  # a source has 1024 bands at most
    bands = blocks.groupBy("sid", "band").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    bands = bands.select("sid", "band", (F.sum("n").over(band) - F.col("n")).alias("n0"), (F.sum("w").over(band) - F.col("w")).alias("w0"), F.sum("n").over(source).alias("filled"))
    inside = W.partitionBy("sid", "band").orderBy("h", "block")
    blocks = blocks.join(bands, ["sid", "band"])
    blocks = blocks.select("sid", "block", "words", "rest", "passes", "filled", (F.row_number().over(inside) - 1 + F.col("n0")).alias("turn"), (F.sum("words").over(inside) - F.col("words") + F.col("w0")).alias("before"))
    blocks = materialize(blocks, "ordered-blocks")
    use = blocks.groupBy("sid").agg(F.max("filled").alias("filled"), (F.max("passes") * F.max("filled") + F.sum((F.col("before") < F.col("rest")).cast("long"))).alias("quota")).orderBy("sid").collect()
    quotas, filled = [0] * len(found), [1] * len(found)
    for r in use:
        quotas[r.sid], filled[r.sid] = r.quota, r.filled
    shards = max(1, sum(quotas) // SHARD_BLOCKS)
    spark = docs.sparkSession
    schema = pa.schema([("sid", pa.int32()), ("from", pa.int64()), ("to", pa.int64()), ("shard", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shard in b.column("id").to_pylist():
                first, n = split_quotas(quotas, shard, shards, seed)
                out += [(i, a, a + k, shard) for i, (a, k) in enumerate(zip(first, n)) if k]
            if out:
                yield batch(schema, *map(list, zip(*out)))

    stretches = spark.range(shards).mapInArrow(walk, "sid int, from long, to long, shard long")
    # each shard's stretches as draws of single blocks: draw k of a source is turn k % filled
    of = F.lit(filled) if len(filled) else F.array(F.lit(1))
    draws = stretches.select("sid", "shard", F.explode(F.sequence("from", F.col("to") - 1)).alias("draw"))
    draws = draws.select("sid", "shard", (F.col("draw") % F.element_at(of, F.col("sid") + 1)).alias("turn"), F.floor(F.col("draw") / F.element_at(of, F.col("sid") + 1)).alias("pass"))
    placed = draws.groupBy("sid", "turn").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("held"))  # at most passes + 1 each
    blocks = materialize(blocks.join(placed, ["sid", "turn"], "left").select("sid", "block", "before", "words", "held"), "placed-blocks")
    rows = rows.join(blocks.withColumnRenamed("words", "block_words"), ["sid", "block"])

    # the block where the rest of a target ends is taken in part
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_words") > F.col("rest"))
    narrow = sized.join(facts, sized.source.eqNullSafe(facts.source)).drop(facts.source).withColumn("block", F.pmod("key", "blocks"))
    ends = blocks.withColumnRenamed("words", "block_words").join(facts.select("sid", "rest"), "sid").where(edge).select("sid", "block", (F.col("rest") - F.col("before")).alias("room"))
    takes = _edge_takes(narrow.join(ends, ["sid", "block"]).select("sid", "room", "key", "size"))
    whole = rows.where(~edge).withColumn("extra", F.col("before") < F.col("rest"))
    equal = W.partitionBy("sid", "key", "size").orderBy("doc_id")
    part = rows.where(edge).withColumn("n", F.row_number().over(equal)).join(takes, ["sid", "key", "size"]).withColumn("extra", F.col("n") <= F.col("takes")).drop("n", "takes")
    rows = whole.unionByName(part)

    def draw(x: Column) -> Column:
        return F.struct(x["shard"].alias("shard"), _mix("key", "size", x["shard"], x["pass"], seed=seed + 3).alias("place"))

    none = F.array().cast("array<struct<pass:bigint,shard:bigint>>")
    taken = F.transform(F.filter(F.coalesce("held", none), lambda x: (x["pass"] < F.col("passes")) | F.col("extra")), draw)
    return rows.select("doc_id", "source", "size", "source_size", "target", *keep, taken.alias("draws")), shards


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source, n_chars) as often as the mix takes them, with shard and place.

    Documents are dealt to their shards, as many tasks as there are shards, and stand in a seeded random order within each.
    """
    rows, shards = _mixed(docs, keep=("text", "lang", "n_chars"), **options)
    one = rows.select("doc_id", "text", "lang", "source", "n_chars", F.explode("draws").alias("d")).select("doc_id", "text", "lang", "source", "n_chars", "d.shard", "d.place")
    return one.repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id")
