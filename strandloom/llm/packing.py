"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length; pieces fall into length classes. A linear
program over patterns of classes, priced by a knapsack recursion, gives the fewest sequences for the
classes' counts. Its whole parts and a first-fit filling of the rest become integer patterns, to
which the pieces are assigned by their rank in their class.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, lean, materialize, tune_batches
from .tokens import END, encoder

log = logging.getLogger(__name__)
LENGTH, GRAIN = 2048, 8
#: Pieces of a class that are ranked together, about.
RANKED = 20_000


class Pattern(NamedTuple):
    copies: int
    items: dict[int, int]  # class: how many


def _knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within room, by dynamic programming over the room."""
    price = np.zeros(room + 1)  # of an item of each size; size 0 leaves one place empty
    item = np.full(room + 1, -1)
    price[sizes], item[sizes] = prices, np.arange(len(sizes))
    price[1], item[1] = (price[1], item[1]) if item[1] >= 0 and price[1] > 0 else (0.0, -1)
    price[(item < 0) & (np.arange(room + 1) > 1)] = -1.0
    value, pick = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        gain = price[1 : c + 1] + value[c - 1 :: -1] if c > 1 else price[1:2]
        pick[c] = int(gain.argmax()) + 1
        value[c] = gain[pick[c] - 1]
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if item[pick[c]] >= 0:
            counts[item[pick[c]]] += 1
        c -= int(pick[c])
    return float(value[room]), counts


def column_generation(demand: dict[int, int], room: int) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """Patterns of a basis, how often each is used (fractional), and the classes of their entries.

    It ends at the optimum, or as soon as rounding up its sum can't be improved: no solution needs
    fewer than the sum over the best column's value.
    """
    classes = sorted(k for k, n in demand.items() if n)
    sizes = np.array(classes, np.int64)
    basis = [np.eye(len(classes))[i] * (room // s) for i, s in enumerate(classes)]
    inverse = np.diag([1.0 / (room // s) for s in classes]) if classes else np.zeros((0, 0))
    use = inverse @ np.array([demand[k] for k in classes], float)
    least, still = 0.0, 0
    while classes:
        value, column = _knapsack(inverse.sum(0), sizes, room)
        total = float(use.sum())
        least = max(least, total / max(value, 1.0))
        if value <= 1 + 1e-9 or math.ceil(least - 1e-6) >= math.ceil(total - 1e-6):
            break
        step = inverse @ column
        rows = np.flatnonzero(step > 1e-9)
        out = int(rows[np.argmin(use[rows] / step[rows])])
        amount = use[out] / step[out]
        still = 0 if amount > 1e-9 else still + 1
        if still > 20 * len(classes):  # steps of no length only: a degenerate basis that goes round
            log.warning("packing stops %.3g sequences above the least possible", total - least)
            break
        use = np.maximum(use - amount * step, 0)
        use[out] = amount
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        basis[out] = column
    return basis, use, classes


def plan(demand: dict[int, int], room: int) -> list[Pattern]:
    """Integer patterns that hold the demand exactly: whole parts of the program's, then first fit for the rest."""
    basis, use, classes = column_generation(demand, room)
    rest, made = {k: demand[k] for k in classes}, []
    for column, x in sorted(zip(basis, use), key=lambda p: -p[1]):
        items = {k: int(round(a)) for k, a in zip(classes, column) if a > 0.5}
        n = min(int(x + 1e-6), *(rest[k] // a for k, a in items.items()))
        if n > 0:
            made.append(Pattern(n, items))
            for k, a in items.items():
                rest[k] -= n * a
    bins: list[tuple[int, dict[int, int]]] = []
    for k in sorted(rest, reverse=True):
        for _ in range(rest[k]):
            for i, (free, items) in enumerate(bins):
                if free >= k:
                    items[k] = items.get(k, 0) + 1
                    bins[i] = (free - k, items)
                    break
            else:
                bins.append((room - k, {k: 1}))
    return made + [Pattern(1, items) for _, items in bins]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, pieces in a copy, first sequence) of each pattern's share of each class."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for p in patterns:
        for k, a in p.items.items():
            first = used.get(k, 0)
            used[k] = first + a * p.copies
            out.append((k, first, used[k], a, sequence))
        sequence += p.copies
    return out


def pieces(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, with keep_ids, ids (unsigned 32-bit, little-endian).

    A null text counts as empty; an empty one is its end id alone.
    """
    tune_batches(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema([*fields, *([("ids", pa.binary())] * keep_ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in batches:
            out = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    out.append((doc_id, at, len(part) // 4, zlib.crc32(part), n, *([part] * keep_ids)))
            if out:
                yield batch(schema, *map(list, zip(*out)))

    types = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), types)


def pack(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, grain: int = GRAIN, keep_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset.

    docs needs doc_id and text; others are ignored. Every piece lies whole in one sequence, offsets
    have no gaps, and no sequence exceeds `length`. Classes are multiples of `grain`, so the program
    has length / grain rows at most whatever the input; only the classes' counts reach the driver.
    Rows that repeat an id are documents of their own. An empty table gives no pieces.
    """
    room = length // grain
    made = materialize(pieces(docs, tokenizer, length=length, keep_ids=keep_ids).withColumn("class", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    counts = {r["class"]: r["count"] for r in made.groupBy("class").count().collect()}
    parts = max(16, sum(counts.values()) // RANKED)
    table = docs.sparkSession.createDataFrame(slots(plan(counts, room)), "k int, first long, last long, each int, sequence long")

    made = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    order = W.partitionBy("class").orderBy("part")
    before = made.groupBy("class", "part").agg(F.count("*").alias("n")).select(F.col("class").alias("k"), F.col("part").alias("p"), (F.sum("n").over(order) - F.col("n")).alias("before"))
    ranked = made.withColumn("rank", F.row_number().over(W.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, (F.col("class") == F.col("k")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("rank") + F.col("before")).drop("k", "p", "before", "part")
    # a few rows for each pattern, of which there are no more than classes and their remainders
    at = ranked.join(F.broadcast(table), (F.col("class") == F.col("k")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    at = at.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    inside = W.partitionBy("sequence_id").orderBy(F.col("class").desc(), "rank")
    offset = F.sum("length").over(inside) - F.col("length")
    return at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] * keep_ids), "sequence_id", offset.alias("offset"))
