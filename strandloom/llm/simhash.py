"""SimHash near-duplicate groups found by covering locality-sensitive hashing.

Every bit position gets a nonzero vector of GF(2)^(radius+1); each nonzero vector v of that space
gives one table, whose mask holds the positions with odd inner product with v. Any `radius`
differing positions leave some v orthogonal to all of them, so the two fingerprints agree under
that mask: every pair within the radius meets in some table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, rows_of, tune_batches
from .components import components

#: Distinct fingerprints of a bucket that one task compares with each other; larger buckets are split.
BUCKET = 1024
_FULL = (1 << 64) - 1


def masks(radius: int) -> list[int]:
    n = (1 << (radius + 1)) - 1
    step = 1 if n <= 64 else 37
    vectors = [1 + i * step % n for i in range(64)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, width: int, seed: int) -> int:
    """Fingerprint of a UTF-8 text as a signed 64-bit integer; without words it is zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: -width])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` fingerprints of 64-bit hashes: the first of the hashes themselves, each other of the hashes mixed anew (splitmix64)."""
    counts = np.zeros(64 * words, np.int64)
    offsets = np.arange(1, words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12), None]
        z = part + offsets
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed = np.ascontiguousarray(np.concatenate((part, z ^ z >> np.uint64(31)), axis=1))
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            counts += bits[b : b + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def tables(words: int, *, width: int, radius: int) -> list[tuple[int, int]]:
    """(word, mask) of each table of a wide fingerprint: the covering masks over every part of `width` bits.

    Two wide fingerprints of which any part differs in `radius` or fewer bits agree under some mask.
    """
    parts = [((1 << width) - 1) << at for at in range(0, 64 - width + 1, width)]
    return [(w, m & part) for w in range(words) for part in parts for m in masks(radius)]


#: Bits of a key of `keyed` below the number of its table.
_KEY = 48


def table_of(key: int) -> int:
    return int(key) >> _KEY


def keyed(classes: DataFrame, dealt: list[tuple[int, int]], *columns) -> DataFrame:
    """Wide fingerprints fps -> a row (key, *columns) for each table; a class without fingerprints gets none.

    A key is the number of the table and a hash of the bits under its mask.
    """
    bits = [F.xxhash64(F.get("fps", F.lit(w)).bitwiseAND(F.lit(_signed(m)))) for w, m in dealt]
    keys = [F.shiftrightunsigned(x, 64 - _KEY).bitwiseOR(F.lit(i << _KEY).cast("long")) for i, x in enumerate(bits)]
    return classes.where(F.size("fps") > 0).select(F.explode(F.array(*keys)).alias("key"), *columns)


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp). Repeated shingles count as often as they occur; a null text counts as empty."""
    tune_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            yield batch(schema, ids, [fingerprint(t, width, seed) for t in texts])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("free", pa.int64())])


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a boolean adjacency matrix."""
    left, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                j = todo.pop()
                new = np.flatnonzero(near[j] & left)
                left[new] = False
                out += [(int(x), j) for x in new]
                todo += new.tolist()
    return out


def _compare(radius: int):
    """Rows (key, fp, free) sorted by key -> links (a, b) of fingerprints within the radius, and the rows of larger buckets as they came (a, key, free)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        hot = None  # the key of a bucket that is being passed on

        def links(a, b) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return batch(_LINKS, np.asarray(a, np.int64), np.asarray(b, np.int64), none, none)

        def passed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from pa.table([t["fp"], pa.nulls(t.num_rows, pa.int64()), t["key"], t["free"]], schema=_LINKS).to_batches()

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, node = t["key"].to_numpy(), t["fp"].to_numpy()
            bits = node.view(np.uint64)
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size, start = np.diff(cuts), cuts[:-1]
            two = start[size == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            yield links(node[two], node[two + 1])
            for s, n in zip(start[size > 2], size[size > 2]):
                if n > BUCKET:
                    yield from passed(t.slice(s, n))
                    continue
                f, v = bits[s : s + n], node[s : s + n]
                out = _spanning(np.bitwise_count(f[:, None] ^ f[None]) <= radius)
                if out:
                    x, y = np.array(out).T
                    yield links(v[x], v[y])

        for b in batches:
            t = pa.Table.from_batches([*held, b])
            if hot is not None:  # rows are sorted by key: what is left of the hot bucket comes first
                n = int(np.searchsorted(t["key"].to_numpy() != hot, True))
                yield from passed(t.slice(0, n))
                t = t.slice(n)
                hot = None if t.num_rows else hot
                if not t.num_rows:
                    held = []
                    continue
            if t.num_rows > BUCKET and t["key"][0] == t["key"][t.num_rows - 1]:
                hot = t["key"][0].as_py()
                yield from passed(t)
                held = []
                continue
            key = t["key"].to_numpy()
            last = int(np.searchsorted(key == key[-1], True))  # the last bucket may go on
            if last:
                yield from work(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def links(classes: DataFrame, *, radius: int = 3) -> DataFrame:
    """Distinct fingerprints fp -> (a, b): links that connect all fingerprints within the radius.

    A bucket of more than BUCKET fingerprints agrees on some bits only; its rows are dealt anew by
    each of radius+1 parts of the bits still free, one of which any pair within the radius shares,
    until buckets are small. Distinct fingerprints differ in free bits, of which every round takes a
    part, so this ends; no pair is dropped, and no bucket is gathered.
    """
    table = F.explode(F.array(*[F.lit(_signed(m)) for m in masks(radius)])).alias("mask")
    rows = classes.select("fp", table).select(F.xxhash64("mask", F.expr("fp & mask")).alias("key"), "fp", F.expr("~mask").alias("free"))
    tune_batches(classes.sparkSession, 1 << 14)
    found, level = None, 0
    while rows is not None:
        dealt = rows.repartition("key").sortWithinPartitions("key", "fp")
        out = materialize(dealt.mapInArrow(_compare(radius), "a long, b long, key long, free long"), f"links-{level}")
        part = out.where("b is not null").select("a", "b")
        found = part if found is None else found.union(part)
        hot = out.where("b is null").select("key", F.col("a").alias("fp"), "free")
        rows = _split(hot, radius + 1) if not hot.isEmpty() else None
        level += 1
    return found


def _split(hot: DataFrame, parts: int) -> DataFrame:
    """Deal the rows of hot buckets by each of the parts of their free bits."""
    schema = pa.schema([(c, pa.int64()) for c in ("key", "fp", "free", "block")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[int]] = {}
        for b in batches:
            free = b.column("free").to_pylist()
            for f in set(free):
                bits = [i for i in range(64) if (f & _FULL) >> i & 1]
                blocks[f] = [_signed(sum(1 << i for i in bits[len(bits) * j // parts : len(bits) * (j + 1) // parts])) for j in range(parts)]
            for j in range(parts):
                yield batch(schema, b.column("key"), b.column("fp"), b.column("free"), np.array([blocks[f][j] for f in free], np.int64))

    dealt = hot.mapInArrow(run, "key long, fp long, free long, block long")
    return dealt.select(F.xxhash64("key", "block", F.expr("fp & block")).alias("key"), "fp", F.expr("free & ~block").alias("free"))


def near_duplicates(docs: DataFrame, *, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    docs needs doc_id and text; other columns are ignored. Fingerprints link at `radius` or fewer
    differing bits. Equal fingerprints become one class first, so copies are linked without pairs.
    Null or empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id stay
    rows; a null doc_id is never a component's id unless all are null (then it is null).
    """
    made = materialize(fingerprints(docs, width=width, seed=seed), "fingerprints")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, radius=radius))
    labelled = materialize(classes.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root"), "rooted")
    group = labelled.groupBy("root").agg(F.min("first").alias("least"))
    linked = labelled.join(group, "root").select("fp", "least")
    ids = classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return made.join(materialize(ids, "classes-of"), "fp").select("doc_id", "fp", "component_id")
