"""Groups of documents by exact Jaccard similarity of their word shingles.

Candidates come from SimHash and its covering masks (simhash.py): WORDS fingerprints of a shingle set
are cut into parts of WIDTH bits, and two sets of which any part differs in RADIUS or fewer bits meet
in a table. At a similarity of 0.8 a bit differs with a probability of 0.15, which leaves out 2 of a
million pairs. A pair links only if its whole shingle sets have the wanted similarity, and whole sets
are fetched only where a sketch (more bits of SimHash, set sizes, parities of shingle counts) leaves that
open, in the first table where the two meet. A bucket's members are first held against the smallest one near them; what these links don't connect is held against all
others of the bucket, a large bucket's part by part, so that no table of all pairs of a large group is
written and no task holds a whole one with its shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batch, lean, materialize, rows_of, tune_batches
from .components import components

WORDS, WIDTH, RADIUS = 7, 16, 1
#: Fingerprints whose tables give the first links, which only spare work, and the least rows of a bucket that others are held against for them.
FIRST, HEADS = 2, 1024
#: Open rows of a bucket that are held with their shingle sets, about: groups hold two parts at most.
PART = 1024
#: Words of a sketch, and its bits that may differ: of 192 29 differ on average at a similarity of 0.8, and more than 58 less than once in ten million pairs of long texts.
SKETCH, FAR = 3, 58
#: Words of parities: bit i is set if an odd number of a set's shingles fall into place i of 64 * ODD.
ODD = 4


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles; a text of fewer words than width is one shingle, one without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))], np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _node(of: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(of.tobytes(), 42))


_S = tuple(f"s{i}" for i in range(SKETCH))
_O = tuple(f"o{i}" for i in range(ODD))
_SKETCH = (*_S, *_O, "size")
_MADE = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fps", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_OPEN = pa.schema([(c, pa.int64()) for c in ("key", "root", "node", *_SKETCH)])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signature(of: np.ndarray) -> list[int]:
    """The fingerprints of a shingle set, its parities and its size; an empty set has none."""
    if not len(of):
        return []
    odd = np.packbits(np.bincount((of % np.uint64(64 * ODD)).astype(np.int64), minlength=64 * ODD) & 1, bitorder="little")
    return [*simhash.wide_fingerprint(of, WORDS).view("<i8").tolist(), *odd.view("<i8").tolist(), len(of)]


def _documents(docs: DataFrame) -> DataFrame:
    tune_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, fps): equal shingle sets have equal nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            sets = [shingles(t, width) for t in texts]
            yield batch(_MADE, ids, [_node(s) for s in sets], [signature(s) for s in sets])

    return _documents(docs).mapInArrow(lean(run), "doc_id long, node long, fps array<long>")


def _sketch() -> list:
    return [F.col("fps")[i].alias(c) for i, c in zip((*range(SKETCH), *range(WORDS, WORDS + ODD + 1)), _SKETCH, strict=True)]


def _apart(s: Sequence[np.ndarray], t: Sequence[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count((x ^ y).view(np.uint64)) for x, y in zip(s, t))


def _near(rows: Sequence[np.ndarray], these, those, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of these and those rows of a sketch whose sets may have a similarity of `least`.

    Sets of x and y shingles of which d are in one of the two only are as similar if d (1 + least) is at most
    (x + y) (1 - least); d is no less than the difference of the sizes or the number of parities that differ,
    so neither drops a pair that links.
    """
    a, b = ([x[at] for x in rows] for at in (these, those))
    i, j = np.nonzero(_apart([x[:, None] for x in a[:SKETCH]], [x[None] for x in b[:SKETCH]]) <= FAR)
    x, y = a[-1][i], b[-1][j]
    most = ((x + y) * (1 - least) + 1e-6) / (1 + least)
    ok = np.abs(x - y) <= most
    i, j, most = i[ok], j[ok], most[ok]
    odd = sum(np.bitwise_count((s[i] ^ t[j]).view(np.uint64)).astype(np.int64) for s, t in zip(a[SKETCH:-1], b[SKETCH:-1]))
    ok = odd <= most
    return i[ok], j[ok]


def _met(s: Sequence[np.ndarray], t: Sequence[np.ndarray], dealt: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which pairs of rows agree under the mask of any of the tables; those of words outside the sketch don't count."""
    met = np.zeros(len(s[0]), bool)
    for w, mask in dealt:
        if w < SKETCH:
            met |= (s[w] ^ t[w]) & _signed(mask) == 0
    return met


def _together(schema: pa.Schema, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Columns of many small results -> batches of some size."""
    held, n = [], 0
    for columns in found:
        held.append(columns)
        n += len(columns[0])
        if n >= 1 << 14:
            yield batch(schema, *map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield batch(schema, *map(np.concatenate, zip(*held)))


def _to_smallest(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and node -> pairs of each node with the smallest one near it, among the HEADS smallest of its bucket."""

        def found() -> Iterator[tuple]:
            for _, node, *rows in _mixed(batches, "node", *_SKETCH):
                for at in range(1, len(node), 1 << 10):
                    i, j = _near(rows, slice(at, at + (1 << 10)), slice(HEADS), least)
                    i, first = np.unique(i, return_index=True)  # places come in order: the first is that of the smallest
                    i, j = i + at, j[first]
                    ok = j < i
                    if ok.any():
                        yield node[i[ok]], node[j[ok]]

        yield from _together(_PAIRS, found())

    return run


def _mixed(batches: Iterator[pa.RecordBatch], by: str, *columns: str) -> Iterator[tuple]:
    """Rows sorted by key and `by` -> key, `by` and columns of each bucket that has more than one value of `by`."""

    def cut(rows) -> Iterator[tuple]:
        key, of = rows[:2]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        yield from (tuple(x[s:e] for x in rows) for s, e in zip(cuts[:-1], cuts[1:]) if of[s] != of[e - 1])

    def read(b: pa.RecordBatch, name: str) -> np.ndarray:
        column = b.column(name)
        if not pa.types.is_list(column.type):
            return column.to_numpy()
        out = np.empty(len(column), object)
        out[:] = [x.values.to_numpy().view(np.uint64) for x in column]
        return out

    held: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = tuple(read(b, c) for c in ("key", by, *columns))
        last = int(np.searchsorted(rows[0], rows[0][-1]))  # keys are sorted; the last bucket may go on
        if last or (held and held[0][0][-1] != rows[0][0]):
            yield from cut(tuple(map(np.concatenate, zip(*held, tuple(x[:last] for x in rows)))))
            held = []
        held.append(tuple(x[last:] for x in rows))
    if held:
        yield from cut(tuple(map(np.concatenate, zip(*held))))


def _largest_last(root: np.ndarray) -> tuple[np.ndarray, int]:
    """An order that puts the rows of the commonest root last, and the number of the others: these only have to be held against all."""
    cuts = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1], [True])))
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    order = np.lexsort((root, size))
    return order, int(np.flatnonzero(root[order] != root[order[-1]])[-1]) + 1


def _open(dealt: Sequence[tuple[int, int]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and root -> those near a row of another root in their bucket that they meet in no table before this one."""

        def found() -> Iterator[tuple]:
            for key, *rows in _mixed(batches, "root", "node", *_SKETCH):
                order, few = _largest_last(rows[0])
                root, node, *rows = (x[order] for x in rows)
                before, wanted = dealt[: simhash.table_of(key[0])], np.zeros(len(node), bool)
                for at in range(0, few, 128):
                    these = slice(at, min(at + 128, few))
                    for to in range(at, len(node), 1 << 13):
                        i, j = (x + y for x, y in zip((at, to), _near(rows, these, slice(to, to + (1 << 13)), least)))
                        other = root[i] != root[j]
                        i, j = i[other], j[other]
                        new = ~_met([x[i] for x in rows[:SKETCH]], [x[j] for x in rows[:SKETCH]], before)
                        wanted[i[new]] = wanted[j[new]] = True
                if wanted.any():
                    yield key[: wanted.sum()], *(x[wanted] for x in (root, node, *rows))

        yield from _together(_OPEN, found())

    return run


def _joined(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with shingles sorted by key and root -> pairs of similar sets that join all roots of a bucket that any such pair joins."""

        def found() -> Iterator[tuple]:
            for _, *rows in _mixed(batches, "root", "node", "shingles", *_SKETCH):
                order, few = _largest_last(rows[0])
                root, node, sets, *rows = (x[order] for x in rows)
                size, out = rows[-1], []
                for i in range(few):
                    j = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                    j = j[_near(rows, slice(i, i + 1), j, least)[1]]
                    for at in range(0, len(j), 1024):
                        k = j[at : at + 1024]
                        k = k[root[k] != root[i]]
                        if not len(k):
                            continue
                        flat = np.concatenate(sets[k])
                        same = sets[i][np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)] == flat
                        both = np.add.reduceat(same, np.cumsum(size[k]) - size[k], dtype=np.int64)
                        for x in k[both >= least * (size[i] + size[k] - both)]:
                            if root[x] != root[i]:
                                out.append((max(node[i], node[x]), min(node[i], node[x])))
                                root[root == root[x]] = root[i]
                if out:
                    yield tuple(np.array(out, np.int64).T)

        yield from _together(_PAIRS, found())

    return run


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes, made again from the text of one document of each."""
    wanted = materialize(classes.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "first"), "wanted")
    ids = wanted.select(F.col("first").alias("_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows_of(batches, "text"):
            sets = [shingles(t, width) for t in texts]
            yield batch(_SETS, [_node(s) for s in sets], [s.view(np.int64) for s in sets])

    own = _documents(docs)
    own = own.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(lean(run), "node long, shingles array<long>")
    return materialize(own.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, *, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets have Jaccard similarity of `least` or more."""
    pairs = materialize(pairs.distinct(), "pairs")
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), classes, docs, width)
    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return materialize(pairs.join(left, "a").join(right, "b").where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b"), "confirmed")


def _dealt(rest: DataFrame) -> DataFrame:
    """Open rows with the keys of the groups that are held together: a large bucket's parts, each with each.

    A pair of a bucket's rows meets in the group of their two parts, so none is missed, and no group is
    larger than two parts however large its bucket.
    """
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 2")
    own = rest.join(sizes, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = own.withColumn("c", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d"))
    return own.select(F.when(F.col("parts") == 1, F.col("key")).otherwise(pair).alias("key"), "root", "node", *_SKETCH)


def near_duplicates(docs: DataFrame, *, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, node, group, component_id (smallest doc_id reachable over pairs of similarity `least` or more, itself included).

    docs needs doc_id and text. Equal shingle sets have one node and become one class first; group is one
    number a component. Texts without words are one group. Rows that repeat a doc_id stay rows; a null
    doc_id is never a component's id unless all are null.
    """
    made = materialize(signatures(docs, width), "signatures")
    classes = made.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("fps").alias("fps"))
    classes = materialize(classes, "classes")

    tune_batches(docs.sparkSession, 1 << 14)
    dealt = simhash.tables(WORDS, width=WIDTH, radius=RADIUS)
    rows = simhash.keyed(classes, [(w, m) for w, m in dealt if w < FIRST], "node", *_sketch())
    near = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lean(_to_smallest(least)), "a long, b long")
    found = confirmed(near, classes, docs, width=width, least=least)

    roots = materialize(components(found), "roots")
    tune_batches(docs.sparkSession, 1 << 14)
    rooted = simhash.keyed(classes.join(roots, "node", "left"), dealt, F.coalesce("root", "node").alias("root"), "node", *_sketch())
    by_key = lambda rows: rows.repartition("key").sortWithinPartitions("key", "root")
    rest = materialize(by_key(rooted).mapInArrow(lean(_open(dealt, least)), ", ".join(f"{f.name} long" for f in _OPEN)), "open")
    whole = _dealt(rest).join(_sets(rest, classes, docs, width), "node")
    tune_batches(docs.sparkSession, 1 << 14)
    found = found.union(materialize(by_key(whole).mapInArrow(lean(_joined(least)), "a long, b long"), "joined"))

    labelled = classes.select("node", "first").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    group = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = materialize(labelled.join(group, "root").select("node", F.col("root").alias("group"), "component_id"), "classes-of")
    return made.select("doc_id", "node").join(ids, "node").select("doc_id", "node", "group", "component_id")


def representatives(docs: DataFrame, found: DataFrame, *, width: int = 5) -> DataFrame:
    """One row of docs for each group of near_duplicates(docs, width): that of the smallest doc_id, null last.

    Of rows of one id the one of the smallest shingle hash stays, and of equal ones any one. Texts move once,
    for the join by doc_id; only those whose id repeats or is null are told apart by their shingles.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")).alias("k")
    kept = found.groupBy("group").agg(first).select("k.doc_id", "k.node")
    many = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "repeated-ids")
    kept = materialize(kept.join(many, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "node", (F.col("_id").isNotNull() | F.col("doc_id").isNull()).alias("many")), "kept")
    single = docs.join(kept.where("not many").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if many.isEmpty():
        return single
    unclear = docs.join(many.where("_id is not null"), F.col("doc_id") == F.col("_id"), "left_semi").unionByName(docs.where("doc_id is null"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    tune_batches(docs.sparkSession)

    def noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_node(shingles(t.encode("utf-8", "replace") if t is not None else None, width)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.int64())], names=[*b.schema.names, "_node"])

    told = unclear.mapInArrow(noded, f"{kinds}, _node long")
    wanted = kept.where("many").select(F.col("doc_id").alias("_id"), F.col("node").alias("_wanted"))
    told = told.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_wanted")), "left_semi")
    return single.unionByName(told.dropDuplicates(["doc_id", "_node"]).select(*docs.columns))
