"""Reads and alignments: keys, joins, coordinates, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna, tags
from .filters import first_by, primary


def lookup(reads: DataFrame) -> DataFrame:
    """Primary alignments by each key they are known by: their name, and their parent's if they were split."""
    keys = F.array_compact(F.array_distinct(F.array("parent_id", "query_name")))
    return reads.where(primary(F.col("flag"))).select(F.explode(keys).alias("read_id"), "*")


def with_signals(signals: DataFrame, reads: DataFrame) -> DataFrame:
    """Signals with every alignment of theirs; either alone is skipped."""
    return signals.join(lookup(reads), "read_id")


def with_first_alignment(grouped: DataFrame, reads: DataFrame, *, order: str = "line_no") -> DataFrame:
    """Reads' results with their first alignment; those without one are dropped."""
    return grouped.join(first_by(lookup(reads), ["read_id"], order), "read_id")


def with_calls(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """All reads with what was called on them, or nulls."""
    return reads.join(calls.withColumnRenamed("read_id", "query_name"), "query_name", "left")


def common_reads(a: DataFrame, b: DataFrame, *, k: int = 10_000) -> DataFrame:
    """The first k names that both have."""
    return a.select("query_name").intersect(b.select("query_name")).orderBy("query_name").limit(k)


def site_skips(seq: Column, base: str, at: Column) -> Column:
    """Such bases between successive ascending positions `at`; null for a position that isn't on one.

    Each stretch of the sequence is looked at once.
    """

    def build(z: Column) -> Column:
        last = F.concat(F.array(F.lit(-1)), F.slice(z["at"], 1, F.greatest(F.size(z["at"]) - 1, F.lit(0))))
        return F.zip_with(z["at"], F.slice(last, 1, F.size(z["at"])), lambda p, b: F.when(F.get(z["bases"], p) == base, F.size(F.filter(F.slice(z["bases"], b + 2, p - b - 1), lambda x: x == base))))

    return dna.let(F.struct(F.split(F.upper(seq), "").alias("bases"), at.alias("at")), build)


#: Reference- and query-consuming CIGAR operations. Fixed values.
_QUERY, _REF = (0, 1, 4, 7, 8), (0, 2, 3, 7, 8)


def aligned_pairs(cigar: Column, start: Column) -> Column:
    """(q, r) of every aligned, inserted, clipped or deleted base, in order; null where one side has none.

    Bases that consume a side are numbered by their rank among these, and both sides are merged by a
    sort on the base's place, so a read costs n log n however many operations it has.
    """

    def side(ops: Column, consuming: tuple[int, ...], told) -> Column:
        at = F.filter(F.transform(ops, lambda o, i: F.when(o.isin(*consuming), i)), lambda i: i.isNotNull())
        return F.transform(at, told)

    def merged(ops: Column) -> Column:
        none_q, none_r = F.lit(None).cast("int"), F.lit(None).cast("long")
        query = side(ops, _QUERY, lambda i, j: F.struct(i.alias("i"), j.alias("q"), none_r.alias("r")))
        ref = side(ops, _REF, lambda i, j: F.struct(i.alias("i"), none_q.alias("q"), (start + j).cast("long").alias("r")))
        return F.array_sort(F.concat(query, ref))  # of one place, the row without q comes first

    def paired(rows: Column) -> Column:
        def told(x: Column, k: Column) -> Column:
            after, before = F.get(rows, k + 1), F.get(rows, k - 1)
            both = F.struct(after["q"].alias("q"), x["r"].alias("r"))
            return F.when(after["i"] == x["i"], both).when(F.coalesce(before["i"] == x["i"], F.lit(False)), None).otherwise(F.struct(x["q"].alias("q"), x["r"].alias("r")))

        return F.filter(F.transform(rows, told), lambda x: x.isNotNull())

    ops = F.flatten(F.transform(cigar, lambda c: F.array_repeat(c["op"], c["len"])))
    return dna.let(dna.let(ops, merged), paired)


def reference_positions(pairs: Column, positions: Column, length: Column, is_reverse: Column) -> Column:
    """Reference position of each forward read position; -1 for insertions, clips and reads without pairs."""
    # every query base occurs once and in order, so its place in this list is its position
    by_query = F.transform(F.filter(pairs, lambda p: p["q"].isNotNull()), lambda p: p["r"])

    def look(z: Column) -> Column:
        return F.transform(z["at"], lambda x: F.coalesce(F.get(z["r"], dna.forward_position(x, z["n"], z["back"])), F.lit(-1).cast("long")))

    return dna.let(F.struct(by_query.alias("r"), positions.alias("at"), length.alias("n"), is_reverse.alias("back")), look)


def reanchored(pairs: Column) -> Column:
    """Pairs by the bases of the re-anchored read: (ref_pos, q, extra), extra the inserted bases that join the one before.

    Clipped ends keep their own bases, deletions have no q, and insertions lie between the first
    and the last reference base. Each base takes the pairs up to the next one, so pairs are passed once.
    """

    def places(x: Column, wanted) -> Column:
        return F.filter(F.transform(x, lambda p, i: F.when(wanted(p, i), i)), lambda i: i.isNotNull())

    def ends(x: Column) -> Column:
        on = places(x, lambda p, i: p["r"].isNotNull())
        n = F.size(x)
        return dna.let(on, lambda o: F.struct(x.alias("pairs"), F.coalesce(F.get(o, F.lit(0)), n).alias("first"), F.coalesce(F.get(o, F.size(o) - 1), n).alias("last")))

    def starts(z: Column) -> Column:
        outside = lambda i: (i < z["first"]) | (i > z["last"])
        at = places(z["pairs"], lambda p, i: F.when(outside(i), p["q"].isNotNull()).otherwise(p["r"].isNotNull()))
        return F.struct(z["pairs"].alias("pairs"), at.alias("at"))

    def built(z: Column) -> Column:
        def base(a: Column, k: Column) -> Column:
            to = F.coalesce(F.get(z["at"], k + 1), F.size(z["pairs"]))
            extra = F.transform(F.slice(z["pairs"], a + 2, to - a - 1), lambda p: p["q"])
            own = F.get(z["pairs"], a)
            return F.struct(own["r"].alias("ref_pos"), own["q"].alias("q"), F.filter(extra, lambda q: q.isNotNull()).alias("extra"))

        return F.transform(z["at"], base)

    return dna.let(dna.let(dna.let(pairs, ends), starts), built)


def complete(patches: DataFrame) -> DataFrame:
    """Reads with how many distinct patches came, how many should, and whether all did."""
    found = patches.groupBy("read_id").agg(F.count_distinct("patch_idx").alias("got"), F.max("total_patches").alias("expected"))
    return found.withColumn("complete", F.col("got") == F.col("expected"))


def packed_sites(predictions: DataFrame) -> DataFrame:
    """Per read and base (A for m6A, else C): positions and probabilities, the last of a position by patch and place."""
    base = F.when(F.col("methy_type") == dna.M6A, "A").otherwise("C")
    last = predictions.groupBy("read_id", base.alias("base"), "read_pos").agg(F.max_by("prob", F.struct("patch_idx", "place")).alias("prob"))
    return last.groupBy("read_id", "base").agg(F.sort_array(F.collect_list(F.struct("read_pos", "prob"))).alias("sites"))


def tagged(reads: DataFrame, packed: DataFrame, *, how: str = "inner") -> DataFrame:
    """Reads (query_name, forward sequence seq) with mm and ml of their packed sites, both bases' parts set end to end.

    how: inner keeps reads that have calls only, left keeps all. A read with a position that isn't on
    its base loses its row.
    """
    part = packed.join(reads.select(F.col("query_name").alias("read_id"), "seq"), "read_id")
    part = part.withColumn("at", F.transform("sites", lambda s: s["read_pos"]))
    part = part.withColumn("skips", F.when(F.col("base") == "A", site_skips(F.col("seq"), "A", F.col("at"))).otherwise(site_skips(F.col("seq"), "C", F.col("at"))))
    text = F.concat(F.when(F.col("base") == "A", "A+a,").otherwise("C+m,"), F.array_join("skips", ","), F.lit(";"))
    made = part.select("read_id", F.struct(F.when(F.col("base") == "A", 1).otherwise(0).alias("o"), text.alias("mm"), tags.ml(F.transform("sites", lambda s: s["prob"] * 100)).alias("ml")).alias("part"), F.exists("skips", lambda x: x.isNull()).alias("bad"))
    joined = made.groupBy(F.col("read_id").alias("query_name")).agg(F.sort_array(F.collect_list("part")).alias("parts"), F.max("bad").alias("bad"))
    joined = joined.select("query_name", "bad", F.array_join(F.transform("parts", lambda p: p["mm"]), "").alias("mm"), F.flatten(F.transform("parts", lambda p: p["ml"])).alias("ml"))
    return reads.drop("mm", "ml").join(joined, "query_name", how).where(~F.coalesce("bad", F.lit(False))).drop("bad")


def in_coordinate_order(reads: DataFrame, contigs: list[str]) -> DataFrame:
    """Aligned reads in the header's order of contigs, unaligned ones last."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, contigs)), F.col("reference_name")), F.lit(0))
    return reads.orderBy(F.when(rank == 0, len(contigs) + 1).otherwise(rank), "reference_start")


def dropped_moves(tags_column: Column, *, keep_mv: bool = False, pulse: tuple[str, ...] = ()) -> Column:
    """Extra tags without the move table, unless it's kept, and without pulse tags if told."""
    gone = (() if keep_mv else ("mv",)) + pulse
    return F.map_filter(tags_column, lambda k, v: ~k.isin(*gone)) if gone else tags_column


def ranked_per_read(rows: DataFrame, base: str = "C") -> DataFrame:
    """(query_name, seq) exploded to (query_name, pos, rank) of a base."""
    return rows.select("query_name", F.posexplode(dna.positions(F.col("seq"), base)).alias("rank", "pos"))


def numbered_patches(patches: DataFrame) -> DataFrame:
    own = W.partitionBy("read_id")
    return patches.select("*", (F.row_number().over(own.orderBy("start")) - 1).alias("patch_idx"), F.count("*").over(own).alias("total_patches"))
