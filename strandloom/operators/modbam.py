"""Modification tags of alignment records: decoded to sites, and written from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna, tags
from .filters import first_by, labelable, primary
from .reads import aligned_pairs, reference_positions, site_skips


def modifications(seq: Column, mm: Column, ml: Column, kind: str) -> Column:
    """(pos, score) of one modification in a forward sequence, from MM and ML values that may hold several."""
    base, _, prefix = tags.mod_config(kind)
    parts = F.filter(F.split(mm, ";"), lambda p: p != "")
    earlier = F.slice(parts, 1, F.greatest(F.array_position(F.transform(parts, lambda p: p.startswith(prefix.rstrip(","))), F.lit(True)).cast("int") - 1, F.lit(0)))
    before = F.aggregate(earlier, F.lit(0), lambda n, p: n + F.size(F.split(p, ",")) - 1)
    ranks = tags.ranks_of(mm, prefix)

    def build(z: Column) -> Column:
        return F.transform(z["ranks"], lambda r, i: F.struct(F.get(z["at"], r).alias("pos"), F.get(z["ml"], z["before"] + i).alias("score")))

    return dna.let(F.struct(ranks.alias("ranks"), dna.positions(seq, base).alias("at"), ml.alias("ml"), before.alias("before")), build)


def site_predictions(reads: DataFrame, kind: str = "m", *, order: str = "line_no") -> DataFrame:
    """(read_id, chrom, ref_pos, prob) of the modifications of primary records with scores, the first of each name, on reference positions."""
    kept = first_by(reads.where(primary(F.col("flag")) & (F.size("ml") > 0) & F.col("seq").isNotNull()), ["query_name"], order)
    fwd = dna.forward(F.col("seq"), F.col("is_reverse"))
    found = kept.select("query_name", "reference_name", "reference_start", "cigar", "is_reverse", F.length("seq").alias("n"), modifications(fwd, F.col("mm"), F.col("ml"), kind).alias("m"))
    at = reference_positions(aligned_pairs(F.col("cigar"), F.col("reference_start")), F.transform("m", lambda x: x["pos"]), F.col("n"), F.col("is_reverse"))
    rows = found.select("query_name", "reference_name", F.explode(F.zip_with("m", at, lambda x, r: F.struct(x["score"].alias("score"), r.alias("ref_pos")))).alias("x"))
    return rows.where("x.ref_pos <> -1").select(F.col("query_name").alias("read_id"), F.col("reference_name").alias("chrom"), "x.ref_pos", (F.col("x.score") / 255).alias("prob"))


def _written(rows: DataFrame, kind: str) -> DataFrame:
    """(query_name, fwd, sites of (pos, score 0..100) ascending) -> mm and ml; reads with a site off its base are dropped."""
    base, _, prefix = tags.mod_config(kind)
    at = F.transform("sites", lambda s: s["pos"])
    told = rows.select("query_name", site_skips(F.col("fwd"), base, at).alias("skips"), tags.ml(F.transform("sites", lambda s: s["score"])).alias("ml"))
    return told.where(~F.exists("skips", lambda x: x.isNull())).select("query_name", F.concat(F.lit(prefix), F.array_join("skips", ","), F.lit(";")).alias("mm"), "ml")


def label_tags(reads: DataFrame, labels: DataFrame, *, kind: str = "m", least: int = 10) -> DataFrame:
    """Reads with tags of their labels: (chrom, pos, score) of sites, or (read_id, chrom, pos, label) of reads.

    Positions on the reference are brought to the read by its aligned pairs; those off the base, and
    reads left without any, are dropped.
    """
    base, _, _ = tags.mod_config(kind)
    own = labelable(reads.drop("mm", "ml"), least=least)
    n = F.length("seq")
    fwd = dna.forward(F.col("seq"), F.col("is_reverse"))
    pairs = F.filter(aligned_pairs(F.col("cigar"), F.col("reference_start")), lambda p: p["q"].isNotNull() & p["r"].isNotNull())

    def on_base(z):
        at = F.transform(z["pairs"], lambda p: F.struct(dna.forward_position(p["q"], z["n"], z["back"]).alias("at"), p["r"].alias("pos")))
        return F.filter(at, lambda p: F.get(z["bases"], p["at"]) == base)

    # only places leave the read, not its sequence, which is joined back to the places that have a label
    found = dna.let(F.struct(pairs.alias("pairs"), F.split(fwd, "").alias("bases"), n.alias("n"), F.col("is_reverse").alias("back")), on_base)
    spread = own.select("query_name", F.col("reference_name").alias("chrom"), F.explode(found).alias("p")).select("query_name", "chrom", "p.at", "p.pos")
    if "read_id" in labels.columns:
        joined = spread.join(labels.select(F.col("read_id").alias("query_name"), "chrom", "pos", F.col("label").alias("score")), ["query_name", "chrom", "pos"])
    else:
        joined = spread.join(labels.select("chrom", "pos", "score"), ["chrom", "pos"])
    sites = joined.groupBy("query_name").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("pos"), F.col("score").cast("double").alias("score")))).alias("sites"))
    sites = sites.join(own.select("query_name", fwd.alias("fwd")), "query_name")
    return own.join(_written(sites, kind), "query_name")


def training_tags(reads: DataFrame, *, kind: str = "m6A", min_confidence: float = 0.9, use_nucleosome: bool = False) -> DataFrame:
    """Reads with tags of sure labels: high scores and zeros, or, with nucleosomes, their edges against unmodified bases."""
    base, _, _ = tags.mod_config(kind)
    fwd = dna.forward(F.col("seq"), F.col("is_reverse"))
    own = reads.where(primary(F.col("flag")) & F.col("seq").isNotNull() & F.col("mm").isNotNull()).withColumn("fwd", fwd)
    own = own.withColumn("m", F.map_from_entries(F.array_distinct(modifications(F.col("fwd"), F.col("mm"), F.col("ml"), kind))))
    edges = F.coalesce(tags.nucleosome_edges(F.col("ns"), F.col("nl")), F.array().cast("array<int>"))

    def label(z: Column):
        return lambda p: F.struct(p.alias("pos"), (tags.nucleosome_label(p, z["edges"], z["m"][p]) if use_nucleosome else tags.training_label(F.coalesce(z["m"][p], F.lit(0)), min_confidence)).cast("double").alias("score"))

    sites = dna.let(F.struct(F.col("m").alias("m"), edges.alias("edges"), dna.positions(F.col("fwd"), base).alias("at")), lambda z: F.transform(z["at"], label(z)))
    kept = own.select("query_name", "fwd", F.filter(sites, lambda s: s["score"].isNotNull()).alias("sites")).where(F.size("sites") > 0)
    return reads.drop("mm", "ml").join(_written(kept, kind), "query_name")


def predictions_to_tags(reads: DataFrame, calls: DataFrame, *, threshold: float = 0.5, order: str = "line_no") -> DataFrame:
    """First alignments with tags of their predictions: 100 over the threshold, else 0; positions are those of the read."""
    own = first_by(reads.where(primary(F.col("flag"))), ["query_name"], order).drop("mm", "ml")
    score = F.when(F.col("prob_methylated") > threshold, 100.0).otherwise(0.0)
    last = calls.groupBy(F.col("read_id").alias("query_name"), "read_pos").agg(F.max_by(score, order).alias("score"))
    sites = last.groupBy("query_name").agg(F.sort_array(F.collect_list(F.struct(F.col("read_pos").alias("pos"), "score"))).alias("sites"))
    base = F.first(F.when(F.col("methy_type") == dna.M6A, "A").otherwise("C"))
    kinds = calls.groupBy(F.col("read_id").alias("query_name")).agg(base.alias("base"))
    joined = sites.join(kinds, "query_name").join(own.select("query_name", dna.forward(F.col("seq"), F.col("is_reverse")).alias("fwd")), "query_name")
    made = _written(joined.where("base = 'A'"), "m6A").union(_written(joined.where("base = 'C'"), "m"))
    return own.join(made, "query_name")
