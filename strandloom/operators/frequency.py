"""Site frequencies from calls, and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .filters import callable_call

SITE = ("chrom", "ref_pos")


def usable_calls(calls: DataFrame, *, prob_cf: float = 0.0, contig: str | None = None) -> DataFrame:
    """Calls on a reference position, of one contig if told, with a sure enough probability."""
    kept = calls.where(F.col("ref_pos") >= 0)
    kept = kept if contig is None else kept.where(F.col("chrom") == contig)
    return kept.where(callable_call(F.col("prob_unmethylated"), F.col("prob_methylated"), prob_cf))


def _with_genome(calls: DataFrame, contigs: DataFrame, before: int, length: int, size: int | None) -> tuple[DataFrame, Column]:
    """Calls with the seq that holds their window, and their window in it."""
    if size is None:
        joined, at = calls.join(contigs, calls.chrom == contigs.contig), F.col("ref_pos")
    else:
        start = F.when(F.col("strand") == "-", F.col("ref_pos") - (length - before) + 1).otherwise(F.col("ref_pos") - before)
        own = calls.withColumn("_chunk", F.floor(F.greatest(start, F.lit(0)) / size))
        joined, at = own.join(contigs, (own.chrom == contigs.contig) & (F.col("_chunk") == contigs.chunk)), F.col("ref_pos") - F.col("_chunk") * size
    return joined, dna.window(F.col("seq"), at, F.col("strand"), before, length)


def on_motif(calls: DataFrame, contigs: DataFrame, *, motif: str = "C", mloc: int = 0, size: int | None = None) -> DataFrame:
    """Calls whose strand's genome window is one of the motif's sequences; calls on unknown contigs are dropped.

    contigs holds whole contigs, or chunks of `size` bases that overlap by a motif's length or more;
    genomes of ordinary size are broadcast by Spark's own size check, larger ones joined by a shuffle.
    """
    joined, window = _with_genome(calls, contigs, mloc, len(motif), size)
    return joined.where(window.isin(dna.expand_motif(motif))).drop("contig", "seq", "chunk", "_chunk")


def site_frequency(calls: DataFrame, *, prob_cf: float = 0.0, methyl_threshold: float = 0.5, order: str = "line_no", use_prob: bool = False) -> DataFrame:
    """One row per (chrom, ref_pos): probability sums, counts and rate; strand and kmer are the first call's.

    Strand isn't part of the key. pos_in_strand is the first call's too, or -1 if calls don't tell it. Each task sums
    its own calls before the one shuffle, so a site with very many calls gathers nowhere; first wins hold strings,
    which makes that a sort aggregation, which spills.
    """
    met = F.col("prob_methylated") >= methyl_threshold
    place = F.min_by("pos_in_strand", order) if "pos_in_strand" in calls.columns else F.lit(-1)
    out = usable_calls(calls, prob_cf=prob_cf).groupBy("chrom", F.col("ref_pos").alias("pos")).agg(
        F.min_by("strand", order).alias("strand"), place.alias("pos_in_strand"),
        F.sum("prob_unmethylated").alias("prob_0_sum"), F.sum("prob_methylated").alias("prob_1_sum"),
        F.count_if(met).alias("met"), F.count_if(~met).alias("unmet"), F.count("*").alias("coverage"), F.min_by("kmer", order).alias("kmer"),
        F.min(order).alias("first_seen"),
    )
    rate = F.col("prob_1_sum") / F.col("coverage") if use_prob else F.col("met") / F.col("coverage")
    return out.withColumn("rmet", rate)


def call_usage(calls: DataFrame, *, prob_cf: float = 0.0) -> DataFrame:
    """Calls on reference positions, how many of them count, and their share (null without any)."""
    ok = callable_call(F.col("prob_unmethylated"), F.col("prob_methylated"), prob_cf)
    return calls.where(F.col("ref_pos") >= 0).agg(F.count_if(ok).alias("used"), F.count("*").alias("total")).withColumn("share", F.try_divide("used", "total"))


def percentage(rate: Column, *, use_floor: bool = False) -> Column:
    """Whole per cent: the floor, or half to even of 100 rate + 0.001."""
    return (F.floor(rate * 100) if use_floor else F.rint(rate * 100 + 0.001)).cast("int")


def bedmethyl(sites: DataFrame, *, use_floor: bool = False) -> DataFrame:
    """The eleven bedMethyl columns of site frequencies."""
    end = F.col("pos") + 1
    return sites.select(
        "chrom", F.col("pos").alias("start"), end.alias("end"), F.lit(".").alias("name"), F.col("coverage").alias("score"), "strand",
        F.col("pos").alias("thick_start"), end.alias("thick_end"), F.lit("0,0,0").alias("rgb"), "coverage", percentage(F.col("rmet"), use_floor=use_floor).alias("percentage"),
    )


def by_motif(calls: DataFrame, contigs: DataFrame, *, size: int | None = None) -> DataFrame:
    """Calls with the CG, CHG or CHH of their genome context as motif; contexts that are short or none of these are dropped.

    contigs and size are as for on_motif.
    """
    joined, window = _with_genome(calls.where(F.col("ref_pos") >= 0), contigs, 0, 3, size)
    told = joined.withColumn("motif", dna.cytosine_motif(window))
    return told.where(F.col("motif").isNotNull()).drop("contig", "seq", "chunk", "_chunk")


def in_order(sites: DataFrame, *, by: str = "place") -> DataFrame:
    """By contig name and position, or, by='first_seen', by each site's first call."""
    return sites.orderBy("first_seen") if by == "first_seen" else sites.orderBy("chrom", "pos")
