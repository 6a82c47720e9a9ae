"""Sites' calls, truth and labels: aggregation, joins, ranking, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SITE = ["chrom", "ref_pos"]


def site_ratio(calls: DataFrame, *, methy_type: str | None = None, least: int = 5) -> DataFrame:
    """Calls and methylated calls (over one half) of sites with enough of them; the lists are never gathered."""
    kept = calls.where(F.col("ref_pos") != -1)
    kept = kept if methy_type is None else kept.where(F.col("methy_type") == methy_type)
    return kept.groupBy(*SITE).agg(F.count("*").alias("n"), F.count_if(F.col("prob_methylated") > 0.5).alias("m")).where(F.col("n") >= least)


def site_probabilities(calls: DataFrame, *, methy_type: str | None = None) -> DataFrame:
    """Sites with the sorted list of their probabilities: only for few calls a site; site_ratio() needs no list."""
    kept = calls.where(F.col("ref_pos") != -1)
    kept = kept if methy_type is None else kept.where(F.col("methy_type") == methy_type)
    return kept.groupBy(*SITE).agg(F.sort_array(F.collect_list("prob_methylated")).alias("probabilities"))


def site_label(calls: DataFrame) -> DataFrame:
    """One label per site, of labelled calls; two labels raise."""
    found = calls.where(F.col("label") != -1).groupBy(*SITE).agg(F.min("label").alias("label"), F.max("label").alias("most"), F.count("*").alias("n"))
    return found.withColumn("label", F.when(F.col("label") == F.col("most"), F.col("label")).otherwise(F.raise_error(F.lit("a site has two labels")))).drop("most")


def quota_labels(calls: DataFrame, *, least: int = 6, order: str = "line_no") -> DataFrame:
    """Read labels by rank: of a site's n reads the first rint(n label / 100) by hard call get 100, the others 0.

    Ties stand in source order, and sites need `least` reads. Reads of one site are one window group.
    """
    site = W.partitionBy(*SITE)
    rank = F.row_number().over(site.orderBy(F.col("prediction").desc(), order))
    ranked = calls.where(F.col("label") != -1).select("*", F.count("*").over(site).alias("n"), rank.alias("rk")).where(F.col("n") >= least)
    return ranked.withColumn("read_label", F.when(F.col("rk") <= F.rint(F.col("n") * F.col("label") / 100), 100).otherwise(0))


def last_results(calls: DataFrame, *, order: str = "line_no") -> DataFrame:
    """The last prediction of each read at each site."""
    return calls.groupBy("read_id", *SITE).agg(F.max_by("prediction", order).alias("prediction"))


def per_read(calls: DataFrame, *, order: str = "line_no") -> DataFrame:
    """Reads' calls: positions ascending, the first of equal ones; start, end, number, positions and probabilities.

    Repeats are removed before a read's calls are gathered, so a list is no longer than its read.
    """
    first = calls.groupBy("read_id", "read_pos").agg(F.min_by("prob_methylated", order).alias("p"))
    held = first.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct(F.col("read_pos").alias("loc"), "p"))).alias("c"))
    locs = F.transform("c", lambda x: x["loc"])
    return held.select("read_id", F.array_min(locs).alias("start"), (F.array_max(locs) + 1).alias("end"), F.size("c").alias("n"), locs.alias("locs"), F.transform("c", lambda x: x["p"]).alias("probs"))


def merge_labels(sources: list[DataFrame]) -> DataFrame:
    """(chrom, start, percentage) of several truth sets; the last that has a site wins."""
    numbered = reduce(DataFrame.unionByName, [s.select("chrom", "start", "percentage", F.lit(i).alias("_source")) for i, s in enumerate(sources)])
    return numbered.groupBy("chrom", "start").agg(F.max_by("percentage", "_source").alias("percentage"))


def covered(bed: DataFrame, *, least: int = 5, chrom: Column | None = None, order: str = "line_no") -> DataFrame:
    """Truth rows with enough coverage on wanted contigs, the first of equal sites."""
    kept = bed.where(F.col("coverage") >= least)
    kept = kept if chrom is None else kept.where(chrom)
    return kept.groupBy("chrom", "start").agg(F.min_by("percentage", order).alias("percentage"))


def evaluated(sites: DataFrame, truth: DataFrame) -> DataFrame:
    """Sites that have a truth, whatever their strand. Spark broadcasts the truth if its size allows, and else shuffles both."""
    return sites.join(truth.select("chrom", F.col("start").alias("ref_pos"), "percentage"), SITE)


def read_label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("read_label").agg(F.count("*").alias("n"))


def group_losses(rows: DataFrame) -> DataFrame:
    """Sum over (type, label) groups of their mean losses, and the weighted mean over unmasked places."""
    kept = rows.where(F.col("label") != -100)
    groups = kept.groupBy("methy_type", "label").agg(F.avg("loss").alias("mean")).agg(F.sum("mean").alias("balanced"))
    return groups.crossJoin(kept.agg(F.avg(F.col("loss") * F.col("weight")).alias("weighted")))  # two single rows
