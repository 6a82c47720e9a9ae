"""Evaluation of calls against truth, comparison of methods, and fibre statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from . import filters, metrics, sites


def evaluate(calls: DataFrame, truth: DataFrame, *, methy_type: str | None = None, least: int = 5) -> dict[str, DataFrame]:
    """site: correlation of ratios with truth; read: classification and areas at fully (un)methylated sites."""
    known = sites.covered(truth, least=least)
    at = sites.evaluated(sites.site_ratio(calls, methy_type=methy_type, least=least), known)
    own = calls if methy_type is None else calls.where(F.col("methy_type") == methy_type)
    reads = sites.evaluated(own.where(F.col("ref_pos") != -1), known.where(filters.fully_decided(F.col("percentage"))))
    reads = reads.select((F.col("percentage") == 100).cast("int").alias("y"), F.col("prob_methylated").alias("score"))
    return {
        "site": metrics.correlation(at.select((F.col("percentage") / F.lit(100.0)).alias("truth"), (F.col("m") / F.col("n")).alias("pred"))),
        "read": metrics.confusion(reads), "areas": metrics.areas(reads),
    }


def compare(calls: DataFrame, baseline: DataFrame, *, threshold: float = 0.5, order: str = "line_no") -> DataFrame:
    """Reads, sites and methylated ratios of predictions and of a baseline (read_id, read_pos, score 0..255) at the same places."""
    last = calls.groupBy("read_id", "read_pos").agg(F.max_by("prob_methylated", order).alias("p"))
    both = last.join(baseline.select("read_id", "read_pos", "score"), ["read_id", "read_pos"])
    mine, theirs = F.count_if(F.col("p") > threshold), F.count_if(F.col("score") > 127)
    return both.agg(F.count_distinct("read_id").alias("reads"), F.count("*").alias("sites"), mine.alias("methylated"), theirs.alias("baseline_methylated")).select("reads", "sites", F.try_divide("methylated", "sites").alias("ratio"), F.try_divide("baseline_methylated", "sites").alias("baseline_ratio"))


def fibre_records(table: DataFrame, *, min_freq: float = 0.02) -> DataFrame:
    """Full-length fibres of a fibre table with their marked positions, dense enough, and nucleosome lengths."""
    flag = F.col("sam_flag").cast("int") if "sam_flag" in table.columns else None
    st, en, length = (F.col(c).cast("long") for c in ("st", "en", "fiber_length"))
    kept = table.where(filters.full_fibre(st, en, length, flag)).where(F.col("m6a").contains(",") & F.col("m6a_qual").contains(","))
    kept = kept.select(tags.ints(F.col("m6a")).alias("m6a"), tags.ints(F.col("nuc_lengths")).alias("nuc_lengths"))
    return kept.where(filters.dense_enough(F.size("m6a"), F.array_max("m6a"), min_freq))


def fibre_totals(fibres: DataFrame) -> DataFrame:
    """Reads, marked positions, all positions and nucleosomes."""
    return fibres.agg(F.count("*").alias("reads"), F.sum(F.size("m6a")).alias("marked"), F.sum(F.array_max("m6a") + 1).alias("positions"), F.sum(F.size("nuc_lengths")).alias("nucleosomes"))


def nucleosome_density(fibres: DataFrame) -> DataFrame:
    return metrics.density(fibres.select(F.explode("nuc_lengths").alias("x")))
