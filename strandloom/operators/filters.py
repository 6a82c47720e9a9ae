"""Predicates of reads and calls, as expressions or DataFrame filters; all reach the scan where it can take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECONDARY, SUPPLEMENTARY = 0x100, 0x800


def chromosome_filter(rule: str, chrom: Column) -> Column:
    """`exclude|include`, each a comma-separated list; both, neither or no bar means all. An include list drops all others."""
    parts = rule.split("|")
    if len(parts) < 2 or bool(parts[0]) == bool(parts[1]):
        return F.lit(True)
    return ~chrom.isin(parts[0].split(",")) if parts[0] else chrom.isin(parts[1].split(","))


def primary(flag: Column) -> Column:
    return flag.bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0


def mapped_well(mapped: Column, quality: Column, least: int = 0) -> Column:
    """Unaligned reads pass; aligned ones from a quality on."""
    return ~mapped | (quality >= least)


def extractable(reads: DataFrame, *, least: int = 0, chrom: str = "|") -> DataFrame:
    """Reads for feature extraction: primary, well mapped, on wanted contigs; unaligned reads pass the last two."""
    mapped = F.col("reference_name").isNotNull()
    return reads.where(primary(F.col("flag")) & mapped_well(mapped, F.col("mapping_quality"), least) & (~mapped | chromosome_filter(chrom, F.col("reference_name"))))


def labelable(reads: DataFrame, *, least: int = 10) -> DataFrame:
    """Reads that labels are written to: primary, with a sequence, mapped from a quality on."""
    return reads.where(primary(F.col("flag")) & F.col("seq").isNotNull() & (F.col("mapping_quality") >= least))


def callable_call(p0: Column, p1: Column, margin: float = 0.0) -> Column:
    return F.abs(p0 - p1) >= margin


def first_by(df: DataFrame, keys: list[str], order: str, *, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in source order."""
    by = F.col(order).desc() if last else F.col(order)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(by))).where("_n = 1").drop("_n")


def modified_reads(reads: DataFrame, *, order: str = "line_no") -> DataFrame:
    """First alignment of each name that has modification scores."""
    return first_by(reads.where(F.size("ml") > 0), ["query_name"], order)


def patch_length(signals: Column, *, least: int = 50, width: int = 500, bins: int = 15) -> Column:
    """Windows long enough to score and short enough for the last bin."""
    return (F.size(signals) >= least) & (F.size(signals) < width * bins)


def has_label(tokens: Column, mask: int = 12) -> Column:
    return F.exists(tokens, lambda t: t != mask)


def full_fibre(st: Column, en: Column, length: Column, flag: Column | None = None) -> Column:
    """Fibres that mostly lie within their window, or have no window; secondary records apart."""
    whole = (en - st > 0.5 * length) | ((en == 0) & (st == 0))
    return whole if flag is None else whole & (flag <= 16)


def dense_enough(n: Column, last: Column, least: float) -> Column:
    return (last > 0) & (F.try_divide(n, last) > least)


def fully_decided(percentage: Column) -> Column:
    return percentage.isin(0, 100)


def confident(mods: Column, *, least: int = 243) -> Column:
    """Of (pos, score) modifications, those sure enough to be counted."""
    return F.filter(mods, lambda m: m["score"] >= least)


def matched(predictions: Column, bases: Column) -> Column:
    """Reads with as many predictions as bases."""
    return F.size(predictions) == F.size(bases)
