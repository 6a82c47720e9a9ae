"""Running sums, numbers and samples over an order, taken band by band so that no task holds the whole order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, order: str, sums: dict[str, str], *, by: tuple[str, ...] = (), descending: bool = False, bands: int = 256, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each new name of sums, the sum of a column over all rows up to this one in the order of a numeric column.

    The order's span is cut into bands; bands are summed apart, their totals added up (as many rows as
    bands and `by` groups), and rows are summed inside their band. Equal values are ordered by ties, or
    summed together without any.
    """
    value = F.col(order).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    span = (high - low) or 1.0 if low is not None else 1.0
    rows = df.withColumn("_band", F.least(F.floor((value - F.lit(low or 0.0)) / F.lit(span) * bands), F.lit(bands - 1)))
    turn = (lambda c: F.col(c).desc()) if descending else F.col
    earlier = W.partitionBy(*by).orderBy(turn("_band"))
    totals = rows.groupBy(*by, "_band").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*by, "_band", *[(F.sum(f"_t_{n}").over(earlier) - F.col(f"_t_{n}")).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy(*by, "_band").orderBy(turn(order), *ties)
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow) if ties else inside
    joined = rows.join(totals, [*by, "_band"]) if not by else rows.join(totals.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_band").alias("_k_band"), *[f"_b_{n}" for n in sums]), reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.col("_band") == F.col("_k_band")))
    out = joined.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_b_{n}")).alias(n) for n, c in sums.items()])
    return out


def numbered(df: DataFrame, order: str, *, by: tuple[str, ...] = (), name: str = "ordinal", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's 0-based place in the order, in each group of by; ties must tell equal rows apart."""
    one = running(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, by=by, ties=(*ties, order))
    return one.withColumn(name, F.col(name) - 1).drop("_one")


def interleaved(sources: list[DataFrame], order: str, *, ties: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of all sources, then the second ones, and so on; longer sources go on alone."""
    each = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, each)
    return numbered(rows, order, by=("source",), ties=ties).orderBy("ordinal", "source")


def first_per_source(rows: DataFrame, order: str, *, total: int = 5000, source: str = "source", sources: int | None = None) -> DataFrame:
    """The first total // sources rows of each source; each task keeps no more than that of a source before the shuffle."""
    n = sources or rows.select(source).distinct().count()
    rank = F.row_number().over(W.partitionBy(source).orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= total // max(n, 1)).drop("_rank")


def first_batches(rows: DataFrame, batches: int, *, batch_size: int, order: tuple[str, ...]) -> DataFrame:
    """The rows of the first batches in an order."""
    return rows.orderBy(*order).limit(batches * batch_size)
