"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: ANSI casts, adaptive plans with skewed joins split, and one time zone.
CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "strandloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many tasks as there are cores: a scan of one row group is dealt out before costly expressions, a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
