"""Raw-signal sources: paths by suffix, and SLOW5 text with the names its columns may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import calibration_scale
from .text import place

#: Suffixes of the containers, and names that a field may have, the first that is there counts. Fixed values.
POD5, SLOW5 = (".pod5",), (".slow5", ".blow5")
READ_ID, SIGNAL, DIGITISATION = ("read_id", "readID", "read_name"), ("signal", "raw_signal", "raw_signal_pa"), ("digitisation", "digitization")
COLUMNS = ("read_id", "read_group", "digitisation", "offset", "range", "sampling_rate", "len_raw_signal", "raw_signal")


def signal_paths(spark: SparkSession, path: str, *, suffixes: tuple[str, ...] = POD5 + SLOW5) -> list[str]:
    """Sorted signal files below a folder, at any depth and in any case of suffix, or the file itself; none, or a foreign suffix, raises."""
    wanted = tuple(s.lower() if s.startswith(".") else f".{s.lower()}" for s in suffixes)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.getFileStatus(hadoop).isDirectory():
        if not path.lower().endswith(wanted):
            raise ValueError(f"not a signal file of {', '.join(wanted)}: {path}")
        return [path]
    found, listed = [], files.listFiles(hadoop, True)
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if name.lower().endswith(wanted):
            found.append(name)
    if not found:
        raise FileNotFoundError(f"no file of {', '.join(wanted)} below {path}")
    return sorted(found)


def flat_read_ids(json: Column) -> Column:
    """The strings of a JSON list of read ids, however nested, in order; all else is left out."""
    quoted = F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
    return F.transform(quoted, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))


def read_slow5(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Signals of SLOW5 text: read_id, signal, cal_offset, cal_scale (range over digitisation).

    Each file's header names its columns, by any of the names a field may have; without one they stand
    in the format's order. Missing digitisation, offset and range are 1, 0 and the digitisation.
    """
    lines = spark.read.text(paths).select("value", place().alias("line_no"), F.col("_metadata.file_path").alias("file"))
    heads = lines.where(F.col("value").startswith("#") & F.col("value").contains("\t") & F.split(F.substring("value", 2, 1 << 20), "\t")[0].isin(*READ_ID))
    heads = heads.groupBy(F.col("file").alias("_file")).agg(F.min_by("value", "line_no").alias("head"))  # a row for each file
    rows = lines.where(~F.col("value").rlike("^[#@]") & (F.col("value") != "")).join(heads, F.col("file") == F.col("_file"), "left")
    names = F.coalesce(F.split(F.substring("head", 2, 1 << 20), "\t"), F.array(*map(F.lit, COLUMNS)))
    rows = rows.withColumn("c", F.split("value", "\t")).withColumn("names", names)

    def cell(*known: str) -> Column:
        places = [F.nullif(F.array_position("names", k), F.lit(0)).cast("int") for k in known]
        return F.get("c", F.coalesce(*places, F.lit(0)) - 1)

    digits = F.coalesce(cell(*DIGITISATION).try_cast("double"), F.lit(1.0))
    signal = F.transform(F.split(cell(*SIGNAL), ","), lambda x: x.cast("float"))
    scale = calibration_scale(F.coalesce(cell("range").try_cast("double"), digits), digits)
    return rows.select(cell(*READ_ID).alias("read_id"), signal.alias("signal"), F.coalesce(cell("offset").try_cast("double"), F.lit(0.0)).alias("cal_offset"), scale.alias("cal_scale"))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals of a file or folder by suffix. The binary containers need readers that aren't part of this package: give their `signals` table instead."""
    paths = signal_paths(spark, path)
    binary = [p for p in paths if not p.lower().endswith(".slow5")]
    if binary:
        raise NotImplementedError(f"no reader of this container is here: {binary[0]}")
    return read_slow5(spark, paths)
