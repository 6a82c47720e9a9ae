"""Text sources and sinks: call TSV, truth BED, FASTA, SAM and fibre tables; bad rows fare as each format's rule has it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def place() -> Column:
    """Where a row of a file source stands: file, then block of the file, then row of the block, as a struct that sorts.

    Tasks hold blocks of several files in any order, but each block's rows in their own.
    """
    row = F.monotonically_increasing_id()
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row.alias("row"))


def _lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Lines of plain or gzipped files, line_no their order by file, then line."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    return reader.text(list(paths) if not isinstance(paths, str) else paths).select("value", place().alias("line_no"))


def parse_calls(lines: DataFrame) -> DataFrame:
    """Calls of lines (value and, if there, line_no): blank, comment, short and uncastable ones are dropped.

    A read position that isn't a number is -1.
    """
    cell = F.split("value", "\t")
    get = lambda i: F.get(F.col("cell"), F.lit(i))
    kept = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("cell", cell).where(F.size("cell") >= 10)
    out = kept.select(
        get(0).alias("chrom"), get(1).try_cast("bigint").alias("ref_pos"), get(2).alias("strand"), get(3).try_cast("int").alias("label"), get(4).alias("read_id"),
        F.when(get(5).rlike("^[0-9]+$"), get(5).try_cast("int")).otherwise(-1).alias("read_pos"), get(6).alias("methy_type"),
        get(7).try_cast("double").alias("prob_unmethylated"), get(8).try_cast("double").alias("prob_methylated"), get(9).try_cast("double").alias("prediction"),
        F.coalesce(get(10), F.lit(".")).alias("kmer"), *(["line_no"] if "line_no" in lines.columns else []),
    )
    return out.dropna(subset=["ref_pos", "label", "prob_unmethylated", "prob_methylated", "prediction"])


def read_calls(spark: SparkSession, paths: str | Sequence[str], *, file_uid: str | None = None, max_lines: int | None = None) -> DataFrame:
    """Calls of files or directories; file_uid keeps file names that contain it, max_lines the first valid rows."""
    calls = parse_calls(_lines(spark, paths, None if file_uid is None else f"*{file_uid}*"))
    return calls if max_lines is None else calls.orderBy("line_no").limit(max_lines)


def parse_mod_records(lines: DataFrame) -> DataFrame:
    """Calls as the frequency tool reads them: the fourth column is the place in the strand ('.' is -1), and bad fields raise."""
    rows = lines.where(F.trim("value") != "").withColumn("cell", F.split("value", "\t"))
    get = lambda i: F.col("cell")[i]
    place_in = F.when(get(3) == ".", "-1").otherwise(get(3))
    return rows.select(
        get(0).alias("chrom"), get(1).cast("bigint").alias("ref_pos"), get(2).alias("strand"), place_in.cast("int").alias("pos_in_strand"), get(4).alias("read_id"),
        get(7).cast("double").alias("prob_unmethylated"), get(8).cast("double").alias("prob_methylated"), get(10).alias("kmer"), *(["line_no"] if "line_no" in lines.columns else []),
    )


def read_mod_records(spark: SparkSession, paths: str | Sequence[str], *, file_uid: str | None = None) -> DataFrame:
    """parse_mod_records() of files or directories; file_uid keeps file names that contain it."""
    return parse_mod_records(_lines(spark, paths, None if file_uid is None else f"*{file_uid}*"))


def read_bed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Truth rows; blank, comment and short lines are dropped, bad numbers raise."""
    rows = _lines(spark, paths).where((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t")).where(F.size("c") >= 11)
    kinds = ("chrom string", "start bigint", "end bigint", "name string", "score string", "strand string", "thick_start bigint", "thick_end bigint", "rgb string", "coverage int", "percentage double")
    return rows.select(*[F.col("c")[i].cast(k.split()[1]).alias(k.split()[0]) for i, k in enumerate(kinds)], "line_no")


def read_fasta(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """contig (up to the first space) and its upper-case sequence, one row each."""
    records = spark.read.option("lineSep", ">").text(paths).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return records.select(F.split(head, r"[ \t]")[0].alias("contig"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")).alias("seq"))


def contig_names(spark: SparkSession, source: str) -> DataFrame:
    """Sorted distinct contigs of a comma-separated list, or of a FASTA or name-per-line file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source) if "," not in source else None
    if path is None or not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([(c,) for c in sorted(set(source.split(",")))], "contig string")
    lines = spark.read.text(source)
    fasta = lines.where(F.col("value").startswith(">"))
    names = fasta.select(F.split(F.substring("value", 2, 1 << 20), " ")[0].alias("contig")) if not fasta.isEmpty() else lines.where(F.trim("value") != "").select(F.trim("value").alias("contig"))
    return names.distinct().orderBy("contig")


def chunked(contigs: DataFrame, *, size: int = 1_000_000, overlap: int = 16) -> DataFrame:
    """Contigs as chunks of bounded size, each with what follows it, keyed by (contig, chunk)."""
    n = F.greatest(F.ceil(F.length("seq") / size).cast("int"), F.lit(1))
    return contigs.select("contig", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"), "seq").select("contig", "chunk", F.expr(f"substring(seq, chunk * {size} + 1, {size + overlap})").alias("seq"))


def _cigar(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct((F.instr(F.lit("MIDNSHP=X"), F.right(p, F.lit(1))) - 1).alias("op"), F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("len")))


def read_sam(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Alignment records of SAM text with the typed tags of the canonical schema; positions become 0-based."""
    rows = _lines(spark, paths).where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("c", F.split("value", "\t"))
    tags = F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0)))
    pairs = F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 28).alias("v")))
    rows = rows.withColumn("t", F.map_from_entries(pairs))
    null = lambda i, bad: F.when(F.col("c")[i] != bad, F.col("c")[i])
    numbers = lambda k: F.transform(F.filter(F.split(F.regexp_replace(F.col("t")[k], "^[a-zA-Z],", ""), ","), lambda x: x != ""), lambda x: x.cast("int"))
    flag = F.col("c")[1].cast("int")
    return rows.select(
        F.col("c")[0].alias("query_name"), F.col("t")["pi"].alias("parent_id"), flag.alias("flag"), null(2, "*").alias("reference_name"), (F.col("c")[3].cast("bigint") - 1).alias("reference_start"),
        F.col("c")[4].cast("int").alias("mapping_quality"), F.when(F.col("c")[5] != "*", _cigar(F.col("c")[5])).alias("cigar"), null(6, "*").alias("next_reference_name"), (F.col("c")[7].cast("bigint") - 1).alias("next_reference_start"),
        F.col("c")[8].cast("int").alias("template_length"), null(9, "*").alias("seq"), null(10, "*").alias("qual"), (flag.bitwiseAND(16) != 0).alias("is_reverse"),
        F.col("t")["ts"].cast("int").alias("ts"), F.col("t")["sp"].cast("int").alias("sp"), numbers("mv").alias("mv"), F.col("t")["sm"].cast("double").alias("sm"), F.col("t")["sd"].cast("double").alias("sd"),
        F.coalesce(F.col("t")["MM"], F.col("t")["Mm"]).alias("mm"), numbers("ML").alias("ml"), numbers("ns").alias("ns"), numbers("nl").alias("nl"),
        F.map_filter("t", lambda k, v: ~k.isin("pi", "ts", "sp", "mv", "sm", "sd", "MM", "Mm", "ML", "ns", "nl", "fi", "fp", "ri", "rp")).alias("tags_extra"), "line_no",
    )


def sam_contigs(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, int]]:
    """(name, length) of the contigs in the headers of SAM text, in their order, the first of equal names; empty without a header."""
    rows = _lines(spark, paths).where(F.col("value").startswith("@SQ\t"))
    field = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]*)", 1)
    found = rows.select(field("SN").alias("name"), field("LN").cast("int").alias("size"), "line_no").groupBy("name").agg(F.min_by("size", "line_no").alias("size"), F.min("line_no").alias("at"))
    return [(r["name"], r["size"]) for r in found.orderBy("at").collect()]  # a row for each contig


def read_fibres(spark: SparkSession, path: str, *, nrows: int = 10_000) -> DataFrame:
    """The first rows of a fibre table with a header; a leading '#' of a name is dropped."""
    raw = spark.read.csv(path, sep="\t", header=True)
    names = [c.lstrip("#") for c in raw.columns]
    first = raw.select("*", place().alias("_place")).orderBy("_place").limit(nrows)
    return first.drop("_place").toDF(*names)


def _number(x: Column, digits: int) -> Column:
    """Digits behind the point, a tie going to the even one."""
    return F.format_string(f"%.{digits}f", F.rint(x * 10**digits) / 10**digits)


def call_lines(calls: DataFrame) -> DataFrame:
    """Calls as the lines of a call file: eleven columns, six digits, the hard call over one half."""
    from ..functions.tags import hard_call

    p1 = F.col("prob_methylated")
    return calls.select(F.concat_ws("\t", "chrom", F.col("ref_pos").cast("string"), "strand", F.col("label").cast("string"), "read_id", F.col("read_pos").cast("string"), "methy_type", _number(F.col("prob_unmethylated"), 6), _number(p1, 6), hard_call(p1).cast("string"), F.lit(".")).alias("value"))


def frequency_lines(sites: DataFrame) -> DataFrame:
    """Site frequencies as lines of eleven columns."""
    text = lambda c: F.col(c).cast("string")
    return sites.select(F.concat_ws("\t", "chrom", text("pos"), "strand", text("pos_in_strand"), _number(F.col("prob_0_sum"), 3), _number(F.col("prob_1_sum"), 3), text("met"), text("unmet"), text("coverage"), _number(F.col("rmet"), 4), "kmer").alias("value"))


def bed_lines(bed: DataFrame) -> DataFrame:
    return bed.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in bed.columns]).alias("value"))


def write_lines(lines: DataFrame, path: str, *, gzip: bool = False, one_file: bool = False) -> None:
    """Lines as text files, gzipped if told or if the path says so; one_file gathers them for small results only."""
    out = lines.coalesce(1) if one_file else lines
    out.write.option("compression", "gzip" if gzip or path.endswith(".gz") else "none").text(path)


def write_by_motif(calls: DataFrame, path: str) -> None:
    """Call lines with a motif column, in one directory for each motif."""
    call_lines(calls).sparkSession  # columns are checked before anything is written
    lines = calls.select("motif", F.concat_ws("\t", *[F.col(c).cast("string") for c in calls.columns if c not in ("motif", "line_no")]).alias("value"))
    lines.write.partitionBy("motif").text(path)


def in_bed_order(bed: DataFrame) -> DataFrame:
    return bed.orderBy("chrom", "start")


def write_by_contig(lines: DataFrame, path: str) -> None:
    """(chrom, value) lines in one directory for each contig; directories sort by contig's name."""
    lines.write.partitionBy("chrom").text(path)
