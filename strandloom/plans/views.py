"""The driver's tables seen as calls, truth, reads and signals, in Spark and as SQL text with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = ("ACGT" * 7)[:26] + "AC" + ("ACGT" * 6)
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as calls; line_no is a struct that orders rows like a source would."""
    key = F.col("l_partkey")
    pm = (F.rint(F.col("l_extendedprice") * 100).cast("long") % 1001).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("[CpG]", "[CHG]", "[CHH]", "[m6A]"))), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), "l_returnflag").alias("chrom"), key.alias("ref_pos"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"),
        F.when(key % 7 == 0, -1).otherwise((key * 37) % 11 * 10).cast("int").alias("label"), F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("read_id"),
        (F.col("l_linenumber") * 1000 + F.col("l_quantity")).cast("int").alias("read_pos"), kind.alias("methy_type"), pm.alias("pm"),
        ((1000 - pm) / F.lit(1000.0)).alias("prob_unmethylated"), (pm / F.lit(1000.0)).alias("prob_methylated"), (pm > 500).cast("int").alias("prediction"),
        F.lit(".").alias("kmer"), F.struct(*_LINE).alias("line_no"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    chrom = F.concat(F.lit("chr"), F.substring(F.lit("ANR"), (key % 3 + 1).cast("int"), F.lit(1)))
    return table(spark, sf_dir, "part").select(chrom.alias("chrom"), key.alias("start"), F.col("p_size").alias("coverage"), ((key * 37) % 11 * 10).cast("int").alias("percentage"), key.alias("line_no"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as DNA: letters dealt to ACGT, all else dropped. Exploding one element keeps it from being computed again for every use."""
    seq = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _FROM, _TO), "[^ACGT]", "")
    own = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return own.select("doc_id", F.explode(F.array(seq)).alias("seq"))


#: Bases of a chunk of contigs(), a multiple of the period.
CHUNK = 900


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three contigs of one period each in chunks with 18 bases of overlap, up to the largest position of calls."""
    periods = spark.createDataFrame([("chrA", "ACGCAGCTT"), ("chrN", "CCGTCAGAT"), ("chrR", "GCTTACGCA")], "contig string, period string")
    last = table(spark, sf_dir, "lineitem").agg(F.floor(F.coalesce(F.max("l_partkey"), F.lit(0)) / CHUNK).cast("long").alias("last"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("last", F.lit(0)))).alias("chunk")
    return periods.crossJoin(last).select("contig", chunk, F.repeat("period", F.lit(CHUNK // 9 + 2)).alias("seq"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as alignment records."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("r"), k.cast("string"))
    return table(spark, sf_dir, "orders").select(
        name.alias("query_name"), F.when(k % 4 == 0, F.concat(F.lit("p"), (k % 1000).cast("string"))).alias("parent_id"),
        F.when(k % 10 == 0, 256).when(k % 17 == 0, 2048).otherwise(0).alias("flag"), (c % 60).cast("int").alias("mapping_quality"),
        F.when(k % 13 != 0, F.concat(F.lit("chr"), F.substring(F.lit("ANR"), (c % 3 + 1).cast("int"), F.lit(1)))).alias("reference_name"),
        c.alias("reference_start"), F.lit("ACGT").alias("seq"), F.col("o_orderstatus").alias("status"), k.alias("line_no"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("signal"))


#: The same in DuckDB's SQL.
CALLS = """calls as (select 'chr'||l_returnflag as chrom, l_partkey as ref_pos, case when l_linestatus='F' then '+' else '-' end as strand,
 case when l_partkey%7=0 then -1 else cast(((l_partkey*37)%11)*10 as int) end as label, 'r'||cast(l_orderkey as varchar) as read_id,
 cast(l_linenumber*1000+l_quantity as int) as read_pos,
 case l_partkey%4 when 0 then '[CpG]' when 1 then '[CHG]' when 2 then '[CHH]' else '[m6A]' end as methy_type,
 cast(cast(round_even(l_extendedprice*100,0) as bigint)%1001 as int) as pm,
 row_number() over (order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) as line_no
 from lineitem)"""
TRUTH = """truth as (select 'chr'||substr('ANR',cast(p_partkey%3 as int)+1,1) as chrom, p_partkey as start, p_size as coverage,
 cast((p_partkey*37)%11*10 as int) as percentage from part)"""
SEQUENCES = f"""reads as (select doc_id, regexp_replace(translate(coalesce(text,''),'{_FROM}','{_TO}'),'[^ACGT]','','g') as seq from documents)"""
CONTIGS = """contigs as (select * from (values ('chrA', repeat('ACGCAGCTT',4000)), ('chrN', repeat('CCGTCAGAT',4000)), ('chrR', repeat('GCTTACGCA',4000))) t(contig, seq))"""
ALIGNMENTS = """alignments as (select 'r'||cast(o_orderkey as varchar) as query_name, case when o_orderkey%4=0 then 'p'||cast(o_orderkey%1000 as varchar) end as parent_id,
 case when o_orderkey%10=0 then 256 when o_orderkey%17=0 then 2048 else 0 end as flag, cast(o_custkey%60 as int) as mapping_quality,
 case when o_orderkey%13<>0 then 'chr'||substr('ANR',cast(o_custkey%3 as int)+1,1) end as reference_name, o_custkey as reference_start,
 o_orderstatus as status, o_orderkey as line_no from orders)"""
