"""Queries over calls, truth and alignments, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags
from ..operators import filters, frequency, metrics, reads, sites
from .views import ALIGNMENTS, CALLS, CHUNK, CONTIGS, TRUTH, alignments, calls, contigs, table, truth

QUERIES, SQL = {}, {}
_SURE = "abs(cast(1000-pm as double)/1000 - cast(pm as double)/1000) >= 0.2"
_LONG = "long"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _milli(total: str):
    return F.rint(F.col(total) * 1000).cast(_LONG)


@query(f"""with {CALLS} select chrom, ref_pos as pos, min_by(strand, line_no) as strand, cast(sum(case when pm>=500 then 1 else 0 end) as bigint) as met,
 cast(sum(case when pm<500 then 1 else 0 end) as bigint) as unmet, count(*) as coverage, cast(sum(pm) as bigint) as s1_pm,
 cast(floor(cast(sum(case when pm>=500 then 1 else 0 end) as double)/count(*)*100) as int) as rmet_floor_pct from calls where {_SURE} group by 1,2""")
def site_frequency(spark, sf_dir):
    s = frequency.site_frequency(calls(spark, sf_dir), prob_cf=0.2)
    return s.select("chrom", "pos", "strand", "met", "unmet", "coverage", _milli("prob_1_sum").alias("s1_pm"), frequency.percentage(F.col("rmet"), use_floor=True).alias("rmet_floor_pct"))


@query(f"with {CALLS} select chrom, ref_pos as pos, count(*) as coverage, cast(sum(pm) as bigint) as s1_pm, cast(floor(cast(sum(pm) as double)/count(*)) as bigint) as rate_pm from calls group by 1,2")
def site_frequency_use_prob(spark, sf_dir):
    s = frequency.site_frequency(calls(spark, sf_dir), use_prob=True)
    return s.select("chrom", "pos", "coverage", _milli("prob_1_sum").alias("s1_pm"), F.floor(_milli("prob_1_sum") / F.col("coverage")).alias("rate_pm"))


def _bed_sql(how: str) -> str:
    return f"""with {CALLS}, s as (select chrom, ref_pos as pos, min_by(strand, line_no) as strand, count(*) as n, cast(sum(case when pm>=500 then 1 else 0 end) as double)/count(*) as r from calls group by 1,2)
 select chrom, pos as start, pos+1 as "end", n as coverage, strand, cast({how} as int) as percentage from s"""


@query(_bed_sql("round_even(r*100+0.001, 0)"))
def bedmethyl(spark, sf_dir):
    return frequency.bedmethyl(frequency.site_frequency(calls(spark, sf_dir))).select("chrom", "start", "end", "coverage", "strand", "percentage")


@query(_bed_sql("floor(r*100)"))
def bedmethyl_floor(spark, sf_dir):
    return frequency.bedmethyl(frequency.site_frequency(calls(spark, sf_dir)), use_floor=True).select("chrom", "start", "end", "coverage", "strand", "percentage")


@query(f"with {CALLS} select cast(sum(case when {_SURE} then 1 else 0 end) as bigint) as used, count(*) as total from calls")
def call_usage(spark, sf_dir):
    return frequency.call_usage(calls(spark, sf_dir), prob_cf=0.2).select("used", "total")


@query(f"with {CALLS} select chrom, count(*) as n from calls where chrom in ('chrA') group by 1")
def chrom_include(spark, sf_dir):
    return calls(spark, sf_dir).where(filters.chromosome_filter("|chrA", F.col("chrom"))).groupBy("chrom").agg(F.count("*").alias("n"))


@query(f"with {CALLS} select chrom, count(*) as n from calls where chrom not in ('chrA') group by 1")
def chrom_exclude(spark, sf_dir):
    return calls(spark, sf_dir).where(filters.chromosome_filter("chrA|", F.col("chrom"))).groupBy("chrom").agg(F.count("*").alias("n"))


@query(f"with {CALLS} select chrom, ref_pos, read_id, case when read_pos%3=0 then -1 else read_pos end as read_pos from calls where pm%5<>0")
def call_scan_valid(spark, sf_dir):
    """Calls written as text lines, a fifth of them broken, and scanned again."""
    from ..sources.text import parse_calls

    c = calls(spark, sf_dir)
    pos = F.when(F.col("read_pos") % 3 == 0, "x").otherwise(F.col("read_pos").cast("string"))
    p1 = F.when(F.col("pm") % 5 == 0, "bad").otherwise((F.col("pm") / 1000).cast("string"))
    line = F.concat_ws("\t", "chrom", F.col("ref_pos").cast("string"), "strand", F.col("label").cast("string"), "read_id", pos, "methy_type", F.lit("0.5"), p1, F.lit("1"), F.lit("."))
    return parse_calls(c.select(line.alias("value"))).select("chrom", "ref_pos", "read_id", "read_pos")


@query(f"with {CALLS} select chrom, ref_pos, label, count(*) as n from calls where label<>-1 group by 1,2,3")
def site_label_check(spark, sf_dir):
    return sites.site_label(calls(spark, sf_dir)).select("chrom", "ref_pos", "label", "n")


@query(f"with {CALLS} select chrom, ref_pos, count(*) as n, cast(sum(case when pm>500 then 1 else 0 end) as bigint) as m from calls where methy_type='[CpG]' group by 1,2 having count(*)>=5")
def site_ratio(spark, sf_dir):
    return sites.site_ratio(calls(spark, sf_dir), methy_type="[CpG]")


@query(f"""with {CALLS}, {TRUTH}, s as (select chrom, ref_pos, count(*) as n, cast(sum(case when pm>500 then 1 else 0 end) as bigint) as m from calls group by 1,2 having count(*)>=5)
 select s.chrom, ref_pos, n, m, percentage from s join truth t on s.chrom=t.chrom and s.ref_pos=t.start where coverage>=5""")
def evaluate_sites(spark, sf_dir):
    return sites.evaluated(sites.site_ratio(calls(spark, sf_dir)), sites.covered(truth(spark, sf_dir)))


@query(f"""with {CALLS}, {TRUTH} select case when percentage=100 then 1 else 0 end as y, pm, count(*) as n from calls c join truth t on c.chrom=t.chrom and c.ref_pos=t.start
 where percentage in (0,100) and coverage>=5 group by 1,2""")
def evaluate_reads(spark, sf_dir):
    known = sites.covered(truth(spark, sf_dir)).where(filters.fully_decided(F.col("percentage")))
    return sites.evaluated(calls(spark, sf_dir), known).groupBy((F.col("percentage") == 100).cast("int").alias("y"), "pm").agg(F.count("*").alias("n"))


_QUOTA = f"""with {CALLS}, r as (select *, count(*) over (partition by chrom, ref_pos) as n,
 row_number() over (partition by chrom, ref_pos order by case when pm>500 then 1 else 0 end desc, line_no) as rk from calls where label<>-1),
 q as (select chrom, ref_pos, read_id, rk, case when rk <= round_even(n*label/cast(100 as double),0) then 100 else 0 end as read_label from r where n>=6)"""


@query(f"{_QUOTA} select chrom, ref_pos, read_id, cast(rk as int) as rk, read_label from q")
def quota_labels(spark, sf_dir):
    return sites.quota_labels(calls(spark, sf_dir)).select("chrom", "ref_pos", "read_id", "rk", "read_label")


@query(f"{_QUOTA} select read_label, count(*) as n from q group by 1")
def quota_label_counts(spark, sf_dir):
    return sites.read_label_counts(sites.quota_labels(calls(spark, sf_dir)))


@query(f"""with {CALLS}, f as (select read_id, read_pos, min_by(pm, line_no) as pm from calls group by 1,2)
 select read_id, min(read_pos) as start, max(read_pos)+1 as "end", cast(count(*) as int) as n, string_agg(cast(read_pos as varchar), ',' order by read_pos) as locs_csv,
 string_agg(cast(pm as varchar), ',' order by read_pos) as pm_csv from f group by 1""")
def per_read_calls(spark, sf_dir):
    p = sites.per_read(calls(spark, sf_dir))
    pm = F.transform("probs", lambda x: F.rint(x * 1000).cast("int").cast("string"))
    return p.select("read_id", "start", "end", "n", F.array_join(F.transform("locs", lambda x: x.cast("string")), ",").alias("locs_csv"), F.array_join(pm, ",").alias("pm_csv"))


@query(f"with {CALLS} select read_id, chrom, ref_pos, max_by(case when pm>500 then 1 else 0 end, line_no) as prediction from calls group by 1,2,3")
def read_results_last(spark, sf_dir):
    return sites.last_results(calls(spark, sf_dir)).select("read_id", "chrom", "ref_pos", "prediction")


@query(f"""with {TRUTH}, u as (select chrom, start, percentage, 0 as o from truth union all select chrom, start+3, 100-percentage, 1 from truth)
 select chrom, start, max_by(percentage, o) as percentage from u group by 1,2""")
def bed_merge_last(spark, sf_dir):
    t = truth(spark, sf_dir)
    return sites.merge_labels([t, t.withColumns({"start": F.col("start") + 3, "percentage": 100 - F.col("percentage")})])


@query(f"""with {TRUTH} select cast(sum(case when chrom<>'chrA' and coverage>=5 then 1 else 0 end) as bigint) as n_kept, cast(sum(case when chrom='chrA' then 1 else 0 end) as bigint) as n_excluded,
 cast(sum(case when chrom<>'chrA' and coverage<5 then 1 else 0 end) as bigint) as n_low_cov from truth""")
def bed_coverage_counters(spark, sf_dir):
    wanted, deep = filters.chromosome_filter("chrA|", F.col("chrom")), F.col("coverage") >= 5
    return truth(spark, sf_dir).agg(F.count_if(wanted & deep).alias("n_kept"), F.count_if(~wanted).alias("n_excluded"), F.count_if(wanted & ~deep).alias("n_low_cov"))


@query(f"""with {ALIGNMENTS}, k as (select unnest([parent_id, query_name]) as read_id from alignments where flag & 2304 = 0) select read_id, count(*) as n_alignments from k where read_id is not null group by 1""")
def read_lookup_multi(spark, sf_dir):
    return reads.lookup(alignments(spark, sf_dir)).groupBy("read_id").agg(F.count("*").alias("n_alignments"))


@query(f"""with {ALIGNMENTS}, {CALLS}, c as (select distinct read_id from calls) select query_name, case when c.read_id is null then 0 else 1 end as has_calls from alignments a left join c on a.query_name=c.read_id""")
def reads_left_calls(spark, sf_dir):
    called = calls(spark, sf_dir).select("read_id", F.lit(1).alias("has")).distinct()
    return reads.with_calls(alignments(spark, sf_dir), called).select("query_name", F.coalesce("has", F.lit(0)).alias("has_calls"))


@query(f"""with {ALIGNMENTS} select query_name from (select query_name from alignments where mapping_quality>=10 intersect select query_name from alignments where flag & 2304 = 0) order by 1 limit 100""")
def common_reads_topk(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return reads.common_reads(a.where("mapping_quality >= 10"), a.where(filters.primary(F.col("flag"))), k=100)


@query(f"""with {ALIGNMENTS} select query_name from alignments where flag & 2304 = 0 and (reference_name is null or (mapping_quality>=20 and reference_name<>'chrN'))""")
def extractable_reads(spark, sf_dir):
    return filters.extractable(alignments(spark, sf_dir), least=20, chrom="chrN|").select("query_name")


@query(f"with {ALIGNMENTS} select query_name from alignments where flag & 2304 = 0 and mapping_quality>=10")
def labelable_reads(spark, sf_dir):
    return filters.labelable(alignments(spark, sf_dir)).select("query_name")


@query(f"with {ALIGNMENTS}, {CALLS} select a.query_name, c.chrom, c.ref_pos, c.pm from alignments a join calls c on a.query_name=c.read_id where a.flag & 2304 = 0 and c.label<>-1 and a.mapping_quality>=10")
def labelled_calls_on_reads(spark, sf_dir):
    own = filters.labelable(alignments(spark, sf_dir)).select("query_name")
    return own.join(calls(spark, sf_dir).where("label <> -1"), F.col("query_name") == F.col("read_id")).select("query_name", "chrom", "ref_pos", "pm")


@query(f"""with {ALIGNMENTS} select rank, query_name from (select query_name, row_number() over (order by case reference_name when 'chrR' then 1 when 'chrA' then 2 when 'chrN' then 3 else 4 end, reference_start, query_name) as rank from alignments) where rank<=200""")
def coordinate_sorted_head(spark, sf_dir):
    from pyspark.sql import Window as W

    head = reads.in_coordinate_order(alignments(spark, sf_dir), ["chrR", "chrA", "chrN"]).select("query_name", "reference_name", "reference_start")
    order = F.expr("case reference_name when 'chrR' then 1 when 'chrA' then 2 when 'chrN' then 3 else 4 end")
    top = head.orderBy(order, "reference_start", "query_name").limit(200)
    return top.select(F.row_number().over(W.orderBy(order, "reference_start", "query_name")).cast(_LONG).alias("rank"), "query_name")


_WINDOW = "case when strand='-' then case when ref_pos-2>=0 then reverse(translate(substr(seq, cast(ref_pos-1 as int), 3),'ACGT','TGCA')) else '' end else substr(seq, cast(ref_pos+1 as int), 3) end"


@query(f"with {CALLS}, {CONTIGS}, w as (select chrom, {_WINDOW} as k from calls join contigs on chrom=contig) select chrom, count(*) as n from w where k in ('CAG','CCG','CTG','CAC','CAT','CAA','CCC','CCA','CCT','CTA','CTC','CTT') group by 1")
def motif_filter(spark, sf_dir):
    """Calls in CHN contexts (N: any base)."""
    return frequency.on_motif(calls(spark, sf_dir), contigs(spark, sf_dir), motif="CHN", size=CHUNK).groupBy("chrom").agg(F.count("*").alias("n"))


@query(f"""with {CALLS}, {CONTIGS}, w as (select {_WINDOW} as k from calls join contigs on chrom=contig),
 m as (select case when substr(k,1,2)='CG' and length(k)=3 then 'CG' when regexp_matches(k,'^C[ACT]G$') then 'CHG' when regexp_matches(k,'^C[ACT][ACT]$') then 'CHH' end as motif from w)
 select motif, count(*) as n from m where motif is not null group by 1""")
def split_by_motif(spark, sf_dir):
    return frequency.by_motif(calls(spark, sf_dir), contigs(spark, sf_dir), size=CHUNK).groupBy("motif").agg(F.count("*").alias("n"))


@query(f"""with {CALLS}, t as (select case when label=-1 then 12 when label<=20 then 11 when label>=80 then 10 else 12 end as token, label from calls)
 select token, count(*) as n, round(sum(case when token=12 then 0 else 10*power((label-50)/cast(50 as double),2) end), 3) as weight_sum from t group by 1""")
def label_tokens(spark, sf_dir):
    label = F.col("label")
    return calls(spark, sf_dir).groupBy(tags.label_token(label, 20, 80).alias("token")).agg(F.count("*").alias("n"), F.round(F.sum(tags.label_weight(label, 20, 80)), 3).alias("weight_sum"))


@query(f"""with {CALLS}, s as (select chrom, ref_pos, avg(case when pm>500 then 1.0 else 0.0 end) as pred, count(*) as n from calls group by 1,2 having count(*)>=5), {TRUTH},
 j as (select percentage/cast(100 as double) as a, cast(pred as double) as b from s join truth t on s.chrom=t.chrom and s.ref_pos=t.start where coverage>=5),
 r as (select a, b, rank() over (order by a) + (count(*) over (partition by a)-1)/2.0 as ra, rank() over (order by b) + (count(*) over (partition by b)-1)/2.0 as rb from j)
 select count(*) as sites, round(corr(a,b),4) as pearson, round(corr(a,b)*corr(a,b),4) as rsquare, round(corr(ra,rb),4) as spearman, round(sqrt(avg((a-b)*(a-b))),4) as rmse from r""")
def correlation_metrics(spark, sf_dir):
    joined = sites.evaluated(sites.site_ratio(calls(spark, sf_dir)), sites.covered(truth(spark, sf_dir)))
    return metrics.correlation(joined.select((F.col("percentage") / F.lit(100.0)).alias("truth"), (F.col("m") / F.col("n")).alias("pred")))


@query("""with q as (select l_quantity as x, count(*) as w from lineitem group by 1), s as (select stddev_samp(l_quantity) as s1, stddev_pop(l_quantity) as s0, count(*) as n from lineitem),
 g as (select unnest(range(1000))*(cast(500 as double)/999) as pt),
 d as (select pt, sum(w*exp(-power(x-pt,2)/(2*power(2*s1/s0,2))))/max(n)/max(2*s1/s0)/sqrt(2*pi()) as density from g, q, s group by 1)
 select round(pt,4) as peak, round(density,6) as density from d order by density desc, pt limit 1""")
def kde_peak(spark, sf_dir):
    d = metrics.density(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x")))
    return d.orderBy(F.col("density").desc(), "at").limit(1).select(F.round("at", 4).alias("peak"), F.round("density", 6).alias("density"))


@query(f"with {CALLS} select read_id, read_pos, pm, round(1/(1+exp(-cast(pm-500 as double)/100)),6) as p, case when 1/(1+exp(-cast(pm-500 as double)/100))>0.5 then 1 else 0 end as hard from calls")
def softmax_calls(spark, sf_dir):
    p = tags.softmax_probability(F.lit(0.0), (F.col("pm") - 500).cast("double") / 100)
    return calls(spark, sf_dir).select("read_id", "read_pos", "pm", F.round(p, 6).alias("p"), tags.hard_call(p).alias("hard"))


@query("""with r as (select quality as y, n_chars%1001 as s from labels l join documents d on l.doc_id=d.doc_id) select cast(sum(case when s>500 and y=1 then 1 else 0 end) as bigint) as tp, cast(sum(case when s>500 and y=0 then 1 else 0 end) as bigint) as fp,
 cast(sum(case when s<=500 and y=1 then 1 else 0 end) as bigint) as fn, cast(sum(case when s<=500 and y=0 then 1 else 0 end) as bigint) as tn,
 round(avg(case when (s>500)=(y=1) then cast(1 as double) else 0 end),4) as accuracy from r""")
def classification_metrics(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), threshold=500).select("tp", "fp", "fn", "tn", "accuracy")


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") % 1001).alias("score"))


@query("""with r as (select quality as y, n_chars%1001 as s from labels l join documents d on l.doc_id=d.doc_id), g as (select s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from r group by 1),
 c as (select s, p, n, sum(p) over (order by s desc) as tp, sum(n) over (order by s desc) as fp, sum(p) over () as ap, sum(n) over () as an from g),
 e as (select *, tp/(tp+fp) as pr, case when tp-p+fp-n>0 then (tp-p)/(tp-p+fp-n) else 1 end as pb from c)
 select cast(max(ap) as bigint) as positives, cast(max(an) as bigint) as negatives, round(sum((tp-p/2)*n)/max(ap)/max(an),4) as roc_auc, round(sum(p*(pr+pb)/2)/max(ap),4) as pr_auc from e""")
def roc_pr(spark, sf_dir):
    return metrics.areas(_scored(spark, sf_dir)).select("positives", "negatives", "roc_auc", "pr_auc")


@query("select conv_id, count(distinct turn) as got, max(turn)+1 as expected, count(distinct turn)=max(turn)+1 as complete from conversations group by 1")
def read_completeness(spark, sf_dir):
    own = table(spark, sf_dir, "conversations")
    total = own.groupBy("conv_id").agg((F.max("turn") + 1).alias("total_patches"))
    patches = own.join(total, "conv_id").select(F.col("conv_id").alias("read_id"), F.col("turn").alias("patch_idx"), "total_patches")
    return reads.complete(patches).withColumnRenamed("read_id", "conv_id")


@query(f"""with {CALLS}, g as (select methy_type, label, avg(pm/cast(1000 as double)) as m from calls group by 1,2) select round((select sum(m) from g),4) as balanced, round(avg(pm/cast(1000 as double)*(1+ref_pos%3)),4) as weighted from calls""")
def loss_groups(spark, sf_dir):
    rows = calls(spark, sf_dir).select("methy_type", "label", F.col("prob_methylated").alias("loss"), (1 + F.col("ref_pos") % 3).alias("weight"))
    return sites.group_losses(rows).select(F.round("balanced", 4).alias("balanced"), F.round("weighted", 4).alias("weighted"))
