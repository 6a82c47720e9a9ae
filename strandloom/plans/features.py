"""Queries over extraction, re-anchoring, tags, samples and orders, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, signal, tags
from ..operators import evaluation, extraction, filters, frequency, metrics, modbam, ordering, reads, sites
from ..sources import text
from .views import ALIGNMENTS, CALLS, SEQUENCES, TRUTH, alignments, calls, sequences, signals, table, truth

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _csv(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def _moves():
    """A move table of stride 4 from each vector: a base starts at 0 and at each positive component of the next 14."""
    return F.concat(F.array(F.lit(4), F.lit(1)), F.transform(F.slice("signal", 2, 14), lambda x: (x > 0).cast("int")))


_SEGMENTS = """m as (select vec_id, embedding, unnest(range(15)) as k from embeddings), b as (select vec_id, k*4+2 as bp from m where k=0 or embedding[k+1]>0),
 s as (select vec_id, row_number() over (partition by vec_id order by bp)-1 as i, bp, lead(bp,1,64) over (partition by vec_id order by bp) as nx from b)"""


def _cigar(ops: list[tuple[int, int]]):
    return F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in ops])


#: Four CIGARs by rule; 4 clips, 1 inserts, 2 deletes.
_CIGARS = (((4, 2), (0, 5), (1, 1), (0, 4), (2, 2), (0, 3)), ((0, 6),), ((1, 2), (0, 4), (2, 1), (0, 2), (4, 3)), ((4, 4),))
_PAIRS = f"""o(v, op, len, ord) as (values {", ".join(f"({v},{op},{n},{i})" for v, c in enumerate(_CIGARS) for i, (op, n) in enumerate(c))}),
 e as (select v, op, row_number() over (partition by v order by ord, j) - 1 as k from (select v, op, ord, unnest(range(len)) as j from o)),
 f as (select v, k, case when op in (0,1,4) then sum(case when op in (0,1,4) then 1 else 0 end) over (partition by v order by k) - 1 end as q,
 case when op in (0,2) then sum(case when op in (0,2) then 1 else 0 end) over (partition by v order by k) - 1 end as r from e)"""


def _pairs(spark, sf_dir):
    v = F.col("vec_id") % 4
    cigar = F.when(v == 0, _cigar(_CIGARS[0])).when(v == 1, _cigar(_CIGARS[1])).when(v == 2, _cigar(_CIGARS[2])).otherwise(_cigar(_CIGARS[3]))
    return table(spark, sf_dir, "embeddings").select("vec_id", reads.aligned_pairs(cigar, F.col("vec_id")).alias("pairs"))


@query(f"with {_PAIRS} select vec_id, cast(k as int) as k, cast(q as int) as q, cast(vec_id+r as bigint) as ref_pos from embeddings join f on vec_id%4=v")
def aligned_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.posexplode("pairs").alias("k", "p")).select("vec_id", "k", "p.q", F.col("p.r").alias("ref_pos"))


@query(f"""with {_PAIRS}, g as (select v, min(case when r is not null then k end) as a, max(case when r is not null then k end) as b from f group by 1),
 n as (select f.v, k, q, r, case when a is null or k<a or k>b then q is not null else r is not null end as new from f join g on f.v=g.v),
 h as (select *, sum(case when new then 1 else 0 end) over (partition by v order by k) - 1 as base_idx from n),
 a as (select v, base_idx, max(case when new then q end) as q, max(case when new then r end) as r, sum(case when not new and q is not null then 1 else 0 end) as x from h where base_idx>=0 group by 1,2)
 select vec_id, cast(base_idx as int) as base_idx, cast(q as int) as q, cast(vec_id+r as bigint) as ref_pos, cast(x as int) as n_extra from embeddings join a on vec_id%4=v""")
def reanchored_reads(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("vec_id", F.posexplode(reads.reanchored(F.col("pairs"))).alias("base_idx", "b"))
    return rows.select("vec_id", "base_idx", "b.q", "b.ref_pos", F.size("b.extra").alias("n_extra"))


@query(f"with {_SEGMENTS}, x as (select vec_id, i, bp-2+unnest(range(nx-bp)) as t from s) select vec_id, cast(count(*) as int) as n, cast(sum(i) as bigint) as total from x where t%3=0 group by 1")
def signal_positions(spark, sf_dir):
    lens = F.transform(signal.segments(signal.move_bounds(_moves(), F.lit(2), F.size("signal"))), lambda s: s["len"])
    rows = signals(spark, sf_dir).select("vec_id", signal.signal_index(lens, 3).alias("x"))
    return rows.select("vec_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, i: a + i).alias("total"))


_WINDOWS = f"""with {_SEGMENTS}, n as (select vec_id, count(*) as n from s group by 1), x as (select vec_id, n, substr(repeat('CGACTGCAT',3), cast(vec_id%9 as int)+1, cast(n as int)) as x from n),
 q as (select vec_id, n, case when vec_id%2=1 then reverse(translate(x,'ACGT','TGCA')) else x end as fwd from x),
 t as (select s.vec_id, i, nx-bp as len, n, substr(fwd, cast(i+1 as int), 1) as x, substr(fwd, cast(i+2 as int), 1) as y, substr(fwd, cast(i+3 as int), 1) as z from s join q on s.vec_id=q.vec_id),
 c as (select *, case when x='C' and (y='G' or z<>'') then 1 else 0 end as site from t),
 p as (select *, i + coalesce(sum(site) over (partition by vec_id order by i rows between unbounded preceding and 1 preceding), 0) as tp from c),
 l as (select vec_id, n+sum(site) as size, sum(site) as ns from c group by vec_id, n),
 w as (select vec_id, size, unnest(case when size<=4 then case when ns>0 then cast([0] as bigint[]) else cast([] as bigint[]) end else range(0, cast(size-4 as bigint), 4) end) as s from l),
 o as (select p.*, size, case when tp+1<6 then 0 else least(floor((tp-1)/cast(4 as double)), greatest(ceil((size-4)/cast(4 as double))-1, 0)) end as own from p join l on p.vec_id=l.vec_id)
 select w.vec_id, cast(s//4 as int) as patch_idx, cast(least(8, w.size-s)+1 as int) as n_ids, cast(sum(case when tp>=s and tp<s+8 then len else 0 end) as int) as n_samples,
 cast(sum(case when site=1 and own=s//4 then 1 else 0 end) as int) as n_sites, cast(sum(case when site=1 and own=s//4 then i else 0 end) as bigint) as read_pos_sum,
 cast(sum(case when site=1 and own=s//4 then case when w.vec_id%3=0 then -1 else w.vec_id + case when w.vec_id%2=1 then n-1-i else i end end else 0 end) as bigint) as ref_pos_sum
 from w join o on w.vec_id=o.vec_id group by w.vec_id, s, w.size"""


def _extracted(spark, sf_dir):
    own = signals(spark, sf_dir).withColumn("mv", _moves())
    k, n = F.col("vec_id"), F.size("mv") - 1 - F.size(F.filter(F.slice("mv", 2, 15), lambda m: m == 0))
    name = F.concat(F.lit("s"), k.cast("string"))
    back = k % 2 == 1
    rows = own.select(
        name.alias("query_name"), F.lit(None).cast("string").alias("parent_id"), F.when(back, 16).otherwise(0).alias("flag"), F.when(k % 3 != 0, "chr1").alias("reference_name"), k.alias("reference_start"),
        F.lit(60).alias("mapping_quality"), F.array(F.struct(F.lit(0).alias("op"), n.alias("len"))).alias("cigar"), F.substring(F.lit("CGACTGCAT" * 3), (k % 9 + 1).cast("int"), n).alias("seq"), back.alias("is_reverse"),
        F.lit(2).alias("ts"), F.lit(None).cast("int").alias("sp"), "mv", F.lit(0.2).alias("sm"), F.lit(0.5).alias("sd"), F.lit(None).cast("string").alias("mm"), F.lit(None).cast("array<int>").alias("ml"),
    )
    raw = own.select(name.alias("read_id"), F.col("signal").cast("array<float>").alias("signal"), F.lit(3.0).alias("cal_offset"), F.lit(2.0).alias("cal_scale"))
    return extraction.windows(extraction.features(raw, rows, least=20, cpg=True, chg=True, chh=True), chunk=8, overlap=2)


@query(_WINDOWS)
def extraction_windows(spark, sf_dir):
    w = _extracted(spark, sf_dir)
    total = lambda c: F.aggregate(F.transform("sites", lambda s: s[c].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select(F.substring("read_id", 2, 20).cast("long").alias("vec_id"), "patch_idx", F.size("ids").alias("n_ids"), F.size("signals").alias("n_samples"), F.size("sites").alias("n_sites"), total("read_pos").alias("read_pos_sum"), total("ref_pos").alias("ref_pos_sum"))


#: Reads of 64 bases, every other one reversed, the first three bases clipped; ranks 0, 3 and 5 of their C's are marked.
_BLOCK, _BACK = "ACGTCCGA", "TCGGACGT"


def _tagged(spark, sf_dir):
    k, back = F.col("vec_id"), F.col("vec_id") % 2 == 1
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), k.cast("string")).alias("query_name"), F.lit(None).cast("string").alias("parent_id"), F.when(k % 5 == 0, 256).otherwise(0).alias("flag"), F.lit("chr1").alias("reference_name"), k.alias("reference_start"), F.lit(60).alias("mapping_quality"),
        _cigar([(4, 3), (0, 61)]).alias("cigar"), F.lit(_BLOCK * 8).alias("seq"), back.alias("is_reverse"), F.lit("C+m,0,2,1;").alias("mm"), F.array(F.lit(255), (k % 256).cast("int"), F.lit(7)).alias("ml"),
        F.lit(None).cast("array<int>").alias("ns"), F.lit(None).cast("array<int>").alias("nl"), k.alias("line_no"),
    )


@query("""with t(par, o, i) as (values (0,6,2),(0,10,3),(1,59,1),(1,47,2),(1,39,3)) select 's'||cast(vec_id as varchar) as read_id, 'chr1' as chrom, cast(vec_id+o as bigint) as ref_pos,
 cast(case i when 1 then 255 when 2 then vec_id%256 else 7 end as int) as score from embeddings join t on vec_id%2=par where vec_id%5<>0""")
def tagged_site_predictions(spark, sf_dir):
    found = modbam.site_predictions(filters.modified_reads(_tagged(spark, sf_dir)))
    return found.select("read_id", "chrom", "ref_pos", F.rint(F.col("prob") * 255).cast("int").alias("score"))


_LABELLED = f"""with c as (select par, p, row_number() over (partition by par order by p)-1 as rank from (select par, s, unnest(range(64)) as p from (values (0, repeat('{_BLOCK}',8)), (1, repeat('{_BACK}',8))) t(par, s)) where substr(s, cast(p+1 as int), 1)='C'),
 a as (select vec_id, p, rank, vec_id + case when par=0 then p else 63-p end - 3 as pos from embeddings join c on vec_id%2=par where vec_id%5<>0 and case when par=0 then p else 63-p end >= 3),
 k as (select vec_id, p, rank - coalesce(lag(rank) over (partition by vec_id order by p), -1) - 1 as skip, cast(round_even(pos%101*255/cast(100 as double),0) as int) as ml from a where pos%2=0)
 select 's'||cast(vec_id as varchar) as query_name, 'C+m,'||string_agg(cast(skip as varchar), ',' order by p)||';' as mm, string_agg(cast(ml as varchar), ',' order by p) as ml_csv from k group by 1"""


@query(_LABELLED)
def label_tags_sites(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.explode(F.sequence("vec_id", F.col("vec_id") + 64)).alias("pos")).where("pos % 2 = 0").distinct()
    labels = own.select(F.lit("chr1").alias("chrom"), "pos", (F.col("pos") % 101).alias("score"))
    return modbam.label_tags(_tagged(spark, sf_dir), labels).select("query_name", "mm", _csv("ml").alias("ml_csv"))


@query(_LABELLED)
def label_tags_reads(spark, sf_dir):
    """The same labels told read by read."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence("vec_id", F.col("vec_id") + 64)).alias("pos")).where("pos % 2 = 0")
    labels = own.select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("read_id"), F.lit("chr1").alias("chrom"), "pos", (F.col("pos") % 101).alias("label"))
    return modbam.label_tags(_tagged(spark, sf_dir), labels).select("query_name", "mm", _csv("ml").alias("ml_csv"))


@query(f"""with c as (select par, p, row_number() over (partition by par order by p)-1 as rank from (select par, s, unnest(range(64)) as p from (values (0, repeat('{_BLOCK}',8)), (1, repeat('{_BACK}',8))) t(par, s)) where substr(s, cast(p+1 as int), 1)='C'),
 a as (select vec_id, p, rank, case when rank=0 then 255 when rank=3 then vec_id%256 when rank=5 then 7 else 0 end as score from embeddings join c on vec_id%2=par where vec_id%5<>0),
 l as (select *, case when score>=229 then 100 when score=0 then 0 end as label from a),
 k as (select vec_id, p, rank - coalesce(lag(rank) over (partition by vec_id order by p), -1) - 1 as skip, case when label=100 then 255 else 0 end as ml from l where label is not null)
 select 's'||cast(vec_id as varchar) as query_name, 'C+m,'||string_agg(cast(skip as varchar), ',' order by p)||';' as mm, string_agg(cast(ml as varchar), ',' order by p) as ml_csv from k group by 1""")
def training_tags(spark, sf_dir):
    return modbam.training_tags(_tagged(spark, sf_dir), kind="m").select("query_name", "mm", _csv("ml").alias("ml_csv"))


@query(f"""with {CALLS}, l as (select read_id, read_pos, max_by(pm, line_no) as pm from calls group by 1,2), b as (select read_id, read_pos, max(pm%256) as score from calls where pm%3=0 group by 1,2),
 j as (select l.read_id, pm, score from l join b on l.read_id=b.read_id and l.read_pos=b.read_pos)
 select count(distinct read_id) as reads, count(*) as sites, round(avg(case when pm>500 then cast(1 as double) else 0 end),6) as ratio, round(avg(case when score>127 then cast(1 as double) else 0 end),6) as baseline_ratio from j""")
def compared_methods(spark, sf_dir):
    own = calls(spark, sf_dir)
    baseline = own.where("pm % 3 = 0").groupBy("read_id", "read_pos").agg(F.max(F.col("pm") % 256).alias("score"))
    return evaluation.compare(own, baseline).select("reads", "sites", F.round("ratio", 6).alias("ratio"), F.round("baseline_ratio", 6).alias("baseline_ratio"))


_GROUPED = f"{CALLS}, {ALIGNMENTS}, g as (select case when l_orderkey%4=0 then 'p'||cast(l_orderkey%1000 as varchar) else 'r'||cast(l_orderkey as varchar) end as read_id, count(*) as n from lineitem group by 1), k as (select unnest([parent_id, query_name]) as read_id, query_name, line_no from alignments where flag & 2304 = 0)"


@query(f"with {_GROUPED}, f as (select *, row_number() over (partition by read_id order by line_no) as rn from k where read_id is not null) select g.read_id, f.query_name, n from g join f on g.read_id=f.read_id where rn=1")
def reads_first_alignment(spark, sf_dir):
    k = F.col("l_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("p"), (k % 1000).cast("string"))).otherwise(F.concat(F.lit("r"), k.cast("string")))
    grouped = table(spark, sf_dir, "lineitem").groupBy(name.alias("read_id")).agg(F.count("*").alias("n"))
    return reads.with_first_alignment(grouped, alignments(spark, sf_dir)).select("read_id", "query_name", "n")


@query(f"with {ALIGNMENTS}, k as (select unnest([parent_id, query_name]) as read_id, query_name from alignments where flag & 2304 = 0) select vec_id, query_name from embeddings join k on read_id='p'||cast(vec_id as varchar)")
def signals_with_reads(spark, sf_dir):
    own = signals(spark, sf_dir).withColumn("read_id", F.concat(F.lit("p"), F.col("vec_id").cast("string")))
    return reads.with_signals(own, alignments(spark, sf_dir)).select("vec_id", "query_name")


@query(f"""with {CALLS} select chrom||chr(9)||cast(ref_pos as varchar)||chr(9)||strand||chr(9)||cast(label as varchar)||chr(9)||read_id||chr(9)||cast(read_pos as varchar)||chr(9)||methy_type||chr(9)||
 printf('%.6f', (1000-pm)/cast(1000 as double))||chr(9)||printf('%.6f', pm/cast(1000 as double))||chr(9)||case when pm>500 then '1' else '0' end||chr(9)||'.' as value from calls""")
def call_lines(spark, sf_dir):
    return text.call_lines(calls(spark, sf_dir))


@query(f"""with {CALLS}, s as (select chrom, ref_pos, min_by(strand, line_no) as strand, sum(1000-pm) as s0, sum(pm) as s1, sum(case when pm>=500 then 1 else 0 end) as met, count(*) as n from calls group by 1,2)
 select chrom||chr(9)||cast(ref_pos as varchar)||chr(9)||strand||chr(9)||'-1'||chr(9)||printf('%.3f', s0/cast(1000 as double))||chr(9)||printf('%.3f', s1/cast(1000 as double))||chr(9)||cast(met as varchar)||chr(9)||cast(n-met as varchar)||chr(9)||cast(n as varchar)||chr(9)||printf('%.4f', met/cast(n as double))||chr(9)||'.' as value from s""")
def frequency_lines(spark, sf_dir):
    return text.frequency_lines(frequency.site_frequency(calls(spark, sf_dir)))


_RATES = """r as (select quality as y, n_chars%1001 as s from labels l join documents d on l.doc_id=d.doc_id), g as (select s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from r group by 1),
 c as (select s, sum(p) over (order by s desc) as tp, sum(n) over (order by s desc) as fp, sum(p) over () as ap, sum(n) over () as an from g),
 t as (select 'roc' as curve, (select s from c order by tp/ap - fp/an desc, s desc limit 1) as threshold union all select 'pr', (select s from c order by tp/(tp+fp) + tp/ap desc, s limit 1))"""


@query(f"""with {_RATES} select curve, cast(threshold as double) as threshold, cast(sum(case when s>=threshold and y=1 then 1 else 0 end) as bigint) as tp, cast(sum(case when s>=threshold and y=0 then 1 else 0 end) as bigint) as fp,
 cast(sum(case when s<threshold and y=1 then 1 else 0 end) as bigint) as fn, cast(sum(case when s<threshold and y=0 then 1 else 0 end) as bigint) as tn from t, r group by 1,2""")
def roc_pr_thresholds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") % 1001).alias("score"))
    return metrics.at_thresholds(rows).select("curve", "threshold", "tp", "fp", "fn", "tn")


@query(f"""with {CALLS}, k as (select methy_type, case when label>=50 then 1 else 0 end as y, pm as s from calls where label<>-1),
 g as (select methy_type, s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from k group by 1,2),
 c as (select methy_type, p, n, sum(p) over (partition by methy_type order by s desc) as tp, sum(p) over (partition by methy_type) as ap, sum(n) over (partition by methy_type) as an from g),
 a as (select methy_type, round(sum((tp-p/2)*n)/max(ap)/max(an),4) as roc_auc from c group by 1)
 select k.methy_type, cast(sum(case when s>500 and y=1 then 1 else 0 end) as bigint) as tp, cast(sum(case when s>500 and y=0 then 1 else 0 end) as bigint) as fp, cast(sum(case when s<=500 and y=1 then 1 else 0 end) as bigint) as fn,
 cast(sum(case when s<=500 and y=0 then 1 else 0 end) as bigint) as tn, max(roc_auc) as roc_auc from k join a on k.methy_type=a.methy_type group by 1""")
def context_metrics(spark, sf_dir):
    token = F.when(F.col("label") == -1, tags.MASK).when(F.col("label") >= 50, tags.PLUS).otherwise(tags.MINUS)
    rows = calls(spark, sf_dir).select("methy_type", F.lit(0.0).alias("minus"), ((F.col("pm") - 500) / F.lit(100.0)).alias("plus"), token.alias("label"))
    return metrics.by_context(rows).select("methy_type", "tp", "fp", "fn", "tn", "roc_auc")


@query("""with u as (select 0 as source, p_partkey as key from part union all select 1, s_suppkey from supplier) select source, key, row_number() over (partition by source order by key) - 1 as ordinal from u""")
def interleaved_sources(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return ordering.interleaved([a, b], "key").select("source", "key", "ordinal")


@query("""with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as k from documents) select source, doc_id from r where k <= 200 // (select count(distinct source) from documents)""")
def validation_sample(spark, sf_dir):
    return ordering.first_per_source(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", total=200)


@query("select event_id from (select event_id from events order by event_id limit 192)")
def first_batches(spark, sf_dir):
    return ordering.first_batches(table(spark, sf_dir, "events").select("event_id"), 3, batch_size=64, order=("event_id",))


@query("""with p as (select vec_id, unnest(range(1, len(embedding)+1)) as i, embedding from embeddings), m as (select vec_id, i-1 as pos, cast(floor(abs(embedding[i]::double)*4000) as int)%256 as score from p)
 select vec_id, cast(sum(case when score>=243 then 1 else 0 end) as int) as n from m group by 1 having sum(case when score>=243 then 1 else 0 end)*7 <> vec_id%11""")
def m6a_confident(spark, sf_dir):
    scores = F.transform("signal", lambda x, i: F.struct(i.alias("pos"), (F.floor(F.abs(x) * 4000).cast("int") % 256).alias("score")))
    rows = signals(spark, sf_dir).select("vec_id", F.size(filters.confident(scores)).alias("n"))
    told = filters.matched(F.array_repeat(F.lit(0), F.col("n") * 7), F.array_repeat(F.lit(0), (F.col("vec_id") % 11).cast("int")))
    return rows.where(~told)


@query(f"""with {CALLS}, s as (select chrom, ref_pos, min(line_no) as seen from calls group by 1,2), o as (select *, row_number() over (order by chrom, ref_pos) as place, row_number() over (order by seen) as turn from s)
 select 'place' as told, place as rank, chrom, ref_pos as pos from o where place<=100 union all select 'first_seen', turn, chrom, ref_pos from o where turn<=100""")
def sites_in_order(spark, sf_dir):
    """The first hundred sites of both orders; only these are numbered in one task."""
    from pyspark.sql import Window as W

    found = frequency.site_frequency(calls(spark, sf_dir)).select("chrom", "pos", "first_seen")

    def head(by, *order):
        rank = F.row_number().over(W.orderBy(*order)).cast("long").alias("rank")
        return frequency.in_order(found, by=by).limit(100).select(F.lit(by).alias("told"), rank, "chrom", "pos")

    return head("place", "chrom", "pos").union(head("first_seen", "first_seen"))


@query(f"with {TRUTH} select chrom, start, percentage from (select *, row_number() over (order by chrom, start) as rn from truth) where rn<=100")
def bed_in_order(spark, sf_dir):
    return text.in_bed_order(truth(spark, sf_dir)).limit(100).select("chrom", "start", "percentage")


@query(f"with {CALLS} select ref_pos, count(*) as n from calls where chrom='chrA' and abs(cast(1000-pm as double)/1000 - cast(pm as double)/1000) >= 0.2 group by 1")
def calls_on_contig(spark, sf_dir):
    return frequency.usable_calls(calls(spark, sf_dir), prob_cf=0.2, contig="chrA").groupBy("ref_pos").agg(F.count("*").alias("n"))


@query(f"with {CALLS} select chrom, ref_pos, string_agg(cast(pm as varchar), ',' order by pm) as pm_csv from calls where methy_type='[CpG]' group by 1,2")
def site_probability_lists(spark, sf_dir):
    found = sites.site_probabilities(calls(spark, sf_dir), methy_type="[CpG]")
    return found.select("chrom", "ref_pos", _csv(F.transform("probabilities", lambda p: F.rint(p * 1000).cast("int"))).alias("pm_csv"))


@query("""with t as (select doc_id, substr(regexp_replace(translate(coalesce(text,''),'abcdefghijklmnopqrstuvwxyz','ABCDEFGHIJKLMNOPQRSTUVWXYZ'),'[^ACGTMKRYBVDHWSZN]','','g'), 1, 50)||case when doc_id%3=0 then 'Q' else 'R' end as s from documents)
 select doc_id, case when s like '%Q' then '' else reverse(translate(s,'ATCGMKRYBVDH','TAGCKMYRVBHD')) end as s from t""")
def revcomp_or_empty(spark, sf_dir):
    s = F.substring(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "[^ACGTMKRYBVDHWSZN]", ""), 1, 50)
    s = F.concat(s, F.when(F.col("doc_id") % 3 == 0, "Q").otherwise("R"))
    return table(spark, sf_dir, "documents").select("doc_id", dna.revcomp_or_empty(s).alias("s"))


@query(f"with {SEQUENCES}, b as (select doc_id, seq, unnest(range(1, length(seq)+1)) as i from reads), k as (select doc_id, i-1 as pos, row_number() over (partition by doc_id order by i) - 1 as rank from b where substr(seq, i, 1)='C') select doc_id, count(*) as n, cast(sum(pos*(1+rank%7)) as bigint) as total from k group by 1")
def ranked_bases(spark, sf_dir):
    rows = reads.ranked_per_read(sequences(spark, sf_dir).withColumnRenamed("doc_id", "query_name"))
    return rows.groupBy(F.col("query_name").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long") * (1 + F.col("rank") % 7)).alias("total"))
