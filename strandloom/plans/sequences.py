"""Queries over sequences, tags, signals and windows, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, signal, tags
from ..operators import filters, patches, reads
from .views import CALLS, SEQUENCES, calls, sequences, signals, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


#: One row a base: i is 1-based here.
_BASES = f"{SEQUENCES}, b as (select doc_id, seq, length(seq) as n, unnest(range(1, length(seq)+1)) as i from reads), c as (select doc_id, n, i, substr(seq, i, 1) as x, substr(seq, i+1, 1) as y, substr(seq, i+2, 1) as z from b)"
_CONTEXT = "case when x='A' then '[m6A]' when x='C' and y='G' then '[CpG]' when x='C' and z='G' then '[CHG]' when x='C' and z<>'' then '[CHH]' end"


@query(f"with {SEQUENCES} select doc_id, cast(length(seq) as int) as len, md5(reverse(translate(seq,'ACGT','TGCA'))) as md5 from reads")
def revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.length("seq").alias("len"), F.md5(dna.revcomp(F.col("seq"))).alias("md5"))


@query("with t as (select doc_id, regexp_replace(translate(coalesce(text,''),'abcdefghijklmnopqrstuvwxyz','ABCDEFGHIJKLMNOPQRSTUVWXYZ'),'[^ACGTMKRYBVDHWSZN]','N','g') as s from documents) select doc_id, md5(reverse(translate(s,'ATCGMKRYBVDH','TAGCKMYRVBHD'))) as md5 from t")
def revcomp_iupac(spark, sf_dir):
    text = F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(dna.revcomp_iupac(text)).alias("md5"))


def _sites(spark, sf_dir):
    """Typed sites of all sequences: positions as an array, exploded."""
    s = sequences(spark, sf_dir).select("doc_id", F.length("seq").alias("n"), F.explode(dna.sites(F.col("seq"))).alias("s"))
    return s.select("doc_id", "n", "s.pos", "s.methy_type")


@query(f"with {_BASES}, t as (select doc_id, i-1 as pos, {_CONTEXT} as m from c) select doc_id, count(*) as n_sites, min(pos)::int as first_pos, max(pos)::int as last_pos, cast(sum(pos) as bigint) as pos_sum from t where m is not null group by 1")
def find_sites(spark, sf_dir):
    return _sites(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sites"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("pos").alias("pos_sum"))


@query(f"with {_BASES}, t as (select {_CONTEXT} as methy_type from c) select methy_type, count(*) as n from t where methy_type is not null group by 1")
def site_context_counts(spark, sf_dir):
    return _sites(spark, sf_dir).groupBy("methy_type").agg(F.count("*").alias("n"))


@query(f"with {_BASES} select doc_id, cast(count(*) as int) as n, cast(min(i)-1 as int) as first_pos, cast(max(i)-1 as int) as last_pos from c where x='C' group by 1")
def target_positions(spark, sf_dir):
    at = dna.positions(F.col("seq"), "C")
    return sequences(spark, sf_dir).select("doc_id", at.alias("p")).where(F.size("p") > 0).select("doc_id", F.size("p").alias("n"), F.array_min("p").alias("first_pos"), F.array_max("p").alias("last_pos"))


#: CpG sites by their rank among C's, with a score of (rank*7)%101.
_CPG = f"{_BASES}, k as (select doc_id, i, y, row_number() over (partition by doc_id order by i) - 1 as rank from c where x='C'), g as (select doc_id, i, rank, (rank*7)%101 as score, rank - coalesce(lag(rank) over (partition by doc_id order by i), -1) - 1 as skip from k where y='G')"


def _cpg(spark, sf_dir):
    """(doc_id, seq, ranks, scores) of each sequence's CpG sites: ranks from cumulated positions of C's, joins none."""
    own = F.filter(F.array(tags.ranks(dna.cpg_skips(F.col("seq")))), lambda r: F.size(r) > 0)
    s = sequences(spark, sf_dir).select("doc_id", "seq", F.explode(own).alias("ranks"))
    return s.withColumn("scores", F.transform("ranks", lambda r: r * 7 % 101))


@query(f"with {_CPG} select doc_id, 'C+m,'||string_agg(cast(skip as varchar), ',' order by i)||';' as mm from g group by 1")
def mm_skips(spark, sf_dir):
    return _cpg(spark, sf_dir).select("doc_id", tags.mm(F.col("ranks")).alias("mm"))


@query(f"with {_CPG} select doc_id, string_agg(cast(cast(round_even(score*255/cast(100 as double),0) as int) as varchar), ',' order by i) as ml_csv, string_agg(cast(least(cast(floor(score/cast(100 as double)*256) as int),255) as varchar), ',' order by i) as alt_csv from g group by 1")
def ml_values(spark, sf_dir):
    csv = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return _cpg(spark, sf_dir).select("doc_id", csv(tags.ml(F.col("scores"))).alias("ml_csv"), csv(tags.ml_of_probabilities(F.transform("scores", lambda s: s / 100))).alias("alt_csv"))


@query(f"with {_CPG} select doc_id, string_agg(cast(rank as varchar), ',' order by i) as ranks_csv from g group by 1")
def mm_roundtrip(spark, sf_dir):
    """Ranks written as a tag and read again."""
    made = _cpg(spark, sf_dir).select("doc_id", tags.encode(F.col("ranks"), F.col("scores")).alias("t"))
    return made.select("doc_id", F.array_join(F.transform(tags.ranks_of(F.col("t.mm")), lambda r: r.cast("string")), ",").alias("ranks_csv"))


_MODBAM = f"with {_CPG}, p as (select doc_id, string_agg(cast(skip as varchar), ',' order by i) as s, string_agg(cast(cast(round_even(score*255/cast(100 as double),0) as int) as varchar), ',' order by i) as ml from g group by 1)"


def _modbam(spark, sf_dir, how):
    own = sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("query_name"), "seq")
    sites = _cpg(spark, sf_dir)
    rows = sites.select(F.col("doc_id").cast("string").alias("read_id"), F.explode(F.zip_with(dna.cpg_positions(F.col("seq")), "scores", lambda p, s: F.struct(p.alias("read_pos"), (s / 100).alias("prob")))).alias("x"))
    predictions = rows.select("read_id", F.lit("[CpG]").alias("methy_type"), "x.read_pos", "x.prob", F.lit(0).alias("patch_idx"), F.col("x.read_pos").alias("place"))
    made = reads.tagged(own, reads.packed_sites(predictions), how=how)
    return made.select(F.col("query_name").cast("long").alias("doc_id"), "mm", F.array_join(F.transform("ml", lambda x: x.cast("string")), ",").alias("ml_csv"))


@query(f"{_MODBAM} select doc_id, 'C+m,'||s||';' as mm, ml as ml_csv from p")
def modbam_inner(spark, sf_dir):
    return _modbam(spark, sf_dir, "inner")


@query(f"{_MODBAM} select r.doc_id, 'C+m,'||s||';' as mm, ml as ml_csv from reads r left join p on r.doc_id=p.doc_id")
def modbam_left(spark, sf_dir):
    return _modbam(spark, sf_dir, "left")


@query(f"with {CALLS}, t as (select case when pm%256>=229 then 100 when pm%256=0 then 0 end as label, cast(round_even(cast(pm%256 as double)/255*100,0) as int) as bs from calls) select label, count(*) as n, cast(sum(bs) as bigint) as bs_sum from t where label is not null group by 1")
def training_labels(spark, sf_dir):
    score = F.col("pm") % 256
    rows = calls(spark, sf_dir).select(tags.training_label(score).alias("label"), tags.bisulfite_label(score).alias("bs"))
    return rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"), F.sum("bs").alias("bs_sum"))


@query("""with e as (select vec_id, unnest([10,25,40]) as s from embeddings), p as (select vec_id, s-1 as pos from e union select vec_id, s+(10+vec_id%3) from e)
 select vec_id, cast(count(*) as int) as n_edges, cast(sum(pos) as bigint) as pos_sum, max(case when pos=24 then 1 else 0 end) as has_24 from p group by 1""")
def nucleosome_labels(spark, sf_dir):
    starts = F.array(*map(F.lit, (10, 25, 40)))
    lengths = F.transform(starts, lambda x: (10 + F.col("vec_id") % 3).cast("int"))
    edges = tags.nucleosome_edges(starts, lengths)
    rows = signals(spark, sf_dir).select("vec_id", edges.alias("e"))
    label = tags.nucleosome_label(F.lit(24), F.col("e"), F.lit(1))
    return rows.select("vec_id", F.size("e").alias("n_edges"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x).alias("pos_sum"), F.coalesce((label == 100).cast("int"), F.lit(0)).alias("has_24"))


#: A move table of stride 4 from each vector: a base starts at 0 and at each positive component of the first 15.
@query("""with m as (select vec_id, embedding, len(embedding) as n, unnest(range(15)) as k from embeddings), b as (select vec_id, n, k*4+2 as bp from m where k=0 or embedding[k+1]>0),
 s as (select vec_id, row_number() over (partition by vec_id order by bp) - 1 as base_idx, bp, lead(bp, 1, n) over (partition by vec_id order by bp) as nx from b)
 select vec_id, cast(base_idx as int) as base_idx, cast(bp as int) as start, cast(nx-bp as int) as len from s""")
def move_segments(spark, sf_dir):
    moves = F.concat(F.array(F.lit(4), F.lit(1)), F.transform(F.slice("signal", 2, 14), lambda x: (x > 0).cast("int")))
    bounds = signal.move_bounds(moves, signal.move_start(F.lit(2), F.lit(None).cast("int")), F.size("signal"))
    return signals(spark, sf_dir).select("vec_id", F.posexplode(signal.segments(bounds)).alias("base_idx", "s")).select("vec_id", "base_idx", "s.start", "s.len")


@query("""with x as (select vec_id, unnest(embedding)::double as v from embeddings) select vec_id, count(*)::int as n, round(sum((v-(1-0.2))/(1/0.5)),4) as sum_a, round(sum((v-0.2)/0.5),4) as sum_b, round(sum((v-(0.2/2-3))/(0.5/2)),2) as sum_c from x group by 1""")
def signal_norm(spark, sf_dir):
    sm, sd, off, by = (F.lit(x) for x in (0.2, 0.5, 3.0, 2.0))
    total = lambda **k: F.aggregate(signal.normalized(F.col("signal"), signal.normalization(sm, sd, off, by, **k)), F.lit(0.0), lambda a, x: a + x)
    return signals(spark, sf_dir).select("vec_id", F.size("signal").alias("n"), F.round(total(frequency="5khz"), 4).alias("sum_a"), F.round(total(frequency="5khz", dorado_version=0.8), 4).alias("sum_b"), F.round(total(), 2).alias("sum_c"))


_LENGTH = f"with {SEQUENCES}, l as (select doc_id, length(seq) as n from reads where length(seq)>0)"


@query(f"{_LENGTH} select doc_id, cast(s as int) as start, cast(row_number() over (partition by doc_id order by s)-1 as int) as patch_idx, count(*) over (partition by doc_id) as total_patches from (select doc_id, unnest(case when n<=32 then [0] else range(0, n-32, 224) end) as s from l)")
def patch_chunks(spark, sf_dir):
    s = sequences(spark, sf_dir).where(F.length("seq") > 0)
    cut = s.select(F.col("doc_id").alias("read_id"), F.explode(patches.starts(F.length("seq"))).alias("start"))
    return reads.numbered_patches(cut).select(F.col("read_id").alias("doc_id"), "start", "patch_idx", "total_patches")


@query(f"""with {_BASES}, t as (select doc_id, n, i-1 as pos from c where x='C' and y='G'),
 o as (select doc_id, case when pos<240 then 0 else least(cast(floor((pos-16)/cast(224 as double)) as int), greatest(cast(ceil((n-32)/cast(224 as double)) as int)-1,0)) end as patch_idx, pos from t)
 select doc_id, patch_idx, count(*) as n_sites, cast(sum(pos) as bigint) as pos_sum from o group by 1,2""")
def patch_sites(spark, sf_dir):
    s = sequences(spark, sf_dir).select("doc_id", F.length("seq").alias("n"), F.explode(dna.cpg_positions(F.col("seq"))).alias("pos"))
    return s.groupBy("doc_id", patches.owner(F.col("pos"), F.col("n")).alias("patch_idx")).agg(F.count("*").alias("n_sites"), F.sum("pos").alias("pos_sum"))


@query(f"with {SEQUENCES} select cast(floor(length(seq)/cast(500 as double)) as int) as bin, count(*) as n from reads where length(seq)>=50 and length(seq)<7500 group by 1")
def length_bins(spark, sf_dir):
    n = F.length("seq")
    return sequences(spark, sf_dir).where(filters.patch_length(F.split("seq", ""))).groupBy(patches.length_bin(n).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""with {SEQUENCES}, t as (select doc_id, substr(seq,1,length(seq)) as seq, length(seq) as n from reads where length(seq)>0), b as (select doc_id, n, unnest(range(1, n+1)) as i, seq from t),
 g as (select doc_id, i, substr(seq,i,1) as x, substr(seq,i,2)='CG' as site from b)
 select doc_id, cast(count(*)+sum(case when site then 1 else 0 end) as int) as n_tokens, md5(string_agg(x||case when site then '[CpG]' else '' end, '' order by i)) as md5 from g group by 1""")
def context_tokens(spark, sf_dir):
    s = sequences(spark, sf_dir).where(F.length("seq") > 0)
    at = F.transform(dna.cpg_positions(F.col("seq")), lambda p: F.struct(p.alias("pos"), F.lit(dna.CPG).alias("token")))
    made = signal.with_context_tokens(F.split("seq", ""), at)
    return s.select("doc_id", made.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "")).alias("md5"))


#: A CIGAR by rule: 2 clipped, 5 matched, 1 inserted, 4 matched, 2 deleted, 3 matched.
@query("""with o(op, len, ord) as (values (4,2,1),(0,5,2),(1,1,3),(0,4,4),(2,2,5),(0,3,6)), b as (select op, ord, unnest(range(len)) as j from o),
 e as (select op, row_number() over (order by ord, j) as k from b),
 f as (select *, sum(case when op in (0,1,4) then 1 else 0 end) over (order by k) - 1 as q, sum(case when op in (0,2) then 1 else 0 end) over (order by k) - 1 as r from e),
 p as (select unnest(range(15)) as x), m as (select q, r from f where op=0)
 select vec_id, cast(x as int) as read_pos, cast(coalesce(vec_id+r, -1) as bigint) as ref_pos from embeddings, p left join m on m.q = case when vec_id%2=1 then 14-x else x end""")
def align_ref(spark, sf_dir):
    ops = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in ((4, 2), (0, 5), (1, 1), (0, 4), (2, 2), (0, 3))])
    pairs = reads.aligned_pairs(ops, F.col("vec_id"))
    at = reads.reference_positions(pairs, F.sequence(F.lit(0), F.lit(14)), F.lit(15), F.col("vec_id") % 2 == 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(at).alias("read_pos", "ref_pos"))


@query("""with w(w, en, st, len) as (select event_id, event_id%97, event_id%13, 100 from events) select count(*) as reads, cast(sum(en-st) as bigint) as covered from w where (en-st > 0.5*len or (en=0 and st=0))""")
def fiber_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("en"), (F.col("event_id") % 13).alias("st"))
    return e.where(filters.full_fibre(F.col("st"), F.col("en"), F.lit(100))).agg(F.count("*").alias("reads"), F.sum(F.col("en") - F.col("st")).alias("covered"))


@query("""with p as (select vec_id, unnest(range(1, len(embedding)+1)) as i, embedding from embeddings), m as (select vec_id, i-1 as pos from p where embedding[i]>0.1)
 select vec_id, cast(count(*) as int) as n, cast(max(pos) as int) as last_pos, cast(max(pos)+1-count(*) as int) as zeros from m group by 1 having max(pos)>0 and count(*)/cast(max(pos) as double)>0.2""")
def m6a_density(spark, sf_dir):
    """Marked positions as a comma cell, read back, dense enough, and spread to 0/1."""
    at = F.filter(F.transform("signal", lambda x, i: F.when(x > F.lit(0.1).cast("float").cast("double"), i)), lambda i: i.isNotNull())
    s = signals(spark, sf_dir).select("vec_id", F.concat(F.array_join(F.transform(at, lambda i: i.cast("string")), ","), F.lit(",")).alias("cell"))
    s = s.select("vec_id", tags.ints(F.col("cell")).alias("m")).where(F.size("m") > 0)
    s = s.select("vec_id", "m", F.size("m").alias("n"), F.array_max("m").alias("last_pos")).where(filters.dense_enough(F.col("n"), F.col("last_pos"), 0.2))
    return s.select("vec_id", "n", "last_pos", (F.size(F.filter(tags.dense(F.col("m")), lambda x: x == 0))).alias("zeros"))
