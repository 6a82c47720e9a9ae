"""Hand-computed cases of the expressions and operators."""

from pyspark.sql import functions as F

from strandloom.functions import dna, signal, tags
from strandloom.operators import filters, frequency, patches, reads, sites


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def arr(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")


def test_contexts(spark):
    r = one(spark, a=dna.sites(F.lit("CGCAGCTT"), m6a=False), b=dna.sites(F.lit("AC"), m6a=False), c=dna.sites(F.lit("CTG"), chg=False), d=dna.sites(F.lit("")))
    assert [(s.pos, s.methy_type) for s in r.a] == [(0, "[CpG]"), (2, "[CHG]"), (5, "[CHH]")]
    assert r.b == [] and r.c == [] and r.d == []


def test_complements_and_motifs(spark):
    r = one(spark, a=dna.revcomp(F.lit("ACGTNx")), b=dna.revcomp_iupac(F.lit("ARYKMBVDHWSN?")), c=dna.revcomp_iupac(F.lit("AUG"), "RNA"), d=dna.revcomp_or_empty(F.lit("A?")))
    assert (r.a, r.b, r.c, r.d) == ("NNACGT", "NNSWDHBVKMRYT", "CAU", "")
    assert dna.expand_motif("RC") == ["AC", "GC"] and len(dna.expand_motif("NNN")) == 64


def test_windows_keep_within_the_contig(spark):
    seq = F.lit("ACGTACGT")
    w = lambda pos, strand: dna.window(seq, F.lit(pos), F.lit(strand), 0, 3)
    r = one(spark, a=w(1, "+"), b=w(3, "-"), c=w(1, "-"), d=w(7, "+"))
    assert (r.a, r.b, r.c, r.d) == ("CGT", "ACG", "", "T")
    r = one(spark, **{k: dna.cytosine_motif(F.lit(k)) for k in ("CGN", "CAG", "CCC", "CHH", "CNN", "AAA")})
    assert (r.CGN, r.CAG, r.CCC, r.CHH, r.CNN, r.AAA) == ("CG", "CHG", "CHH", "CHH", None, None)


def test_tags_round_trip(spark):
    r = one(spark, t=tags.encode(arr(0, 2, 3), arr(100, 0, 50)), back=tags.ranks_of(F.lit("A+a,5;C+m,0,1,0;")), none=tags.ranks_of(F.lit("C+m,;")), p=tags.ml_of_probabilities(arr(0.5, 0.999, 1.0)), e=tags.mm(arr()))
    assert (r.t.mm, r.t.ml) == ("C+m,0,1,0;", [255, 0, 128]) and r.back == [0, 2, 3] and r.none == [] and r.p == [128, 255, 255] and r.e == "C+m,;"


def test_labels(spark):
    r = one(spark, a=tags.training_label(F.lit(229)), b=tags.training_label(F.lit(0)), c=tags.training_label(F.lit(9)), d=tags.bisulfite_label(F.lit(None).cast("int")), e=tags.loss_weight(F.lit(100)), f=tags.label_token(F.lit(100)), g=tags.label_token(F.lit(-1)), h=tags.nucleosome_edges(arr(10, 30), arr(5, 5)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (100, 0, None, -1, 10.0, 10, 12, [9, 29, 15, 35])


def test_signal(spark):
    bounds = signal.move_bounds(arr(5, 1, 0, 1, 1), signal.move_start(F.lit(10), F.lit(None).cast("int")), F.lit(40))
    norm = signal.normalization(F.lit(0.2), F.lit(0.5), F.lit(0.0), F.lit(1.0), frequency="5khz")
    r = one(spark, b=bounds, s=signal.segments(bounds), n=norm, i=signal.signal_index(arr(2, 0, 3), 2), t=signal.token_text(arr(3, -100, 7)), c=signal.calibration_scale(F.lit(1467.6), F.lit(8192.0)), z=signal.calibration_scale(F.lit(1.0), F.lit(0.0)))
    assert r.b == [10, 20, 25, 40] and [(s.start, s.len) for s in r.s] == [(10, 10), (20, 5), (25, 15)]
    assert abs(r.n.shift - 0.8) < 1e-12 and r.n.scale == 2.0 and r.i == [0, 2, 2] and r.t == "A[CpG]" and r.z == 1.0 and r.c == 1467.6 / 8192
    at = F.array(F.struct(F.lit(1).alias("pos"), F.lit("[CpG]").alias("token")))
    r = one(spark, w=signal.with_context_tokens(F.split(F.lit("ACGTA"), ""), at), p=signal.token_position(F.lit(1), at))
    assert r.w == ["A", "C", "[CpG]", "G", "T", "A"] and r.p == 2


def test_chunks_partition_every_length(spark):
    n = spark.range(1, 1200).select(F.col("id").cast("int").alias("n"))
    rows = n.select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p")).select("n", patches.owner(F.col("p"), F.col("n")).alias("o"))
    most = rows.groupBy("n").agg(F.max("o").alias("o")).join(n.select("n", F.size(patches.starts(F.col("n"))).alias("k")), "n")
    assert most.where("o <> k - 1").count() == 0
    r = one(spark, s=patches.starts(F.lit(300)), a=patches.owner(F.lit(239), F.lit(300)), b=patches.owner(F.lit(240), F.lit(300)))
    assert (r.s, r.a, r.b) == ([0, 224], 0, 1)


def test_chromosome_filters(spark):
    df = spark.createDataFrame([("Chr1",), ("Chr2",), ("Chr3",)], "c string")
    names = lambda rule: sorted(r.c for r in df.where(filters.chromosome_filter(rule, F.col("c"))).collect())
    assert names("|") == names("Chr1|Chr2") == names("Chr1") == ["Chr1", "Chr2", "Chr3"]
    assert names("Chr1,Chr2|") == ["Chr3"] and names("|Chr1") == ["Chr1"]


def calls(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "chrom string, ref_pos long, strand string, label int, read_id string, prediction int, prob_unmethylated double, prob_methylated double, kmer string, line_no long")


def test_quota_ranking(spark):
    c = calls(spark, [("c", 1, "+", 50, f"r{i}", int(i < 4), 0.5, 0.5, ".") for i in range(6)] + [("c", 2, "+", 50, f"r{i}", 1, 0.5, 0.5, ".") for i in range(5)] + [("c", 3, "+", 50, f"r{i}", 1, 0.5, 0.5, ".") for i in range(7)])
    got = {(r.ref_pos, r.read_id): r.read_label for r in sites.quota_labels(c).collect()}
    assert [got[1, f"r{i}"] for i in range(6)] == [100, 100, 100, 0, 0, 0]
    assert not any(k[0] == 2 for k in got) and sum(got[3, f"r{i}"] == 100 for i in range(7)) == 4


def test_frequency_edges(spark):
    c = calls(spark, [("c", 1, "-", 0, "a", 0, 0.6, 0.4, "K"), ("c", 1, "+", 0, "b", 0, 0.5, 0.5, "L"), ("c", -1, "+", 0, "b", 0, 0.5, 0.5, "L")])
    r = frequency.site_frequency(c).collect()
    assert len(r) == 1 and (r[0].strand, r[0].kmer, r[0].met, r[0].unmet, r[0].rmet) == ("-", "K", 1, 1, 0.5)
    r = frequency.call_usage(c.limit(0)).first()
    assert (r.used, r.total, r.share) == (0, 0, None)
    r = one(spark, a=frequency.percentage(F.lit(0.125), use_floor=True), b=frequency.percentage(F.lit(0.125)))
    assert (r.a, r.b) == (12, 13)


def test_alignment_coordinates(spark):
    cigar = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in ((4, 1), (0, 2), (1, 1), (2, 1), (0, 1))])
    pairs = reads.aligned_pairs(cigar, F.lit(100))
    r = one(spark, p=pairs, f=reads.reference_positions(pairs, arr(0, 1, 2, 3, 4), F.lit(5), F.lit(False)), b=reads.reference_positions(pairs, arr(0, 4), F.lit(5), F.lit(True)), n=reads.reference_positions(F.array().cast("array<struct<q:int,r:bigint>>"), arr(0), F.lit(5), F.lit(False)), a=reads.reanchored(pairs))
    assert [(x.q, x.r) for x in r.p] == [(0, None), (1, 100), (2, 101), (3, None), (None, 102), (4, 103)]
    assert r.f == [-1, 100, 101, -1, 103] and r.b == [103, -1] and r.n == [-1]
    assert [(x.ref_pos, x.q, x.extra) for x in r.a] == [(None, 0, []), (100, 1, []), (101, 2, [3]), (102, None, []), (103, 4, [])]


def test_modbam_drops_reads_with_positions_off_their_base(spark):
    own = spark.createDataFrame([("a", "ACG"), ("b", "ACG"), ("c", "ACGCA")], "query_name string, seq string")
    made = spark.createDataFrame([("a", "[CpG]", 1, 0.9, 0, 1), ("b", "[CpG]", 0, 0.9, 0, 0), ("c", "[CpG]", 3, 0.2, 0, 0), ("c", "[CpG]", 3, 0.4, 1, 0), ("c", "[m6A]", 4, 1.0, 1, 1)], "read_id string, methy_type string, read_pos int, prob double, patch_idx int, place int")
    got = {r.query_name: (r.mm, r.ml) for r in reads.tagged(own, reads.packed_sites(made), how="left").collect()}
    assert got == {"a": ("C+m,0;", [230]), "c": ("C+m,1;A+a,1;", [102, 255])}
