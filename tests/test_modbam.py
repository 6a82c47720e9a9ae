"""Tags of alignment records, written and decoded."""

from pyspark.sql import functions as F

from strandloom.operators import evaluation, modbam
from strandloom.schemas import CIGAR


def records(spark, *rows):
    schema = f"query_name string, flag int, reference_name string, reference_start long, mapping_quality int, cigar {CIGAR}, seq string, is_reverse boolean, mm string, ml array<int>, ns array<int>, nl array<int>, line_no long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def test_labels_written_are_read_back_on_both_strands(spark):
    reads = records(
        spark,
        ("fwd", 0, "c", 100, 60, [(4, 1), (0, 5)], "TACGCA", False, None, None, None, None),
        ("rev", 16, "c", 100, 60, [(0, 6)], "TGCGTA", True, None, None, None, None),
        ("low", 0, "c", 100, 3, [(0, 6)], "TACGCA", False, None, None, None, None),
        ("second", 256, "c", 100, 60, [(0, 6)], "TACGCA", False, None, None, None, None),
    )
    labels = spark.createDataFrame([("c", 101, 100.0), ("c", 103, 0.0), ("c", 500, 1.0)], "chrom string, pos long, score double")
    out = modbam.label_tags(reads, labels)
    got = {r.query_name: (r.mm, r.ml) for r in out.collect()}
    # forward read: C's at 2 and 4 stand on 101 and 103; reverse read TACGCA: base q stands on 105 - q, C's at 2, 4 on 103, 101
    assert got == {"fwd": ("C+m,0,0;", [255, 0]), "rev": ("C+m,0,0;", [0, 255])}
    back = {(r.read_id, r.ref_pos): r.prob for r in modbam.site_predictions(out).collect()}
    assert back == {("fwd", 101): 1.0, ("fwd", 103): 0.0, ("rev", 103): 0.0, ("rev", 101): 1.0}


def test_read_labels_and_several_modifications(spark):
    reads = records(spark, ("a", 0, "c", 0, 60, [(0, 6)], "ACGACA", False, "C+m,0,0;A+a,1;", [10, 20, 200], None, None))
    assert {(r.ref_pos, round(r.prob * 255)) for r in modbam.site_predictions(reads, "m").collect()} == {(1, 10), (4, 20)}
    assert {(r.ref_pos, round(r.prob * 255)) for r in modbam.site_predictions(reads, "m6A").collect()} == {(3, 200)}
    labels = spark.createDataFrame([("a", "c", 4, 100), ("b", "c", 1, 100)], "read_id string, chrom string, pos long, label int")
    r = modbam.label_tags(reads, labels).first()
    assert (r.mm, r.ml) == ("C+m,1;", [255])


def test_training_tags(spark):
    reads = records(spark, ("a", 0, "c", 0, 60, [(0, 5)], "AAGAA", False, "A+a,0,0,0;", [240, 0, 100], [3], [1]))
    r = modbam.training_tags(reads).first()
    assert (r.mm, r.ml) == ("A+a,0,0,1;", [255, 0, 0])  # the third is unsure, the last has no score
    r = modbam.training_tags(reads, use_nucleosome=True).first()
    assert (r.mm, r.ml) == ("A+a,1,1;", [0, 255])


def test_predictions_and_comparison(spark):
    reads = records(spark, ("a", 0, "c", 0, 60, [(0, 6)], "ACGACA", False, None, None, None, None))
    calls = spark.createDataFrame([("a", 1, "[CpG]", 0.9, 0), ("a", 4, "[CpG]", 0.9, 1), ("a", 4, "[CpG]", 0.5, 2)], "read_id string, read_pos int, methy_type string, prob_methylated double, line_no long")
    r = modbam.predictions_to_tags(reads, calls).first()
    assert (r.mm, r.ml) == ("C+m,0,0;", [255, 0])
    base = spark.createDataFrame([("a", 1, 200), ("a", 4, 128), ("a", 5, 1)], "read_id string, read_pos int, score int")
    r = evaluation.compare(calls, base).first()
    assert (r.reads, r.sites, r.ratio, r.baseline_ratio) == (1, 2, 0.5, 1.0)


def test_fibres(spark):
    t = spark.createDataFrame([("0", "90", "100", "1,5,9,", "1,2,3,", "140,150,"), ("0", "10", "100", "1,5,", "1,2,", "1,"), ("0", "90", "100", "7", "1", "1,")], "st string, en string, fiber_length string, m6a string, m6a_qual string, nuc_lengths string")
    f = evaluation.fibre_records(t)
    r = evaluation.fibre_totals(f).first()
    assert (r.reads, r.marked, r.positions, r.nucleosomes) == (1, 3, 10, 2)
    assert evaluation.nucleosome_density(f).where(F.col("density") > 0).count() > 0


def test_evaluate(spark):
    calls = spark.createDataFrame([("c", p, "[CpG]", 0.9 if i < p else 0.1) for p in (1, 3, 5) for i in range(6)], "chrom string, ref_pos long, methy_type string, prob_methylated double")
    truth = spark.createDataFrame([("c", 1, 9, 0.0, 0), ("c", 3, 9, 50.0, 1), ("c", 5, 9, 100.0, 2)], "chrom string, start long, coverage int, percentage double, line_no long")
    out = evaluation.evaluate(calls, truth)
    assert out["site"].first().sites == 3 and out["site"].first().pearson == 1.0
    r = out["read"].first()
    assert (r.tp, r.fp, r.fn, r.tn) == (5, 1, 1, 5) and out["areas"].first().roc_auc == 0.8333
    empty = evaluation.evaluate(calls.limit(0), truth)
    assert empty["site"].first().sites == 0 and empty["areas"].first().roc_auc is None
