"""Signals and reads to windows and calls, by hand-computed reads."""

from strandloom.operators import extraction, scoring
from strandloom.schemas import READS, SIGNALS

NONE = dict.fromkeys(x.split()[0] for x in READS.replace("array<struct<op:int,len:int>>", "x").replace("map<string,string>", "x").split(", "))


def read(**k):
    return tuple((NONE | {"query_name": "read-1", "flag": 0, "mapping_quality": 0, "reference_start": -1, "seq": "ACGTT", "is_reverse": False, "ts": 0, "mv": [1, 1, 1, 1, 1, 1], "sm": 0.0, "sd": 1.0} | k).values())


def test_unaligned_read(spark):
    signals = spark.createDataFrame([("read-1", [10.0, 11.0, 12.0, 13.0, 14.0, 15.0], 0.0, 1.0)], SIGNALS)
    made = extraction.features(signals, spark.createDataFrame([read()], READS))
    r = made.first()
    assert (r.chrom, r.strand) == ("*", "+") and [(s.read_pos, s.ref_pos, s.label, s.at) for s in r.sites] == [(1, -1, -1, 2)]
    assert [(t.token, t.start, t.len) for t in r.tokens] == [("A", 0, 1), ("C", 1, 1), ("[CpG]", 0, 0), ("G", 2, 1), ("T", 3, 1), ("T", 4, 2)]
    w = extraction.windows(made).first()
    assert (w.patch_idx, w.total_patches) == (0, 1) and [(s.patch_pos, s.read_pos, s.ref_pos) for s in w.sites] == [(2, 1, -1)]
    assert w.signals == [10.0, 11.0, 12.0, 13.0, 14.0, 15.0] and w.signal_pos == [0, 5] and w.ids[-1] == 2 and len(w.ids) == 7


def test_aligned_reverse_read_with_labels_and_filters(spark):
    cigar = [{"op": 4, "len": 1}, {"op": 0, "len": 4}]
    rows = [
        read(query_name="a", parent_id="p", reference_name="c", reference_start=100, mapping_quality=30, flag=16, is_reverse=True, seq="AACGT", cigar=cigar, mm="C+m,0;", ml=[255]),
        read(query_name="low", reference_name="c", reference_start=1, mapping_quality=3, cigar=cigar),
        read(query_name="second", reference_name="c", reference_start=1, mapping_quality=30, flag=256, cigar=cigar),
        read(query_name="odd", mv=[1, 1, 1]),
        read(query_name="none", mv=None),
    ]
    names = ("p", "low", "second", "odd", "none", "alone")
    signals = spark.createDataFrame([(n, [float(x) for x in range(6)], 1.0, 2.0) for n in names], SIGNALS)
    got = extraction.features(signals, spark.createDataFrame(rows, READS), least=10).collect()
    assert [r.read_id for r in got] == ["a"]
    # forward ACGTT; its C is the stored place 3, the reference base 100 + 2
    assert [(s.read_pos, s.ref_pos, s.label) for s in got[0].sites] == [(1, 102, 100)] and got[0].strand == "-"


def test_windows_own_each_site_once_and_calls_follow(spark):
    n = 300
    signals = spark.createDataFrame([("r", [float(x % 7) for x in range(2 * n)], 0.0, 1.0)], SIGNALS)
    made = extraction.features(signals, spark.createDataFrame([read(query_name="r", seq="CG" * (n // 2), mv=[2] + [1] * n)], READS))
    cut = extraction.windows(made, chunk=64, overlap=8).cache()
    assert cut.count() == cut.first().total_patches > 5
    owned = sorted(s.read_pos for w in cut.collect() for s in w.sites)
    assert owned == list(range(0, n, 2))
    scored = scoring.score_sites(cut)
    assert all(len(w.probabilities) == len(w.sites) for w in scored.collect())
    calls = extraction.called(scored).collect()
    assert len(calls) == n // 2 and all(abs(c.prob_methylated + c.prob_unmethylated - 1) < 1e-12 and c.prediction == int(c.prob_methylated > 0.5) for c in calls)
    assert {c.methy_type for c in calls} == {"[CpG]"} and {c.chrom for c in calls} == {"*"}


def test_batches_are_padded(spark):
    b = scoring.window_batch([[1.0, 2.0, 3.0, 4.0, 5.0], [1.0]], [[0, 3], [0]], [[3, 6, 2], [3]], [[1], []], 4)
    assert b.signals.tolist() == [[1, 2, 3, 4, 5], [1, 0, 0, 0, 0]] and b.mask_lengths.tolist() == [2, 1]
    assert b.signal_pos.tolist() == [[0, 3], [0, 256]] and b.ids.tolist() == [[3, 6, 2], [3, -100, -100]]
    assert [x.shape for x in scoring.stand_in_sites(b)] == [(1, 2), (0, 2)]
