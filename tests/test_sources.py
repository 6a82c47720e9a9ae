"""Files written in each format and read again."""

import gzip
import struct

import pytest

from pyspark.sql import functions as F

from strandloom.operators import frequency
from strandloom.operators.scoring import binned, score
from strandloom.schemas import READS
from strandloom.sources import bam, signals, text


def test_calls_drop_bad_rows(spark, tmp_path):
    good = "c\t5\t+\t-1\tr\t7\t[CpG]\t0.1\t0.9\t1\t."
    lines = ["# comment", "", good, "c\t5", good.replace("0.9", "x"), good.replace("\t7\t", "\tzz\t")]
    (tmp_path / "a.tsv").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write(good)
    got = [r.read_pos for r in text.read_calls(spark, str(tmp_path)).collect()]
    assert sorted(got) == [-1, 7, 7]
    assert text.read_calls(spark, str(tmp_path), file_uid="b").count() == 1
    assert text.read_calls(spark, str(tmp_path), max_lines=2).count() == 2
    out = text.call_lines(text.read_calls(spark, str(tmp_path / "a.tsv"))).first().value
    assert out == "c\t5\t+\t-1\tr\t7\t[CpG]\t0.100000\t0.900000\t1\t."
    text.write_lines(text.call_lines(text.read_calls(spark, str(tmp_path / "a.tsv"))), str(tmp_path / "o.gz"), one_file=True)
    assert text.read_calls(spark, str(tmp_path / "o.gz")).count() == 2


def test_bed_and_fasta(spark, tmp_path):
    (tmp_path / "t.bed").write_text("#x\nc\t1\t2\tn\t0\t+\t1\t2\t0,0,0\t9\t55.5\nshort\n")
    r = text.read_bed(spark, str(tmp_path / "t.bed")).first()
    assert (r.chrom, r.start, r.coverage, r.percentage) == ("c", 1, 9, 55.5)
    (tmp_path / "g.fa").write_text(">one some words\nacg\nTT\n>two\nGG\n")
    assert {r.contig: r.seq for r in text.read_fasta(spark, str(tmp_path / "g.fa")).collect()} == {"one": "ACGTT", "two": "GG"}
    assert [r.contig for r in text.contig_names(spark, str(tmp_path / "g.fa")).collect()] == ["one", "two"]
    assert [r.contig for r in text.contig_names(spark, "b,a,b").collect()] == ["a", "b"]
    parts = text.chunked(text.read_fasta(spark, str(tmp_path / "g.fa")), size=2, overlap=1).collect()
    assert {(r.contig, r.chunk): r.seq for r in parts} == {("one", 0): "ACG", ("one", 1): "GTT", ("one", 2): "T", ("two", 0): "GG"}


def test_sam_and_slow5(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tx\nr1\t16\tchr1\t11\t60\t2S3M1I\t*\t0\t0\tACGTAC\t*\tts:i:3\tmv:B:c,5,1,0\tMM:Z:C+m,0;\tML:B:C,200\tsm:f:0.5\tXX:Z:y\n")
    r = text.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (r.reference_start, r.is_reverse, r.ts, r.mv, r.ml, r.sm, r.tags_extra) == (10, True, 3, [5, 1, 0], [200], 0.5, {"XX": "y"})
    assert [(c.op, c.len) for c in r.cigar] == [(4, 2), (0, 3), (1, 1)]
    (tmp_path / "a.slow5").write_text("#slow5_version\t0.2.0\n@x\nread-1\t0\t8192\t3.0\t1467.6\t4000\t3\t1,2,3\n")
    r = signals.read_slow5(spark, str(tmp_path / "a.slow5")).first()
    assert (r.read_id, r.signal, r.cal_offset, r.cal_scale) == ("read-1", [1.0, 2.0, 3.0], 3.0, 1467.6 / 8192)


def test_bam_records(spark, tmp_path):
    def record(name, seq, tags):
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", 0, 10, len(name) + 1, 60, 0, 1, 16, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + b"\xff" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    tags = b"MMZC+m,0;\0" + b"MLBC" + struct.pack("<IB", 1, 200) + b"tsC\x03" + b"XYAq"
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + record("r1", "ACGTA", tags) + record("r2", "AC", b"")
    (tmp_path / "a.bam").write_bytes(gzip.compress(data[:60]) + gzip.compress(data[60:]))
    got = bam.typed(bam.read_bam(spark, str(tmp_path))).orderBy("query_name").collect()
    assert [(r.query_name, r.reference_name, r.reference_start, r.seq, r.is_reverse) for r in got] == [("r1", "chr1", 10, "ACGTA", True), ("r2", "chr1", 10, "AC", True)]
    assert (got[0].mm, got[0].ml, got[0].ts, got[0].tags_extra) == ("C+m,0;", [200], 3, {"XY": "q"})


def test_scoring(spark):
    p = spark.createDataFrame([("a", 0, [1.0, -1.0]), ("a", 1, [2.0]), ("b", 0, [])], "read_id string, patch_idx int, signals array<float>")
    got = {(r.read_id, r.patch_idx): r.probability for r in score(binned(p)).collect()}
    assert got["a", 0] == 0.5 and got["b", 0] == 0.5 and abs(got["a", 1] - 1 / (1 + 2.718281828459045 ** -4)) < 1e-9
    assert p.where(F.size("signals") > 5).count() == 0


def test_lines_keep_the_order_of_files_and_blocks(spark, tmp_path):
    """Spark packs files by falling size, so a small first file is read behind a large second one."""
    call = lambda pos, place, kmer: f"c\t{pos}\t+\t{place}\tr\t1\t[CpG]\t0.1\t0.9\t1\t{kmer}\n"
    (tmp_path / "a.tsv").write_text(call(5, 3, "first"))
    (tmp_path / "b.tsv").write_text("".join(call(5, 4, "second") + call(6, ".", f"k{i}") for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = text.read_mod_records(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 2
        sites = {r.pos: r for r in frequency.site_frequency(rows).collect()}
        ordered = [r.kmer for r in rows.where("ref_pos = 6").orderBy("line_no").select("kmer").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (sites[5].kmer, sites[5].pos_in_strand, sites[6].kmer, sites[6].pos_in_strand) == ("first", 3, "k0", -1)
    assert ordered == [f"k{i}" for i in range(2000)]
    assert [r.pos for r in frequency.in_order(frequency.site_frequency(rows), by="first_seen").collect()] == [5, 6]


def test_limited_calls_are_the_first_valid_ones(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("bad line\n" + "".join(f"c\t{i}\t+\t0\tr\t1\t[CpG]\t0.1\t0.9\t1\t.\n" for i in range(3)))
    (tmp_path / "b.tsv").write_text("".join(f"c\t{100 + i}\t+\t0\tr\t1\t[CpG]\t0.1\t0.9\t1\t.\n" for i in range(500)))
    assert [r.ref_pos for r in text.read_calls(spark, str(tmp_path), max_lines=4).orderBy("line_no").collect()] == [0, 1, 2, 100]


def test_signal_paths_names_and_nested_ids(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name in ("b.BLOW5", "a.pod5", "notes.txt", "nested/d.fast5"):
        (tmp_path / name).write_text("")
    (tmp_path / "nested/c.slow5").write_text("#slow5_version\t0.2.0\n#read_name\tdigitization\trange\traw_signal_pa\n@asic\tx\nread-1\t8.0\t4.0\t1,2\n")
    assert [p.rsplit("/", 1)[1] for p in signals.signal_paths(spark, str(tmp_path))] == ["a.pod5", "b.BLOW5", "c.slow5"]
    assert signals.signal_paths(spark, str(tmp_path), suffixes=("slow5",))[0].endswith("nested/c.slow5")
    for bad, error in (("notes.txt", ValueError), ("a.pod5", NotImplementedError)):
        with pytest.raises(error):
            signals.read_signals(spark, str(tmp_path / bad))
    with pytest.raises(FileNotFoundError):
        signals.signal_paths(spark, str(tmp_path / "nested"), suffixes=("pod5",))
    (tmp_path / "nested/e.slow5").write_text("read-2\t0\t8192\t3.0\t1467.6\t4000\t3\t1,2,3\n")
    got = {r.read_id: r for r in signals.read_signals(spark, str(tmp_path / "nested")).collect()}
    assert (got["read-1"].signal, got["read-1"].cal_offset, got["read-1"].cal_scale) == ([1.0, 2.0], 0.0, 0.5)
    assert (got["read-2"].signal, got["read-2"].cal_offset, got["read-2"].cal_scale) == ([1.0, 2.0, 3.0], 3.0, 1467.6 / 8192)
    ids = spark.createDataFrame([('[["read-1", "read-2"], 4000, [["x\\"y"]]]',)], "ids string")
    assert ids.select(signals.flat_read_ids("ids")).first()[0] == ["read-1", "read-2", 'x"y']


def test_bam_written_read_in_splits_and_merged(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(3000):
        n = rng.choice([1, 50, 400])
        aligned = i % 5 != 0
        rows.append((f"r{i}", None if i % 3 else f"p{i}", 0 if aligned else 4, f"chr{rng.choice('AB')}" if aligned else None, rng.randrange(10_000) if aligned else -1, 60, [{"op": 0, "len": n}] if aligned else [], None, -1, 0, "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("!5I", k=n)), False, 7, None, [5, 1, 0], 0.5, None, "C+m,0;", [200], None, None, {"XY": "q", "NM": "3"}))
    df = spark.createDataFrame(rows, READS)
    bam.write_bam(df.repartition(3), str(tmp_path / "out"), [("chrB", 10_000), ("chrA", 10_000)])
    assert not (tmp_path / "out/_temporary").exists()
    read = bam.read_bam(spark, str(tmp_path / "out"), split=20_000)
    assert read.rdd.getNumPartitions() > 6
    got = bam.typed(read).orderBy("line_no").collect()
    assert sorted(r.query_name for r in got) == sorted(r[0] for r in rows)
    rank = {"chrB": 0, "chrA": 1, None: 2}
    assert [(rank[r.reference_name], r.reference_start) for r in got] == sorted((rank[r.reference_name], r.reference_start) for r in got)
    by = {r[0]: r for r in rows}
    for r in got:
        w = by[r.query_name]
        assert (r.parent_id, r.flag, r.seq, r.qual, r.mv, r.sm, r.mm, r.ml, r.tags_extra, [c.asDict() for c in r.cigar]) == (w[1], w[2], w[10], w[11], w[15], w[16], w[18], w[19], w[22], w[6])
    bam.merge_parts(str(tmp_path / "out"), str(tmp_path / "whole.bam"))
    for split in (5_000, 1 << 30):
        whole = bam.read_bam(spark, str(tmp_path / "whole.bam"), split=split).orderBy("path", "record").select("query_name").collect()
        assert [r.query_name for r in whole] == [r.query_name for r in got]
    with pytest.raises(Exception, match="chrA"):
        bam.write_bam(df, str(tmp_path / "bad"), [("chrB", 10_000)])
    assert not any((tmp_path / "bad").glob("*.bam"))
    bam.write_bam(df.where("flag = 4").coalesce(1), str(tmp_path / "plain"), [])
    assert bam.read_bam(spark, str(tmp_path / "plain")).count() == 600
