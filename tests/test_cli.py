import gzip
import glob

from strandloom import cli
from strandloom.sources import bam


def test_commands(spark, tmp_path):
    calls = "".join(f"c\t{p}\t+\t50\tr{i}\t{p}\t[CpG]\t{1 - q}\t{q}\t{int(q > 0.5)}\t.\n" for p in (0, 3) for i, q in enumerate((0.9, 0.1, 0.9, 0.9, 0.1, 0.5)))
    (tmp_path / "calls.tsv").write_text(calls)
    (tmp_path / "g.fa").write_text(">c\nCGACAT\n")
    (tmp_path / "t.bed").write_text("".join(f"c\t{p}\t{p + 1}\tn\t0\t+\t0\t0\t0\t9\t{v}\n" for p, v in ((0, 100), (3, 0))))
    src = str(tmp_path / "calls.tsv")
    cli.main(["frequency", "--input_path", src, "--result_file", str(tmp_path / "f"), "--sort"])
    lines = [x for f in sorted(glob.glob(f"{tmp_path}/f/part*")) for x in open(f).read().splitlines()]
    assert lines[0].split("\t") == ["c", "0", "+", "50", "2.600", "3.400", "4", "2", "6", "0.6667", "."]
    cli.main(["frequency", "--input_path", src, "--result_file", str(tmp_path / "b"), "--bed", "--gzip", "--ref", str(tmp_path / "g.fa"), "--motif", "CG"])
    lines = [x for f in glob.glob(f"{tmp_path}/b/part*.gz") for x in gzip.open(f, "rt").read().splitlines()]
    assert [x.split("\t")[1::9] for x in lines] == [["0", "67"]]
    cli.main(["split", "--callmods_file", src, "--ref", str(tmp_path / "g.fa"), "--out", str(tmp_path / "s")])
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"motif=CG", "motif=CHH"}
    cli.main(["evaluate", "--tsv_dir", src, "--CpG_bed_dir", str(tmp_path / "t.bed")])
    cli.main(["annotate", "--pred_result", src, "--out", str(tmp_path / "l")])
    got = {(r.pos, r.read_id): r.label for r in spark.read.parquet(str(tmp_path / "l")).collect()}
    assert sum(v == 100 for v in got.values()) == 6 and got[0, "r0"] == 100 and got[0, "r1"] == 0
    (tmp_path / "a.sam").write_text("r\t0\tc\t1\t60\t6M\t*\t0\t0\tCGACAT\t*\n")
    cli.main(["bed_to_tags", "--bed_file_dir", str(tmp_path / "t.bed"), "--sam_or_bam", str(tmp_path / "a.sam"), "--out_folder", str(tmp_path / "o")])
    r = spark.read.parquet(str(tmp_path / "o")).first()
    assert (r.mm, r.ml) == ("C+m,0,0;", [255, 0])
    (tmp_path / "h.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:z\tLN:9\n@SQ\tSN:c\tLN:60\nr\t0\tc\t1\t60\t6M\t*\t0\t0\tCGACAT\t*\n")
    cli.main(["bed_to_tags", "--bed_file_dir", str(tmp_path / "t.bed"), "--sam_or_bam", str(tmp_path / "h.sam"), "--out_folder", str(tmp_path / "bam"), "--out_format", "bam"])
    assert bam.contigs_of(str(tmp_path / "bam")) == [("z", 9), ("c", 60)]
    r = bam.typed(bam.read_bam(spark, str(tmp_path / "bam"))).first()
    assert (r.reference_name, r.mm, r.ml) == ("c", "C+m,0,0;", [255, 0])
