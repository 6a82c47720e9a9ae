"""From signals and records to call files, and the options behind it."""

import glob

import pytest

from strandloom import cli, config
from strandloom.sources import text


def test_options_come_from_presets_files_and_callers(tmp_path):
    assert config.options() == config.Options() and config.options("distilled").stride == 8
    config.save(config.merged({"cpg": 1, "overlap": None, "other": 3}, config.Options()), tmp_path / "c.json")
    assert config.options(tmp_path / "c.json") == config.Options(cpg=1) == config.options({"cpg": 1})
    with pytest.raises(FileNotFoundError):
        config.options("nothing")
    with pytest.raises(TypeError):
        config.options({"unknown": 1})


def test_infer_writes_calls(spark, tmp_path):
    seq = "ACGTTCAGCAT"
    mv = "mv:B:c,1," + ",".join(["1"] * len(seq))
    tags = f"ts:i:0\tsm:f:0.0\tsd:f:1.0\t{mv}"
    (tmp_path / "a.sam").write_text(f"@SQ\tSN:c\tLN:900\nr1\t0\tc\t11\t60\t{len(seq)}M\t*\t0\t0\t{seq}\t*\t{tags}\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t{seq}\t*\t{tags}\nr3\t0\tc\t1\t1\t{len(seq)}M\t*\t0\t0\t{seq}\t*\t{tags}\n")
    (tmp_path / "s.slow5").write_text("".join(f"r{i}\t0\t1\t0\t1\t4000\t{len(seq)}\t" + ",".join(str(x % 3 - i) for x in range(len(seq))) + "\n" for i in (1, 2, 3)))
    cli.main(["infer", "--signals", str(tmp_path / "s.slow5"), "--bam", str(tmp_path / "a.sam"), "--out", str(tmp_path / "calls"), "--cpg", "1", "--chg", "1", "--mapq", "10"])
    got = {(r.read_id, r.read_pos): r for r in text.read_calls(spark, str(tmp_path / "calls")).collect()}
    assert {(k, r.methy_type, r.chrom, r.ref_pos) for k, r in got.items()} == {(("r1", 1), "[CpG]", "c", 11), (("r1", 5), "[CHG]", "c", 15), (("r2", 1), "[CpG]", "*", -1), (("r2", 5), "[CHG]", "*", -1)}
    assert all(abs(r.prob_methylated + r.prob_unmethylated - 1) < 2e-6 and r.label == -1 for r in got.values())
    cli.main(["infer", "--signals", str(tmp_path / "s.slow5"), "--bam", str(tmp_path / "a.sam"), "--out", str(tmp_path / "one"), "--cpg", "1", "--limit", "1", "--batch_size", "1"])
    lines = [x for f in glob.glob(f"{tmp_path}/one/part*") for x in open(f).read().splitlines()]
    assert [x.split("\t")[4] for x in lines] == ["r1"]
