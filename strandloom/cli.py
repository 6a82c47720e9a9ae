"""Command line: `python -m strandloom.cli COMMAND --help`. Options have the operators' names and defaults."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("frequency", help="site frequencies of call files")
    f.add_argument("--input_path", action="append", required=True)
    f.add_argument("--result_file", required=True)
    f.add_argument("--prob_cf", type=float, default=0.0)
    f.add_argument("--methyl_threshold", type=float, default=0.5)
    f.add_argument("--file_uid")
    f.add_argument("--ref")
    f.add_argument("--motif", default="C")
    f.add_argument("--mloc_in_motif", type=int, default=0)
    f.add_argument("--contigs")
    for flag in ("gzip", "bed", "sort", "use_prob", "use_floor"):
        f.add_argument(f"--{flag}", action="store_true")
    e = sub.add_parser("evaluate", help="calls against bisulfite truth")
    e.add_argument("--tsv_dir", required=True)
    for context in ("CpG", "CHG", "CHH"):
        e.add_argument(f"--{context}_bed_dir")
    s = sub.add_parser("split", help="call files by genome context")
    s.add_argument("--callmods_file", required=True)
    s.add_argument("--ref", required=True)
    s.add_argument("--out", required=True)
    b = sub.add_parser("bed_to_tags", help="records tagged with site labels, as Parquet or BAM parts")
    b.add_argument("--bed_file_dir", nargs="+", required=True)
    b.add_argument("--sam_or_bam", required=True)
    b.add_argument("--out_folder", required=True)
    b.add_argument("--out_format", choices=("parquet", "bam"), default="parquet")
    b.add_argument("--coverage_thres", type=int, default=5)
    b.add_argument("--mapq_thres", type=int, default=10)
    b.add_argument("--chr", default="|")
    q = sub.add_parser("annotate", help="read labels by quota from labelled calls, as Parquet")
    q.add_argument("--pred_result", required=True)
    q.add_argument("--out", required=True)
    i = sub.add_parser("infer", help="signals and records to calls, by a scorer of windows")
    i.add_argument("--signals", required=True, help="SLOW5 file or folder, or a Parquet table of the signals schema")
    i.add_argument("--bam", required=True, help="BAM file or folder, or SAM text")
    i.add_argument("--out", required=True)
    i.add_argument("--gzip", action="store_true")
    i.add_argument("--config", default="default", help="a preset's name or a JSON file")
    i.add_argument("--scorer", default="strandloom.operators.scoring:stand_in_sites", help="module:function")
    i.add_argument("--chr", default="|")
    i.add_argument("--limit", type=int, help="batches")
    for name in ("cpg", "chg", "chh", "m6A", "batch_size", "chunk_size", "overlap", "stride"):
        i.add_argument(f"--{name}", type=int)
    i.add_argument("--mapq", dest="mapq_thres", type=int)
    i.add_argument("--frequency")
    i.add_argument("--dorado_version", type=float)
    return p


def _infer(spark, o: argparse.Namespace) -> None:
    """Options that aren't told come from the configuration."""
    from importlib import import_module

    from . import config
    from .operators import extraction, ordering, scoring
    from .sources import bam, signals, text

    c = config.merged(vars(o), config.options(o.config))
    raw = spark.read.parquet(o.signals) if o.signals.rstrip("/").endswith(".parquet") else signals.read_signals(spark, o.signals)
    reads = text.read_sam(spark, o.bam) if o.bam.endswith(".sam") else bam.typed(bam.read_bam(spark, o.bam))
    made = extraction.features(raw, reads, least=c.mapq_thres, chrom=o.chr, cpg=bool(c.cpg), chg=bool(c.chg), chh=bool(c.chh), m6a=bool(c.m6A), frequency=c.frequency, dorado_version=c.dorado_version)
    cut = extraction.windows(made, chunk=c.chunk_size, overlap=c.overlap, stride=c.stride)
    if o.limit is not None:
        cut = ordering.first_batches(cut, o.limit, batch_size=c.batch_size, order=("read_id", "patch_idx"))
    module, name = o.scorer.split(":")
    scored = scoring.score_sites(cut, getattr(import_module(module), name), batch_size=c.batch_size, stride=c.stride)
    text.write_lines(text.call_lines(extraction.called(scored)), o.out, gzip=o.gzip)


def main(argv: list[str] | None = None) -> None:
    from .operators import evaluation, filters, frequency, modbam, sites
    from .session import session
    from .sources import bam, text

    o = _parser().parse_args(argv)
    spark = session()
    if o.command == "infer":
        _infer(spark, o)
    elif o.command == "frequency":
        calls = text.read_mod_records(spark, o.input_path, file_uid=o.file_uid)
        if o.contigs:
            calls = calls.join(text.contig_names(spark, o.contigs), F.col("chrom") == F.col("contig"), "left_semi")
        if o.ref:
            calls = frequency.on_motif(calls, text.read_fasta(spark, o.ref), motif=o.motif, mloc=o.mloc_in_motif)
        found = frequency.site_frequency(calls, prob_cf=o.prob_cf, methyl_threshold=o.methyl_threshold, use_prob=o.use_prob)
        found = frequency.in_order(found, by="place" if o.sort else "first_seen")
        lines = text.bed_lines(frequency.bedmethyl(found, use_floor=o.use_floor)) if o.bed else text.frequency_lines(found)
        text.write_lines(lines, o.result_file, gzip=o.gzip)
    elif o.command == "evaluate":
        calls = text.read_calls(spark, o.tsv_dir)
        for context in ("CpG", "CHG", "CHH"):
            if path := getattr(o, f"{context}_bed_dir"):
                for name, df in evaluation.evaluate(calls, text.read_bed(spark, path), methy_type=f"[{context}]").items():
                    print(context, name, df.first().asDict())
    elif o.command == "split":
        text.write_by_motif(frequency.by_motif(text.read_calls(spark, o.callmods_file), text.read_fasta(spark, o.ref)), o.out)
    elif o.command == "bed_to_tags":
        wanted = filters.chromosome_filter(o.chr, F.col("chrom"))
        merged = sites.merge_labels([sites.covered(text.read_bed(spark, p), least=o.coverage_thres, chrom=wanted) for p in o.bed_file_dir])
        reads = bam.typed(bam.read_bam(spark, o.sam_or_bam)) if o.sam_or_bam.endswith(".bam") else text.read_sam(spark, o.sam_or_bam)
        labels = merged.select("chrom", F.col("start").alias("pos"), F.col("percentage").alias("score"))
        tagged = modbam.label_tags(reads, labels, least=o.mapq_thres)
        if o.out_format == "bam":
            bam.write_bam(tagged, o.out_folder, bam.contigs_of(o.sam_or_bam) if o.sam_or_bam.endswith(".bam") else text.sam_contigs(spark, o.sam_or_bam))
        else:
            tagged.write.parquet(o.out_folder)
    else:
        sites.quota_labels(text.read_calls(spark, o.pred_result)).select("read_id", "chrom", F.col("ref_pos").alias("pos"), F.col("read_label").alias("label")).write.parquet(o.out)


if __name__ == "__main__":
    main()
