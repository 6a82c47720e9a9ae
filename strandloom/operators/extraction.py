"""Feature extraction: signals joined with reads, segmented by move tables, typed, and cut into model windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna, signal, tags
from . import filters, modbam, patches, reads

END_ID = signal.VOCABULARY.index("[END]")


def _labels(fwd: Column, mm: Column, ml: Column, kind: str) -> Column:
    """Position -> 0..100 label of a forward sequence's modifications; empty without tags."""
    found = F.when(mm.isNotNull(), modbam.modifications(fwd, mm, ml, kind))
    kept = F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<struct<pos:int,score:int>>")), lambda m: F.struct(m["pos"].cast("int").alias("pos"), tags.bisulfite_label(m["score"]).alias("label"))))
    return F.map_from_entries(F.filter(kept, lambda m: m["pos"].isNotNull()))


def features(
    signals: DataFrame, alignments: DataFrame, *, least: int = 0, chrom: str = "|", cpg: bool = True, chg: bool = False, chh: bool = False, m6a: bool = False,
    frequency: str = "4khz", dorado_version: float = 0.71,
) -> DataFrame:
    """One row per signal and alignment of it that is fit for extraction.

    read_id, chrom ('*' if unaligned), strand, signal, norm, tokens (token, start, len: bases with their
    samples, each site's context token behind its base without any), and sites (at: the token's place,
    read_pos, ref_pos or -1, label 0..100 or -1), ascending. Reads without a move table, or whose move
    table tells another number of bases than their sequence has, are dropped; signals and reads meet
    by either name of a split read.
    """
    own = filters.extractable(alignments, least=least, chrom=chrom).where(F.col("seq").isNotNull() & F.col("mv").isNotNull())
    rows = reads.with_signals(signals, own)
    fwd = dna.forward(F.upper("seq"), F.col("is_reverse"))
    bounds = signal.move_bounds(F.col("mv"), signal.move_start(F.col("ts"), F.col("sp")), F.size("signal"))
    rows = rows.withColumn("fwd", fwd).withColumn("events", signal.segments(bounds)).where(F.size("events") == F.length("fwd"))
    kind = "m6A" if m6a and not (cpg or chg or chh) else "m"
    found = dna.sites(F.col("fwd"), cpg=cpg, chg=chg, chh=chh, m6a=m6a)
    rows = rows.withColumn("found", found).withColumn("known", _labels(F.col("fwd"), F.col("mm"), F.col("ml"), kind))
    n, at = F.length("fwd"), F.transform("found", lambda s: s["pos"])
    aligned = reads.reference_positions(reads.aligned_pairs(F.col("cigar"), F.col("reference_start")), at, n, F.col("is_reverse"))
    ref = F.when(F.col("reference_name").isNotNull(), aligned).otherwise(F.transform("found", lambda s: F.lit(-1).cast("long")))
    rows = rows.withColumn("ref", ref)

    def site(s: Column, i: Column) -> Column:
        return F.struct((s["pos"] + i + 1).cast("int").alias("at"), s["pos"].cast("int").alias("read_pos"), F.get("ref", i).alias("ref_pos"), F.coalesce(F.col("known")[s["pos"].cast("int")], F.lit(-1)).alias("label"))

    def told(token: Column, start: Column, length: Column) -> Column:
        return F.struct(token.alias("token"), start.cast("int").alias("start"), length.cast("int").alias("len"))

    bases = F.zip_with(F.split("fwd", ""), F.col("events"), lambda b, e: told(b, e["start"], e["len"]))
    marks = F.transform("found", lambda s: F.struct(s["pos"].alias("pos"), told(s["methy_type"], F.lit(0), F.lit(0)).alias("token")))
    norm = signal.normalization(F.col("sm"), F.col("sd"), F.col("cal_offset"), F.col("cal_scale"), frequency=frequency, dorado_version=dorado_version)
    return rows.select(
        F.col("query_name").alias("read_id"), F.coalesce("reference_name", F.lit("*")).alias("chrom"), F.when(F.col("is_reverse"), "-").otherwise("+").alias("strand"),
        "signal", norm.alias("norm"), signal.with_context_tokens(bases, marks).alias("tokens"), F.transform("found", site).alias("sites"),
    )


def windows(made: DataFrame, *, chunk: int = patches.CHUNK, overlap: int = patches.OVERLAP, stride: int = 4) -> DataFrame:
    """features() cut into windows of `chunk` tokens that overlap: what a model is given.

    read_id, patch_idx, total_patches, chrom, strand, signals (normalized samples of the window's bases),
    signal_pos (of every stride-th sample, its base's place in the window), ids (tokens and an end), and
    sites (patch_pos, token, read_pos, ref_pos, label) that this window owns. A window is built from its
    own slices of the read, so a read's signal isn't copied for each. Reads shorter than two overlaps
    give one window, or none without sites.
    """
    size = F.size("tokens")
    starts = F.when((F.size("sites") > 0) | (size > 2 * overlap), patches.starts(size, chunk=chunk, overlap=overlap)).otherwise(F.array().cast("array<int>"))

    def window(s: Column, i: Column) -> Column:
        own = F.slice("tokens", s + 1, chunk)
        samples = F.flatten(F.transform(own, lambda t: F.slice("signal", t["start"] + 1, t["len"])))
        index = signal.signal_index(F.transform(own, lambda t: t["len"]), stride)
        ids = F.concat(signal.token_ids(F.transform(own, lambda t: t["token"])), F.array(F.lit(END_ID)))
        mine = F.filter("sites", lambda x: patches.owner(x["at"], size, chunk=chunk, overlap=overlap) == i)
        placed = F.transform(mine, lambda x: F.struct((x["at"] - s).cast("int").alias("patch_pos"), F.get("tokens", x["at"])["token"].alias("token"), x["read_pos"], x["ref_pos"], x["label"]))
        return F.struct(signal.normalized(samples, F.col("norm")).alias("signals"), index.alias("signal_pos"), ids.alias("ids"), placed.alias("sites"))

    cut = made.select("read_id", "chrom", "strand", F.size(starts).alias("total_patches"), F.posexplode(F.transform(starts, window)).alias("patch_idx", "w"))
    return cut.select("read_id", "patch_idx", "total_patches", "chrom", "strand", "w.signals", "w.signal_pos", "w.ids", "w.sites")


def called(scored: DataFrame) -> DataFrame:
    """windows() with a column probabilities, one for each of a window's sites, as call rows."""
    each = F.explode(F.arrays_zip("sites", "probabilities")).alias("x")
    rows = scored.select("read_id", "chrom", "strand", each)
    p = F.col("x.probabilities")
    return rows.select(
        "chrom", F.col("x.sites.ref_pos").alias("ref_pos"), "strand", F.col("x.sites.label").alias("label"), "read_id", F.col("x.sites.read_pos").alias("read_pos"), F.col("x.sites.token").alias("methy_type"),
        (1 - p).alias("prob_unmethylated"), p.alias("prob_methylated"), tags.hard_call(p).alias("prediction"), F.lit(".").alias("kmer"),
    )
