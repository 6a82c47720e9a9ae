"""Completeness of keyed patches as a stream: a read leaves when all its patches came, or late when its timer ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: In place of a read's number of patches: it has left.
GONE = -1
OUT = "read_id string, got int, expected int, complete boolean"


def completed_reads(patches: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """(read_id, patch_idx, total_patches, ts) as a stream -> one row per read.

    State is the set of indices seen, no larger than a read's patches. Repeats count once, also after the
    read has left: a mark of it stays until the watermark passes its last patch. A read that is still
    incomplete once the watermark passes its last patch by `delay` leaves as incomplete.
    """
    columns = ["read_id", "got", "expected", "complete"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total, last = state.get if state.exists else ([], 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], len(seen), total, False)] if total != GONE else [], columns=columns)
            return
        have, gone = set(seen), total == GONE
        for b in batches:
            have |= set(b.patch_idx.tolist())
            total = max(total, int(b.total_patches.max()))
            last = max(last, int(b.ts.max().timestamp() * 1000))
        done = not gone and len(have) >= total
        state.update(([], GONE, last) if gone or done else (sorted(have), total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + 1)
        yield pd.DataFrame([(key[0], len(have), total, True)] if done else [], columns=columns)

    keyed = patches.withWatermark("ts", delay).select(F.col("read_id").cast("string"), F.col("patch_idx").cast("int"), F.col("total_patches").cast("int"), "ts")
    return keyed.groupBy("read_id").applyInPandasWithState(step, OUT, "seen array<int>, total int, last long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_frequency(calls: DataFrame, *, delay: str = "10 minutes", width: str = "1 hour", methyl_threshold: float = 0.5) -> DataFrame:
    """Site counts of a stream of calls (chrom, ref_pos, prob_methylated, ts) in event-time windows (an extension)."""
    met = F.col("prob_methylated") >= methyl_threshold
    return calls.withWatermark("ts", delay).groupBy(F.window("ts", width), "chrom", "ref_pos").agg(F.count_if(met).alias("met"), F.count("*").alias("coverage"))
