"""Scoring of model windows in batches, behind one interface; layout by length before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import softmax_probability

#: A scorer takes padded signals (batch x samples) and their lengths and gives (batch x 2) logits.
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def stand_in(signals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A deterministic scorer for tests: logits from the mean of each signal."""
    mean = signals.sum(1) / np.maximum(lengths, 1)
    return np.stack((-mean, mean), 1)


def collate(signals: list, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signals padded with zeros, lengths, mask lengths (n - 1) // stride + 1)."""
    n = np.array([len(s) for s in signals], np.int64)
    out = np.zeros((len(signals), int(n.max(initial=0))), np.float32)
    for i, s in enumerate(signals):
        out[i, : len(s)] = s
    return out, n, np.where(n > 0, (n - 1) // stride + 1, 0)


def binned(patches: DataFrame, *, width: int = 500) -> DataFrame:
    """Windows of alike length together, so that padding is small: ranges of length, sorted within each."""
    n = F.size("signals")
    return patches.repartitionByRange(F.floor(n / width), F.xxhash64("read_id")).sortWithinPartitions(n)


def score(patches: DataFrame, scorer: Scorer = stand_in, *, batch_size: int = 512) -> DataFrame:
    """patches (read_id, patch_idx, signals) -> read_id, patch_idx, probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch_size):
                part = pdf.iloc[a : a + batch_size]
                padded, n, _ = collate(part.signals.tolist())
                logits = scorer(padded, n)
                yield pd.DataFrame({"read_id": part.read_id, "patch_idx": part.patch_idx, "minus": logits[:, 0].astype(float), "plus": logits[:, 1].astype(float)})

    made = patches.select("read_id", "patch_idx", "signals").mapInPandas(run, "read_id string, patch_idx int, minus double, plus double")
    return made.select("read_id", "patch_idx", softmax_probability(F.col("minus"), F.col("plus")).alias("probability"))


#: Padding of signals, token ids and signal places in a batch. Fixed values.
PAD_SIGNAL, PAD_ID, PAD_POSITION = 0.0, -100, 256


class Batch(NamedTuple):
    """Padded windows: signals, signal places and token ids with their lengths, and each window's site places."""

    signals: np.ndarray
    signal_lengths: np.ndarray
    mask_lengths: np.ndarray
    signal_pos: np.ndarray
    ids: np.ndarray
    patch_pos: list[np.ndarray]


#: Gives a (sites x 2) array of logits for each window.
SiteScorer = Callable[[Batch], list[np.ndarray]]


def _padded(rows: list, value: float, kind: type) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), value, kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def window_batch(signals: list, signal_pos: list, ids: list, patch_pos: list, stride: int = 4) -> Batch:
    _, n, masks = collate(signals, stride)
    return Batch(_padded(signals, PAD_SIGNAL, np.float32), n, masks, _padded(signal_pos, PAD_POSITION, np.int64), _padded(ids, PAD_ID, np.int64), [np.asarray(p, np.int64) for p in patch_pos])


def stand_in_sites(b: Batch) -> list[np.ndarray]:
    """A deterministic scorer for tests: logits of a site from its window's mean signal, its place and the token there."""
    mean = b.signals.sum(1) / np.maximum(b.signal_lengths, 1)
    out = []
    for i, at in enumerate(b.patch_pos):
        x = mean[i] + (b.ids[i, at] % 5 - 2) / 4 + (at % 3 - 1) / 8 if len(at) else np.zeros(0)
        out.append(np.stack((-x, x), 1))
    return out


def score_sites(windows: DataFrame, scorer: SiteScorer = stand_in_sites, *, batch_size: int = 512, stride: int = 4) -> DataFrame:
    """extraction.windows() with probabilities, one for each of a window's sites; a window without sites has an empty list.

    A task holds one batch of windows at a time.
    """
    spark = windows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_size))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in windows.schema)}, probabilities array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = [[s["patch_pos"] for s in x] for x in b.column("sites").to_pylist()]
            made = window_batch([x.values.to_numpy() for x in b.column("signals")], b.column("signal_pos").to_pylist(), b.column("ids").to_pylist(), place, stride)
            p = [(1 / (1 + np.exp(x[:, 0] - x[:, 1]))).astype(float).tolist() for x in scorer(made)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.list_(pa.float64()))], names=[*b.schema.names, "probabilities"])

    return windows.mapInArrow(run, schema)
