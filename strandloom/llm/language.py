"""Language of a text by a byte convolutional network, trained and applied in numpy.

Bytes get small vectors, filters of several widths slide over fixed-length windows, each filter
keeps its largest response, and a softmax tells the language. A document's prediction averages its
windows, which cover the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, id_remainder, tune_batches

WINDOW, WIDTHS, EACH, DIM = 192, (2, 3, 4), 8, 4
#: Labelled documents of a language that the network is fitted on, about (a sample by hash), and windows of each.
FIT_DOCS, FIT_WINDOWS = 500, 4
EPOCHS, BATCH, RATE = 12, 64, 0.01
_LETTER = re.compile(r"[^\W\d_]")


class Network(NamedTuple):
    languages: list[str]
    bytes: np.ndarray  # 256 x DIM
    filters: np.ndarray  # DIM * widest x filters
    offset: np.ndarray
    out: np.ndarray  # filters x languages
    bias: np.ndarray


def _mask() -> np.ndarray:
    """Which weights of each filter lie within its width."""
    widths = np.repeat(WIDTHS, EACH)
    return (np.arange(DIM * max(WIDTHS))[:, None] < DIM * widths[None]).astype(np.float32)


def windows(data: bytes) -> np.ndarray:
    """Windows that cover all bytes and all filter places; the last is filled up with zeros."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    whole = np.zeros((n - 1) * step + WINDOW, np.uint8)
    whole[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, WINDOW)[::step]


def _patches(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    x = table[rows].reshape(len(rows), -1)
    view = np.lib.stride_tricks.sliding_window_view(x, DIM * max(WIDTHS), axis=1)[:, ::DIM]
    return np.ascontiguousarray(view)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def apply(net: Network, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the languages for each window."""
    out = np.empty((len(rows), len(net.languages)), np.float32)
    for a in range(0, len(rows), 64):
        p = _patches(rows[a : a + 64], net.bytes)
        top = (p.reshape(-1, p.shape[2]) @ net.filters).reshape(p.shape[0], p.shape[1], -1).max(1)
        out[a : a + 64] = _softmax(np.maximum(top + net.offset, 0) @ net.out + net.bias)
    return out


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], *, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the cross entropy of labelled windows, each language weighted alike."""
    rng = np.random.default_rng(seed)
    mask, k = _mask(), len(languages)
    net = [
        rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.3, mask.shape) * mask, np.zeros(mask.shape[1]),
        rng.normal(0, 0.2, (mask.shape[1], k)), np.zeros(k),
    ]
    net = [x.astype(np.float32) for x in net]
    first, second, t = [np.zeros_like(x) for x in net], [np.zeros_like(x) for x in net], 0
    weight = (1 / np.maximum(np.bincount(labels, minlength=k), 1)).astype(np.float32)
    weight *= len(labels) / max(weight[labels].sum(), 1e-9)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            some = order[a : a + BATCH]
            x, y = rows[some], labels[some]
            table, filters, offset, out, bias = net
            p = _patches(x, table)
            response = (p.reshape(-1, p.shape[2]) @ filters).reshape(p.shape[0], p.shape[1], -1)
            where = response.argmax(1)
            top = np.take_along_axis(response, where[:, None], 1)[:, 0] + offset
            h = np.maximum(top, 0)
            g = _softmax(h @ out + bias)
            g[np.arange(len(y)), y] -= 1
            g *= (weight[y] / len(y))[:, None]
            gh = g @ out.T * (top > 0)
            chosen = p[np.arange(len(x))[:, None], where]  # windows x filters x patch
            gf = np.einsum("nf,nfd->df", gh, chosen) * mask
            gp = gh[:, :, None] * filters.T[None]
            spots = where[:, :, None] + np.arange(max(WIDTHS))[None, None]
            gt = np.zeros_like(table)
            np.add.at(gt, x[np.arange(len(x))[:, None, None], spots], gp.reshape(*spots.shape, DIM))
            t += 1
            for i, grad in enumerate((gt, gf, gh.sum(0), h.T @ g, g.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                net[i] = (net[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            net[1] *= mask
    return Network(languages, *net)


def fit(docs: DataFrame, *, per_language: int = FIT_DOCS, epochs: int = EPOCHS) -> Network | None:
    """Network from documents with a language that are not held out; None without any.

    About per_language documents of each language are drawn by a hash of their id, FIT_WINDOWS
    evenly spaced windows of each; that bounds what reaches the driver, whatever the corpus.
    """
    tune_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = rows.where(F.col("lang").isNotNull() & (F.coalesce(id_remainder("doc_id", 4), F.lit(0)) != 2))
    sizes = rows.groupBy("lang").count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(1 << 20)) / float(1 << 20)
    # one row a language
    drawn = rows.join(F.broadcast(sizes), "lang").where(chance * F.col("count") < per_language)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("window", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, text, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                if text and _LETTER.search(text):
                    w = windows(text.encode())
                    out += [(d, lang, w[i].tobytes()) for i in sorted({len(w) * j // FIT_WINDOWS for j in range(FIT_WINDOWS)})]
            if out:
                yield batch(schema, *map(list, zip(*out)))

    found = sorted({(r.lang, r.doc_id if r.doc_id is not None else -1, bytes(r.window)) for r in drawn.select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, lang string, window binary").collect()})
    if not found:
        return None
    languages = sorted({r[0] for r in found})
    return train(np.stack([np.frombuffer(r[2], np.uint8) for r in found]), np.array([languages.index(r[0]) for r in found]), languages, epochs=epochs)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Windows are averaged by their number of letters, a byte outside ASCII counting as one. Texts that
    are null or without a letter, and all if there is no network, are `und` with score 0. A null
    doc_id is not held out.
    """
    tune_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    letter = np.zeros(256, np.float32)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            told, scores = ["und"] * len(texts), [0.0] * len(texts)
            for i, t in enumerate(texts):
                if net is not None and t and _LETTER.search(t):
                    rows = windows(t.encode())
                    weight = letter[rows].sum(1)
                    p = (apply(net, rows) * weight[:, None]).sum(0) / max(float(weight.sum()), 1.0)
                    j = int(p.argmax())
                    told[i], scores[i] = net.languages[j], min(1.0, float(p[j]))
            yield batch(schema, b.column("doc_id"), told, scores)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return made.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def languages(docs: DataFrame, **options) -> DataFrame:
    """predict() by a network fitted on the same documents, those held out apart."""
    return predict(docs, fit(docs, **options))
