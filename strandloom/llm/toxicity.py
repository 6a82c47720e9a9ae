"""Toxic passages as maximal-scoring segments of token log-odds with Dirichlet priors.

A word's score is the log-odds that a toxic rather than a clean labelled document holds it (or a
beginning of it), smoothed by a Dirichlet prior, less a cost that every token pays, so that the mean
score of clean text is negative. Documents, not occurrences, are counted, near copies once, and in a
text the k-th token of one term counts 1/k^2 of the first, so repeated lines don't pile up. A linear
scan finds every maximal segment. Segments are judged by the extreme-value law of clean text, whose
rate, factor and tail come from labelled documents scored by the model of the other half of them; the
sum statistic of a text's segments gives its chance in clean text, and that gives its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, id_remainder, lean, materialize, tune_batches

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that score words not kept themselves; results of look-ups a worker holds.
STEMS, HELD = (8, 7, 6, 5, 4, 3), 50_000
#: Labelled documents that the model is fitted on, at most: those with the smallest hashes of their ids.
FIT_DOCS = 30_000
#: Toxic documents that must hold a term, its least z, the prior weight, and the cost of any token.
LEAST_DOCS, LEAST_Z, PRIOR, COST = 3, 3.0, 1.0, 1.0
#: Share of clean documents that may score 0.7 or more.
ALPHA = 0.01


class Scores(dict):
    """(score, term) of a word by its whole form or the beginning that is surest; None without either."""

    def __init__(self, terms: dict[str, tuple[float, float]]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple[float, str] | None:
        if len(self) >= HELD:
            self.clear()
        found = [(*self.terms[x], x) for x in _terms_of(word) if x in self.terms]
        self[word] = out = max(found)[1:] if found else None
        return out

    def __reduce__(self):
        return Scores, (self.terms,)


def _terms_of(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in STEMS if len(word) >= k)]


class Tail(NamedTuple):
    """Chance that a clean document's evidence exceeds t: share * exp((start - t) / scale) beyond start."""

    start: float
    share: float
    scale: float

    def log_chance(self, t: float) -> float:
        if t <= 0:
            return 0.0
        if t < self.start:
            return math.log(self.share) * t / self.start
        return math.log(self.share) - (t - self.start) / self.scale


class Model(NamedTuple):
    scores: Scores
    cost: float
    rate: float  # lambda of the extreme-value law
    log_k: float
    tail: Tail
    alpha: float


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def segments(at: Sequence[int], gain: Sequence[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time.

    at, gain: positions of the tokens with a score above zero or below the cost, and that score;
    every other token scores minus cost. Each candidate keeps the total before and through it; a new
    one is joined to the nearest earlier one with a smaller total before it, if its own is larger.
    """
    stack: list[list] = []  # start, end, total before, total through, place in the stack of the nearest smaller
    total, done = 0.0, 0
    for i, g in zip(at, gain):
        before = total - cost * (i - done)
        total, done = before + g, i + 1
        if g <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = new[4] if new[4] >= 0 else len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4] if stack[j][4] >= 0 else -1
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2], new[4] = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            if not stack:
                new[4] = -1
                stack.append(new)
                break
    return [(s, e, through - before) for s, e, before, through, _ in stack]


def gains(words: Sequence[str], scores: Scores, cost: float) -> tuple[list[int], list[float]]:
    """Places and scores of the tokens that a term scores; the k-th token of a term counts 1/k^2 of the first."""
    at, out, seen = [], [], {}
    for i, found in enumerate(map(scores.__getitem__, words)):
        if found is not None:
            g, term = found
            k = seen[term] = seen.get(term, 0) + 1
            at.append(i)
            out.append((g + cost) / (k * k) - cost)
    return at, out


def passages(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the segments of a text."""
    words = tokens(text)
    return len(words), segments(*gains(words, model.scores, model.cost), model.cost)


def evidence(n: int, scores: Sequence[float], rate: float, log_k: float) -> float:
    """-log of the chance of the best r segments' sum in n clean tokens, at the r that gives the least; 0 if nothing is odd.

    r segments of normalized scores that sum to t have the chance exp(-t) t^(r-1) / (r! (r-1)!), and
    trying every r costs 2^r.
    """
    expect, best, t = math.log(max(n, 1)) + log_k, 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        t += rate * s - expect
        if t <= 0:
            break
        best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return best


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over clean tokens."""
    weights = weights / weights.sum()
    low, high = 1e-4, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (weights * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return low


_TEXTS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("sketch", pa.int64()), ("text", pa.string())])


def _labelled(docs: DataFrame, labels: DataFrame, fit_docs: int) -> DataFrame:
    """(toxic, half, text) of at most fit_docs labelled documents outside the held-out third, one of near copies.

    Copies share the smallest hash of their three-word runs; a half holds all documents of a hash.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (id_remainder("doc_id", 3) != 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("long").alias("toxic"), F.max("toxic").alias("most"))
    known = known.where("toxic = most and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs).select("doc_id", "toxic")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                w = tokens(t)
                out.append(min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1)
            yield batch(_TEXTS, b.column("doc_id"), b.column("toxic"), out, b.column("text"))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    rows = materialize(own.mapInArrow(lean(sketched), "doc_id long, toxic long, sketch long, text string"), "labelled")
    first = rows.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(F.broadcast(first), ["sketch", "toxic", "doc_id"], "left_semi")  # as many rows as fit_docs, at most
    return rows.select("toxic", F.xxhash64("sketch").bitwiseAND(1).alias("half"), "text")


_COUNT = pa.schema([("term", pa.string()), ("a", pa.int64()), ("b", pa.int64())])


def _document_counts(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """Documents of each half that hold a term, of the wanted terms if told, first summed over each stretch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            made = batch(_COUNT, names, *([h[x] for x in names] for h in held))
            held[0].clear(), held[1].clear()
            return made

        for b in batches:
            for t, half in zip(b.column("text").to_pylist(), b.column("half").to_pylist()):
                words = set(tokens(t))
                found = {f"={w}" for w in words}
                for k in STEMS:
                    found |= {f"^{w[:k]}" for w in words if len(w) >= k}
                held[half].update(found if wanted is None else found & wanted)
            if len(held[0]) + len(held[1]) > 100_000:
                yield out()
        yield out()

    return rows.select("text", "half").mapInArrow(lean(run), "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, prior: float, least_docs: int, least_z: float, cost: float) -> Scores:
    """Terms that mark toxic documents: (certainty, score), the log-odds shrunk by what chance explains."""
    out = {}
    for term, t in toxic.items():
        if t < least_docs:
            continue
        c = clean.get(term, 0)
        share = 0.5 + prior * (t + c) / (n_toxic + n_clean)
        in_t, in_c = t + share, c + share
        odds = math.log(in_t / (n_toxic + 1 + prior - in_t)) - math.log(in_c / (n_clean + 1 + prior - in_c))
        z = odds / math.sqrt(1 / in_t + 1 / in_c)
        score = odds * (1 - (least_z / z) ** 2 / 2) - cost if z >= least_z else 0.0
        if score > 0:
            out[term] = (odds * (1 - 2 / z), score)
    return Scores(out)


_SEEN = pa.schema([("toxic", pa.int64()), ("n", pa.int64()), ("gains", pa.list_(pa.float64())), ("segments", pa.list_(pa.float64()))])


def fit(docs: DataFrame, labels: DataFrame, *, fit_docs: int = FIT_DOCS, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z, prior: float = PRIOR, cost: float = COST, alpha: float = ALPHA) -> Model:
    """Model from labelled documents outside the held-out third.

    At most fit_docs of them, a sample by hash, are used, so that their ids may be broadcast and texts
    stay where they are; what comes to the driver (terms of at least least_docs toxic documents, scores of
    segments) is bounded by that sample. Labels other than 0 and 1, and ids labelled both ways, are left
    out. Without both labels in the sample every score is that of text without evidence.
    """
    tune_batches(docs.sparkSession)
    rows = materialize(_labelled(docs, labels, fit_docs), "fitted")
    size = {(r.toxic, r.half): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    n = {(label, half): size.get((label, half), 0) for label in (0, 1) for half in (0, 1)}
    nothing = Model(Scores({}), cost, 1.0, 0.0, Tail(0.0, 1.0, 1.0), alpha)
    if not (n[0, 0] + n[0, 1]) or not (n[1, 0] + n[1, 1]):
        return nothing
    toxic = {r.term: (r.a, r.b) for r in _document_counts(rows.where("toxic = 1"), None).where(F.col("a") + F.col("b") >= least_docs).collect()}
    wanted = frozenset(toxic)
    clean = {r.term: (r.a, r.b) for r in _document_counts(rows.where("toxic = 0"), wanted).collect()}

    def made(halves: tuple[int, ...]) -> Scores:
        own = lambda counts: {x: sum(v[h] for h in halves) for x, v in counts.items()}
        return _terms(own(toxic), own(clean), sum(n[1, h] for h in halves), sum(n[0, h] for h in halves), prior, least_docs, least_z, cost)

    whole, of_half = made((0, 1)), (made((0,)), made((1,)))
    if not whole.terms:
        return nothing

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, half, label in zip(*(b.column(c).to_pylist() for c in ("text", "half", "toxic"))):
                words = tokens(text)
                at, gain = gains(words, of_half[1 - half], cost)
                out.append((label, len(words), gain, [s for *_, s in segments(at, gain, cost)]))
            if out:
                yield batch(_SEEN, *map(list, zip(*out)))

    seen = rows.where("toxic = 0").mapInArrow(lean(measure), "toxic long, n long, gains array<double>, segments array<double>").collect()
    total = sum(r.n for r in seen)
    # one token of the highest score stands for what clean text has not shown yet
    met = Counter(round(g, 2) for r in seen for g in r.gains)
    met[max(s for _, s in whole.terms.values())] += 1
    met[-cost] += max(1, total - sum(met.values()))
    rate = _rate(np.array(list(met)), np.array(list(met.values()), float))
    found = sorted((s for r in seen for s in r.segments), reverse=True)[:100]
    log_k = math.log((len(found) or 0.5) / max(total, 1)) + rate * (found[-1] if found else 0.0)
    shown = sorted((evidence(r.n, r.segments, rate, log_k) for r in seen), reverse=True)
    start = shown[len(shown) // 20]
    over = [t - start for t in shown if t > start]
    tail = Tail(start, max(len(over), 0.5) / (len(shown) + 1), max(sum(over) / len(over) if over else 1.0, 0.5))
    return Model(whole, cost, rate, log_k, tail, alpha)


def probability(n: int, scores: Sequence[float], model: Model) -> float:
    """0.7 at the evidence that a share alpha of clean documents exceeds; more as it gets rarer."""
    odds = (math.log(model.alpha) - model.tail.log_chance(evidence(n, scores, model.rate, model.log_k))) / 2
    return 1 / (1 + 3 / 7 * math.exp(-max(-30.0, min(30.0, odds))))


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, score of every whole text, and its significant passages as (start, end, score) in tokens.

    A passage is significant if at most alpha as high ones are expected in clean text of its length.
    Null and empty texts score as text without tokens. Labels, lang, source and ids have no part.
    """
    tune_batches(docs.sparkSession)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, found = [], []
            for t in b.column("text").to_pylist():
                n, x = passages(t, model)
                scores.append(probability(n, [s for *_, s in x], model))
                least = math.log(max(n, 1)) + model.log_k - math.log(model.alpha)
                found.append([{"start": s, "end": e, "score": g} for s, e, g in x if model.rate * g >= least])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(k) for k in keep), pa.array(scores, pa.float64()), pa.array(found, spans)], names=["doc_id", *keep, "score", "passages"])

    kinds = dict(docs.dtypes)
    kept = "".join(f"{k} {kinds[k]}, " for k in keep)
    return docs.select(F.col("doc_id").cast("long"), "text", *(k for k in keep if k != "text")).mapInArrow(lean(run), f"doc_id long, {kept}score double, passages array<struct<start:bigint,end:bigint,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, *, least: float = 0.7, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """score(), with held_out and predicted (1 from `least` on). A null doc_id is not held out."""
    scored = score(docs, fit(docs, labels, **options), keep=keep)
    held = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", *keep, held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "passages")
