"""Secret scans: fixed credential patterns, and formats that automata learn from the credentials found.

The fixed patterns label credentials. A bounded sample of these of each kind, and of ordinary
tokens, trains one probabilistic automaton each; every other token of eight characters or more of every
text is then scored by how much likelier it is as a credential than as an ordinary token.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, log_likelihoods
from .common import batch, lean, materialize, rows_of, tune_batches

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates: as short as the shortest labelled credential may be.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Labelled credentials of each kind, and ordinary tokens, that the automata are fitted on, at most: samples
#: by hash over the whole corpus.
FIT, FIT_TOKENS = 300, 1000
#: Natural-log likelihood ratio over the tokens' automaton at which a token counts as a secret, in all and a character.
LEAST, LEAST_EACH = 12.0, 0.45


def base_spans(text: str) -> list[tuple[int, str, int, int, str]]:
    """(start, kind, end, and so on) of the fixed patterns: start, kind's place, end, value's start, value."""
    out = [(m.start(), 0, m.end(), m.start(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m.start(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m.start(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _tokens(text: str, spans: list) -> list[tuple[int, int, str]]:
    """Candidates: tokens, or what base spans leave of them if that is as long as one."""
    out, i, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while i < len(spans) and spans[i][0] < end:
            s, e = spans[i][0], spans[i][2]
            if s - max(at, reach) >= 8:
                out.append((max(at, reach), s, text[max(at, reach) : s]))
            reach = max(reach, e)
            i += 1
        at = max(at, reach)
        if end - at >= 8:
            out.append((at, end, text[at:end]))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def fit(docs: DataFrame) -> tuple[list[Automaton], Automaton]:
    """Automata of the credential kinds that occur (at most FIT distinct strings each), and of ordinary tokens (FIT_TOKENS).

    The whole corpus is looked at; of each document one candidate by chance stands for ordinary tokens.
    """
    tune_batches(docs.sparkSession)
    schema = pa.schema([("kind", pa.int32()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for t in b.column("text").to_pylist():
                base = base_spans(t or "")
                found |= {(k, v) for _, k, _, _, v in base}
                if tokens := _tokens(t or "", base):
                    found.add((-1, tokens[zlib.crc32(t.encode("utf-8", "replace")) % len(tokens)][2]))
            if found:
                yield batch(schema, *map(list, zip(*found)))

    rows = materialize(docs.select("text").mapInArrow(lean(run), "kind int, value string").distinct(), "labelled")
    # one bounded sample a kind, each taken where the rows are
    kept = [r for k, n in ((-1, FIT_TOKENS), (0, FIT), (1, FIT), (2, FIT)) for r in rows.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(n).collect()]
    by: dict[int, list[str]] = {}
    for r in kept:
        by.setdefault(r.kind, []).append(r.value)
    return [Automaton().learn(by[k]) for k in sorted(by) if k >= 0], Automaton().learn(by.get(-1, []))


def ratios(tokens: list[str], credentials: list[tuple], words: tuple) -> np.ndarray:
    """How much likelier, as logarithm, each token is as a credential of its best kind than as an ordinary token; by the automata's tables."""
    return np.max([log_likelihoods(a, tokens) for a in credentials], axis=0) - log_likelihoods(words, tokens)


def _finder(docs: DataFrame, least: float, least_each: float):
    """Function from texts to their spans (start, kind, end), sorted; learns from docs."""
    credentials, words = fit(docs)
    credentials, words = [a.tables() for a in credentials], words.tables()

    def find(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        base = [base_spans(t or "") for t in texts]
        found = [_tokens(t or "", x) if credentials else [] for t, x in zip(texts, base)]
        distinct = list({x: None for tokens in found for *_, x in tokens})
        odds = ratios(distinct, credentials, words) if distinct else ()
        secret = {t for t, r in zip(distinct, odds) if r >= max(least, least_each * len(t))}
        return [sorted([*((s, k, e) for s, k, e, _, _ in x), *((s, 3, e) for s, e, t in tokens if t in secret)]) for x, tokens in zip(base, found)]

    return find


def secrets(docs: DataFrame, *, least: float = LEAST, least_each: float = LEAST_EACH) -> DataFrame:
    """doc_id and spans: array of (start, kind's place in KINDS, end), by start and kind.

    Offsets are code points, ends exclusive. docs needs doc_id and text; others are ignored. A null text
    counts as empty, and an empty one has no spans. The first three kinds are the whole matches of the
    fixed patterns; learned ones are other tokens, or parts of tokens that these leave. Without any
    credential in the corpus nothing is learned. Texts are looked at twice and written nowhere.
    """
    find = _finder(docs, least, least_each)
    tune_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in find(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, _SPAN)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, spans array<struct<start:bigint,kind:int,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the fixed kinds, and all spans as text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, spans in rows_of(batches, "doc_id", "spans"):
            told = [[f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in x] for x in spans]
            base = [",".join(t for t in x if not t.startswith("learned")) for x in told]
            counts = [[sum(s["kind"] == k for s in x) for x in spans] for k in range(3)]
            yield batch(schema, ids, *counts, [hashlib.sha256(x.encode()).hexdigest() for x in base], [",".join(x) for x in told])

    return found.select("doc_id", "spans").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "[SECRET]", *, least: float = LEAST, least_each: float = LEAST_EACH) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with every span of every text replaced by mark; n_chars follows."""
    find = _finder(docs, least, least_each)
    tune_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = b.column("text").to_pylist(), b.column("n_chars").to_pylist()
            for i, spans in enumerate(find(texts)):
                if spans:
                    t, out, at = texts[i], [], 0
                    for s, _, e in spans:
                        if s >= at:
                            out += [t[at:s], mark]
                        at = max(at, e)
                    texts[i] = "".join([*out, t[at:]])
                    sizes[i] = len(texts[i])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("lang"), b.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])

    return own.mapInArrow(lean(run), "doc_id long, text string, lang string, source string, n_chars long")
