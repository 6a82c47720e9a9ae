"""Expressions on modification tags, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modification types: base, tag key, tag prefix. Fixed values.
MODS = {t: ("A", "a", "A+a,") for t in ("m6A", "a", "A+a")} | {t: ("C", "m", "C+m,") for t in ("m", "CpG", "CHG", "CHH", "C+m")}
#: Token ids. Fixed values.
PLUS, MINUS, MASK = 10, 11, 12
IGNORED = -100


def mod_config(kind: str) -> tuple[str, str, str]:
    if kind not in MODS:
        raise ValueError(f"unknown modification type {kind!r}")
    return MODS[kind]


def _ints(cells: Column) -> Column:
    return F.transform(cells, lambda x: x.cast("int"))


def skips(ranks: Column) -> Column:
    """Skip counts between ascending ranks, the first from the start."""
    before = F.concat(F.array(F.lit(-1)), F.slice(ranks, 1, F.greatest(F.size(ranks) - 1, F.lit(0))))
    gaps = F.zip_with(ranks, before, lambda a, b: a - b - 1)
    return F.when(F.size(ranks) == 0, F.array().cast("array<int>")).otherwise(_ints(gaps))


def ranks(skip_counts: Column) -> Column:
    """Ranks of skip counts: the places of marks that stand behind as many unmarked bases; linear in the bases passed."""
    marks = F.flatten(F.transform(skip_counts, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))
    return F.filter(F.transform(marks, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def mm(ranks: Column, prefix: str = "C+m,") -> Column:
    """MM value of ascending base ranks."""
    return F.concat(F.lit(prefix), F.array_join(skips(ranks), ","), F.lit(";"))


def ml(scores: Column) -> Column:
    """ML values of scores in 0..100, rounded half to even."""
    return F.transform(scores, lambda s: F.rint(s * 255 / 100).cast("int"))


def ml_of_probabilities(probs: Column) -> Column:
    """The other quantization: floor(256 p), at most 255."""
    return F.transform(probs, lambda p: F.when(p < 1, F.floor(p * 256)).otherwise(255).cast("int"))


def encode(ranks: Column, scores: Column, prefix: str = "C+m,") -> Column:
    """struct(mm, ml); arrays of unequal length raise."""
    told = F.when(F.size(ranks) == F.size(scores), mm(ranks, prefix)).otherwise(F.raise_error(F.lit("positions and scores differ in number")))
    return F.struct(told.alias("mm"), ml(scores).alias("ml"))


def ranks_of(mm_value: Column, prefix: str = "C+m,") -> Column:
    """Base ranks that one modification's part of an MM value marks."""
    key = prefix.rstrip(",")
    part = F.element_at(F.filter(F.split(mm_value, ";"), lambda p: p.startswith(key)), 1)
    cells = F.filter(F.split(F.regexp_replace(part, r"^[^,]*,?", ""), ","), lambda c: c != "")
    return F.coalesce(ranks(F.transform(cells, lambda c: c.cast("int"))), F.array().cast("array<int>"))


def bisulfite_label(score: Column) -> Column:
    """0..100 of an ML value, half to even; -1 if there is none."""
    return F.coalesce(F.rint(score / 255 * 100).cast("int"), F.lit(-1))


def training_label(score: Column, confidence: float = 0.9) -> Column:
    """100 from confidence on, 0 at zero, else null."""
    return F.when(score >= int(confidence * 255), 100).when(score == 0, 0)


def nucleosome_edges(starts: Column, lengths: Column) -> Column:
    """Positions just outside of nucleosomes."""
    return F.array_union(F.transform(starts, lambda x: x - 1), F.zip_with(starts, lengths, lambda a, b: a + b))


def nucleosome_label(pos: Column, edges: Column, score: Column) -> Column:
    return F.when(F.array_contains(edges, pos), 100).when(F.coalesce(score, F.lit(0)) == 0, 0)


def loss_weight(label: Column) -> Column:
    return 10 * F.pow((label - 50) / 50, 2)


def label_token(label: Column, low: int = 0, high: int = 100) -> Column:
    """Token of a 0..100 label; between the thresholds, and at -1, the mask."""
    return F.when(label == -1, MASK).when(label <= low, MINUS).when(label >= high, PLUS).otherwise(MASK)


def label_weight(label: Column, low: int = 0, high: int = 100) -> Column:
    return F.when(label_token(label, low, high) == MASK, F.lit(0.0)).otherwise(loss_weight(label))


def softmax_probability(minus: Column, plus: Column) -> Column:
    """Probability of the second of two logits."""
    return 1 / (1 + F.exp(minus - plus))


def hard_call(p: Column) -> Column:
    """As files of calls tell it: over one half."""
    return (p > 0.5).cast("int")


def is_methylated(p: Column, threshold: float = 0.5) -> Column:
    """As frequencies count it: from the threshold on."""
    return p >= threshold


def ints(cell: Column) -> Column:
    """Integers of a comma-separated cell that may end in a comma."""
    return F.transform(F.filter(F.split(cell, ","), lambda x: x != ""), lambda x: x.cast("int"))


def dense(marked: Column) -> Column:
    """0/1 of every position up to the last marked."""
    return F.when(F.size(marked) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.array_max(marked)), lambda i: F.array_contains(marked, i).cast("int")))
