"""Expressions on raw signals, move tables and model tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import let

#: The model's vocabulary in order of its ids. Fixed values.
VOCABULARY = ("[PAD]", "[START]", "[END]", "A", "G", "T", "C", "[CpG]", "[CHG]", "[CHH]", "+", "-", "[MASK]", "[m6A]", "[R10]", "[4khz]", "[5khz]")


def token_map() -> Column:
    return F.create_map(*[x for i, t in enumerate(VOCABULARY) for x in (F.lit(t), F.lit(i))])


def token_ids(tokens: Column) -> Column:
    table = token_map()
    return F.transform(tokens, lambda t: table[t])


def token_text(ids: Column) -> Column:
    """Tokens of ids set end to end; ignored places (-100) are left out."""
    table = F.array(*map(F.lit, VOCABULARY))
    return F.array_join(F.transform(F.filter(ids, lambda i: i != -100), lambda i: F.element_at(table, i + 1)), "")


def move_start(ts: Column, sp: Column) -> Column:
    return ts + F.coalesce(sp, F.lit(0))


def move_bounds(mv: Column, start: Column, signal_length: Column) -> Column:
    """Sample bounds of the bases of a move table (its first entry is the stride), the last at the signal's end."""
    moves = F.slice(mv, 2, F.greatest(F.size(mv) - 1, F.lit(0)))
    at = F.filter(F.transform(moves, lambda m, i: F.when(m == 1, i * mv[0] + start)), lambda x: x.isNotNull())
    return F.concat(at, F.array(signal_length.cast("int")))


def segments(bounds: Column) -> Column:
    """(start, len) between successive bounds."""
    n = F.greatest(F.size(bounds) - 1, F.lit(0))
    return F.zip_with(F.slice(bounds, 1, n), F.slice(bounds, 2, n), lambda a, b: F.struct(a.alias("start"), (b - a).alias("len")))


def normalization(sm: Column, sd: Column, offset: Column, scale: Column, *, frequency: str = "4khz", dorado_version: float = 0.71) -> Column:
    """struct(shift, scale) of the three basecaller conventions."""
    if frequency == "5khz" and dorado_version <= 0.71:
        shift, by = 1 - sm, 1 / sd
    elif frequency == "5khz":
        shift, by = sm, sd
    else:
        shift, by = sm / scale - offset, sd / scale
    return F.struct(shift.alias("shift"), by.alias("scale"))


def normalized(signal: Column, norm: Column) -> Column:
    return F.transform(signal, lambda x: (x - norm["shift"]) / norm["scale"])


def calibration_scale(range_: Column, digitisation: Column) -> Column:
    """range / digitisation; 1 where digitisation is zero or missing."""
    return F.coalesce(F.when(digitisation != 0, range_ / digitisation), F.lit(1.0))


def signal_index(lengths: Column, stride: int = 1) -> Column:
    """Of every stride-th sample, the event it belongs to."""
    each = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))
    return F.filter(F.transform(each, lambda x, i: F.when(i % stride == 0, x)), lambda x: x.isNotNull())


def with_context_tokens(bases: Column, sites: Column) -> Column:
    """Bases with each site's context token behind it. sites: array of (pos, token), positions ascending.

    The bases are cut behind every site, so each is copied once.
    """

    def build(z: Column) -> Column:
        last = F.concat(F.array(F.lit(-1)), F.transform(z["sites"], lambda s: s["pos"]))
        parts = F.zip_with(z["sites"], F.slice(last, 1, F.size(z["sites"])), lambda s, b: F.concat(F.slice(z["bases"], b + 2, s["pos"] - b), F.array(s["token"])))
        end = F.element_at(last, -1)
        return F.flatten(F.concat(parts, F.array(F.slice(z["bases"], end + 2, F.size(z["bases"])))))

    return let(F.struct(bases.alias("bases"), sites.alias("sites")), build)


def token_position(pos: Column, sites: Column) -> Column:
    """Where the context token of a site at pos stands once all tokens are in."""
    return pos + 1 + F.size(F.filter(sites, lambda s: s["pos"] < pos))
