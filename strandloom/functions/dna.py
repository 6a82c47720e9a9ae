"""Expressions on nucleotide strings: complements, motifs, contexts, orientation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and the bases they stand for. Fixed values.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "M": "AC", "S": "CG", "Y": "CT", "K": "GT", "W": "AT",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: Context tokens. Fixed values.
CPG, CHG, CHH, M6A = "[CpG]", "[CHG]", "[CHH]", "[m6A]"


def cpg_skips(seq: Column) -> Column:
    """C's between successive CpG sites, the first from the start: the letters that count, cut at the sites."""
    marked = F.regexp_replace(F.replace(seq, F.lit("CG"), F.lit("X")), "[^CX]", "")
    parts = F.split(marked, "X")
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.length)


def cpg_positions(seq: Column) -> Column:
    """Positions of CpG sites, in one pass over the letters."""

    def hits(x: Column) -> Column:
        return F.filter(F.transform(x, lambda c, i: F.when((c == "C") & (F.get(x, i + 1) == "G"), i)), lambda i: i.isNotNull())

    return let(F.split(seq, ""), hits)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body's inner functions use it."""
    return F.transform(F.array(value), body)[0]


def revcomp(seq: Column) -> Column:
    """Reverse complement of a DNA string; any other letter gives N."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGT]", "N")), "ACGT", "TGCA")


def revcomp_iupac(seq: Column, kind: str = "DNA") -> Column:
    """IUPAC reverse complement; codes that stand for their own complement stay, unknown letters give N."""
    pairs = {"A": "T", "T": "A", "C": "G", "G": "C", "M": "K", "K": "M", "R": "Y", "Y": "R", "B": "V", "V": "B", "D": "H", "H": "D"}
    if kind == "RNA":
        pairs = {k: {"T": "U"}.get(v, v) for k, v in pairs.items() if k != "T"} | {"U": "A"}
    elif kind != "DNA":
        raise ValueError("kind must be DNA or RNA")
    known = "".join(pairs) + "WSZN"
    return F.translate(F.reverse(F.regexp_replace(seq, f"[^{known}]", "N")), "".join(pairs), "".join(pairs.values()))


def revcomp_or_empty(seq: Column) -> Column:
    """IUPAC reverse complement, or an empty string if a letter is unknown."""
    return F.when(seq.rlike("^[ACGTMKRYBVDHWSZN]*$"), revcomp_iupac(seq)).otherwise(F.lit(""))


def expand_motif(motif: str) -> list[str]:
    """All concrete sequences of an IUPAC motif, in the order of their letters."""
    unknown = set(motif.upper()) - set(IUPAC)
    if unknown:
        raise ValueError(f"not IUPAC: {sorted(unknown)}")
    return reduce(lambda made, code: [m + b for m in made for b in IUPAC[code]], motif.upper(), [""])


def window(seq: Column, pos: Column, strand: Column, before: int, length: int) -> Column:
    """The strand's bases around a forward position, `before` of them ahead of it; '' if they leave the contig's start."""
    plus, minus = pos - before, pos - (length - before) + 1
    cut = lambda start: F.when(start >= 0, F.substring(seq, (start + 1).cast("int"), F.lit(length))).otherwise(F.lit(""))
    return F.when(strand == "-", revcomp(cut(minus))).otherwise(cut(plus))


def cytosine_motif(context: Column) -> Column:
    """CG, CHG or CHH of a concrete three-base context (or its literal pattern), else null."""
    h = "[ACT]"
    return (
        F.when(context.rlike("^CG[ACGTN]$"), "CG")
        .when(context.rlike(f"^C{h}G$") | (context == "CHG"), "CHG")
        .when(context.rlike(f"^C{h}{h}$") | (context == "CHH"), "CHH")
    )


def context_of(x: Column, y: Column, z: Column, *, end: str = "", cpg: bool = True, chg: bool = True, chh: bool = True, m6a: bool = True) -> Column:
    """Context token of a base and the two behind it (`end` past the end), or null: at a read's end a C has none unless G follows."""
    none = F.lit(None).cast("string")
    c = x == "C"
    told = F.when(c & (y == "G"), F.lit(CPG) if cpg else none).when(c & (z == "G"), F.lit(CHG) if chg else none)
    return told.when(c & (z != end), F.lit(CHH) if chh else none).when(x == "A", F.lit(M6A) if m6a else none)


def context_at(seq: Column, i: Column, **flags: bool) -> Column:
    """context_of() the base at 0-based i."""
    return context_of(*[F.substring(seq, (i + 1 + k).cast("int"), F.lit(1)) for k in range(3)], **flags)


def contexts(seq: Column, **flags: bool) -> Column:
    """(pos, base, methy_type) of every base, in one pass: each is seen with the two behind it."""
    at = lambda k: F.split(F.substring(F.concat(seq, F.lit("  ")), k, 1 << 30), "")
    triples = F.arrays_zip(at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))

    def told(t: Column, i: Column) -> Column:
        y, z = (F.coalesce(t[k], F.lit(" ")) for k in "yz")
        return F.struct(i.alias("pos"), t["x"].alias("base"), context_of(t["x"], y, z, end=" ", **flags).alias("methy_type"))

    return F.filter(F.transform(triples, told), lambda t: t["base"] != " ")


def sites(seq: Column, **flags: bool) -> Column:
    """(pos, base, methy_type) of the bases that have a context."""
    return F.filter(contexts(seq, **flags), lambda t: t["methy_type"].isNotNull())


def positions(seq: Column, base: str) -> Column:
    """0-based positions of a base, in either case, as an array; one pass over the letters."""
    if len(base) != 1:
        raise ValueError("base must be one letter")
    hits = F.transform(F.split(F.upper(seq), ""), lambda x, i: F.when(x == base.upper(), i))
    return F.filter(hits, lambda i: i.isNotNull())


def forward(seq: Column, is_reverse: Column) -> Column:
    """A stored sequence as it was read."""
    return F.when(is_reverse, revcomp(seq)).otherwise(seq)


def forward_position(q: Column, length: Column, is_reverse: Column) -> Column:
    return F.when(is_reverse, length - 1 - q).otherwise(q)
