"""Chat formatting with turn spans found by incremental black-box rendering.

A template is any function from turns to a string. Prefixes of the turns are rendered one after
another; if an output starts with the one before, the rest is the new turn's span, and if not, the
template rewrites history, which is reported. Where a turn's text lies in its span is found by
rendering the turn with marker texts. Long conversations are rendered in stretches of turns,
each behind the last turn of the stretch before it, if the template declares `last_turn_only`; all
others get every prefix of the whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, tune_batches

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
#: Values of `turn` that make one stretch.
STRETCH = 64

#: Escapes inside texts: no mark of the template can occur in them. Fixed values.
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {v: k for k, v in _ESCAPES.items()}
_ESCAPE, _UNESCAPE = re.compile(r"[\\<\[]"), re.compile(r"\\[\\lb]")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[0]], text)


#: Opening and closing marks of roles; any other role is named in its opening. Fixed values.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
BEGIN = "<s>"


def instruct(turns: Sequence[Turn]) -> str:
    """The default template: a beginning mark, then every turn between its role's marks."""
    out = [BEGIN]
    for role, text in turns:
        opening, closing = MARKS.get(role) or (f"[ROLE] {escape(role)} [/ROLE] ", " [/TURN]")
        out += [opening, escape(text), closing]
    return "".join(out)


#: Declares that a turn's rendering depends on no more than the turn before; only such templates are rendered in stretches.
instruct.last_turn_only = True


def parse(formatted: str) -> list[Turn]:
    """The turns of what instruct() gave, or of a stretch of it."""
    at, out = len(BEGIN) if formatted.startswith(BEGIN) else 0, []
    while at < len(formatted):
        if formatted.startswith("[ROLE] ", at):
            close = formatted.index(" [/ROLE] ", at)
            role, closing, start = unescape(formatted[at + 7 : close]), " [/TURN]", close + 9
        else:
            role = next(r for r, (o, _) in MARKS.items() if formatted.startswith(o, at))
            start, closing = at + len(MARKS[role][0]), MARKS[role][1]
        end = formatted.index(closing, start)
        out.append((role, unescape(formatted[start:end])))
        at = end + len(closing)
    return out


_A, _B = "\ue000\ue001\ue000", "\ue001\ue000\ue001"
Span = tuple[int, int, int, int]


def content_margins(template: Template, role: str) -> tuple[int, int, int] | None:
    """Characters before a turn's text as the first turn and as a later one, and behind it; None if the template doesn't show it once, unchanged."""
    a, b, tail = (template(t) for t in ([(role, _A)], [(role, _B)], [(role, _A), (role, _A)]))
    tail = tail[len(a) :]
    if a.count(_A) != 1 or a.replace(_A, _B) != b or tail.count(_A) != 1:
        return None
    return a.index(_A), tail.index(_A), len(a) - a.index(_A) - len(_A)


def located(turns: Sequence[Turn], i: int, template: Template, whole: str) -> tuple[int, int] | None:
    """Where turn i's text lies in the rendering of all turns: what differs once a marker stands for it. None if that isn't one place."""
    marked = template([*turns[:i], (turns[i][0], _A), *turns[i + 1 :]])
    at = marked.find(_A)
    behind = len(marked) - at - len(_A)
    if marked.count(_A) != 1 or at + behind > len(whole) or whole[:at] != marked[:at] or whole[len(whole) - behind :] != marked[at + len(_A) :]:
        return None
    return at, len(whole) - behind


def render(turns: Sequence[Turn], template: Template, context: Sequence[Turn] = ()) -> tuple[str, list[Span | None], bool]:
    """(output, for each turn its span and its text's place in the output, whether history was rewritten).

    Successive prefixes are rendered behind the context; what the context renders to is left out, and a
    turn's span is what its prefix adds. Where a rendering doesn't go on from the one before, history was
    rewritten: then all of it is given, context included, and every turn's text is looked for in the last
    output by a marker, its span being its text. Turns whose text isn't shown once, unchanged, have no span.
    """
    base = shown = template(context) if context else ""
    spans: list[Span | None] = []
    margins: dict[str, tuple[int, int, int] | None] = {}
    for i, (role, _) in enumerate(turns):
        longer = template([*context, *turns[: i + 1]])
        if not longer.startswith(shown):
            return _rewritten(turns, template, context)
        if role not in margins:
            margins[role] = content_margins(template, role)
        start = len(shown) - len(base)
        if margins[role] is None:
            place = located([*context, *turns[: i + 1]], len(context) + i, template, longer)
            spans.append(place and (start, len(longer) - len(base), place[0] - len(base), place[1] - len(base)))
        else:
            first, later, behind = margins[role]
            spans.append((start, len(longer) - len(base), start + (later if shown else first), len(longer) - behind - len(base)))
        shown = longer
    return shown[len(base) :], spans, False


def _rewritten(turns: Sequence[Turn], template: Template, context: Sequence[Turn]) -> tuple[str, list[Span | None], bool]:
    every = [*context, *turns]
    whole = template(every)
    places = [located(every, len(context) + i, template, whole) for i in range(len(turns))]
    return whole, [p and (*p, *p) for p in places], True


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def format_chats(rows: DataFrame, *, template: Template = instruct, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, stretch, text, mask, rewrote.

    One row per stretch of turns, in order to be joined without anything between, or one per
    conversation if the template doesn't declare `last_turn_only`, which takes time by the square of its
    turns and holds it in one task. A template that declares it wrongly isn't found out. mask holds the
    assistant texts' places in the row's text, and rewrote tells whether the template changed
    earlier output. Other columns are ignored. Null texts and roles count as empty; a null conv_id is
    a conversation, a null turn comes first, and rows of equal turn are ordered by role and text.
    """
    tune_batches(rows.sparkSession)
    own = rows.select("conv_id", F.coalesce("turn", F.lit(-(1 << 40))).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("stretch", F.floor(F.col("turn") / stretch) if getattr(template, "last_turn_only", False) else F.lit(0).cast("long"))
    row = F.struct("turn", "role", "text")
    held = materialize(own.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list(row)).alias("turns")), "turns")
    order = W.partitionBy("conv_id").orderBy("stretch")
    last = F.element_at("turns", -1)
    before = held.select("conv_id", "stretch", F.struct(last["role"].alias("role"), last["text"].alias("text")).alias("end"))
    before = before.select(F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch"), F.lag("end").over(order).alias("context"))
    joined = held.join(before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("stretch") == F.col("_stretch"))).select("conv_id", "stretch", "turns", "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, masks, changed = [], [], []
            for turns, context in zip(b.column("turns").to_pylist(), b.column("context").to_pylist()):
                pairs = [(t["role"], t["text"]) for t in turns]
                text, spans, rewrote = render(pairs, template, [(context["role"], context["text"])] if context else [])
                texts.append(text)
                masks.append([{"from": x[2], "to": x[3]} for (role, _), x in zip(pairs, spans) if role == "assistant" and x])
                changed.append(rewrote)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("stretch"), pa.array(texts, pa.string()), pa.array(masks, _SPANS), pa.array(changed, pa.bool_())], names=["conv_id", "stretch", "text", "mask", "rewrote"])

    return joined.mapInArrow(run, "conv_id long, stretch long, text string, mask array<struct<from:bigint,to:bigint>>, rewrote boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation: its turns, digests of them and of the text under the mask, and its length.

    Each task passes over its conversations' stretches in order and holds one stretch at a time.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrote", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list | None = None

        def done(a: list) -> tuple:
            return a[0], a[1], a[2].hexdigest(), a[3], a[4].hexdigest(), a[5], a[6]

        for b in batches:
            out = []
            for conv, text, mask, rewrote in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "mask", "rewrote"))):
                if at is None or at[0] != conv:
                    if at is not None:
                        out.append(done(at))
                    at = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, said in parse(text):
                    at[1] += 1
                    at[2].update(f"{role}\n{said}\n".encode())
                for m in mask:
                    said = unescape(text[m["from"] : m["to"]])
                    at[3] += len(said)
                    at[4].update(said.encode())
                at[5] += len(text)
                at[6] |= rewrote
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(at), schema)], schema=schema)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrote boolean")
