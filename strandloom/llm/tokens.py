"""Token ids of whole texts by a public tokenizer file, with the ids of recurring words held by each worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .common import trim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words whose ids a worker holds, at most; then it lets go of the older half.
HELD = 300_000
END = 1
# Letters of the common Latin blocks, both cases, without the ordinal signs and the micro sign.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
# A cut stands before white space and after a run of letters: no word of either pre-tokenizer spans one.
_UNIT = re.compile(rf"[ \n\t\r]*[^ \n\t\r{_L}]*[{_L}]+|[ \n\t\r]*[^ \n\t\r{_L}]+|[ \n\t\r]+")
# Anything else than these letters, ASCII and plain marks: it may be white space, a letter or a mark that
# joins, so such a text is not cut; nor is one that may hold a special token's string.
_ODD = re.compile(rf"[^\t\n\r\x20-\x7e\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6\u00b7\u00bb\u00bf\u00d7\u00f7{_L}\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac]|<\|")


# Words of a text of such characters, as the two pre-tokenizers part them.
_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+")
_LOW = _L.replace("A-Z", "")  # this one is for texts in lower case
_BARE = re.compile(rf"[{_LOW}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_LOW}]+")
_WORD_END = b"\xff"  # no byte of UTF-8


def _bytes_of() -> dict[str, int]:
    """Byte-level letters of the files: printable bytes stand for themselves, others for letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Ranks by which merging any two neighbours whose joint is a token does what the file's merges do; None if it might not.

    So it is if ids follow the order of merges and every token, taken apart, is last joined from the
    two parts of its own merge: then no others of its parts can ever stand side by side.
    """
    suffix = model.get("end_of_word_suffix") or ""
    if suffix not in ("", "</w>") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        return None
    letters = _bytes_of()

    def raw(token: str) -> bytes:
        ended = suffix and token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if ended else token)) + (_WORD_END if ended else b"")

    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocabulary = model["vocab"]
    ids = [vocabulary[a + b] for a, b in merges]
    joined = {a + b for a, b in merges}
    base = [t for t in vocabulary if t not in joined and all(c in letters for c in t.removesuffix(suffix))]
    if any(x >= y for x, y in zip(ids, ids[1:])) or max(vocabulary[t] for t in base if len(t.removesuffix(suffix)) == 1) >= ids[0]:
        return None
    ranks = {raw(t): vocabulary[t] for t in [*base, *joined] if raw(t) != _WORD_END or not suffix}
    if suffix:
        ranks[_WORD_END] = 1 << 30
    for (a, b), rank in zip(merges, ids):
        parts = [bytes([x]) for x in raw(a + b)]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if parts != [raw(a), raw(b)]:
            return None
    return ranks


class Encoder:
    """Ids by the tokenizers library, without special tokens added, as little-endian unsigned integers of `size` bytes.

    A text of common characters is encoded word by word, each distinct word once; any other is
    encoded as a whole. New words are merged by tiktoken where its rule provably does the same. size
    is 4, or 2 if narrow ones are asked for and all ids fit.
    """

    def __init__(self, path: str, narrow: bool = False) -> None:
        self.path, self.tokenizer = path, None
        self.held: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        most = max([*model["vocab"].values(), *(t["id"] for t in whole.get("added_tokens") or [])])
        self.size = 2 if narrow and most < 1 << 16 else 4
        self._code = "H" if self.size == 2 else "I"
        self.ended = bool(model.get("end_of_word_suffix"))
        ranks = _ranks(model)
        self.merge = None if ranks is None else tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        del whole, model, ranks
        trim()

    def _whole(self, texts: list[str]) -> list[bytes]:
        if self.tokenizer is None:  # it is large, and few texts need it
            self.tokenizer = Tokenizer.from_file(self.path)
        return [np.array(e.ids, f"<u{self.size}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, text: str) -> list[str]:
        """Parts of a text that are encoded apart: where words end with a mark and spaces don't count, the words themselves."""
        return _BARE.findall(text.lower()) if self.ended and self.merge is not None else _UNIT.findall(text)

    def _learn(self, words: set[str]) -> None:
        if len(self.held) + len(words) > HELD:
            self.held = dict(islice(self.held.items(), len(self.held) // 2, None))
        if self.merge is not None:
            for u in words:
                ids = self.merge(u.encode() + _WORD_END) if self.ended else [i for w in _SPACED.findall(u) for i in self.merge(w.encode())]
                self.held[u] = array(self._code, ids).tobytes()
            return
        new = list(words)
        for i in range(0, len(new), 4096):
            self.held.update(zip(new[i : i + 4096], self._whole(new[i : i + 4096])))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        for t in texts:
            if not t:
                yield b""
            elif _ODD.search(t):
                yield self._whole([t])[0]
            else:
                units = self._units(t)
                ids = list(map(self.held.get, units))
                if None in ids:
                    self._learn({u for u, x in zip(units, ids) if x is None})
                    ids = [x if x is not None else self.held[u] for u, x in zip(units, ids)]
                yield b"".join(ids)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, *, narrow: bool = False) -> Encoder:
    """One for each file and worker process."""
    if (path, narrow) not in _ENCODERS:
        _ENCODERS[path, narrow] = Encoder(path, narrow)
    return _ENCODERS[path, narrow]
