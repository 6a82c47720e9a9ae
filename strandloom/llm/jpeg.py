"""Progressive JPEG in numpy: many files are coded and decoded side by side.

Scans are accumulated into coefficient arrays, spectral band by band and bit by bit. Restart
intervals make a scan's stretches independent, so one vector step reads the next symbol of every
stretch of every file. Blocks are then inverse-transformed, chroma is upsampled, and tiles become
full-resolution RGB tensors.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

#: Places of a block's coefficients in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, (i // 8 if s % 2 else i % 8))))
#: Blocks (alone in a scan) or units (interleaved) of a restart interval.
RESTART = 8
#: Components: sampling factors; a unit holds four blocks of the first and one of each other.
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Scans: components, spectral band, bits left out before and after.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), *(((c,), a, b, 0, 1) for c in range(3) for a, b in ((1, 5), (6, 63))), *(((c,), 1, 63, 1, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0))


class Table(NamedTuple):
    counts: bytes  # codes of each length
    symbols: bytes
    code: np.ndarray  # by symbol
    size: np.ndarray
    look: np.ndarray  # by the next 16 bits: size << 8 | symbol


def huffman(counts: bytes, symbols: bytes) -> Table:
    code, size, look = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(1 << 16, np.int64)
    value, at = 0, 0
    for n, k in enumerate(counts, 1):
        for s in symbols[at : at + k]:
            code[s], size[s] = value, n
            look[value << (16 - n) : (value + 1) << (16 - n)] = n << 8 | s
            value += 1
        at += k
        value <<= 1
    return Table(counts, symbols, code, size, look)


#: DC categories have codes of 4 bits; the AC symbols that text gives have short codes, all others codes of 10 bits.
_SHORT = {0x01: 2, 0x02: 2, 0x03: 3, 0x04: 4, 0x05: 5, 0x00: 6}
_REST = sorted({r << 4 | s for r in range(16) for s in range(11)} - set(_SHORT))
DC = huffman(bytes(12 if n == 4 else 0 for n in range(1, 17)), bytes(range(12)))
AC = huffman(bytes(sum(x == n for x in _SHORT.values()) + (len(_REST) if n == 10 else 0) for n in range(1, 17)), bytes([*_SHORT, *_REST]))
#: The table of files without small coefficients, which need no runs.
_DENSE = {0x01: 1, 0x02: 2, 0x03: 3, 0x04: 5, 0x05: 5, 0x06: 5, 0x00: 6, 0x07: 7, 0x08: 8, 0xF0: 9}
DENSE = huffman(bytes(sum(x == n for x in _DENSE.values()) for n in range(1, 17)), bytes(_DENSE))
_SIZES = np.array([x.bit_length() for x in range(4096)])


def _size_of(x: np.ndarray) -> np.ndarray:
    """Bits of a magnitude."""
    return _SIZES[np.abs(x)]


class Grid:
    """Where the blocks of several images stand in one array, unit after unit."""

    def __init__(self, shapes: Sequence[tuple[int, int]]) -> None:
        """shapes: units down and across."""
        self.shapes = shapes
        self.units = np.array([h * w for h, w in shapes], np.int64)
        self.base = (np.cumsum(self.units) - self.units) * 6
        self.total = int(self.units.sum()) * 6

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Block places in a scan's order, and how many each image has."""
        if len(components) > 1:
            return np.arange(self.total), self.units * 6
        c, out = components[0], []
        if all(w == 1 for _, w in self.shapes):
            inner = np.array([3 + c]) if c else np.arange(4)
            return (np.arange(0, self.total, 6)[:, None] + inner).reshape(-1), self.units * len(inner)
        for (h, w), base in zip(self.shapes, self.base):
            if c:
                out.append(base + np.arange(h * w) * 6 + 3 + c)
            else:
                y, x = np.divmod(np.arange(4 * h * w), 2 * w)
                out.append(base + (y // 2 * w + x // 2) * 6 + y % 2 * 2 + x % 2)
        return np.concatenate(out) if out else np.zeros(0, np.int64), self.units * (1 if c else 4)


def _stretches(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each restart interval, with an end, and the image of each."""
    starts, owner, at = [], [], 0
    for i, n in enumerate(sizes.tolist()):
        own = range(at, at + n, step)
        starts += own
        owner += [i] * len(own)
        at += n
    return np.array([*starts, at], np.int64), np.array(owner, np.int64)


def _items(blocks: np.ndarray, scan: tuple, start: np.ndarray, ac: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, bits, block) of a first scan's codes in order. blocks: coefficients in the scan's order."""
    components, low, high, _, shift = scan
    if low == 0:
        v = blocks[:, 0] >> shift
        last = np.zeros(len(v), np.int64)
        q = np.arange(len(v)) % 6
        for own in ((q < 4), (q == 4), (q == 5)):
            last[own] = np.concatenate(([0], v[own][:-1]))
        head = np.isin(np.arange(len(v)) // 6, start[:-1] // 6)  # in the first unit of an interval prediction starts from zero
        last[head & ((q == 0) | (q > 3))] = 0
        d = v - last
        s = _size_of(d)
        extra = np.where(d < 0, d + (1 << s) - 1, d)
        return DC.code[s] << s | extra, DC.size[s] + s, np.arange(len(v))
    band = blocks[:, low : high + 1]
    v = np.sign(band) * (np.abs(band) >> shift)
    if v.all():
        x, s = v.reshape(-1), _size_of(v).reshape(-1)
        return ac.code[s] << s | np.where(x < 0, x + (1 << s) - 1, x), ac.size[s] + s, np.repeat(np.arange(len(v)), v.shape[1])
    b, k = np.nonzero(v)
    x = v[b, k]
    before = np.where(np.concatenate(([True], b[1:] != b[:-1])), -1, np.concatenate(([0], k[:-1]))) if len(b) else k
    run = k - before - 1
    s = _size_of(x)
    symbol = (run % 16) << 4 | s
    extra = np.where(x < 0, x + (1 << s) - 1, x)
    value, bits, key = ac.code[symbol] << s | extra, ac.size[symbol] + s, b * 128 + k * 2 + 1
    far = np.repeat(np.arange(len(b)), run // 16)
    ended = np.flatnonzero(v[:, -1] == 0)
    if len(far) or len(ended):
        value = np.concatenate((value, np.full(len(far), ac.code[0xF0]), np.full(len(ended), ac.code[0])))
        bits = np.concatenate((bits, np.full(len(far), ac.size[0xF0]), np.full(len(ended), ac.size[0])))
        key = np.concatenate((key, b[far] * 128 + k[far] * 2, ended * 128 + 127))
        by = np.argsort(key, kind="stable")
        value, bits, key = value[by], bits[by], key[by]
    return value, bits, key >> 7


def _refinement(blocks: np.ndarray, scan: tuple, ac: Table) -> tuple[np.ndarray, np.ndarray]:
    """(bits of a later scan one by one, their number in each block)."""
    _, low, high, _, shift = scan
    if low == 0:
        return (blocks[:, 0] >> shift & 1).astype(np.uint8), np.ones(len(blocks), np.int64)
    size = np.abs(blocks[:, low : high + 1]) >> shift
    known, new = size > 1, size == 1
    plain = ~new.any(1)
    n_code = int(ac.size[0])
    code = np.array([ac.code[0] >> (n_code - 1 - i) & 1 for i in range(n_code)], np.uint8)
    rows = np.concatenate((np.broadcast_to(code, (len(size), n_code)), (size & 1).astype(np.uint8)), 1)
    if known.all():
        return rows.reshape(-1), np.full(len(size), rows.shape[1])
    any_known = known.any(1) | (size == 0).any(1)
    mask = np.concatenate((np.broadcast_to(any_known[:, None], (len(size), n_code)), known), 1)
    if plain.all():
        return rows[mask], mask.sum(1)
    slow = {}
    for i in np.flatnonzero(~plain):  # new coefficients: runs of those still zero, each with the known ones' bits behind it
        out, held, run = [], [], 0

        def put(symbol: int, tail: list[int]) -> None:
            out.extend(int(ac.code[symbol]) >> (int(ac.size[symbol]) - 1 - j) & 1 for j in range(int(ac.size[symbol])))
            out.extend(tail)

        last = int(np.flatnonzero(new[i])[-1])
        for k, (v, c) in enumerate(zip(size[i].tolist(), blocks[i, low : high + 1].tolist())):
            if v > 1:
                held.append(v & 1)
            elif v == 1:
                put(run << 4 | 1, [int(c > 0), *held])
                held, run = [], 0
            else:
                run += 1
                if run == 16 and k < last:
                    put(0xF0, held)
                    held, run = [], 0
        if run or held:
            put(0, held)
        slow[int(i)] = out
    count = np.where(plain, mask.sum(1), 0)
    for i, out in slow.items():
        count[i] = len(out)
    flat, fast = np.empty(int(count.sum()), np.uint8), np.repeat(plain, count)
    flat[fast] = rows[plain][mask[plain]]
    flat[~fast] = np.array([x for i in sorted(slow) for x in slow[i]], np.uint8)
    return flat, count


def _entropy(blocks: np.ndarray, scan: tuple, sizes: np.ndarray, ac: Table) -> list[bytes]:
    """A scan's data of each image, with restart marks."""
    start, owner = _stretches(sizes, RESTART * (6 if len(scan[0]) > 1 else 1))
    if not scan[3]:
        value, bits, block = _items(blocks, scan, start, ac)
        per_block = np.bincount(block, bits, len(blocks)).astype(np.int64)
    else:
        flat, per_block = _refinement(blocks, scan, ac)
    total = np.concatenate(([0], np.cumsum(per_block)))
    length = total[start[1:]] - total[start[:-1]]  # bits of each interval
    width = -(-length // 8)
    first = np.cumsum(width) - width
    moved = first * 8 - total[start[:-1]]  # from a bit's place in the sequence to its place among whole bytes
    if not scan[3]:
        which = np.repeat(np.arange(len(length)), np.diff(start))
        at = np.cumsum(bits) - bits + moved[which[block]]
        data, n = np.zeros(int(width.sum()) + 5), int(width.sum()) + 5
        word = value << (40 - bits - (at & 7))
        for i in range((int(bits.max(initial=0)) + 14) // 8):
            data += np.bincount((at >> 3) + i, word >> (32 - 8 * i) & 255, n)
        data = data[: n - 5].astype(np.uint8)
        pad = width * 8 - length
        some = width > 0
        data[(first + width - 1)[some]] |= ((1 << pad[some]) - 1).astype(np.uint8)
    else:
        places = np.ones(int(width.sum()) * 8, np.uint8)
        places[np.arange(len(flat)) + np.repeat(moved, length)] = flat
        data = np.packbits(places)
    stuff = np.flatnonzero(data == 255) + 1
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    ends = (first + width)[inner]
    turn = inner - np.searchsorted(owner, owner[inner])
    where = np.concatenate((stuff, np.repeat(ends, 2)))
    what = np.concatenate((np.zeros(len(stuff), np.int64), np.stack((np.full(len(ends), 255), 0xD0 + turn % 8), 1).reshape(-1)))
    by = np.argsort(where, kind="stable")
    done = np.insert(data, where[by], what[by].astype(np.uint8)).tobytes()
    last = np.flatnonzero(np.concatenate((owner[1:] != owner[:-1], [True]))) if len(owner) else []
    cuts = (first + width)[last]
    cuts = cuts + np.searchsorted(where[by], cuts, "right")
    out, at = [b""] * len(sizes), 0
    for i, c in zip(owner[last].tolist() if len(owner) else [], cuts.tolist()):
        out[i] = done[at:c]
        at = c
    return out


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, mark, len(body) + 2) + body


def encode(blocks: np.ndarray, shapes: Sequence[tuple[int, int]], comments: Sequence[bytes]) -> list[bytes]:
    """Files of images of shapes (units down and across), from coefficients in zigzag order, unit after unit."""
    grid = Grid(shapes)
    blocks = blocks.astype(np.int64)
    ac = DENSE if (np.abs(blocks[:, 1:]) > 1).all() and np.abs(blocks).max(initial=0) < 256 else AC
    scans = [(scan, _entropy(blocks[(o := grid.order(scan[0]))[0]], scan, o[1], ac)) for scan in SCRIPT]
    tables = b"".join(_segment(0xC4, bytes([c]) + t.counts + t.symbols) for c, t in ((0, DC), (0x10, ac)))
    quant = _segment(0xDB, b"\0" + b"\1" * 64)
    parts = b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING))
    out = []
    for i, ((h, w), comment) in enumerate(zip(shapes, comments)):
        file = [b"\xff\xd8", _segment(0xFE, comment), quant, _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + parts), tables, _segment(0xDD, struct.pack(">H", RESTART))]
        for (components, low, high, before, after), data in scans:
            file += [_segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([low, high, before << 4 | after])), data[i]]
        out.append(b"".join([*file, b"\xff\xd9"]))
    return out


class Parsed(NamedTuple):
    shape: tuple[int, int]
    comment: bytes
    quant: np.ndarray
    scans: list[tuple[tuple, int, Table | None, list[tuple[int, int]]]]  # scan, restart interval, table, intervals


def parse(file: bytes) -> Parsed:
    """Marks and intervals of a progressive file of three components, chroma at half the size each way."""
    at, shape, comment, quant, restart = 2, (0, 0), b"", np.ones(64), 0
    tables: dict[int, Table] = {}
    scans = []
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while file[at + 1] != 0xD9:
        mark, n = file[at + 1], struct.unpack_from(">H", file, at + 2)[0]
        body = file[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xFE:
            comment = body
        elif mark == 0xDB:
            quant = np.frombuffer(body[1:65], np.uint8).astype(float)
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xC2:
            _, h, w, c = struct.unpack_from(">BHHB", body)
            if c != 3 or tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(3)) != SAMPLING:
                raise ValueError("another sampling than 4:2:0")
            shape = (-(-h // 16), -(-w // 16))
        elif mark == 0xC4:
            if (key := (body[0], body[1:])) not in _TABLES:
                _TABLES[key] = huffman(body[1:17], body[17:])
            tables[body[0]] = _TABLES[key]
        elif mark == 0xDA:
            k = body[0]
            components = tuple(body[1 + 2 * i] - 1 for i in range(k))
            low, high, both = body[1 + 2 * k : 4 + 2 * k]
            table = tables.get(body[2] & 15 | 16 if low else body[2] >> 4)
            intervals, start = [], at
            while True:
                end = file.index(b"\xff", at)
                if file[end + 1] == 0:
                    at = end + 2
                    continue
                intervals.append((start, end))
                if not 0xD0 <= file[end + 1] <= 0xD7:
                    at = end
                    break
                start = at = end + 2
            scans.append(((components, low, high, both >> 4, both & 15), restart, table, intervals))
        elif mark in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive file")
    return Parsed(shape, comment, quant, scans)


_TABLES: dict[tuple[int, bytes], Table] = {}


class _Bits:
    """All files' bytes without stuffing; reads at many places at once."""

    def __init__(self, files: Sequence[bytes]) -> None:
        raw = np.frombuffer(b"".join(files), np.uint8)
        drop = np.concatenate(([False], (raw[1:] == 0) & (raw[:-1] == 255)))
        self.base = np.cumsum([0, *map(len, files)])
        self.gone = np.concatenate(([0], np.cumsum(drop)))
        self.data = np.concatenate((raw[~drop], np.zeros(16, np.uint8)))
        x = self.data.astype(np.uint64)
        self.window = np.zeros(len(x) - 8, np.uint64)
        for i in range(8):
            self.window |= x[i : len(x) - 8 + i] << np.uint64(56 - 8 * i)

    def places(self, at: np.ndarray) -> np.ndarray:
        """Bit places of bytes of the files set end to end."""
        return (at - self.gone[at]) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place on, at the top of 64."""
        return self.window[at >> 3] << (at & 7).astype(np.uint64)


def _top(x: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits behind skip bits; 0 bits give 0."""
    return ((x << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extended(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)


def _dc_first(bits: _Bits, at, order, start, out, scan, table) -> None:
    last = np.zeros((len(at), 3), np.int64)
    place, end, lane = start[:-1].copy(), start[1:], np.arange(len(at))
    while len(lane):
        x = bits.peek(at[lane])
        look = table.look[(x >> np.uint64(48)).astype(np.int64)]
        n, s = look >> 8, look & 255
        part = np.maximum(place[lane] % 6 - 3, 0)
        last[lane, part] += _extended(_top(x, n, s), s)
        out[order[place[lane]], 0] += last[lane, part] << scan[4]
        at[lane] += n + s
        place[lane] += 1
        lane = lane[place[lane] < end[lane]]


def _dc_later(bits: _Bits, at, order, start, out, scan, table) -> None:
    size = np.diff(start)
    where = np.repeat(at - start[:-1], size) + np.arange(start[-1])
    out[order, 0] |= (bits.peek(where) >> np.uint64(63)).astype(np.int64) << scan[4]


def _ac_first(bits: _Bits, at, order, start, out, scan, table) -> None:
    _, low, high, _, shift = scan
    flat = out.reshape(-1)
    lane = np.arange(len(at))
    place, end, k = start[:-1].copy(), start[1:].copy(), np.full(len(at), low)
    while len(place):
        x = bits.peek(at)
        look = table.look[(x >> np.uint64(48)).astype(np.int64)]
        n, r, s = look >> 8, look >> 4 & 15, look & 15
        valued = s > 0
        if valued.all():
            k = k + r
            flat[order[place] * 64 + k] = _extended(_top(x, n, s), s) << shift
            at, k = at + n + s, k + 1
        else:
            run = np.where(~valued & (r < 15), r, 0)
            v = _top(x, n, np.where(valued, s, run))
            spot = k + r
            flat[(order[place] * 64 + spot)[valued]] = _extended(v, s)[valued] << shift
            ended = ~valued & (r < 15)
            at = at + n + np.where(valued, s, run)
            place = np.where(ended, place + (1 << run) + v - 1, place)
            k = np.where(ended, high, spot) + 1
        over = k > high
        if over.any():
            place = place + over
            k = np.where(over, low, k)
            stay = place < end
            if not stay.all():
                at, place, end, k, lane = at[stay], place[stay], end[stay], k[stay], lane[stay]


def _ac_later(bits: _Bits, at, order, start, out, scan, table) -> None:
    _, low, high, _, shift = scan
    place, end, k, left = start[:-1].copy(), start[1:].copy(), np.full(len(at), low), np.zeros(len(at), np.int64)
    spots, one = np.arange(low, high + 1), 1 << shift
    while len(place):
        read = left == 0  # the others are in a run of blocks without new coefficients
        x = bits.peek(at)
        look = table.look[(x >> np.uint64(48)).astype(np.int64)]
        n, r, s = np.where(read, look >> 8, 0), look >> 4 & 15, np.where(read, look & 15, 0)
        ended = read & (s == 0) & (r < 15)
        run = np.where(ended, r, 0)
        v = _top(x, n, np.where(ended, run, s))
        at = at + n + np.where(ended, run, s)
        left = np.where(ended, (1 << run) + v, left)
        block = order[place]
        own = out[block, low : high + 1]
        ahead = spots[None] >= k[:, None]
        known = (own != 0) & ahead
        whole = left > 0
        if whole.all():
            reach = np.full(len(k), high + 1)
        else:
            zeros = np.cumsum((own == 0) & ahead, 1) > r[:, None]
            reach = np.where(whole, high + 1, np.where(zeros.any(1), zeros.argmax(1) + low, high + 1))
        fix = known & (spots[None] < reach[:, None])
        nth = np.cumsum(fix, 1)
        where = at[:, None] + nth - 1
        bit = (bits.data[np.maximum(where, 0) >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1
        own = own + np.where(fix & (bit == 1), np.sign(own) * one, 0)
        at = at + nth[:, -1]
        fresh = np.flatnonzero((s > 0) & (reach <= high))
        own[fresh, reach[fresh] - low] = np.where(v[fresh] == 1, one, -one)
        out[block, low : high + 1] = own
        left = np.where(whole, left - 1, left)
        k = reach + 1
        over = k > high
        place = place + over
        k = np.where(over, low, k)
        stay = place < end
        if not stay.all():
            at, place, end, k, left = at[stay], place[stay], end[stay], k[stay], left[stay]


def coefficients(files: Sequence[bytes]) -> tuple[np.ndarray, Grid, list[Parsed]]:
    """Coefficients of all files in zigzag order, unit after unit."""
    parsed = [parse(f) for f in files]
    grid = Grid([p.shape for p in parsed])
    out, bits = np.zeros((grid.total, 64), np.int64), _Bits(files)
    # scans of one kind run side by side, in all files and components, once those they refine are done
    groups: dict[tuple, dict[tuple, list[tuple[int, list]]]] = defaultdict(lambda: defaultdict(list))
    kept: dict[int, Table | None] = {}
    for i, p in enumerate(parsed):
        done: list[tuple[tuple, int]] = []
        for scan, restart, table, intervals in p.scans:
            level = max((n + 1 for x, n in done if set(x[0]) & set(scan[0]) and x[1] <= scan[2] and scan[1] <= x[2]), default=0)
            done.append((scan, level))
            kept[id(table)] = table
            groups[level, *scan[1:], len(scan[0]) > 1, restart, id(table)][scan[0]].append((i, intervals))
    for (_, low, high, before, after, joint, restart, table), by in sorted(groups.items(), key=lambda g: g[0][0]):
        orders, counts, at = [], [], []
        for components, members in by.items():
            own = [i for i, _ in members]
            part = grid if len(own) == len(parsed) else Grid([parsed[i].shape for i in own])
            order, n = part.order(components)
            orders.append(order if part is grid else order + np.repeat(grid.base[own] - part.base, n))
            counts.append(n)
            at += [a + base for (_, iv), base in zip(members, bits.base[own].tolist()) for a, _ in iv]
        start, _ = _stretches(np.concatenate(counts), (restart or 1 << 40) * (6 if joint else 1))
        if len(at) != len(start) - 1:
            raise ValueError("restart intervals are missing")
        kind = (_dc_later if before else _dc_first) if low == 0 else (_ac_later if before else _ac_first)
        kind(bits, bits.places(np.array(at, np.int64)), np.concatenate(orders), start, out, (None, low, high, before, after), kept[table])
    return out, grid, parsed


def _inverse() -> np.ndarray:
    """Samples of a block in rows from its coefficients in zigzag order."""
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


_INVERSE = _inverse()


def tiles(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """RGB tiles of 16 by 16 of each unit."""
    flat = np.clip(np.rint((blocks.astype(np.float32) * quant.astype(np.float32)) @ _INVERSE + 128), 0, 255).reshape(-1, 6, 8, 8)
    y = flat[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb, cr = (np.repeat(np.repeat(flat[:, i] - 128, 2, 1), 2, 2) for i in (4, 5))
    rgb = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode(file: bytes) -> np.ndarray:
    """The RGB tensor (height, width, 3) of a file, whole units."""
    blocks, grid, parsed = coefficients([file])
    h, w = grid.shapes[0]
    return tiles(blocks, parsed[0].quant).reshape(h, w, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * h, 16 * w, 3)
