import itertools
import random
import re

import pytest
import xxhash

from strandloom.llm import simhash
from strandloom.llm.components import components


def brute(text, width=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    """Smallest id reachable for each row of (id, fp)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
            parent[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(fps):
        out.setdefault(find(i), []).append(d)
    return {i: min((d for d in out[find(i)] if d is not None), default=None) for i in range(len(fps))}


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_masks_cover_every_pair(radius):
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for positions in itertools.islice(itertools.combinations(range(64), radius), 0, 60_000, 7 if radius < 6 else 97):
        assert any(all(not m >> p & 1 for p in positions) for m in masks)


def test_against_brute_force(docs, rows):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fps = [(r[0], brute(r[1])) for r in rows]
    want = sorted(((d, f - (1 << 64) if f >> 63 else f, groups_[i]) for groups_ in [groups(fps, 3)] for i, (d, f) in enumerate(fps)), key=str)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hot_bucket_is_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    base = 0x1234567890ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {base, ~base & (1 << 64) - 1})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df, radius=3)).collect()}
    assert len(roots) == len(fps) - 1 and len(set(roots.values())) == 1


def test_dealt_rows_shrink_by_level(spark, monkeypatch):
    """A hot bucket's rows are dealt four times a level, but every level leaves fewer of them hot."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    sizes, split = [], simhash._split
    monkeypatch.setattr(simhash, "_split", lambda hot, parts: sizes.append(hot.count()) or split(hot, parts))
    rng = random.Random(6)
    fps = [rng.getrandbits(63) & ~0xFFFF for _ in range(20)]
    fps += [fps[0] | rng.getrandbits(16) for _ in range(2000)]
    roots = simhash.links(spark.createDataFrame([(f,) for f in set(fps)], "fp long"), radius=3)
    got = {r.node: r.root for r in components(roots).collect()}
    want = groups([(f, f) for f in sorted(set(fps))], 3)
    assert all(got.get(f, f) == want[i] for i, f in enumerate(sorted(set(fps))))
    assert sizes[0] > 2000 and len(sizes) < 12 and sizes[-1] < sizes[0]


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(101, 140))
