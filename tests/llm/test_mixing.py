import re

import numpy as np

from strandloom.llm import mixing, queries


def test_targets_share_the_excess():
    got = mixing.targets([100, 100, 1000], [5, 2, 1], 900, 2.0)
    assert got == [200, 200, 500]
    assert mixing.targets([], [], 0, 2.0) == [] and mixing.targets([0, 0], [1, 1], 0, 2.0) == [0, 0]


def test_splitting_tree_is_exact_and_disjoint():
    quotas, shards = [17, 0, 120, 3], 13
    got = [mixing.split_quotas(quotas, s, shards, 9) for s in range(shards)]
    assert np.sum([n for _, n in got], 0).tolist() == quotas
    at = np.zeros(4, int)
    for first, n in got:
        assert first == at.tolist()
        at += n
    assert max(sum(n) for _, n in got) - min(sum(n) for _, n in got) <= 4


def test_fill_ends_near_the_room():
    assert mixing.fill([(5, 1), (7, 1), (2, 1)], 8) == [1, 0, 1] and mixing.fill([(5, 1), (4, 1)], 8) == [1, 1]
    assert mixing.fill([(0, 3), (10, 4)], 25) == [3, 2] and mixing.fill([(10, 1)], 4) == [0] and mixing.fill([], 4) == []
    assert mixing.fill([(1, 1), (2, 1), (9, 1)], 9) == [0, 0, 1]


def brute(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """Sizes and targets of sources, the excess shared again until none is above."""
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, goal, left = {s: weights[i % 3] for i, s in enumerate(names)}, {}, share * sum(size.values())
    while True:
        free = [s for s in names if s not in goal]
        unit = left / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if unit * weight[s] > most * size[s]]
        if not over:
            return size, goal | {s: unit * weight[s] for s in free}
        for s in over:
            goal[s] = most * size[s]
            left -= goal[s]


def test_query_meets_the_targets_by_whole_documents(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_mixing(spark, str(tmp_path)).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").toPandas()
    size, goal = brute(rows)
    mixed = mixing.mix(docs).toPandas()
    assert len(mixed) == len(rows)
    assert sorted(mixed["size"]) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    for source, own in mixed.assign(s=mixed.source.fillna("~")).groupby("s"):
        s = None if source == "~" else source
        taken = (own["size"] * own.draws.map(len)).sum()
        assert (own.source_size == size[s]).all() and abs(own.target - goal[s]).max() < 1e-6 * goal[s] + 1e-9
        small = own["size"][own["size"] < 1000].sum()  # beside one document of 20,000 words
        assert abs(taken - goal[s]) <= (1 if own["size"].max() < 1000 else abs(size[s] + small - goal[s]))
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    places = [x for d in mixed.draws for x in d]
    assert all(len(t.split(",")) == n // s for t, n, s in zip(got.draws, got.taken, got["size"]) if n) and len(places) >= len(rows)


def test_reruns_agree_and_documents_follow(docs):
    one, two = (sorted(map(str, mixing.mix(docs).select("doc_id", "draws").collect())) for _ in range(2))
    assert one == two
    out = mixing.mixed_documents(docs).toPandas()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in out.text)
    mixed = mixing.mix(docs).toPandas()
    assert words == (mixed["size"] * mixed.draws.map(len)).sum() and out.shard.is_monotonic_increasing or out.shard.nunique() > 1


def test_a_hot_source_and_repeated_rows(spark):
    rows = [(i, f"w{i} " * (1 + i % 9), "en", "big" if i % 3 else f"s{i % 7}", 1) for i in range(3000)] + [(None, "same words", "en", "big", 1)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(df).toPandas()
    assert len(mixed) == 3500
    for _, own in mixed.groupby("source"):
        assert abs((own["size"] * own.draws.map(len)).sum() - own.target.iloc[0]) <= 9


def test_empty_table(none):
    assert mixing.mix(none).count() == 0
