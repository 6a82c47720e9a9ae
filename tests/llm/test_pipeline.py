import random

import numpy as np
import pytest

import corpus_pipeline
from strandloom.llm import simhash, similar


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [a + b for a in ("ba", "ko", "li", "mu", "se", "ty") for b in ("ra", "no", "du", "zzi", "p")]
    path = str(tmp_path_factory.mktemp("sf"))
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = [text(rng.randint(80, 200)) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(200 + i, t, "de", "s0", len(t)) for i, t in enumerate(base[:10])]
    rows += [(300 + i, t + " last", "en", "s1", len(t)) for i, t in enumerate(base[10:20])]
    rows += [(400 + i, text(30) + " scum clown " + text(10) + " clown scum", "en", "s1", 1) for i in range(40)]
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (502, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "s2", 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(400 <= r[0] < 440)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out = spark.createDataFrame(out.collect(), out.schema)
        seen[name], docs = out.toPandas(), out
    clean = set(seen["toxicity"].doc_id)
    assert not any(400 <= i < 440 for i in clean) and set(range(120)) <= clean and {500, 501, 502} <= clean
    kept = seen["near_duplicates"].doc_id.tolist()
    assert len(kept) == len(set(kept)) and set(range(120)) <= set(kept)
    assert not any(200 <= i < 320 for i in kept) and 500 in kept and 501 not in kept
    safe = seen["secrets"].set_index("doc_id")
    assert safe.text[502] == "[SECRET]\"" and sorted(safe.index) == sorted(kept)
    mixed, packed = seen["mixing"], seen["packing"]
    assert set(mixed.doc_id) <= set(kept) and abs(sum(len((t or "").split()) for t in mixed.text) / sum(len((t or "").split()) for t in safe.text) - 1.5) < 0.02
    assert packed[packed.start == 0].doc_id.value_counts().to_dict() == mixed.doc_id.value_counts().to_dict()


def test_run_gives_pieces(spark, folder):
    assert corpus_pipeline.run(spark, folder).where("offset + length > 2048").count() == 0


@pytest.mark.parametrize("part", [1024, 8])
def test_near_copies_of_similarity_0_8_go_and_others_stay(spark, monkeypatch, part):
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for i in range(90):
        words = [word() for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(words))
        for _ in range(i % 4):  # each changed word takes five shingles
            copy = list(words)
            for at in rng.sample(range(len(words)), rng.randint(1, 5)):
                copy[at] = word()
            texts.append(" ".join(copy))
    shared = [word() for _ in range(120)]  # a large loose group around one text
    for _ in range(150):
        copy = list(shared)
        for at in rng.sample(range(len(shared)), rng.randint(0, 6)):
            copy[at] = word()
        texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == set(root) and len(kept) < len(texts) - 100


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    a, b, c = ("one two three four five six " * 3, "seven eight nine ten eleven twelve", "none of them is like any other one")
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (3, None), (None, ""), (4, "x y"), (4, "z")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (None, c), (3, None), (4, "x y"), (4, "z")], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_copies_meet_in_covering_tables_only(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(100)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(words + ["last"]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect())
    assert kept() == [1]
    monkeypatch.setattr(simhash, "masks", lambda radius: [(1 << 64) - 1])  # whole parts, and of these only one that differs
    x, y = (similar.signature(similar.shingles(r[1].encode(), 5)) for r in rows)
    apart = [(w, m) for w, m in simhash.tables(similar.WORDS, width=similar.WIDTH, radius=0) if (x[w] ^ y[w]) & m]
    monkeypatch.setattr(simhash, "tables", lambda *_, **__: apart[:1])
    assert apart and kept() == [1, 2]


def test_a_part_within_the_radius_is_found():
    tables = simhash.tables(3, width=16, radius=1)
    assert len(tables) == 3 * 4 * 3
    for part in range(12):
        for bit in range(16):  # all other parts differ everywhere
            apart = [(1 << 64) - 1] * 3
            apart[part // 4] &= ~(0xFFFF << part % 4 * 16) | 1 << part % 4 * 16 + bit
            assert any(not apart[w] & m for w, m in tables)


def test_texts_that_only_share_a_passage_are_not_held_against_each_other(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(110)]
    texts = [" ".join([*passage, *(word() for _ in range(rng.randint(40, 50)))]) for _ in range(200)]  # similarities of 0.52 to 0.59
    texts += [t + " last" for t in texts[:20]]
    opened, write = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, tag: (written := write(df, tag), tag == "open" and opened.append(written.count()))[0])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == set(range(200)) and opened[0] < 200


def test_a_sketch_drops_no_pair_of_the_wanted_similarity(monkeypatch):
    monkeypatch.setattr(similar, "FAR", 64 * similar.SKETCH)  # what remains is exact
    rng = np.random.default_rng(4)
    at = (*range(similar.SKETCH), *range(similar.WORDS, similar.WORDS + similar.ODD + 1))
    dropped = 0
    for n in (*range(1, 12), 60, 130, 300, 2000):
        for _ in range(30):
            of = np.unique(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64))
            new = np.unique(rng.integers(0, 1 << 63, int(rng.integers(0, n + 1)), np.int64).astype(np.uint64))
            x, y = of, np.union1d(of[int(rng.integers(0, n + 1)) :], new)
            for a, b in ((x, y), (of, of[: max(1, -(-n * 4 // 5))]), (of, of)):
                if not len(b):
                    continue
                rows = [np.array(c, np.int64) for c in zip(*([similar.signature(s)[i] for i in at] for s in (a, b)))]
                i, j = similar._near(rows, slice(0, 1), slice(1, 2), 0.8)
                both = len(np.intersect1d(a, b))
                assert len(i) == 1 or both < 0.8 * (len(a) + len(b) - both)
                dropped += not len(i)
    assert dropped > 100


def test_rows_are_open_in_the_first_table_where_they_meet():
    dealt = simhash.tables(similar.WORDS, width=16, radius=1)
    values = {"root": [1, 2], "node": [1, 2], "s0": [0, 0xFFFF], "size": [100, 100]}  # the first part, of three tables, differs everywhere

    def opened(table):
        rows = similar.batch(similar._OPEN, *([table << 48] * 2 if c == "key" else values.get(c, [0, 0]) for c in similar._OPEN.names))
        return sum(b.num_rows for b in similar._open(dealt, 0.8)(iter([rows])))

    assert [opened(i) for i in range(len(dealt))] == [2] * 4 + [0] * (len(dealt) - 4)
