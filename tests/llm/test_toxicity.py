import math
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import toxicity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4).filter(bool), min_size=1, max_size=30))
def test_segments_are_those_of_the_recursive_definition(gain):
    """The best segment first, of equal ones the shortest, then what is left on either side of it."""

    def recursive(a, b):
        best = max(((sum(gain[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*recursive(a, i), best[0], *recursive(j, b)]

    got = toxicity.segments(range(len(gain)), gain, 0.0)
    assert [s for *_, s in got] == recursive(0, len(gain))
    assert all(abs(sum(gain[a:b]) - s) < 1e-9 and s > 0 for a, b, s in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_evidence_takes_the_best_number_of_segments():
    assert toxicity.evidence(100, [], 1.0, 0.0) == 0 and toxicity.evidence(0, [5.0], 1.0, 0.0) > 0
    one = toxicity.evidence(100, [9.0], 1.0, 0.0)
    assert abs(one - (9.0 - math.log(100) - math.log(2))) < 1e-9
    assert toxicity.evidence(100, [9.0, 9.0], 1.0, 0.0) > one and toxicity.evidence(100, [9.0, 0.1], 1.0, 0.0) == one


def corpus(spark):
    rng = random.Random(1)
    words, bad = [a + b for a in "bcdfgh" for b in ("ana", "olo", "umi", "ete")], ["scum", "clown", "moron"]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(words, k=rng.randint(20, 80))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "scum clown moron scum", None, None, None), (2000, None, None, None, None), (2001, "", None, None, None)]
    labels += [(None, 1, 1), (2000, None, None), (0, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(900))
    right = sum(got[i].predicted == (i % 6 == 0) for i in held)
    assert right / len(held) > 0.97
    assert got[None].predicted == 1 and got[None].held_out is False
    assert got[2000].score == got[2001].score < 0.5
    assert all(0 <= r.score <= 1 for r in got.values())


def test_without_labels(spark):
    docs, labels = corpus(spark)
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_one_word_in_clean_text_is_found_and_clean_text_left(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    rng = random.Random(2)
    words = [a + b for a in "bcdfgh" for b in ("ana", "olo", "umi", "ete")]
    caught = clean = 0
    for _ in range(200):
        w = rng.choices(words, k=rng.randint(20, 400))
        clean += toxicity.probability(*told(" ".join(w), model), model) < 0.7
        w[rng.randrange(len(w))] = rng.choice(["scum", "Clown", "MORON"])
        caught += toxicity.probability(*told(" ".join(w), model), model) >= 0.7
    assert caught >= 180 and clean >= 196


def told(text, model):
    n, found = toxicity.passages(text, model)
    return n, [s for *_, s in found]


def test_copies_of_a_toxic_text_count_once(spark):
    rng = random.Random(4)
    words = [a + b for a in "bcdfgh" for b in ("ana", "olo", "umi", "ete")]
    rows = [(i, " ".join(rng.choices(words, k=40) + ["scum"] * (i % 7 == 0)), int(i % 7 == 0)) for i in range(400)]
    copied = " ".join(["zzyzx", *rng.choices(words, k=40)])
    rows += [(1000 + i, copied, 1) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "=scum" in model.scores.terms and "=zzyzx" not in model.scores.terms
