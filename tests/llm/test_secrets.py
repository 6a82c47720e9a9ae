import hashlib
import random
import re

from strandloom.llm import secrets
from strandloom.llm.automata import CLASSES, Automaton, log_likelihoods


def brute(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A | re.I):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(out)


def test_base_spans_and_digest(docs, rows):
    got = secrets.digest(secrets.secrets(docs)).collect()
    want = sorted(str((r[0], hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in brute(r[1])).encode()).hexdigest(), *(sum(x[1] == k for x in brute(r[1])) for k in range(3)))) for r in rows)
    assert sorted(str((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex)) for r in got) == want
    assert all("learned" in x for r in got for x in r.spans.split(",") if x and x not in {f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in brute(dict((y[0], y[1]) for y in rows)[r.doc_id])})


def test_learned_formats_are_found_and_words_left(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 22))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (f' token = "{key(40)}"' if i % 3 == 0 else ""), "en", "s", 1) for i in range(300)]
    rows += [(1000, "seen " + key(28) + " here", "en", "s", 1), (1001, None, None, None, None), (1002, "", None, None, None)]
    short = {1100 + i: " ".join(rng.choices(words, k=40)) + " " for i in range(20)}
    rows += [(i, t + key(10), "en", "s", 1) for i, t in short.items()] + [(1200, "x " + key(32) + "/" + key(12).replace("a", "0") + "zz", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.spans for r in secrets.secrets(df).collect()}
    assert [(s["start"], s["kind"], s["end"]) for s in got[1000]] == [(5, 3, 33)]
    assert got[1001] == [] and got[1002] == []
    assert sum([(s["start"], s["kind"], s["end"]) for s in got[i]] == [(len(t), 3, len(t) + 10)] for i, t in short.items()) >= 16
    assert not any(s["kind"] == 3 for i in range(300) for s in got[i])
    clean = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert clean[1000].text == "seen [SECRET] here" and clean[1000].n_chars == 18 and clean[1001].text is None
    assert all(len(r.text) == r.n_chars for i, r in clean.items() if i % 3 == 0 and i < 300)


def test_candidates_are_what_base_spans_leave():
    text = "abcdefgh " + "0" * 32 + "/abcdefgh short " + "x" * 9 + "=" + "f" * 33
    base = secrets.base_spans(text)
    assert [x for *_, x in secrets._tokens(text, base)] == ["abcdefgh", "/abcdefgh", "x" * 9 + "="]
    assert all(text[s:e] == x for s, e, x in secrets._tokens(text, base))


def test_many_words_score_like_one_at_a_time():
    rng = random.Random(2)
    a = Automaton().learn(["".join(rng.choices("abc012-", k=rng.randint(1, 9))) for _ in range(100)])

    def one(word):
        s, out = 0, 0.0
        to, step, end = a.tables()
        for ch in word:
            c = next((i for i, x in enumerate(CLASSES) if ch in x), len(CLASSES))
            out, s = out + step[s, c], to[s, c]
        return out + end[s]

    words = ["", "a", "é0", *("".join(rng.choices("abcz012-+é", k=rng.randint(1, 30))) for _ in range(50))]
    assert all(abs(x - one(w)) < 1e-9 for x, w in zip(log_likelihoods(a.tables(), words), words))


def test_automaton_generalizes_and_sums_to_one_or_less():
    rng = random.Random(1)
    a = Automaton().learn(["AK" + "".join(rng.choices("0123456789", k=8)) for _ in range(200)])
    assert len(a.next) < 40
    assert a.log_likelihood("AK12345678") > a.log_likelihood("zz12345678") + 5
    assert Automaton().learn([]).log_likelihood("abc") < 0


def test_empty_table(none):
    assert secrets.digest(secrets.secrets(none)).count() == 0
