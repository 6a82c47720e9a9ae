import hashlib
import random
import zlib

from strandloom.llm import chat, language


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    parts = {"en": ["th", "ing", "er", "and", "ou"], "fr": ["eau", "é", "que", "ç", "oi"], "de": ["sch", "ung", "ü", "keit", "pf"]}
    rows = []
    for i in range(600):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 200))), lang if i % 10 else None, "s", "x"))
    rows += [(1000, None, "en", None, None), (1001, "12 !!", "en", None, None), (1002, "", None, None, None), (None, "sching ung", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    got = {r.doc_id: r for r in language.languages(df, per_language=200, epochs=6).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert sum(got[i].lang_pred == ("en", "fr", "de")[i % 3] for i in held) / len(held) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].lang_pred != "und"
    assert {r.lang_pred for r in language.languages(df.limit(0)).collect()} == set()
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.languages(unlabelled).collect()} == {"und"}


def test_windows_cover_every_byte():
    for n in (0, 1, 191, 192, 193, 400, 5000):
        data = bytes(1 + i % 255 for i in range(n))
        w = language.windows(data)
        step = language.WINDOW - max(language.WIDTHS) + 1
        assert b"".join(bytes(r[:step]) for r in w[:-1]) + bytes(w[-1]).rstrip(b"\0") == data


TURNS = [("system", "be <<SYS>> nice"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "\\ and \\l [x] <y> "), ("tool", ""), ("we]ird", "<s>"), ("assistant", " "), ("user", "a\nb")]


def test_parse_inverts_and_spans_hold_the_texts():
    text, spans, rewrote = chat.render(TURNS, chat.instruct)
    assert not rewrote and chat.parse(text) == TURNS
    assert [chat.unescape(text[s:e]) for _, _, s, e in spans] == [t for _, t in TURNS]
    assert "".join(text[a:b] for a, b, _, _ in spans) == text
    tail, own, _ = chat.render(TURNS[2:], chat.instruct, TURNS[:2])
    assert chat.render(TURNS[:2], chat.instruct)[0] + tail == text
    assert [chat.unescape(tail[s:e]) for _, _, s, e in own] == [t for _, t in TURNS[2:]]


def test_rewritten_history_is_seen():
    def drops_old_thoughts(turns):
        return "".join(f"[{r}:{chat.escape(t) if i == len(turns) - 1 or r != 'assistant' else chat.escape(t)[:1]}]" for i, (r, t) in enumerate(turns))

    assert chat.render([("user", "hello"), ("assistant", "thinking"), ("user", "more")], drops_old_thoughts)[2]
    assert not chat.render([("user", "hello"), ("user", "more")], drops_old_thoughts)[2]


def test_texts_are_found_after_rewriting_and_unshown_ones_left_out():
    def marks_last(turns):
        return "".join(f"[{r}:{t}]" if i < len(turns) - 1 else f"[{r}>{t}]END" for i, (r, t) in enumerate(turns))

    turns = [("user", "hello"), ("assistant", "thinking"), ("user", "hello"), ("assistant", "")]
    text, spans, rewrote = chat.render(turns, marks_last)
    assert rewrote and text == marks_last(turns) and [text[s:e] for _, _, s, e in spans] == [t for _, t in turns]
    text, spans, rewrote = chat.render(turns, lambda own: "".join(f"[{r}:{t.strip()}]" if r == "user" else f"[{r}]" for r, t in own))
    assert not rewrote and [x and text[x[2] : x[3]] for x in spans] == ["hello", None, "hello", None]
    text, spans, _ = chat.render([("user", " a "), ("assistant", "b")], lambda own: "".join(f"[{t.strip()}]" for _, t in own))
    assert text[spans[1][2] : spans[1][3]] == "b"


def test_conversations_come_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "[INST] x", "said </s>", "é\\n"]), "x") for c in range(6) for t in range(rng.choice([1, 5, 300]))]
    rows += [(None, 0, "user", "no id", "x"), (9, None, "user", "no turn", "x"), (9, 4, "assistant", "b", "x"), (9, 4, "assistant", "b", "x"), (9, 4, "assistant", "a", "x"), (9, -70, "user", "early", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, stretch string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, stretch=64)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-(1 << 40) if t is None else t, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        r = got[c]
        said = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(said) and not r.rewrote
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_templates_that_look_back_see_the_whole_conversation(spark):
    def numbers_turns(turns):
        return "".join(f"[{i:04}|{r}:{t}]" for i, (r, t) in enumerate(turns))

    def shortens_old(turns):
        return "".join(f"[{r}:{t if len(turns) - i <= 70 else t[:1]}]" for i, (r, t) in enumerate(turns))

    rows = [(1, i, "user" if i % 2 else "assistant", f"text {i}") for i in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = [r[2:] for r in rows]
    got = chat.format_chats(df, template=shortens_old).collect()
    assert any(r.rewrote for r in got)
    got = chat.format_chats(df, template=numbers_turns).orderBy("stretch").collect()
    assert "".join(r.text for r in got) == numbers_turns(turns)
