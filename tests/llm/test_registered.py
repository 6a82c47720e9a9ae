"""The registered queries on small tables with odd rows, against what their contracts say, computed apart."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_secrets import brute as base_spans
from test_simhash import brute as fingerprint
from test_simhash import groups
from tokenizers import Tokenizer

from strandloom.llm import queries, secrets


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)] + [(400, None), (500, [0.0] * 8)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    talk = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} [INST]") for c in range(5) for t in range(1 + 3 * c)] + [(7, 0, None, None)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def told(rows):
    return sorted(map(str, rows))


def ids_of(text, name):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, folder, rows):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, folder).collect()]
    fps = [(r[0], fingerprint(r[1])) for r in rows]
    near = groups(fps, 3)
    assert told(got) == told((d, f"{f:016x}", near[i]) for i, (d, f) in enumerate(fps))


def test_op2(spark, folder):
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 300").collect()}
    got = queries.op2_nearest(spark, folder).toPandas()
    found = 0
    for q in (0, 100, 200):
        want = sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own.score.is_monotonic_increasing
        found += len({i for _, i in want} & set(own.vec_id))
    assert set(got.query_id) == {0, 100, 200} and found >= 27


def test_op3(spark, folder, rows):
    got = queries.op3_toxicity(spark, folder).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert told((r.doc_id, r.held_out) for r in got) == told((r[0], held(r[0])) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_op4(spark, folder, rows):
    got = queries.op4_packing(spark, folder).toPandas()
    whole = {r[0]: ids_of(r[1], "byte_bpe_50k.json") for r in rows if r[0] is not None and r[0] != 3}
    for d, ids in whole.items():
        own = got[got.doc_id == d].sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
        assert [crc(ids[s : s + n]) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert (got.start == 0).sum() == len(rows)


def test_op6(spark, folder, rows):
    got = queries.op6_secrets(spark, folder).collect()
    want = []
    for d, t, *_ in rows:
        spans = base_spans(t)
        want.append((d, *(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()))
    assert told((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == told(want)


def test_op7(spark, folder, rows):
    got = queries.op7_media(spark, folder).collect()

    def payload(t):
        b = (t or "").encode()
        return b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))

    want = [(r[0], len((r[1] or "").encode()), len(payload(r[1])), hashlib.sha256(payload(r[1])).hexdigest(), zlib.crc32(payload(r[1])[-64:])) for r in rows]
    assert told((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == told(want)
    same = {}
    assert all(same.setdefault(r.payload_sha256, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature) for r in got if r.n_bytes)


def test_op8(spark, folder, rows):
    got = sorted(queries.op8_rans(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    made = [ids_of(r[1], "word_bpe_49k.json") for r in rows]
    assert told((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == told((r[0], len(x), crc(x)) for r, x in zip(rows, made))


def test_op9(spark, folder, rows):
    got = queries.op9_language(spark, folder).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    letter = lambda t: any(c.isalpha() for c in t or "")
    assert told((r.doc_id, r.held_out, r.lang_pred == "und") for r in got) == told((r[0], held(r[0]), not letter(r[1])) for r in rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)


def test_op10(spark, folder):
    talk = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    talk += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op10_chat(spark, folder).collect()}
    assert set(got) == {c for c, *_ in talk}
    for c, r in got.items():
        own = sorted(x[1:] for x in talk if x[0] == c)
        said = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(said)) and r.formatted_chars >= sum(len(t) for *_, t in own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = queries.queries()[name](spark, folder)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert told(tuple(r[c] for c in columns) for r in df.collect()) == told(want.fetchall())


def test_every_query_is_here():
    assert {re.match(r"op\d+", n)[0] for n in queries.queries() if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)}
