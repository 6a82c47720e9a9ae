import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm import packing, rans, tokens
from strandloom.llm.common import shared_dir

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def reference_ids(rows, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(rows, name):
    odd = ["don't 'S 's", "a'll 'x", "İªº", "tab\tx\r\n\r\n y  ", "  lead", "A1b22 #$%", " x  y", "naïve ½ ²", "caf́e"]
    some = [*[(0, r[1]) for r in rows], *[(0, x) for x in odd]]
    e = tokens.Encoder(public_tokenizers.path(name))
    assert e.merge is not None
    for _ in range(2):
        assert list(e.encode([t for _, t in some])) == [x[:-1].tobytes() for x in reference_ids(some, name)]


def test_held_words_are_let_go(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 10)
    e = tokens.Encoder(public_tokenizers.path(FILES[0]))
    texts = [f"w{i} x{i} y" for i in range(40)]
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    assert list(e.encode(texts)) == [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts)]
    assert e.tokenizer is None  # none of them needs it


@pytest.mark.parametrize("name", FILES)
def test_narrow_ids(rows, name):
    texts = [r[1] for r in rows]
    wide, narrow = tokens.Encoder(public_tokenizers.path(name)), tokens.Encoder(public_tokenizers.path(name), narrow=True)
    assert (wide.size, narrow.size) == (4, 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in wide.encode(texts)] == [np.frombuffer(x, "<u2").tolist() for x in narrow.encode(texts)]


def test_packing_is_whole_and_dense(docs, rows):
    got = packing.pack(docs, public_tokenizers.path(FILES[0]), keep_ids=True).toPandas()
    want = sorted(zlib.crc32(x.tobytes()) for x in reference_ids(rows, FILES[0]))
    whole = []
    ids = got.assign(doc=got.doc_id.fillna(-1))
    for _, g in ids.groupby(["doc", "doc_tokens"]):
        n = int((g.start == 0).sum())
        parts = g.sort_values("start")
        if n == 1:
            whole.append(zlib.crc32(b"".join(parts.ids)))
        else:  # repeated rows have equal pieces
            whole += [zlib.crc32(b"".join(parts.ids.iloc[::n]))] * n
    assert sorted(whole) == want
    assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(got.ids, got.ids_crc32, got.length))
    lengths = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
        lengths.append(g.length.sum())
    assert max(lengths) <= 2048 and sorted(got.sequence_id.unique()) == list(range(len(lengths)))
    assert len(lengths) <= -(-got.length.sum() // 2048) + 2


def test_column_generation_meets_the_bound_and_the_demand():
    demand = {100: 7, 60: 11, 50: 9, 33: 20, 7: 31, 256: 3}
    made = packing.plan(demand, 256)
    held = {k: sum(p.copies * p.items.get(k, 0) for p in made) for k in demand}
    assert held == demand and all(sum(k * a for k, a in p.items.items()) <= 256 for p in made)
    least = sum(k * n for k, n in demand.items()) / 256
    assert sum(p.copies for p in made) <= least + 2
    assert packing.plan({}, 256) == []


def test_empty_tables(none):
    assert packing.pack(none, public_tokenizers.path(FILES[0])).count() == 0
    assert rans.roundtrip(none, public_tokenizers.path(FILES[1])).count() == 0


def test_token_files_round_trip(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(rans, "FILE_TOKENS", 2000)
    folder = shared_dir(spark, "test")
    rans.write_tokens(docs, public_tokenizers.path(FILES[1]), folder)
    got = sorted(rans.read_tokens(spark, folder, keep_ids=True).collect(), key=lambda r: r.start)
    want = sorted(((r[0] if r[0] is not None else -1, x.tobytes()) for r, x in zip(rows, reference_ids(rows, FILES[1]))))
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in got) == want
    ids = [r.doc_id if r.doc_id is not None else -1 for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)


def test_coder_blocks_checksums_and_damage():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 77):
        ids = rng.zipf(1.3, n).clip(max=70_000).astype(np.int64)
        coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=5)))
        data = coder.write([5], [n], ids)
        assert (coder.read(data)[2] == ids).all()
    broken = bytearray(data)
    broken[-100] ^= 1
    with pytest.raises(ValueError):
        coder.read(bytes(broken))


def test_frequencies_sum_and_keep_every_id():
    f = rans.frequencies(np.array([10**9, 1, 0, *[1] * 60_000]))
    assert f.sum() == 1 << rans.BITS and (f[[0, 1, 3]] > 0).all() and f[2] == 0
