import hashlib
import zlib

import numpy as np
import pytest

from strandloom.llm import jpeg, media


@pytest.mark.parametrize("seed", range(4))
def test_any_coefficients_come_back(seed):
    rng = np.random.default_rng(seed)
    shapes = [(1, 1), (3, 2), (9, 1), (2, 5)]
    n = sum(h * w * 6 for h, w in shapes)
    kinds = (rng.integers(-500, 500, (n, 64)), rng.integers(-2, 3, (n, 64)) * (rng.random((n, 64)) < 0.1), np.zeros((n, 64), int), rng.integers(2, 131, (n, 64)))
    files = jpeg.encode(kinds[seed], shapes, [b""] * 4)
    got, grid, _ = jpeg.coefficients(files)
    assert (got == kinds[seed]).all()
    one, _, _ = jpeg.coefficients(files[1:2])  # a file alone decodes alike
    assert (one == got[6:42]).all()


def test_flat_blocks_give_flat_tensors_with_upsampled_chroma():
    blocks = np.zeros((6, 64), int)
    blocks[:4, 0], blocks[4, 0], blocks[5, 0] = 8 * 40, 8 * 10, -8 * 20
    rgb = jpeg.decode(jpeg.encode(blocks, [(1, 1)], [b""])[0])
    y, cb, cr = 168, 10, -20
    want = np.rint([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])
    assert rgb.shape == (16, 16, 3) and (rgb == want).all()


def test_inverse_transform_is_orthonormal():
    m = jpeg._INVERSE
    assert np.allclose(m @ m.T, np.eye(64), atol=1e-5)


def test_payloads_and_features(docs, rows, monkeypatch):
    monkeypatch.setattr(media, "FRAME", 4096)
    stored = media.store(docs)
    got = sorted(media.features(stored).collect(), key=lambda r: (str(r.doc_id), r.n_bytes))
    want = []
    for r in rows:
        t = (r[1] or "").encode()
        p = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        want.append((r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got] == sorted(want, key=lambda r: (str(r[0]), r[1]))
    same = {}
    assert all(same.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature) for r in got)
    t = media.tensors(stored).first()
    assert len(t.rgb) == t.height * t.width * 3


def test_empty_table(none):
    assert media.features(media.store(none)).count() == 0


def test_features_give_every_tensor(spark, docs):
    long = spark.createDataFrame([(-7, "some words " * 40_000)], "doc_id long, text string")  # two frames
    stored = media.store(docs.select("doc_id", "text").union(long))
    key = lambda r: (str(r[0]), r[1], r[4])
    got = [(r.doc_id, i, t.height, t.width, bytes(t.rgb)) for r in media.features(stored, tensors=True).collect() for i, t in enumerate(r.tensors)]
    want = [(*r[:4], bytes(r.rgb)) for r in media.tensors(stored).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and any(i > 0 for _, i, *_ in got)
    plain, full = ({tuple(r)[:8] for r in media.features(stored, tensors=x).collect()} for x in (False, True))
    assert plain == full


def test_query_gives_the_tensors(spark):
    from strandloom.llm import queries

    rows = queries.op7_media(spark, "/root/testdata/sf0.001").select("payload_bytes", "feature", "tensors").collect()
    for r in rows:
        pixels = sum(t.height * t.width for t in r.tensors)
        assert pixels == int(r.feature.split(":")[0]) >= r.payload_bytes * 2 / 3 and all(len(t.rgb) == 3 * t.height * t.width for t in r.tensors)
