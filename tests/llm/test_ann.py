import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, v string, pivot int"


def test_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[40:80] = x[40]
    data = [(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)]
    data += [(600, None, 0, "", 0), (700, [0.0] * 16, 0, "", 0), (701, [None] * 16, 0, "", 0), (702, [float("nan")] * 16, 0, "", 0), (703, [1.0], 0, "", 0), (None, [1.0] * 16, 0, "", 0)]
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0).toPandas()
    x = x.astype(np.float64)
    found = total = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(d[own.vec_id], own.score, atol=1e-12)
        found += len(set(best) & set(own.vec_id))
        total += 10
        if q == 40:
            assert own.vec_id.tolist() == list(range(41, 51))
    assert found / total >= 0.9
    assert set(got.query_id) == set(range(0, 600, 20))


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0, "", 0) for i in range(4)], SCHEMA)
    got = ann.nearest(df, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
