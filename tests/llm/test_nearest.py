import numpy as np
import pytest
from pyspark.sql import functions as F

from tomespark.llm import nearest


def brute(rows, k, modulo):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if i % modulo == 0:
            found = []
            for j, c in good:
                if j != i and len(c) == len(q):
                    s = 0.0
                    for a, b in zip(q.tolist(), c.tolist()):
                        s += a * b
                    found.append((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("q_block,c_block,k", [(2048, 16384, 20), (7, 50, 5), (3, 40, 300)])
def test_matches_brute_force(spark, monkeypatch, q_block, c_block, k):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", q_block)
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", c_block)
    monkeypatch.setattr(nearest, "PAIRS", 50)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).astype("f4").tolist()
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(200)]
    rows += [(200 + i, hot) for i in range(60)]  # ties
    rows += [(300 + i, (rng.normal(size=8) * 10.0 ** rng.integers(-6, 6)).astype("f4").tolist()) for i in range(40)]
    rows += [(400, None), (410, [0.0] * 8), (420, [1.0, None] * 4), (430, [float("nan")] * 8), (440, [float("inf")] + [1.0] * 7), (450, []), (460, [1.0, 2.0]), (470, [3.0, 1.0]), (None, hot)]
    frame = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id long, embedding array<float>, id int, rank int, score double").repartition(3)
    got = nearest.nearest(frame, F.col("id") % 20 == 0, k=k).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, k, 20)


def test_empty(spark):
    frame = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert nearest.nearest(frame, F.col("id") % 20 == 0).count() == 0
    assert nearest.nearest(frame.limit(0), F.col("id") % 20 == 0).count() == 0
