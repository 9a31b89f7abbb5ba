import math

import numpy as np
import pytest

from tomespark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, most=8):
    good = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], dtype=object)
    n, s = len(good), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1).tolist()
    c = (x - np.array([a / n for a in s], dtype=object)).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return [i for i, _ in good], n, deviation, c @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def compare(got, rows, most=8):
    ids, n, deviation, whitened, explained = plain(rows, most)
    k = whitened.shape[1]
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    sign = np.array([np.sign(by_id[ids[0]][j + 1][0]["whitened"] * whitened[0, j]) for j in range(k)])
    for i, d, w in zip(ids, deviation, whitened):
        for j in range(k):
            for r in by_id[i][j + 1]:
                assert r["deviation"] == d
                assert r["whitened"] == pytest.approx(w[j] * sign[j], abs=1e-8)
                assert r["explained"] == pytest.approx(explained[j], rel=1e-9)
                assert 0 <= r["identity_error"] < 1e-8


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_equals_plain_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13)).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)]  # a third are copies
    rows += [(7, rows[7][1]), (None, rows[3][1])]  # a repeated id with its own vector, and none
    odd = [(900, None), (901, []), (902, [1.0, None] * 6), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    got = whitening.whiten(frame(spark, rows + odd)).collect()
    compare(got, rows)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).astype("f4").tolist()) for i in range(50)]
    got = whitening.whiten(frame(spark, rows + [(99, [1.0, 2.0])])).collect()  # another length takes no part
    compare(got, rows)


def test_no_variation(spark):
    rows = [(i, [1.0, 2.0, float(i % 2)]) for i in range(10)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 30
    for r in got:
        assert (r["whitened"] is None) == (r["component"] > 1)
        assert r["explained"] == pytest.approx(1.0 if r["component"] == 1 else 0.0)
        assert r["identity_error"] < 1e-9
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2.0**30 * (i + 1)), float(-i), 0.5 * i * i]) for i in range(6)]
    got = whitening.whiten(frame(spark, rows + [(9, [3e38, 0.0, 0.0])])).collect()  # beyond 64 bits: no part
    want = dict(zip(*[plain(rows)[0], plain(rows)[2]]))
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in want.items()}


def test_empty_and_columns(spark):
    got = whitening.whiten(frame(spark, [(1, [1.0])]).limit(0))
    assert got.count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [0.0, 5.0])])).dtypes == got.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
