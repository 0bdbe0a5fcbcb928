"""Whitening and bit-sliced search against numpy on small tables."""

import numpy as np
import pytest

from footfall.llm import bit_sliced, whitening
from footfall.llm.bit_sliced import Block, Query, signed_digits

SCHEMA = "vec_id long, embedding array<float>"


def vectors(spark, rows, clash=False):
    if clash:
        return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA + ", v string, n string, score long").repartition(3)
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows():
    """Rows that take no part."""
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, []), (950, [nan] * 6), (1000, [inf] + [0.0] * 5), (1050, [None] + [1.0] * 5), (1100, [1.0, 2.0])]


def table(seed, n=400, d=6):
    draw = np.random.default_rng(seed)
    x = (draw.standard_normal((n, d)) * np.linspace(1, 3, d) + draw.standard_normal(d)).astype(np.float32)
    x[5:40] = x[4]                                          # one vector many times
    return [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]


def whitened_by_numpy(rows, scale=64, k=32):
    x = np.floor(scale * np.array([r[1] for r in rows], dtype=float)).astype(np.int64) + 1000000
    n, total = len(x), x.sum(0)
    y = (n * x - total) / n
    e, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:k]
    return y @ axes[:, order] / np.sqrt(e[order]), ((n * x - total) ** 2).sum(1), e[order] / e.sum()


@pytest.mark.parametrize("d,k", [(6, 32), (40, 3)])
def test_whitening_equals_an_eigen_decomposition(spark, d, k):
    rows = table(3, d=d)
    odd = odd_rows() if d == 6 else []
    out = whitening.whiten(vectors(spark, rows + odd, clash=True), components=k).toPandas()
    want, deviation, explained = whitened_by_numpy(rows, k=k)
    k = want.shape[1]
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[range(len(rows))].to_numpy()
    assert len(out) == len(rows) * k and got.shape == want.shape
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    assert out.groupby("vec_id").deviation.first().loc[range(len(rows))].tolist() == deviation.tolist()
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-9) and (out.n == len(rows)).all()
    assert out.identity_error.nunique() == 1 and 0 <= out.identity_error[0] < 1e-9


def test_whitening_finds_every_vector_of_equal_eigenvalues_and_stops_at_the_rank():
    draw = np.random.default_rng(1)
    q, _ = np.linalg.qr(draw.standard_normal((50, 8)))
    axes, _ = np.linalg.qr(draw.standard_normal((8, 8)))
    s = np.array([5, 5, 5, 5, 2, 2, 0, 0])
    y = q * s @ axes.T
    found, got = whitening.bidiagonalise(lambda w0, w: whitening._step(y, (w0, w)), 8, 8)
    assert np.allclose(got, s, atol=1e-12) and np.allclose(found.T @ found, np.eye(8), atol=1e-12)
    assert np.allclose((y @ found).T @ (y @ found), np.diag(s**2), atol=1e-10)


def test_whitening_of_flat_huge_and_empty_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0            # no variance
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    line = [(k, [float(k), 2.0 * k, 3.0]) for k in range(20)] + [(None, [1.0, 2.0, 3.0])]
    out = whitening.whiten(vectors(spark, line)).collect()
    assert len(out) == 21 and {r.component for r in out} == {1} and out[0].explained == pytest.approx(1)
    big = [(k, [1e13 * k, float(k % 2)]) for k in range(6)]                                # numerators beyond a long's square
    rows = whitening.whiten(vectors(spark, big)).collect()
    assert {r.component for r in rows} == {1} and all(r.deviation is None or r.deviation >= 0 for r in rows)
    exact = whitening._squared(np.array([[3, 4], [1 << 40, 0]], object)).to_pylist()
    assert exact == [25, None]


def brute_top(ids, values, own, query, k):
    full = values.astype(object) @ query.astype(object)
    return sorted((-int(f), int(i)) for f, i in zip(full, ids) if i != own)[:k]


@pytest.mark.parametrize("seed", range(6))
def test_block_search_equals_brute_force(seed, monkeypatch):
    draw = np.random.default_rng(seed)
    for _ in range(25):
        n, d, k = int(draw.integers(1, 260)), int(draw.integers(1, 9)), int(draw.integers(1, 7))
        most = int(draw.choice([1, 3, 100, 1 << 20]))
        values = draw.integers(-most, most + 1, (n, d))
        if draw.random() < 0.5:
            values[:n // 2] = values[0]
        ids = draw.integers(0, 2 * n, n)
        monkeypatch.setattr(bit_sliced, "FEW", int(draw.choice([0, 5, 1024])))
        block = Block.of_parts(*Block.build(ids, values).parts())
        query, own = draw.integers(-most, most + 1, d), int(draw.choice(ids))
        at, score = Query(block, query, signed_digits(query)).best(own, k)
        assert [(-int(s), int(block.ids[r])) for s, r in zip(score, at)] == brute_top(ids, values, own, query, k)


def test_top_k_of_a_table_with_ties_repeats_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bit_sliced, "CHUNK", 3)
    rows = table(9) + [(50, [1.0] + [0.0] * 5), (None, [9.0] * 6)]
    out = bit_sliced.top_k(vectors(spark, rows + odd_rows(), clash=True)).collect()
    values = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    ids = np.array([np.iinfo(np.int64).max if r[0] is None else r[0] for r in rows])
    want = []
    for row, (own, _) in enumerate(rows):
        if own is not None and own % 50 == 0:
            want += [(own, k + 1, None if i == np.iinfo(np.int64).max else i, -s) for k, (s, i) in enumerate(brute_top(ids, values, own, values[row], 5))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key) and len(out) == 9 * 5


def test_top_k_of_small_tables(spark):
    assert bit_sliced.top_k(vectors(spark, [])).count() == 0
    assert bit_sliced.top_k(vectors(spark, [(1, [1.0])])).count() == 0                   # no query
    assert bit_sliced.top_k(vectors(spark, [(50, [1.0])])).count() == 0                  # no candidate
    got = bit_sliced.top_k(vectors(spark, [(0, [0.0, 0.0]), (7, [1.0, 1.0]), (3, [2.0, 0.5])])).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 3, 0), (0, 2, 7, 0)]
    far = bit_sliced.top_k(vectors(spark, [(0, [3e38]), (1, [3e38])])).collect()
    assert len(far) == 1 and far[0].score > 0
