"""Whitening against a covariance and eigenvectors made at once, with odd rows and exact integers."""

import math
import random

import numpy as np
import pytest

from duskline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def brute(rows, k=8):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:k]
    return deviation, e[order], v[:, order], c, e.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    make = lambda: [rng.gauss(0, 1 / (1 + j)) for j in range(12)]
    good = [(i, make()) for i in range(700)] + [(None, make()), (3, make())]
    good += [good[5]] * 400
    odd = [(9001, None), (9002, []), (9003, [None, *make()[1:]]), (9004, [math.nan, *make()[1:]]), (9005, [*make()[1:], -math.inf]), (9006, [1.0, 2.0])]
    return good, odd


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening_is_the_eigenvectors_of_the_covariance(spark, vectors, parts):
    good, odd = vectors
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + odd], SCHEMA).repartition(parts)
    got = whitening.whiten(df).collect()
    deviation, e, v, c, trace = brute(good)
    assert len(got) == 8 * len(good) and {r.n for r in got} == {len(good)} and {r.component for r in got} == set(range(1, 9))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    z = c @ v / np.sqrt(e)
    want = sorted((-1 if i is None else i, dv, *np.round(np.abs(z[j]), 6)) for j, ((i, _), dv) in enumerate(zip(good, deviation, strict=True)))
    rows = {}
    for at in range(0, len(got), 8):  # the components of a row stand together
        r = got[at : at + 8]
        assert [x.component for x in r] == list(range(1, 9)) and len({(x.vec_id, x.deviation) for x in r}) == 1
        rows.setdefault(at, (-1 if r[0].vec_id is None else r[0].vec_id, r[0].deviation, *np.round(np.abs([x.whitened for x in r]), 6)))
        assert [x.explained for x in r] == pytest.approx(list(e / trace), rel=1e-9)
    for a, b in zip(sorted(rows.values()), want, strict=True):
        assert a[:2] == b[:2] and np.abs(np.array(a[2:]) - np.array(b[2:])).max() < 1e-5
    # one sign for all rows
    for k in range(8):
        mine = {(-1 if r.vec_id is None else r.vec_id, r.deviation): r.whitened for r in got if r.component == k + 1}
        sign = {np.sign(mine[-1 if i is None else i, dv] * z[j, k]) for j, ((i, _), dv) in enumerate(zip(good, deviation, strict=True)) if abs(z[j, k]) > 1e-3}
        assert len(sign) == 1


def test_merges_do_not_change_the_factor(spark, vectors):
    good, _ = vectors
    rows, d = whitening.usable(spark.createDataFrame([(i, v, 1, 2) for i, v in good], SCHEMA).repartition(30))
    n, total = whitening.sums(rows, d, "embedding")
    c = brute(good)[3]
    for fan_in in (2, 3, 16):
        r = whitening.r_factor(rows, n, total, "embedding", fan_in)
        assert np.allclose(r.T @ r, c.T @ c, rtol=1e-10, atol=1e-6) and (np.diag(r) >= 0).all() and np.allclose(r, np.triu(r))


def test_few_equal_and_no_rows(spark):
    made = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert made([]) == [] and made([(1, None, 1, 1), (2, [math.inf], 1, 1)]) == []
    one = made([(1, [0.5, 0.25], 1, 1)])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = made([(i, [float(i), 2.0 * i, 0.0], 1, 1) for i in range(5)])
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True} and line[0].identity_error < 1e-12
    assert sorted(abs(round(r.whitened, 9)) for r in line if r.component == 1) == [0, *[round(x / math.sqrt(2), 9) for x in (1, 1, 2, 2)]]


def test_large_integers_are_exact(spark):
    big = [(i, v) for i, v in enumerate([[3e5, -1e6], [-2e5, 5.5], [1e5, 3e5]])]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, 1) for r in big], SCHEMA)).collect()
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == list(enumerate(brute(big)[0]))
    x = np.array([[2**49, 1], [5 - 2**49, 2]])
    total = [sum(int(a) for a in c) for c in x.T]
    assert [[int(a) for a in r] for r in whitening.centred(x, 10**6, total)[1]] == [[10**6 * int(a) - t for a, t in zip(r, total, strict=True)] for r in x]
    with pytest.raises(Exception, match="too large to convert"):
        whitening.whiten(spark.createDataFrame([(i, [c * 1e3 for c in v], 1, 1) for i, v in big], SCHEMA)).collect()
