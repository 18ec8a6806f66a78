"""op12 against the whole covariance in plain Python and numpy."""

import math

import numpy as np
import pytest

from marlstone.llm import queries, whitening

LONG = 2**63 - 1


def plain(rows, most=4, scale=256):
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in keep), default=0)
    xs = [tuple(max(-LONG - 1, min(LONG, math.floor(scale * c))) for c in [*v, *[0.0] * (width - len(v))]) for _, v in keep]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(r[j] for r in fit) for j in range(width)]
    centred = lambda r: [n * x - s for x, s in zip(r, sums)]
    c = np.array([[u / n for u in centred(r)] for r in fit], float).reshape(n, width)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:most]
    out = {}
    for (i, _), r in zip(keep, xs):
        u = centred(r)
        for k, at in enumerate(order, 1):
            if values[at] > 1e-14 * values.sum():
                out.setdefault((i, k), []).append((n, min(LONG, sum(x * x for x in u)), abs(float(np.dot([x / n for x in u], vectors[:, at]))) / math.sqrt(values[at]), values[at] / values.sum()))
    return out


def held_against(got, want, tolerance=1e-9):
    have = {}
    for r in got:
        have.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert have.keys() == want.keys()
    for k in want:
        for (n, d, w, e), (n2, d2, w2, e2) in zip(sorted(want[k]), sorted(have[k])):
            assert (n, d) == (n2, d2) and w == pytest.approx(w2, abs=tolerance * 10, rel=tolerance) and e == pytest.approx(e2, rel=1e-4)
    assert all(0 <= r.identity_error < 1e-4 for r in got) and len({r.identity_error for r in got}) <= 1


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, x string")


def test_query_equals_whole_covariance(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    held_against(queries.op12_embedding_whitening(spark, sf_dir).collect(), plain(rows))


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_far_mean_and_few_directions(spark, offset):
    rng = np.random.default_rng(1)
    strong = rng.standard_normal((400, 5)) @ (rng.standard_normal((5, 40)) * np.array([80, 40, 20, 10, 5.0])[:, None]) + offset
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(strong)]
    rows += [(7, rows[7][1]), (-1, None), (-2, [1.0, None]), (-3, [float("nan")] * 40), (-4, [float("inf")] * 40), (None, rows[3][1])] + [(900 + i, rows[0][1]) for i in range(200)]
    df = table(spark, rows)
    held_against(whitening.whiten(df).collect(), plain(rows), 1e-7)
    fit = whitening.integer_vectors(df, 256).select("x").distinct()
    found = whitening.fit_components(fit, whitening.centre_of(fit, 40), 4)
    assert not found.full and found.passes <= whitening.PASSES  # a steep spectrum needs no whole basis


def test_flat_spectrum_expands(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((300, 40)))]
    fit = whitening.integer_vectors(table(spark, rows), 256).select("x").distinct()
    assert whitening.fit_components(fit, whitening.centre_of(fit, 40), 4).full
    held_against(whitening.whiten(table(spark, rows)).collect(), plain(rows))


def test_ranks_lengths_and_size(spark):
    short = [(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [-0.001, 0.0])]
    held_against(whitening.whiten(table(spark, short)).collect(), plain(short))
    line = [(i, [float(i), 2.0 * i, 0.0, 1.0, 1.0]) for i in range(20)]
    got = whitening.whiten(table(spark, line)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)
    huge = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)]
    held_against(whitening.whiten(table(spark, huge)).collect(), plain(huge))
    for rows in ([], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(table(spark, rows)).collect() == []
