import numpy as np
import pytest

from tallybrook.llm import quality_rules as Q
from tallybrook.llm.common import saved

SCHEMA = "level int, lang string, source string, x array<double>"


def planted(draw, n, part):
    """n vectors of which `part` are far from the others, in one place."""
    turn = draw.normal(size=(5, 5)) * 0.3 + np.eye(5)
    x = draw.normal(size=(n, 5)) @ turn + draw.normal(size=5) * 2
    far = np.arange(n) < int(part * n)
    if far.any():
        x[far] = x[far].mean(axis=0) + 14 + 0.3 * draw.normal(size=(far.sum(), 5))
    return x, far


def estimate(x):
    cov = Q.CONSISTENCY * np.cov(x.T, bias=True) + np.diag(np.square(Q.FLOORS))
    return x.mean(axis=0), cov


def distances(x, centre, cov):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def least_determinant(x, draw, starts=60):
    """By concentration from random starts, each until it ends: log determinant of the best."""
    h, best = int(np.ceil(Q.CORE * len(x))), np.inf
    for _ in range(starts):
        inside, last = draw.choice(len(x), min(len(x), 7), replace=False), np.inf
        while True:
            centre, cov = estimate(x[inside])
            now = np.linalg.slogdet(cov)[1]
            if len(inside) >= h and now >= last - 1e-9:
                break
            last = now if len(inside) >= h else np.inf
            inside = np.argsort(distances(x, centre, cov))[:h]
        best = min(best, now)
    return best


def test_estimates_against_numpy(spark):
    draw = np.random.default_rng(3)
    groups = {name: planted(draw, n, part) for name, n, part in (("small", 12, 0.0), ("few", 40, 0.2), ("many", 400, 0.2), ("clean", 300, 0.0), ("one", 1, 0.0))}
    rows = [(2, "en", name, [float(v) for v in r]) for name, (x, _) in groups.items() for r in x]
    found = {r.source: r for r in Q.robust_estimates(saved(spark.createDataFrame(rows, SCHEMA), "points")).collect()}
    assert set(found) == set(groups)
    for name, (x, far) in groups.items():
        r = found[name]
        cov = np.zeros((5, 5))
        for v, (i, j) in zip(r["cov"], Q.TRIANGLE, strict=True):
            cov[i, j] = cov[j, i] = v
        white = np.zeros((5, 5))
        for v, (i, j) in zip(r["whiten"], Q.TRIANGLE, strict=True):
            white[i, j] = v
        assert r["n"] == len(x) and np.allclose(white @ cov @ white.T, np.eye(5), atol=1e-5)
        assert r["logdet"] == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-6)
        d = distances(x, np.asarray(r["centre"]), cov)
        if far.any():
            assert d[far].min() > 10 * d[~far].max()
        if len(x) >= 40:  # as good as the best of many random starts, but for what a bin's width lets in
            assert r["logdet"] <= least_determinant(x, draw) + 0.1
            near = np.sort(d)[: int(np.ceil(Q.CORE * len(x)))]
            centre, _ = estimate(x[d <= near[-1]])
            assert np.allclose(centre, r["centre"], atol=0.2)


def test_estimates_are_mixed_by_size(spark):
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(300, 5)), draw.normal(size=(6, 5)) + 3
    rows = [(level, lang, source, [float(v) for v in r]) for source, values in (("big", x), ("tiny", y)) for r in values for level, lang, source in ((0, "", ""), (1, "en", ""), (2, "en", source))]
    raw = Q.robust_estimates(saved(spark.createDataFrame(rows, SCHEMA), "points"))
    own = {(r.level, r.source): r for r in raw.collect()}
    mixed = {r.source: r for r in Q.mixed_estimates(raw).collect()}
    upper = np.asarray(own[1, ""]["centre"])
    weight = 306 / 356
    upper = weight * upper + (1 - weight) * np.asarray(own[0, ""]["centre"])
    for source, n in (("big", 300), ("tiny", 6)):
        w = n / (n + Q.PRIOR_ROWS)
        assert np.allclose(mixed[source]["centre"], w * np.asarray(own[2, source]["centre"]) + (1 - w) * upper, atol=1e-6)


def test_quantiles_of_bins(spark):
    draw = np.random.default_rng(8)
    values = draw.integers(0, 40, 500)
    cells = spark.createDataFrame([("a", int(b), int((values == b).sum())) for b in set(values)], "k string, bin long, n long")
    found = Q.quantiles(cells, ["k"], [0.25, 0.75]).first()
    assert (found["total"], found["p0"], found["p1"]) == (500, np.sort(values)[124], np.sort(values)[374])


def test_every_passing_row_has_a_distance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = Q.quality_rules(docs)
    assert found.where("not base_failed and distance is null").isEmpty() and found.count() == docs.count()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, Q.quality_rules(docs.repartition(7)).drop("row").join(found.select("doc_id", "row"), "doc_id").select(*found.columns).collect()), key=str)
