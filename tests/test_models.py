"""Models against numpy brute force and seeded recovery."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import special as SP
from panelweave.operators import describe as D, models as M, zib as Z


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 600
    x1, x2 = rng.normal(2016, 2, n), rng.normal(0, 1, n)
    g = rng.choice(["a", "b", "c"], n)
    y = 3 + 0.5 * (x1 - 2016) - 2 * x2 + np.select([g == "b", g == "c"], [1.0, -1.0], 0.0) + rng.normal(0, 0.3, n)
    rows = [(int(i), float(a), float(b), str(k), float(v)) for i, (a, b, k, v) in enumerate(zip(x1, x2, g, y))]
    return spark.createDataFrame(rows, "id int, x1 double, x2 double, g string, y double"), (x1, x2, g, y)


def test_ols_against_normal_equations(spark, sample):
    df, (x1, x2, g, y) = sample
    x = np.column_stack([np.ones(len(y)), x1, x2, g == "b", g == "c"]).astype(float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = ((y - x @ beta) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / (len(y) - 5))
    fit = M.ols(df, "y", ["x1", "x2"], ["g"])
    assert fit.terms == ["(intercept)", "x1", "x2", "g=b", "g=c"]
    assert fit.beta == pytest.approx(beta, rel=1e-6)
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(se, rel=1e-5)
    assert fit.summary(spark).first().r2 == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
    scored = df.select("id", fit.score().alias("f")).orderBy("id").collect()
    assert [r.f for r in scored] == pytest.approx(x @ beta)


def test_two_factors(spark, sample):
    df, (x1, x2, g, y) = sample
    df = df.withColumn("h", (df.id % 2).cast("string"))
    h = (np.arange(len(y)) % 2).astype(float)
    x = np.column_stack([np.ones(len(y)), x2, g == "b", g == "c", h]).astype(float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert M.ols(df, "y", ["x2"], ["g", "h"]).beta == pytest.approx(beta, abs=1e-9)


def test_vif_against_auxiliary_regression(spark, sample):
    df, (x1, x2, g, _) = sample
    z = np.column_stack([np.ones(len(x1)), x2, g == "b", g == "c"]).astype(float)
    r = x1 - z @ np.linalg.lstsq(z, x1, rcond=None)[0]
    got = {row.term: row.gvif for row in M.vif(M.ols(df, "y", ["x1", "x2"], ["g"]), spark).collect()}
    assert got["x1"] == pytest.approx(((x1 - x1.mean()) ** 2).sum() / (r**2).sum())
    assert set(got) == {"x1", "x2", "g"}


def test_too_many_levels_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_LIMIT", 3)
    df = spark.range(10).selectExpr("cast(id as string) f", "cast(id as double) y")
    with pytest.raises(ValueError, match="combinations"):
        M.ols(df, "y", [], ["f"])


def test_special_functions():
    x = np.array([0.05, 0.7, 3.0, 41.0])
    assert SP.gammaln(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-11)
    e = 1e-5
    assert SP.digamma(x[1:]) == pytest.approx([(math.lgamma(v + e) - math.lgamma(v - e)) / (2 * e) for v in x[1:]], abs=1e-6)
    assert SP.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert SP.betainc(2.0, 3.0, 0.4)[0] == pytest.approx(0.5248)
    assert SP.betainc(0.5, 0.5, [0.0, 0.25, 1.0]) == pytest.approx([0, 1 / 3, 1])
    assert SP.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert SP.chi2_tail(0.0, 2) == 1
    assert SP.t_tail(2.228138851964939, 10) == pytest.approx(0.05)


@pytest.fixture(scope="module")
def zib(spark):
    rng = np.random.default_rng(11)
    n = 6000
    x, g = rng.normal(10, 2, n), rng.choice(["p", "q"], n)
    mu = 1 / (1 + np.exp(-(-1 + 0.3 * (x - 10) + 0.5 * (g == "q"))))
    phi = np.exp(2.0 + 0.2 * (x - 10))
    nu = 1 / (1 + np.exp(-(-1.5 + 0.4 * (x - 10))))
    y = np.where(rng.random(n) < nu, 0.0, np.clip(rng.beta(mu * phi, (1 - mu) * phi), 1e-9, 1 - 1e-9))
    rows = [(int(i), float(a), str(b), float(c)) for i, (a, b, c) in enumerate(zip(x, g, y))]
    return spark.createDataFrame(rows, "id int, x double, g string, y double").repartition(4)


def test_zib_recovers_parameters(spark, zib):
    fit = Z.zib_regression(zib, "y", ["x", "g"], ["x"], ["x"], ["g"])
    want = {"mu": [-4.0, 0.3, 0.5], "sigma": [0.0, 0.2], "nu": [-5.5, 0.4]}
    for part, truth in want.items():
        se = np.sqrt(np.diag(fit.cov[part]))
        assert np.all(np.abs(fit.coef[part] - truth) < 4 * se), (part, fit.coef[part], se)
    assert fit.n == 6000 and fit.n_zero == zib.filter("y = 0").count()
    table = fit.table(spark)
    assert table.count() == 7 and table.filter("lo < estimate AND estimate < hi").count() == 7


def test_zib_is_a_maximum(spark, zib):
    """The likelihood written out in plain numpy falls when a coefficient moves."""
    fit = Z.zib_regression(zib, "y", ["x"], [], [])
    rows = [(r.x, r.y) for r in zib.collect()]
    x, y = np.array(rows).T

    def loglik(b0, b1, s, d):
        mu, phi, nu = 1 / (1 + np.exp(-(b0 + b1 * x))), np.exp(s), 1 / (1 + np.exp(-d))
        lg = np.vectorize(math.lgamma)
        pos = y > 0
        a, b = (mu * phi)[pos], ((1 - mu) * phi)[pos]
        dens = math.lgamma(phi) - lg(a) - lg(b) + (a - 1) * np.log(y[pos]) + (b - 1) * np.log1p(-y[pos])
        return dens.sum() + pos.sum() * math.log(1 - nu) + (~pos).sum() * math.log(nu)

    at = [*fit.coef["mu"], *fit.coef["sigma"], *fit.coef["nu"]]
    best = loglik(*at)
    assert best == pytest.approx(fit.loglik, rel=1e-8)
    for i in range(4):
        for step in (-1e-3, 1e-3):
            moved = list(at)
            moved[i] += step
            assert loglik(*moved) < best


def test_lr_test_and_effects(spark, zib):
    full = Z.zib_regression(zib, "y", ["x", "g"], factors=["g"], model="full")
    small = Z.zib_regression(zib, "y", ["x"], factors=["g"], model="small")
    test = Z.lr_test(small, full, spark).first()
    assert test.df == 1 and test.statistic > 50 and test.p_value < 1e-6
    effects = Z.effect_table(full.table(spark).filter("part = 'mu'"), {"g": "p"})
    got = {(r.term, r.level): r.odds_ratio for r in effects.collect()}
    assert set(got) == {("x", None), ("g", "q"), ("g", "p")} and got["g", "p"] == 1.0
    assert got["g", "q"] == pytest.approx(math.exp(full.coef["mu"][2]))


def test_zib_without_zeros_and_out_of_range(spark, zib):
    fit = Z.zib_regression(zib.filter("y > 0"), "y", ["x"])
    assert fit.n_zero == 0 and fit.coef["nu"][0] == -np.inf
    with pytest.raises(ValueError, match="values in"):
        Z.zib_regression(spark.createDataFrame([(1.0,), (0.5,)], "y double"), "y", [])


def test_residuals_are_standard_normal(spark, zib):
    fit = Z.zib_regression(zib, "y", ["x", "g"], ["x"], ["x"], ["g"])
    res = Z.quantile_residuals(zib, fit, "id")
    z = np.array([r.residual for r in res.collect()])
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05
    qq = Z.normal_qq(res, "id").collect()
    assert np.corrcoef([r.residual for r in qq], [r.theoretical for r in qq])[0, 1] > 0.998


def test_kde_integrates_to_one(spark, zib):
    curve = D.kde_1d(zib.filter("y > 0"), "x", ["g"], points=200).orderBy("g", "point").collect()
    for g in "pq":
        pts = [(r.x, r.density) for r in curve if r.g == g]
        xs, ds = np.array(pts).T
        assert np.trapezoid(ds, xs) == pytest.approx(1, abs=0.01)


def test_beta_fit_says_whether_it_converged(spark):
    rows = [(i, ((i * 37) % 89 + 1) / 100.0 if i % 5 else 0.0, float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, y double, x double")
    whole = Z.zib_regression(df, "y", ["x"], nu=["x"])
    assert whole.converged and whole.summary(spark).first().converged
    short = Z.zib_regression(df, "y", ["x"], nu=["x"], max_iter=1)
    assert not short.converged and short.iterations == 1
    with pytest.raises(ValueError, match="converged"):
        Z.lr_test(short, whole, spark)
    apart = Z.zib_regression(spark.createDataFrame([(k, 0.0 if x < 3 else max(y, 0.1), x) for k, y, x in rows], df.schema), "y", [], nu=["x"], max_iter=12)
    assert not apart.converged


def plain_loglik(y, x, z, w, beta, gamma, delta):
    """Zero-inflated beta log-likelihood with full design columns."""
    lg = np.vectorize(math.lgamma)
    mu, phi, eta = 1 / (1 + np.exp(-(x @ beta))), np.exp(z @ gamma), w @ delta
    pos = y > 0
    a, b, f = (mu * phi)[pos], ((1 - mu) * phi)[pos], phi[pos]
    dens = lg(f) - lg(a) - lg(b) + (a - 1) * np.log(y[pos]) + (b - 1) * np.log1p(-y[pos])
    return dens.sum() + ((y == 0) * eta - np.logaddexp(0, eta)).sum()


def test_many_models_in_one_search_are_each_a_maximum(spark, zib, monkeypatch):
    """Full, reduced, factor only, varying parts and a second response with gaps: passes are those of the slowest, each fit is its own maximum."""
    passes, one = [], Z._pass
    monkeypatch.setattr(Z, "_pass", lambda *a: (passes.append(1), one(*a)))
    rows = zib.withColumns({
        "y2": F.when(F.col("id") % 7 != 0, F.col("y") * 0.9), "x2": F.when(F.col("id") % 11 != 0, (F.col("id") % 13).cast("double")),
        "k": F.concat(F.lit("k"), F.col("id") % 4)})
    models = [
        Z.ZibModel("full", "y", ["x", "x2", "g", "k"]), Z.ZibModel("no factor", "y", ["x", "x2"]), Z.ZibModel("only k", "y", ["k"]),
        Z.ZibModel("varying", "y", ["x", "g"], ["x", "k"], ["x", "g"]), Z.ZibModel("second", "y2", ["x", "k"]),
    ]
    fits = Z.zib_models(rows, models, ["g", "k"])
    assert all(f.converged for f in fits) and len(passes) <= max(f.iterations for f in fits) + 2
    data = rows.collect()
    for m, f in zip(models, fits):
        whole = [r for r in data if all(r[c] is not None for c in [m.y, *m.used])]
        y = np.array([r[m.y] for r in whole])

        def design(part):
            cells = [[1.0] * len(whole)]
            for t in f.terms[part][1:]:
                name, _, level = t.partition("=")
                cells.append([float(r[name] == level) if level else r[name] for r in whole])
            return np.array(cells).T

        x, z, w = (design(p) for p in ("mu", "sigma", "nu"))
        at = [f.coef[p] for p in ("mu", "sigma", "nu")]
        best = plain_loglik(y, x, z, w, *at)
        assert (f.n, f.n_zero) == (len(y), (y == 0).sum()) and best == pytest.approx(f.loglik, rel=1e-9)
        for k in range(3):
            for i in range(len(at[k])):
                for side in (-1, 1):
                    moved = [v.copy() for v in at]
                    moved[k][i] += side * 0.02 * math.sqrt(f.cov[("mu", "sigma", "nu")[k]][i, i])
                    assert plain_loglik(y, x, z, w, *moved) < best
    table = Z.lr_table(spark, [(fits[1], fits[0]), (fits[4], fits[0])]).collect()
    assert (table[0].df, table[0].usable, table[1].usable, table[1].statistic) == (4, True, False, None)
    assert table[0].statistic == pytest.approx(2 * (fits[0].loglik - fits[1].loglik))
    wide = {(r.term, r.level): r for r in Z.effects_side_by_side(spark, {"a": fits[0], "b": fits[2]}).collect()}
    assert wide["k", "k0"].effect_a == wide["k", "k0"].effect_b == 1 and wide["x", None].effect_b is None
    assert wide["k", "k2"].effect_a == pytest.approx(math.exp(fits[0].coef["mu"][fits[0].terms["mu"].index("k=k2")]))


def test_extreme_predictors_are_not_clipped(spark):
    """A zero share of e^-40 has its own likelihood; a bound of 30 on the predictor would hide it."""
    w = Z._Design({"x": np.array([0.0, 1.0])}, np.array([True, True]), ["x"], {})
    loglik, score, info = Z._logit_sums(np.array([1.0, 0.0]), w, np.array([-40.0, -10.0]))
    assert loglik == pytest.approx(-40.0 - math.exp(-50), rel=1e-12) and score[0] == pytest.approx(1.0) and info[0, 0] == pytest.approx(math.exp(-40), rel=1e-6)
    assert Z._expit(np.array([-700.0, 700.0])) == pytest.approx([math.exp(-700), 1.0])


def test_normal_quantile_and_erfc():
    from statistics import NormalDist

    p = np.concatenate([np.logspace(-15, -1, 300), np.linspace(0.1, 0.9, 101), 1 - np.logspace(-12, -1, 100)])
    assert SP.normal_quantile(p) == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-9, abs=1e-9)
    x = np.linspace(-5, 25, 400)
    assert SP.erfc(x) == pytest.approx([math.erfc(v) for v in x], rel=1e-9)


def test_three_factors_without_their_combinations(spark):
    """31,000 combinations of levels occur; only levels and pairs of levels are summed. Compared with a dense least-squares fit."""
    n = 40_000
    rows = spark.range(n).select(
        (F.xxhash64("id") % 40).cast("string").alias("a"), (F.xxhash64("id", F.lit(1)) % 35).cast("string").alias("b"),
        (F.xxhash64("id", F.lit(2)) % 23).cast("string").alias("c"), (F.xxhash64("id", F.lit(3)) % 1000 / 100).alias("x"),
        (F.xxhash64("id", F.lit(4)) % 777 / 50).alias("e")).withColumn("y", 3 + 0.5 * F.col("x") + F.col("a").cast("int") / 10 + F.col("e"))
    assert rows.select("a", "b", "c").distinct().count() > 31_000
    fit = M.ols(rows, "y", ["x"], ["a", "b", "c"])
    data = rows.toPandas()
    cells = [np.ones(n), data.x] + [(data[f] == v).astype(float) for f in "abc" for v in sorted(data[f].unique())[1:]]
    dense = np.column_stack(cells)
    beta, rss, *_ = np.linalg.lstsq(dense, data.y, rcond=None)
    assert fit.beta == pytest.approx(beta, abs=1e-8) and fit.rss == pytest.approx(rss[0]) and not fit.aliased
    se = np.sqrt(np.diag(np.linalg.inv(dense.T @ dense)) * rss[0] / (n - dense.shape[1]))
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(se)


def test_collinear_terms_are_named(spark):
    rows = [(float(i % 7), float(i % 7) * 2 + 1, "pq"[i % 2], "st"[i % 2], float(i % 5), 1.5) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, x2 double, g string, h string, y double, one double")
    fit = M.ols(df, "y", ["x", "x2", "one"], ["g", "h"])
    assert fit.aliased == ["x2", "one", "h=t"]
    small = M.ols(df, "y", ["x"], ["g"])
    same = [i for i, t in enumerate(fit.terms) if t in small.terms]
    assert fit.beta[same] == pytest.approx(small.beta) and fit.rss == pytest.approx(small.rss) and fit.df_residual == small.df_residual
    table = {r.term: r for r in fit.table(spark).collect()}
    assert table["x2"].estimate is None and table["x"].se == pytest.approx(float(np.sqrt(small.cov[1, 1])))
    assert {r.term for r in M.vif(fit, spark).collect()} == {"x", "g"}
    fitted = df.select((fit.score() - small.score()).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert fitted == pytest.approx(0, abs=1e-9)


def test_level_lines_follow_the_density(spark):
    """Round hill off the grid: every end of a line lies at the level's radius and is shared by two pieces; a saddle has two pieces."""
    n = 41
    rows = [(i, j, i / 20 - 1.0, j / 20 - 1.0, math.exp(-2 * ((i / 20 - 1.0131) ** 2 + (j / 20 - 0.9917) ** 2))) for i in range(n) for j in range(n)]
    grid = spark.createDataFrame(rows, "px int, py int, x double, y double, density double")
    levels = {r.mass: r.level for r in D.mass_levels(grid, [0.2, 0.5]).collect()}
    z = np.sort([r[4] for r in rows])[::-1]
    for mass, level in levels.items():
        k = int(np.searchsorted(np.cumsum(z), mass * z.sum()))
        assert z[k] > level > z[k + 1]
    lines = D.iso_lines(grid, D.mass_levels(grid, [0.2, 0.5])).collect()
    for mass, level in levels.items():
        ends = [p for r in lines if r.mass == mass for p in ((round(r.x0, 9), round(r.y0, 9)), (round(r.x1, 9), round(r.y1, 9)))]
        assert all(math.hypot(p[0] - 0.0131, p[1] + 0.0083) == pytest.approx(math.sqrt(-math.log(level) / 2), abs=2e-3) for p in ends)
        assert {ends.count(p) for p in ends} == {2}
    saddle = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (1, 0, 1.0, 0.0, 0.0), (1, 1, 1.0, 1.0, 1.0), (0, 1, 0.0, 1.0, 0.0)], grid.schema)
    for level, want in ((0.4, {((0.6, 0.0), (1.0, 0.4)), ((0.4, 1.0), (0.0, 0.6))}), (0.6, {((0.0, 0.4), (0.4, 0.0)), ((1.0, 0.6), (0.6, 1.0))})):
        got = D.iso_lines(saddle, spark.createDataFrame([(0.5, level)], "mass double, level double")).collect()
        assert {((round(r.x0, 9), round(r.y0, 9)), (round(r.x1, 9), round(r.y1, 9))) for r in got} == want
