"""The set of regressions on the regression frame: seven covariates and the province, three scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelweave.operators import models as M, zib as Z
from panelweave.plans import reports as R
from panelweave.session import stage
from workload.registry import query, rd, rounded
from workload.scenarios import FRAME_SQL, regression_inputs

RAW = ["p_risk", "tot", "discount", "tax", "burden", "lines", "wealth"]
SCALED = [f"{c}_s" for c in RAW]
# lines stands where the reference drops a covariate that another one explains
KEPT_RAW, KEPT = [c for c in RAW if c != "lines"], [c for c in SCALED if c != "lines_s"]
SCENARIOS = {"pop": "coverage_pop", "a": "coverage_a", "b": "coverage_b"}


def wide_frame(spark, sf):
    """The regression frame with all covariates; a stage table, since every pass of the models reads it."""
    out = R.regression_frame(*regression_inputs(spark, sf, ["wealth", "discount", "tax", "lines"]), 1998, ("province", 3), ["003"])
    return stage(out.select("unit", "province", *SCENARIOS.values(), *RAW, *SCALED), "frame")


def model_list() -> list[Z.ZibModel]:
    y = SCENARIOS["pop"]
    models = [
        Z.ZibModel("full", y, [*SCALED, "province"]), Z.ZibModel("full raw", y, [*RAW, "province"]),
        Z.ZibModel("reduced", y, [*KEPT, "province"]), Z.ZibModel("reduced raw", y, [*KEPT_RAW, "province"]),
        Z.ZibModel("no province", y, SCALED),
    ]
    models += [Z.ZibModel(f"only {c}", y, [c]) for c in [*SCALED, "province"]]
    models += [Z.ZibModel(f"scenario {s}", SCENARIOS[s], [*SCALED, "province"]) for s in ("a", "b")]
    varying = ["tax_s", "wealth_s"]
    return [*models, Z.ZibModel("varying precision and zeros", y, [*SCALED, "province"], varying, varying)]


def _fits(spark, sf) -> dict[str, Z.ZibFit]:
    # the family has no mass at 1
    inside = [(F.col(y) < 1) & (F.col(y) >= 0) for y in SCENARIOS.values()]
    rows = wide_frame(spark, sf).filter(reduce(lambda a, b: a & b, inside))
    models = model_list()
    return {m.name: f for m, f in zip(models, Z.zib_models(rows, models, ["province"], max_iter=30))}


@query("zib_model_set")
def zib_model_set(spark, sf):
    """Full, reduced, without province, univariate, other scenarios, varying precision and zeros: one search for all."""
    fits = _fits(spark, sf).values()
    facts = reduce(lambda a, b: a.unionByName(b), [f.summary(spark) for f in fits])
    table = Z.model_summary(spark, *fits)
    return rounded(table.join(facts.select("model", "n", "n_zero", "n_parameters", "loglik", "aic", "converged"), "model"), 4)


@query("zib_model_tests")
def zib_model_tests(spark, sf):
    f = _fits(spark, sf)
    pairs = [("reduced", "full"), ("no province", "full"), ("full", "varying precision and zeros")]
    return rounded(Z.lr_table(spark, [(f[a], f[b]) for a, b in pairs]), 4)


@query("zib_scenario_effects")
def zib_scenario_effects(spark, sf):
    f = _fits(spark, sf)
    return rounded(Z.effects_side_by_side(spark, {"pop": f["full"], "a": f["scenario a"], "b": f["scenario b"]}), 4)


WIDE_SQL = FRAME_SQL.replace("stddev_samp(tax) OVER () AS tax_s FROM v_cov_x", "stddev_samp(tax) OVER () AS tax_s, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}_s" for c in ("discount", "lines")) + " FROM v_cov_x").replace(
    "wealth, tax, wealth_s, tax_s,", "wealth, tax, discount, lines, wealth_s, tax_s, discount_s, lines_s,")


def _corr_sql(columns: list[str]) -> str:
    return f"WITH {WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rd(f'corr({a}, {b})')} AS r FROM frame" for a in columns for b in columns)


@query("corr_matrix_raw", _corr_sql(RAW))
def corr_matrix_raw(spark, sf):
    return rounded(M.corr_matrix(wide_frame(spark, sf), RAW))


@query("corr_matrix_scaled", _corr_sql(SCALED))
def corr_matrix_scaled(spark, sf):
    return rounded(M.corr_matrix(wide_frame(spark, sf), SCALED))
