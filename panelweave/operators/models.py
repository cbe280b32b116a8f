"""Least squares, correlation, association and group contrasts.

The data side is one aggregate of means and co-moments and, with factors, one aggregate over grouping sets:
sums per level and counts per pair of levels, which are the non-zero cells of the normal equations. Combinations of more
levels are never formed; only matrices of the size of the model (terms by terms) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.functions.special import chi2_tail, f_tail, t_tail
from panelweave.operators.ranks import distribution
from panelweave.operators.shape import to_long

MAX_TERMS = 4_000  # the normal equations are dense on the driver, 128 MB
ALIASED = 1e-10  # share of a term's sum of squares that earlier terms must leave
COEF_SCHEMA = (
    "model string, term string, estimate double, se double, statistic double, p_value double, lo double, hi double"
)
INTERCEPT = "(intercept)"


def _moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sums of products around the means): one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]]
    aggs += [F.covar_pop(a, b).alias(f"v{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    one, q = df.agg(*aggs).first(), len(columns)
    if not one["n"]:
        raise ValueError("no complete rows to fit")
    cross = np.array([[one[f"v{min(i, j)}_{max(i, j)}"] for j in range(q)] for i in range(q)], dtype=float)
    return one["n"], np.array([one[f"m{i}"] for i in range(q)]), cross * one["n"]


def _level_sums(df: DataFrame, columns: list[str], factors: list[str]) -> list:
    """Rows of (factor levels or NULL, _sets, n, s0, s1, ...): per level the sums of the columns, per pair of levels the count."""
    sets = [[f] for f in factors] + [[f, g] for i, f in enumerate(factors) for g in factors[i + 1:]]
    grouped = df.groupingSets([[F.col(f"`{f}`") for f in part] for part in sets], *[F.col(f"`{f}`") for f in factors])
    alone = F.grouping_id(*[F.col(f"`{f}`") for f in factors]).alias("_sets")
    return grouped.agg(alone, F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).collect()


def _independent(gram: np.ndarray) -> np.ndarray:
    """Which columns are not a combination of the ones before them, by Cholesky steps in order."""
    left, size = gram.astype(float).copy(), np.diag(gram).copy()
    keep = np.zeros(len(gram), dtype=bool)
    for j in range(len(gram)):
        if size[j] > 0 and left[j, j] > ALIASED * size[j]:
            keep[j] = True
            left[j + 1:, j + 1:] -= np.outer(left[j + 1:, j], left[j, j + 1:]) / left[j, j]
    return keep


@dataclass
class LinearFit:
    """A least-squares fit: coefficients by term and what inference needs."""

    model: str
    response: str
    covariates: list[str]
    levels: dict[str, list[str]]
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    rss: float
    tss: float
    n: int
    correlation: np.ndarray = field(repr=False, default=None)
    aliased: list[str] = field(default_factory=list)  # terms that earlier terms explain; they have no estimate

    @property
    def df_residual(self) -> int:
        return self.n - len(self.terms) + len(self.aliased)

    def table(self, spark: SparkSession, z: float = 1.96, reference_level: bool = False) -> DataFrame:
        """Coefficient table; optionally with the reference levels as zero rows."""
        se = np.sqrt(np.diag(self.cov))
        rows = []
        for name, b, s in zip(self.terms, self.beta, se):
            if name in self.aliased:
                rows.append((self.model, name, *[None] * 6))
                continue
            t = float(b / s) if s > 0 else None
            p = t_tail(t, self.df_residual) if t is not None else None
            rows.append((self.model, name, float(b), float(s), t, p, float(b - z * s), float(b + z * s)))
        if reference_level:
            rows += [(self.model, f"{f}={v[0]}", 0.0, 0.0, None, None, 0.0, 0.0) for f, v in self.levels.items()]
        return spark.createDataFrame(rows, COEF_SCHEMA)

    def summary(self, spark: SparkSession) -> DataFrame:
        k = len(self.terms) - len(self.aliased) - 1
        r2 = 1 - self.rss / self.tss
        f = (r2 / k) / ((1 - r2) / self.df_residual) if k and r2 < 1 else None
        return spark.createDataFrame(
            [(self.model, self.n, self.df_residual, float(r2), float(np.sqrt(self.rss / self.df_residual)),
              float(f) if f is not None else None, f_tail(f, k, self.df_residual) if f is not None else None)],
            "model string, n long, df_residual long, r2 double, sigma double, f_statistic double, f_p_value double",
        )

    def score(self) -> Column:
        """The fitted value as a column expression, factor effects as a literal lookup."""
        coef = {t: 0.0 if t in self.aliased else b for t, b in zip(self.terms, self.beta)}
        out = F.lit(float(coef[INTERCEPT]))
        for c in self.covariates:
            out = out + F.lit(float(coef[c])) * F.col(c)
        for f, levels in self.levels.items():
            effect = F.create_map(*[F.lit(v) for x in levels for v in (x, float(coef.get(f"{f}={x}", 0.0)))])
            out = out + F.try_element_at(effect, F.col(f).cast("string"))
        return out


def ols(
    df: DataFrame, y: str, xs: list[str], factors: list[str] | None = None, model: str = "ols"
) -> LinearFit:
    """Least squares of ``y`` on covariates and dummy-coded factors.

    Levels are sorted and the first is the reference. Rows with a NULL are left out. Terms that are combinations of
    earlier ones are named in ``aliased`` and have no estimate.
    """
    factors = factors or []
    columns = [*xs, y]
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *[F.col(f).cast("string").alias(f) for f in factors]).dropna()
    total, center, cross = _moments(clean, columns)
    q = len(columns)
    scale = np.sqrt(np.diag(cross) / total)
    scale[scale == 0] = 1.0
    ready = clean.select(*[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(columns, center, scale)], *factors)
    cells = _level_sums(ready, columns, factors) if factors else []
    # bit i of the grouping id, from the left, is 1 where factor i is not in the set
    having = {r["_sets"]: [f for i, f in enumerate(factors) if not r["_sets"] >> (len(factors) - 1 - i) & 1] for r in cells}
    levels = {f: sorted({r[f] for r in cells if having[r["_sets"]] == [f]}) for f in factors}
    dummies = [(f, v) for f in factors for v in levels[f][1:]]
    # intercept, scaled covariates, dummies, response last
    p = q + len(dummies)
    if p > MAX_TERMS:
        raise ValueError(f"{p} terms; the normal equations are dense and hold {MAX_TERMS} at most")
    place = {d: q + i for i, d in enumerate(dummies)}
    gram = np.zeros((p + 1, p + 1))
    numbers = [*range(1, q), p]
    gram[0, 0] = total
    gram[np.ix_(numbers, numbers)] = cross / np.outer(scale, scale)
    for r in cells:
        at = [place.get((f, r[f])) for f in having[r["_sets"]]]
        if None in at:
            continue
        if len(at) == 1:
            d = at[0]
            gram[d, d] = gram[0, d] = gram[d, 0] = r["n"]
            gram[numbers, d] = gram[d, numbers] = [r[f"s{i}"] for i in range(q)]
        else:
            gram[at[0], at[1]] = gram[at[1], at[0]] = r["n"]
    xtx, xty, yty = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    keep = _independent(xtx)
    kept = np.flatnonzero(keep)
    rank = len(kept)
    inverse = np.full((p, p), np.nan)
    inverse[np.ix_(kept, kept)] = np.linalg.inv(xtx[np.ix_(kept, kept)])
    beta = np.zeros(p)
    beta[kept] = inverse[np.ix_(kept, kept)] @ xty[kept]
    rss = max(float(yty - beta @ xty), 0.0)
    cov = inverse * (rss / (total - rank)) if total > rank else np.full((p, p), np.nan)
    # undo scaling and centring
    back = np.eye(p)
    back[1:q, 1:q] = np.diag(1 / scale[:-1])
    back[0, 1:q] = -center[:-1] / scale[:-1]
    used = np.ix_(kept, kept)
    cov[used] = back[used] @ cov[used] @ back[used].T * scale[-1] ** 2
    beta = back @ beta * scale[-1]
    beta[0] += center[-1]
    beta[~keep] = np.nan
    rest = kept[1:]
    spread = xtx[np.ix_(rest, rest)] - np.outer(xtx[0, rest], xtx[0, rest]) / total
    root = np.sqrt(np.diag(spread))
    terms = [INTERCEPT, *xs, *[f"{f}={v}" for f, v in dummies]]
    return LinearFit(
        model, y, list(xs), levels, terms, beta, cov, rss * scale[-1] ** 2, float(yty - gram[0, -1] ** 2 / total) * scale[-1] ** 2,
        int(total), spread / np.outer(root, root), [t for t, k in zip(terms, keep) if not k],
    )


def vif(fit: LinearFit, spark: SparkSession) -> DataFrame:
    """Generalised variance inflation per term, from determinants of the term correlations; aliased terms are left out."""
    names = [t for t in fit.terms[1:] if t not in fit.aliased]
    blocks = [(c, [i for i, t in enumerate(names) if t == c]) for c in fit.covariates]
    blocks += [(f, [i for i, t in enumerate(names) if t.startswith(f"{f}=")]) for f in fit.levels]
    whole = np.linalg.slogdet(fit.correlation)[1]
    rows = []
    for name, idx in [b for b in blocks if b[1]]:
        rest = [i for i in range(len(names)) if i not in idx]
        a = np.linalg.slogdet(fit.correlation[np.ix_(idx, idx)])[1]
        b = np.linalg.slogdet(fit.correlation[np.ix_(rest, rest)])[1] if rest else 0.0
        value = float(np.exp(a + b - whole))
        rows.append((name, len(idx), value, value ** (1 / (2 * len(idx)))))
    return spark.createDataFrame(rows, "term string, df int, gvif double, gvif_root double")


def ols_simple(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Straight line per group, all from built-in aggregates."""
    paired = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
    )
    rss = F.greatest(F.col("_syy") - F.try_divide(F.pow("_sxy", F.lit(2.0)), F.col("_sxx")), F.lit(0.0))
    sigma2 = F.try_divide(rss, F.col("n") - 2)
    return fit.withColumn("slope_se", F.sqrt(F.try_divide(sigma2, F.col("_sxx")))).drop("_sxx", "_syy", "_sxy")


def ols_factor(df: DataFrame, y: str, factor: str) -> DataFrame:
    """Group means and their contrast with the first level; se as in the one-factor model."""
    per = df.filter(F.col(y).isNotNull() & F.col(factor).isNotNull()).groupBy(factor).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("_v")
    )
    whole = per.agg(
        F.struct(
            F.min_by("mean", factor).alias("m0"), F.min_by("n", factor).alias("n0"), F.min(factor).alias("f0"),
            F.try_divide(F.sum(F.col("n") * F.col("_v")), F.sum("n") - F.count(F.lit(1))).alias("s2"),
        ).alias("w")
    ).scalar()
    first = F.col(factor) == F.col("_w.f0")
    se = F.sqrt(F.col("_w.s2") * (1 / F.col("n") + 1 / F.col("_w.n0")))
    return per.withColumn("_w", whole).select(
        factor, "n", "mean", (F.col("mean") - F.col("_w.m0")).alias("estimate"),
        F.when(first, F.lit(0.0)).otherwise(se).alias("se"),
    )


def glm_gaussian(df: DataFrame, y: str, xs: list[str], factors: list[str] | None = None) -> DataFrame:
    """The same design through the generalised linear model of Spark ML."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    factors = factors or []
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in [y, *xs]], *factors).dropna()
    # the encoder drops the last index, so descending order makes the first level the reference
    stages = [StringIndexer(inputCol=f, outputCol=f"_i_{f}", stringOrderType="alphabetDesc") for f in factors]
    stages += [OneHotEncoder(inputCol=f"_i_{f}", outputCol=f"_v_{f}", dropLast=True) for f in factors]
    stages += [
        VectorAssembler(inputCols=[*xs, *[f"_v_{f}" for f in factors]], outputCol="_features"),
        GeneralizedLinearRegression(family="gaussian", link="identity", featuresCol="_features", labelCol=y),
    ]
    fitted = Pipeline(stages=stages).fit(clean)
    model = fitted.stages[-1]
    names = list(xs)
    for i, f in enumerate(factors):
        names += [f"{f}={v}" for v in fitted.stages[i].labels[:-1]]
    s = model.summary
    rows = [
        ("glm", t, float(b), float(se), float(z), float(p), float(b - 1.96 * se), float(b + 1.96 * se))
        for t, b, se, z, p in zip(
            [*names, INTERCEPT], [*model.coefficients, model.intercept],
            s.coefficientStandardErrors, s.tValues, s.pValues,
        )
    ]
    return df.sparkSession.createDataFrame(rows, COEF_SCHEMA)


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, one aggregate pass, long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = []
    for k, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"c{k}").alias("r")))
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def chisq_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, df, n) of the independence test, one row; only non-empty cells are visited."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    joined = cells.join(rows, a).join(cols, b)
    share = F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))
    # each margin is counted once by weighting its cells with o / margin
    stat = joined.agg(
        F.sum("o").alias("n"), F.sum(share).alias("s"),
        F.round(F.sum(F.col("o") / F.col("ra"))).alias("r"), F.round(F.sum(F.col("o") / F.col("cb"))).alias("c"),
    )
    return stat.select(
        (F.col("n") * (F.col("s") - 1)).alias("statistic"),
        ((F.col("r") - 1) * (F.col("c") - 1)).cast("long").alias("df"), "n",
    )


def chisq_test(df: DataFrame, a: str, b: str) -> DataFrame:
    row = chisq_counts(df, a, b).first()
    p = chi2_tail(row["statistic"], row["df"])
    return df.sparkSession.createDataFrame(
        [(row["statistic"], row["df"], row["n"], p)], "statistic double, df long, n long, p_value double"
    )


def cohens_d(df: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """(mean in - mean out) / pooled sd per column, from one grouped aggregate."""
    long = to_long(df.select(flag, *[F.col(c).cast("double").alias(c) for c in columns]), [flag], columns)

    def side(fn, on: bool):
        return fn(F.when(F.col(flag) == F.lit(on), F.col("value")))

    stats = long.filter("value IS NOT NULL").groupBy("name").agg(
        side(F.count, True).alias("n_in"), side(F.count, False).alias("n_out"),
        side(F.avg, True).alias("_m1"), side(F.avg, False).alias("_m0"),
        side(F.var_samp, True).alias("_v1"), side(F.var_samp, False).alias("_v0"),
    )
    pooled = F.sqrt(F.try_divide(
        (F.col("n_in") - 1) * F.col("_v1") + (F.col("n_out") - 1) * F.col("_v0"), F.col("n_in") + F.col("n_out") - 2
    ))
    return stats.select("name", "n_in", "n_out", F.try_divide(F.col("_m1") - F.col("_m0"), pooled).alias("d"))


def group_compare(df: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """Distribution of each column inside and outside the flagged group."""
    long = to_long(df.select(flag, *[F.col(c).cast("double").alias(c) for c in columns]), [flag], columns)
    return distribution(long, "value", ["name", flag])
