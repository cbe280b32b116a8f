"""Zero-inflated beta regression by Fisher scoring, many models in one pass.

y = 0 with probability nu; otherwise y is beta with mean mu and precision phi, where
logit(mu), log(phi) and logit(nu) are linear in their covariates (Ospina and Ferrari 2010).
The likelihood splits into a logistic part for 1{y=0} and a beta part for y > 0. All parts of
all models of a list are searched side by side: one pass over the data gives each of them the sums
at its next point, with the log-likelihoods at shorter steps in case the full one overshoots, so the number of
passes is that of the slowest part. Factors are integer codes; a level is an index of a sum, not a column. A task
turns its rows into sums of the size of the models, Spark adds them up, and the driver solves a terms-by-terms system.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.functions.special import betainc, chi2_tail, digamma, gammaln, normal_quantile, trigamma
from panelweave.operators.models import COEF_SCHEMA, INTERCEPT
from panelweave.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_TERMS = 4_000  # of one part: its information matrix is dense on the driver, 128 MB
SHORTER = (0.5, 0.25, 0.125)


def _expit(x):
    """1 / (1 + exp(-x)), right to the last bit of small results on both sides."""
    with np.errstate(over="ignore"):
        return np.where(x >= 0, 1.0 / (1.0 + np.exp(-x)), np.exp(np.minimum(x, 0)) / (1.0 + np.exp(np.minimum(x, 0))))


class _Design:
    """Intercept, covariates and factors of one part over a batch, without a column per level.

    Terms are in order of ``columns``; the first level of a factor is its reference and has no term.
    """

    def __init__(self, data: dict[str, np.ndarray], rows: np.ndarray, columns: list[str], codes: dict[str, np.ndarray]):
        self.n, at, dense = int(rows.sum()), 1, [np.ones(int(rows.sum()))]
        self.place, self.factors = [0], []
        for c in columns:
            if c in codes:
                size = int(codes[c].max(initial=0))
                self.factors.append((at, size, codes[c][data[c][rows].astype(np.int64)] - 1))
                at += size
            else:
                dense.append(data[c][rows])
                self.place.append(at)
                at += 1
        self.size, self.dense = at, np.column_stack(dense)

    def times(self, theta):
        out = self.dense @ theta[self.place]
        for at, size, code in self.factors:
            out = out + np.append(theta[at : at + size], 0.0)[code]
        return out

    def score(self, v):
        out = np.zeros(self.size)
        out[self.place] = self.dense.T @ v
        for at, size, code in self.factors:
            out[at : at + size] = np.bincount(code[code >= 0], v[code >= 0], size)
        return out

    def cross(self, w, other: "_Design"):
        """self.T diag(w) other."""
        out = np.zeros((self.size, other.size))
        out[np.ix_(self.place, other.place)] = self.dense.T @ (w[:, None] * other.dense)
        for at, size, code in self.factors:
            own = code >= 0
            for j, k in enumerate(other.place):
                out[at : at + size, k] = np.bincount(code[own], (w * other.dense[:, j])[own], size)
            for at2, size2, code2 in other.factors:
                both = own & (code2 >= 0)
                cells = np.bincount(code[both] * size2 + code2[both], w[both], size * size2)
                out[at : at + size, at2 : at2 + size2] = cells.reshape(size, size2)
        for at, size, code in other.factors:
            own = code >= 0
            for j, k in enumerate(self.place):
                out[k, at : at + size] = np.bincount(code[own], (w * self.dense[:, j])[own], size)
        return out


def _beta_sums(y, x: _Design, z: _Design, theta, whole: bool = True):
    """Log-likelihood, score and information of the beta part for one batch."""
    beta, gamma = theta[: x.size], theta[x.size :]
    with np.errstate(all="ignore"):
        eta = x.times(beta)
        mu, rest = _expit(eta), _expit(-eta)
        phi = np.exp(z.times(gamma))
        a, b = mu * phi, rest * phi
        log_y, log_rest = np.log(y), np.log1p(-y)
        loglik = (gammaln(phi) - gammaln(a) - gammaln(b) + (a - 1) * log_y + (b - 1) * log_rest).sum()
        if not whole:
            return loglik, None, None
        slope = mu * rest
        star = log_y - log_rest - (digamma(a) - digamma(b))
        d_phi = mu * star + log_rest - digamma(b) + digamma(phi)
        ta, tb = trigamma(a), trigamma(b)
        w_mu = (phi * slope) ** 2 * (ta + tb)
        w_cross = phi * slope * (ta * mu - tb * rest) * phi
        w_phi = (ta * mu**2 + tb * rest**2 - trigamma(phi)) * phi**2
        score = np.concatenate([x.score(phi * slope * star), z.score(phi * d_phi)])
        corner = x.cross(w_cross, z)
        return loglik, score, np.block([[x.cross(w_mu, x), corner], [corner.T, z.cross(w_phi, z)]])


def _logit_sums(zero, w: _Design, delta, whole: bool = True):
    eta = w.times(delta)
    loglik = (zero * eta - np.logaddexp(0, eta)).sum()
    if not whole:
        return loglik, None, None
    nu = _expit(eta)
    return loglik, w.score(zero - nu), w.cross(nu * _expit(-eta), w)


@dataclass
class ZibModel:
    """A model of a list: response, covariates and factors of the mean, the precision and the share of zeros."""

    name: str
    y: str
    mu: list[str]
    sigma: list[str] = field(default_factory=list)
    nu: list[str] = field(default_factory=list)

    @property
    def columns(self) -> dict[str, list[str]]:
        return {"mu": list(self.mu), "sigma": list(self.sigma), "nu": list(self.nu)}

    @property
    def used(self) -> list[str]:
        return list(dict.fromkeys(c for part in self.columns.values() for c in part))


@dataclass
class _Search:
    """Where the search for one part of one model stands."""

    model: int
    zero: bool
    theta: np.ndarray
    max_iter: int
    tol: float
    loglik: float | None = None
    score: np.ndarray | None = None
    info: np.ndarray | None = None
    step: np.ndarray | None = None
    scale: float = 1.0
    last: tuple[float, float] = (np.inf, np.inf)  # gain and length of the last accepted step
    iterations: int = 0
    done: bool = False

    def points(self) -> list[tuple[np.ndarray, bool]]:
        """(parameters, whether score and information are needed) of the next pass."""
        if self.loglik is None:
            return [(self.theta, True)]
        if self.score is None:  # a shorter step was taken; its sums are still to come
            return [(self.theta, True)]
        return [(self.theta + self.scale * self.step, True), *[(self.theta + self.scale * s * self.step, False) for s in SHORTER]]

    def _newton(self) -> None:
        gain, length = self.last
        if self.iterations and gain <= self.tol * (abs(self.loglik) + self.tol) and length < 1e-7 or self.iterations >= self.max_iter:
            self.done = True
            return
        self.step, self.scale = _invert(self.info) @ self.score, 1.0
        self.iterations += 1

    def take(self, found: list[tuple[float, np.ndarray | None, np.ndarray | None]]) -> None:
        if self.loglik is None or self.score is None:
            self.loglik, self.score, self.info = found[0]
            self._newton()
            return
        for (loglik, score, info), share in zip(found, (1.0, *SHORTER)):
            fine = np.isfinite(loglik) and loglik >= self.loglik - 1e-12 * abs(self.loglik)
            if share == 1.0:
                fine = fine and np.all(np.isfinite(score)) and np.all(np.isfinite(info))
            if fine:
                self.last = loglik - self.loglik, float(np.max(np.abs(self.scale * share * self.step)))
                self.theta = self.theta + self.scale * share * self.step
                self.loglik, self.score, self.info = loglik, score, info
                if score is not None:
                    self._newton()
                return
        self.scale *= SHORTER[-1] / 2
        if self.scale < 1e-8:
            self.done = True

    @property
    def converged(self) -> bool:
        """The last full step would gain next to nothing, and no direction is flat (a separated part has no finite maximum)."""
        if self.score is None or not np.all(np.isfinite(self.info)):
            return False
        gain = float(self.score @ _invert(self.info) @ self.score)
        flat = np.linalg.matrix_rank(self.info, hermitian=True, tol=1e-10 * np.abs(self.info).max()) < len(self.theta)
        return bool(np.isfinite(gain) and gain <= 1e-8 * (1 + abs(self.loglik)) and not flat)


def _invert(info: np.ndarray) -> np.ndarray:
    """Inverse; the generalised one where a flat direction (say, a level without zeros) leaves none."""
    try:
        return np.linalg.inv(info)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(info)


def _pass(frame: DataFrame, models: list[ZibModel], codes: list[dict[str, np.ndarray]], searches: list[_Search]) -> None:
    """One pass over the frame for all searches that go on."""
    asked = [(k, s.model, s.zero, s.points()) for k, s in enumerate(searches) if not s.done]

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            data = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            known: dict[tuple, _Design] = {}
            for k, m, zero, points in asked:
                model, y = models[m], data[models[m].y]
                rows = ~np.isnan(y)
                for c in model.used:
                    rows &= data[c] >= 0 if c in codes[m] else ~np.isnan(data[c])
                if not zero:
                    rows &= y > 0

                def design(part: str) -> _Design:
                    columns = model.columns[part]
                    key = (m, zero, tuple(columns))
                    if key not in known:
                        known[key] = _Design(data, rows, columns, codes[m])
                    return known[key]

                for i, (theta, whole) in enumerate(points):
                    if zero:
                        loglik, score, info = _logit_sums((y[rows] == 0).astype(float), design("nu"), theta, whole)
                    else:
                        loglik, score, info = _beta_sums(y[rows], design("mu"), design("sigma"), theta, whole)
                    flat = np.array([loglik]) if score is None else np.concatenate([[loglik], score, info[np.triu_indices(len(score))]])
                    total[k, i] = flat if (k, i) not in total else total[k, i] + flat
        for (k, i), flat in total.items():
            at = np.flatnonzero(flat != 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(flat[at])], names=["k", "i", "at", "v"])

    sums = frame.mapInArrow(run, "k int, i int, at long, v double").groupBy("k", "i", "at").agg(F.sum("v").alias("v")).toArrow()
    k, i, at, v = (sums[c].to_numpy() for c in ("k", "i", "at", "v"))
    for number, _, _, points in asked:
        found = []
        for j, (theta, whole) in enumerate(points):
            p, mine = len(theta), (k == number) & (i == j)
            flat = np.zeros(1 + p + p * (p + 1) // 2 if whole else 1)
            flat[at[mine]] = v[mine]
            if not whole:
                found.append((flat[0], None, None))
                continue
            info = np.zeros((p, p))
            info[np.triu_indices(p)] = flat[1 + p :]
            found.append((flat[0], flat[1 : 1 + p], np.triu(info) + np.triu(info, 1).T))
        searches[number].take(found)


@dataclass
class ZibFit:
    model: str
    response: str
    terms: dict[str, list[str]]
    columns: dict[str, list[str]]
    levels: dict[str, list[str]]
    coef: dict[str, np.ndarray]
    cov: dict[str, np.ndarray]
    loglik: float
    n: int
    n_zero: int
    converged: bool = True
    iterations: int = 0

    @property
    def n_parameters(self) -> int:
        return sum(len(t) for t in self.terms.values())

    def table(self, spark: SparkSession, z: float = 1.96) -> DataFrame:
        """Coefficients of the three parts; Wald interval and normal p-value."""
        rows = []
        for part in ("mu", "sigma", "nu"):
            se = np.sqrt(np.diag(self.cov[part]))
            for name, b, s in zip(self.terms[part], self.coef[part], se):
                b, s = float(b), float(s)
                p = chi2_tail((b / s) ** 2, 1.0) if s > 0 else None
                rows.append((part, self.model, name, b, s, b / s if s > 0 else None, p, b - z * s, b + z * s))
        return spark.createDataFrame(rows, "part string, " + COEF_SCHEMA)

    def summary(self, spark: SparkSession) -> DataFrame:
        k = self.n_parameters
        return spark.createDataFrame(
            [(self.model, self.n, self.n_zero, k, float(self.loglik), 2 * k - 2 * float(self.loglik), self.converged, self.iterations)],
            "model string, n long, n_zero long, n_parameters int, loglik double, aic double, converged boolean, iterations int",
        )


def zib_models(df: DataFrame, models: list[ZibModel], factors: list[str] | None = None, max_iter: int = 100, tol: float = 1e-10) -> list[ZibFit]:
    """Fit every model on its own complete rows; every response must lie in [0, 1).

    The frame is read a fixed number of times for counts and levels and once for each step of the slowest part.
    """
    used = list(dict.fromkeys(c for m in models for c in m.used))
    responses = list(dict.fromkeys(m.y for m in models))
    factors = [f for f in factors or [] if f in used]
    if set(responses) & set(factors):
        raise ValueError("a response can't be a factor")
    numbers = list(dict.fromkeys([*responses, *[c for c in used if c not in factors]]))
    # written once so that every pass reads evenly packed files, then kept in memory where it fits
    frame = stage(df.select(*[F.col(c).cast("double").alias(c) for c in numbers], *[F.col(f).cast("string").alias(f) for f in factors]), "model")

    def complete(m: ZibModel):
        out = F.col(m.y).isNotNull()
        for c in m.used:
            out = out & F.col(c).isNotNull()
        return out

    names: dict[str, list[str]] = {}
    own: list[dict[str, list[str]]] = [{} for _ in models]
    for f in factors:
        seen = frame.filter(F.col(f).isNotNull()).groupBy(f).agg(*[F.bool_or(complete(m)).alias(f"m{i}") for i, m in enumerate(models)])
        rows = sorted(seen.limit(MAX_TERMS + 1).collect(), key=lambda r: r[f])
        if len(rows) > MAX_TERMS:
            raise ValueError(f"{f} has more than {MAX_TERMS} levels; the terms-by-terms matrix of a part is dense")
        names[f] = [r[f] for r in rows]
        for i, m in enumerate(models):
            if f in m.used:
                own[i][f] = [r[f] for r in rows if r[f"m{i}"]]
    stats = frame.agg(*[a.alias(f"{n}{i}") for i, m in enumerate(models) for ok, y in [(complete(m), F.col(m.y))] for n, a in (
        ("n", F.count_if(ok)), ("lo", F.min(F.when(ok, y))), ("hi", F.max(F.when(ok, y))), ("zeros", F.count_if(ok & (y == 0))),
        ("m", F.avg(F.when(ok & (y > 0), y))), ("v", F.var_samp(F.when(ok & (y > 0), y))))],
        *[a.alias(f"{n}_{i}") for i, c in enumerate(numbers) for n, a in (("c", F.avg(c)), ("s", F.stddev_pop(c)))]).first()
    for i, m in enumerate(models):
        if not stats[f"n{i}"] or stats[f"lo{i}"] < 0 or stats[f"hi{i}"] >= 1:
            raise ValueError(f"{m.y} must have values in [0, 1)")
    # standardise covariates for the search and map the coefficients back afterwards
    scaled = [c for c in numbers if c in used]
    if set(scaled) & set(responses):
        raise ValueError("a response can't be a covariate")
    center = {c: stats[f"c_{numbers.index(c)}"] for c in scaled}
    scale = {c: stats[f"s_{numbers.index(c)}"] or 1.0 for c in scaled}
    coded = {f: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for k, x in enumerate(names[f]) for v in (x, k)]), F.col(f)), F.lit(-1)) if names[f] else F.lit(-1) for f in factors}
    ready = frame.select(
        *[F.col(y) for y in responses], *[((F.col(c) - center[c]) / scale[c]).alias(c) for c in scaled], *[coded[f].cast("int").alias(f) for f in factors])
    ready = stage(ready, "coded").persist(StorageLevel.MEMORY_AND_DISK)
    # code in the frame -> 0 for the reference level, else the place of its term; levels without a complete row have none
    codes = [{f: np.array([levels.index(x) if x in levels else 0 for x in names[f]], dtype=np.int64) for f, levels in own[i].items()} for i in range(len(models))]
    terms = [{
        part: [INTERCEPT, *[t for c in cols for t in ([f"{c}={v}" for v in own[i][c][1:]] if c in factors else [c])]]
        for part, cols in m.columns.items()
    } for i, m in enumerate(models)]
    searches, beta_of, zero_of = [], {}, {}
    for i, m in enumerate(models):
        p, q, r = (len(terms[i][k]) for k in ("mu", "sigma", "nu"))
        if max(p + q, r) > MAX_TERMS:
            raise ValueError(f"{m.name} has more than {MAX_TERMS} terms in a part; its information matrix is dense")
        start, mean, var = np.zeros(p + q), stats[f"m{i}"], stats[f"v{i}"] or 0.01
        if mean is not None:
            start[0] = np.log(mean / (1 - mean))
            start[p] = np.log(max(mean * (1 - mean) / var - 1, 0.1))
            beta_of[i] = len(searches)
            searches.append(_Search(i, False, start, max_iter, tol))
        share = stats[f"zeros{i}"] / stats[f"n{i}"]
        if 0 < share < 1:
            first = np.zeros(r)
            first[0] = np.log(share / (1 - share))
            zero_of[i] = len(searches)
            searches.append(_Search(i, True, first, max_iter, tol))
    try:
        while not all(s.done for s in searches):
            _pass(ready, models, codes, searches)
    finally:
        ready.unpersist()
    fits = []
    for i, m in enumerate(models):
        p, q, r = (len(terms[i][k]) for k in ("mu", "sigma", "nu"))
        share = stats[f"zeros{i}"] / stats[f"n{i}"]
        parts = [searches[of[i]] for of in (beta_of, zero_of) if i in of]
        theta, cov = np.full(p + q, np.nan), np.full((p + q, p + q), np.nan)
        if i in beta_of:
            s = searches[beta_of[i]]
            theta, cov = s.theta, _invert(s.info) if s.info is not None else cov
        delta, cov0 = np.zeros(r), np.zeros((r, r))
        if i in zero_of:
            s = searches[zero_of[i]]
            delta, cov0 = s.theta, _invert(s.info) if s.info is not None else np.full((r, r), np.nan)
        else:
            delta[0] = -np.inf if share == 0 else np.inf
        raw_coef = {"mu": theta[:p], "sigma": theta[p:], "nu": delta}
        raw_cov = {"mu": cov[:p, :p], "sigma": cov[p:, p:], "nu": cov0}
        coef, covs = {}, {}
        for part in raw_coef:
            back = np.eye(len(terms[i][part]))
            for k, t in enumerate(terms[i][part]):
                if t in center:
                    back[k, k] = 1 / scale[t]
                    back[0, k] = -center[t] / scale[t]
            coef[part] = back @ raw_coef[part] if np.all(np.isfinite(raw_coef[part])) else raw_coef[part]
            covs[part] = back @ raw_cov[part] @ back.T
        fits.append(ZibFit(
            m.name, m.y, terms[i], m.columns, own[i], coef, covs, float(sum(s.loglik for s in parts)), int(stats[f"n{i}"]), int(stats[f"zeros{i}"]),
            all(s.converged for s in parts), max((s.iterations for s in parts), default=0),
        ))
    return fits


def zib_regression(
    df: DataFrame, y: str, mu: list[str], sigma: list[str] | None = None, nu: list[str] | None = None,
    factors: list[str] | None = None, model: str = "zib", max_iter: int = 100, tol: float = 1e-10,
) -> ZibFit:
    """Fit one model on the complete rows; every response must lie in [0, 1)."""
    return zib_models(df, [ZibModel(model, y, mu, sigma or [], nu or [])], factors, max_iter, tol)[0]


def lr_test(reduced: ZibFit, full: ZibFit, spark: SparkSession) -> DataFrame:
    """Likelihood-ratio test of nested fits on the same rows."""
    if reduced.n != full.n:
        raise ValueError("both models must be fitted on the same rows")
    if not (reduced.converged and full.converged):
        raise ValueError("a likelihood-ratio test needs converged fits; see converged in their summaries")
    stat = 2 * (full.loglik - reduced.loglik)
    df = full.n_parameters - reduced.n_parameters
    return spark.createDataFrame(
        [(reduced.model, full.model, float(stat), df, chi2_tail(stat, df))],
        "reduced string, full string, statistic double, df int, p_value double",
    )


def lr_table(spark: SparkSession, pairs: list[tuple[ZibFit, ZibFit]]) -> DataFrame:
    """Likelihood-ratio tests of (reduced, full) pairs; NULL where the rows differ or a fit has not converged."""
    rows = []
    for reduced, full in pairs:
        usable = reduced.n == full.n and reduced.converged and full.converged and full.n_parameters > reduced.n_parameters
        stat = 2 * (full.loglik - reduced.loglik) if usable else None
        df = full.n_parameters - reduced.n_parameters
        rows.append((reduced.model, full.model, stat, df, chi2_tail(stat, df) if usable else None, bool(usable)))
    return spark.createDataFrame(rows, "reduced string, full string, statistic double, df int, p_value double, usable boolean")


def effects_side_by_side(spark: SparkSession, fits: dict[str, ZibFit], part: str = "mu") -> DataFrame:
    """(term, level, effect, lo and hi per scenario): exp of the coefficients, each factor with its reference level as 1."""
    names = list(fits)
    out = None
    for name, fit in fits.items():
        firsts = {f: levels[0] for f, levels in fit.levels.items() if f in fit.columns[part] and levels}
        one = effect_table(fit.table(spark).filter(F.col("part") == part), firsts).select(
            "term", "level", F.col("odds_ratio").alias("effect"), "lo", "hi", F.lit(name).alias("scenario"))
        out = one if out is None else out.unionByName(one)
    at = {n: F.max(F.when(F.col("scenario") == n, F.struct("effect", "lo", "hi"))) for n in names}
    wide = out.groupBy("term", "level").agg(*[a.alias(n) for n, a in at.items()])
    return wide.select("term", "level", *[F.col(f"`{n}`.{c}").alias(f"{c}_{n}") for n in names for c in ("effect", "lo", "hi")])


def effect_table(coefficients: DataFrame, factors: dict[str, str] | None = None) -> DataFrame:
    """exp(estimate) with its interval, factor terms split into factor and level.

    ``factors`` maps a factor to its reference level, which is added with effect 1. The
    effect acts on the odds of the mean.
    """
    factors = factors or {}
    rows = coefficients.filter(F.col("term") != INTERCEPT)
    is_factor = F.col("term").contains("=")
    out = rows.select(
        "model",
        F.when(is_factor, F.substring_index("term", "=", 1)).otherwise(F.col("term")).alias("term"),
        F.when(is_factor, F.expr("substring(term, locate('=', term) + 1)")).alias("level"),
        F.exp("estimate").alias("odds_ratio"), F.exp("lo").alias("lo"), F.exp("hi").alias("hi"),
    )
    for name, level in factors.items():
        ones = coefficients.select("model").distinct().select(
            "model", F.lit(name).alias("term"), F.lit(level).alias("level"),
            F.lit(1.0).alias("odds_ratio"), F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"),
        )
        out = out.unionByName(ones)
    return out


def model_summary(spark: SparkSession, *fits) -> DataFrame:
    """Coefficient tables of several fits in one long table with a ``model`` column."""
    out = fits[0].table(spark)
    for fit in fits[1:]:
        out = out.unionByName(fit.table(spark), allowMissingColumns=True)
    return out


def quantile_residuals(df: DataFrame, fit: ZibFit, key: str) -> DataFrame:
    """z-score residual per row: normal quantile of the fitted distribution function.

    At zeros the function jumps, so a uniform point of the jump is taken; it is derived
    from a hash of the key and is the same on every run. Rows with a level that the fit has not seen are left out.
    """
    used = list(dict.fromkeys(c for part in fit.columns.values() for c in part))
    hashed = (F.pmod(F.xxhash64(F.col(key)), F.lit(2**40)).cast("double") + 0.5) / float(2**40)
    places = {f: F.try_element_at(F.create_map(*[F.lit(v) for k, x in enumerate(levels) for v in (x, k)]), F.col(f).cast("string")) for f, levels in fit.levels.items()}
    frame = df.select(F.col(key).alias("_key"), F.col(fit.response).cast("double").alias("_y"), hashed.alias("_u"), *[
        places[c].cast("int").alias(c) if c in places else F.col(c).cast("double").alias(c) for c in used
    ]).dropna()
    coef, columns = fit.coef, fit.columns
    codes = {f: np.arange(len(levels)) for f, levels in fit.levels.items()}

    def run(batches):
        for batch in batches:
            data = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "_key"}
            y, u, rows = data["_y"], data["_u"], np.ones(len(batch), dtype=bool)
            eta = {part: _Design(data, rows, columns[part], codes).times(coef[part]) for part in coef}
            mu, phi, nu = _expit(eta["mu"]), np.exp(eta["sigma"]), _expit(eta["nu"])
            below = betainc(mu * phi, _expit(-eta["mu"]) * phi, y)
            prob = np.where(y > 0, nu + (1 - nu) * below, u * nu)
            z = normal_quantile(np.clip(prob, 1e-15, 1 - 1e-15))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(prob), pa.array(z)], names=[key, "probability", "residual"])

    key_type = df.schema[key].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {key_type}, probability double, residual double")


def normal_qq(residuals: DataFrame, key: str, value: str = "residual") -> DataFrame:
    """Residuals in order against normal quantiles at the usual plotting positions."""
    from panelweave.operators.ranks import row_positions

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return pd.Series(normal_quantile(p.to_numpy()))

    placed = row_positions(residuals.select(key, value), [value, key])
    a = F.when(F.col("total") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    point = (F.col("position") - a) / (F.col("total") + 1 - 2 * a)
    return placed.select(key, value, "position", quantile(point).alias("theoretical"))
