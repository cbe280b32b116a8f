"""Gap filling of monthly series, and annualising of part-year totals."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def month_cells(df: DataFrame, unit: list[str], period: str, month: str, value: str, months: int = 12) -> DataFrame:
    """(unit, period, cells): one array of ``months`` sums per unit and period.

    Absent months are NULL. The grid comes out of one partial aggregate, no spine join.
    """
    sums = [F.sum(F.when(F.col(month) == m, F.col(value))) for m in range(1, months + 1)]
    return df.filter(F.col(value).isNotNull()).groupBy(*unit, period).agg(F.array(*sums).alias("cells"))


def month_grid(df: DataFrame, unit: list[str], period: str, month: str, value: str, months: int = 12) -> DataFrame:
    """Long form of the completed grid: every month of each observed (unit, period)."""
    cells = month_cells(df, unit, period, month, value, months)
    rows = cells.select(*unit, period, F.posexplode("cells").alias("_i", value))
    return rows.select(*unit, period, (F.col("_i") + 1).alias(month), value)


def min_observations(df: DataFrame, unit: list[str], value: str, more_than: int) -> DataFrame:
    """Units with more than ``more_than`` observed cells."""
    n = F.count(value).over(W.partitionBy(*unit))
    return df.withColumn("n_obs", n).filter(F.col("n_obs") > more_than)


def fill_linear(
    df: DataFrame, unit: list[str], period: str, month: str, value: str, min_obs: int = 3, months: int = 12
) -> DataFrame:
    """Monthly table with a ``filled`` column: linear inside the observed span, edge values held.

    The windows run over one unit's month grid, whose length is bounded by its periods.
    """
    t = F.col(period) * months + F.col(month)
    rows = month_grid(df, unit, period, month, value, months).withColumn("_t", t)
    rows = min_observations(rows, unit, value, min_obs)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("_t").alias("t"), F.col(value).alias("x")))
    order = W.partitionBy(*unit).orderBy("_t")
    back = F.last(seen, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(seen, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("_a", back).withColumn("_b", ahead)
    slope = F.try_divide(F.col("_b.x") - F.col("_a.x"), F.col("_b.t") - F.col("_a.t"))
    between = F.col("_a.x") + slope * (F.col("_t") - F.col("_a.t"))
    return rows.withColumn("filled", F.coalesce(value, between, "_a.x", "_b.x")).drop("_a", "_b", "_t")


def _tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solutions of one tridiagonal system per row, by a forward and a backward sweep over the columns."""
    n = mid.shape[1]
    c, d = np.zeros_like(mid), np.zeros_like(mid)
    c[:, 0], d[:, 0] = up[:, 0] / mid[:, 0], rhs[:, 0] / mid[:, 0]
    for j in range(1, n):
        pivot = mid[:, j] - low[:, j] * c[:, j - 1]
        c[:, j] = up[:, j] / pivot
        d[:, j] = (rhs[:, j] - low[:, j] * d[:, j - 1]) / pivot
    for j in range(n - 2, -1, -1):
        d[:, j] -= c[:, j] * d[:, j + 1]
    return d


def spline_batch(row: np.ndarray, t: np.ndarray, x: np.ndarray, at_row: np.ndarray, at: np.ndarray, rows: int, ends: str = "cubic") -> np.ndarray:
    """Cubic splines through the points (t, x) of each of ``rows`` curves, at the places ``at`` of their curves.

    Points are sorted by curve and t, every curve has one at least. ``ends="cubic"`` gives the outer intervals the third derivative of the
    cubic through the four outer points; ``ends="natural"`` sets the second derivative at the ends to 0. Beyond the ends the outer cubic is
    continued; a curve of one point is constant. All curves are solved together, in sweeps of the length of the longest.
    """
    count = np.bincount(row, minlength=rows)
    n, first = int(count.max(initial=1)), np.cumsum(count) - count
    place = np.arange(len(row)) - first[row]
    times, values = np.zeros((rows, n)), np.zeros((rows, n))
    times[row, place], values[row, place] = t, x
    real = np.arange(n - 1) < (count - 1)[:, None]  # intervals that exist
    h = np.where(real, np.diff(times, axis=1), 1.0)
    d = np.where(real, np.diff(values, axis=1) / h, 0.0)
    low, up, rhs = np.zeros((rows, n)), np.zeros((rows, n)), np.zeros((rows, n))
    mid = np.ones((rows, n))
    if n > 2:
        inner = real[:, 1:]  # points 1, 2, ... with an interval on both sides
        low[:, 1:-1], up[:, 1:-1] = np.where(inner, h[:, :-1], 0.0), np.where(inner, h[:, 1:], 0.0)
        mid[:, 1:-1] = np.where(inner, 2 * (h[:, :-1] + h[:, 1:]), 1.0)
        rhs[:, 1:-1] = np.where(inner, 6 * (d[:, 1:] - d[:, :-1]), 0.0)
    if ends == "cubic":
        some = np.flatnonzero(count > 2)
        last = count[some] - 1
        mid[some, 0], up[some, 0], low[some, last] = -1.0, 1.0, -1.0
        full = np.flatnonzero(count > 3)
        if len(full):
            end = count[full] - 1

            def third(k):
                """Third divided difference of the four points from k on."""
                span = lambda i, j: times[full, k + j] - times[full, k + i]
                one, two = (d[full, k + 1] - d[full, k]) / span(0, 2), (d[full, k + 2] - d[full, k + 1]) / span(1, 3)
                return (two - one) / span(0, 3)

            rhs[full, 0] = 6 * h[full, 0] * third(np.zeros(len(full), np.int64))
            rhs[full, end] = 6 * h[full, end - 1] * third(end - 3)
    m = _tridiagonal(low, mid, up, rhs)
    # the interval of a place, by one search over all curves laid end to end
    low_t, reach = min(t.min(initial=0), at.min(initial=0)), 1.0 + max(t.max(initial=0), at.max(initial=0))
    width = reach - low_t
    found = np.searchsorted(row * width + (t - low_t), at_row * width + (at - low_t), side="right") - 1 - first[at_row]
    k = np.clip(found, 0, np.maximum(count[at_row] - 2, 0))
    r, nxt = at_row, np.minimum(k + 1, n - 1)
    step = h[r, np.minimum(k, n - 2)] if n > 1 else np.ones(len(at))
    u, v = at - times[r, k], times[r, nxt] - at
    curve = (
        (m[r, k] * v**3 + m[r, nxt] * u**3) / (6 * step)
        + (values[r, k] / step - m[r, k] * step / 6) * v
        + (values[r, nxt] / step - m[r, nxt] * step / 6) * u
    )
    return np.where(count[at_row] > 1, curve, values[r, 0])


def spline_values(t: np.ndarray, x: np.ndarray, at: np.ndarray, ends: str = "cubic") -> np.ndarray:
    """One cubic spline through the points (t, x), at the places ``at``."""
    none = np.zeros(len(t), np.int64)
    return spline_batch(none, np.asarray(t, float), np.asarray(x, float), np.zeros(len(at), np.int64), np.asarray(at, float), 1, ends)


def _spline_filler(ends: str, stretch: bool):
    def fill(times: pa.Array, values: pa.Array) -> pa.Array:
        rows = len(times)
        size = np.asarray(pc.list_value_length(times).to_numpy(zero_copy_only=False), dtype=np.int64)
        t, x = (np.asarray(a.flatten().to_numpy(zero_copy_only=False), dtype=float) for a in (times, values))
        row, seen = np.repeat(np.arange(rows), size), ~np.isnan(x)
        at = t
        if stretch:
            whole = np.flatnonzero(seen)
            lo, hi = np.full(rows, np.inf), np.full(rows, -np.inf)
            np.minimum.at(lo, row[whole], t[whole])
            np.maximum.at(hi, row[whole], t[whole])
            place = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
            at = lo[row] + (hi - lo)[row] * place / np.maximum(size - 1, 1)[row]
        filled = np.where(seen, x, spline_batch(row[seen], t[seen], x[seen], row, at, rows, ends)) if len(t) else t
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(filled))

    fill.__annotations__ = {"times": pa.Array, "values": pa.Array, "return": pa.Array}
    return F.arrow_udf(fill, "array<double>")


def fill_spline(
    df: DataFrame, unit: list[str], period: str, month: str, value: str, min_obs: int = 3, months: int = 12,
    ends: str = "cubic", stretch: bool = False,
) -> DataFrame:
    """Monthly table with a ``filled`` column from a cubic spline per unit.

    One array row per unit goes to the task, at most ``months`` times its periods long.
    ``stretch`` evaluates on evenly spaced points over the observed span instead of at
    the months; the two agree where the first and last month are observed.
    """
    cells = month_cells(df, unit, period, month, value, months)
    packed = cells.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct(period, "cells"))).alias("_p"))
    values = F.flatten(F.transform("_p", lambda p: p["cells"]))
    times = F.flatten(F.transform("_p", lambda p: F.transform(
        F.sequence(F.lit(1), F.lit(months)), lambda m: (p[period] * months + m).cast("double")
    )))
    packed = packed.withColumn("_x", values).withColumn("n_obs", F.size(F.filter("_x", lambda v: v.isNotNull())))
    packed = packed.filter(F.col("n_obs") > min_obs).withColumn("_t", times)
    packed = packed.withColumn("_f", _spline_filler(ends, stretch)("_t", "_x"))
    rows = packed.select(*unit, "n_obs", F.explode(F.arrays_zip("_t", "_x", "_f")).alias("_r"))
    index = F.col("_r._t").cast("int") - 1
    return rows.select(
        *unit, F.floor(index / months).cast("int").alias(period), (index % months + 1).alias(month),
        F.col("_r._x").alias(value), "n_obs", F.col("_r._f").alias("filled"),
    )


def impute_monthly(
    df: DataFrame, unit: list[str], period: str, month: str, value: str, method: str = "linear", **options
) -> tuple[DataFrame, DataFrame]:
    """(totals per unit and period, filled monthly table)."""
    fill = {"linear": fill_linear, "spline": fill_spline}[method]
    monthly = fill(df, unit, period, month, value, **options)
    return monthly.groupBy(*unit, period).agg(F.sum("filled").alias(value)), monthly


def annualise(df: DataFrame, unit: list[str], month: str, value: str, months: int = 12) -> DataFrame:
    """Total scaled from the observed months to a full period; a NULL value counts as 0."""
    per_month = df.groupBy(*unit, month).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("_v"))
    return per_month.groupBy(*unit).agg(
        (F.sum("_v") * months / F.count(F.lit(1))).alias(value), F.count(F.lit(1)).alias("n_month")
    )
