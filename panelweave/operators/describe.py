"""Tables behind box plots, histograms, densities and category counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.operators.ranks import distribution, row_positions, value_ranks
from panelweave.operators.shape import grid


def _on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Attach one row per group, NULL groups included."""
    renamed = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return left.join(renamed, match).drop(*[f"_by_{c}" for c in by])


def boxplot(df: DataFrame, value: str, by: list[str], reach: float = 1.5) -> DataFrame:
    """Hinges, median and whiskers: the outermost values within ``reach`` hinge widths."""
    ranks = value_ranks(df, value, by)
    hinges = distribution(df, value, by, ranks=ranks).select(*by, "n", "q1", "median", "q3")
    inside = _on(ranks.select(*by, value), hinges, by)
    width = reach * (F.col("q3") - F.col("q1"))
    return inside.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col(value) >= F.col("q1") - width, F.col(value))).alias("whisker_low"),
        F.max(F.when(F.col(value) <= F.col("q3") + width, F.col(value))).alias("whisker_high"),
    )


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal bins over the whole range, centred on the extremes; empty bins count 0."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.greatest((F.col("_e.hi") - F.col("_e.lo")) / (bins - 1), F.lit(1e-300))
    ends = ends.select(F.struct("lo", "hi").alias("e")).scalar()
    placed = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_e", ends)
        .withColumn("bin", F.floor((F.col(value) - F.col("_e.lo")) / width + 0.5).cast("int"))
    )
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    cells = grid(counts.select(*by).distinct(), bin=list(range(bins)))
    found = counts.select(*[F.col(c).alias(f"_{c}_of") for c in by], F.col("bin").alias("_bin"), "n")
    match = F.col("bin") == F.col("_bin")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}_of"))
    full = cells.join(found, match, "left")
    return (
        full.withColumn("_e", ends)
        .select(
            *by, "bin",
            (F.col("_e.lo") + (F.col("bin") - 0.5) * width).alias("low"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        )
    )


def _spread():
    """Normal-reference spread with the usual fallbacks for a zero inter-quartile range."""
    robust = F.least("sd", (F.col("q3") - F.col("q1")) / 1.34)
    return F.when(robust > 0, robust).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))


def _split_weight(position, n):
    """Linear binning: a value counts to its two neighbouring grid points by distance."""
    low = F.floor(position)
    return F.array(
        F.struct(low.cast("int").alias("i"), (n * (1 - (position - low))).alias("c")),
        F.struct((low + 1).cast("int").alias("i"), (n * (position - low)).alias("c")),
    )


def _smooth(cells, points: int, step, h):
    """Gaussian sums at every grid point over at most ``points`` occupied cells."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda k: F.aggregate(
            cells,
            F.lit(0.0),
            lambda acc, s: acc + s["c"] * F.exp(-F.pow((k - s["i"]) * step / h, F.lit(2.0)) / 2),
        ),
    )


def kde_1d(
    df: DataFrame, value: str, by: list[str], adjust: float = 1.0, points: int = 512, cut: float = 3.0
) -> DataFrame:
    """Gaussian density on ``points`` grid points per group.

    The data are read once into a binned count; smoothing then works on at most
    ``points`` cells per group, whatever the number of rows.
    """
    ranks = value_ranks(df, value, by)
    stats = distribution(df, value, by, ranks=ranks)
    h = adjust * 0.9 * _spread() * F.pow(F.col("n"), F.lit(-0.2))
    stats = (
        stats.withColumn("h", h)
        .withColumn("lo", F.col("min") - cut * F.col("h"))
        .withColumn("step", (F.col("max") - F.col("min") + 2 * cut * F.col("h")) / (points - 1))
        .select(*by, F.col("n").alias("rows"), "h", "lo", "step")
    )
    cells = _on(ranks.select(*by, value, "n"), stats, by).withColumn(
        "_cell", F.explode(_split_weight((F.col(value) - F.col("lo")) / F.col("step"), F.col("n")))
    )
    keys = [*by, "rows", "h", "lo", "step"]
    binned = cells.groupBy(*keys, F.col("_cell.i").alias("i")).agg(F.sum("_cell.c").alias("c"))
    packed = binned.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("_cells"))
    curve = packed.select(
        *keys, F.posexplode(_smooth(F.col("_cells"), points, F.col("step"), F.col("h"))).alias("point", "_sum")
    )
    return curve.select(
        *by, "point",
        (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        (F.col("_sum") / (F.col("rows") * F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("density"),
    )


def kde_2d(df: DataFrame, x: str, y: str, points: int = 100, adjust: float = 1.0) -> DataFrame:
    """Gaussian density of (x, y) on a ``points`` by ``points`` grid over the data range.

    Rows are binned to the grid in one aggregate; the kernel is then applied along x
    and along y, each time over at most ``points`` cells of one grid line.
    """
    clean = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    axis = {}
    for c in ("_x", "_y"):
        s = distribution(clean, c).withColumn("h", adjust * 1.06 * _spread() * F.pow(F.col("n"), F.lit(-0.2)))
        axis[c] = s.select(
            F.struct(
                F.col("min").alias("lo"), F.col("n").alias("n"), F.col("h").alias("h"),
                F.greatest((F.col("max") - F.col("min")) / (points - 1), F.lit(1e-300)).alias("step"),
            ).alias("s")
        ).scalar()
    placed = clean.withColumn("_sx", axis["_x"]).withColumn("_sy", axis["_y"])
    px = (F.col("_x") - F.col("_sx.lo")) / F.col("_sx.step")
    py = (F.col("_y") - F.col("_sy.lo")) / F.col("_sy.step")
    cells = (
        placed.select(F.explode(_split_weight(px, F.lit(1.0))).alias("a"), _split_weight(py, F.lit(1.0)).alias("bs"))
        .select("a", F.explode("bs").alias("b"))
        .groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j"))
        .agg(F.sum(F.col("a.c") * F.col("b.c")).alias("c"))
    )
    along_x = (
        cells.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("_cells"))
        .withColumn("_sx", axis["_x"])
        .withColumn("_step", F.col("_sx.step")).withColumn("_h", F.col("_sx.h"))
        .select("j", F.posexplode(_smooth(F.col("_cells"), points, F.col("_step"), F.col("_h"))).alias("px", "c"))
    )
    along_y = (
        along_x.groupBy("px")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("j").alias("i"), "c"))).alias("_cells"))
        .withColumn("_sx", axis["_x"]).withColumn("_sy", axis["_y"])
        .withColumn("_step", F.col("_sy.step")).withColumn("_h", F.col("_sy.h"))
        .select(
            "px", "_sx", "_sy",
            F.posexplode(_smooth(F.col("_cells"), points, F.col("_step"), F.col("_h"))).alias("py", "_sum"),
        )
    )
    norm = F.col("_sx.n") * F.col("_sx.h") * F.col("_sy.h") * (2 * 3.141592653589793)
    return along_y.select(
        "px", "py",
        (F.col("_sx.lo") + F.col("px") * F.col("_sx.step")).alias("x"),
        (F.col("_sy.lo") + F.col("py") * F.col("_sy.step")).alias("y"),
        (F.col("_sum") / norm).alias("density"),
    )


def mass_levels(density: DataFrame, masses: list[float]) -> DataFrame:
    """(mass, level): the density above which the densest grid cells hold that share of the whole; between two densities that occur.

    ``density`` is a grid as ``kde_2d`` gives it, so its size is that of the grid whatever the data.
    """
    cells = density.groupBy("density").agg((F.col("density") * F.count(F.lit(1))).alias("part"))
    down = W.orderBy(F.desc("density"))
    ranked = cells.select(
        "density", F.sum("part").over(down.rowsBetween(W.unboundedPreceding, 0)).alias("held"), F.lead("density").over(down).alias("next"),
        F.sum("part").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("whole"))
    asked = ranked.withColumn("mass", F.explode(F.array(*[F.lit(float(m)) for m in masses]))).filter(F.col("held") >= F.col("mass") * F.col("whole"))
    return asked.groupBy("mass").agg(F.max_by(F.struct("density", "next"), "density").alias("c")).select(
        "mass", ((F.col("c.density") + F.coalesce("c.next", F.lit(0.0))) / 2).alias("level"))


def iso_lines(density: DataFrame, levels: DataFrame) -> DataFrame:
    """(mass, level, px, py, part, x0, y0, x1, y1): the pieces of the level lines, by marching squares over the grid's cells.

    A cell is named by its lower corner. Places on its sides are interpolated between the corners; where all four sides are crossed, the
    mean of the corners says which corners hang together. Levels are a few rows, each cell meets all of them.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]))
    spots = density.select("px", "py", "x", "y", "density", corner.alias("at"))
    cells = spots.groupBy((F.col("px") - F.col("at.i")).alias("px"), (F.col("py") - F.col("at.j")).alias("py")).agg(
        F.array(*[F.max(F.when(F.col("at.k") == k, F.struct("x", "y", "density"))) for k in range(4)]).alias("c"))
    whole = cells.filter(F.forall("c", lambda p: p.isNotNull()))
    listed = levels.agg(F.collect_list(F.struct("mass", "level")).alias("l")).scalar()
    rows = whole.withColumn("l", F.explode(listed)).select("px", "py", "c", "l.mass", "l.level")

    def side(a: int, b: int) -> Column:
        p, q = F.col("c")[a], F.col("c")[b]
        share = (F.col("level") - p["density"]) / (q["density"] - p["density"])
        place = F.struct((p["x"] + share * (q["x"] - p["x"])).alias("x"), (p["y"] + share * (q["y"] - p["y"])).alias("y"))
        return F.when((p["density"] >= F.col("level")) != (q["density"] >= F.col("level")), place)

    sides = [side(0, 1), side(1, 2), side(3, 2), side(0, 3)]  # lower, right, upper, left
    rows = rows.withColumn("s", F.array(*sides)).withColumn("on", F.array_compact("s"))
    mean = (F.col("c")[0]["density"] + F.col("c")[1]["density"] + F.col("c")[2]["density"] + F.col("c")[3]["density"]) / 4
    around_odd = (F.col("c")[0]["density"] >= F.col("level")) == (mean >= F.col("level"))

    def pair(part: int, p: Column, q: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))

    s = [F.col("s")[k] for k in range(4)]
    pieces = F.when(F.size("on") == 2, F.array(pair(0, F.col("on")[0], F.col("on")[1]))).when(
        F.size("on") == 4, F.when(around_odd, F.array(pair(0, s[0], s[1]), pair(1, s[2], s[3]))).otherwise(F.array(pair(0, s[3], s[0]), pair(1, s[1], s[2]))))
    return rows.select("mass", "level", "px", "py", F.explode(pieces).alias("p")).select("mass", "level", "px", "py", "p.*")


def category_frequency(df: DataFrame, category: str, stack: str) -> DataFrame:
    """Counts per category and class, with the category total that orders the bars."""
    cells = df.groupBy(category, stack).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(category).agg(F.sum("n").alias("category_n"))
    return _on(cells, totals, [category])


def category_order(df: DataFrame, category: str) -> DataFrame:
    """(category, n, sort_key): categories by falling count, then by name."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).withColumn("_down", -F.col("n"))
    placed = row_positions(counts, ["_down", category])
    return placed.select(category, "n", F.col("position").cast("int").alias("sort_key"))
