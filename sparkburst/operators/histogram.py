"""Light curves and histograms with dense bins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bins(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("bin"))


def _dense(counted: DataFrame, n: int) -> DataFrame:
    """counted (bin, value) with a row for every bin: missing ones are 0. How the sides meet is left to their sizes, as a long span has many bins."""
    return bins(counted.sparkSession, n).join(counted, "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns if c != "bin"])


def light_curve(events: DataFrame, start: int, stop: int, width: int, t: str = "t") -> DataFrame:
    """(bin, count) over [start, stop) in bins of width; the last may be short; empty bins are 0."""
    n = -(-(stop - start) // width)
    inside = events.where((F.col(t) >= start) & (F.col(t) < stop))
    return _dense(inside.groupBy(F.floor((F.col(t) - start) / width).cast("long").alias("bin")).agg(F.count("*").alias("count")), n)


def linear_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Bin number in n equal bins; the last holds its right end; null outside."""
    place = F.least(F.floor((x - low) / ((high - low) / n)), F.lit(n - 1)).cast("long")
    return F.when((x >= low) & (x <= high), place)


def log_bin(x: Column, low: float, high: float, n: int) -> Column:
    return F.when(x > 0, linear_bin(F.log10(x), math.log10(low), math.log10(high), n))


def histogram(df: DataFrame, bin_: Column, n: int, weight: Column | None = None) -> DataFrame:
    """(bin, count) or, with a weight, (bin, total); rows without a bin are left out."""
    value = F.count("*").alias("count") if weight is None else F.sum(weight).alias("total")
    return _dense(df.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("bin").agg(value), n)


def log_edges(df: DataFrame, x: str, low: float | None = None, high: float | None = None) -> tuple[Column, Column]:
    """Common logarithms of the least and the greatest positive x, or of the bounds that are given, as columns.

    They are scalar subqueries, so that a histogram over them is one plan; a table without a positive x gives nulls.
    """
    ends = df.where(F.col(x) > 0)
    found = lambda f: ends.agg(F.log10(f(x))).scalar()
    return found(F.min) if low is None else F.lit(math.log10(low)), found(F.max) if high is None else F.lit(math.log10(high))


def log_histogram(df: DataFrame, x: str, n: int, low: float | None = None, high: float | None = None, keys: tuple[str, ...] = (), edges_of: DataFrame | None = None) -> DataFrame:
    """(keys..., bin, left, right, count): n logarithmic bins from the least to the greatest x, of df or of edges_of.

    A bound that is given is used instead. The last bin holds its right end; x outside, not positive or null is left out.
    With keys, each key that df has has all bins; the edges are the same. Where all x are one value, the only bin with a
    width is none: all counts are in the last. A table without x gives no rows with keys, and else empty bins with null edges.
    """
    lo, hi = log_edges(df if edges_of is None else edges_of, x, low, high)
    width = (hi - lo) / n
    place = F.when((F.col(x) > 0) & (F.log10(x) >= lo) & (F.log10(x) <= hi), F.least(F.coalesce(F.floor(F.try_divide(F.log10(x) - lo, width)), F.lit(n - 1)), F.lit(n - 1)).cast("long"))
    counted = df.withColumn("bin", place).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    every = bins(df.sparkSession, n) if not keys else df.select(*keys).distinct().withColumn("bin", F.explode(F.expr(f"sequence(0L, {n - 1}L)")))
    edge = lambda k: F.pow(F.lit(10.0), lo + k * width)
    out = every.join(counted, [*keys, "bin"], "left")
    return out.select(*keys, "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"), F.coalesce("count", F.lit(0)).alias("count"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bin, ratio, difference) of two histograms (bin, count); 0 over 0 has no ratio. A row a bin on both sides."""
    both = a.select("bin", F.col("count").alias("x")).join(b.select("bin", F.col("count").alias("y")), "bin")
    return both.select("bin", F.try_divide(F.col("x"), F.col("y")).alias("ratio"), (F.col("x") - F.col("y")).alias("difference"))


def rate(counts: Column, width_s: float) -> Column:
    return F.transform(counts, lambda c: c / width_s)


def power_law_fit(x: np.ndarray, y: np.ndarray, first: tuple[float, float] | None = None, rounds: int = 200) -> tuple[float, float]:
    """(a, b) of a * x^b by damped least squares (Levenberg-Marquardt); x and y are a histogram's bins."""
    good = y > 0
    if first is None:
        b, a = np.polyfit(np.log(x[good]), np.log(y[good]), 1) if good.sum() > 1 else (-1.0, 0.0)
        first = (math.exp(a), b)
    p, damp = np.array(first, float), 1e-3
    error = lambda q: q[0] * x ** q[1] - y
    for _ in range(rounds):
        r = error(p)
        j = np.stack([x ** p[1], p[0] * x ** p[1] * np.log(x)], axis=1)
        h = j.T @ j
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h)), -j.T @ r, rcond=None)[0]
        with np.errstate(over="ignore", invalid="ignore"):
            better = np.sum(error(p + step) ** 2) < np.sum(r**2)
        if better:
            p, damp = p + step, damp / 3
            if np.all(np.abs(step) <= 1e-12 * np.abs(p)):
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(p[0]), float(p[1])


def power_law_total(a: float, b: float, low: float, high: float, n: int) -> float:
    """Sum of a * x^b over the centres of n logarithmic bins."""
    edges = np.logspace(math.log10(low), math.log10(high), n + 1)
    return float(np.sum(a * ((edges[:-1] + edges[1:]) / 2) ** b))


def _sum(bins_: Column, term) -> Column:
    return F.aggregate(bins_, F.lit(0.0), lambda total, p: total + term(p))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def fitted_power_law(bins_: Column, b0: Column, rounds: int = 120) -> Column:
    """struct(a, b) of the a * x^b nearest to an array of bins (x, y) in squares, from the exponent b0.

    For an exponent the best factor is a quotient of two sums, so only the exponent is searched: damped Gauss-Newton
    steps on what is left of the residuals, each from sums over the bins; a step that doesn't lower the residual is
    halved next time. It is one expression, so groups are fitted where their rows lie. Fewer than two bins give nulls.
    """
    factor = lambda b: _sum(bins_, lambda p: F.pow(p["x"], b) * p["y"]) / _sum(bins_, lambda p: F.pow(p["x"], 2 * b))
    left = lambda a, b: _sum(bins_, lambda p: F.pow(p["y"] - a * F.pow(p["x"], b), F.lit(2.0)))

    def at(b: Column, scale: Column) -> Column:
        """struct(b, a, sse, step, scale): what is known at b; step is the Gauss-Newton step from there."""

        def known(s: Column) -> Column:
            a = s["xy"] / s["xx"]
            # The slope's residual part: d = a x^b ln x less its share along x^b.
            along = s["xxl"] / s["xx"]
            slope = _sum(bins_, lambda p: (p["y"] - a * F.pow(p["x"], b)) * a * F.pow(p["x"], b) * (F.log(p["x"]) - along))
            bend = _sum(bins_, lambda p: F.pow(a * F.pow(p["x"], b) * (F.log(p["x"]) - along), F.lit(2.0)))
            return F.struct(b.alias("b"), a.alias("a"), left(a, b).alias("sse"), F.coalesce(F.try_divide(slope, bend), F.lit(0.0)).alias("step"), scale.alias("scale"))

        sums = F.struct(_sum(bins_, lambda p: F.pow(p["x"], 2 * b)).alias("xx"), _sum(bins_, lambda p: F.pow(p["x"], b) * p["y"]).alias("xy"), _sum(bins_, lambda p: F.pow(p["x"], 2 * b) * F.log(p["x"])).alias("xxl"))
        return _let(sums, known)

    def moved(state: Column, _: Column) -> Column:
        # Near the end residuals differ by rounding only; there the step itself has to shrink.
        level = lambda new: (F.abs(new["sse"] - state["sse"]) <= 1e-9 * state["sse"]) & (F.abs(new["step"]) < F.abs(state["step"]))
        tried = lambda new: F.when((new["sse"] < state["sse"] * (1 - 1e-9)) | level(new), new).otherwise(state.withField("scale", state["scale"] / 2))
        return _let(at(state["b"] + state["scale"] * state["step"], F.least(F.lit(1.0), state["scale"] * 2)), tried)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), at(b0, F.lit(1.0)), moved)
    return F.when(F.size(bins_) > 1, _let(end, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))


def log_slope(bins_: Column) -> Column:
    """The slope of log y over log x of the bins (x, y) that hold something: where a fit begins. -1 if there is none."""
    good = F.filter(bins_, lambda p: p["y"] > 0)
    n = F.size(good).cast("double")
    lx, ly = lambda p: F.log(p["x"]), lambda p: F.log(p["y"])
    up = n * _sum(good, lambda p: lx(p) * ly(p)) - _sum(good, lx) * _sum(good, ly)
    down = n * _sum(good, lambda p: lx(p) * lx(p)) - F.pow(_sum(good, lx), F.lit(2.0))
    return F.when(F.size(good) > 1, F.coalesce(F.try_divide(up, down), F.lit(-1.0))).otherwise(-1.0)


def chained_power_laws(hist: DataFrame, keys: list[str], ranges: list[tuple[float, float]], rounds: int = 120) -> DataFrame:
    """(keys..., fits): for each range of x (both ends left out) the fit to a group's bins, begun from the range before.

    hist has keys and a row a bin (left, right, count); a bin's x is the middle of its ends. A group's bins, whose number
    the histogram fixes, meet in one row; groups are spread over tasks, and none comes to the driver. The first fit begins
    from the slope of the logarithms; a range with fewer than two bins gives a null and passes its beginning on.
    """
    rows = hist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(((F.col("left") + F.col("right")) / 2).alias("x"), F.col("count").cast("double").alias("y")))).alias("__bins"))
    within = lambda low, high: lambda p: (p["x"] > low) & (p["x"] < high)
    begin, fits = None, []
    for k, (low, high) in enumerate(ranges):
        rows = rows.withColumn(f"__in{k}", F.filter("__bins", within(low, high)))
        inside = F.col(f"__in{k}")
        begin = log_slope(inside) if begin is None else begin
        rows = rows.withColumn(f"__b{k}", begin)
        # Exploding an array of one keeps the planner from putting the fit into every place that names it.
        rows = rows.select("*", F.explode(F.array(fitted_power_law(inside, F.col(f"__b{k}"), rounds))).alias(f"__fit{k}"))
        begin = F.coalesce(F.col(f"__fit{k}.b"), F.col(f"__b{k}"))
        fits.append(F.col(f"__fit{k}"))
    return rows.select(*keys, F.array(*fits).alias("fits"))


def power_law_sum(fit: Column, low: Column, high: Column, n: Column) -> Column:
    """Sum of a * x^b over the middles of n logarithmic bins between two common logarithms."""
    edge = lambda i: F.pow(F.lit(10.0), low + i * (high - low) / n)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda total, i: total + fit["a"] * F.pow((edge(i) + edge(i + 1)) / 2, fit["b"]))
