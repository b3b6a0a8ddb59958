"""Merging with sight, histograms with edges from the data, and grouped fits, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkburst.operators import histogram, scan

FOUND = "chunk long, ti long, tj long, k long, mean double, p double, fp double"


def plain_merge(triggers, vision):
    out = []
    for chunk in sorted({t[0] for t in triggers}):
        last = None
        for _, ti, tj, k, mean, p, fp in sorted(t for t in triggers if t[0] == chunk):
            size = tj - ti
            if last and last["stop"] + max(last["max"], size) * vision >= ti:
                last["stop"], last["min"], last["max"] = max(last["stop"], tj), min(last["min"], size), max(last["max"], size)
                if fp < last["fp"]:
                    last |= {"best": size, "delay": ti - last["start"], "k": k, "fp": fp}
            else:
                last = {"chunk": chunk, "start": ti, "stop": tj, "min": size, "max": size, "best": size, "delay": 0, "k": k, "fp": fp}
                out.append(last)
    return sorted(tuple(x.values()) for x in out)


@pytest.mark.parametrize("vision", [0.0, 0.5, 1.0, 2.0, 7.25])
def test_merging_with_vision(spark, vision):
    rng = random.Random(4)
    triggers = []
    for chunk in range(6):
        t = 0
        for _ in range(300):
            t += rng.randrange(120)
            triggers.append((chunk, t, t + rng.randrange(1, 60), rng.randrange(9), 1.0, 0.1, rng.randrange(5) / 4))
    triggers += [(9, 10, 20, 1, 1.0, 0.1, 1.0), (9, 10, 20, 1, 1.0, 0.1, 1.0), (10, 0, 10, 1, 1.0, 0.1, 2.0), (10, 20, 30, 2, 1.0, 0.1, 1.0), (10, 41, 42, 3, 1.0, 0.1, 0.5)]
    df = spark.createDataFrame(triggers, FOUND).repartition(7)
    got = scan.merged(df, vision).select("chunk", "start", "stop", "bin_min", "bin_max", "bin_best", "delay", "count", "fp").collect()
    assert sorted(map(tuple, got)) == plain_merge(triggers, vision)


def test_sight_depends_on_the_longest_bin_so_far(spark):
    # The third is seen because of the first's long bin, though the second, which is nearer, is short; a bound from the whole chunk would take in the fourth.
    rows = [(1, 0, 100, 1, 1.0, 0.1, 1.0), (1, 90, 101, 1, 1.0, 0.1, 1.0), (1, 150, 151, 1, 1.0, 0.1, 1.0), (1, 300, 301, 1, 1.0, 0.1, 1.0), (1, 500, 900, 1, 1.0, 0.1, 1.0)]
    got = scan.merged(spark.createDataFrame(rows, FOUND), 0.5).select("start", "stop").orderBy("start").collect()
    assert [tuple(r) for r in got] == [(0, 151), (300, 900)]
    assert scan.merged(spark.createDataFrame([], FOUND), 0.5).count() == 0


def test_edges_from_the_data(spark):
    rng = random.Random(8)
    x = [3.0, 900.0] + [math.exp(rng.uniform(math.log(3), math.log(900))) for _ in range(500)] + [0.0, -1.0, None]
    df = spark.createDataFrame([(v, k % 3) for k, v in enumerate(x)], "x double, g int")
    got = histogram.log_histogram(df, "x", 37).orderBy("bin").collect()
    edges = np.logspace(math.log10(3.0), math.log10(900.0), 38)
    want = np.histogram(np.array([v for v in x if v and v > 0]).clip(edges[0], edges[-1]), edges)[0]
    assert [r["count"] for r in got] == want.tolist() and sum(want) == 502
    assert [r.left for r in got] == pytest.approx(edges[:-1].tolist()) and [r.right for r in got] == pytest.approx(edges[1:].tolist())
    by_group = histogram.log_histogram(df, "x", 37, keys=("g",)).groupBy("bin").agg(F.sum("count").alias("n"), F.count("*").alias("groups")).orderBy("bin").collect()
    assert [r.n for r in by_group] == want.tolist() and {r.groups for r in by_group} == {3}
    one = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["count"] for r in histogram.log_histogram(one, "x", 3).orderBy("bin").collect()] == [0, 0, 2]
    assert [r["count"] for r in histogram.log_histogram(one.limit(0), "x", 3).collect()] == [0, 0, 0]
    plan = histogram.log_histogram(df, "x", 37)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan


def test_fits_of_groups(spark):
    """Noisy power laws of many groups: the residual is no larger than around the fit, and equals the driver's fit."""
    rng = np.random.default_rng(3)
    edges = np.logspace(-6, 3, 61)
    x = (edges[:-1] + edges[1:]) / 2
    rows, want = [], {}
    for g in range(12):
        a, b = 3.0 + g, -0.6 + 0.1 * g
        y = np.maximum(0, np.round(a * x**b * (1 + 0.3 * rng.standard_normal(len(x)))))
        rows += [(g, k, float(edges[k]), float(edges[k + 1]), int(y[k])) for k in range(len(x))]
        want[g] = y
    hist = spark.createDataFrame(rows, "g int, bin long, left double, right double, count long").repartition(5)
    found = {r.g: r.fits for r in histogram.chained_power_laws(hist, ["g"], [(1e-3, 1e3), (1e-7, 1e-2), (50.0, 51.0)]).collect()}
    for g, y in want.items():
        assert found[g][2] is None  # too few bins
        for fit, inside in ((found[g][0], (x > 1e-3) & (x < 1e3)), (found[g][1], (x > 1e-7) & (x < 1e-2))):
            sse = lambda a, b, u=x[inside], v=y[inside]: float(np.sum((a * u**b - v) ** 2))
            here = sse(fit.a, fit.b)
            assert all(sse(fit.a * (1 + p), fit.b + q) >= here * (1 - 1e-12) for p in (-1e-4, 0, 1e-4) for q in (-1e-4, 0, 1e-4))
            a, b = histogram.power_law_fit(x[inside], y[inside], first=(fit.a * 1.1, fit.b - 0.01))
            assert (fit.a, fit.b) == pytest.approx((a, b), rel=1e-5, abs=1e-7)
    total = spark.createDataFrame([(2.0, -0.5)], "a double, b double").select(histogram.power_law_sum(F.struct("a", "b"), F.lit(-6.0), F.lit(3.0), F.lit(60))).first()[0]
    assert total == pytest.approx(histogram.power_law_total(2.0, -0.5, 1e-6, 1e3, 60))
