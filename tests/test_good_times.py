"""Good time, energies, coincidences of detectors, labels and idle logs against plain Python, with odd rows."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from sparkburst.functions import geo, poisson
from sparkburst.operators import gti
from sparkburst.sources import archive

INTERVALS = "k string, start long, stop long"


def _drawn(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    spans = [(key(), s, s + rng.choice([0, 1, 5, 30, 400])) for s in (rng.randrange(1000) for _ in range(60))]
    spans += [spans[0], ("a", None, 5), ("a", 7, None), ("a", 90, 10), ("c", 0, 5000)]
    events = [(i, key() if i % 9 else "c", rng.randrange(-50, 1100) if i % 50 else None) for i in range(400)]
    return spans, events + events[:3]


def _inside(spans: list, k: str | None, t: int | None) -> bool:
    return t is not None and any(k == x and s is not None and e is not None and s <= t < e for x, s, e in spans)


def test_marked_events_in_cut_and_whole_intervals(spark):
    spans, events = _drawn(3)
    want = sorted((i, _inside(spans, k, t)) for i, k, t in events)
    ev = spark.createDataFrame([(*e, True) for e in events], "id long, k string, t long, good boolean")
    iv = spark.createDataFrame(spans, INTERVALS)
    assert sorted((r.id, r.good) for r in gti.marked(ev, iv, ["k"]).collect()) == want
    cut = gti.dealt(iv, -60, 37)
    assert all(r.start < r.stop and (r.start + 60) // 37 == (r.stop - 1 + 60) // 37 == r.stretch for r in cut.collect())
    by_stretch = gti.marked(ev.withColumn("stretch", F.floor((F.col("t") + 60) / 37).cast("long")), cut, ["k", "stretch"])
    assert sorted((r.id, r.good) for r in by_stretch.collect()) == want
    none = iv.limit(0)
    assert not any(r.good for r in gti.marked(ev, none, ["k"]).collect()) and gti.marked(ev.limit(0), iv, ["k"]).count() == 0


def test_merged_intervals_and_exposure(spark):
    spans, events = _drawn(4)
    iv, ev = spark.createDataFrame(spans, INTERVALS), spark.createDataFrame(events, "id long, k string, t long")
    held = {(x, t) for x, s, e in spans if s is not None and e is not None for t in range(s, e)}
    got = gti.merged(iv, ["k"]).collect()
    assert sorted(((r.k, t) for r in got for t in range(r.start, r.stop)), key=str) == sorted(held, key=str)
    assert all((r.k, r.stop) not in held and (r.k, r.start - 1) not in held for r in got)
    want, count = {}, {}
    for k, t in held:
        want[k, t // 100] = want.get((k, t // 100), 0) + 1
    for _, k, t in events:
        if _inside(spans, k, t):
            count[k, t // 100] = count.get((k, t // 100), 0) + 1
    assert {(r.k, r.bin): r.exposure for r in gti.exposure(iv, ["k"], 0, 100).collect()} == want
    assert {(r.k, r.bin): (r.exposure, r["count"]) for r in gti.rates(ev, iv, ["k"], 0, 100).collect()} == {x: (n, count.get(x, 0)) for x, n in want.items()}
    assert gti.rates(ev, iv.limit(0), ["k"], 0, 100).count() == 0


def test_energies_of_unknown_channels_are_null(spark):
    ev = spark.createDataFrame([("f", 1, 1), ("f", 2, 2), ("g", 1, 3), (None, 1, 4), ("f", None, 5)], "file string, pi int, id int")
    eb = spark.createDataFrame([("f", 1, 0.5, 1.0), ("g", 1, 2.0, 3.0)], "file string, channel int, e_min double, e_max double")
    got = {r.id: (r.e_min, r.e_max) for r in gti.energies(ev, eb, ["file"]).collect()}
    assert got == {1: (0.5, 1.0), 2: (None, None), 3: (2.0, 3.0), 4: (None, None), 5: (None, None)}


def test_at_least_n_of_m(spark):
    rng = random.Random(5)
    for m in (0, 1, 4, 10):
        ps = [round(rng.random(), 3) for _ in range(m)]
        row = spark.range(1).select(F.array(*map(F.lit, ps)).cast("array<double>").alias("ps"))
        for n in range(m + 2):
            want = sum(math.prod(p if hit else 1 - p for p, hit in zip(ps, hits, strict=True)) for hits in itertools.product((0, 1), repeat=m) if sum(hits) >= n)
            assert abs(row.select(poisson.at_least(n, F.col("ps")).alias("x")).first().x - want) < 1e-12, (m, n)
    odd = spark.createDataFrame([([0.5, None],), (None,)], "ps array<double>").select(poisson.at_least(1, F.col("ps")).alias("x"), poisson.at_least(0, F.col("ps")).alias("y")).collect()
    assert all(r.x is None and r.y is None for r in odd)


def test_labels(spark):
    lon = {0: "0°", 180: "180°", -180: "180°", 181: "179°W", 330: "30°W", -30: "30°W", 60: "60°E", 720: "0°"}
    lat = {-30: "30°S", 0: "0°", 15: "15°N"}
    assert {r.x: r.y for r in spark.createDataFrame([(x,) for x in lon], "x long").select("x", geo.longitude_label(F.col("x")).alias("y")).collect()} == lon
    assert {r.x: r.y for r in spark.createDataFrame([(x,) for x in lat], "x long").select("x", geo.latitude_label(F.col("x")).alias("y")).collect()} == lat


def test_idle_logs(spark):
    logs = spark.createDataFrame([("a.sh.out.1", 0), ("a.sh.err.1", 3), ("a.sh.out.2", 0), ("b.sh.out.3", 0), ("a.sh.core.4", 0), (None, 0), ("a.sh.out.5", None)], "name string, size long")
    running = spark.createDataFrame([(2,), (None,)], "id long")
    assert [r.name for r in archive.idle_logs(logs, running, "a.sh").collect()] == ["a.sh.out.1"]
    assert archive.idle_logs(logs, running.limit(0), "a.sh").count() == 2 and archive.idle_logs(logs.limit(0), running, "a.sh").count() == 0
