"""Queries that take every row of their table, against plain Python."""

import math
from datetime import datetime, timedelta

import pytest
from sparkburst.plans import registry

ROWS = 400


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    kinds = ("purchase", "view", "error")
    events = [(k, datetime(2024, 1, 1) + timedelta(seconds=k * 6007 + k * k % 977), k * 13 % 83, kinds[k % 3], k % 41 * 1.5, '{"k": 1}') for k in range(ROWS)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def rows(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def test_quantiles_of_all_events(spark, folder):
    def quantile(p, mean):
        k, part = 0, math.exp(-mean)
        total = part
        while total < 1.0 - p:
            k += 1
            part *= mean / k
            total += part
        return k

    got = {r.event_id: r.k for r in rows(spark, folder, "poisson_quantiles")}
    assert got == {k: quantile(10.0 ** -(k % 7 + 1), (k % 37 + 1) ** 2 / 4) for k in range(ROWS)}


def test_values_are_found_once_for_each_key(spark):
    calls = spark.sparkContext.accumulator(0)

    @registry.F.udf("long")
    def double(k):
        calls.add(1)
        return None if k is None else 2 * k

    x = spark.range(300).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 3 END k", "id % 2 AS j")
    got = registry.per_value(x, ["k", "j"], ("v", double(registry.F.col("__k")))).collect()
    assert len(got) == 300 and all(r.v == (2 * r.k if r.k else None) for r in got) and calls.value == 6
    for name in ("poisson_tails", "poisson_quantiles"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" in plan and "Aggregate" in plan


@pytest.fixture(scope="module")
def photons(spark, folder):
    return {p.event_id: p for p in registry.photons(spark, folder).collect()}


def stretch(photons):
    """Of a photon: its mission and its stretch of two thousand mean gaps."""
    width = (max(p.t for p in photons.values()) - min(p.t for p in photons.values())) // len(photons) * 4 * registry._CHUNK_GAPS
    return lambda p: p.mission * 1_000_000 + (p.t - registry.START) // width


def orbit(photons, chunk):
    """Rows of each chunk by time: the first event of each six hours."""
    first = {}
    for p in sorted(photons.values(), key=lambda p: (p.t, p.event_id)):
        first.setdefault((chunk(p), p.t // 21_600_000_000), p)
    out = {}
    for (mission, _), p in first.items():
        out.setdefault(mission, []).append((p.t, float(p.user_id * 7 % 360 - 180), float(p.user_id % 80 - 40), 500000 + p.value, p.user_id % 16 / 16, p.user_id % 32 / 32, p.event_id % 64 / 64))
    return out


def between(path, at):
    k = next((k for k in range(len(path) - 1) if path[k + 1][0] >= at), None)
    if k is None:
        return None
    (t0, *a), (t1, *b) = path[k], path[k + 1]
    return [x + (y - x) * ((at - t0) / (t1 - t0)) for x, y in zip(a, b, strict=True)]


def test_veto_of_all_events(spark, folder, photons):
    gap = (max(p.t for p in photons.values()) - min(p.t for p in photons.values())) // len(photons) * 4
    want = []
    of = stretch(photons)
    for chunk in {of(p) for p in photons.values()}:
        t = sorted(p.t for p in photons.values() if of(p) == chunk)
        sessions = [[t[0]]]
        for a, b in zip(t[:-1], t[1:], strict=True):
            if b - a > gap or b == t[-1]:
                sessions.append([])
            sessions[-1].append(b)
        for x in sessions:
            if x and (x[-1] == t[-1] or not (x[-1] - x[0] > 3 * gap or len(x) >= 4)):
                want += [(chunk, v) for v in x]
    assert sorted(tuple(r) for r in rows(spark, folder, "session_veto")) == sorted(want) and len(want) > 50


def test_positions_of_all_events(spark, folder, photons):
    of = stretch(photons)
    paths = orbit(photons, of)
    want = {p.event_id: v for p in photons.values() if (v := between(paths[of(p)], p.t + 1))}
    got = {r.id: r[1:] for r in rows(spark, folder, "interpolated_positions")}
    assert len(want) > 350 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    low, high = registry.START + 10 * registry.DAY_US, registry.START + 12 * registry.DAY_US
    window = {(m, r[0], r[1]) for m, path in paths.items() for r in path if low <= r[0] <= high}
    assert {tuple(r) for r in rows(spark, folder, "trajectory_window")} == window and window


def test_positions_of_a_mission_whose_time_is_many_stretches(spark):
    d = "/root/testdata/sf0.001"
    photons = {p.event_id: p for p in registry.photons(spark, d).collect()}
    paths = orbit(photons, lambda p: p.mission)
    want = {p.event_id: v for p in photons.values() if (v := between(sorted(paths[p.mission]), p.t + 1))}
    got = {r.id: r[1:] for r in rows(spark, d, "interpolated_positions")}
    assert len(want) > 900 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    points = spark.createDataFrame([(0, 1, -950), (1, 1, 0), (2, 1, 5), (3, 1, 990), (4, 1, 1001), (5, 1, 5000), (6, 2, 1), (7, 3, 1), (8, 1, 1000)], "id long, chunk long, at long")
    path = spark.createDataFrame([(1, 0, 0.0), (1, 10, 10.0), (1, 1000, 1000.0), (3, 0, 1.0)], "chunk long, t long, v double")
    for width in (None, 1, 7, 100, 10_000):
        assert {r.id: r.v for r in registry.trajectory.interpolated(points, path, ["v"], width=width).collect()} == {0: -950.0, 1: 0.0, 2: 5.0, 3: 990.0, 8: 1000.0}


def test_bursts_are_located_on_the_whole_trajectory(spark, photons):
    d = "/root/testdata/sf0.001"
    events, config = registry._spanned(spark, d)
    width = config.max_duration // 4 * registry._CHUNK_GAPS
    paths = orbit({p.event_id: p for p in registry.photons(spark, d).collect()}, lambda p: p.mission * 1_000_000 + (p.t - registry.START) // width)
    found = registry.scan.vetoed(registry.scan.search(events, config), 36_000_000_000, 108_000_000_000, 5).collect()
    want = {(f.chunk, f.start): v for f in found if (v := between(sorted(paths[f.chunk]), f.start + f.bin_best // 2))}
    got = {(r.chunk, r.start): r[4:] for r in rows(spark, d, "located_bursts")}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_strokes_near_all_events(spark, folder, photons):
    radius = registry.geo.EARTH_M

    def seen(p, s):
        la1, lo1, la2, lo2 = map(math.radians, (p.user_id % 80 - 39, p.user_id * 7 % 360 - 180, s.user_id % 80 - 40, s.user_id * 7 % 360 - 180))
        a = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        distance = 2 * radius * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))
        x, y = radius + 550000.0, radius + registry.geo.LIGHTNING_M
        return distance, round(math.sqrt(x * x + y * y - 2 * x * y * math.cos(distance / radius)) / registry.geo.LIGHT_M_S * 1e9) / 1000

    tolerance, half = registry._TOL, registry._HALF
    pairs, chance = {}, {}
    for p in photons.values():
        at, covered = p.t + 1000, []
        for s in (s for s in photons.values() if s.kind == "purchase" and abs(s.t - at) <= half):
            distance, delay = seen(p, s)
            if distance <= registry._REACH:
                covered.append((s.t + delay - tolerance, s.t + delay + tolerance))
                if abs(s.t - (at - delay)) <= tolerance:
                    pairs[p.event_id, s.event_id] = distance
        total, end = 0.0, at - half
        for a, b in sorted(covered):
            a, b = max(a, end), min(b, at + half)
            if b > a:
                total, end = total + b - a, b
        chance[p.event_id] = total / (2.0 * half)
    got = {(r.id, r.sid): r.distance for r in rows(spark, folder, "lightning_associations")}
    assert got.keys() == pairs.keys() and all(got[k] == pytest.approx(pairs[k], abs=0.01) for k in pairs) and len({a for a, _ in pairs}) > 30
    share = {r.id: r.probability for r in rows(spark, folder, "coincidence_probability")}
    assert share.keys() == chance.keys() and all(share[k] == pytest.approx(chance[k], abs=1e-8) for k in chance)


def test_records_of_whole_texts(spark, tmp_path):
    texts = [None, "", "short", "12345678", "exactly sixteen!", "more than two records é in UTF-8", "x" * 4003] + [f"text {k} " * 30 + "ab" * k for k in range(20)] + ["".join(chr(80 + (k * n) % 11) for n in range(400)) for k in range(2, 12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        for n in range(max(1, -(-len(data) // 8))):
            b = data[8 * n : 8 * n + 8]
            if len(b) < 8:
                want[k, n] = (None, None, "short")
                continue
            crc = 0
            for digit in b.hex()[:15]:
                crc = registry.packets.CRC4[crc ^ int(digit, 16)]
            kind = {0x00: "event", 0x20: "event", 0x10: "second"}.get(b[7] & 0x30, "error") if crc == b[7] & 15 else "error"
            want[k, n] = (crc, (b[5] & 127) << 24 | b[4] << 16 | b[3] << 8 | b[2], kind)
    got = rows(spark, str(tmp_path), "packet_fields_all")
    assert len(got) == len(want) and {(r.doc_id, r.record): (r.crc, r.bus, r.kind) for r in got} == want
    assert {v[2] for v in want.values()} == {"short", "event", "second", "error"}
