"""Operators against sequential Python, hand-checked values and synthetic files."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkburst.functions import clock, geo, packets, poisson, solar
from sparkburst.plans import registry
from sparkburst.operators import histogram, saturation, scan, trajectory
from sparkburst.sources import archive, fits, signals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def sequential(times, start, stop, cfg):
    """Two-pointer counts written from the rules: last event below, first event at or above, first snapshot's overshoot."""
    t = [x for x in times if x >= start]
    n = len(t)
    out = []
    below = lambda x: sum(v < x for v in t) - 1
    at_least = lambda x: sum(v < x for v in t)
    for i in range(n):
        for j in range(i, n):
            if t[i] >= stop or t[j] >= stop or t[j] - t[i] >= cfg.max_duration:
                continue
            k, dur = j - i + 1, t[j] - t[i]
            if k < cfg.min_number or dur < cfg.min_duration or not dur:
                continue
            counts, spans = [], []
            for half in (cfg.neighbor // 2, cfg.hollow // 2):
                first = min(at_least(t[0] + half), n - 1)
                counts.append(max(first, below(t[j] + half)) - max(0, at_least(t[i] - half) - 1) + 1)
                spans.append(min(t[j] + half, stop) - max(t[i] - half, start))
            out.append((t[i], t[j], k, (counts[0] - counts[1]) * dur / (spans[0] - spans[1])))
    return out


def tail(mean, k):
    """P(X > k) by plain summing."""
    log = lambda i: i * math.log(mean) - mean - math.lgamma(i + 1)
    return math.fsum(math.exp(log(i)) for i in range(k + 1, k + 400))


def test_scan_pairs_match_sequential_counts(spark):
    rng = random.Random(4)
    cfg = scan.ScanConfig(0, 60, 4000, 200, 1e11, 3)
    for case in range(3):
        times = sorted(rng.sample(range(0, 9000), 150)) + [4000 + k for k in range(0, 40, 5)]
        times = sorted(set(times))
        rows = spark.createDataFrame([(case, t, 500, 8800) for t in times], "chunk long, t long, start long, stop long")
        found = {(r.ti, r.tj): (r.k, r.mean, r.p) for r in scan.triggers(rows, cfg).collect()}
        want = {(a, b): (k, m) for a, b, k, m in sequential(times, 500, 8800, cfg)}
        want = {key: (k, m, p) for key, (k, m) in want.items() if m > 0 and (p := tail(m, k)) < cfg.limit * (key[1] - key[0]) / 1e6 / poisson.YEAR_S}
        assert found.keys() == want.keys() and found
        for key, (k, m, p) in found.items():
            assert want[key][0] == k and want[key][1] == pytest.approx(m, rel=1e-12) and want[key][2] == pytest.approx(p, rel=1e-9)


def test_hand_values(spark):
    assert one(spark, geo.distance(F.lit(10.0), F.lit(20.0), F.lit(15.0), F.lit(25.0))) == pytest.approx(776860.157542904)
    assert one(spark, geo.arrival_ns(F.lit(800e3), F.lit(550e3), F.lit(15e3))) == 3305816
    assert one(spark, poisson.sf(F.lit(2.0), F.lit(8))) == pytest.approx(2.3744732826e-4, rel=1e-9)
    assert one(spark, poisson.sf(F.lit(0.1), F.lit(8))) == pytest.approx(2.51865283553e-15, rel=1e-9)
    assert one(spark, poisson.sf(F.lit(0.0), F.lit(0))) == 0.0 and one(spark, poisson.search_sf(F.lit(0.0), F.lit(0))) == 1.0
    u = F.lit(clock.micros("2022-10-07T15:01:48"))
    assert one(spark, solar.declination(u)) == pytest.approx(-5.4039732775, abs=1e-9)
    assert one(spark, solar.zenith(u, F.lit(25.0), F.lit(0.0))) == pytest.approx(53.4576290562, abs=1e-9)
    assert one(spark, solar.azimuth(u, F.lit(25.0), F.lit(0.0))) == pytest.approx(-61.6456909462, abs=1e-9)
    assert one(spark, clock.met_from_utc(F.lit(clock.micros("2016-12-31T23:59:59")), clock.HXMT)) == 157852801.0
    assert one(spark, clock.met_from_utc(F.lit(clock.micros("2017-01-01T00:00:00")), clock.HXMT)) == 157852803.0
    for data, crc in ((bytes(8), 0), (bytes(range(1, 9)), 7), (b"\xff" * 8, 0)):
        assert one(spark, packets.crc4(F.lit(data))) == crc


@pytest.mark.parametrize("mean, count, want", [(500.0, 480, None), (1000.0, 1000, None), (2000.0, 1950, None), (10000.0, 10000, None), (0.5, 700, None), (3.0, 0, None), (900.0, 1100, None)])
def test_tails_of_large_counts(spark, mean, count, want):
    log = lambda i: i * math.log(mean) - mean - math.lgamma(i + 1)
    low = math.fsum(math.exp(log(i)) for i in range(count + 1))
    want = 1 - low if low < 0.9 else math.fsum(math.exp(log(i)) for i in range(count + 1, count + 5000))
    assert one(spark, poisson.sf(F.lit(mean), F.lit(count))) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_quantiles_have_no_cap(spark):
    k, part, total = 0, 0.0, math.exp(-2000.0)
    while total < 1.0 - 1e-6:
        k += 1
        part += math.log(2000.0 / k)
        total += math.exp(part - 2000.0)
    assert k > 2200 and one(spark, poisson.isf(F.lit(1e-6), F.lit(2000.0))) == k
    assert one(spark, poisson.isf(F.lit(0.0), F.lit(5.0))) is None and one(spark, poisson.isf(F.lit(1.0), F.lit(5.0))) == 0


def test_interpolation_edges(spark):
    path = spark.createDataFrame([(1, 10, 0.0), (1, 20, 10.0), (2, 5, 1.0)], "chunk int, t long, v double")
    points = spark.createDataFrame([("before", 1, 5), ("at", 1, 10), ("mid", 1, 15), ("end", 1, 20), ("after", 1, 21), ("lone", 2, 5)], "id string, chunk int, at long")
    got = {r["id"]: r["v"] for r in trajectory.interpolated(points, path, ["v"]).collect()}
    assert got == {"before": -5.0, "at": 0.0, "mid": 5.0, "end": 10.0}


def test_veto_keeps_last(spark):
    rows = spark.createDataFrame([(0, t) for t in (0, 1, 2, 3, 50, 51, 100)], "chunk int, start long")
    assert [r.start for r in scan.vetoed(rows, 10, 100, 4).orderBy("start").collect()] == [50, 51, 100]
    assert [r.start for r in scan.vetoed(rows.where("start < 4"), 10, 100, 3).orderBy("start").collect()] == [3]


def record(kind, stime=0, ptime=0):
    row = [0] * 8
    if kind == "second":
        row[:4] = stime.to_bytes(4, "big")
    row[4], row[5], row[6] = ptime >> 18 & 1, ptime >> 10 & 255, ptime >> 2 & 255
    row[7] = (ptime & 3) << 6 | {"event": 0, "second": 0x10, "error": 0x30}[kind]
    c = 0
    for j in range(15):
        c = packets.CRC4[c ^ (row[j // 2] >> 4 if j % 2 == 0 else row[j // 2] & 15)]
    row[7] |= c
    return bytes(row)


def packet(utc, records):
    body = b"".join(records) + record("error") * (109 - len(records))
    return bytes(6) + body + struct.pack("<I", utc)


@pytest.mark.parametrize("gap, wide", [(3400, False), (3500, True)])
def test_saturation(spark, gap, wide):
    """A gap of 6.8 ms between packets passes, one of 7.0 ms is saturation; an unknown stamp is, too."""
    second = 500_000  # ticks
    ticks = lambda a, b: [record("event", ptime=t) for t in range(a, b, 3000)]
    packs = [packet(999, [record("second", 499, 0), *ticks(1, 250_000)]), packet(1000, ticks(250_000, second))]
    last = 250_000 + (second - 250_000 - 1) // 3000 * 3000
    packs.append(packet(1000, [record("second", 500, gap - (second - last)), *ticks(gap, 250_000)]))
    final = gap + (250_000 - gap - 1) // 3000 * 3000
    packs.append(packet(1001, [*ticks(final + 3000, second), record("second", 501, 0)]))
    sci = spark.createDataFrame([(1, "A", k, p) for k, p in enumerate(packs)], "chunk int, box string, row int, ccsds binary")
    bus = lambda t: bytes(2) + struct.pack("<I", t)
    eng = spark.createDataFrame([(1, "A", k, 499 + k, bus(999 + k)) for k in range(3)], "chunk int, box string, row int, stime int, bus binary")
    asked = spark.createDataFrame([("x", 1, 1000.2), ("y", 1, 5000.0)], "id string, chunk int, met double")
    got = {r["id"]: r["saturated"] for r in saturation.saturated_boxes(asked, eng, sci).collect()}
    assert got == {"x": wide, "y": True}
    rows = saturation.clock_rows(spark.createDataFrame([(1, "A", k, k, bus(t)) for k, t in enumerate((7, 7, 7, 9))], "chunk int, box string, row int, stime int, bus binary"))
    assert [r.repaired for r in rows.orderBy("row").collect()] == [7, 8, 9, 9]


def svom_file(met, pi=3, deal=False):
    """A file with the same events in each detector's table, or with the events dealt to the three."""
    if deal:
        return fits.encoded([(name, svom_columns(met[k::3], pi)) for k, name in enumerate(fits.SVOM_DETECTORS)])
    return fits.encoded([(name, svom_columns(met, pi)) for name in fits.SVOM_DETECTORS])


def svom_columns(met, pi):
    cols = [("TIME", "D", met), ("PI", "I", [pi] * len(met)), ("GAIN_TYPE", "I", [0] * len(met)), ("DEAD_TIME", "E", [0.5] * len(met)), ("EVT_TYPE", "I", [0] * len(met)), ("ANTI_COIN", "I", [0] * len(met)), ("FLAG", "I", [0] * len(met))]
    return [(c, f, np.array(v)) for c, f, v in cols]


def test_fits(spark, tmp_path):
    """Three tables of a file in one pass; a broken file and one without a table give an error each and no rows."""
    (tmp_path / "a.fits").write_bytes(svom_file([1.5, 2.5]))
    (tmp_path / "b.fits").write_bytes(b"broken")
    (tmp_path / "c.fits").write_bytes(fits.encoded([("EVENTS01", [("TIME", "D", np.array([1.0]))])]))
    rows = fits.svom_events(fits.load(spark, f"{tmp_path}/*.fits"))
    assert [(r.det_id, r.row, r.met, r.pi) for r in rows.where("error is null").orderBy("det_id", "row").collect()] == [(k, n, 1.5 + n, 3) for k in (1, 2, 3) for n in (0, 1)]
    assert {r.file.rsplit("/", 1)[1] for r in rows.where("error is not null").collect()} == {"b.fits", "c.fits"}
    assert fits.read_table(spark, f"{tmp_path}/*.fits", "EVENTS01", "TIME double").count() == 3
    assert fits.broken_files(spark, f"{tmp_path}/*.fits", "EVENTS02", ["TIME"]).count() == 2
    assert fits.svom_events(fits.load(spark, [])).count() == 0


def test_instants_with_nanoseconds(spark):
    """The known instants go both ways unchanged, also around a leap second and before an epoch."""
    known = ["2022-10-07T15:01:48.278494Z", "2020-08-06T08:51:41.908577919Z", "2020-11-12T14:37:04.004140019Z", "2024-06-26T01:35:07.999054014Z", "2018-08-26T12:31:59.217Z", "2017-06-27T14:08:39.627Z", "2016-12-31T23:59:59.999999999Z", "2017-01-01T00:00:00Z", "1970-01-01T00:00:00.000000001Z", "1969-12-31T23:59:59.999999999Z", "2100-01-01T00:00:00.5Z"]
    df = spark.createDataFrame([(t,) for t in [*known, None, "soon", "2020-13-01T00:00:00Z"]], "t string").withColumn("ns", clock.nanos_of_text(F.col("t")))
    for mission in (clock.HXMT, clock.SVOM):
        met = clock.met_of_nanos(F.col("ns"), mission)
        got = df.select("t", "ns", met.alias("met"), clock.nanos_of_met(met, mission).alias("back"), clock.text_of_nanos(F.col("ns")).alias("text")).collect()
        assert all(r.ns is None for r in got[len(known):])
        for r in got[: len(known)]:
            assert r.back == r.ns and r.text == r.t.replace(".5Z", ".500Z")
    by = {r.t: (r.ns, r.met) for r in df.select("t", "ns", clock.met_of_nanos(F.col("ns"), clock.HXMT).alias("met")).collect()}
    assert by[known[1]][0] == clock.micros("2020-08-06T08:51:41") * 1000 + 908577919 and str(by[known[4]][1]) == "209910722.217000000"
    assert str(by[known[6]][1]) == "157852801.999999999" and str(by[known[7]][1]) == "157852803.000000000"


def test_resolvers(spark):
    hours = spark.sql("SELECT TIMESTAMP '2017-08-24 10:00:00' AS hour")
    folder = "Y201708/20170824-0071"
    names = ["HXMT_20170824T10_HE-Evt_FFFFFF_V1_1K.FITS", "HXMT_20170824T10_HE-Evt_FFFFFF_V3_1K.FITS", "HXMT_20170824T10_Orbit_FFFFFF_V1.FITS"]
    listing = spark.createDataFrame([(folder, n, k) for k, n in enumerate(names)], "folder string, name string, listed int")
    found = {r.kind: r.file for r in archive.resolve_1k(hours, listing).collect()}
    assert found == {"events": f"{folder}/{names[1]}", "orbit": f"{folder}/{names[2]}"}
    good, errors = archive.chunks(hours, archive.resolve_1k(hours, listing), 3)
    assert good.count() == 0 and errors.first().message == "2 of 3 files"


def put(root, path, data):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_bytes(data)


def burst(rng, low, high, at, n=25):
    return np.array(sorted([rng.uniform(low, high) for _ in range(3000)] + [at + k * 2e-5 for k in range(n)]))


def test_svom_run(spark, tmp_path):
    """Hours to daily files: a burst at the hour's start with events after its end, a missing file, a broken one, an empty day."""
    from sparkburst.functions.clock import SVOM
    from sparkburst.plans.mission import run_days

    rng, day = random.Random(1), clock.micros("2024-07-01T00:00:00") // 10**6
    met = lambda hour: float(day + 3600 * hour - clock.micros(SVOM.epoch) // 10**6)
    root = tmp_path / "svom"
    for hour in (3, 4, 5):
        t = met(hour)
        events = burst(rng, t, t + 20, t) if hour != 5 else burst(rng, t + 3590, t + 3602, t + 3600 + 0.5)  # after stop: no burst of this hour
        put(root, f"2024/07/01/grm_evt/svom_grm_evt_240701_{hour:02d}_v01.fits", svom_file(events, deal=True))
        put(root, f"2024/07/01/grm_evt/svom_grm_evt_240701_{hour:02d}_v00.fits", b"old")
        ends = np.array([t - 1, t + 1800, t + 3700])
        put(root, f"2024/07/01/att/svom_att_240701_{hour:02d}_v00.fits", b"bad" if hour == 4 else fits.encoded([("Quaternion", [("TIME", "D", ends), *((f"Q{k}", "E", np.array([0.0, 1, 2]) + k) for k in range(4))])]))
        put(root, f"2024/07/01/orb/svom_orb_240701_{hour:02d}_v00.fits", fits.encoded([("ORB", [("TIME", "D", ends), *((n, "E", np.array([0.0, 18, 36])) for n in ("LON", "LAT", "ALT"))])]))
    spark.conf.set(archive.CONF["SVOM"], str(root))
    errors = run_days(spark, SVOM, "2024-07-01", "2024-07-02", str(tmp_path / "work"), str(tmp_path / "out"))
    kinds = [(r.hour.hour, r.hour.day, r.kind) for r in errors.collect()]
    assert sorted(kinds) == sorted([(4, 1, "Unreadable")] + [(h, 1, "FileNotFound") for h in range(24) if h not in (3, 4, 5)] + [(h, 2, "FileNotFound") for h in range(24)])
    files = sorted(tmp_path.glob("out/**/*.json"))
    assert [str(f.relative_to(tmp_path / "out")) for f in files] == [f"{SVOM.name}/2024/07/{day}_signals.json" for day in ("20240701", "20240702")] and not list(tmp_path.glob("out/.staging*"))
    found = signals.read_signals(spark, str(tmp_path / "out")).collect()
    assert len(found) == 1 and found[0].start.time == pytest.approx(met(3), abs=1e-3) and found[0]["count"] >= 20 and str(found[0].date) == "20240701"
    assert found[0].attitude.q2 == pytest.approx(found[0].attitude.q1 + 1) and found[0].attitude.q1 == pytest.approx(found[0].position.longitude / 18)
    empty = next(f for f in files if "20240702" in str(f))
    assert json.loads(empty.read_text()) == []
    whole = json.loads(next(f for f in files if "20240701" in str(f)).read_text())
    assert list(whole[0]) == ["start", "stop", "bin_size_min", "bin_size_max", "bin_size_best", "delay", "count", "mean", "sf", "false_positive_per_year", "attitude", "position"] and whole[0]["start"] == {"time": found[0].start.time}


def test_hxmt_run(spark, tmp_path):
    """A burst in the hour's first second on a clock with leap seconds passes the veto and the unsaturated boxes."""
    from sparkburst.functions.clock import HXMT
    from sparkburst.plans.mission import run_mission

    rng, hour = random.Random(2), "2018-08-26T12:00:00"
    t = clock.micros(hour) // 10**6 - clock.micros(HXMT.epoch) // 10**6 + 3  # leap seconds after 2012, 2015 and 2016
    k, b = tmp_path / "1k", tmp_path / "1b"
    events = np.concatenate((burst(rng, t, t + 20, t + 0.2), [t - 2.5]))  # one before the span
    events.sort()
    n, folder = len(events), "Y201808/20180826-0438"
    cols = [("Time", "D", events), ("Det_ID", "B", np.zeros(n)), ("Channel", "B", np.full(n, 100)), ("Pulse_Width", "B", np.full(n, 80)), ("ACD", "J", np.zeros(n)), ("Event_Type", "B", np.zeros(n))]
    put(k, f"{folder}/HXMT_20180826T12_HE-Evt_FFFFFF_V1_1K.FITS", fits.encoded([("Events", cols)]))
    ends = np.array([t - 10.0, t + 100, t + 3700])
    put(k, f"{folder}/HXMT_20180826T12_Att_FFFFFF_V1_1K.FITS", fits.encoded([("ATT_Quater", [("Time", "D", ends), *((f"Q{i}", "D", np.array([0.0, 1, 2])) for i in (1, 2, 3))])]))
    put(k, f"{folder}/HXMT_20180826T12_Orbit_FFFFFF_V1_1K.FITS", fits.encoded([("Orbit", [("Time", "D", ends), *((c, "D", np.array([0.0, 110, 200])) for c in ("Lon", "Lat", "Alt"))])]))

    def box(wide):
        packs = []
        for sec in range(t - 3, t + 4):
            for q in range(20):
                first = record("second", sec - 1000, 0) if q == 0 else record("event", ptime=q * 25_000)
                packs.append(packet(sec, [first, record("event", ptime=(q + 1) * 25_000 - (4000 if wide and q == 7 else 500))]))
        seconds = np.arange(t - 3, t + 4)
        bus = np.hstack([np.zeros((7, 2), np.uint8), seconds.astype("<u4").view(np.uint8).reshape(-1, 4)])
        sci = fits.encoded([("HE_Evt_Src", [("CCSDS", "882B", np.frombuffer(b"".join(packs), np.uint8).reshape(-1, 882))])])
        return {"eng": fits.encoded([("HE_Eng", [("Time", "J", seconds - 1000), ("BUS_Time_Bdc", "6B", bus)])]), "sci": sci}

    def archive_1b(saturated):
        for (kind, name), code in archive.CODES_1B.items():
            put(b, f"2018/20180826/{code}/HXMT_1B_{code}_20180826T120000_G000000_0001_V1.FITS", box(name in saturated)[kind])

    spark.conf.set(archive.CONF["1K"], str(k))
    spark.conf.set(archive.CONF["1B"], str(b))
    hours = spark.sql(f"SELECT TIMESTAMP '{hour}' AS hour UNION ALL SELECT TIMESTAMP '2018-08-26 13:00:00'")
    for saturated, want in (("AB", 1), ("ABC", 0)):
        archive_1b(saturated)
        found, errors = run_mission(spark, HXMT, hours, str(tmp_path / "work"))
        rows = found.collect()
        assert len(rows) == want and [r.message for r in errors.collect()] == ["0 of 9 files"]
        if rows:
            assert rows[0].start.time == pytest.approx(t + 0.2, abs=1e-3) and rows[0]["count"] >= 20 and str(rows[0].day) == "2018-08-26"
            at = rows[0].start.time + rows[0].bin_size_best / 2
            assert rows[0].position.longitude == pytest.approx(at - t + 10, abs=1e-4) and rows[0].attitude.q3 == pytest.approx((at - t + 10) / 110, abs=1e-6)


def test_archive_folders_must_be_set(spark):
    spark.conf.unset(archive.CONF["strokes"])
    with pytest.raises(ValueError, match="lightning"):
        archive.root(spark, "strokes")


def test_strokes_table(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00.000001", 1.0, 2.0, 0.5, 7, None, None, None)], archive.STROKES).write.parquet(f"{tmp_path}/s")
    row = archive.read_strokes(spark, f"{tmp_path}/s").first()
    assert row.nstn == 7 and row.energy is None and len(row) == 8


def test_catalogue_rows(spark):
    """Neither key is broken; null ids are no key; missing columns are null."""
    from sparkburst.operators import catalog

    old = spark.createDataFrame([("a", "S", "D", "1")], "id string, satellite string, detector string, start_full string")
    new = spark.createDataFrame([("b", "S", "D", "1"), ("a", "S", "D", "2"), ("c", "S", "D", "3"), ("c", "S", "D", "4"), (None, "S", "D", "5"), (None, "S", "D", "6"), ("d", "S", "D", "6")], old.schema)
    got = catalog.added_signals(old, new)
    assert len(got.columns) == 43 and sorted((r.start_full, r.id or "") for r in got.collect()) == [("1", "a"), ("3", "c"), ("5", ""), ("6", "")]
    texts = spark.createDataFrame([("[", None, "x"), (None, "[]", "y"), ('[{"lightning":null}]', '[[null]]', "z")], "a string, b string, id string")
    assert [r.n for r in texts.select((F.size(catalog.stroke_places(F.col("a"))) + F.size(catalog.stroke_places(F.col("b")))).alias("n")).collect()] == [0, 0, 0]


def brute_near(points, strokes, reach_us, reach_m):
    import math

    out = set()
    for i, at, la1, lo1, _ in points:
        for j, time, la2, lo2 in strokes:
            a = math.sin(math.radians(la2 - la1) / 2) ** 2 + math.cos(math.radians(la1)) * math.cos(math.radians(la2)) * math.sin(math.radians(lo2 - lo1) / 2) ** 2
            if abs(time - at) <= reach_us and 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(a))) <= reach_m:
                out.add((i, j))
    return out


@pytest.mark.parametrize("reach_m", [3e5, 8e5, 5e6, 2.1e7])
def test_strokes_meet_over_poles_and_date_line(spark, reach_m):
    from sparkburst.operators import lightning

    rng = random.Random(6)
    place = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), -89.9, 90.0]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 182), -180.0, 359.9]))
    points = [(k, rng.randint(0, 4000), *place(), 5e5) for k in range(200)]
    strokes = [(k, rng.randint(0, 4000), *place()) for k in range(200)]
    p = spark.createDataFrame(points, "id long, at long, lat double, lon double, alt double")
    s = spark.createDataFrame(strokes, "sid long, time long, stroke_lat double, stroke_lon double")
    got = [(r.id, r.sid) for r in lightning.near(p, s, 500, reach_m).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(points, strokes, 500, reach_m)


def test_power_law():
    x = np.linspace(1, 50, 40)
    a, b = histogram.power_law_fit(x, 3.0 * x**-1.7)
    assert a == pytest.approx(3.0, rel=1e-6) and b == pytest.approx(-1.7, rel=1e-6)


def test_stream(spark, tmp_path):
    from sparkburst.streaming.light_curves import light_curve_stream

    spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10) AS ts FROM range(60)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in")
    q = light_curve_stream(stream).writeStream.outputMode("append").format("memory").queryName("curve").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["count"] for r in spark.sql("SELECT * FROM curve").collect()) > 40


def test_exploded_points_are_not_broadcast(spark):
    from sparkburst.operators import lightning

    points = spark.range(50).selectExpr("id", "id * 1000 AS at", "CAST(id AS DOUBLE) lat", "CAST(id AS DOUBLE) lon", "550000.0D alt")
    strokes = spark.range(50).selectExpr("id AS sid", "id * 1000 AS time", "CAST(id AS DOUBLE) stroke_lat", "CAST(id AS DOUBLE) stroke_lon")
    found = lightning.near(points, strokes, 10_000, 800_000.0)
    assert found.count() > 50 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_remainders_and_records_are_not_folded_row_by_row(spark):
    from sparkburst.functions import packets

    rng = random.Random(4)
    data = [rng.randbytes(8) for _ in range(300)]

    def plain(b):
        crc = 0
        for digit in b.hex()[:15]:
            crc = packets.CRC4[crc ^ int(digit, 16)]
        return crc

    df = spark.createDataFrame([(bytearray(b),) for b in data], "b binary").select("b", packets.crc4(F.col("b")).alias("crc"))
    assert [r.crc for r in df.collect()] == [plain(b) for b in data]
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    made = spark.range(64).select(packets.packed((F.col("id") % 4 * 16), F.col("id") * 67_108_860, F.col("id") * 8321).alias("b"), "id").collect()
    for r in made:
        b = bytes(r.b)
        assert b[:4] == (r.id * 67_108_860).to_bytes(4) and b[7] & 15 == plain(b) and int.from_bytes(b[4:]) >> 6 == r.id * 8321 and b[7] >> 4 & 3 == r.id % 4
    texts = spark.createDataFrame([(None, "x" * 20), (5, None)], "doc_id long, text string")
    assert sorted((r.record, r.kind) for r in packets.records(texts).collect()) == [(0, "error"), (0, "short"), (1, "error"), (2, "short")]


def test_candidates_of_one_second_are_judged_once(spark):
    x = registry._packets(spark, "/root/testdata/sf0.001")
    one = registry._asked(x)
    many = one.unionByName(one.withColumn("id", F.col("id") + 1_000_000)).unionByName(one.withColumn("id", F.col("id") + 2_000_000))
    found = saturation.saturated_boxes(many, registry._engineering(x), registry._science(x))
    got = {(r.id, r.box): r.saturated for r in found.collect()}
    assert len(got) == 3 * one.count() * 3 and len(set(got.values())) == 2 and all(got[i, b] == got[i % 1_000_000, b] for i, b in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "pack" in line]
    assert windows and all("id#" not in line.rsplit("], [", 2)[1] for line in windows)


def test_share_of_a_window_against_all_pairs(spark):
    """Places at poles and at the date line, one place often, strokes that overtake each other, duplicates, nulls."""
    from sparkburst.operators import lightning

    rng = random.Random(5)
    tolerance, window, reach = 2_000, 20_000_000, 800_000.0
    half = tolerance + 1_000_000 + window // 2
    spots = [(89.5, 10.0), (-89.9, -170.0), (0.0, 179.9), (0.0, -179.9), (45.0, 400.0), (61.0, 0.0)]
    place = lambda: rng.choice(spots) if rng.random() < 0.6 else (rng.uniform(-90, 90), rng.uniform(-360, 720))
    shifted = lambda p: (max(-90.0, min(90.0, p[0] + rng.uniform(-9, 9))), p[1] + rng.uniform(-20, 20))
    # Some times lie within light's way of the windows' edges, so that arrivals there are out of order.
    strokes = [(k, rng.choice([-half, 0, half]) + rng.randrange(-1_500, 1_500) if k % 2 else rng.randrange(-3 * half, 3 * half), *shifted(place())) for k in range(1500)]
    strokes += strokes[:20] + [(-1, None, 0.0, 0.0), (-2, 0, None, 0.0), (-3, 0, 0.0, None)]
    points = [(k, rng.choice([0, 1, -7, 2 * half]) if k % 2 else rng.randrange(-3 * half, 3 * half), *place(), rng.choice([550_000.0, 400_000.0])) for k in range(400)]
    points += [(1000, None, 0.0, 0.0, 1.0), (1001, 0, None, 0.0, 1.0), (1002, 0, 0.0, None, 1.0), (1003, 0, 0.0, 179.9, None), (None, 0, 0.0, 179.9, 550_000.0)]

    def share(at, lat, lon, alt):
        spans, total, end = [], 0.0, at - half
        for _, time, y, x in strokes:
            if None in (time, y, x) or abs(time - at) > half:
                continue
            h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
            d = 2 * geo.EARTH_M * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))
            if d <= reach:
                a, b = geo.EARTH_M + alt, geo.EARTH_M + geo.LIGHTNING_M
                seen = time + math.floor(math.sqrt(a * a + b * b - 2 * a * b * math.cos(d / geo.EARTH_M)) / geo.LIGHT_M_S * 1e9 + 0.5) / 1000
                spans.append((seen - tolerance, seen + tolerance))
        for a, b in sorted(spans):
            a, b = max(a, end), min(b, at + half)
            if b > a:
                total, end = total + b - a, b
        return total / (2.0 * half)

    want = {p[0]: 0.0 if None in p else share(*p[1:]) for p in points}
    p = spark.createDataFrame(points, "id long, at long, lat double, lon double, alt double")
    s = spark.createDataFrame(strokes, "sid long, time long, stroke_lat double, stroke_lon double")
    found = lightning.coincidence(p, s, tolerance, reach, window)
    got = found.collect()
    assert len(got) == len(points) and all(r.probability == pytest.approx(want[r.id], abs=1e-10) for r in got)
    assert sum(v > 0 for v in want.values()) > 300
    # Pairs are never rows: nothing is joined, and all that is dealt out is points and strokes.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert lightning.coincidence(p.where("id < 0"), s, tolerance, reach, window).count() == 0
    assert {r.probability for r in lightning.coincidence(p, s.where("sid < -9"), tolerance, reach, window).collect()} == {0.0}
