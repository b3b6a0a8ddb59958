"""Every query of the engine's own operators over the driver's tables, with SQL that gives the same rows.

Photon events, trajectories, strokes and signals are derived from `events` and `orders` by integer arithmetic, so that
both engines see the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkburst.functions import clock, geo, packets, poisson, solar
from sparkburst.operators import catalog, gti, histogram, lightning, saturation, scan, trajectory
from sparkburst.operators import events as E
from sparkburst.plans import mission, search
from sparkburst.sources import archive, fits, signals, store
from sparkburst.sources import files as paths

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}
START, DAY_US = 1_704_067_200_000_000, 86_400_000_000
SPAN = 30 * DAY_US


def query(sql: str | None):
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def photons(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", t.alias("t"), (F.col("user_id") % 256).alias("channel"), (F.col("event_id") * 37 % 150).alias("pulse_width"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("event_type"), (F.col("user_id") % 18).alias("det_id"), (F.col("user_id") % 4).alias("mission"), (F.col("event_id") * 7919 % 262144).alias("acd"), "user_id", "value", F.col("event_type").alias("kind"), "props")


PHOTONS = """photons AS (SELECT event_id, epoch_us(ts) t, user_id % 256 channel, event_id * 37 % 150 pulse_width, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END event_type,
 user_id % 18 det_id, user_id % 4 mission, event_id * 7919 % 262144 acd, user_id, value, event_type kind, props FROM events)"""


def signal_rows(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    x = F.col("o_orderkey")
    return o.select(
        x.alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("start_full"),
        F.col("o_custkey").alias("c"), F.pow(F.lit(10.0), (x * 13 % 140 - 120) / 10.0).alias("false_positive_per_year"), (F.greatest(F.lit(0), x % 5 - 2)).alias("associated_lightning_count"),
        ((x * 31 % 1000) / 1000.0).alias("coincidence_probability"), (x * 17 % 997 + 3).alias("count"), ((x * 11 % 3600) / 10.0).alias("longitude"), ((x * 3 % 860) / 10.0 - 43.0).alias("latitude"),
    )


SIGNALS = """signals AS (SELECT o_orderkey id, epoch_us(o_orderdate) t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') start_full, o_custkey c, pow(10.0, (o_orderkey * 13 % 140 - 120) / 10.0) false_positive_per_year,
 greatest(0, o_orderkey % 5 - 2) associated_lightning_count, (o_orderkey * 31 % 1000) / 1000.0 coincidence_probability, o_orderkey * 17 % 997 + 3 "count", (o_orderkey * 11 % 3600) / 10.0 longitude, (o_orderkey * 3 % 860) / 10.0 - 43.0 latitude FROM orders)"""


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: for few bytes with much work each, which a scan leaves in one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def per_value(rows: DataFrame, keys: list[str], *values) -> DataFrame:
    """rows with values that depend on keys alone: found once for each distinct key, then joined; null keys meet null keys."""
    named = {c: f"__{c}" for c in keys}
    once = spread(rows.select(*[F.col(c).alias(n) for c, n in named.items()]).distinct()).select(*named.values(), F.explode(F.array(F.struct(*[v.alias(n) for n, v in values]))).alias("__v"))
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()])
    return rows.join(once.select(*named.values(), "__v.*"), met).drop(*named.values())


def r(c, n: int = 9):
    return F.round(c, n)


def packets_fold_sql(digits: str) -> str:
    """The remainder of the first 15 half-bytes in a list, in SQL."""
    table = "[" + ", ".join(map(str, packets.CRC4)) + "]"
    out = "0"
    for j in range(1, 16):
        out = f"{table}[xor(CAST({out} AS INTEGER), CAST({digits}[{j}] AS INTEGER)) + 1]"
    return out


# ---- light curves and the scan -------------------------------------------------------------------------------------
@query(f"WITH {PHOTONS}, b AS (SELECT range bin FROM range({SPAN // 21_600_000_000})) SELECT b.bin, count(p.t) AS count FROM b LEFT JOIN photons p ON p.t >= {START} AND p.t < {START + SPAN} AND (p.t - {START}) // 21600000000 = b.bin GROUP BY 1")
def light_curve(s, d):
    return histogram.light_curve(photons(s, d), START, START + SPAN, 21_600_000_000)


def _config(rows: DataFrame) -> scan.ScanConfig:
    low, high, n = rows.agg(F.min("t"), F.max("t"), F.count("*")).first()
    gap = (high - low) // n * 4
    return scan.ScanConfig(0, 4 * gap, 400 * gap, 16 * gap, 1e-3 * poisson.YEAR_S / (4 * gap / 1e6), 5)


#: Mean gaps in a chunk, the stand-in for an hour's file: about as many events, however many the table holds.
_CHUNK_GAPS = 2000


def _chunk(config: scan.ScanConfig) -> tuple:
    """(chunk, start, stop) of a photon: its mission and its stretch of time."""
    width = config.max_duration // 4 * _CHUNK_GAPS
    number = F.floor((F.col("t") - START) / width).cast("long")
    return F.col("mission") * 1_000_000 + number, F.lit(START) + number * width, F.lit(START) + (number + 1) * width


def _spanned(s, d) -> tuple[DataFrame, scan.ScanConfig]:
    p = photons(s, d)
    config = _config(p)
    chunk, start, stop = _chunk(config)
    return p.select(chunk.alias("chunk"), "t", start.alias("start"), stop.alias("stop")), config


# The tail in SQL shares nothing with poisson.py: plain sums of probabilities by lgamma, over the side that is asked.
_PMF = "exp(i * ln(mean) - mean - lgamma(i + 1))"
_TAIL = f"list_sum(list_transform(range(k + 1, k + 61 + CAST(12 * sqrt(mean + k) AS BIGINT)), lambda i: {_PMF}))"
_HEAD = f"list_sum(list_transform(range(greatest(0, k - 61 - CAST(12 * sqrt(mean + k) AS BIGINT)), k + 1), lambda i: {_PMF}))"
_SF = f"CASE WHEN mean = 0 THEN CASE WHEN k = 0 THEN 0.0 ELSE 1.0 END WHEN mean < k + 1 THEN {_TAIL} ELSE 1.0 - {_HEAD} END"
_GAP = f"cfg AS (SELECT (max(t) - min(t)) // count(*) * 4 g FROM photons), stretch AS (SELECT *, mission * 1000000 + (t - {START}) // (g * {_CHUNK_GAPS}) chunk, {START} + (t - {START}) // (g * {_CHUNK_GAPS}) * (g * {_CHUNK_GAPS}) low FROM photons, cfg)"
_TRIGGERS = f"""{PHOTONS}, {_GAP}, ev AS (SELECT chunk, low, low + g * {_CHUNK_GAPS} high, g, t, row_number() OVER (PARTITION BY chunk ORDER BY t) - 1 rn, count(*) OVER (PARTITION BY chunk) n, min(t) OVER (PARTITION BY chunk) t0 FROM stretch),
 sides AS (SELECT ev.*, count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 200 * g - 1 FOLLOWING) - 1 lt_n, count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 8 * g - 1 FOLLOWING) - 1 lt_h,
   count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 200 * g + 1 PRECEDING) fg_n, count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 8 * g + 1 PRECEDING) fg_h FROM ev WINDOW w AS (PARTITION BY chunk ORDER BY t)),
 edge AS (SELECT chunk, least(count(*) FILTER (t < t0 + 200 * g), any_value(n) - 1) f_n, least(count(*) FILTER (t < t0 + 8 * g), any_value(n) - 1) f_h FROM ev GROUP BY 1),
 pairs AS (SELECT a.chunk, a.t ti, b.t tj, b.rn - a.rn + 1 k, a.g, a.low, a.high, (greatest(f_n, b.lt_n) - greatest(0, a.fg_n - 1)) - (greatest(f_h, b.lt_h) - greatest(0, a.fg_h - 1)) extra FROM sides a JOIN sides b ON a.chunk = b.chunk AND b.rn > a.rn AND b.rn - a.rn + 1 >= 5 AND b.t - a.t < 4 * a.g AND b.t > a.t JOIN edge ON edge.chunk = a.chunk),
 means AS (SELECT *, extra * (tj - ti) / CAST((least(tj + 200 * g, high) - greatest(ti - 200 * g, low)) - (least(tj + 8 * g, high) - greatest(ti - 8 * g, low)) AS DOUBLE) mean FROM pairs),
 tails AS (SELECT *, CASE WHEN mean <= 0 THEN 1.0 ELSE {_SF} END p FROM means),
 trig AS (SELECT *, p * {poisson.YEAR_S} / ((tj - ti) / 1e6) fp FROM tails WHERE p < 1e-3 * (tj - ti) / (4.0 * g))"""


@query(f"WITH {_TRIGGERS} SELECT chunk, ti, tj, CAST(k AS BIGINT) k, round(mean, 9) mean, round(log10(fp), 6) log_fp FROM trig")
def burst_triggers(s, d):
    rows, config = _spanned(s, d)
    return scan.triggers(rows, config).select("chunk", "ti", "tj", "k", r("mean").alias("mean"), r(F.log10("fp"), 6).alias("log_fp"))


_MERGED = """isl AS (SELECT *, sum(new) OVER (PARTITION BY chunk ORDER BY ti, tj ROWS UNBOUNDED PRECEDING) island FROM (SELECT *, CASE WHEN max(tj) OVER (PARTITION BY chunk ORDER BY ti, tj ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= ti THEN 0 ELSE 1 END new FROM trig)),
 best AS (SELECT *, row_number() OVER (PARTITION BY chunk, island ORDER BY fp, ti, tj) o FROM isl),
 cand AS (SELECT chunk, island, min(ti) "start", max(tj) stop, min(tj - ti) bin_min, max(tj - ti) bin_max, max(tj - ti) FILTER (o = 1) bin_best, max(ti) FILTER (o = 1) - min(ti) delay, max(k) FILTER (o = 1) "count", max(mean) FILTER (o = 1) mean, max(fp) FILTER (o = 1) fp FROM best GROUP BY 1, 2)"""


@query(f'WITH {_TRIGGERS}, {_MERGED} SELECT chunk, "start", stop, bin_min, bin_max, bin_best, delay, CAST("count" AS BIGINT) AS count, round(mean, 9) mean, round(log10(fp), 6) log_fp FROM cand')
def burst_search(s, d):
    rows, config = _spanned(s, d)
    found = scan.search(rows, config)
    return found.select("chunk", "start", "stop", "bin_min", "bin_max", "bin_best", "delay", "count", r("mean").alias("mean"), r(F.log10("fp"), 6).alias("log_fp"))


@query(f"""WITH RECURSIVE {_TRIGGERS}, ord AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY ti, tj) n FROM trig), sight AS (SELECT unnest([0.0, 0.5, 2.0])::DOUBLE vision),
 fold AS (SELECT vision, chunk, n, tj reach, tj - ti longest, 1 island FROM ord, sight WHERE n = 1
  UNION ALL SELECT vision, chunk, n, CASE WHEN joined THEN greatest(reach, tj) ELSE tj END, CASE WHEN joined THEN greatest(longest, tj - ti) ELSE tj - ti END, CASE WHEN joined THEN island ELSE island + 1 END
  FROM (SELECT f.vision, f.reach, f.longest, f.island, o.chunk, o.n, o.ti, o.tj, f.reach + greatest(f.longest, o.tj - o.ti) * f.vision >= o.ti joined FROM fold f JOIN ord o ON o.chunk = f.chunk AND o.n = f.n + 1)),
 best AS (SELECT f.vision, f.island, o.*, row_number() OVER (PARTITION BY f.vision, f.chunk, f.island ORDER BY fp, ti, tj) b FROM fold f JOIN ord o ON o.chunk = f.chunk AND o.n = f.n)
 SELECT vision, chunk, min(ti) "start", max(tj) stop, min(tj - ti) bin_min, max(tj - ti) bin_max, max(tj - ti) FILTER (b = 1) bin_best, max(ti) FILTER (b = 1) - min(ti) delay, CAST(max(k) FILTER (b = 1) AS BIGINT) AS count FROM best GROUP BY vision, chunk, island""")
def merged_with_vision(s, d):
    """Triggers merged by sight of none, half and two longest bins."""
    rows, config = _spanned(s, d)
    found = scan.triggers(rows, config)
    out = [scan.merged(found, v).withColumn("vision", F.lit(v)) for v in (0.0, 0.5, 2.0)]
    return reduce(DataFrame.union, out).select("vision", "chunk", "start", "stop", "bin_min", "bin_max", "bin_best", "delay", "count")


@query(f"""WITH {PHOTONS}, {_GAP}, c AS (SELECT chunk, t s, g FROM stretch), m AS (SELECT *, CASE WHEN s - lag(s) OVER w > g OR lead(s) OVER w IS NULL THEN 1 ELSE 0 END cut, lead(s) OVER w IS NULL last FROM c WINDOW w AS (PARTITION BY chunk ORDER BY s)),
 k AS (SELECT *, sum(cut) OVER (PARTITION BY chunk ORDER BY s ROWS UNBOUNDED PRECEDING) grp FROM m), b AS (SELECT *, max(s) OVER p - min(s) OVER p > 3 * g OR count(*) OVER p >= 4 bad FROM k WINDOW p AS (PARTITION BY chunk, grp)) SELECT chunk, s AS "start" FROM b WHERE NOT bad OR last""")
def session_veto(s, d):
    """Every event is a candidate; sessions end at gaps above the mean."""
    p = photons(s, d)
    config = _config(p)
    gap = config.max_duration // 4
    return scan.vetoed(p.select(_chunk(config)[0].alias("chunk"), F.col("t").alias("start")), gap, 3 * gap, 4)


_BUCKET = 21_600_000_000
_VALUES = ["longitude", "latitude", "altitude", "q1", "q2", "q3"]
_STATE = "CAST((user_id * 7) % 360 - 180 AS DOUBLE) longitude, CAST(user_id % 80 - 40 AS DOUBLE) latitude, 500000 + value altitude, (user_id % 16) / 16.0 q1, (user_id % 32) / 32.0 q2, (event_id % 64) / 64.0 q3"


def _path_sql(chunk: str, source: str = "photons") -> str:
    return f"path AS (SELECT chunk, t, {_STATE} FROM (SELECT {chunk} chunk, t, user_id, value, event_id, row_number() OVER (PARTITION BY {chunk}, t // {_BUCKET} ORDER BY t, event_id) o FROM {source}) WHERE o = 1)"


def _orbit(p: DataFrame, chunk) -> DataFrame:
    """The trajectory: one row per chunk and six hours, from the bucket's first event."""
    first = p.groupBy(chunk.alias("chunk"), F.floor(F.col("t") / _BUCKET)).agg(F.min(F.struct("t", "event_id", "user_id", "value")).alias("e"))
    user, event = F.col("e.user_id"), F.col("e.event_id")
    return first.select("chunk", "e.t", ((user * 7) % 360 - 180).cast("double").alias("longitude"), (user % 80 - 40).cast("double").alias("latitude"), (F.lit(500000) + F.col("e.value")).alias("altitude"), ((user % 16) / 16.0).alias("q1"), ((user % 32) / 32.0).alias("q2"), ((event % 64) / 64.0).alias("q3"))


def _hit_sql(points: str, keep: str) -> str:
    """Values at points (chunk, moment) along path, as the text of a chain of common tables that ends in hit."""
    lead = ", ".join(f"lead({v}) OVER w {v}_1" for v in _VALUES)
    at = ", ".join(f"{v} + ({v}_1 - {v}) * ((moment - t) / CAST(t_1 - t AS DOUBLE)) {v}" for v in _VALUES)
    return f"seg AS (SELECT *, lead(t) OVER w t_1, {lead}, row_number() OVER w n FROM path WINDOW w AS (PARTITION BY chunk ORDER BY t)), hit AS (SELECT {keep}, {at} FROM {points} p JOIN seg s ON p.chunk = s.chunk AND (s.t < p.moment OR s.n = 1) AND s.t_1 >= p.moment QUALIFY row_number() OVER (PARTITION BY {keep} ORDER BY s.t DESC) = 1)"


_ROUNDED = "round(longitude, 6) longitude, round(latitude, 6) latitude, round(altitude, 4) altitude, round(q1, 6) q1, round(q2, 6) q2, round(q3, 6) q3"


def _rounded() -> list:
    return [r(F.col(v), 4 if v == "altitude" else 6).alias(v) for v in _VALUES]


@query(f"WITH {PHOTONS}, {_path_sql('mission')}, pts AS (SELECT event_id id, mission chunk, t + 1 AS moment FROM photons), {_hit_sql('pts', 'p.id')} SELECT id, {_ROUNDED} FROM hit")
def interpolated_positions(s, d):
    """Positions and attitudes at every event, from the whole trajectory of its mission."""
    p = photons(s, d)
    points = p.select(F.col("event_id").alias("id"), F.col("mission").alias("chunk"), (F.col("t") + 1).alias("at"))
    width = max(1, _config(p).max_duration // 4 * _CHUNK_GAPS)
    return trajectory.interpolated(points, _orbit(p, F.col("mission")), _VALUES, width=width).select("id", *_rounded())


@query(f"WITH {PHOTONS}, {_GAP}, {_path_sql('chunk', 'stretch')} SELECT chunk, t, longitude FROM path WHERE t BETWEEN {START + 10 * DAY_US} AND {START + 12 * DAY_US}")
def trajectory_window(s, d):
    p = photons(s, d)
    return trajectory.window(_orbit(p, _chunk(_config(p))[0]), START + 11 * DAY_US, DAY_US).select("chunk", "t", "longitude")


@query(f"""WITH {_TRIGGERS}, {_MERGED}, {_path_sql("chunk", "stretch")}, m AS (SELECT *, CASE WHEN "start" - lag("start") OVER w > 36000000000 OR lead("start") OVER w IS NULL THEN 1 ELSE 0 END cut, lead("start") OVER w IS NULL last FROM cand WINDOW w AS (PARTITION BY chunk ORDER BY "start")),
 grp AS (SELECT *, sum(cut) OVER (PARTITION BY chunk ORDER BY "start" ROWS UNBOUNDED PRECEDING) session FROM m), judged AS (SELECT *, max("start") OVER p - min("start") OVER p > 108000000000 OR count(*) OVER p >= 5 bad FROM grp WINDOW p AS (PARTITION BY chunk, session)),
 pts AS (SELECT chunk, "start", stop, "count", "start" + bin_best // 2 moment FROM judged WHERE NOT bad OR last), {_hit_sql("pts", 'p.chunk, p."start", p.stop, p."count"')}
 SELECT chunk, "start", stop, CAST("count" AS BIGINT) AS count, {_ROUNDED} FROM hit""")
def located_bursts(s, d):
    """The whole chain: scan, islands, session veto, then position and attitude at the peak from the chunk's own trajectory."""
    events, config = _spanned(s, d)
    found = scan.vetoed(scan.search(events, config), 36_000_000_000, 108_000_000_000, 5).withColumn("at", F.col("start") + F.floor(F.col("bin_best") / 2))
    path = _orbit(photons(s, d), _chunk(config)[0])
    return trajectory.interpolated(found, path, _VALUES).select("chunk", "start", "stop", "count", *_rounded())


# ---- events ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {PHOTONS} SELECT event_id, CASE WHEN pulse_width < 75 THEN 'NaI' ELSE 'CsI' END scintillator, event_type = 1 is_am241, CASE WHEN channel < 20 THEN channel + 256 ELSE channel END channel, bit_count(acd) AS n_acd, (acd & 1) = 1 acd_first,
 pulse_width >= 75 AND event_type <> 1 AND (channel < 20 OR channel >= 38) keep, pulse_width >= 75 AND event_type = 0 AND (channel < 20 OR channel >= 38) keep_strict, 0 AS grp FROM photons""".replace("bit_count(acd)", "CAST(bit_count(acd) AS BIGINT)"))
def event_columns(s, d):
    p = photons(s, d)
    flags = packets.acd_flags(F.col("acd"))
    args = (F.col("pulse_width"), F.col("event_type"), F.col("channel"))
    return p.select("event_id", E.scintillator(args[0]).alias("scintillator"), (F.col("event_type") == 1).alias("is_am241"), E.unfolded_channel(F.col("channel")).alias("channel"), F.size(F.filter(flags, lambda x: x)).cast("long").alias("n_acd"), flags[0].alias("acd_first"), E.kept_hxmt(*args).alias("keep"), E.kept_analysis(*args).alias("keep_strict"), F.lit(0).alias("grp"))


@query(f"WITH {PHOTONS} SELECT event_id, t - {START + 9 * DAY_US} AS offset_us FROM photons WHERE abs(t - {START + 9 * DAY_US}) < {DAY_US // 4}")
def events_around(s, d):
    return E.around(photons(s, d), "t", START + 9 * DAY_US, DAY_US // 4).select("event_id", F.col("offset").alias("offset_us"))


@query(f"WITH {PHOTONS}, {_GAP} SELECT t, CAST(user_id % 3 + 1 AS INTEGER) det_id, row_number() OVER (PARTITION BY chunk ORDER BY t, user_id % 3) AS place FROM stretch")
def merged_streams(s, d):
    p = photons(s, d)
    chunk = _chunk(_config(p))[0].alias("chunk")
    both = E.merged_streams([p.where(F.col("user_id") % 3 == k).select("t", chunk) for k in range(3)])
    return both.select("t", "det_id", F.row_number().over(Window.partitionBy("chunk").orderBy("t", "det_id")).cast("long").alias("place"))


@query(f"WITH {PHOTONS} SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM photons")
def parsed_props(s, d):
    return photons(s, d).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(f"WITH {PHOTONS} SELECT mission, count(*) n, min(t) first, max(t) last, sum(CASE WHEN det_id = 0 THEN 1 ELSE 0 END)::BIGINT n_det0 FROM photons GROUP BY 1")
def group_counts(s, d):
    return photons(s, d).groupBy("mission").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("det_id") == 0).alias("n_det0"))


# ---- scalar functions --------------------------------------------------------------------------------------------------
_TAILS_X = "x AS (SELECT event_id, (event_id % 101) * (event_id % 101) * (event_id % 101) / 100.0 mean, (event_id % 101) * (event_id % 101) * (event_id % 101) * (event_id % 7 + 2) // 400 + event_id % 11 k FROM events)"
_LOG10 = "CASE WHEN {0} > 1e-250 THEN round(log10({0}), 6) END"


@query(f"""WITH {_TAILS_X}, y AS (SELECT mean, k, {_SF} sf FROM (SELECT DISTINCT mean, k FROM x)), z AS (SELECT event_id, sf, CASE WHEN x.mean <= 0 THEN 1.0 ELSE sf END search, sf * {poisson.YEAR_S} / (x.k + 1) per, x.k FROM x JOIN y ON x.mean = y.mean AND x.k = y.k)
 SELECT event_id, round(sf, 6) sf, {_LOG10.format("sf")} log_sf, round(search, 6) search_sf, {_LOG10.format("per")} log_per_year, round(20.0 * k / {poisson.YEAR_S}, 12) threshold FROM z""")
def poisson_tails(s, d):
    """Means up to 10,000 and counts of half to twice the mean."""
    n = F.col("event_id") % 101
    x = s.read.parquet(f"{d}/events.parquet").select("event_id", (n * n * n / 100.0).alias("mean"), (F.floor(n * n * n * (F.col("event_id") % 7 + 2) / 400) + F.col("event_id") % 11).alias("k"))
    mean, k = F.col("__mean"), F.col("__k")
    x = per_value(x, ["mean", "k"], ("sf", poisson.sf(mean, k)), ("search", poisson.search_sf(mean, k))).withColumn("per", poisson.per_year(F.col("sf"), F.col("k") + 1))
    log = lambda c: F.when(F.col(c) > 1e-250, r(F.log10(c), 6))
    return x.select("event_id", r("sf", 6).alias("sf"), log("sf").alias("log_sf"), r("search", 6).alias("search_sf"), log("per").alias("log_per_year"), r(poisson.threshold(20.0, F.col("k")), 12).alias("threshold"))


@query("""WITH x AS (SELECT event_id, event_id % 37 a, event_id % 7 b FROM events), pq AS (SELECT a, b, (a + 1) * (a + 1) / 4.0 mean, pow(10.0, -(b + 1)) p FROM (SELECT DISTINCT a, b FROM x)),
 y AS (SELECT *, list_transform(range(0, 600), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-mean + i * ln(mean) - lgamma(i + 1))))) c FROM pq), z AS (SELECT a, b, CAST(len(list_filter(c, lambda v: v < 1.0 - p)) AS BIGINT) AS k FROM y)
 SELECT event_id, k FROM x JOIN z USING (a, b)""")
def poisson_quantiles(s, d):
    """A quantile for every event, means from 1/4 to 342."""
    i = F.col("event_id")
    x = s.read.parquet(f"{d}/events.parquet").select("event_id", (i % 37 + 1).alias("a"), (i % 7 + 1).alias("b"))
    a = F.col("__a")
    return per_value(x, ["a", "b"], ("k", poisson.isf(F.pow(F.lit(10.0), -F.col("__b")), a * a / 4.0))).select("event_id", "k")


def _dist(la1: str, lo1: str, la2: str, lo2: str) -> str:
    a = f"(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * pow(sin(radians({lo2} - {lo1}) / 2), 2))"
    return f"(2 * {geo.EARTH_M} * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))))"


def _arrival(dist: str, alt: str) -> str:
    a, b = f"({geo.EARTH_M} + {alt})", f"{geo.EARTH_M + geo.LIGHTNING_M}"
    return f"round(sqrt({a} * {a} + {b} * {b} - 2 * {a} * {b} * cos({dist} / {geo.EARTH_M})) / {geo.LIGHT_M_S} * 1e9)"


_INSIDE = " + ".join(f"CASE WHEN ({float(y1)} > latitude) <> ({float(y2)} > latitude) AND longitude < (latitude - {y1}) * ({(x2 - x1) / (y2 - y1)!r}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(geo.ANOMALY[:-1], geo.ANOMALY[1:], strict=True) if y1 != y2)


@query(f"WITH {SIGNALS} SELECT id, round({_dist('latitude', 'longitude', '10.0', '20.0')}, 3) metres, CAST({_arrival('800000.0', '(500000.0 + id % 1000)')} AS BIGINT) arrival, round(pow(sin(latitude / 2), 2), 9) hav, round((id % 900) / 6371.0 * {180 / math.pi!r}, 9) degrees, CASE WHEN longitude < 330 THEN longitude ELSE longitude - 360 END shown, ({_INSIDE}) % 2 = 1 inside FROM signals")
def geography(s, d):
    x = signal_rows(s, d)
    lat, lon = F.col("latitude"), F.col("longitude")
    return x.select("id", r(geo.distance(lat, lon, F.lit(10.0), F.lit(20.0)), 3).alias("metres"), geo.arrival_ns(F.lit(800_000.0), 500_000.0 + F.col("id") % 1000, F.lit(geo.LIGHTNING_M)).alias("arrival"), r(geo.haversine(lat)).alias("hav"), r(geo.radius_degrees(F.col("id") % 900)).alias("degrees"), geo.display_longitude(lon).alias("shown"), geo.in_polygon(lon, lat).alias("inside"))


_SOLAR = f"""WITH {SIGNALS}, a AS (SELECT *, make_timestamp(t) ts, (t % {DAY_US}) / 1e6 sod FROM signals), b AS (SELECT *, dayofyear(ts) doy, year(ts) - 1985 y, ((sod + longitude * 240) % 86400 + 86400) % 86400 mst FROM a),
 c AS (SELECT *, 2 * {math.pi!r} * (doy - (79.6764 + 0.2422 * y - floor(0.25 * y))) / 365.2422 th FROM b),
 e AS (SELECT *, 0.3723 + 23.2567 * sin(th) + 0.1149 * sin(2 * th) - 0.1712 * sin(3 * th) - 0.7580 * cos(th) + 0.3656 * cos(2 * th) + 0.0201 * cos(3 * th) dec, 0.0028 - 1.9857 * sin(th) + 9.9059 * sin(2 * th) - 7.0924 * cos(th) - 0.6882 * cos(2 * th) eot, floor(mst / 60) / 4 - 180 ha FROM c),
 f AS (SELECT *, acos(greatest(-1.0, least(1.0, sin(radians(latitude)) * sin(radians(dec)) + cos(radians(latitude)) * cos(radians(dec)) * cos(radians(ha))))) z FROM e)
 SELECT id, CAST(doy AS INTEGER) doy, round(th, 9) theta, round(dec, 9) declination, round(eot, 9) equation, round(mst, 6) mean_time, round(((mst + eot * 60) % 86400 + 86400) % 86400, 6) apparent_time, round(ha, 9) hour_angle, round(degrees(z), 6) zenith, round(degrees(asin(greatest(-1.0, least(1.0, -sin(radians(ha)) * cos(radians(dec)) / sin(z))))), 4) azimuth, round(abs(latitude - dec), 9) noon FROM f"""


@query(_SOLAR)
def solar_geometry(s, d):
    x = signal_rows(s, d)
    t, lat, lon = F.col("t"), F.col("latitude"), F.col("longitude")
    return x.select("id", solar.day_of_year(t).alias("doy"), r(solar.year_angle(t)).alias("theta"), r(solar.declination(t)).alias("declination"), r(solar.equation_of_time(t)).alias("equation"), r(solar.mean_solar_time(t, lon), 6).alias("mean_time"), r(solar.apparent_solar_time(t, lon), 6).alias("apparent_time"), r(solar.hour_angle(t, lon)).alias("hour_angle"), r(solar.zenith(t, lat, lon), 6).alias("zenith"), r(solar.azimuth(t, lat, lon), 4).alias("azimuth"), r(solar.noon_zenith(t, lat)).alias("noon"))


_LEAPS = " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in clock.HXMT.leaps)


@query(f"WITH x AS (SELECT o_orderkey id, 1325376000000000 + (o_orderkey * 7919 % 200000) * 1000000000 + 217000 u FROM orders) SELECT id, round((u - 1325376000000000 + ({_LEAPS}) * 1000000) / 1e6, 6) met, round((u - 1483228800000000) / 1e6, 6) met_svom, u AS back FROM x")
def mission_clock(s, d):
    x = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.lit(1325376000000000) + (F.col("o_orderkey") * 7919 % 200000) * 1000000000 + 217000).alias("u"))
    met = clock.met_from_utc(F.col("u"), clock.HXMT)
    return x.select("id", r(met, 6).alias("met"), r(clock.met_from_utc(F.col("u"), clock.SVOM), 6).alias("met_svom"), clock.utc_from_met(met, clock.HXMT).alias("back"))


_NANOS = "(epoch_us(ts) * 1000 + event_id * 7919 % 1000 * CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END)"


@query(f"""WITH n AS (SELECT event_id id, {_NANOS} ns FROM events), p AS (SELECT *, ns % 1000000000 part FROM n)
 SELECT id, ns, strftime(make_timestamp(ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN part = 0 THEN '' WHEN part % 1000000 = 0 THEN '.' || substr(lpad(CAST(part AS VARCHAR), 9, '0'), 1, 3) WHEN part % 1000 = 0 THEN '.' || substr(lpad(CAST(part AS VARCHAR), 9, '0'), 1, 6) ELSE '.' || lpad(CAST(part AS VARCHAR), 9, '0') END || 'Z' AS text,
 CAST((ns - {clock.micros(clock.HXMT.epoch)} * 1000) // 1000000000 + {len(clock.HXMT.leaps)} AS VARCHAR) || '.' || lpad(CAST(part AS VARCHAR), 9, '0') AS met, ns AS back FROM p""")
def nanosecond_instants(s, d):
    """Every event's instant with nanoseconds: to a text and back, to the mission's clock as an exact decimal and back."""
    e = s.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.when(i % 5 == 0, 0).otherwise(i * 7919 % 1000)
    x = e.select(i.alias("id"), clock.text_of_nanos(ns).alias("text")).withColumn("ns", clock.nanos_of_text(F.col("text")))
    met = clock.met_of_nanos(F.col("ns"), clock.HXMT)
    return x.select("id", "ns", "text", met.cast("string").alias("met"), clock.nanos_of_met(met, clock.HXMT).alias("back"))


@query(f"""WITH b AS (SELECT event_id, event_id * 2654435761 % 4294967296 hi, event_id * 40503 % 4294967296 lo, event_id % 3 kind FROM events), n AS (SELECT *, list_transform(range(0, 8), lambda i: hi // CAST(pow(16, 7 - i) AS BIGINT) % 16) || list_transform(range(0, 8), lambda i: lo // CAST(pow(16, 7 - i) AS BIGINT) % 16) d FROM b),
 c AS (SELECT *, {packets_fold_sql("d")} crc FROM n), v AS (SELECT *, CASE WHEN kind = 0 THEN d[16] ELSE crc END low FROM c),
 k AS (SELECT *, CASE WHEN crc <> low THEN 'error' WHEN d[15] % 4 IN (0, 2) THEN 'event' WHEN d[15] % 4 = 1 THEN 'second' ELSE 'error' END name, d[10] % 2 * 262144 + (d[11] * 16 + d[12]) * 1024 + (d[13] * 16 + d[14]) * 4 + d[15] // 4 tick FROM v)
 SELECT event_id, CAST(crc AS BIGINT) crc, CAST((d[11] * 16 + d[12]) % 128 * 16777216 + (d[9] * 16 + d[10]) * 65536 + (d[7] * 16 + d[8]) * 256 + d[5] * 16 + d[6] AS BIGINT) bus, name kind, CASE WHEN name = 'second' THEN hi END stime, CASE WHEN name <> 'error' THEN CAST(tick AS BIGINT) END ptime FROM k""")
def packet_fields(s, d):
    """A record of 8 bytes made from every event; two thirds have a right remainder."""
    x = s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(*[F.lpad(F.hex(F.col("event_id") * m % 4294967296), 8, "0") for m in (2654435761, 40503)]).alias("h"))
    right = F.concat(F.substring("h", 1, 15), F.hex(packets.crc4(F.unhex("h"))))
    x = x.select("event_id", F.unhex(F.when(F.col("event_id") % 3 == 0, F.col("h")).otherwise(right)).alias("b"))
    out = x.select("event_id", packets.crc4(F.col("b")).alias("crc"), packets.bus_time(F.col("b")).alias("bus"), packets.record(F.col("b")).alias("r"))
    return out.select("event_id", "crc", "bus", "r.kind", "r.stime", "r.ptime")


@query(None)
def packet_fields_all(s, d):
    """Every 8-byte record of every text, numbered from 0. Bytes left at the end, and empty and null texts, give one row of kind short without fields."""
    return packets.records(spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")))


@query(f"WITH {SIGNALS} SELECT id, CAST(substr(start_full, 12, 2) AS INTEGER) + CAST(substr(start_full, 15, 2) AS INTEGER) / 60.0 AS hour, CAST(month(make_timestamp(t)) AS INTEGER) AS month, strftime(make_timestamp(t), 'Y%Y%m/%Y%m%d-') || lpad(CAST(date_diff('day', DATE '2017-06-15', CAST(make_timestamp(t) AS DATE)) + 1 AS VARCHAR), 4, '0') AS folder FROM (SELECT id, start_full, t + 757382400000000 AS t FROM signals)".replace("AS hour", "AS hour_of_day"))
def path_and_time_texts(s, d):
    x = signal_rows(s, d).withColumn("t", F.col("t") + 757382400000000)  # 24 years on
    ts = F.timestamp_micros("t")
    return x.select("id", solar.hour_of_time(F.substring("start_full", 12, 8)).alias("hour_of_day"), F.month(ts).alias("month"), archive.folder_1k(ts).alias("folder"))


# ---- lightning ---------------------------------------------------------------------------------------------------------
_STROKES = "strokes AS (SELECT event_id sid, t time, CAST(user_id % 80 - 40 AS DOUBLE) stroke_lat, CAST(user_id * 7 % 360 - 180 AS DOUBLE) stroke_lon FROM photons WHERE kind = 'purchase')"
_POINTS = "pts AS (SELECT event_id id, t + 1000 AS moment, CAST(user_id % 80 - 40 AS DOUBLE) + 1 lat, CAST(user_id * 7 % 360 - 180 AS DOUBLE) lon, 550000.0 alt FROM photons)"
_TOL, _REACH = 3_600_000_000, 800_000.0


def _strokes(p: DataFrame) -> DataFrame:
    return p.where("kind = 'purchase'").select(F.col("event_id").alias("sid"), F.col("t").alias("time"), (F.col("user_id") % 80 - 40).cast("double").alias("stroke_lat"), (F.col("user_id") * 7 % 360 - 180).cast("double").alias("stroke_lon"))


def _points(p: DataFrame) -> DataFrame:
    return p.select(F.col("event_id").alias("id"), (F.col("t") + 1000).alias("at"), ((F.col("user_id") % 80 - 40).cast("double") + 1).alias("lat"), (F.col("user_id") * 7 % 360 - 180).cast("double").alias("lon"), F.lit(550000.0).alias("alt"))


@query(f"WITH {PHOTONS}, {_STROKES}, {_POINTS}, m AS (SELECT *, {_dist('lat', 'lon', 'stroke_lat', 'stroke_lon')} dist FROM pts JOIN strokes ON time BETWEEN moment - {_TOL + 1000000} AND moment + {_TOL + 1000000}) SELECT id, sid, round(dist, 3) distance FROM m WHERE dist <= {_REACH} AND abs(time - (moment - {_arrival('dist', 'alt')} / 1000)) <= {_TOL}")
def lightning_associations(s, d):
    """Every event is a point, every purchase a stroke."""
    p = photons(s, d)
    return lightning.associated(_points(p), _strokes(p), _TOL, _REACH).select("id", "sid", r("distance", 3).alias("distance"))


_HALF = _TOL + 1_000_000 + 43_200_000_000


@query(f"""WITH {PHOTONS}, {_STROKES}, {_POINTS}, m AS (SELECT *, {_dist('lat', 'lon', 'stroke_lat', 'stroke_lon')} dist FROM pts JOIN strokes ON time BETWEEN moment - {_HALF} AND moment + {_HALF}), w AS (SELECT id, moment, time + {_arrival('dist', 'alt')} / 1000 - {_TOL} a, time + {_arrival('dist', 'alt')} / 1000 + {_TOL} b FROM m WHERE dist <= {_REACH}),
 n AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END new FROM w), i AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) k FROM n), u AS (SELECT id, moment, k, least(max(b), moment + {_HALF}) - greatest(min(a), moment - {_HALF}) len FROM i GROUP BY 1, 2, 3)
 SELECT pts.id, round(coalesce(sum(len) FILTER (len > 0), 0) / {2.0 * _HALF}, 9) probability FROM pts LEFT JOIN u ON pts.id = u.id GROUP BY 1""")
def coincidence_probability(s, d):
    p = photons(s, d)
    return lightning.coincidence(_points(p), _strokes(p), _TOL, _REACH, 86_400_000_000).select("id", r("probability").alias("probability"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, event_id AS sid, CASE WHEN value < 20 THEN NULL ELSE value END AS energy FROM events WHERE event_type = 'purchase' AND strftime(ts, '%Y-%m-%d %H:%M:%S.%f') BETWEEN '2024-01-05 00:00:00.000000' AND '2024-01-09 12:00:00.000000'")
def strokes_between(s, d):
    e = s.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), F.col("event_id").alias("sid"), F.when(F.col("value") >= 20, F.col("value")).alias("energy"))
    return lightning.strokes_between(rows, "2024-01-05 00:00:00.000000", "2024-01-09 12:00:00.000000")


# ---- catalogue and histograms ------------------------------------------------------------------------------------------
_ACC = "acc AS (SELECT * FROM signals WHERE start_full < '1997-01-01' AND (false_positive_per_year <= 1e-5 OR false_positive_per_year <= 1 AND associated_lightning_count > 0))"


def _accepted(s, d) -> DataFrame:
    return catalog.accepted(signal_rows(s, d), "1997-01-01")


@query(f"WITH {SIGNALS}, {_ACC} SELECT id, start_full, associated_lightning_count FROM acc")
def accepted_signals(s, d):
    return _accepted(s, d).select("id", "start_full", "associated_lightning_count")


@query(f"WITH {SIGNALS}, {_ACC} SELECT count(*) n, count(*) FILTER (associated_lightning_count > 0) n_with, count(*) FILTER (associated_lightning_count = 0) n_without, count(*) FILTER (month(make_timestamp(t)) IN (6, 7, 8)) n_summer, count(*) FILTER (month(make_timestamp(t)) IN (12, 1, 2)) n_winter, min(\"count\") least, max(\"count\") most FROM acc")
def signal_counts(s, d):
    m, a = F.month(F.timestamp_micros("t")), F.col("associated_lightning_count")
    return _accepted(s, d).agg(F.count("*").alias("n"), F.count_if(a > 0).alias("n_with"), F.count_if(a == 0).alias("n_without"), F.count_if(m.isin(6, 7, 8)).alias("n_summer"), F.count_if(m.isin(12, 1, 2)).alias("n_winter"), F.min("count").alias("least"), F.max("count").alias("most"))


@query(f"WITH {SIGNALS} SELECT id FROM signals WHERE start_full = (SELECT max(start_full) FROM signals) ORDER BY id LIMIT 1")
def point_lookup(s, d):
    x = signal_rows(s, d).withColumns({"satellite": F.lit("a"), "detector": F.lit("b")})
    last = x.agg(F.max("start_full")).first()[0]
    return catalog.point(x, last, "a", "b").orderBy("id").limit(1).select("id")


def _bins_sql(n: int, x: str, source: str, value: str = "count(*)", name: str = "count") -> str:
    return f"SELECT b.range bin, coalesce(v, 0) AS {name} FROM range({n}) b LEFT JOIN (SELECT {x} bin, {value} v FROM {source} GROUP BY 1) h ON h.bin = b.range"


@query(f"WITH {SIGNALS}, {_ACC} " + _bins_sql(36, "CAST(least(floor((longitude - 0.0) / 10.0), 35) AS BIGINT)", "acc WHERE longitude BETWEEN 0 AND 360"))
def longitude_histogram(s, d):
    return histogram.histogram(_accepted(s, d), histogram.linear_bin(F.col("longitude"), 0.0, 360.0, 36), 36)


_LOG = "CAST(least(floor((log10(false_positive_per_year) - (-12.05)) / (13.35 / 200)), 199) AS BIGINT)"


def _fp_bin():
    return histogram.linear_bin(F.log10("false_positive_per_year"), -12.05, 1.3, 200)


@query(f"WITH {SIGNALS} " + _bins_sql(200, _LOG.replace("13.35 / 200", "0.06675"), "signals WHERE log10(false_positive_per_year) BETWEEN -12.05 AND 1.3"))
def rate_histogram(s, d):
    return histogram.histogram(signal_rows(s, d), _fp_bin(), 200)


@query(f"WITH {SIGNALS} " + _bins_sql(200, _LOG.replace("13.35 / 200", "0.06675"), "signals WHERE log10(false_positive_per_year) BETWEEN -12.05 AND 1.3", "round(sum(coincidence_probability), 6)", "total"))
def chance_histogram(s, d):
    return histogram.histogram(signal_rows(s, d), _fp_bin(), 200, F.col("coincidence_probability")).select("bin", r("total", 6).alias("total"))


@query(f"WITH {SIGNALS} SELECT b.range bin, CASE WHEN y > 0 THEN x / CAST(y AS DOUBLE) END ratio, coalesce(x, 0) - coalesce(y, 0) difference FROM range(37) b LEFT JOIN (SELECT CAST(least(floor((log10(\"count\") - log10(3)) / ((log10(999) - log10(3)) / 37)), 36) AS BIGINT) bin, count(*) FILTER (associated_lightning_count > 0) x, count(*) y FROM signals WHERE \"count\" BETWEEN 3 AND 999 GROUP BY 1) h ON h.bin = b.range")
def associated_share(s, d):
    x = signal_rows(s, d)
    b = histogram.log_bin(F.col("count"), 3, 999, 37)
    return histogram.compared(histogram.histogram(x.where("associated_lightning_count > 0"), b, 37), histogram.histogram(x, b, 37)).select("bin", "ratio", "difference")


@query(f"WITH {SIGNALS} " + _bins_sql(48, "CAST(least(floor((t % 86400000000) / 1800000000), 47) AS BIGINT)", "signals", "CAST(sum(1000.0 / (id % 50 + 1)) AS DOUBLE)", "total").replace("coalesce(v, 0) AS total", "round(coalesce(v, 0), 6) AS total"))
def weighted_rates(s, d):
    x = signal_rows(s, d)
    b = histogram.linear_bin(F.pmod("t", F.lit(DAY_US)) / 1e6, 0.0, 86_400.0, 48)
    return histogram.histogram(x, b, 48, 1000.0 / (F.col("id") % 50 + 1)).select("bin", r("total", 6).alias("total"))


_FIT_SUM = "list_sum(list_transform(list_zip(xs, ys), lambda z: {}))"
_FIT_A = f"({_FIT_SUM.format('pow(z[1], m) * z[2]')} / {_FIT_SUM.format('pow(z[1], 2 * m)')})"


@query(f"""WITH RECURSIVE {SIGNALS}, n AS (SELECT CAST(least(floor((log10(false_positive_per_year) - (-12.05)) / 0.06675), 199) AS BIGINT) bin, count(*) y FROM signals WHERE log10(false_positive_per_year) BETWEEN -12.05 AND 1.3 GROUP BY 1),
 b AS (SELECT i, (pow(10.0, -12.05 + i * 0.06675) + pow(10.0, -12.05 + (i + 1) * 0.06675)) / 2 x, CAST(coalesce(y, 0) AS DOUBLE) y FROM (SELECT unnest(range(0, 200)) i) LEFT JOIN n ON n.bin = i), l AS (SELECT list(x ORDER BY i) xs, list(y ORDER BY i) ys FROM b WHERE x > 1e-4 AND x < 20),
 s AS (SELECT 0 k, -1.0::DOUBLE lo, 1.0::DOUBLE hi UNION ALL SELECT k + 1, CASE WHEN slope < 0 THEN m ELSE lo END, CASE WHEN slope < 0 THEN hi ELSE m END FROM (SELECT *, {_FIT_SUM.format(f"({_FIT_A} * pow(z[1], m) - z[2]) * pow(z[1], m) * ln(z[1])")} slope FROM (SELECT *, (lo + hi) / 2 m FROM s, l WHERE k < 60))),
 f AS (SELECT lo m, xs, ys FROM s, l WHERE k = 60), ab AS (SELECT {_FIT_A} a, m b FROM f)
 SELECT round(a, 4) a, round(b, 6) b, round(a * list_sum(list_transform(range(0, 353), lambda i: pow((pow(10.0, -12.05 + i * (log10(3.16e11) + 12.05) / 353) + pow(10.0, -12.05 + (i + 1) * (log10(3.16e11) + 12.05) / 353)) / 2, b))), 2) total FROM ab""")
def power_law(s, d):
    """Fit over the histogram's 200 bins, and its total over the extended range. The SQL finds the exponent by bisection of the slope."""
    rows = sorted((row["bin"], row["count"]) for row in histogram.histogram(signal_rows(s, d), _fp_bin(), 200).collect())  # a row a bin
    edges = np.logspace(-12.05, 1.3, 201)
    x, y = (edges[:-1] + edges[1:]) / 2, np.array([c for _, c in rows], float)
    use = (x > 1e-4) & (x < 20)
    a, b = histogram.power_law_fit(x[use], y[use])
    return s.createDataFrame([(round(a, 4), round(b, 6), round(histogram.power_law_total(a, b, 10**-12.05, 3.16e11, 353), 2))], "a double, b double, total double")


_EDGES = """ends AS (SELECT log10(min({x})) lo, {hi} hi FROM signals)"""
_PLACED = "CAST(least(floor((log10({x}) - lo) / ((hi - lo) / {n})), {n} - 1) AS BIGINT)"


@query(f"""WITH {SIGNALS}, {_EDGES.format(x='"count"', hi='log10(max("count"))')}, n AS (SELECT associated_lightning_count > 0 AS lit, {_PLACED.format(x='"count"', n=37)} bin, count(*) y FROM signals, ends GROUP BY 1, 2), i AS (SELECT unnest(range(0, 37)) bin)
 SELECT i.bin, round(pow(10.0, lo + i.bin * ((hi - lo) / 37)), 6) AS "left", round(pow(10.0, lo + (i.bin + 1) * ((hi - lo) / 37)), 6) AS "right", CAST(coalesce((SELECT sum(y) FROM n WHERE n.bin = i.bin), 0) AS BIGINT) n_all, CAST(coalesce((SELECT sum(y) FROM n WHERE n.bin = i.bin AND lit), 0) AS BIGINT) n_lightning FROM i, ends""")
def count_histograms(s, d):
    """Counts of all and of associated signals in the bins between 38 edges from the least to the greatest count of all."""
    x = signal_rows(s, d)
    lit = x.where("associated_lightning_count > 0")
    both = histogram.log_histogram(x, "count", 37).join(histogram.log_histogram(lit, "count", 37, edges_of=x).select("bin", F.col("count").alias("n_lightning")), "bin")
    return both.select("bin", r("left", 6).alias("left"), r("right", 6).alias("right"), F.col("count").alias("n_all"), "n_lightning")


_ZIP = "list_sum(list_transform(list_zip(xs, ys), lambda z: {}))"
_A = f"({_ZIP.format('z[2] * pow(z[1], {m})')} / {_ZIP.format('pow(z[1], 2 * {m})')})"


@query(f"""WITH RECURSIVE {SIGNALS}, {_EDGES.format(x="false_positive_per_year", hi="log10(20.0)")}, n AS (SELECT c % 4 g, {_PLACED.format(x="false_positive_per_year", n=200)} bin, count(*) y FROM signals, ends WHERE log10(false_positive_per_year) <= hi GROUP BY 1, 2),
 b AS (SELECT g.g, i, (pow(10.0, lo + i * ((hi - lo) / 200)) + pow(10.0, lo + (i + 1) * ((hi - lo) / 200))) / 2 x, CAST(coalesce(y, 0) AS DOUBLE) y FROM (SELECT DISTINCT c % 4 g FROM signals) g CROSS JOIN (SELECT unnest(range(0, 200)) i) CROSS JOIN ends LEFT JOIN n ON n.g = g.g AND n.bin = i),
 l AS (SELECT g, 1 part, list(x ORDER BY i) xs, list(y ORDER BY i) ys FROM b WHERE x > 1e-4 AND x < 20 GROUP BY g UNION ALL SELECT g, 2, list(x ORDER BY i), list(y ORDER BY i) FROM b WHERE x > 1e-50 AND x < 1e-8 GROUP BY g),
 s AS (SELECT g, part, 0 k, -1.0::DOUBLE lo, 1.0::DOUBLE hi FROM l UNION ALL SELECT g, part, k + 1, CASE WHEN slope < 0 THEN m ELSE lo END, CASE WHEN slope < 0 THEN hi ELSE m END FROM
  (SELECT *, {_ZIP.format("(a * pow(z[1], m) - z[2]) * pow(z[1], m) * ln(z[1])")} slope FROM (SELECT *, {_A.format(m="m")} a FROM (SELECT s.g, s.part, s.k, s.lo, s.hi, (s.lo + s.hi) / 2 m, l.xs, l.ys FROM s JOIN l ON l.g = s.g AND l.part = s.part WHERE k < 60)))),
 f AS (SELECT g, part, b, {_A.format(m="b")} a FROM (SELECT s.g, s.part, s.lo b, l.xs, l.ys FROM s JOIN l ON l.g = s.g AND l.part = s.part WHERE k = 60)),
 w AS (SELECT f.g, a, b, lo, (log10(3.16e11) - lo) / m step, m FROM f, (SELECT lo, CAST(round(201 * (log10(3.16e11) - lo) / (hi - lo)) AS BIGINT) - 1 m FROM ends) WHERE part = 2)
 SELECT f.g, round(f.a, 3) a_left, round(f.b, 5) b_left, round(w.a, 3) a_right, round(w.b, 5) b_right, round(w.a * list_sum(list_transform(range(0, w.m), lambda i: pow((pow(10.0, w.lo + i * w.step) + pow(10.0, w.lo + (i + 1) * w.step)) / 2, w.b))), 1) total FROM f JOIN w ON w.g = f.g WHERE f.part = 1""")
def power_law_groups(s, d):
    """For each of four groups the fit to its common signals, the one to its rare ones that begins there, and the sum of the
    second over the extended range; 201 edges from the least rate of all. The SQL bisects the slope of each."""
    x, rate = signal_rows(s, d).withColumn("g", F.col("c") % 4), "false_positive_per_year"
    fits = histogram.chained_power_laws(histogram.log_histogram(x, rate, 200, high=20.0, keys=("g",)), ["g"], [(1e-4, 20.0), (1e-50, 1e-8)])
    (low, high), far = histogram.log_edges(x, rate, high=20.0), F.lit(math.log10(3.16e11))
    fits = fits.withColumns({"low": low, "n": F.round(201 * (far - low) / (high - low)).cast("int") - 1})
    total = histogram.power_law_sum(F.col("fits")[1], F.col("low"), far, F.col("n"))
    fit = lambda k, name, n: r(F.col("fits")[k][name], n)
    return fits.select("g", fit(0, "a", 3).alias("a_left"), fit(0, "b", 5).alias("b_left"), fit(1, "a", 3).alias("a_right"), fit(1, "b", 5).alias("b_right"), r(total, 1).alias("total"))


# ---- tasks -------------------------------------------------------------------------------------------------------------
_TASKS = "tasks AS (SELECT 'HXMT' satellite, 'HE' detector, o_orderdate AS time, CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'Failed' ELSE 'Running' END status, CAST(o_orderkey % 3 AS INTEGER) retry_times, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) n FROM orders), task AS (SELECT satellite, detector, time, status, retry_times FROM tasks WHERE n = 1)"


def _tasks(s, d) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    first = o.groupBy("o_orderdate").agg(F.min_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("x"))
    status = F.when(F.col("x.o_orderstatus") == "O", "Pending").when(F.col("x.o_orderstatus") == "F", "Failed").otherwise("Running")
    return first.select(F.lit("HXMT").alias("satellite"), F.lit("HE").alias("detector"), F.col("o_orderdate").alias("time"), status.alias("status"), (F.col("x.o_orderkey") % 3).cast("int").alias("retry_times"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def _reset(s, d, status):
    return catalog.reset(_tasks(s, d), status, F.lit("2024-01-01").cast("timestamp_ntz")).select("time", "status", "retry_times", F.col("updated_at").isNotNull().alias("touched"))


@query(f"WITH {_TASKS} SELECT time, CASE status WHEN 'Failed' THEN 'Pending' ELSE status END status, CASE status WHEN 'Failed' THEN retry_times + 1 ELSE retry_times END retry_times, status = 'Failed' touched FROM task")
def reset_failed(s, d):
    return _reset(s, d, "Failed")


@query(f"WITH {_TASKS} SELECT time, CASE status WHEN 'Running' THEN 'Pending' ELSE status END status, CASE status WHEN 'Running' THEN retry_times + 1 ELSE retry_times END retry_times, status = 'Running' touched FROM task")
def reset_stuck(s, d):
    return _reset(s, d, "Running")


_HOURS = "h AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01 00:00:00', TIMESTAMP '1996-03-01 07:00:00', INTERVAL 1 HOUR)) AS time)"


@query(f"WITH {_TASKS}, {_HOURS} SELECT satellite, detector, time, status, retry_times FROM task UNION ALL SELECT 'HXMT', 'HE', time, 'Pending', 0 FROM h WHERE NOT EXISTS (SELECT 1 FROM task k WHERE k.time = h.time)")
def refresh_tasks(s, d):
    return catalog.refreshed_tasks(_tasks(s, d), "HXMT", "HE", "1996-01-01 00:00:00", "1996-03-01 06:30:00").drop("updated_at")


#: Work lists that orders leave: an hour each, of two kinds.
_WORK = """work AS (SELECT CAST(time AS TIMESTAMP) AS time, min(k) k, k % 2 odd FROM (SELECT o_orderkey k, o_orderdate + INTERVAL 24 YEAR + INTERVAL (o_orderkey % 24) HOUR AS time FROM orders) GROUP BY 1, 3),
 w AS (SELECT *, ['Pending', 'Failed', 'Finished'][k % 3 + 1] status, CAST(k % 3 AS INTEGER) retry_times FROM work), due AS (SELECT unnest(generate_series(TIMESTAMP '2021-01-01 00:00:00', TIMESTAMP '2021-03-01 19:00:00', INTERVAL 1 HOUR)) AS time)"""


def _work(s, d) -> DataFrame:
    first = _hours(s, d).withColumn("odd", F.col("k") % 2).groupBy(F.col("hour").cast("timestamp_ntz").alias("time"), "odd").agg(F.min("k").alias("k"))
    status = F.element_at(F.array(*map(F.lit, ("Pending", "Failed", "Finished"))), (F.col("k") % 3 + 1).cast("int"))
    return first.select("time", "odd", status.alias("status"), (F.col("k") % 3).cast("int").alias("retry_times"))


@query(f"WITH {_WORK}, r AS (SELECT time, CASE odd WHEN 0 THEN 'HXMT-HE: Energy Spectrum' ELSE 'another' END AS what, status, retry_times FROM w) SELECT * FROM r UNION ALL SELECT time, 'HXMT-HE: Energy Spectrum', 'Pending', 0 FROM due WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.time = due.time AND r.what <> 'another')")
def refresh_statistics(s, d):
    """A table of two statistics in which the hours of one are made complete."""
    what = F.when(F.col("odd") == 0, "HXMT-HE: Energy Spectrum").otherwise("another")
    held = _work(s, d).select("time", what.alias("what"), "status", "retry_times")
    return catalog.refreshed_statistics(held, "HXMT-HE: Energy Spectrum", "2021-01-01 00:00:00", "2021-03-01 18:20:00")


@query(f"WITH {_TASKS} SELECT time, status FROM task UNION ALL SELECT TIMESTAMP '2017-08-24 10:00:00', 'Pending'")
def insert_task(s, d):
    new = s.sql("SELECT 'HXMT' AS satellite, 'HE' AS detector, TIMESTAMP_NTZ '2017-08-24 10:00:00' AS time, 'Pending' AS status, 0 AS retry_times")
    return catalog.added(_tasks(s, d), new, ["satellite", "detector", "time"]).select("time", "status")


@query(f"WITH {SIGNALS}, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '1999-03-01', INTERVAL 1 DAY)) AS DATE) AS day), x AS (SELECT CAST(make_timestamp(t) AS DATE) AS day, count(*) AS n, max(id) AS last_id FROM signals GROUP BY 1) SELECT days.day, coalesce(n, 0) AS n, last_id FROM days LEFT JOIN x ON x.day = days.day")
def daily_signals(s, d):
    """Every day of a calendar, also those without signals."""
    x = signal_rows(s, d).select(F.timestamp_micros("t").cast("date").alias("day"), "id")
    days = s.sql("SELECT explode(sequence(DATE '1994-12-01', DATE '1999-03-01')) AS day")
    out = archive.signal_days(days, x)
    return out.select("day", F.size("signals").cast("long").alias("n"), F.array_max(F.transform("signals", lambda v: v["id"])).alias("last_id"))


@query(f"""WITH {SIGNALS}, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '1999-03-01', INTERVAL 1 DAY)) AS DATE) AS day), x AS (SELECT CAST(make_timestamp(t) AS DATE) AS day, * FROM signals)
 SELECT days.day, count(id) n, round(min(t) / 1e6, 6) first, round(max(t + 1000) / 1e6, 6) last, CAST(sum("count") AS BIGINT) counts, round(max(longitude), 6) east, round(min(latitude), 6) south, round(max((id % 16) / 16.0), 6) q3, round(min(log10(false_positive_per_year)), 6) best FROM days LEFT JOIN x ON x.day = days.day GROUP BY 1""")
def day_signals(s, d):
    """A file for every day, published by the sink with its nested signals as one JSON array, read back and summed up."""
    x = signal_rows(s, d).withColumn("day", F.timestamp_micros("t").cast("date"))
    time = lambda c: F.struct((c / 1e6).alias("time"))
    width, zero = F.lit(1e-3), F.lit(0.0)
    nested = x.select(
        "day", time(F.col("t")).alias("start"), time(F.col("t") + 1000).alias("stop"), width.alias("bin_size_min"), width.alias("bin_size_max"), width.alias("bin_size_best"), zero.alias("delay"),
        "count", F.lit(1.0).alias("mean"), F.lit(0.5).alias("sf"), "false_positive_per_year", F.struct(zero.alias("q1"), zero.alias("q2"), ((F.col("id") % 16) / 16.0).alias("q3")).alias("attitude"), F.struct("longitude", "latitude", F.lit(5e5).alias("altitude")).alias("position"),
    )
    days = s.sql("SELECT explode(sequence(DATE '1994-12-01', DATE '1999-03-01')) AS day")
    out, name = paths.new_folder(s, "signals"), F.lit("HXMT")
    signals.write_signals(days.withColumn("mission", name), nested.withColumn("mission", name), out)
    g = days.join(signals.read_signals(s, out).withColumn("day", F.to_date("date", "yyyyMMdd")), "day", "left")
    return g.groupBy("day").agg(
        F.count("start").alias("n"), r(F.min("start.time"), 6).alias("first"), r(F.max("stop.time"), 6).alias("last"), F.sum("count").alias("counts"),
        r(F.max("position.longitude"), 6).alias("east"), r(F.min("position.latitude"), 6).alias("south"), r(F.max("attitude.q3"), 6).alias("q3"), r(F.min(F.log10("false_positive_per_year")), 6).alias("best"),
    )


@query(f"WITH {_WORK}, r AS (SELECT time, CASE odd WHEN 0 THEN 'SVOM' ELSE 'HXMT' END AS satellite, CASE odd WHEN 0 THEN 'GRM' ELSE 'HE' END AS detector, status FROM w) SELECT * FROM r UNION ALL SELECT time, 'SVOM', 'GRM', 'Pending' FROM due WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.time = due.time AND r.satellite = 'SVOM')")
def svom_tasks(s, d):
    """A task table of both missions in which one mission's hours are made complete."""
    odd = F.col("odd") == 0
    held = _work(s, d).select(F.when(odd, "SVOM").otherwise("HXMT").alias("satellite"), F.when(odd, "GRM").otherwise("HE").alias("detector"), "time", "status", "retry_times")
    return catalog.refreshed_tasks(held, "SVOM", "GRM", "2021-01-01 00:00:00", "2021-03-01 18:20:00").select("time", "satellite", "detector", "status")


_CATALOGUE = """x AS (SELECT o_orderkey k, CAST(o_orderkey % 5 = 0 AS INTEGER) old, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'id' || CAST(o_orderkey // 20 AS VARCHAR) END id, 'S' || CAST(o_custkey % 2 AS VARCHAR) satellite, 'D' detector, strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') start_full, CAST(o_orderkey % 7 AS BIGINT) n FROM orders)"""


def _catalogue_rows(s, d) -> DataFrame:
    o, k = s.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    return o.select((k % 5 == 0).alias("old"), F.when(k % 9 != 0, F.concat(F.lit("id"), F.floor(k / 20).cast("string"))).alias("id"), F.concat(F.lit("S"), (F.col("o_custkey") % 2).cast("string")).alias("satellite"), F.lit("D").alias("detector"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.lpad((k % 24).cast("string"), 2, "0")).alias("start_full"))


@query(f"""WITH {_CATALOGUE}, new AS (SELECT * FROM x WHERE old = 0), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY satellite, detector, start_full ORDER BY start_full, id NULLS FIRST, satellite, detector) o FROM new) WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM x t WHERE t.old = 1 AND t.satellite = satellite_ AND t.start_full = start_)),
 b AS (SELECT * FROM (SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY start_full, id, satellite, detector) END o2 FROM a) WHERE o2 = 1 AND (id IS NULL OR id NOT IN (SELECT id FROM x WHERE old = 1 AND id IS NOT NULL)))
 SELECT id, satellite, start_full, CAST(43 AS INTEGER) n_columns FROM x WHERE old = 1 UNION ALL SELECT id, satellite, start_full, 43 FROM b""".replace("SELECT * FROM x WHERE old = 0", "SELECT *, satellite satellite_, start_full start_ FROM x WHERE old = 0"))
def catalogue_inserts(s, d):
    """New signals that break neither of the catalogue's keys, with all its columns."""
    x = _catalogue_rows(s, d)
    out = catalog.added_signals(x.where("old"), x.where("NOT old"))
    return out.select("id", "satellite", "start_full", F.lit(len(out.columns)).alias("n_columns"))


_INSERTED = """a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY satellite, start_full ORDER BY id NULLS FIRST) o FROM x WHERE old = 0) WHERE o = 1), b1 AS (SELECT * FROM (SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY start_full, satellite) END o2 FROM a1) WHERE o2 = 1),
 a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY satellite, start_full ORDER BY id NULLS FIRST) o FROM x) p WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM b1 WHERE b1.satellite = p.satellite AND b1.start_full = p.start_full)),
 b2 AS (SELECT * FROM (SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY start_full, satellite) END o2 FROM a2) WHERE o2 = 1 AND (id IS NULL OR id NOT IN (SELECT id FROM b1 WHERE id IS NOT NULL)))"""


@query(f"WITH {_CATALOGUE}, {_INSERTED} SELECT id, satellite, start_full FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) WHERE start_full BETWEEN '1995-11-20 05' AND '1998-02-03 12'")
def stored_signals(s, d):
    """Two inserts into a stored catalogue, the second with rows that are there, and the rows between two times of it."""
    held = store.signal_store(s, paths.new_folder(s, "signals"))
    rows = _catalogue_rows(s, d)
    store.insert_signals(held, rows.where("NOT old"))
    store.insert_signals(held, rows)
    return held.between("1995-11-20 05", "1998-02-03 12").select("id", "satellite", "start_full")


@query(f"""WITH {_TASKS}, r AS (SELECT time, CASE status WHEN 'Failed' THEN 'Pending' ELSE status END status, CASE status WHEN 'Failed' THEN retry_times + 1 ELSE retry_times END retry_times FROM task), n AS (SELECT *, CASE WHEN status = 'Pending' THEN row_number() OVER (PARTITION BY status ORDER BY time) END n FROM r)
 SELECT time, CASE WHEN n <= 150 THEN 'Running' ELSE status END status, retry_times, CASE WHEN n <= 100 THEN 'w1' WHEN n <= 150 THEN 'w2' END worker FROM n""")
def stored_tasks(s, d):
    """A stored work list: hours added, failed ones reset, and two workers that claim a hundred and fifty of the earliest."""
    held, now = store.task_store(s, paths.new_folder(s, "tasks")), F.lit("2024-01-01").cast("timestamp_ntz")
    store.insert_tasks(held, _tasks(s, d))
    store.reset_tasks(held, "Failed", now)
    for worker, n in (("w1", 100), ("w2", 50)):
        store.claim_tasks(held, worker, n, now)
    return held.read().select("time", "status", "retry_times", F.substring_index("worker", "/", 1).alias("worker"))


@query(f"WITH {PHOTONS}, e AS (SELECT event_id, event_type <> 0 acd, CASE WHEN pulse_width < 75 THEN 'NaI' ELSE 'CsI' END sc, channel, t - {START} off FROM photons) SELECT event_id // 128 AS id, round((off % 5000000) / 1000.0, 3) ms, channel, CASE WHEN sc = 'NaI' THEN 'triangle' ELSE 'circle' END marker, acd vetoed, channel >= 38 keep FROM e")
def event_details(s, d):
    """Events of catalogue rows, 128 of them each, from their JSON texts."""
    p = photons(s, d)
    time = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    one = F.struct(time(F.lit(START) + (F.col("t") - START) % 5_000_000).alias("time"), "channel", (F.col("channel") >= 38).alias("keep"), F.struct(E.scintillator(F.col("pulse_width")).alias("scintillator"), (F.col("event_type") * 3).alias("acd")).alias("info"))
    rows = p.groupBy(F.floor(F.col("event_id") / 128).alias("id")).agg(F.to_json(F.collect_list(one)).alias("events")).withColumn("start_full", time(F.lit(START)))
    return catalog.detail_events(rows).withColumn("ms", r("ms", 3))


@query("WITH x AS (SELECT event_id // 256 AS id, round((user_id * 7 % 360 - 180) / 4.0, 2) lon, round((user_id % 80 - 40) / 8.0, 3) lat FROM events WHERE event_type = 'purchase') SELECT id, lon, lat FROM x")
def stroke_details(s, d):
    """Places of associated strokes from both shapes of a catalogue row's JSON."""
    e = s.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    stroke = F.struct(F.lit("2024-01-01 00:00:00").alias("time"), r((F.col("user_id") % 80 - 40) / 8.0, 3).alias("lat"), r((F.col("user_id") * 7 % 360 - 180) / 4.0, 2).alias("lon"))
    rows = e.groupBy(F.floor(F.col("event_id") / 256).alias("id")).agg(F.collect_list(stroke).alias("s"))
    named, listed = F.to_json(F.transform("s", lambda x: F.struct(x.alias("lightning"), F.lit(1.5).alias("distance")))), F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), F.to_json(x), F.lit(",1.5]"))), ","), F.lit("]"))
    text = rows.select("id", F.when(F.col("id") % 2 == 0, named).otherwise(listed).alias("lightnings"))
    return text.select("id", F.explode(catalog.stroke_places(F.col("lightnings"))).alias("p")).select("id", "p.lon", "p.lat")


@query(f"WITH {PHOTONS}, c AS (SELECT mission, (t - {START}) // {DAY_US} AS bin, count(*) n FROM photons GROUP BY 1, 2) SELECT mission, bin, round(n / 0.001, 6) cps FROM c")
def light_curve_rates(s, d):
    """Counts a second of light curves held as arrays, with bins of a millisecond."""
    p = photons(s, d).groupBy("mission", F.floor((F.col("t") - START) / DAY_US).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    held = p.groupBy("mission").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("c"))
    held = held.select("mission", F.transform("c", lambda x: x["bin"]).alias("bins"), histogram.rate(F.transform("c", lambda x: x["n"]), 1e-3).alias("cps"))
    return held.select("mission", F.explode(F.arrays_zip("bins", "cps")).alias("x")).select("mission", F.col("x.bins").alias("bin"), r("x.cps", 6).alias("cps"))


_GROUPED = _TRIGGERS.split(", means AS")[0].replace("low, low + g *", "user_id % 3 grp, low, low + g *")
_GROUPED = _GROUPED.replace("pairs AS (SELECT a.chunk,", "cum AS (SELECT chunk, rn, sum(CASE WHEN grp = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk ORDER BY rn) c FROM sides), pairs AS (SELECT a.chunk, a.rn ri, b.rn rj, greatest(f_n, b.lt_n) hi_n, greatest(0, a.fg_n - 1) lo_n, greatest(f_h, b.lt_h) hi_h, greatest(0, a.fg_h - 1) lo_h,")


def _cum(place: str) -> str:
    return f"coalesce((SELECT c FROM cum WHERE cum.chunk = p.chunk AND cum.rn = {place}), 0)"


@query(f"""WITH {_GROUPED}, zero AS (SELECT p.*, {_cum('rj')} - {_cum('ri - 1')} k0, ({_cum('hi_n')} - {_cum('lo_n - 1')}) - ({_cum('hi_h')} - {_cum('lo_h - 1')}) extra0 FROM pairs p),
 wide AS (SELECT *, (tj - ti) / CAST((least(tj + 200 * g, high) - greatest(ti - 200 * g, low)) - (least(tj + 8 * g, high) - greatest(ti - 8 * g, low)) AS DOUBLE) share FROM zero),
 q AS (SELECT *, CASE WHEN mean <= 0 THEN 1.0 ELSE {_SF} END p0 FROM (SELECT * EXCLUDE (k), k kk, CAST(k0 AS BIGINT) k, extra0 * share mean FROM wide))
 SELECT chunk, ti, tj, CAST(kk AS BIGINT) k, round(extra * share, 9) mean FROM q WHERE p0 < 1e-3 * (tj - ti) / (4.0 * g)""")
def grouped_triggers(s, d):
    """The scan with three groups of events: all count, the first is tested."""
    p = photons(s, d)
    config = _config(p)
    chunk, start, stop = _chunk(config)
    rows = p.select(chunk.alias("chunk"), "t", start.alias("start"), stop.alias("stop"), (F.col("user_id") % 3).alias("grp"))
    return scan.triggers(rows, config, group="grp").select("chunk", "ti", "tj", "k", r("mean").alias("mean"))


# ---- the archive -----------------------------------------------------------------------------------------------------
_HOUR = "o_orderdate + INTERVAL 24 YEAR + INTERVAL (o_orderkey % 24) HOUR"


def _hours(s, d) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    hour = F.col("o_orderdate").cast("timestamp") + F.make_interval(years=F.lit(24), hours=(F.col("o_orderkey") % 24).cast("int"))
    return o.select(F.col("o_orderkey").alias("k"), hour.alias("hour"))


def _listed(hours: DataFrame, folder, name) -> DataFrame:
    return hours.select(folder.alias("folder"), name.alias("name")).distinct().withColumn("listed", F.col("name"))


def _shown(resolved: DataFrame, *more: str) -> DataFrame:
    return resolved.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "kind", *more, "file")


@query(f"""WITH h AS (SELECT o_orderkey k, {_HOUR} AS hour FROM orders), f AS (SELECT DISTINCT hour, ['events', 'orbit', 'attitude'][k % 3 + 1] kind, strftime(hour, 'Y%Y%m/%Y%m%d-') || lpad(CAST(date_diff('day', DATE '2017-06-15', CAST(hour AS DATE)) + 1 AS VARCHAR), 4, '0') folder,
  'HXMT_' || strftime(hour, '%Y%m%dT%H') || '_' || ['HE-Evt', 'Orbit', 'Att'][k % 3 + 1] || '_FFFFFF_V' || CASE WHEN k // 3 % 6 = 5 THEN 'x' ELSE CAST(k // 3 % 6 AS VARCHAR) END || '_' || CAST(k % 4 AS VARCHAR) || '.FITS' AS name FROM h)
 SELECT strftime(hour, '%Y-%m-%d %H') AS hour, kind, folder || '/' || arg_max(name, (CASE WHEN substr(name, instr(name, 'FFFFFF_V') + 8, 1) = 'x' THEN 0 ELSE CAST(substr(name, instr(name, 'FFFFFF_V') + 8, 1) AS INTEGER) END, name)) AS file FROM f GROUP BY hour, kind, folder""")
def resolved_1k(s, d):
    h, k = _hours(s, d), F.col("k")
    part = F.element_at(F.array(*map(F.lit, ("HE-Evt", "Orbit", "Att"))), (k % 3 + 1).cast("int"))
    version = F.when(F.floor(k / 3) % 6 == 5, "x").otherwise((F.floor(k / 3) % 6).cast("string"))
    name = F.concat(F.lit("HXMT_"), F.date_format("hour", "yyyyMMdd'T'HH"), F.lit("_"), part, F.lit("_FFFFFF_V"), version, F.lit("_"), (k % 4).cast("string"), F.lit(".FITS"))
    return _shown(archive.resolve_1k(h.select("hour").distinct(), _listed(h, archive.folder_1k(F.col("hour")), name)))


_CODES = "[" + ", ".join(f"'{c}'" for c in archive.CODES_1B.values()) + "]"
_BOXES = "[" + ", ".join(f"'{b}'" for _, b in archive.CODES_1B) + "]"
#: Every order brings the files of its hour, all six or all but one; a file's version is a digit or, for some, none.
_NAMES_1B = f"""h AS (SELECT o_orderkey k, {_HOUR} AS hour FROM orders), f AS (SELECT DISTINCT hour, c, 'HXMT_1B_' || {_CODES}[c] || strftime(hour, '_%Y%m%dT%H') || '0000_G00' || lpad(CAST(k % 1000 AS VARCHAR), 7, '0') || CASE WHEN (k + c) % 11 = 0 THEN 'x' ELSE CAST((k + c) % 4 AS VARCHAR) END || '.fits' AS name FROM h, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) c) WHERE (k // 24 + c) % 7 <> 0)"""


def _files_1b(s, d) -> DataFrame:
    h = _hours(s, d).withColumn("c", F.explode(F.expr("sequence(1, 6)")))
    k, c = F.col("k"), F.col("c")
    code = F.element_at(F.array(*map(F.lit, archive.CODES_1B.values())), c)
    name = F.concat(F.lit("HXMT_1B_"), code, F.date_format("hour", "'_'yyyyMMdd'T'HH"), F.lit("0000_G00"), F.lpad((k % 1000).cast("string"), 7, "0"), F.when((k + c) % 11 == 0, "x").otherwise(((k + c) % 4).cast("string")), F.lit(".fits"))
    there = h.where((F.floor(k / 24) + c) % 7 != 0)
    return archive.resolve_1b(h.select("hour").distinct(), _listed(there, F.concat(F.date_format("hour", "yyyy/yyyyMMdd/"), code), name))


@query(f"WITH {_NAMES_1B} SELECT strftime(hour, '%Y-%m-%d %H') AS hour, CASE WHEN c <= 3 THEN 'eng' ELSE 'sci' END kind, {_BOXES}[c] box, strftime(hour, '%Y/%Y%m%d/') || {_CODES}[c] || '/' || arg_min(name, (-CAST(substr(name, 40, 1) AS INTEGER), name)) AS file FROM f WHERE length(name) >= 40 AND substr(name, 40, 1) BETWEEN '0' AND '9' GROUP BY hour, c")
def resolved_1b(s, d):
    return _shown(_files_1b(s, d), "box")


@query(f"WITH {_NAMES_1B}, n AS (SELECT hour, count(DISTINCT c) AS n FROM f WHERE substr(name, 40, 1) BETWEEN '0' AND '9' GROUP BY 1) SELECT strftime(h.hour, '%Y-%m-%d %H') AS hour, CASE WHEN coalesce(n, 0) < 6 THEN CAST(coalesce(n, 0) AS VARCHAR) || ' of 6 files' END AS message FROM (SELECT DISTINCT hour FROM h) h LEFT JOIN n ON n.hour = h.hour")
def complete_hours(s, d):
    """Every hour: whole if all six files are there, and else with its error."""
    hours = _hours(s, d).select("hour").distinct()
    good, errors = archive.chunks(hours, _files_1b(s, d), len(archive.CODES_1B))
    both = good.select("hour", F.lit(None).cast("string").alias("message")).union(errors.select("hour", "message"))
    return both.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "message")


@query(f"""WITH h AS (SELECT o_orderkey k, {_HOUR} AS hour FROM orders), f AS (SELECT hour, k % 3 j, strftime(hour, '%Y/%m/%d/') || ['grm_evt', 'att', 'orb'][k % 3 + 1] folder, ['svom_grm_evt', 'svom_att', 'svom_orb'][k % 3 + 1] || strftime(hour, '_%y%m%d_%H_v') || lpad(CAST(k * 7 % 23 AS VARCHAR), 2, '0') || '.fits' AS name FROM h)
 SELECT strftime(hour, '%Y-%m-%d %H') AS hour, ['events', 'attitude', 'orbit'][j + 1] kind, folder || '/' || max(name) AS file FROM f GROUP BY hour, j, folder""")
def resolved_svom(s, d):
    h, k = _hours(s, d), F.col("k")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % 3 + 1).cast("int"))
    name = F.concat(pick("svom_grm_evt", "svom_att", "svom_orb"), F.date_format("hour", "'_'yyMMdd'_'HH'_v'"), F.lpad((k * 7 % 23).cast("string"), 2, "0"), F.lit(".fits"))
    return _shown(archive.resolve_svom(h.select("hour").distinct(), _listed(h, F.concat(F.date_format("hour", "yyyy/MM/dd/"), pick("grm_evt", "att", "orb")), name)))


@query(f"""WITH h AS (SELECT o_orderkey k, epoch_us({_HOUR}) u FROM orders), m AS (SELECT k, u, CAST(u - 1325376000000000 + ({{leaps}}) * 1000000 AS BIGINT) low, CAST(u + 3600000000 - 1325376000000000 + ({{after}}) * 1000000 AS BIGINT) high FROM h)
 SELECT k AS id, u // 3600000000 AS chunk, low AS "start", high AS stop, low + k % 4000 * 1000000 + 500000 AS t FROM m WHERE k % 8 <> 3 AND k % 8 <> 5 AND k % 8 <> 6""".replace("{leaps}", "{0}").replace("{after}", "{1}").format(" + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in clock.HXMT.leaps), " + ".join(f"CASE WHEN u + 3600000000 >= {t} THEN 1 ELSE 0 END" for t in clock.HXMT.leaps)))
def file_chunks(s, d):
    """Rows of hourly files with their chunk and its span on the mission's clock; rows without a finite time go, rows after the hour stay."""
    h, k = _hours(s, d), F.col("k")
    met = F.round(clock.met_from_utc(F.unix_micros("hour"), clock.HXMT), 6) + k % 4000 + 0.5
    met = F.when(k % 8 == 3, F.lit(float("nan"))).when(k % 8 == 5, F.lit(float("inf"))).when(k % 8 != 6, met)
    return search.chunked(h.withColumn("met", met), clock.HXMT).select(F.col("k").alias("id"), "chunk", "start", "stop", "t")


def _fits_files(rows: DataFrame, tables: dict[str, list[tuple[str, str, str]]]) -> DataFrame:
    """(path) of FITS files in the shared folder, one of each group `file` of rows, with tables' columns (name, form, column of
    rows), in order of id. Rows with a column hdu go to the table of that name."""

    def one(key: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by("id").to_pandas()
        made = []
        for name, cols in tables.items():
            part = found[found["hdu"] == name]
            made.append((name, [(c, form, part[old].to_numpy()) for c, form, old in cols]))
        return pa.table({"path": [key[0].as_py()], "content": [fits.encoded(made)]})

    return fits.written(rows.groupBy("file").applyInArrow(one, "path string, content binary"), paths.new_folder(rows.sparkSession, "fits"))


def _named(rows: DataFrame) -> DataFrame:
    """rows of readable files, with the file's name instead of its path."""
    return rows.where("error IS NULL").drop("error").withColumn("file", F.substring_index("file", "/", -1))


#: A file holds the events of one stretch of ids, so that files grow in number and not in size.
_FILE = "'f' || CAST(event_id // 4096 AS VARCHAR)"
_file = lambda: F.concat(F.lit("f"), F.floor(F.col("event_id") / 4096).cast("string"))


@query(f"""WITH {PHOTONS}, e AS (SELECT *, {_FILE} || 'm' || CAST(mission AS VARCHAR) file FROM photons), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS n FROM e)
 SELECT file, n AS "row", (t - {START}) / 1e6 met, CAST(det_id AS SMALLINT) det_id, CAST(channel AS SMALLINT) channel, CAST(pulse_width AS SMALLINT) pulse_width, acd, CAST(event_type AS SMALLINT) event_type FROM n""")
def fits_events(s, d):
    """Every event through the FITS tables of a mission's files, and back by runs of rows."""
    p = photons(s, d)
    rows = p.select(F.concat(_file(), F.lit("m"), F.col("mission").cast("string")).alias("file"), F.lit("Events").alias("hdu"), F.col("event_id").alias("id"), ((F.col("t") - START) / 1e6).alias("met"), "det_id", "channel", "pulse_width", "acd", "event_type")
    cols = [("Time", "D", "met"), ("Det_ID", "B", "det_id"), ("Channel", "B", "channel"), ("Pulse_Width", "B", "pulse_width"), ("ACD", "J", "acd"), ("Event_Type", "B", "event_type")]
    return _named(fits.hxmt_events(_fits_files(rows, {"Events": cols})))


@query(f"""WITH {PHOTONS}, e AS (SELECT *, {_FILE} AS file, ['EVENTS01', 'EVENTS02', 'EVENTS03'][user_id % 3 + 1] hdu FROM photons), n AS (SELECT *, row_number() OVER (PARTITION BY file, hdu ORDER BY event_id) - 1 AS n FROM e)
 SELECT file, n AS "row", CAST(user_id % 3 + 1 AS INTEGER) det_id, (t - {START}) / 1e6 met, CAST(channel AS SMALLINT) pi, CAST(event_id % 2 AS SMALLINT) gain_type, CAST((event_id % 64) / 64.0 AS FLOAT) dead_time, CAST(event_type AS SMALLINT) evt_type FROM n""")
def fits_svom(s, d):
    """Every event through the three detectors' tables of a file, and back."""
    p = photons(s, d)
    i = F.col("event_id")
    rows = p.select(_file().alias("file"), F.element_at(F.array(*map(F.lit, fits.SVOM_DETECTORS)), (F.col("user_id") % 3 + 1).cast("int")).alias("hdu"), i.alias("id"), ((F.col("t") - START) / 1e6).alias("met"), "channel", (i % 2).alias("gain"), ((i % 64) / 64.0).alias("dead"), "event_type", F.lit(0).alias("none"))
    cols = [("TIME", "D", "met"), ("PI", "I", "channel"), ("GAIN_TYPE", "I", "gain"), ("DEAD_TIME", "E", "dead"), ("EVT_TYPE", "I", "event_type"), ("ANTI_COIN", "I", "none"), ("FLAG", "I", "none")]
    return _named(fits.svom_events(_fits_files(rows, {h: cols for h in fits.SVOM_DETECTORS}))).drop("anti_coin", "flag")


@query(f"""WITH {PHOTONS}, e AS (SELECT *, {_FILE} AS file FROM photons), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS n FROM e), k AS (SELECT unnest(['hxmt attitude', 'hxmt orbit', 'svom attitude', 'svom orbit', 'engineering']) what)
 SELECT what AS kind, file, n AS "row", CASE WHEN what = 'engineering' THEN CAST(event_id % 100000 AS DOUBLE) ELSE (t - {START}) / 1e6 END met, CASE WHEN what = 'engineering' THEN CAST(event_id % 128 * 16777216 + 513 AS DOUBLE) ELSE (user_id % 16) / 16.0 END a, CASE WHEN what = 'engineering' THEN NULL ELSE (event_id % 32) / 32.0 END b, CASE WHEN what = 'engineering' THEN NULL ELSE (event_id % 64) / 64.0 END c FROM n, k""")
def fits_other_tables(s, d):
    """Attitude, orbit and engineering tables of both missions through FITS files, and back."""
    p = photons(s, d)
    i = F.col("event_id")
    rows = p.select(_file().alias("file"), i.alias("id"), ((F.col("t") - START) / 1e6).alias("met"), ((F.col("user_id") % 16) / 16.0).alias("a"), ((i % 32) / 32.0).alias("b"), ((i % 64) / 64.0).alias("c"), (i % 100000).alias("stime"))
    three = lambda time, form, *names: [(time, "D", "met"), *((n, form, v) for n, v in zip(names, "abc", strict=True))]

    def shown(kind: str, hdu: str, cols: list, read, values: list[str]) -> DataFrame:
        out = _named(read(_fits_files(rows.withColumn("hdu", F.lit(hdu)), {hdu: cols})))
        return out.select(F.lit(kind).alias("kind"), "file", "row", "met", *[F.col(v).alias(n) for v, n in zip(values, "abc", strict=True)])

    quaternion, place = ["q1", "q2", "q3"], ["longitude", "latitude", "altitude"]
    out = shown("hxmt attitude", "ATT_Quater", three("Time", "D", "Q1", "Q2", "Q3"), fits.hxmt_attitude, quaternion)
    out = out.union(shown("hxmt orbit", "Orbit", three("Time", "D", "Lon", "Lat", "Alt"), fits.hxmt_orbit, place))
    out = out.union(shown("svom attitude", "Quaternion", three("TIME", "E", "Q0", "Q1", "Q2"), fits.svom_attitude, quaternion).withColumn("met", F.col("met")))
    out = out.union(shown("svom orbit", "ORB", three("TIME", "E", "LON", "LAT", "ALT"), fits.svom_orbit, place))

    def bus(key: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by("id").to_pandas()
        clock_ = (found["id"].to_numpy() % 128 * 16_777_216 + 513).astype("<u4").view(np.uint8).reshape(-1, 4)
        six = np.hstack([np.zeros((len(found), 2), np.uint8), clock_])
        return pa.table({"path": [key[0].as_py()], "content": [fits.encoded([("HE_Eng", [("Time", "J", found["stime"].to_numpy()), ("BUS_Time_Bdc", "6B", six)])])]})

    eng = _named(fits.hxmt_engineering(fits.written(rows.groupBy("file").applyInArrow(bus, "path string, content binary"), paths.new_folder(s, "fits"))))
    none = F.lit(None).cast("double")
    return out.union(eng.select(F.lit("engineering").alias("kind"), "file", "row", F.col("stime").cast("double").alias("met"), packets.bus_time(F.col("bus")).cast("double").alias("a"), none.alias("b"), none.alias("c")))


_PLACES = (0, 1, 440, 880, 881)
_SCIENCE = " || ".join(f"printf('%02x', (event_id * 7 + {k}) % 256)" for k in _PLACES)


@query(f"WITH {PHOTONS}, n AS (SELECT *, row_number() OVER (PARTITION BY {_FILE} ORDER BY event_id) - 1 AS n FROM photons) SELECT {_FILE} file, n AS \"row\", 882 AS size, {_SCIENCE} AS bytes FROM n")
def fits_science(s, d):
    """A packet of 882 bytes for every event through FITS files, and back: its size and some of its bytes."""

    def one(key: tuple, found: pa.Table) -> pa.Table:
        ids = np.sort(found["event_id"].to_numpy())
        packs = ((ids[:, None] * 7 + np.arange(882)[None, :]) % 256).astype(np.uint8)
        return pa.table({"path": [key[0].as_py()], "content": [fits.encoded([("HE_Evt_Src", [("CCSDS", "882B", packs)])])]})

    made = photons(s, d).select(_file().alias("file"), "event_id").groupBy("file").applyInArrow(one, "path string, content binary")
    rows = _named(fits.hxmt_science(fits.written(made, paths.new_folder(s, "fits"))))
    some = F.concat(*[F.lower(F.hex(F.substring("ccsds", k + 1, 1))) for k in _PLACES])
    return rows.select("file", "row", F.octet_length("ccsds").alias("size"), some.alias("bytes"))


# ---- good time, energies, labels --------------------------------------------------------------------------------------
_GOOD = f"""{PHOTONS}, good AS (SELECT mission, t AS "start", t + (event_id // 20 % 7) * 1200000000 AS stop FROM photons WHERE event_id % 20 = 0)"""
_QUARTER = 21_600_000_000


def _good_times(p: DataFrame) -> DataFrame:
    """Intervals of up to two hours that every twentieth event begins; some are empty, many overlap."""
    return p.where("event_id % 20 = 0").select("mission", F.col("t").alias("start"), (F.col("t") + F.floor(F.col("event_id") / 20) % 7 * 1_200_000_000).alias("stop"))


@query(f"""WITH {_GOOD} SELECT event_id, EXISTS (SELECT 1 FROM good WHERE good.mission = photons.mission AND "start" <= t AND t < stop) AS good FROM photons""")
def good_events(s, d):
    """Which events lie in good time, by stretches of a mission that hold about as many events each."""
    p = photons(s, d)
    width = _config(p).max_duration // 4 * _CHUNK_GAPS
    cut = gti.dealt(_good_times(p), START, width)
    number = F.floor((F.col("t") - START) / width).cast("long")
    return gti.marked(p.withColumn("stretch", number), cut, ["mission", "stretch"]).select("event_id", "good")


@query(f"""WITH {_GOOD}, used AS (SELECT * FROM good WHERE "start" < stop), isl AS (SELECT *, sum(new) OVER (PARTITION BY mission ORDER BY "start", stop ROWS UNBOUNDED PRECEDING) island FROM
 (SELECT *, CASE WHEN max(stop) OVER (PARTITION BY mission ORDER BY "start", stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= "start" THEN 0 ELSE 1 END new FROM used)),
 whole AS (SELECT mission, min("start") a, max(stop) b FROM isl GROUP BY mission, island), cut AS (SELECT mission, a, b, unnest(range((a - {START}) // {_QUARTER}, (b - 1 - {START}) // {_QUARTER} + 1)) bin FROM whole),
 ex AS (SELECT mission, bin, sum(least(b, {START} + (bin + 1) * {_QUARTER}) - greatest(a, {START} + bin * {_QUARTER})) us FROM cut GROUP BY 1, 2),
 n AS (SELECT mission, (t - {START}) // {_QUARTER} bin, count(*) n FROM photons WHERE EXISTS (SELECT 1 FROM whole WHERE whole.mission = photons.mission AND a <= t AND t < b) GROUP BY 1, 2)
 SELECT ex.mission, ex.bin, CAST(us AS BIGINT) exposure, coalesce(n, 0) AS "count", round(coalesce(n, 0) / (us / 1e6), 9) rate FROM ex LEFT JOIN n ON n.mission = ex.mission AND n.bin = ex.bin""")
def exposure_rates(s, d):
    p = photons(s, d)
    return gti.rates(p, _good_times(p), ["mission"], START, _QUARTER).withColumn("rate", r(F.col("count") / (F.col("exposure") / 1e6)))


@query(f"""WITH {PHOTONS}, e AS (SELECT *, {_FILE} AS file, (t - {START}) / 1e6 met FROM photons), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS n FROM e WHERE event_id % 3 > 0)
 SELECT file, n AS "row", met, CAST(channel AS SMALLINT) pi, CASE WHEN channel % 16 < 15 THEN CAST(channel * 0.5 AS FLOAT) END e_min, CASE WHEN channel % 16 < 15 THEN CAST(channel * 0.5 + 0.5 AS FLOAT) END e_max,
 EXISTS (SELECT 1 FROM e g WHERE g.file = n.file AND g.event_id % 64 = 0 AND g.met <= n.met AND n.met < g.met + 600) AS good FROM n""")
def fits_good_energies(s, d):
    """Events with their file's energies and good time, all three from tables of the same files; some channels have no energies."""
    p = photons(s, d).withColumn("file", _file())
    met, i = (F.col("t") - START) / 1e6, F.col("event_id")
    events = p.where(i % 3 > 0).select("file", F.lit("EVENTS01").alias("hdu"), i.alias("id"), met.alias("a"), F.lit(0.0).alias("b"), "channel")
    good = p.where(i % 64 == 0).select("file", F.lit("GTI").alias("hdu"), i.alias("id"), met.alias("a"), (met + 600).alias("b"), F.lit(0).cast("long").alias("channel"))
    bounds = p.where("channel % 16 < 15").select("file", "channel").distinct()
    bounds = bounds.select("file", F.lit("EBOUNDS").alias("hdu"), F.col("channel").alias("id"), (F.col("channel") * 0.5).alias("a"), (F.col("channel") * 0.5 + 0.5).alias("b"), "channel")
    tables = {"EVENTS01": [("TIME", "D", "a"), ("PI", "I", "channel")], "GTI": [("START", "D", "a"), ("STOP", "D", "b")], "EBOUNDS": [("CHANNEL", "I", "channel"), ("E_MIN", "E", "a"), ("E_MAX", "E", "b")]}
    files = _fits_files(events.union(good).union(bounds), tables)
    rows = _named(fits.decoded(files, "EVENTS01", "TIME double, PI short")).select("file", "row", F.col("TIME").alias("met"), F.col("PI").alias("pi"))
    rows = gti.energies(rows, _named(fits.svom_energies(files)), ["file"])
    return gti.marked(rows, _named(fits.svom_good_times(files)), ["file"], "met")


_CHANCES = "[" + ", ".join(f"(event_id * {k} % 101) / 100.0" for k in (37, 41, 43, 47, 53)) + "]"
_SUBSETS = "list_sum(list_transform(list_filter(range(32), lambda m: bit_count(CAST(m AS BIGINT)) >= {n}), lambda m: " + " * ".join(f"(CASE WHEN (m >> {k}) & 1 = 1 THEN ps[{k + 1}] ELSE 1 - ps[{k + 1}] END)" for k in range(5)) + "))"


@query(f"WITH x AS (SELECT event_id, {_CHANCES} ps FROM events) SELECT event_id, " + ", ".join(f"round({_SUBSETS.format(n=n)}, 9) of_{n}" for n in (1, 2, 3, 5)) + " FROM x")
def detectors_hit(s, d):
    """Probability that 1, 2, 3 or all of five detectors are hit; SQL sums over all subsets."""
    i = F.col("event_id")
    x = s.read.parquet(f"{d}/events.parquet").select("event_id", F.array(*[i * k % 101 / 100.0 for k in (37, 41, 43, 47, 53)]).alias("ps"))
    return x.select("event_id", *[r(poisson.at_least(n, F.col("ps"))).alias(f"of_{n}") for n in (1, 2, 3, 5)])


@query(f"""WITH {SIGNALS}, x AS (SELECT id, CAST(floor(longitude) AS BIGINT) lon, CAST(trunc(latitude) AS BIGINT) lat FROM signals), y AS (SELECT *, (lon + 180) % 360 - 180 w FROM x)
 SELECT id, CAST(abs(w) AS VARCHAR) || '°' || CASE WHEN w IN (0, -180) THEN '' WHEN w < 0 THEN 'W' ELSE 'E' END longitude_label, CAST(abs(lat) AS VARCHAR) || '°' || CASE WHEN lat < 0 THEN 'S' WHEN lat > 0 THEN 'N' ELSE '' END latitude_label FROM y""")
def axis_labels(s, d):
    x = signal_rows(s, d)
    lat = F.when(F.col("latitude") < 0, F.ceil("latitude")).otherwise(F.floor("latitude"))
    return x.select("id", geo.longitude_label(F.floor("longitude")).alias("longitude_label"), geo.latitude_label(lat).alias("latitude_label"))


@query("""WITH logs AS (SELECT 'run.sh.' || k || '.' || CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN (o_orderkey + length(k)) % 3 = 0 THEN o_orderkey ELSE 0 END size FROM orders, (SELECT unnest(['out', 'err', 'core']) k))
 SELECT name FROM logs WHERE size = 0 AND name NOT LIKE '%core%' AND name NOT IN (SELECT 'run.sh.' || k || '.' || CAST(o_orderkey AS VARCHAR) FROM orders, (SELECT unnest(['out', 'err']) k) WHERE o_orderstatus = 'O')""")
def idle_logs(s, d):
    """Empty logs of jobs that no longer run, with orders as jobs: open ones are running."""
    o, k = s.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    logs = o.select(k, F.explode(F.array(*map(F.lit, ("out", "err", "core")))).alias("kind"))
    logs = logs.select(F.concat(F.lit("run.sh."), "kind", F.lit("."), k.cast("string")).alias("name"), F.when((k + F.length("kind")) % 3 == 0, k).otherwise(0).alias("size"))
    return archive.idle_logs(logs, o.where("o_orderstatus = 'O'").select(k.alias("id")), "run.sh")


# ---- a mission's run -------------------------------------------------------------------------------------------------
#: Two thousand events make an hour of a mission that has four bursts of twelve; of every five hours one has no orbit file and one
#: an attitude file that can't be read. Nodes of attitude and orbit lie on a line, so that SQL needs no as-of join.
_RUN_HOUR, _RUN_NODES = "2024-07-01T00:00:00", (-64, 1984, 4032)
_RUN = f"""run AS (SELECT event_id // 2000 h, CASE WHEN event_id % 500 < 12 THEN 10000000 + (event_id % 2000 - event_id % 500) * 1000 + event_id % 500 * 20 ELSE 10000000 + event_id % 2000 * 1000 + event_id * 7919 % 997 END rel FROM events),
 stretch AS (SELECT h chunk, rel t, 0 low, CAST(3600000000 AS BIGINT) high, 0 g FROM run WHERE h % 5 < 3), ev AS (SELECT chunk, low, high, g, t,""" + _TRIGGERS.split("high, g, t,", 1)[1].replace("200 * g", "500000").replace("8 * g", "5000").replace("4 * a.g", "1000").replace("a.rn + 1 >= 5", "a.rn + 1 >= 8").replace("p < 1e-3 * (tj - ti) / (4.0 * g)", f"p * {poisson.YEAR_S} / ((tj - ti) / 1e6) < 20")


@query(f"""WITH {_RUN}, {_MERGED}, hours AS (SELECT unnest(range(0, (SELECT max(event_id) // 2000 FROM events) + 3)) h), there AS (SELECT DISTINCT h FROM run)
 SELECT chunk h, 'signal' AS what, NULL AS message, "start", stop, bin_best, CAST("count" AS BIGINT) AS count, round((("start" + bin_best // 2) / 1e6 + 64) / 8192, 9) q1, round((("start" + bin_best // 2) / 1e6 + 64) / 128, 6) longitude FROM cand
 UNION ALL SELECT h, CASE WHEN h % 5 = 4 AND h IN (SELECT h FROM there) THEN 'Unreadable' ELSE 'FileNotFound' END, CASE WHEN h NOT IN (SELECT h FROM there) THEN '0 of 3 files' WHEN h % 5 = 3 THEN '2 of 3 files' END, NULL, NULL, NULL, NULL, NULL, NULL FROM hours WHERE h % 5 >= 3 OR h NOT IN (SELECT h FROM there)""")
def svom_run(s, d):
    """Hours of an archive of FITS files to signals and errors: listing, resolving, reading, searching and locating."""
    base = clock.micros(_RUN_HOUR) // 10**6
    zero, root, i = base - clock.micros(clock.SVOM.epoch) // 10**6, paths.new_folder(s, "archive"), F.col("event_id")
    rel = F.when(i % 500 < 12, 10_000_000 + (i % 2000 - i % 500) * 1000 + i % 500 * 20).otherwise(10_000_000 + i % 2000 * 1000 + i * 7919 % 997)
    e = s.read.parquet(f"{d}/events.parquet").select(F.floor(i / 2000).alias("h"), rel.alias("rel"), (i % 3).alias("det"))
    hour = F.timestamp_seconds(F.lit(base) + F.col("h") * 3600)
    named = lambda folder, stem: F.concat(F.date_format(hour, "yyyy/MM/dd/"), F.lit(f"{folder}/{stem}_"), F.date_format(hour, "yyMMdd_HH"), F.lit("_v01.fits"))

    def events(key: tuple, found: pa.Table) -> pa.Table:
        h, part, det = key[0].as_py().rsplit("@", 1)[1], found.sort_by("rel"), found.sort_by("rel")["det"].to_numpy()
        met = zero + int(h) * 3600 + part["rel"].to_numpy() / 1e6
        cols = lambda t: [("TIME", "D", t), *((c, form, np.zeros(len(t))) for c, form in (("PI", "I"), ("GAIN_TYPE", "I"), ("DEAD_TIME", "E"), ("EVT_TYPE", "I"), ("ANTI_COIN", "I"), ("FLAG", "I")))]
        content = fits.encoded([(name, cols(met[det == k])) for k, name in enumerate(fits.SVOM_DETECTORS)])
        return pa.table({"path": [key[0].as_py().rsplit("@", 1)[0]], "content": [content]})

    def lines(batches):
        for batch in batches:
            for h, attitude, orbit in zip(*(batch[c].to_pylist() for c in ("h", "attitude", "orbit")), strict=True):
                nodes = zero + h * 3600 + np.array(_RUN_NODES, float)
                line = lambda step: np.arange(3) * step
                q = fits.encoded([("Quaternion", [("TIME", "D", nodes), *((f"Q{k}", "E", line(0.25 if k == 0 else 0.5)) for k in range(4))])])
                made = [(attitude, b"unreadable" if h % 5 == 4 else q)]
                if h % 5 != 3:
                    made.append((orbit, fits.encoded([("ORB", [("TIME", "D", nodes), ("LON", "E", line(16.0)), ("LAT", "E", line(8.0)), ("ALT", "E", line(1.0))])])))
                yield pa.RecordBatch.from_pylist([{"path": p, "content": c} for p, c in made])

    keyed = e.withColumn("path", F.concat(named("grm_evt", "svom_grm_evt"), F.lit("@"), F.col("h").cast("string")))
    fits.written(keyed.groupBy("path").applyInArrow(events, "path string, content binary"), root)
    other = e.select("h").distinct().select("h", named("att", "svom_att").alias("attitude"), named("orb", "svom_orb").alias("orbit"))
    fits.written(other.mapInArrow(lines, "path string, content binary"), root)
    last = e.agg(F.max("h")).first()[0] + 2
    hours = s.range(last + 1).select(F.timestamp_seconds(F.lit(base) + F.col("id") * 3600).alias("hour"))
    key = archive.CONF["SVOM"]
    before = s.conf.get(key, None)
    s.conf.set(key, root)
    try:
        found, errors = mission.run_mission(s, clock.SVOM, hours, paths.new_folder(s, "work"))
    finally:
        s.conf.unset(key) if before is None else s.conf.set(key, before)
    micros = lambda c: F.round((F.col(c) - zero) * 1e6).cast("long")
    start, h = micros("start.time"), F.floor((F.col("start.time") - zero) / 3600)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    shown = found.select(h.alias("h"), F.lit("signal").alias("what"), *none("string", "message"), (start - h * 3_600_000_000).alias("start"), (micros("stop.time") - h * 3_600_000_000).alias("stop"), F.round(F.col("bin_size_best") * 1e6).cast("long").alias("bin_best"), "count", r("attitude.q1", 9).alias("q1"), r("position.longitude", 6).alias("longitude"))
    wrong = errors.select(((F.unix_seconds("hour") - base) / 3600).cast("long").alias("h"), F.col("kind").alias("what"), F.when(F.col("kind") == "FileNotFound", F.col("message")).alias("message"), *none("long", "start", "stop", "bin_best", "count"), *none("double", "q1", "longitude"))
    return shown.union(wrong)


# ---- saturation --------------------------------------------------------------------------------------------------------
#: Every event is a science packet: ten a second of each of three boxes in two chunks of ten minutes; a packet's three good records tell
#: where in its second it lies, and the second's first one bears the clock mark, which box B loses every eleventh second.
_PACKS = """pk AS (SELECT event_id, event_id // 60 + 1000 sec, event_id % 3 b, event_id // 36000 * 2 + event_id // 3 % 2 chunk, event_id % 60 // 6 q, event_id * 7919 % 3470 w FROM events)"""
_ENG = """eng AS (SELECT chunk, b, sec AS row, sec - 500 stime, CASE WHEN sec % 29 = 0 AND chunk % 2 = 1 THEN 0 WHEN sec % 17 IN (3, 4) THEN sec - sec % 17 + 2 ELSE sec END bus FROM pk WHERE q = 0),
 clk AS (SELECT *, first(bus) OVER (PARTITION BY chunk, b, run ORDER BY row) + row_number() OVER (PARTITION BY chunk, b, run ORDER BY row) - 1 repaired FROM (SELECT *, sum(moved) OVER (PARTITION BY chunk, b ORDER BY row ROWS UNBOUNDED PRECEDING) run FROM (SELECT *, CASE WHEN bus = lag(bus) OVER (PARTITION BY chunk, b ORDER BY row) THEN 0 ELSE 1 END moved FROM eng)))"""
_PIVOTS = """cand AS (SELECT event_id id, event_id // 36000 * 2 + event_id // 3 % 2 chunk, CAST(round(event_id // 60 + 1000 + event_id % 10 / 10.0 + 0.03) AS BIGINT) stamp FROM events WHERE event_type = 'purchase'), boxes AS (SELECT DISTINCT chunk, b FROM eng),
 piv AS (SELECT id, cand.chunk, boxes.b, stamp, coalesce((SELECT arg_min(stime, row) FROM clk WHERE clk.chunk = cand.chunk AND clk.b = boxes.b AND bus = stamp), (SELECT arg_min(stime, row) FROM clk WHERE clk.chunk = cand.chunk AND clk.b = boxes.b AND repaired = stamp)) "pivot" FROM cand JOIN boxes ON boxes.chunk = cand.chunk)"""
_WIDE = """near AS (SELECT id, piv.b, "pivot", pk.*, row_number() OVER (PARTITION BY id, piv.b ORDER BY event_id) pack, CASE WHEN q = 0 AND NOT (piv.b = 1 AND sec % 11 = 0) THEN sec - 500 END mark FROM piv JOIN pk ON pk.chunk = piv.chunk AND pk.b = piv.b AND sec BETWEEN stamp - 2 AND stamp + 2 WHERE "pivot" IS NOT NULL),
 span AS (SELECT * FROM (SELECT *, max(pack) FILTER (mark = "pivot" - 1) OVER (PARTITION BY id, b) f, max(pack) FILTER (mark = "pivot" + 1) OVER (PARTITION BY id, b) l FROM near) WHERE pack BETWEEN f AND l),
 tick AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY id, b ORDER BY pack ROWS UNBOUNDED PRECEDING), "pivot" - 1) + CASE WHEN mark IS NOT NULL THEN 0 WHEN q = 0 THEN 100 ELSE q * 50000 END * 2e-6 lo, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY id, b ORDER BY pack ROWS UNBOUNDED PRECEDING), "pivot" - 1) + ((q + 1) * 50000 - w) * 2e-6 hi FROM span),
 wide AS (SELECT id, b, coalesce(max(gap) > 0.0069, false) wide FROM (SELECT id, b, lead(lo) OVER (PARTITION BY id, b ORDER BY pack) - hi gap FROM tick) GROUP BY 1, 2)"""


def _packets(s, d) -> DataFrame:
    e = F.col("event_id")
    x = spread(s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")).select(e, "event_type", (F.floor(e / 60) + 1000).alias("sec"), (e % 3).cast("int").alias("b"), (F.floor(e / 36_000) * 2 + F.floor(e / 3) % 2).alias("chunk"), F.floor(e % 60 / 6).alias("q"), (e * 7919 % 3470).alias("w"))
    return x.withColumns({"box": F.element_at(F.array(*map(F.lit, "ABC")), F.col("b") + 1), "row": e})


def _science(x: DataFrame) -> DataFrame:
    q, base = F.col("q"), F.col("q") * 50_000
    lost = (F.col("b") == 1) & (F.col("sec") % 11 == 0)
    first = F.when(q == 0, F.when(lost, 0x30).otherwise(0x10)).otherwise(F.when(F.col("event_id") % 2 == 0, 0x20).otherwise(0))
    bad = bytes([0] * 7 + [0x30 | packets.CRC4[3]])  # type bits that no record has, with a right remainder
    records = [packets.packed(first, F.when(first == 0x10, F.col("sec") - 500).otherwise(7), base), packets.packed(F.lit(0), F.lit(9), base + 100), packets.packed(F.lit(0x20), F.lit(9), base + 50_000 - F.col("w"))]
    end = F.concat(*[F.lpad(F.hex(F.shiftright(F.col("sec"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])
    data = F.concat(F.lit(bytes(6)), *records, F.lit(bad * 106), F.unhex(end))
    return x.select("chunk", "box", "row", data.alias("ccsds"))


def _engineering(x: DataFrame) -> DataFrame:
    sec = F.col("sec")
    bus = F.when((sec % 29 == 0) & (F.col("chunk") % 2 == 1), 0).when((sec % 17).isin(3, 4), sec - sec % 17 + 2).otherwise(sec)
    text = F.concat(F.lit("0000"), *[F.lpad(F.hex(F.shiftright(bus, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])
    return x.where("q = 0").select("chunk", "box", sec.alias("row"), (sec - 500).cast("int").alias("stime"), F.unhex(text).alias("bus"))


def _asked(x: DataFrame) -> DataFrame:
    return x.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "chunk", (F.col("sec") + F.col("event_id") % 10 / 10.0 + 0.03).alias("met"))


@query(f"WITH {_PACKS}, {_ENG} SELECT chunk, ['A', 'B', 'C'][b + 1] box, row, bus bus_time, CAST(repaired AS BIGINT) repaired FROM clk")
def repaired_clocks(s, d):
    return saturation.clock_rows(_engineering(_packets(s, d))).select("chunk", "box", "row", "bus_time", "repaired")


@query(f"WITH {_PACKS}, {_ENG}, {_PIVOTS} SELECT id, ['A', 'B', 'C'][b + 1] box, stamp, \"pivot\" FROM piv")
def clock_pivots(s, d):
    x = _packets(s, d)
    return saturation.pivots(_asked(x), _engineering(x)).select("id", "box", "stamp", "pivot")


@query(f"WITH {_PACKS}, {_ENG}, {_PIVOTS}, {_WIDE} SELECT piv.id, ['A', 'B', 'C'][piv.b + 1] box, coalesce(wide, true) saturated FROM piv LEFT JOIN wide ON wide.id = piv.id AND wide.b = piv.b")
def saturated_boxes(s, d):
    x = _packets(s, d)
    return saturation.saturated_boxes(_asked(x), _engineering(x), _science(x))


@query(f"WITH {_PACKS}, {_ENG}, {_PIVOTS}, {_WIDE} SELECT piv.id FROM piv LEFT JOIN wide ON wide.id = piv.id AND wide.b = piv.b GROUP BY 1 HAVING bool_and(coalesce(wide, true))")
def saturated_candidates(s, d):
    x = _packets(s, d)
    return saturation.saturated(_asked(x), _engineering(x), _science(x))


#: Photons beside the packets: a burst of twelve for each chunk every 25 seconds, every third with another one a second later, so that
#: the session is too long; of the background every seventh photon isn't kept. A chunk's first burst has no clock mark before it, and so
#: counts as saturated.
_CHAIN = """ph AS (SELECT event_id // 36000 * 2 + event_id // 3 % 2 chunk, event_id, event_id % 1500 < 24 OR (event_id % 1500 BETWEEN 60 AND 83 AND event_id // 1500 % 3 = 1) burst FROM events),
 stretch AS (SELECT chunk, (event_id // 60 + 1000) * 1000000 + CASE WHEN burst THEN event_id // 1500 % 10 * 90000 + event_id % 1500 // 60 * 10000 + event_id % 60 * 20 ELSE event_id % 60 * 16000 + event_id * 7919 % 997 END t,
  (1000 + chunk // 2 * 600) * 1000000 low, (1600 + chunk // 2 * 600) * 1000000 high, 0 g FROM ph WHERE burst OR event_id % 7 > 0)"""
_CHAIN += ", ev AS (" + _RUN.split(" ev AS (", 1)[1] + ", " + _MERGED.replace("cand AS (", "islands AS (")
_CHAIN += """, v1 AS (SELECT *, CASE WHEN "start" - lag("start") OVER w > 10000000 OR lead("start") OVER w IS NULL THEN 1 ELSE 0 END cut, lead("start") OVER w IS NULL last FROM islands WINDOW w AS (PARTITION BY chunk ORDER BY "start")),
 v2 AS (SELECT *, sum(cut) OVER (PARTITION BY chunk ORDER BY "start" ROWS UNBOUNDED PRECEDING) session FROM v1),
 v3 AS (SELECT *, max("start") OVER p - min("start") OVER p > 1000000 OR count(*) OVER p >= 10 bad FROM v2 WINDOW p AS (PARTITION BY chunk, session)),
 found AS (SELECT *, chunk * 1000000000000 + "start" id, "start" + bin_best // 2 "at" FROM v3 WHERE NOT bad OR last)"""
_FOUND_PIVOTS = 'cand AS (SELECT id, chunk, CAST(round("start" / 1e6) AS BIGINT) stamp FROM found), boxes AS (' + _PIVOTS.split(" boxes AS (", 1)[1]


@query(f"""WITH {_CHAIN}, {_PACKS}, {_ENG}, {_FOUND_PIVOTS}, {_WIDE}, gone AS (SELECT piv.id FROM piv LEFT JOIN wide ON wide.id = piv.id AND wide.b = piv.b GROUP BY 1 HAVING bool_and(coalesce(wide, true)))
 SELECT "start", stop, bin_best, CAST("count" AS BIGINT) AS count, round("at" / 1e6 / 1024, 9) q1, round(chunk + "at" / 1e9, 6) longitude FROM found WHERE id NOT IN (SELECT id FROM gone)""")
def hxmt_search(s, d):
    """A mission's whole search: kept events, scan, session veto, saturation of three boxes, attitude and position at the peak."""
    i = F.col("event_id")
    chunk, burst = F.floor(i / 36_000) * 2 + F.floor(i / 3) % 2, (i % 1500 < 24) | ((i % 1500).between(60, 83) & (F.floor(i / 1500) % 3 == 1))
    second, low = (F.floor(i / 60) + 1000) * 1_000_000, (F.floor(F.col("chunk") / 2) * 600 + 1000) * 1_000_000
    t = second + F.when(burst, F.floor(i / 1500) % 10 * 90_000 + F.floor(i % 1500 / 60) * 10_000 + i % 60 * 20).otherwise(i % 60 * 16_000 + i * 7919 % 997)
    events = s.read.parquet(f"{d}/events.parquet").select(chunk.alias("chunk"), t.alias("t"), F.when(burst | (i % 7 > 0), 100).otherwise(10).alias("pulse_width"), F.lit(0).alias("event_type"), F.lit(50).alias("channel"))
    events = events.withColumns({"start": low, "stop": low + 600_000_000})
    # Nodes on lines through time, so that SQL needs no as-of join.
    nodes = events.select("chunk", F.explode(F.array(*[F.col("start") + k for k in (-1_000_000, 250_000_000, 601_000_000)])).alias("t")).distinct()
    path = nodes.select("chunk", "t", (F.col("t") / 1e6 / 1024).alias("q1"), F.lit(0.0).alias("q2"), F.lit(0.0).alias("q3"), (F.col("chunk") + F.col("t") / 1e9).alias("longitude"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("altitude"))
    x = _packets(s, d)
    found = search.search_hxmt(events, path.select("chunk", "t", "q1", "q2", "q3"), path.select("chunk", "t", "longitude", "latitude", "altitude"), _engineering(x), _science(x), clock.HXMT)
    micros = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return found.select(micros("start.time").alias("start"), micros("stop.time").alias("stop"), micros("bin_size_best").alias("bin_best"), "count", r("attitude.q1").alias("q1"), r("position.longitude", 6).alias("longitude"))


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
