"""From event tables to signals, for one mission and all its hours at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkburst.functions.clock import Mission, met_from_utc
from sparkburst.operators import events as E
from sparkburst.operators import saturation, trajectory
from sparkburst.operators.scan import ScanConfig, search, vetoed

#: Both missions search from 0 to 1 ms.
CONFIG = ScanConfig(min_duration=0)


def chunked(rows: DataFrame, mission: Mission) -> DataFrame:
    """rows (hour: a timestamp, met: seconds) with integer microseconds t, their file's hour (chunk) and its span.

    The span runs from the mission's clock at the hour to its clock an hour later, leap seconds included; rows beyond it
    stay in their file's chunk. Rows without a finite time are dropped.
    """
    hour = F.unix_micros("hour")
    micros = lambda utc: F.round(met_from_utc(utc, mission) * 1e6).cast("long")
    kept = rows.where(F.col("met").isNotNull() & ~F.isnan("met") & (F.abs("met") != float("inf")))
    return kept.withColumns({"t": F.round(F.col("met") * 1e6).cast("long"), "chunk": F.floor(hour / 3_600_000_000).cast("long"), "start": micros(hour), "stop": micros(hour + 3_600_000_000)})


def signals(found: DataFrame, attitude: DataFrame, orbit: DataFrame, mission: Mission) -> DataFrame:
    """Candidates with attitude (chunk, t, q1..q3) and position (chunk, t, longitude, latitude, altitude) at their peaks, as archive.SIGNAL_JSON with mission and day.

    The peak is the start and half the best width. Candidates without an attitude or a position are dropped. Instants and
    durations are seconds; the day is the file's.
    """
    peaked = found.withColumn("at", F.col("start") + F.floor(F.col("bin_best") / 2))
    out = trajectory.interpolated(peaked, attitude, ["q1", "q2", "q3"])
    out = trajectory.interpolated(out, orbit, ["longitude", "latitude", "altitude"])
    seconds = lambda c: F.col(c) / 1e6
    return out.select(
        F.lit(mission.name).alias("mission"), F.timestamp_seconds(F.col("chunk") * 3600).cast("date").alias("day"),
        F.struct(seconds("start").alias("time")).alias("start"), F.struct(seconds("stop").alias("time")).alias("stop"),
        seconds("bin_min").alias("bin_size_min"), seconds("bin_max").alias("bin_size_max"), seconds("bin_best").alias("bin_size_best"), seconds("delay").alias("delay"),
        "count", "mean", "sf", F.col("fp").alias("false_positive_per_year"), F.struct("q1", "q2", "q3").alias("attitude"), F.struct("longitude", "latitude", "altitude").alias("position"),
    )


def search_hxmt(events: DataFrame, attitude: DataFrame, orbit: DataFrame, engineering: DataFrame, science: DataFrame, mission: Mission, config: ScanConfig = CONFIG) -> DataFrame:
    """Kept events, scan, session veto (10 s, 1 s, 10 triggers), saturation of all three boxes, then attitude and position.

    All tables have their file's chunk; events, attitude and orbit are chunked().
    """
    kept = events.where(E.kept_hxmt(F.col("pulse_width"), F.col("event_type"), F.col("channel")))
    found = vetoed(search(kept, config), 10_000_000, 1_000_000, 10).withColumn("id", F.xxhash64("chunk", "start")).withColumn("met", F.col("start") / 1e6)
    bad = saturation.saturated(found.select("id", "chunk", "met"), engineering, science)
    return signals(found.join(bad, "id", "left_anti").drop("id", "met"), attitude, orbit, mission)


def search_svom(events: DataFrame, attitude: DataFrame, orbit: DataFrame, mission: Mission, config: ScanConfig = CONFIG) -> DataFrame:
    """The detectors' events as one stream, scan, then attitude and position. All tables are chunked()."""
    return signals(search(events, config), attitude, orbit, mission)
