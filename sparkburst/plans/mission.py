"""A mission's run: hours to files, files to tables, tables to signals, and a day's signals to its file."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkburst.functions.clock import SVOM, Mission
from sparkburst.plans.search import CONFIG, chunked, search_hxmt, search_svom
from sparkburst.operators.scan import ScanConfig
from sparkburst.sources import archive, fits
from sparkburst.sources.signals import write_signals

#: The reader of each kind of file.
HXMT_KINDS = {"events": fits.hxmt_events, "attitude": fits.hxmt_attitude, "orbit": fits.hxmt_orbit, "eng": fits.hxmt_engineering, "sci": fits.hxmt_science}
SVOM_KINDS = {"events": fits.svom_events, "attitude": fits.svom_attitude, "orbit": fits.svom_orbit}


def resolved_files(spark: SparkSession, mission: Mission, hours: DataFrame) -> DataFrame:
    """(hour, kind, path) of the files that serve hours (hour: a timestamp), from the folders that the session names. Only
    the folders of those hours' days are listed, in tasks."""

    def of(at: str, wanted, resolve) -> DataFrame:
        found = resolve(hours, archive.listing(wanted(hours).select("folder"), at))
        return found.select("hour", "kind", F.concat(F.lit(f"{at}/"), "file").alias("path"))

    if mission == SVOM:
        return of(archive.root(spark, "SVOM"), archive.wanted_svom, archive.resolve_svom)
    return of(archive.root(spark, "1K"), archive.wanted_1k, archive.resolve_1k).union(of(archive.root(spark, "1B"), archive.wanted_1b, archive.resolve_1b))


def run_mission(spark: SparkSession, mission: Mission, hours: DataFrame, work: str, config: ScanConfig = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(signals, errors) of a mission's hours: signals as search.signals gives them, errors (hour, kind, message).

    An hour with a file missing, or with one that can't be read, has error rows and no signals; it never stops the others.
    The resolved paths, and each kind's decoded tables, are Parquet tables in a folder of this run under `work`, which all
    executors share; the search reads those. No path comes to the driver. Runs with one `work` don't disturb each other.
    """
    kinds, files = (SVOM_KINDS, 3) if mission == SVOM else (HXMT_KINDS, 9)
    own = f"{work.rstrip('/')}/{uuid.uuid4().hex}"
    resolved_files(spark, mission, hours).write.parquet(f"{own}/paths")
    found = spark.read.schema("hour timestamp, kind string, path string").parquet(f"{own}/paths")
    whole, errors = archive.chunks(hours, found, files)
    used = found.join(whole, "hour", "left_semi")
    tables = {}
    for kind, read in kinds.items():
        rows = read(used.where(F.col("kind") == kind).select("path")).withColumn("hour", archive.hour_of(F.col("file")))
        if kind in ("eng", "sci"):
            rows = rows.withColumn("box", archive.box_of(F.col("file")))
        rows.write.parquet(f"{own}/{kind}")
        tables[kind] = spark.read.schema(rows.schema).parquet(f"{own}/{kind}")
    broken = reduce(DataFrame.union, (t.where("error IS NOT NULL").select("hour", F.lit("Unreadable").alias("kind"), F.concat_ws(": ", "file", "error").alias("message")) for t in tables.values()))
    good = {k: t.where("error IS NULL").join(broken.select("hour").distinct(), "hour", "left_anti") for k, t in tables.items()}
    timed = {k: chunked(good[k], mission) for k in ("events", "attitude", "orbit")}
    if mission == SVOM:
        signals = search_svom(timed["events"], timed["attitude"], timed["orbit"], mission, config)
    else:
        boxed = {k: good[k].withColumn("chunk", F.floor(F.unix_seconds("hour") / 3600).cast("long")) for k in ("eng", "sci")}
        signals = search_hxmt(timed["events"], timed["attitude"], timed["orbit"], boxed["eng"], boxed["sci"], mission, config)
    return signals, errors.union(broken)


def run_days(spark: SparkSession, mission: Mission, first: str, last: str, work: str, out: str, config: ScanConfig = CONFIG) -> DataFrame:
    """Runs the days from first to last, both included, writes a file of signals for each (see signals.write_signals) and returns the errors."""
    hours = spark.sql(f"SELECT explode(sequence(TIMESTAMP '{first} 00:00:00', TIMESTAMP '{last} 23:00:00', INTERVAL 1 HOUR)) AS hour")
    signals, errors = run_mission(spark, mission, hours, work, config)
    days = hours.select(F.lit(mission.name).alias("mission"), F.col("hour").cast("date").alias("day")).distinct()
    write_signals(days, signals, out)
    return errors
