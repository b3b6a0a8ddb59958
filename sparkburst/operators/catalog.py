"""Task lists and the signal catalogue as tables that are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the three tables, and the keys that tell rows apart.
TASK = "satellite string, detector string, time timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, retry_times int, worker string, status string, error string"
STATISTICS = "time timestamp_ntz, what string, created_at timestamp_ntz, updated_at timestamp_ntz, retry_times int, worker string, status string, error string, value string"
SIGNAL = """id string, satellite string, detector string, start_full string, start_best string, stop_full string, stop_best string, peak string,
duration_full double, duration_best double, false_positive double, false_positive_per_year double,
count_unfiltered_full long, count_unfiltered_best long, count_filtered_full long, count_filtered_best long,
background double, flux_unfiltered_full double, flux_unfiltered_best double, flux_filtered_full double, flux_filtered_best double,
events string, light_curve_1s_unfiltered string, light_curve_1s_filtered string, light_curve_100ms_unfiltered string, light_curve_100ms_filtered string,
longitude double, latitude double, altitude double, q1 double, q2 double, q3 double, orbit string, lightnings string,
associated_lightning_count long, coincidence_probability double, mean_solar_time string, apparent_solar_time string,
day_of_year long, month long, solar_zenith_angle double, solar_zenith_angle_at_noon double, solar_azimuth_angle double"""
TASK_KEYS, STATISTICS_KEYS = ("satellite", "detector", "time"), ("time", "what")
SIGNAL_KEYS = (("satellite", "detector", "start_full"), ("id",))


def conformed(df: DataFrame, ddl: str) -> DataFrame:
    """df with a table's columns, types and order; columns it lacks are null, others are left out."""
    fields = T.StructType.fromDDL(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def added_signals(table: DataFrame, new: DataFrame) -> DataFrame:
    """table and the new signals that break neither key. Of new rows with one key the first by start_full and id stays; a
    null id is no key. Rows are judged by the first key, then by the second."""
    fresh = conformed(new, SIGNAL)
    for keys in SIGNAL_KEYS:
        known = F.lit(True)
        for k in keys:
            known &= F.col(k).isNotNull()
        order = Window.partitionBy(*keys).orderBy("start_full", "id", "satellite", "detector")
        first = fresh.withColumn("__n", F.when(known, F.row_number().over(order)).otherwise(1)).where("__n = 1").drop("__n")
        fresh = first.join(table.select(*keys).where(known), list(keys), "left_anti").select(first.columns)
    return conformed(table, SIGNAL).unionByName(fresh)


def hours(spark: SparkSession, first: str, now: str) -> DataFrame:
    """(time): every hour from first to the first one at or after now."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{first}', TIMESTAMP_NTZ '{now}' + INTERVAL '59:59.999999' MINUTE TO SECOND, INTERVAL 1 HOUR)) AS time")


def added(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows of new whose keys it doesn't have; of equal new keys one stays."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(keys), keys, "left_anti"), allowMissingColumns=True)


def refreshed_tasks(tasks: DataFrame, satellite: str, detector: str, first: str, now: str) -> DataFrame:
    """tasks and a Pending one for each hour of a mission that has none yet."""
    new = hours(tasks.sparkSession, first, now).select(F.lit(satellite).alias("satellite"), F.lit(detector).alias("detector"), "time", F.lit("Pending").alias("status"), F.lit(0).alias("retry_times"))
    return added(tasks, new, list(TASK_KEYS))


def refreshed_statistics(statistics: DataFrame, what: str, first: str, now: str) -> DataFrame:
    new = hours(statistics.sparkSession, first, now).select("time", F.lit(what).alias("what"), F.lit("Pending").alias("status"), F.lit(0).alias("retry_times"))
    return added(statistics, new, list(STATISTICS_KEYS))


def reset(tasks: DataFrame, status: str, now: Column) -> DataFrame:
    """Tasks of a status (Failed, Running) are Pending again, one more retry."""
    hit = F.col("status") == status
    return tasks.withColumns({"status": F.when(hit, "Pending").otherwise(F.col("status")), "retry_times": F.when(hit, F.col("retry_times") + 1).otherwise(F.col("retry_times")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def accepted(signals: DataFrame, before: str) -> DataFrame:
    """Signals before a day that are very improbable, or improbable and associated with lightning."""
    fp = F.col("false_positive_per_year")
    return signals.where((F.col("start_full") < before) & ((fp <= 1e-5) | ((fp <= 1) & (F.col("associated_lightning_count") > 0))))


def point(signals: DataFrame, start_full: str, satellite: str, detector: str) -> DataFrame:
    return signals.where((F.col("start_full") == start_full) & (F.col("satellite") == satellite) & (F.col("detector") == detector))


#: The JSON texts of a catalogue row: associated strokes, in two shapes, and events.
LIGHTNINGS = "array<struct<lightning:struct<time:string,lat:double,lon:double>>>"
EVENTS = "array<struct<time:string,channel:long,keep:boolean,info:struct<scintillator:string,acd:long>>>"


def stroke_places(text: Column) -> Column:
    """Array of (lon, lat) from `lightnings`: elements are objects with a key lightning, or lists that begin with the stroke."""
    named = F.transform(F.from_json(text, LIGHTNINGS), lambda x: x["lightning"])
    listed = F.transform(F.from_json(text, "array<array<string>>"), lambda x: F.from_json(x[0], "time string, lat double, lon double"))
    both = F.coalesce(F.filter(named, lambda s: s.isNotNull()), F.array()), F.coalesce(F.filter(listed, lambda s: s.isNotNull()), F.array())
    return F.transform(F.concat(*both), lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))


def detail_events(signals: DataFrame) -> DataFrame:
    """A row per event of each signal: id, milliseconds after start_full, channel, marker (triangle for NaI), vetoed (any
    anti-coincidence), keep. Texts that aren't JSON and empty lists give no rows."""
    micros = lambda c: F.unix_micros(F.to_timestamp(c))
    e = signals.select("id", "start_full", F.explode(F.from_json("events", EVENTS)).alias("e"))
    return e.select("id", ((micros(F.col("e.time")) - micros(F.col("start_full"))) / 1000).alias("ms"), F.col("e.channel").alias("channel"), F.when(F.col("e.info.scintillator") == "NaI", "triangle").otherwise("circle").alias("marker"), (F.col("e.info.acd") != 0).alias("vetoed"), F.col("e.keep").alias("keep"))
