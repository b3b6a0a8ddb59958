"""Which file of an archive serves which hour, and reading of signals and strokes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkburst.sources import files as paths

#: Folder codes of level 1B files by kind and box.
CODES_1B = {("eng", "A"): "0766", ("eng", "B"): "1009", ("eng", "C"): "1781", ("sci", "A"): "0642", ("sci", "B"): "0922", ("sci", "C"): "1686"}
KINDS_1K = {"events": "HE-Evt", "orbit": "Orbit", "attitude": "Att"}
KINDS_SVOM = {"events": ("grm_evt", "svom_grm_evt"), "attitude": ("att", "svom_att"), "orbit": ("orb", "svom_orb")}
#: Columns of the lightning table.
STROKES = "time string, lat double, lon double, resid double, nstn long, energy double, energy_uncertainty double, estn long"
#: Session settings that name the archives' folders.
CONF = {"1K": "spark.sparkburst.hxmt.1k.dir", "1B": "spark.sparkburst.hxmt.1b.dir", "SVOM": "spark.sparkburst.svom.dir", "strokes": "spark.sparkburst.lightning.path"}
#: A signal as it is published: the columns of signal tables besides mission and day, and the objects of the JSON arrays.
SIGNAL_JSON = "start struct<time:double>, stop struct<time:double>, bin_size_min double, bin_size_max double, bin_size_best double, delay double, count long, mean double, sf double, false_positive_per_year double, attitude struct<q1:double,q2:double,q3:double>, position struct<longitude:double,latitude:double,altitude:double>"


def root(spark: SparkSession, archive: str) -> str:
    """The folder that the session names for an archive (a key of CONF)."""
    if not (found := spark.conf.get(CONF[archive], None)):
        raise ValueError(f"set {CONF[archive]} to the {archive} archive's folder")
    return found.rstrip("/")


def listing(folders: DataFrame, root: str) -> DataFrame:
    """(folder, name, listed) of the files in just those folders (folder: a path below root), each listed once, by a task.

    No other folder is looked at, however large the archive; contents aren't read. A folder that isn't there has no files.
    Files are listed by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                found = paths.names(f"{root}/{folder}")
                yield pa.RecordBatch.from_arrays([pa.array([folder] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(found, pa.string())], ["folder", "name", "listed"])

    spread = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = folders.where("folder IS NOT NULL").select("folder").distinct()
    return asked.repartition(spread, "folder").mapInArrow(run, "folder string, name string, listed string")


def hour_of(file: Column) -> Column:
    """The hour that a file's name tells: yyyyMMddTHH of the level 1 files, or yyMMdd_HH."""
    name = F.substring_index(file, "/", -1)
    long, short = F.regexp_extract(name, r"_(\d{8}T\d{2})", 1), F.regexp_extract(name, r"_(\d{6}_\d{2})_v", 1)
    return F.coalesce(F.try_to_timestamp(long, F.lit("yyyyMMdd'T'HH")), F.try_to_timestamp(short, F.lit("yyMMdd_HH")))


def box_of(file: Column) -> Column:
    """A, B or C by the code in a level 1B file's name; else null."""
    code = F.regexp_extract(F.substring_index(file, "/", -1), r"^HXMT_1B_(\d{4})_", 1)
    return F.element_at(F.create_map(*[F.lit(x) for (_, box), c in CODES_1B.items() for x in (c, box)]), code)


def folder_1k(hour: Column) -> Column:
    number = F.datediff(hour.cast("date"), F.lit("2017-06-15").cast("date")) + 1
    return F.concat(F.lit("Y"), F.date_format(hour, "yyyyMM"), F.lit("/"), F.date_format(hour, "yyyyMMdd"), F.lit("-"), F.lpad(number.cast("string"), 4, "0"))


def _latest(hits: DataFrame, keys: list[str], version: Column, later_wins: bool) -> DataFrame:
    order = [version.desc(), F.col("listed").desc() if later_wins else F.col("listed").asc()]
    return hits.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def wanted_1k(hours: DataFrame) -> DataFrame:
    """(hour, kind, folder, prefix): where an hour's files lie and how their names begin."""
    kinds = [hours.select("hour", F.lit(kind).alias("kind"), folder_1k(F.col("hour")).alias("folder"), F.concat(F.lit("HXMT_"), F.date_format("hour", "yyyyMMdd'T'HH"), F.lit(f"_{part}_FFFFFF_V")).alias("prefix")) for kind, part in KINDS_1K.items()]
    return reduce(DataFrame.unionByName, kinds)


def wanted_1b(hours: DataFrame) -> DataFrame:
    codes = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("box"), F.lit(c).alias("code")) for (k, b), c in CODES_1B.items()])
    each = hours.select("hour", F.explode(codes).alias("c")).select("hour", "c.*")
    return each.withColumns({"folder": F.concat(F.date_format("hour", "yyyy/yyyyMMdd/"), "code"), "prefix": F.concat(F.lit("HXMT_1B_"), "code", F.lit("_"), F.date_format("hour", "yyyyMMdd'T'HH"))})


def wanted_svom(hours: DataFrame) -> DataFrame:
    kinds = [hours.select("hour", F.lit(kind).alias("kind"), F.concat(F.date_format("hour", "yyyy/MM/dd/"), F.lit(folder)).alias("folder"), F.concat(F.lit(f"{stem}_"), F.date_format("hour", "yyMMdd_HH"), F.lit("_v")).alias("prefix")) for kind, (folder, stem) in KINDS_SVOM.items()]
    return reduce(DataFrame.unionByName, kinds)


def _hits(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    return wanted.join(listing, "folder").where(F.startswith("name", "prefix"))


def resolve_1k(hours: DataFrame, listing: DataFrame) -> DataFrame:
    """(hour, kind, file): the highest one-digit version; of equals the one listed last. listing: (folder, name, listed)."""
    version = F.coalesce(F.expr("try_cast(substring(name, char_length(prefix) + 1, 1) AS int)"), F.lit(0))
    return _latest(_hits(wanted_1k(hours), listing), ["hour", "kind"], version, True).select("hour", "kind", F.concat_ws("/", "folder", "name").alias("file"))


def resolve_1b(hours: DataFrame, listing: DataFrame) -> DataFrame:
    """(hour, kind, box, file): the highest digit at place 40 of the name; of equals the one listed first."""
    digit = F.substring("name", 40, 1)
    hits = _hits(wanted_1b(hours), listing).where((F.char_length("name") >= 40) & digit.rlike("^[0-9]$"))
    return _latest(hits, ["hour", "kind", "box"], digit, False).select("hour", "kind", "box", F.concat_ws("/", "folder", "name").alias("file"))


def complete_1b(resolved: DataFrame) -> DataFrame:
    """Hours for which all six files are there."""
    return resolved.groupBy("hour").agg(F.count("*").alias("n")).where(F.col("n") == len(CODES_1B)).select("hour")


def resolve_svom(hours: DataFrame, listing: DataFrame) -> DataFrame:
    """(hour, kind, file): the last name by order."""
    named = _hits(wanted_svom(hours), listing).groupBy("hour", "kind", "folder").agg(F.max("name").alias("name"))
    return named.select("hour", "kind", F.concat_ws("/", "folder", "name").alias("file"))


def chunks(hours: DataFrame, resolved: DataFrame, kinds: int) -> tuple[DataFrame, DataFrame]:
    """(complete hours, errors): an hour with a file missing is no chunk but an error row (hour, kind, message)."""
    counted = hours.join(resolved.groupBy("hour").agg(F.count("*").alias("n")), "hour", "left")
    whole = F.coalesce("n", F.lit(0)) == kinds
    errors = counted.where(~whole).select("hour", F.lit("FileNotFound").alias("kind"), F.format_string("%d of %d files", F.coalesce("n", F.lit(0)).cast("int"), F.lit(kinds)).alias("message"))
    return counted.where(whole).select("hour"), errors


def signal_days(days: DataFrame, signals: DataFrame) -> DataFrame:
    """days' columns and signals: every day has its array, in order of the signals' columns, also an empty one."""
    keys = days.columns
    rows = signals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in signals.columns if c not in keys]))).alias("__signals"))
    empty = F.array().cast(rows.schema["__signals"].dataType)
    return days.join(rows, keys, "left").select(*keys, F.coalesce("__signals", empty).alias("signals"))


def time_slices(column: str, first: str, last: str, n: int) -> list[str]:
    """SQL conditions that cut first <= column <= last, texts with microseconds, into n ranges of time."""
    low, high = datetime.fromisoformat(first), datetime.fromisoformat(last)
    cuts = [first, *(f"{low + (high - low) * k / n:%Y-%m-%d %H:%M:%S.%f}" for k in range(1, n))]
    return [f"{column} >= '{a}' AND {column} " + (f"< '{b}'" if b else f"<= '{last}'") for a, b in zip(cuts, [*cuts[1:], None], strict=True)]


def read_by_time(spark: SparkSession, url: str, table: str, column: str, first: str, last: str, slices: int = 16) -> DataFrame:
    """Rows of a database's table with first <= column <= last, read by `slices` connections, each with its own range of
    time in its query, so that no task reads the whole table and rows outside never leave the database."""
    return spark.read.jdbc(url, table, predicates=time_slices(column, first, last, slices))


def read_strokes(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, slices: int = 16) -> DataFrame:
    """Lightning strokes of a Parquet table, or of a JDBC url's table `lightning`, between two times (texts) if they are given.

    A database is asked with a condition on the time for each of `slices` tasks; without bounds it has to be asked whole, by one.
    """
    if path.startswith("jdbc:"):
        if first and last:
            return read_by_time(spark, path, "lightning", "time", first, last, slices)
        return spark.read.format("jdbc").option("url", path).option("dbtable", "lightning").load()
    rows = spark.read.schema(T.StructType.fromDDL(STROKES)).parquet(path)
    return rows.where(F.col("time").between(first, last)) if first and last else rows


def read_catalogue(spark: SparkSession, url: str, first: str, last: str, slices: int = 16) -> DataFrame:
    """Rows of a JDBC url's table `signal` whose start_full lies between two texts."""
    return read_by_time(spark, url, "signal", "start_full", first, last, slices)


def idle_logs(logs: DataFrame, running: DataFrame, stem: str) -> DataFrame:
    """Names of empty logs (name, size) that no running job (id) writes: `stem`.out.id and `stem`.err.id are a job's own."""
    own = running.select(F.explode(F.array(*[F.concat(F.lit(f"{stem}.{kind}."), F.col("id").cast("string")) for kind in ("out", "err")])).alias("name"))
    return logs.where((F.col("size") == 0) & (F.startswith("name", F.lit(f"{stem}.out.")) | F.startswith("name", F.lit(f"{stem}.err.")))).select("name").join(own, "name", "left_anti")
