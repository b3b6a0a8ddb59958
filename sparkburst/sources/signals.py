"""Daily signal files: a sink that publishes whole days at once, and their reader."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sparkburst.sources import files as paths
from sparkburst.sources.archive import SIGNAL_JSON, signal_days


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has staged: (staged name, name below the sink's folder)."""

    files: list[tuple[str, str]]


class SignalSink(DataSource):
    """Format "signals": rows (name, text) become files below the path, all of them or none.

    Tasks write their files into a staging folder of the job; only when every task has ended well does the commit give
    them their names, one rename a file, so that no reader sees a part of a day and a failing task leaves the days
    that were there. A retried task stages under names of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "signals"

    def writer(self, schema: T.StructType, overwrite: bool) -> SignalWriter:
        if schema.names != ["name", "text"]:
            raise ValueError("the sink takes rows (name, text)")
        return SignalWriter(self.options["path"].rstrip("/"))


class SignalWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"{path}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        out = []
        for batch in iterator:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held = f"{self.staging}/{uuid.uuid4().hex}"
                paths.write(held, text.encode())
                out.append((held, name))
        return Staged(out)

    def commit(self, messages: list[Staged]) -> None:
        for message in messages:
            for held, name in message.files:
                system, source = paths.system_of(held)
                target = paths.system_of(f"{self.path}/{name}")[1]
                system.create_dir(target.rpartition("/")[0], recursive=True)
                system.move(source, target)
        self._clear()

    def abort(self, messages: list[Staged]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = paths.system_of(self.staging)
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


def day_files(days: DataFrame, signals: DataFrame) -> DataFrame:
    """(name, text): {mission}/{yyyy}/{MM}/{yyyyMMdd}_signals.json and its pretty JSON array, also an empty one, of each of days (mission, day)."""
    fields = [f.name for f in T.StructType.fromDDL(SIGNAL_JSON)]
    rows = signal_days(days.select("mission", "day"), signals.select("mission", "day", *fields))
    name = F.concat_ws("/", "mission", F.date_format("day", "yyyy"), F.date_format("day", "MM"), F.concat(F.date_format("day", "yyyyMMdd"), F.lit("_signals.json")))
    return rows.select(name.alias("name"), F.to_json("signals", {"ignoreNullFields": "false", "pretty": "true"}).alias("text"))


def write_signals(days: DataFrame, signals: DataFrame, path: str) -> None:
    """One JSON array a day of days (mission, day), also for days without signals, published by SignalSink.

    signals has mission, day and SIGNAL_JSON's columns. Only the days given are replaced. A day's signals, of which the
    search's limit allows few, are one value. Nulls of signals are written as null.
    """
    days.sparkSession.dataSource.register(SignalSink)
    day_files(days, signals).write.format("signals").mode("append").save(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals of day files below a path, with the mission and day (yyyyMMdd) of their names; days without signals give no rows."""
    rows = spark.read.schema(T.StructType.fromDDL(SIGNAL_JSON)).option("recursiveFileLookup", "true").option("pathGlobFilter", "*_signals.json").json(path, multiLine=True)
    below = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", path.rstrip("/")))
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), rf"{below}/(.+)/\d{{4}}/\d{{2}}/(\d{{8}})_signals\.json$", k)
    return rows.select("*", part(1).alias("mission"), part(2).alias("date"))
