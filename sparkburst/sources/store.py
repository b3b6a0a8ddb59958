"""Catalogue tables that are stored: snapshots by month, committed by compare-and-set."""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkburst.operators import catalog


class ConflictError(RuntimeError):
    """Other writers were first each time."""


@dataclass(frozen=True)
class Snapshot:
    """A version: which write holds each month's rows."""

    version: int
    months: dict[str, str]


@dataclass
class Store:
    """A table in a folder that all executors share, of columns ddl, with its time column and the key that sorts its files.

    Rows lie under data/in_write=<name>/in_month=<yyyy-MM>/ in files sorted by time and key, so that bounds on the time prune
    months and row groups. A version is a small file that names the write of each month; versions are only ever added, each by
    the one writer that creates the next number's file. A writer reads the last version, writes the months that it
    changes anew and adds a version; if another was first, its files go and it starts again from the other's version. So
    readers see whole versions, no change is lost, and a failed writer leaves nothing that is read.

    Times are texts that begin with yyyy-MM, or timestamps; rows without such a time are the month "none".
    """

    spark: SparkSession
    path: str
    ddl: str
    time: str
    keys: tuple[str, ...]
    attempts: int = 20

    def month_of(self) -> Column:
        text = isinstance(T.StructType.fromDDL(self.ddl)[self.time].dataType, T.StringType)
        found = F.substring(self.time, 1, 7) if text else F.date_format(self.time, "yyyy-MM")
        return F.when(found.rlike(r"^\d{4}-\d{2}$"), found).otherwise("none")

    # -- versions

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _local(self, path: str) -> str | None:
        where, system = self._files(path)
        return where.toUri().getPath() if system.getUri().getScheme() == "file" else None

    def versions(self) -> list[int]:
        where, system = self._files(f"{self.path}/versions")
        names = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last version, or an earlier one; version 0 is the empty table."""
        last = (self.versions() or [0])[-1] if version is None else version
        if not last:
            return Snapshot(0, {})
        for _ in range(50):  # a version's file may be seen just before its content
            row = self.spark.read.text(f"{self.path}/versions/{last:010d}", wholetext=True).first()
            if row and row[0]:
                return Snapshot(last, json.loads(row[0]))
            time.sleep(0.1)
        raise ConflictError(f"version {last} of {self.path} is empty")

    def _add(self, version: int, months: dict[str, str]) -> bool:
        """Creates the version's file, or gives False if there is one: only one writer can."""
        path, text = f"{self.path}/versions/{version:010d}", json.dumps(months)
        if (local := self._local(path)) is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            held = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
            with open(held, "w") as f:
                f.write(text)
            try:
                os.link(held, local)  # fails if the name is taken
            except FileExistsError:
                return False
            finally:
                os.unlink(held)
            return True
        where, system = self._files(path)
        try:
            out = system.create(where, False)
        except Exception as e:
            if system.exists(where):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    # -- rows

    def frame(self, snapshot: Snapshot, months: list[str] | None = None) -> DataFrame:
        """The rows of a snapshot, or of some months of it, with their column in_month."""
        fields = T.StructType.fromDDL(self.ddl)
        schema = T.StructType([*fields, T.StructField("in_write", T.StringType()), T.StructField("in_month", T.StringType())])
        held = [f"{self.path}/data/in_write={w}/in_month={m}" for m, w in sorted(snapshot.months.items()) if months is None or m in months]
        if not held:
            return self.spark.createDataFrame([], schema).drop("in_write")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*held).drop("in_write")

    def read(self, version: int | None = None) -> DataFrame:
        return self.frame(self.snapshot(version)).drop("in_month")

    def between(self, first: str, last: str) -> DataFrame:
        """Rows with first <= time <= last: other months aren't listed, other row groups aren't read."""
        kind = T.StructType.fromDDL(self.ddl)[self.time].dataType
        rows = self.frame(self.snapshot())
        month = F.col("in_month").between(first[:7], last[:7])
        return rows.where(month & F.col(self.time).between(F.lit(first).cast(kind), F.lit(last).cast(kind))).drop("in_month")

    def _write(self, rows: DataFrame, name: str) -> None:
        out = rows.withColumn("in_month", self.month_of()).repartitionByRange("in_month", self.time, *self.keys).sortWithinPartitions("in_month", self.time, *self.keys)
        out.write.partitionBy("in_month").parquet(f"{self.path}/data/in_write={name}")

    def _remove(self, name: str) -> None:
        where, system = self._files(f"{self.path}/data/in_write={name}")
        system.delete(where, True)

    def change(self, plan: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> int:
        """Adds a version. plan(rows) gives (in_month) of the rows that change, and how those months' rows become new ones.

        Only those months are read in full and written; the driver sees names of months. plan is called again, with the rows
        of the version that is last by then, if another writer was first. Without a month to change no version is added.
        """
        for _ in range(self.attempts):
            now = self.snapshot()
            touched, made = plan(self.frame(now))
            months = sorted(r[0] for r in touched.select("in_month").distinct().collect())
            if not months:
                return now.version
            name = uuid.uuid4().hex
            self._write(catalog.conformed(made(self.frame(now, months)), self.ddl), name)
            where, system = self._files(f"{self.path}/data/in_write={name}")
            found = [f.getPath().getName().removeprefix("in_month=") for f in system.listStatus(where) if f.isDirectory()]
            if self._add(now.version + 1, {m: w for m, w in now.months.items() if m not in months} | dict.fromkeys(found, name)):
                return now.version + 1
            self._remove(name)
            time.sleep(random.uniform(0, 0.2))
        raise ConflictError(f"{self.attempts} times another writer of {self.path} was first")

    def vacuum(self, keep: int = 2) -> None:
        """Removes writes and versions that the last `keep` versions don't need; nothing may write or read older ones meanwhile."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        used = {w for v in kept for w in self.snapshot(v).months.values()}
        where, system = self._files(f"{self.path}/data")
        for f in system.listStatus(where) if system.exists(where) else []:
            if (name := f.getPath().getName().removeprefix("in_write=")) not in used:
                self._remove(name)
        for v in old:
            at, system = self._files(f"{self.path}/versions/{v:010d}")
            system.delete(at, False)

    # -- what catalogues do

    def insert(self, new: DataFrame, add: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Adds the new rows that break no key, judged by add(table, new); conflicts are passed over. add sees the months of
        the new rows if all keys hold the time, and gives the table with the new rows."""
        fresh = catalog.conformed(new, self.ddl)
        return self.change(lambda rows: (fresh.select(self.month_of().alias("in_month")), lambda held: add(held.drop("in_month"), fresh)))

    def update(self, hit: Column, change: Callable[[DataFrame], DataFrame]) -> int:
        """Changes rows; hit tells which months have any."""
        return self.change(lambda rows: (rows.where(hit).select("in_month"), lambda held: change(held.drop("in_month"))))


def task_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, catalog.TASK, "time", ("satellite", "detector"))


def statistics_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, catalog.STATISTICS, "time", ("what",))


def signal_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, catalog.SIGNAL, "start_full", ("satellite", "detector", "id"))


def insert_tasks(store: Store, new: DataFrame) -> int:
    """Adds tasks whose satellite, detector and time the table doesn't have."""
    return store.insert(new, lambda table, fresh: catalog.added(table, fresh, list(catalog.TASK_KEYS)))


def insert_statistics(store: Store, new: DataFrame) -> int:
    return store.insert(new, lambda table, fresh: catalog.added(table, fresh, list(catalog.STATISTICS_KEYS)))


def insert_signals(store: Store, new: DataFrame) -> int:
    """Adds signals that break neither key. An id may stand in any month, so new ids are held against the whole table's, of
    which only that column is read."""
    fresh = catalog.conformed(new, store.ddl)

    def plan(rows: DataFrame):
        others = rows.select("id", F.col("in_month").alias("__month")).where("id IS NOT NULL")

        def made(held: DataFrame) -> DataFrame:
            months = held.select("in_month").distinct().withColumnRenamed("in_month", "__month")
            elsewhere = others.join(months, "__month", "left_anti").select("id").distinct()
            usable = fresh.join(elsewhere, "id", "left_anti")
            return catalog.added_signals(held.drop("in_month"), usable)

        return fresh.select(store.month_of().alias("in_month")), made

    return store.change(plan)


def reset_tasks(store: Store, status: str, now: Column) -> int:
    """Tasks of a status are Pending again, one more retry, in the stored table."""
    return store.update(F.col("status") == status, lambda rows: catalog.reset(rows, status, now))


def claim_tasks(store: Store, worker: str, n: int, now: Column) -> DataFrame:
    """The n earliest Pending tasks, which are Running and the worker's from then on: no two workers get one task."""
    keys = list(catalog.TASK_KEYS)
    mark = f"{worker}/{uuid.uuid4().hex[:8]}"

    def plan(rows: DataFrame):
        due = rows.where("status = 'Pending'").orderBy("time", "satellite", "detector").limit(n)

        def made(held: DataFrame) -> DataFrame:
            mine = F.col("__mine").isNotNull()
            out = held.drop("in_month").join(due.select(*keys, F.lit(True).alias("__mine")), keys, "left")
            return out.withColumns({"status": F.when(mine, "Running").otherwise(F.col("status")), "worker": F.when(mine, mark).otherwise(F.col("worker")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))})

        return due.select("in_month"), made

    store.change(plan)
    return store.read().where(F.col("worker") == mark)
