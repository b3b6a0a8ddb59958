"""Small helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Most rows that are ever broadcast; beyond it the join shuffles both sides.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


#: Texts that a task holds as Python strings at once.
_TEXTS = 512


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | None]:
    """The texts of a batch in order, of which few are Python strings at a time."""
    for a in range(0, batch.num_rows, _TEXTS):
        yield from batch[name].slice(a, _TEXTS).to_pylist()


def trimmed(run: Callable) -> Callable:
    """run, a function of Arrow batches, after which its worker gives freed memory back, so that idle workers stay small."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return whole


def row_hash(df: DataFrame, seed: int = 42) -> Column:
    """A 64-bit hash of all columns of a row, maps and variants as text: rows that differ anywhere differ in it."""
    plain = lambda f: F.to_json(F.struct(f.name)) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`")
    return F.xxhash64(F.lit(seed), *map(plain, df.schema.fields))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a new
    folder that goes with the session; a cluster is told to set it, as executors can't read each other's disks."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkburst-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found


_scratch: list[list[DataFrame]] = []


def _at(df: DataFrame, path: str):
    """(Hadoop path, its file system)."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: it survives lost executors, and its lineage ends.

    The table goes when it is dropped(), with the scratch() it was made in, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _at(df, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes what stored() wrote; nothing may read it later."""
    for df in tables:
        if path := getattr(df, "_stored_path", None):
            where, system = _at(df, path)
            system.delete(where, True)
            df._stored_path = None


@contextmanager
def scratch():
    """Tables stored inside are dropped at the end, but for those taken out of the list that is given.

    Spark removes the shuffle files of finished steps once the driver has let go of their plans, so both collectors run.
    """
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        dropped(*_scratch.pop())
        gc.collect()
        if (context := SparkContext._active_spark_context) is not None:
            context._jvm.System.gc()


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, stored; whatever else it stored on its way goes."""
    with scratch() as made:
        out = stored(make())
        made.remove(out)
    if _scratch:
        _scratch[-1].append(out)
    return out


def join_checked(left: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """A join that broadcasts `small` (a stored table) if it has BROADCAST_ROWS rows at most, and else shuffles."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(small) if few else small, on, how)


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those whose names, in any case, are among names: outputs replace them."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
