"""Files by path from inside tasks: ranges are read and whole small files written, without a copy on the driver."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def system_of(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path inside it) of a local path or a URI that Arrow knows (file, hdfs, s3, gs, abfs)."""
    if not re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))


class Ranged:
    """A file that is read by ranges; counts the bytes that it has read."""

    def __init__(self, path: str):
        system, inside = system_of(path)
        self._file, self.taken = system.open_input_file(inside), 0
        self.size = self._file.size()

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        out = self._file.read_at(n, at) if n else b""
        self.taken += len(out)
        return out

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def write(path: str, data: bytes) -> None:
    """Writes a file under another name and then gives it its own, so that no reader sees a part of it."""
    system, inside = system_of(path)
    folder, _, name = inside.rpartition("/")
    system.create_dir(folder, recursive=True)
    held = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(held) as out:
        out.write(data)
    system.move(held, inside)


def read_whole(path: str) -> bytes | None:
    """A small file's bytes, or None if there is no such file."""
    system, inside = system_of(path)
    try:
        with system.open_input_file(inside) as f:
            return f.read()
    except FileNotFoundError:
        return None


def names(folder: str) -> list[str]:
    """Names of the files in a folder, in order; none if there is no such folder."""
    system, inside = system_of(folder)
    found = system.get_file_info(pafs.FileSelector(inside, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File)


def found(path: str) -> list[str]:
    """Files that a path names: itself, all below a folder, or those that fit a pattern in its last part."""
    system, inside = system_of(path)
    lead = path[: len(path) - len(inside)] if path.endswith(inside) else "file://"
    folder, _, last = inside.rpartition("/")
    if any(c in last for c in "*?"):
        fits = re.compile(re.escape(last).replace(r"\*", ".*").replace(r"\?", "."))
        listed = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(lead + f.path for f in listed if f.type == pafs.FileType.File and fits.fullmatch(f.base_name))
    info = system.get_file_info(inside)
    if info.type == pafs.FileType.Directory:
        return sorted(lead + f.path for f in system.get_file_info(pafs.FileSelector(inside, recursive=True)) if f.type == pafs.FileType.File)
    return [path] if info.type == pafs.FileType.File else []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Where that is unset a local master gets one of its own; a cluster is told to set it.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit
        import shutil
        import tempfile

        shared = tempfile.mkdtemp(prefix="sparkburst-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
        shared = context.getCheckpointDir()
    path = f"{shared.rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
