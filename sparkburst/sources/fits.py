"""FITS binary tables as Spark tables: headers are read first, then ranges of rows, each by a task of its own."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkburst.sources import files as paths

_BLOCK = 2880
_CODES = {"L": ("i1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()), "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()), "E": (">f4", T.FloatType()), "D": (">f8", T.DoubleType())}
#: Bytes of a value of each form; X is bits, C and M are complex, P and Q point into the heap.
_SIZES = {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}

#: Tables of the files that the searches read, with the columns that they need.
HXMT_EVENTS = ("Events", "Time double, Det_ID short, Channel short, Pulse_Width short, ACD long, Event_Type short")
HXMT_ATTITUDE = ("ATT_Quater", "Time double, Q1 double, Q2 double, Q3 double")
HXMT_ORBIT = ("Orbit", "Time double, Lon double, Lat double, Alt double")
HXMT_ENGINEERING = ("HE_Eng", "Time int, BUS_Time_Bdc binary")
HXMT_SCIENCE = ("HE_Evt_Src", "CCSDS binary")
SVOM_EVENTS = "TIME double, PI short, GAIN_TYPE short, DEAD_TIME float, EVT_TYPE short, ANTI_COIN short, FLAG short"
SVOM_DETECTORS = ("EVENTS01", "EVENTS02", "EVENTS03")
SVOM_ATTITUDE = ("Quaternion", "TIME double, Q0 double, Q1 double, Q2 double")
SVOM_GTI = ("GTI", "START double, STOP double")
SVOM_EBOUNDS = ("EBOUNDS", "CHANNEL short, E_MIN float, E_MAX float")
SVOM_ORBIT = ("ORB", "TIME double, LON double, LAT double, ALT double")
#: Rows that leave a task at once, and bytes of a table that one task reads.
_BATCH, SPLIT = 1 << 18, 64 << 20


def _cards(block: str) -> Iterator[tuple[str, str]]:
    for k in range(0, len(block), 80):
        card = block[k : k + 80]
        if card.startswith("END") and not card[3:].strip():
            yield "END", ""
            return
        if card[8:10] == "= ":
            value = card[10:].strip()
            if text := re.match(r"'((?:[^']|'')*)'", value):
                yield card[:8].strip(), text[1].replace("''", "'").rstrip()
            else:
                yield card[:8].strip(), value.split("/")[0].strip()


def _header(file: paths.Ranged, at: int) -> tuple[dict[str, str], int]:
    cards: dict[str, str] = {}
    while at + _BLOCK <= file.size:
        block = file.read(at, _BLOCK).decode("ascii", "replace")
        at += _BLOCK
        for name, value in _cards(block):
            if name == "END":
                return cards, at
            cards.setdefault(name, value)
    raise ValueError("header without END")


def tables(file: paths.Ranged) -> Iterator[tuple[str, dict[str, str], int]]:
    """(name, header, start of data) of each extension; data and heaps are passed over unread."""
    at = 0
    while at + _BLOCK <= file.size:
        cards, start = _header(file, at)
        size = abs(int(cards.get("BITPIX", 8))) // 8 if int(cards.get("NAXIS", 0)) else 0
        for k in range(int(cards.get("NAXIS", 0))):
            size *= int(cards[f"NAXIS{k + 1}"])
        size += int(cards.get("PCOUNT", 0)) if "XTENSION" in cards else 0
        if cards.get("XTENSION") == "BINTABLE":
            if start + int(cards["NAXIS1"]) * int(cards["NAXIS2"]) > file.size:
                raise ValueError(f"table {cards.get('EXTNAME', '')} ends before its {cards['NAXIS2']} rows")
            yield cards.get("EXTNAME", ""), cards, start
        at = start + -(-size // _BLOCK) * _BLOCK


def layout(cards: dict[str, str], wanted: list[str] | None = None) -> list[dict]:
    """Where the wanted columns (all, if None) lie in a row: name, form's code and count, place, bytes, zero and scale."""
    out, at = [], 0
    for k in range(1, int(cards["TFIELDS"]) + 1):
        form = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"])
        count, code = int(form[1] or 1), form[2]
        size = -(-count // 8) if code == "X" else count * _SIZES[code]
        name = cards.get(f"TTYPE{k}", f"col{k}")
        if wanted is None or name in wanted:
            if code in "PQ" and wanted is not None:
                raise ValueError(f"column {name} has rows of varying length")
            out.append({"name": name, "code": code, "count": count, "at": at, "size": size, "zero": float(cards.get(f"TZERO{k}", 0)), "scale": float(cards.get(f"TSCAL{k}", 1))})
        at += size
    if missing := set(wanted or ()) - {c["name"] for c in out}:
        raise ValueError(f"no column {sorted(missing)}")
    return out


def column_type(c: dict) -> T.DataType:
    """The type that a column has if none is asked for."""
    if c["code"] in "XCMPQ" or c["code"] == "B" and c["count"] != 1:
        return T.BinaryType()
    if c["code"] == "A":
        return T.StringType()
    kind = T.DoubleType() if c["scale"] != 1 or c["zero"] % 1 else T.LongType() if c["zero"] and c["code"] in "BIJK" else _CODES[c["code"]][1]
    return kind if c["count"] == 1 else T.ArrayType(kind)


def _values(raw: np.ndarray, c: dict) -> np.ndarray:
    """A column's numbers, one row of `count` each. Integers with a zero point become wider ones; logical T is 1."""
    value = raw.view(_CODES[c["code"]][0])
    if c["code"] == "L":
        return value == ord("T")
    if c["scale"] != 1 or c["zero"] % 1:
        return value.astype(np.float64) * c["scale"] + c["zero"]
    if c["code"] == "K" and c["zero"] == 2.0**63:
        return value.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    if c["zero"]:
        return value.astype(np.float64) + c["zero"] if c["code"] in "ED" else value.astype(np.int64) + int(c["zero"])
    return value.astype(value.dtype.newbyteorder("="))


def _column(grid: np.ndarray, c: dict, kind: T.DataType) -> pa.Array:
    """One column of the rows in grid (rows, bytes of a row) as Arrow values of the type asked for."""
    from pyspark.sql.pandas.types import to_arrow_type

    raw, n = np.ascontiguousarray(grid[:, c["at"] : c["at"] + c["size"]]), len(grid)
    if isinstance(kind, T.BinaryType):
        offsets = (np.arange(n + 1) * c["size"]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    if c["code"] == "A":
        return pa.array([bytes(r).split(b"\0")[0].decode("ascii", "replace").rstrip() for r in raw], pa.string()).cast(to_arrow_type(kind))
    if c["code"] == "X":
        value = np.unpackbits(raw, axis=1)[:, : c["count"]].astype(bool)
    elif c["code"] in _CODES:
        value = _values(raw, c)
    else:
        raise ValueError(f"column {c['name']} of form {c['code']} can be read as binary only")
    if isinstance(kind, T.ArrayType):
        flat = pa.array(value.reshape(-1)).cast(to_arrow_type(kind.elementType), safe=False)
        return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * value.shape[1]).astype(np.int32)), flat)
    if value.shape[1] != 1:
        raise ValueError(f"column {c['name']} has {value.shape[1]} values a row: read it as an array or as binary")
    return pa.array(value[:, 0]).cast(to_arrow_type(kind), safe=False)


def _fit(columns: dict[str, dict], fields: list[T.StructField]) -> None:
    """Raises if a column can't be read as the type asked for."""
    for f in fields:
        c, kind = columns[f.name], f.dataType
        if isinstance(kind, T.BinaryType) or c["code"] == "A" or isinstance(kind, T.ArrayType) and c["code"] not in "CM":
            continue
        if c["code"] not in _CODES or c["count"] != 1:
            raise ValueError(f"column {f.name} of form {c['count']}{c['code']} isn't one {kind.simpleString()} a row")


def rows_of(file: paths.Ranged, start: int, width: int, first: int, last: int, columns: list[dict], kinds: list[T.DataType]) -> Iterator[tuple[int, list[pa.Array]]]:
    """(number of the first row, columns) of the rows from first to before last, of which only their bytes are read."""
    step = max(1, min(_BATCH, (8 << 20) // max(1, width)))
    for a in range(first, last, step):
        b = min(last, a + step)
        grid = np.frombuffer(file.read(start + a * width, (b - a) * width), np.uint8).reshape(b - a, width)
        yield a, [_column(grid, c, kind) for c, kind in zip(columns, kinds, strict=True)]


def load(spark: SparkSession, named: str | list[str]) -> DataFrame:
    """(path) of the files that a path, folder or pattern, or a list of them, names. Nothing of them is read."""
    return spark.createDataFrame([(f,) for p in ([named] if isinstance(named, str) else named) for f in paths.found(p)], "path string")


_HEAD = pa.schema([("file", pa.string()), ("hdu", pa.string()), ("start", pa.int64()), ("width", pa.int64()), ("rows", pa.int64()), ("columns", pa.string()), ("error", pa.string())])


def headers(files: DataFrame, hdus: str | tuple[str, ...], schema: str) -> DataFrame:
    """(file, hdu, start, width, rows, columns, error) of the tables `hdus` in files (path): only headers are read, in tasks."""
    names = (hdus,) if isinstance(hdus, str) else hdus
    fields = list(T.StructType.fromDDL(schema).fields)
    wanted = [f.name for f in fields]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                found: dict[str, dict] = {}
                try:
                    with paths.Ranged(path) as file:
                        for name, cards, start in tables(file):
                            if name in names and name not in found:
                                by_name = {c["name"]: c for c in layout(cards, wanted)}
                                found[name] = {"file": path, "hdu": name, "start": start, "width": int(cards["NAXIS1"]), "rows": int(cards["NAXIS2"]), "columns": json.dumps([by_name[n] for n in wanted])}
                                _fit(by_name, fields)
                            if len(found) == len(names):
                                break
                    if missing := [n for n in names if n not in found]:
                        raise ValueError(f"no table {', '.join(missing)}")
                    rows = list(found.values())
                except (ValueError, KeyError, IndexError, TypeError, FileNotFoundError, IsADirectoryError) as e:
                    rows = [{"file": path, "error": str(e) or type(e).__name__}]
                yield pa.RecordBatch.from_pylist(rows, _HEAD)

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.where("path IS NOT NULL").select("path").repartition(spread, "path").mapInArrow(heads, "file string, hdu string, start long, width long, rows long, columns string, error string")


def decoded(files: DataFrame, hdus: str | tuple[str, ...], schema: str, split: int = SPLIT) -> DataFrame:
    """(file, hdu, row, error, columns...) of the tables `hdus` in files (path).

    One stage reads the files' headers, by ranges, and cuts each table into runs of about `split` bytes of rows; the next
    reads each run by itself. So paths and headers stay in tasks, a file may be of any size, and a hot file is many tasks.
    Only the columns asked for are decoded. A file with a table or column missing, with broken headers, fewer bytes than
    its rows need, or that isn't there, gives one row with its error and nothing else: it never fails the job, and never
    gives a part of its rows. A path given twice is read twice; a null path gives nothing.
    """
    fields = list(T.StructType.fromDDL(schema).fields)
    kinds = [f.dataType for f in fields]
    out = T.StructType([T.StructField("file", T.StringType()), T.StructField("hdu", T.StringType()), T.StructField("row", T.LongType()), T.StructField("error", T.StringType()), *fields])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for part in batch.to_pylist():
                if part["error"] is not None:
                    empty = [pa.nulls(1, to_arrow_type(f.dataType)) for f in fields]
                    yield pa.RecordBatch.from_arrays([pa.array([part["file"]]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([part["error"]]), *empty], out.names)
                    continue
                with paths.Ranged(part["file"]) as file:
                    for a, body in rows_of(file, part["start"], part["width"], part["first"], part["last"], json.loads(part["columns"]), kinds):
                        n = len(body[0])
                        yield pa.RecordBatch.from_arrays([pa.array([part["file"]] * n, pa.string()), pa.array([part["hdu"]] * n, pa.string()), pa.array(np.arange(a, a + n)), pa.nulls(n, pa.string()), *body], out.names)

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planned = headers(files, hdus, schema)
    run_rows = F.greatest(F.lit(1).cast("long"), F.expr(f"{split} div greatest(width, 1L)"))
    parts = planned.where("error IS NOT NULL OR rows > 0").withColumn("step", run_rows)
    parts = parts.withColumn("first", F.explode(F.when(F.col("error").isNotNull(), F.array(F.lit(0).cast("long"))).otherwise(F.expr("sequence(0L, rows - 1, step)"))))
    parts = parts.withColumn("last", F.least(F.col("rows"), F.col("first") + F.col("step"))).select("file", "hdu", "start", "width", "columns", "error", "first", "last")
    return parts.repartition(spread, "file", "hdu", "first").mapInArrow(run, out)


@dataclass
class FitsPartition(InputPartition):
    """A run of rows of one table of one file, or what is wrong with the file."""

    file: str
    start: int = 0
    width: int = 0
    first: int = 0
    last: int = 0
    columns: tuple = ()
    error: str | None = None


class FitsSource(DataSource):
    """spark.read.format("fits").option("table", name).load(path): one row per row of that table in all files of a path.

    spark.dataSource.register(FitsSource) first. The schema decides which columns are decoded; without one it is that of
    the first file's table. Fields named _file, _row and _error, if the schema has them, give the file, the row's number
    and what is wrong with a file; without _error a broken file fails the read. Planning reads headers only, some
    files at once; a partition is a run of about splitBytes (64 MB) of rows. For an archive's many files use decoded(),
    whose paths and headers stay in tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> T.StructType:
        for path in paths.found(self.options["path"]):
            with paths.Ranged(path) as file:
                for name, cards, _ in tables(file):
                    if name == self.options["table"]:
                        return T.StructType([T.StructField(c["name"], column_type(c)) for c in layout(cards)])
        raise ValueError(f"no table {self.options['table']} in {self.options['path']}")

    def reader(self, schema: T.StructType) -> FitsReader:
        return FitsReader(schema, dict(self.options))


class FitsReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.wanted = [f.name for f in schema.fields if f.name not in ("_file", "_row", "_error")]

    def _planned(self, path: str) -> list[FitsPartition]:
        try:
            with paths.Ranged(path) as file:
                for name, cards, start in tables(file):
                    if name == self.table:
                        by_name = {c["name"]: c for c in layout(cards, self.wanted)}
                        width, rows = int(cards["NAXIS1"]), int(cards["NAXIS2"])
                        step = max(1, self.split // max(1, width))
                        return [FitsPartition(path, start, width, a, min(rows, a + step), tuple(by_name[n] for n in self.wanted)) for a in range(0, rows, step)]
            raise ValueError(f"no table {self.table}")
        except (ValueError, KeyError, IndexError, TypeError) as e:
            if "_error" not in self.schema.names:
                raise ValueError(f"{path}: {e}") from e
            return [FitsPartition(path, error=str(e))]

    def partitions(self) -> list[FitsPartition]:
        with ThreadPoolExecutor(16) as pool:
            return [p for found in pool.map(self._planned, paths.found(self.path)) for p in found] or [FitsPartition("")]

    def read(self, part: FitsPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def batch(n: int, own: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(n, to_arrow_type(f.dataType)) for f in self.schema.fields], self.schema.names)

        if part.error is not None:
            yield batch(1, {"_file": pa.array([part.file]), "_error": pa.array([part.error])})
        elif part.last > part.first:
            kinds = [f.dataType for f in self.schema.fields if f.name in self.wanted]
            with paths.Ranged(part.file) as file:
                for a, body in rows_of(file, part.start, part.width, part.first, part.last, list(part.columns), kinds):
                    n = min(part.last - a, max(1, min(_BATCH, (8 << 20) // max(1, part.width))))
                    yield batch(n, {"_file": pa.array([part.file] * n, pa.string()), "_row": pa.array(np.arange(a, a + n)), **dict(zip(self.wanted, body, strict=True))})


def read_table(spark: SparkSession, path: str, hdu: str, schema: str) -> DataFrame:
    """(file, row, columns...) of table `hdu` in the files that path (a file, folder or pattern) names; see decoded for broken files."""
    return decoded(load(spark, path), hdu, schema).where("error IS NULL").drop("error", "hdu")


def broken_files(spark: SparkSession, path: str, hdu: str, wanted: list[str]) -> DataFrame:
    """(file, message) of files whose table can't be read: rows for the error channel instead of a failed job."""
    found = headers(load(spark, path), hdu, ", ".join(f"`{c}` binary" for c in wanted))
    return found.where("error IS NOT NULL").select("file", F.col("error").alias("message"))


def written(contents: DataFrame, folder: str) -> DataFrame:
    """(path) of files written under folder, one for each row (path: its name, content); each is written where its row lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                paths.write(f"{folder}/{name}", content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    made = contents.select("path", "content").mapInArrow(run, "path string")
    kept = f"{folder}/.paths-{uuid.uuid4().hex}"
    made.write.parquet(kept)
    return contents.sparkSession.read.schema("path string").parquet(kept)


def _adapted(files: DataFrame, table: tuple, **names: str) -> DataFrame:
    rows = decoded(files, *table)
    return rows.select("file", "row", "error", *[F.col(old).alias(new) for new, old in names.items()])


def hxmt_events(files: DataFrame) -> DataFrame:
    return _adapted(files, HXMT_EVENTS, met="Time", det_id="Det_ID", channel="Channel", pulse_width="Pulse_Width", acd="ACD", event_type="Event_Type")


def hxmt_attitude(files: DataFrame) -> DataFrame:
    return _adapted(files, HXMT_ATTITUDE, met="Time", q1="Q1", q2="Q2", q3="Q3")


def hxmt_orbit(files: DataFrame) -> DataFrame:
    return _adapted(files, HXMT_ORBIT, met="Time", longitude="Lon", latitude="Lat", altitude="Alt")


def hxmt_engineering(files: DataFrame) -> DataFrame:
    return _adapted(files, HXMT_ENGINEERING, stime="Time", bus="BUS_Time_Bdc")


def hxmt_science(files: DataFrame) -> DataFrame:
    return _adapted(files, HXMT_SCIENCE, ccsds="CCSDS")


def svom_events(files: DataFrame) -> DataFrame:
    """The three detectors' tables as one with det_id 1 to 3; each file is opened once."""
    rows = decoded(files, SVOM_DETECTORS, SVOM_EVENTS)
    det = F.array_position(F.array(*map(F.lit, SVOM_DETECTORS)), F.col("hdu")).cast("int")
    return rows.select("file", "row", "error", det.alias("det_id"), F.col("TIME").alias("met"), F.col("PI").alias("pi"), F.col("GAIN_TYPE").alias("gain_type"), F.col("DEAD_TIME").alias("dead_time"), F.col("EVT_TYPE").alias("evt_type"), F.col("ANTI_COIN").alias("anti_coin"), F.col("FLAG").alias("flag"))


def svom_good_times(files: DataFrame) -> DataFrame:
    return _adapted(files, SVOM_GTI, start="START", stop="STOP")


def svom_energies(files: DataFrame) -> DataFrame:
    """The energies that each channel of a file stands for."""
    return _adapted(files, SVOM_EBOUNDS, channel="CHANNEL", e_min="E_MIN", e_max="E_MAX")


def svom_attitude(files: DataFrame) -> DataFrame:
    """The file's Q0 to Q2 are our q1 to q3; its Q3 isn't read."""
    return _adapted(files, SVOM_ATTITUDE, met="TIME", q1="Q0", q2="Q1", q3="Q2")


def svom_orbit(files: DataFrame) -> DataFrame:
    return _adapted(files, SVOM_ORBIT, met="TIME", longitude="LON", latitude="LAT", altitude="ALT")


def encoded(tables_: list[tuple[str, list[tuple[str, str, np.ndarray]]]]) -> bytes:
    """A FITS file of binary tables: (name, columns (name, form, values)); forms are those of _CODES, or nB for rows of n bytes."""

    def block(cards: list[str]) -> bytes:
        text = "".join(f"{c:<80}" for c in [*cards, "END"])
        return text.ljust(-(-len(text) // _BLOCK) * _BLOCK).encode()

    out = [block(["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0"])]
    for name, cols in tables_:
        parts = []
        for _, form, values in cols:
            kind = _CODES[form[-1]][0]
            parts.append(np.ascontiguousarray(np.asarray(values).astype(kind)).view(np.uint8).reshape(len(values), -1) if len(values) else np.zeros((0, np.dtype(kind).itemsize * int(form[:-1] or 1)), np.uint8))
        grid = np.hstack(parts)
        head = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {grid.shape[1]}", f"NAXIS2  = {grid.shape[0]}", "PCOUNT  = 0", "GCOUNT  = 1", f"TFIELDS = {len(cols)}", f"EXTNAME = '{name}'"]
        for k, (column, form, _) in enumerate(cols, 1):
            head += [f"TTYPE{k:<3}= '{column}'", f"TFORM{k:<3}= '{form}'"]
        data = grid.tobytes()
        out += [block(head), data.ljust(-(-len(data) // _BLOCK) * _BLOCK, b"\0")]
    return b"".join(out)
