"""FITS tables from bytes made by hand, pruned listings, the sink of daily files, and stored catalogues."""

import os
import struct
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sparkburst.operators import catalog
from sparkburst.sources import archive, files, fits, signals, store


def header(*cards):
    text = "".join(f"{c:<80}" for c in (*cards, "END"))
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def padded(data):
    return data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def by_hand(rows=5, claimed=None):
    """A primary image, an image extension, a table with a heap and odd cards, and a second table of the same name."""
    image = header("SIMPLE  =                    T / it's FITS", "BITPIX  =                   16", "NAXIS   =                    1", "NAXIS1  =                  100", "COMMENT = 'not a value") + padded(b"\1" * 200)
    extension = header("XTENSION= 'IMAGE   '", "BITPIX  =                  -32", "NAXIS   =                    2", "NAXIS1  =                    3", "NAXIS2  =                    2", "PCOUNT  =                    0", "GCOUNT  =                    1") + padded(b"\2" * 24)
    # t 1D, n 1J with a zero point, ok L, bits 11X, name 6A, pair 2E, s 1I scaled, heap 1PE(9), raw 3B
    row = lambda k: struct.pack(">diBB", 1.5 * k, k - 2**31, ord("T") if k % 2 else ord("F"), 0x80 + k % 64) + bytes([0x20]) + b"ab" + bytes([48 + k % 64]) + b"\0zz" + struct.pack(">ffhii", k, k / 2, 10 * k, 1, 0) + bytes([k % 64, 255, 0])
    data = b"".join(map(row, range(rows)))
    heap = struct.pack(">f", 7.0)
    cards = [
        "XTENSION= 'BINTABLE'           / binary table", "BITPIX  =                    8", "NAXIS   =                    2", f"NAXIS1  = {len(row(0)):>20}", f"NAXIS2  = {claimed or rows:>20} / rows", f"PCOUNT  = {len(heap):>20}", "GCOUNT  =                    1", "TFIELDS =                    9",
        "EXTNAME = 'Events  '           / with 'quotes' / slashes", "OBSERVER= 'O''Brien / x'", "TTYPE1  = 'Time    '", "TFORM1  = 'D       '           / no count", "TTYPE2  = 'n'", "TFORM2  = '1J'", "TZERO2  = 2147483648.0", "TTYPE3  = 'ok'", "TFORM3  = '1L'", "TTYPE4  = 'bits'", "TFORM4  = '11X'",
        "TTYPE5  = 'name/x'", "TFORM5  = '6A'", "TTYPE6  = 'pair'", "TFORM6  = '2E'", "TTYPE7  = 's'", "TFORM7  = '1I'", "TSCAL7  = 0.5", "TZERO7  = 3.0", "TTYPE8  = 'heap'", "TFORM8  = '1PE(9)'", "TTYPE9  = 'raw'", "TFORM9  = '3B'",
    ]
    second = header("XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 8", "NAXIS2  = 1", "PCOUNT  = 0", "GCOUNT  = 1", "TFIELDS = 1", "EXTNAME = 'Other'", "TTYPE1  = 'x'", "TFORM1  = 'K'") + padded(struct.pack(">q", -5))
    return image + extension + header(*cards) + padded(data + heap) + second


SCHEMA = "Time double, n long, ok boolean, bits array<boolean>, `name/x` string, pair array<double>, s double, raw binary"


def expected(k):
    bits = [True, *(bool((k >> b) & 1) for b in range(6, -1, -1)), False, False, True]
    return (1.5 * k, k, bool(k % 2), bits, f"ab{k}", [float(k), k / 2], 5.0 * k + 3, bytearray([k, 255, 0]))


def test_bytes_made_by_hand(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(by_hand())
    found = fits.decoded(fits.load(spark, str(tmp_path / "a.fits")), "Events", SCHEMA)
    rows = found.orderBy("row").collect()
    assert [tuple(r)[4:] for r in rows] == [expected(k) for k in range(5)] and [r.row for r in rows] == [0, 1, 2, 3, 4]
    assert fits.decoded(fits.load(spark, str(tmp_path)), "Other", "x long").first().x == -5
    with files.Ranged(str(tmp_path / "a.fits")) as f:
        assert next(fits.tables(f))[1]["OBSERVER"] == "O'Brien / x"


def test_a_table_is_cut_into_runs_of_rows(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(by_hand(200))
    (tmp_path / "none.fits").write_bytes(by_hand(0))
    one = fits.load(spark, str(tmp_path / "*.fits"))
    found = fits.decoded(one.union(one), "Events", "Time double", split=500)  # 43 bytes a row: 11 rows a run
    assert found.where("error IS NULL").groupBy("row").count().where("count = 2").count() == 200 and found.count() == 400
    runs = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert runs > 1
    whole = spark.createDataFrame([(str(tmp_path / "a.fits"),), (None,)], "path string")
    assert fits.decoded(whole, "Events", "Time double", split=1).agg(F.sum("Time")).first()[0] == 1.5 * 199 * 100


def test_what_is_wrong_with_a_file_is_one_row(spark, tmp_path):
    whole = by_hand()
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    put("good.fits", whole), put("short.fits", whole[: len(whole) - 2880 * 4]), put("junk.fits", b"junk" * 2000), put("empty.fits", b""), put("claims.fits", by_hand(claimed=9_000_000))
    names = [p.name for p in tmp_path.iterdir()] + ["absent.fits"]
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names], "path string")
    found = fits.decoded(paths, ("Events", "Other"), "Time double")
    assert found.where("error IS NOT NULL").count() == 6 and found.where("error IS NULL").count() == 0  # Other has no column Time
    rows = {r.file.rsplit("/", 1)[1]: r for r in fits.decoded(paths, "Events", "Time double").where("error IS NOT NULL").collect()}
    assert set(rows) == {"short.fits", "junk.fits", "empty.fits", "claims.fits", "absent.fits"} and "9000000 rows" in rows["claims.fits"].error
    wrong = lambda schema: fits.decoded(paths.where("path LIKE '%good%'"), "Events", schema).first().error
    assert "pair" in wrong("pair double") and "varying" in wrong("heap binary") and "missing" in wrong("missing int")
    assert fits.broken_files(spark, str(tmp_path), "Events", ["Time"]).count() == 4


def test_data_source(spark, tmp_path):
    spark.dataSource.register(fits.FitsSource)
    (tmp_path / "a.fits").write_bytes(by_hand(50))
    (tmp_path / "b.fits").write_bytes(by_hand(7))
    read = lambda **o: spark.read.format("fits").options(table="Events", **o)
    found = read(splitBytes=430).schema("_file string, _row long, Time double, n long").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 6 and found.agg(F.sum("n")).first()[0] == 49 * 25 + 21
    assert {(r._file.rsplit("/", 1)[1], r._row) for r in found.collect()} == {("a.fits", k) for k in range(50)} | {("b.fits", k) for k in range(7)}
    own = read().load(str(tmp_path / "b.fits"))
    assert dict(own.dtypes) == {"Time": "double", "n": "bigint", "ok": "boolean", "bits": "binary", "name/x": "string", "pair": "array<float>", "s": "double", "heap": "binary", "raw": "binary"}
    (tmp_path / "c.fits").write_bytes(b"junk" * 2000)
    assert read().schema("Time double, _file string, _error string").load(str(tmp_path)).where("_error IS NOT NULL").select("_file").first()[0].endswith("c.fits")
    with pytest.raises(Exception, match="c.fits"):
        read().schema("Time double").load(str(tmp_path)).count()


def test_a_file_over_two_gigabytes_is_planned_from_its_header(tmp_path):
    """A sparse file: rows of 1 MB; planning reads a header, and a run of rows only its bytes."""
    cards = header("XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 1000000", "NAXIS2  = 3000", "PCOUNT  = 0", "GCOUNT  = 1", "TFIELDS = 2", "EXTNAME = 'big'", "TTYPE1  = 'x'", "TFORM1  = 'J'", "TTYPE2  = 'pad'", "TFORM2  = '999996B'")
    path, start = tmp_path / "big.fits", 2880 + len(cards)
    with open(path, "wb") as f:
        f.write(header("SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0") + cards)
        f.seek(start + 2_999_000_000)
        f.write(struct.pack(">i", 77))
        f.truncate(start + 3_000_000_000)
    assert os.stat(path).st_blocks * 512 < 10_000_000
    from pyspark.sql import types as T

    reader = fits.FitsReader(T.StructType.fromDDL("x int, _row long"), {"path": str(path), "table": "big"})
    parts = reader.partitions()
    assert len(parts) == 45 and parts[0].last == 67 and parts[-1].last == 3000
    last = [r for batch in reader.read(parts[-1]) for r in batch.to_pylist()]
    assert len(last) == 52 and last[-1] == {"x": 77, "_row": 2999} and {r["x"] for r in last[:-1]} == {0}
    with files.Ranged(str(path)) as f:
        name, found, at = next(fits.tables(f))
        assert (name, at) == ("big", start) and f.taken < 10_000
        assert sum(len(body[0]) for _, body in fits.rows_of(f, at, 1_000_000, 2990, 3000, fits.layout(found, ["x"]), [T.IntegerType()])) == 10 and f.taken < 10_100_000


def test_only_the_folders_of_the_days_asked_are_listed(spark, tmp_path):
    for day in ("20240701", "20240702", "20240703"):
        for kind in ("grm_evt", "att"):
            folder = tmp_path / day[:4] / day[4:6] / day[6:] / kind
            folder.mkdir(parents=True)
            (folder / f"svom_{kind}_{day[2:]}_03_v01.fits").write_bytes(b"")
    (tmp_path / "2024/07/04").symlink_to(tmp_path / "2024/07/04")  # to list this one would fail
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-07-01 00:00:00', TIMESTAMP '2024-07-02 23:00:00', INTERVAL 1 HOUR)) AS hour")
    wanted = archive.wanted_svom(hours)
    assert wanted.count() == 3 * 48 and wanted.select("folder").distinct().count() == 6
    found = archive.listing(wanted.select("folder"), str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"2024/07/{d}/{k}", f"svom_{k}_2407{d}_03_v01.fits", f"svom_{k}_2407{d}_03_v01.fits") for d in ("01", "02") for k in ("grm_evt", "att"))
    resolved = archive.resolve_svom(hours, found)
    assert {(r.hour.day, r.hour.hour, r.kind) for r in resolved.collect()} == {(1, 3, "events"), (1, 3, "attitude"), (2, 3, "events"), (2, 3, "attitude")}
    listed = archive.listing(spark.createDataFrame([("2024/07/03/att",), ("no/such/folder",), (None,)], "folder string"), f"file:{tmp_path}")
    assert listed.count() == 1


SIGNAL = """named_struct('time', 1.0D) start, named_struct('time', 2.0D) stop, 1.0D bin_size_min, 1.0D bin_size_max, 1.0D bin_size_best, 0.0D delay, {n}L count, 1.0D mean, 1e-9D sf, 1e-3D false_positive_per_year,
 named_struct('q1', 0.0D, 'q2', 0.0D, 'q3', CAST(NULL AS DOUBLE)) attitude, named_struct('longitude', 1.0D, 'latitude', 2.0D, 'altitude', 3.0D) position"""


def test_days_are_published_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "data")
    days = spark.sql("SELECT 'HXMT' mission, explode(sequence(DATE '2024-01-31', DATE '2024-02-02')) day")
    some = spark.sql(f"SELECT 'HXMT' mission, DATE '2024-02-01' day, {SIGNAL.format(n=7)}")
    signals.write_signals(days, some.union(some), out)
    names = sorted(str(p.relative_to(out)) for p in tmp_path.glob("data/**/*") if p.is_file())
    assert names == ["HXMT/2024/01/20240131_signals.json", "HXMT/2024/02/20240201_signals.json", "HXMT/2024/02/20240202_signals.json"]
    assert (tmp_path / "data" / names[0]).read_text().replace(" ", "") == "[]"
    found = signals.read_signals(spark, out).collect()
    assert [(r["count"], r.mission, r.date, r.attitude.q3) for r in found] == [(7, "HXMT", "20240201", None)] * 2
    before = {n: (tmp_path / "data" / n).read_bytes() for n in names}

    def fails(batches):
        for batch in batches:
            yield batch
            raise RuntimeError("lost")

    text = signals.day_files(days, spark.sql(f"SELECT 'HXMT' mission, DATE '2024-02-02' day, {SIGNAL.format(n=9)}"))
    with pytest.raises(Exception, match="lost"):
        text.repartition(3).mapInArrow(fails, "name string, text string").write.format("signals").mode("append").save(out)
    assert {n: (tmp_path / "data" / n).read_bytes() for n in names} == before
    assert sorted(str(p.relative_to(out)) for p in tmp_path.glob("data/**/*") if p.is_file()) == names
    signals.write_signals(days.where("day = '2024-02-01'"), some.limit(0), out)
    assert signals.read_signals(spark, out).count() == 0 and len(list(tmp_path.glob("data/**/*.json"))) == 3


# ---- stored catalogues ----

TASKS = "satellite string, detector string, time timestamp_ntz, status string, retry_times int"


def tasks(spark, first, n, status="'Pending'"):
    return spark.sql(f"SELECT 'HXMT' satellite, 'HE' detector, explode(sequence(TIMESTAMP_NTZ '{first}', TIMESTAMP_NTZ '{first}' + INTERVAL {n - 1} HOUR, INTERVAL 1 HOUR)) time, {status} status, 0 retry_times")


def test_store_of_tasks(spark, tmp_path):
    held = store.task_store(spark, str(tmp_path / "task"))
    assert held.read().count() == 0 and held.versions() == []
    assert store.insert_tasks(held, tasks(spark, "2024-01-30 00:00:00", 100)) == 1
    assert store.insert_tasks(held, tasks(spark, "2024-02-01 10:00:00", 60, "'Failed'")) == 2  # some are there already
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    assert held.read().count() == 118 and held.read().where("status = 'Failed'").count() == 18 and held.read(1).count() == 100
    before = held.snapshot().months
    assert store.reset_tasks(held, "Failed", now) == 3 and store.reset_tasks(held, "Failed", now) == 3  # nothing left: no version
    assert held.read().where("status = 'Pending' AND retry_times = 1 AND updated_at = '2024-06-01'").count() == 18
    after = held.snapshot().months
    assert after["2024-01"] == before["2024-01"] and after["2024-02"] != before["2024-02"]  # January has no failed task: not written
    a, b = store.claim_tasks(held, "a", 30, now), store.claim_tasks(held, "b", 30, now)
    times = [sorted(r.time for r in x.collect()) for x in (a, b)]
    assert [len(t) for t in times] == [30, 30] and times[0][-1] < times[1][0]
    assert held.read().where("status = 'Running'").count() == 60 and held.read().count() == 118
    held.vacuum(1)
    assert held.versions() == [5] and held.read().count() == 118 and len(list((tmp_path / "task/data").glob("in_write=*"))) == len(set(held.snapshot().months.values()))


def test_two_writers_lose_nothing(spark, tmp_path):
    """A writer that finds its version taken starts again from the other's rows."""
    held, calls = store.task_store(spark, str(tmp_path / "task")), []
    store.insert_tasks(held, tasks(spark, "2024-01-01 00:00:00", 5))
    first_read, other_done = threading.Event(), threading.Event()

    def slow(table, fresh):
        calls.append(table.count())
        first_read.set()
        assert other_done.wait(120)
        return catalog.added(table, fresh, list(catalog.TASK_KEYS))

    def run():
        held.insert(catalog.conformed(tasks(spark, "2024-01-02 00:00:00", 5), catalog.TASK), slow)

    worker = threading.Thread(target=run)
    worker.start()
    assert first_read.wait(120)
    store.insert_tasks(store.task_store(spark, str(tmp_path / "task")), tasks(spark, "2024-01-03 00:00:00", 5))
    other_done.set()
    worker.join(120)
    assert calls == [5, 10] and held.versions() == [1, 2, 3]
    assert {r.time.day for r in held.read().collect()} == {1, 2, 3} and held.read().count() == 15
    assert len(list((tmp_path / "task/data").glob("in_write=*"))) == 3  # the loser's files are gone
    with pytest.raises(store.ConflictError):
        busy = store.task_store(spark, str(tmp_path / "task"))
        busy._add = lambda *_: False
        busy.attempts = 2
        store.insert_tasks(busy, tasks(spark, "2024-01-09 00:00:00", 1))


def test_failed_writer_leaves_the_table(spark, tmp_path):
    held = store.task_store(spark, str(tmp_path / "task"))
    store.insert_tasks(held, tasks(spark, "2024-01-01 00:00:00", 5))
    with pytest.raises(Exception, match="boom"):
        held.update(F.col("status") == "Pending", lambda rows: rows.withColumn("status", F.raise_error(F.lit("boom")).cast("string")))
    assert held.versions() == [1] and held.read().count() == 5


def test_store_of_signals_prunes(spark, tmp_path):
    held = store.signal_store(spark, str(tmp_path / "signal"))
    rows = spark.range(4000).selectExpr("concat('i', id) id", "'HXMT' satellite", "'HE' detector", "date_format(timestamp_ntz'2023-01-01' + make_interval(0, 0, 0, 0, CAST(id * 3 AS INT), 0, 0), 'yyyy-MM-dd HH:mm:ss') start_full", "rpad('x', 300, 'y') events")
    store.insert_signals(held, rows.where("id < 'i2'"))
    store.insert_signals(held, rows)
    again = rows.limit(1).selectExpr("'i77' id", "satellite", "detector", "'2029-01-01 00:00:00' start_full", "events")
    version = store.insert_signals(held, again.union(again.selectExpr("CAST(NULL AS STRING)", "satellite", "detector", "CAST(NULL AS STRING)", "events")))
    assert version == 3 and held.read().count() == 4001  # i77 is an id of another month; a row without keys stays
    part = held.between("2023-03-05 00:00:00", "2023-03-20 23:00:00")
    assert part.count() == 16 * 8 and part.columns == [f.name for f in T.StructType.fromDDL(catalog.SIGNAL)]
    plan = part.select("id")._jdf.queryExecution().explainString(part.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = {line.split(": ", 1)[0]: line for line in plan.split("\n") if "Filters: " in line}
    assert "in_month" in filters["PartitionFilters"] and "GreaterThanOrEqual(start_full,2023-03-05 00:00:00)" in filters["PushedFilters"] and "LessThanOrEqual(start_full,2023-03-20 23:00:00)" in filters["PushedFilters"]
    used = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
    assert used and all("in_month=2023-03" in f for f in used) and len(used) < len(list((tmp_path / "signal/data").glob("**/*.parquet"))) / 5


def test_database_is_read_by_slices_of_time(spark):
    """Derby stands for the database; each task asks for its own range."""
    url = "jdbc:derby:memory:strokes;create=true"
    rows = [(f"2024-01-{1 + k // 50:02d} {k % 24:02d}:00:00.{k:06d}", 1.0 * k, 2.0, 0.5, 7, None, None, None) for k in range(500)]
    made = spark.createDataFrame(rows, archive.STROKES).withColumnRenamed("time", "TIME")
    made.write.jdbc(url, "lightning", mode="overwrite", properties={"createTableColumnTypes": "TIME VARCHAR(32)"})
    first, last = "2024-01-03 00:00:00.000000", "2024-01-05 05:00:00.000204"
    want = sorted(r[1] for r in rows if first <= r[0] <= last)
    slices = archive.time_slices("TIME", first, last, 5)
    assert len(slices) == 5 and slices[0].startswith(f"TIME >= '{first}'") and slices[-1].endswith(f"<= '{last}'")
    found = archive.read_by_time(spark, url, "lightning", "TIME", first, last, 5)
    assert found.rdd.getNumPartitions() == 5 and sorted(r.lat for r in found.collect()) == want and want
    assert "numPartitions=5" in found._jdf.queryExecution().executedPlan().toString()
    near = found.where("TIME >= '2024-01-04'").select("lat")
    assert "GreaterThanOrEqual(TIME,2024-01-04)" in near._jdf.queryExecution().executedPlan().toString()
    assert archive.read_strokes(spark, url).count() == 500
