"""Vector codes by exact integer Lloyd rounds with group bounds (Yinyang)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkburst.llm.common import dropped, join_checked, stored, trimmed

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Groups of a codebook's entries; each vector's part keeps one lower bound a group.
GROUPS = 16
#: Rows that are compared with a group of entries at once.
_STEP = 4096
#: Bounds are lowered by this share before they are stored, and compared with this slack: more than doubles err by.
_SAFE = 1e-6


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of integer vectors: as doubles where every sum is below 2^53, else as integers."""
    most = max(abs(x).max(initial=0), abs(entries).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        p, q = x.astype(np.float64), entries.astype(np.float64)
        return (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)


def entry_groups(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> list[np.ndarray]:
    """A codebook's entries in groups of near ones, as ascending indexes: a few plain k-means rounds over the entries."""
    x = entries.astype(np.float64)
    middles = x[:: max(1, -(-len(x) // groups))]
    for _ in range(rounds):
        near = ((x[:, None, :] - middles[None, :, :]) ** 2).sum(2).argmin(1)
        middles = np.stack([x[near == g].mean(0) if (near == g).any() else m for g, m in enumerate(middles)])
    return [found for g in range(len(middles)) if len(found := np.flatnonzero(near == g))]


def assign(x: np.ndarray, entries: np.ndarray, groups: list[np.ndarray], near: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry, ties to the lower index; squared distance; lower bounds; distances computed) of each row of x.

    near and lower are the last round's: lower[:, g] bounds the distances to all entries of group g but `near` from below,
    before the entries moved by at most drift[g]. A group is scanned only if its bound, less the drift, isn't above the
    distance to `near`; as the comparison is strict, an entry that is skipped is neither nearer nor as near. Scans
    compare exact integers.
    """
    n = len(x)
    own = ((x - entries[near]) ** 2).sum(1)
    best, at, bounds = own.copy(), near.copy(), np.maximum(lower - drift[None, :] * (1 + _SAFE), 0)
    reach = np.sqrt(own.astype(np.float64)) * (1 + _SAFE)
    scan = bounds <= reach[:, None]
    least, second, who = np.zeros((n, len(groups))), np.zeros((n, len(groups))), np.full((n, len(groups)), -1)
    work = n
    for g, members in enumerate(groups):
        found = np.flatnonzero(scan[:, g])
        work += len(found) * len(members)
        for rows in (found[a : a + _STEP] for a in range(0, len(found), _STEP)):
            apart, line = squared(x[rows], entries[members]), np.arange(len(rows))
            k = apart.argmin(1)
            d = apart[line, k].astype(np.int64)
            least[rows, g], who[rows, g] = np.sqrt(d), members[k]
            if len(members) > 1:
                apart[line, k] = apart.max(1) + 1
                second[rows, g] = np.sqrt(apart.min(1))
            else:
                second[rows, g] = np.inf
            nearer = (d < best[rows]) | ((d == best[rows]) & (members[k] < at[rows]))
            best[rows], at[rows] = np.where(nearer, d, best[rows]), np.where(nearer, members[k], at[rows])
    group_of = np.zeros(len(entries), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    bounds = np.where(scan, np.where(who == at[:, None], second, least), bounds)
    left = np.flatnonzero((at != near) & ~scan[np.arange(n), group_of[near]])  # the old entry counts for its group again
    bounds[left, group_of[near[left]]] = np.minimum(bounds[left, group_of[near[left]]], np.sqrt(own[left].astype(np.float64)))
    return at, best, bounds * (1 - _SAFE), work


def _packed(bounds: np.ndarray) -> np.ndarray:
    """Bounds in two bytes each: the upper half of a float, which is never above it."""
    low = np.nextafter(np.minimum(bounds, 1e38).astype(np.float32), np.float32(0))
    return (low.view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def _unpacked(halves: np.ndarray) -> np.ndarray:
    return (halves.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    offsets = (np.arange(len(rows) + 1) * (rows.itemsize * rows.shape[1])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _assigned(model, kind: str, parts: int, width: int):
    """A round's state of each row: (id, label, x, near, lower, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, groups, drifts = model.value
        sizes = [0, *np.cumsum([len(g) for g in groups])]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch["x"], kind, parts * width).astype(np.int64).reshape(n, parts, width)
            near = _matrix(batch["near"], "<u2", parts) if batch["near"].null_count == 0 else np.zeros((n, parts), np.uint16)
            low = _unpacked(_matrix(batch["lower"], "<u2", sizes[-1])) if batch["lower"].null_count == 0 else np.zeros((n, sizes[-1]))
            codes, bounds, error = np.zeros((n, parts), np.uint16), np.zeros((n, sizes[-1]), np.uint16), np.zeros(n, np.int64)
            for p in range(parts):
                held = slice(sizes[p], sizes[p + 1])
                at, best, out, _ = assign(x[:, p], books[p], groups[p], near[:, p].astype(np.int64), low[:, held], drifts[p])
                codes[:, p], bounds[:, held] = at, _packed(out)
                error += best
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["x"], _bytes(codes), _bytes(bounds), pa.array(error)], ["id", "label", "x", "near", "lower", "error"])

    return trimmed(run)


def _summed(kind: str, parts: int, entries: int, width: int):
    """A task's sums of the parts of each entry: (part, entry, n, sums as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch["x"], kind, parts * width).astype(np.int64).reshape(batch.num_rows, parts, width)
            near = _matrix(batch["near"], "<u2", parts)
            for p in range(parts):
                np.add.at(sums[p], near[:, p], x[:, p])
                counts[p] += np.bincount(near[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        at = np.repeat(np.arange(len(p)), width + 1)
        place = np.tile(np.arange(-1, width), len(p))
        values = np.concatenate([counts[p, e][:, None], sums[p, e]], axis=1).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(p[at]), pa.array(e[at]), pa.array(place), pa.array(values)], ["part", "entry", "place", "total"])

    return trimmed(run)


def _moved(state: DataFrame, kind: str, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Every entry that has parts becomes the floor of their mean. At most entries * (length + parts) sums come to the driver."""
    totals = state.select("x", "near").mapInArrow(_summed(kind, len(books), len(books[0]), width), "part long, entry long, place long, total long")
    rows = totals.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros((len(books), len(books[0]), width + 1), np.int64)
    sums[rows["part"].to_numpy(), rows["entry"].to_numpy(), rows["place"].to_numpy() + 1] = rows["total"].to_numpy()
    count = sums[:, :, :1]
    return [np.where(c > 0, s // np.maximum(c, 1), b) for b, s, c in zip(books, sums[:, :, 1:], count, strict=True)]


def compress_vectors(vectors: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, label, near, error) for every usable vector, and the codebooks: a matrix of integers for each part.

    Components become floor(scale * x); vectors are cut into equal parts. Each codebook starts as the parts of the
    `entries` smallest keys. In each round every part goes to its nearest entry and entries become the floor of their
    parts' mean; an entry without parts stays. Rows keep the entry they had and one lower bound for each group of
    entries from round to round (see assign) in a table in the shared folder; the driver sees the codebooks and their
    sums only, whose size doesn't grow with the rows.

    Null vectors and those with null or non-finite components are left out. Shorter vectors than the longest, and a
    length that parts don't divide, count as having zeros behind. A null key comes after all others; equal keys are told
    apart by their components, and each row counts. Fewer rows than entries give as many entries. Components so large that
    squared distances leave 63 bits are an error. Extra columns are ignored. An empty table gives no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(ok).select(F.col(key).alias("id"), "label", F.transform(F.col("embedding").cast("array<double>"), lambda v: v * scale).alias("x"))
    longest, most, n = rows.select(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.count("*")).first()
    longest, most = longest or 0, most or 0.0
    width = -(-longest // parts)
    if 4 * width * parts * (most + 1) ** 2 >= 2.0**63:
        raise ValueError(f"components up to {most} leave no exact squared distances in 63 bits")
    kind, cell = ("<i2", "short") if most < (1 << 15) - 1 else ("<i4", "int") if most < 1 << 30 else ("<i8", "long")
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v)).cast(f"array<{cell}>"))
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast(cell), F.lit(width * parts) - F.size("x"))))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).toArrow()["x"].to_pylist()
    start = np.array(first, np.int64).reshape(len(first), parts, width)
    books = [start[:, p] for p in range(parts)]
    groups = [entry_groups(b) for b in books] if len(first) else [[] for _ in books]

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy().astype(kind).reshape(batch.num_rows, parts * width)
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], _bytes(x), none, none, pa.nulls(batch.num_rows, pa.int64())], ["id", "label", "x", "near", "lower", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = f"id {types['id']}, label {types['label']}, x binary, near binary, lower binary, error bigint"
    state = rows.mapInArrow(raw, ddl)
    if not len(first):
        return state.select(F.col("id").alias(key), "label", "near", "error"), books
    drifts = [np.zeros(len(g)) for g in groups]
    for k in range(rounds + 1):
        model = spark.sparkContext.broadcast((books, groups, drifts))
        before, state = state, stored(state.mapInArrow(_assigned(model, kind, parts, width), ddl))
        dropped(before)
        if k < rounds:
            new = _moved(state, kind, books, width)
            drifts = [np.array([np.sqrt(((a[m] - b[m]) ** 2).sum(1).max().astype(np.float64)) for m in g]) for a, b, g in zip(books, new, groups, strict=True)]
            books = new
    return state.select(F.col("id").alias(key), "label", "near", "error"), books


def restored(near: bytes, books: list[np.ndarray]) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([b[i] for b, i in zip(books, np.frombuffer(near, "<u2"), strict=True)])


def codes_report(vectors: DataFrame, **options) -> DataFrame:
    """One row per usable vector: its code in hex, its error, the error of its label, and the digest of the codebooks."""
    codes, books = compress_vectors(vectors, **options)
    digest = hashlib.sha256(",".join(map(str, np.concatenate([b.reshape(-1) for b in books]).tolist())).encode()).hexdigest()
    labels = stored(codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    out = join_checked(codes, labels, F.col("label").eqNullSafe(F.col("__label")))
    code = F.concat(*[F.substring(F.lower(F.hex("near")), 1 + 4 * p, 2) for p in range(options.get("parts", PARTS))])
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
