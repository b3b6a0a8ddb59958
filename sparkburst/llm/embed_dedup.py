"""Near copies among embeddings: binary codes by iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkburst.llm.common import dropped, join_checked, stored
from sparkburst.llm.components import connected_components

MIN_COSINE = 0.93
#: Vectors the rotations are fitted on at most; every vector is indexed.
FIT_ROWS = 10_000
#: Bits that one rotation gives; a code has as many rotations as its tables need, and two at least.
ROTATION_BITS = 64
#: Of pairs at the threshold, the share that meets in some table; and the members a bucket of unrelated vectors has.
RECALL, BUCKET = 0.975, 32
#: Standard deviations by which a pair's Hamming distance may exceed what the threshold expects.
SLACK = 6.0
#: Members of a bucket that meet in one block; larger buckets are dealt as pairs of blocks.
BLOCK = 1500
_STEP = 256
_KEYS = ["label", "dim", "table", "key", "i", "j"]


def shape(n: int, min_cosine: float) -> tuple[int, int]:
    """(bits of a key, tables) for n vectors of a label: keys as long as keep buckets near BUCKET, and as many tables as
    meet RECALL of the pairs at the threshold, of whose bits angle / pi differ. So candidates a vector stay about
    constant, and tables grow as a small power of n."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / BUCKET)))
    same = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def fit_rotation(sample: np.ndarray, bits: int = ROTATION_BITS, rounds: int = 40, seed: int = 5) -> np.ndarray:
    """Projection: principal axes of unit vectors, then the rotation that brings projections nearest to their signs.

    Vectors aren't centred, so that bits are tests of directions and two vectors differ in about angle / pi of them even
    where one tight group is most of the data.
    """
    x = sample
    dims = min(bits, x.shape[1])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dims]
    rng = np.random.Generator(np.random.PCG64(seed))
    if dims < bits:  # more bits than dimensions: further random directions
        axes = np.hstack([axes, rng.standard_normal((x.shape[1], bits - dims)) / np.sqrt(x.shape[1])])
    v = x @ axes
    r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def _unit(vectors: list[list[float]]) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _random_model(dim: int, rotations: int) -> np.ndarray:
    """Directions for vectors of a length that the sample lacks: random ones, the same in every task."""
    return np.random.Generator(np.random.PCG64([11, dim])).standard_normal((dim, rotations * ROTATION_BITS))


def _coder(models, rotations: int):
    """Adds each row's code: signs of its projections, packed to bytes; vectors of a label share its key's bits and tables."""
    drawn: dict[int, np.ndarray] = {}

    def model(dim: int) -> np.ndarray:
        if dim in models.value:
            return models.value[dim]
        if dim not in drawn:
            drawn.clear()  # one at a time: lengths may be many
            drawn[dim] = _random_model(dim, rotations)
        return drawn[dim]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, out = batch["embedding"].to_pylist(), [b""] * batch.num_rows
            for dim in sorted({len(v) for v in vectors}):
                rows = [i for i, v in enumerate(vectors) if len(v) == dim]
                packed = np.packbits(_unit([vectors[i] for i in rows]) @ model(dim) >= 0, axis=1)
                for i, p in zip(rows, packed, strict=True):
                    out[i] = p.tobytes()
            names = [n for n in batch.schema.names if n != "embedding"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out, pa.binary())], [*names, "code"])

    return code


def _table_keys(codes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) keys of packed codes: substrings of `bits` bits, one behind the other."""
    flat = np.unpackbits(codes, axis=1)[:, : bits * tables].reshape(len(codes), tables, bits)
    return flat @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _filed(min_cosine: float):
    """A row (label, dim, table, key, cid, code, size) for every table of each coded row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, codes = batch["size"].to_numpy(), batch["code"].to_pylist()
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                bits, tables = shape(n, min_cosine)
                keys = _table_keys(np.frombuffer(b"".join(codes[i] for i in rows), np.uint8).reshape(len(rows), -1), bits, tables)
                at = pa.array(np.repeat(rows, tables))
                same = [batch[c].take(at) for c in ("label", "dim", "cid", "code", "size")]
                yield pa.RecordBatch.from_arrays([*same[:2], pa.array(np.tile(np.arange(tables), len(rows))), pa.array(keys.reshape(-1)), *same[2:]], ["label", "dim", "table", "key", "cid", "code", "size"])

    return run


def _groups(one):
    """Runs one(table of rows) for every run of equal _KEYS in sorted batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            marks = np.stack([rows[c].to_numpy() for c in _KEYS], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if now is not None and tuple(marks[a]) != now:
                    yield one(pa.concat_tables(held))
                    held = []
                now = tuple(marks[a])
                held.append(rows.slice(a, b - a))
        if held:
            yield one(pa.concat_tables(held))

    return run


def _blocks(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps of left members and the right members that they meet, of a bucket's pair of blocks."""
    i, j, block = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for a in range(0, len(left), _STEP):
        yield left[a : a + _STEP], right


def _near(min_cosine: float):
    """Members of a pair of blocks that have another one within the Hamming budget: only their vectors are sent for."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        share, bits = math.acos(min_cosine) / math.pi, 8 * codes.shape[1]
        budget = share * bits + SLACK * math.sqrt(share * (1 - share) * bits)
        words = codes.view(np.uint64) if codes.shape[1] % 8 == 0 else codes
        use = np.zeros(rows.num_rows, bool)
        for left, right in _blocks(rows):
            apart = np.zeros((len(left), len(right)), np.uint16)
            for k in range(words.shape[1]):
                apart += np.bitwise_count(words[left, k][:, None] ^ words[right, k][None, :])
            p, q = np.nonzero(apart <= budget)
            apart_ = left[p] != right[q]
            use[left[p[apart_]]] = True
            use[right[q[apart_]]] = True
        kept = pa.array(np.flatnonzero(use))
        return pa.RecordBatch.from_arrays([rows[c].take(kept).combine_chunks() for c in [*_KEYS, "block", "cid"]], [*_KEYS, "block", "cid"])

    return _groups(one)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(min_cosine: float):
    """Link counts and spanning edges of each (bucket, pair of blocks); a pair of vectors counts in its first table only."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("cid", "ascending")])
        table, same = rows["table"][0].as_py(), rows["i"][0].as_py() == rows["j"][0].as_py()
        cid, copies = rows["cid"].to_numpy(), rows["copies"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        earlier = _table_keys(codes, *shape(rows["size"][0].as_py(), min_cosine))[:, :table]
        x = _unit(rows["embedding"].to_pylist())
        links, ends = np.zeros(len(cid), np.int64), []
        for left, right in _blocks(rows):
            p, q = np.nonzero(x[left] @ x[right].T >= min_cosine)
            p, q = left[p], right[q]
            if same:
                p, q = p[p < q], q[p < q]
            for a in range(0, len(p), 1 << 16):
                u, v = p[a : a + (1 << 16)], q[a : a + (1 << 16)]
                first = ~(earlier[u] == earlier[v]).any(axis=1)
                u, v = u[first], v[first]
                links += np.bincount(u, copies[v], len(cid)).astype(np.int64) + np.bincount(v, copies[u], len(cid)).astype(np.int64)
                ends.append((u, v))
        root = _roots(len(cid), *(np.concatenate([np.zeros(0, np.int64), *(e[k] for e in ends)]) for k in (0, 1)))
        found = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cid[found]), pa.array(links[found]), pa.array(cid[root[found]])], ["cid", "links", "root"])

    return _groups(one)


def embedding_links(vectors: DataFrame, min_cosine: float = MIN_COSINE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per vector (vec_id, n_links, component_id, kept): same-label vectors at cosine >= min_cosine are linked.

    Equal vectors of a label are one class with a count, so copies are never paired. Rotations fitted on a bounded
    sample give each class a code; the more vectors a label has, the longer are its keys and the more its tables (see
    shape), so that a bucket of unrelated vectors stays small. First only codes and ids are shuffled to the buckets, where
    members without another one within the Hamming budget drop out; vectors follow for the others and
    are reranked by double-precision cosines of the original elements. Buckets over BLOCK members are dealt as
    pairs of blocks over many tasks. Each pair counts once, in the first table in which it meets, and each block sends
    on counts and a spanning forest instead of pairs, so that output is linear in the input. A pair at the threshold meets
    with probability RECALL; nearer ones nearly always.

    Vectors of a length that the sample lacks are coded by random directions, which differ in the same share of bits.
    Null labels; null, empty or zero vectors; and null or non-finite components link with nothing. Vectors of different
    lengths are never linked. A repeated vec_id counts as a row of its own; a null vec_id links like others, gives a null
    component and is kept. Extra columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    kind = rows.schema["embedding"].dataType.simpleString()
    fit = F.size("embedding") > 0
    for bad in (lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")),):
        fit &= ~F.exists("embedding", bad)
    fit &= F.exists("embedding", lambda v: v != 0) & F.col("label").isNotNull()
    marked = rows.withColumns({"fit": F.coalesce(fit, F.lit(False)), "dim": F.size("embedding").cast("long"), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    usable = marked.where("fit")
    classes = stored(usable.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")).withColumn("cid", F.xxhash64("label", "dim", "h1", "h2")))
    sizes = stored(classes.groupBy("label", "dim").agg(F.count("*").alias("size")))
    bits, tables = shape(sizes.agg(F.max("size")).first()[0] or 1, min_cosine)
    sample = classes.orderBy(F.xxhash64("h1"), "h2").limit(fit_rows).select(F.col("embedding").cast("array<double>").alias("embedding")).toArrow()["embedding"].to_pylist()
    rotations = max(2, -(-bits * tables // ROTATION_BITS))
    units = {d: _unit([v for v in sample if len(v) == d]) for d in {len(v) for v in sample}}
    models = {d: np.hstack([fit_rotation(x, seed=5 + k) for k in range(rotations)]) for d, x in units.items()}
    sized = join_checked(classes.select("label", "dim", "cid", "copies", "embedding"), sizes, ["label", "dim"])
    sized = sized.select("label", "dim", "cid", "copies", "size", "embedding")
    coded = stored(sized.mapInArrow(_coder(spark.sparkContext.broadcast(models), rotations), "label long, dim long, cid long, copies long, size long, code binary"))
    filed = stored(coded.select("label", "dim", "cid", "code", "size").mapInArrow(_filed(min_cosine), "label long, dim long, table long, key long, cid long, code binary, size long"))
    counts = filed.groupBy("label", "dim", "table", "key").count()
    crowd = stored(counts.where(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("long")).drop("count"))
    dealt = join_checked(filed, crowd, ["label", "dim", "table", "key"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "cid"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*_KEYS, "block", "cid", "code")
    keys = ", ".join(f"{k} long" for k in [*_KEYS, "block", "cid"])
    near = stored(dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_near(min_cosine), keys))
    whole = classes.select("cid", F.col("embedding").cast(kind).alias("embedding")).join(coded.select("cid", "copies", "size", "code"), "cid")
    met = near.join(whole, "cid").select(*_KEYS, "block", "cid", "copies", "size", "code", "embedding")
    met = stored(met.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_linked(min_cosine), "cid long, links long, root long"))
    dropped(sizes, filed, crowd, near, coded)
    groups = connected_components(met.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("label", "dim", "h1", "h2", "cid", "rep", "copies").join(counts, "cid", "left").join(groups, F.col("cid") == F.col("node"), "left")
    known = known.withColumn("component", F.coalesce("component", "cid")).drop("node")
    least = known.groupBy("component").agg(F.min("rep").alias("least"))
    known = known.drop("cid", "rep").join(least, "component")
    out = marked.drop("embedding").join(known.withColumn("fit", F.lit(True)), ["fit", "label", "dim", "h1", "h2"], "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
