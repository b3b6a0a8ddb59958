"""Two-pass external shuffle into shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkburst.llm.common import join_checked, row_hash, stored, without

LAW = "key"
#: Equal rows that go to a bucket together: so many at most, and no more bytes than this share of a bucket.
LOT, LOT_SHARE = 1000, 8


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the key is highest: uniform, and one more shard only draws rows to itself."""
    draws = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), key) for s in range(shards)])
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def _shuffled(seed: int, names: list[str]):
    def one(key: tuple, rows: pa.Table, first: pa.Table) -> pa.Table:
        shard, bucket = (k.as_py() for k in key)
        # Arrival order depends on the shuffle's fetches: a total order first makes reruns agree.
        at = pc.sort_indices(rows, [("__h1", "ascending"), ("__h2", "ascending")]).to_numpy()
        at = np.repeat(at, rows["__m"].to_numpy()[at])
        deal = at[np.random.Generator(np.random.PCG64([seed, shard, bucket])).permutation(len(at))]  # Fisher-Yates
        slot = np.arange(len(at), dtype=np.int64) + (first["__first"][0].as_py() if first.num_rows else 0)
        return rows.take(pa.array(deal)).append_column("slot", pa.array(slot)).select(names)

    return one


def _in_lots(rows: DataFrame, hashes: tuple[Column, Column], size: Column, most_bytes: int) -> DataFrame:
    """rows with __h1, __h2 (of all columns), __lot and __m: of rows that occur more often than a lot holds (LOT rows,
    most_bytes bytes, one row at least) there is a row for every lot of them."""
    hashed = rows.withColumns({"__h1": hashes[0], "__h2": hashes[1], "__size": size})
    held = F.greatest(F.lit(1).cast("long"), F.least(F.lit(LOT).cast("long"), F.floor(F.lit(most_bytes) / F.max("__size"))))
    many = stored(hashed.groupBy("__h1", "__h2").agg(F.count("*").alias("__c"), held.alias("__held")).where(F.col("__c") > F.col("__held")))
    one = {"__lot": F.lit(0).cast("long"), "__m": F.lit(1).cast("long")}
    if not many.limit(1).count():
        return hashed.drop("__size").withColumns(one)
    marked = join_checked(hashed, many, ["__h1", "__h2"]).select(*rows.columns, "__h1", "__h2", "__c", "__held")
    few = marked.where("__c IS NULL").drop("__c", "__held").withColumns(one)
    row = marked.where("__c IS NOT NULL").groupBy("__h1", "__h2", "__c", "__held").agg(F.first(F.struct(*rows.columns)).alias("__row"))
    lots = row.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__c") - 1) / F.col("__held")))))
    return few.unionByName(lots.select("__row.*", "__h1", "__h2", "__lot", F.least("__held", F.col("__c") - F.col("__lot") * F.col("__held")).alias("__m")))


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 7, bucket_bytes: int = 32 << 20) -> DataFrame:
    """All rows of df with their shard, slot and grown_shard: a random order that needs memory for one bucket only.

    Pass 1 scatters rows by seeded hashes: the key picks the shard (law `key`), the whole row's hash picks one of
    the shard's buckets, of which each shard has as many as its own bytes need to keep a bucket near bucket_bytes; a hot
    key makes its shard large but no bucket. Pass 2 shuffles each bucket by
    Fisher-Yates, seeded by shard and bucket, and numbers its rows on from the buckets before it, so slots run from 0
    without gaps. Reruns agree; copies of a text are scattered like other rows, as the law looks at keys only.

    Null keys are a key like any other; null texts have no bytes. An empty table gives no rows. Rows equal in every
    column are dealt in lots (see _in_lots) over their shard's buckets, one after the other, so that they fill them evenly. Columns of df named shard, slot or grown_shard are
    replaced, all others are kept.
    """
    rows = df.select(without(df, "shard", "slot", "grown_shard"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    home = shard_of(F.col(key), shards, seed)
    grown = F.when(F.xxhash64(F.lit(seed), F.lit(shards), F.col(key)) > F.array_max(F.array(*[F.xxhash64(F.lit(seed), F.lit(s), F.col(key)) for s in range(shards)])), F.lit(shards)).otherwise(home)
    held = {r["shard"]: r["bytes"] for r in rows.select(home.alias("shard"), size.alias("size")).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # a row a shard
    buckets = F.array(*[F.lit(max(1, -(-held.get(s, 0) // bucket_bytes))) for s in range(shards)])
    spread = _in_lots(rows, (row_hash(rows), row_hash(rows, seed)), size, bucket_bytes // LOT_SHARE)
    own = F.element_at(buckets, F.col("shard") + 1)
    bucket = F.pmod(F.pmod(F.xxhash64(F.lit(seed + 1), "__h1", "__h2", F.lit(0).cast("long")), own) + F.col("__lot"), own).cast("int")
    placed = spread.withColumns({"shard": home, "grown_shard": grown}).withColumn("__bucket", bucket)
    counts = placed.groupBy("shard", "__bucket").agg(F.sum("__m").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), "__first")
    out = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return placed.groupBy("shard", "__bucket").cogroup(first.groupBy("__s", "__b")).applyInArrow(_shuffled(seed, out.names), out)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order within each file; file ranges follow the slots, so that files read in
    their names' order give the shard's order. path must not exist; no rows write an empty table."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharding_report(docs: DataFrame) -> DataFrame:
    """The digest columns of shard_rows over documents."""
    return shard_rows(docs.select("doc_id", "text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
