"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkburst.llm.common import count_words, join_checked, row_hash, settled, stored

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL, CAP = 1.5, 2.0
#: Documents whose probabilities move together in one task.
BLOCK = 500
#: Equal rows that one block gets at most in the first round.
LOT = 100
#: The landing decides the smallest documents of a source that outweigh its largest so many times, half of its last block at most.
LANDING = 4
_SURE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above cap times its source.

    Sharing an excess anew until no target is above its cap ends at the level L with sum(min(cap * size, L * weight)) =
    total * all; sources in the order in which they reach their caps give L by running sums. Weights repeat over the
    sources by code point, null last. The table has one row per source.
    """
    row = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    listed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(row, F.lit(len(weights))) + 1).cast("int"))).withColumn("most", cap * F.col("source_size"))
    reach = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = reach.rowsBetween(Window.unboundedPreceding, -1)
    onward = reach.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (total * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    listed = listed.withColumn("level", F.when(level * F.col("w") <= F.col("most"), level))
    return listed.withColumn("level", F.max("level").over(Window.partitionBy())).select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def flight(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Chances after the flight: their sum and the sum of chances times sizes stay; at most two are still fractional.

    Three open documents at a time move along the null space of the two constraints (a cross product) until one of
    them reaches 0 or 1; the two ways are drawn so that each chance keeps its mean.
    """
    out, open_ = list(chances), []
    for k, p in enumerate(chances):
        if not _SURE < p < 1 - _SURE:
            out[k] = float(round(p))
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if not any(u):
            u = (1, -1, 0)
        open_ = _move(open_, u, out, rng)
    return out


def _move(open_: list[int], u: tuple, out: list[float], rng: random.Random) -> list[int]:
    up = min((1 - out[k]) / x if x > 0 else out[k] / -x for k, x in zip(open_, u, strict=True) if x)
    down = min(out[k] / x if x > 0 else (1 - out[k]) / -x for k, x in zip(open_, u, strict=True) if x)
    step = up if rng.random() * (up + down) < down else -down
    for k, x in zip(open_, u, strict=True):
        out[k] = min(1.0, max(0.0, out[k] + step * x))
        if not _SURE < out[k] < 1 - _SURE:
            out[k] = float(round(out[k]))
    return [k for k in open_ if 0 < out[k] < 1]


def landing(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Decides all chances left: the document count is given up, words stay (pairs move), and the last one is drawn."""
    out, open_ = list(chances), []
    for k in (k for k, p in enumerate(chances) if 0 < p < 1):
        open_.append(k)
        if len(open_) == 2:
            a, b = open_
            u = (sizes[b], -sizes[a])
            open_ = _move(open_, u if any(u) else (1, -1), out, rng)
    for k in open_:
        out[k] = float(rng.random() < out[k])
    return out


def _flown(seed: int, names: list[str], land: bool):
    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), rows["__m"].to_numpy())))
        rows = rows.take(pc.sort_indices(rows, [(c, "descending") for c in ("__size", "__key", "__tie", "__lot")]))
        rng = random.Random(f"{seed} {key[0].as_py()!r} {key[1].as_py()}")
        size, chance = rows["__size"].to_pylist(), rows["__chance"].to_pylist()
        if land:  # the smallest documents are left to the landing, so that it ends near the target
            held, weight = len(size), 0
            while held > len(size) / 2 and weight < LANDING * size[0]:
                held -= 1
                weight += size[held]
            chance = landing(size, flight(size[:held], chance[:held], rng) + chance[held:], rng)
        else:
            chance = flight(size, chance, rng)
        made = {"__chance": pa.array(chance, pa.float64()), "__m": pa.array(np.ones(len(chance), np.int64))}
        return pa.Table.from_arrays([made[c] if c in made else rows[c] for c in names], names)

    return one


def _mixed(docs: DataFrame, seed: int, weights: tuple[float, ...], total: float, cap: float) -> DataFrame:
    """docs (__key, source, __size, __tie) with source_size, target and copies, a row each; equal rows are interchangeable."""
    classes = stored(docs.groupBy("__key", "source", "__size", "__tie").agg(F.count("*").alias("__c")))
    counts = classes.groupBy("source").agg(F.sum(F.col("__size") * F.col("__c")).cast("long").alias("source_size"), F.sum("__c").alias("__n"))
    targets = stored(source_targets(counts, weights, total, cap).join(counts.select(F.col("source").alias("s"), "__n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    spread = join_checked(classes.withColumnRenamed("source", "s"), targets, F.col("s").eqNullSafe(F.col("source")), "inner").drop("s")
    # A class of equal rows is dealt in lots, so that no block holds more of it than that.
    spread = spread.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__c") - 1) / LOT))))
    spread = spread.withColumn("__m", F.least(F.lit(LOT).cast("long"), F.col("__c") - F.col("__lot") * LOT))
    ready = spread.withColumns({"__whole": F.floor(rate + _SURE).cast("long"), "__chance": F.greatest(F.lit(0.0), rate - F.floor(rate + _SURE))})
    names = ["__key", "source", "__size", "__tie", "__lot", "__m", "source_size", "target", "__whole", "__chance"]
    place = lambda round_, blocks: F.pmod(F.xxhash64(F.lit(seed + round_), "__key", "__size", "__tie", "__lot"), blocks)
    ready = ready.withColumn("__block", place(0, F.greatest(F.lit(1), F.ceil(F.col("__n") / BLOCK)).cast("long")))
    schema = ready.select(names).schema
    done, round_ = [], 0
    while True:
        most = targets.agg(F.max("__n")).first()[0] if round_ == 0 else ready.groupBy("source").count().agg(F.max("count")).first()[0]
        if not most:
            break
        land = most <= BLOCK
        if land:
            ready = ready.withColumn("__block", F.lit(0).cast("long"))
        elif round_:
            ready = ready.withColumn("__block", place(round_, F.lit(-(-most // BLOCK))))
        moved = stored(ready.select(*names, "__block").groupBy("source", "__block").applyInArrow(_flown(seed + round_, names, land), schema))
        done.append(moved.where("__chance in (0, 1)"))
        ready, round_ = moved.where("__chance not in (0, 1)"), round_ + 1
        if land:
            break
    out = ready.where("false").select(names) if not done else done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("__key", "source", "__size", "__tie", "source_size", "target", (F.col("__whole") + F.col("__chance").cast("long")).alias("copies"))


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 13, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """One row per document: key, size, source_size, target and copies (0, 1 or 2; at most ceil(cap)) in the mix, source and row_hash.

    A document's expected copies are target / source_size: the whole part is certain, the fraction is drawn by the cube
    method, balanced on words and on documents. Flights run in blocks of about 500 documents of a source (hashed by
    key, size and the row's hash, so that a hot source is many blocks); what stays fractional, two per block, flies
    again in the next round until a source has one block, where a landing of a few small documents is left. Each source ends
    within about one small document of its target. Blocks are sorted and seeded, so reruns agree. Ids stay in Arrow and
    are never made floating point.

    Null texts have no words; null keys are a key like any other; null sources are a source, the last; sources without
    words have target 0 and copies drawn at chance 0. Repeated rows are documents of their own; rows equal in every
    column are dealt in lots of LOT, however many they are. An empty table gives no rows. row_hash covers all columns of df.
    """
    docs = df.select(F.col(key).alias("__key"), F.col(source).alias("source"), count_words(F.col(text)).alias("__size"), row_hash(df).alias("__tie"))
    out = _mixed(docs, seed, weights, total, cap)
    return out.select(F.col("__key").alias(key), F.col("__size").alias("size"), "source_size", "target", "copies", "source", F.col("__tie").alias("row_hash"))


def mixing_report(docs: DataFrame) -> DataFrame:
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with docs' columns, each as often as it was taken; copies of a row are equal.

    Rows equal in every column are one row with their copies added up; rows that differ anywhere are told apart. Null
    ids, texts and sources are as in mix_sources. An empty table gives no rows.
    """
    names = docs.columns
    picked = settled(lambda: mix_sources(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__th")).agg(F.sum("copies").alias("__copies")))
    rows = docs.withColumn("__hash", row_hash(docs))
    met = rows.join(picked, (F.col("__hash") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id"))).dropDuplicates(["__id", "__th"])  # equal rows
    lots = met.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / LOT))))
    return lots.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT), F.col("__copies") - F.col("__lot") * LOT)))).select(names)
