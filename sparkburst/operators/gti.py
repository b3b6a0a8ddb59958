"""Good time intervals: events inside them, and the exposure that they leave in each bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _usable(intervals: DataFrame, start: str, stop: str) -> DataFrame:
    return intervals.where(F.col(start) < F.col(stop))


def dealt(intervals: DataFrame, origin: int, width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """intervals cut at origin + k * width, with the number `stretch` of each piece: so that a long one is many tasks' work.

    An interval is [start, stop) in whole units; null, empty and backward ones give nothing.
    """
    number = lambda t: F.floor((t - origin) / width).cast("long")
    cut = _usable(intervals, start, stop).withColumn("stretch", F.explode(F.sequence(number(F.col(start)), number(F.col(stop) - 1))))
    low = F.lit(origin) + F.col("stretch") * width
    return cut.withColumns({start: F.greatest(F.col(start), low), stop: F.least(F.col(stop), low + width)})


def marked(events: DataFrame, intervals: DataFrame, keys: list[str], at: str = "t", start: str = "start", stop: str = "stop") -> DataFrame:
    """events with `good`: whether an interval [start, stop) of the same keys holds them; a column `good` of theirs is replaced.

    Events and intervals of a key are one stream sorted by time: an event is held if the greatest stop of all intervals that
    have begun lies after it. So overlapping intervals need no merging, and nothing is compared pairwise. An event without
    a time is not good; keys may be null and then meet null keys. No interval: none is good. No event: no rows.
    """
    own = [c for c in events.columns if c != "good"]
    left = events.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.struct(*own).alias("__e"))
    right = _usable(intervals, start, stop).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col(start).alias("__t"), F.lit(0).alias("__kind"), F.col(stop).alias("__stop"))
    order = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    stream = left.unionByName(right, allowMissingColumns=True).withColumn("__last", F.max("__stop").over(order))
    return stream.where("__kind = 1").select("__e.*", F.coalesce(F.col("__last") > F.col("__t"), F.lit(False)).alias("good"))


def merged(intervals: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """(keys..., start, stop) of the union of each key's intervals: overlapping and touching ones are one."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = _usable(intervals, start, stop).withColumn("__new", F.when(before >= F.col(start), 0).otherwise(1))
    islands = islands.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__island")


def exposure(intervals: DataFrame, keys: list[str], origin: int, width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """(keys..., bin, exposure): good time in each bin of width from origin, overlaps once; bins without any are left out.

    Intervals are first cut at bins, so that a key and bin is a group of its own: a hot key's intervals are many tasks' work.
    """
    pieces = dealt(intervals, origin, width, start, stop).withColumnRenamed("stretch", "bin")
    return merged(pieces, [*keys, "bin"], start, stop).groupBy(*keys, "bin").agg(F.sum(F.col(stop) - F.col(start)).alias("exposure"))


def rates(events: DataFrame, intervals: DataFrame, keys: list[str], origin: int, width: int, at: str = "t") -> DataFrame:
    """(keys..., bin, exposure, count): good time and good events of each bin that has good time."""
    number = F.floor((F.col(at) - origin) / width).cast("long")
    pieces = dealt(intervals, origin, width).withColumnRenamed("stretch", "bin")
    good = marked(events.withColumn("bin", number), pieces, [*keys, "bin"], at).where("good").groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    left, right = exposure(intervals, keys, origin, width), good.select(*[F.col(c).alias(f"__{c}") for c in [*keys, "bin"]], "count")
    met = left.join(right, [left[c].eqNullSafe(right[f"__{c}"]) for c in [*keys, "bin"]], "left")
    return met.select(*keys, "bin", "exposure", F.coalesce("count", F.lit(0)).alias("count"))


def energies(events: DataFrame, bounds: DataFrame, keys: list[str], channel: str = "pi") -> DataFrame:
    """events with e_min and e_max of their channel, from bounds (keys..., channel, e_min, e_max); unknown channels have nulls."""
    right = bounds.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("channel").alias("__channel"), "e_min", "e_max")
    met = [F.col(c) == F.col(f"__{c}") for c in keys]
    return events.join(right, [*met, F.col(channel) == F.col("__channel")], "left").drop("__channel", *[f"__{c}" for c in keys])
