"""Interpolating as-of join of instants with a trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolated(points: DataFrame, path: DataFrame, values: list[str], chunk: str = "chunk", at: str = "at", t: str = "t", width: int | None = None) -> DataFrame:
    """points with path's values at `at`, linear between its neighbours; points after the last path row (or with one row only) are dropped.

    Both sides are one stream sorted by (chunk, time); each point looks back to the last path row strictly before it
    and that row carries its successor, so nothing is compared pairwise. Before the first path row the first segment is
    extended.

    With a width a chunk's stream is cut into stretches of so much time, so that a chunk with many points is many tasks'
    work: each stretch has its own points and every segment that touches it. Then points without a time are dropped.
    """
    part_of = lambda c: F.floor(c / width).cast("long") if width else F.lit(0).cast("long")
    w = Window.partitionBy(chunk).orderBy(t)
    after = lambda c: F.lead(c).over(w)
    segment = path.select(chunk, t, *values).withColumn("__s", F.struct(F.col(t).alias("t0"), after(t).alias("t1"), *[F.struct(F.col(v).alias("a"), after(v).alias("b")).alias(v) for v in values]))
    first = F.row_number().over(w) == 1
    segment = segment.withColumn("__first", F.when(first, F.col("__s")))
    segment = segment.withColumn("__part", part_of(F.col(t)))
    if width:
        # The first segment also serves the points before it, from the stretch of the earliest one on.
        least = points.groupBy(F.col(chunk).alias("__chunk")).agg(F.min(at).alias("__least"))
        low = F.when(F.col("__first").isNotNull(), F.least(F.col(t), F.col("__least"))).otherwise(F.col(t))
        segment = segment.join(least, F.col(chunk) == F.col("__chunk")).withColumn("__part", F.explode(F.sequence(part_of(low), part_of(F.coalesce("__s.t1", t)))))
    stream = points.select(F.col(chunk), part_of(F.col(at)).alias("__part"), F.col(at).alias("__t"), F.lit(0).alias("__kind"), F.struct(*points.columns).alias("__p")).unionByName(
        segment.select(F.col(chunk), "__part", F.col(t).alias("__t"), F.lit(1).alias("__kind"), "__s", "__first"), allowMissingColumns=True
    )
    order = Window.partitionBy(chunk, "__part").orderBy("__t", "__kind")  # a point comes before a path row of its instant
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = F.last("__s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    stream = stream.withColumn("__use", F.coalesce(seen, F.first("__first", ignorenulls=True).over(whole)))
    hit = stream.where("__kind = 0 AND __use.t1 IS NOT NULL")
    part = (F.col("__t") - F.col("__use.t0")) / (F.col("__use.t1") - F.col("__use.t0"))
    return hit.select("__p.*", *[(F.col(f"__use.{v}.a") + (F.col(f"__use.{v}.b") - F.col(f"__use.{v}.a")) * part).alias(v) for v in values])


def window(path: DataFrame, centre: int, half: int, t: str = "t") -> DataFrame:
    """Rows within half of centre, both ends included."""
    return path.where(F.col(t).between(centre - half, centre + half))
