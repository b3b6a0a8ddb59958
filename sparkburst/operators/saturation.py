"""Detector saturation from engineering clocks and science packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkburst.functions import packets

GAP_S = 6.9e-3


def clock_rows(engineering: DataFrame) -> DataFrame:
    """engineering (chunk, box, row, stime, bus: binary) with bus_time and repaired: frozen seconds count up from the last that moved."""
    rows = engineering.withColumn("bus_time", packets.bus_time(F.col("bus")))
    w = Window.partitionBy("chunk", "box").orderBy("row")
    moved = F.coalesce(F.col("bus_time") != F.lag("bus_time").over(w), F.lit(True))
    rows = rows.withColumn("run", F.sum(F.when(moved, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("chunk", "box", "run").orderBy("row")
    return rows.withColumn("repaired", F.first("bus_time").over(inside) + F.row_number().over(inside) - 1).drop("run")


def pivots(candidates: DataFrame, engineering: DataFrame) -> DataFrame:
    """(id, chunk, box, stamp, pivot): the box's clock at the rounded second, read directly or else after repair; null if neither."""
    boxes = engineering.select("chunk", "box").distinct()
    asked = candidates.select("id", "chunk", F.round("met").cast("long").alias("stamp")).join(boxes, "chunk")
    stamps = F.array(F.struct(F.col("bus_time").alias("stamp"), F.lit(True).alias("direct")), F.struct(F.col("repaired").alias("stamp"), F.lit(False).alias("direct")))
    rows = clock_rows(engineering).select("chunk", "box", "row", "stime", F.explode(stamps).alias("s"))
    first = lambda direct: F.min(F.when(F.col("s.direct") == direct, F.struct("row", "stime")))["stime"]
    times = rows.groupBy("chunk", "box", F.col("s.stamp").alias("stamp")).agg(F.coalesce(first(True), first(False)).cast("long").alias("pivot"))
    return asked.join(times, ["chunk", "box", "stamp"], "left").select("id", "chunk", "box", "stamp", "pivot")


def saturated_boxes(candidates: DataFrame, engineering: DataFrame, science: DataFrame) -> DataFrame:
    """(id, box, saturated) from candidates (id, chunk, met) and packets (chunk, box, row, ccsds: binary of 882 bytes).

    Packets are opened once, before they meet candidates; a candidate asks for the five seconds around its stamp by
    second, so that it meets their packets only. Between the last packets that hold the clock
    marks one second before and after, a gap of more than 6.9 ms between one packet's last and the next one's first
    tick is saturation; so is everything that cannot be decided: no clock reading, no marks, marks in reverse. As this
    depends on the stamp alone, candidates of one second are judged once.
    """
    asked = pivots(candidates, engineering)
    stamps = asked.where("pivot IS NOT NULL").select("chunk", "box", "stamp", "pivot").distinct()
    seconds = stamps.withColumn("utc", F.explode(F.sequence(F.col("stamp") - 2, F.col("stamp") + 2)))
    met = seconds.join(packets.summarised(science.select("chunk", "box", "row", "ccsds")), ["chunk", "box", "utc"])
    pair = Window.partitionBy("chunk", "box", "stamp")
    numbered = met.withColumn("pack", F.row_number().over(pair.orderBy("row")))
    mark = lambda d: F.max(F.when(F.array_contains("marks", F.col("pivot") + d), F.col("pack"))).over(pair)
    spanned = numbered.withColumns({"first": mark(-1), "final": mark(1)}).where("pack BETWEEN first AND final")
    order = pair.orderBy("pack")
    clock = F.coalesce(F.last("last_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("pivot") - 1)
    ends = spanned.withColumn("clock", clock).select("chunk", "box", "stamp", "pack", *[pick(F.col("clock") + F.col(f"early_{x}") * packets.TICK_S, F.col(x)).alias(x) for x, pick in (("low", F.least), ("high", F.greatest))]).where("low IS NOT NULL")
    judged = ends.withColumn("gap", F.lead("low").over(order) - F.col("high")).groupBy("chunk", "box", "stamp").agg(F.coalesce(F.max("gap") > GAP_S, F.lit(False)).alias("wide"))
    return asked.join(judged, ["chunk", "box", "stamp"], "left").select("id", "box", F.coalesce("wide", F.lit(True)).alias("saturated"))


def saturated(candidates: DataFrame, engineering: DataFrame, science: DataFrame) -> DataFrame:
    """Ids whose boxes are all saturated; a candidate without boxes is."""
    boxes = saturated_boxes(candidates, engineering, science).groupBy("id").agg(F.bool_and("saturated").alias("all"))
    return candidates.select("id").join(boxes, "id", "left").where(F.coalesce("all", F.lit(True))).select("id")
