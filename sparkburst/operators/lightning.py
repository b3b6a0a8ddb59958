"""Association of candidates with lightning strokes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkburst.functions import geo


def _bands(reach_deg: float) -> list[int]:
    """For each latitude band of reach_deg: how many longitude cells it has. None is narrower than the reach of a point in
    the band or in one next to it."""
    out = []
    for k in range(math.ceil(180 / reach_deg)):
        far = max(abs(-90 + (k - 1) * reach_deg), abs(-90 + (k + 2) * reach_deg))
        across = math.sin(math.radians(min(reach_deg, 90.0))) / max(math.cos(math.radians(min(far, 90.0))), 1e-12)
        out.append(1 if far + reach_deg >= 90 or across >= 1 else max(1, int(360 / math.degrees(math.asin(across)) * (1 - 1e-9))))
    return out


def near(points: DataFrame, strokes: DataFrame, reach_us: int, reach_m: float) -> DataFrame:
    """Pairs of points (at, lat, lon, alt) and strokes (time, stroke_lat, stroke_lon) that may be associated, with distance.

    Time is cut into buckets of twice reach_us and the globe into bands and cells no narrower than reach_m. Each stroke is
    filed once, each point asks the one or two buckets that its reach touches and its own and the neighbouring bands and
    cells, so the join is an equi-join with a residual and work follows the strokes that are near in time and place. Null
    places meet nothing.

    The join goes by shuffle: Spark takes the exploded points for as few bytes as they were before, and would send up to
    18 rows for each of them through the driver.
    """
    reach_deg = min(math.degrees(reach_m / geo.EARTH_M) * (1 + 1e-9), 180.0)
    cells = _bands(reach_deg)
    band = lambda lat: F.greatest(F.lit(0), F.least(F.floor((lat + 90) / reach_deg), F.lit(len(cells) - 1))).cast("int")
    held = lambda at: F.element_at(F.array(*map(F.lit, cells)), at + 1)
    cell = lambda lon, n: F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360 * n), n - 1).cast("int")
    bucket = lambda t: F.floor(t / (2 * reach_us))
    asked = points.withColumn("__band", F.explode(F.sequence(F.greatest(band(F.col("lat")) - 1, F.lit(0)), F.least(band(F.col("lat")) + 1, F.lit(len(cells) - 1)))))
    asked = asked.withColumn("__n", held(F.col("__band"))).withColumn("__cell", cell(F.col("lon"), F.col("__n")))
    asked = asked.withColumn("__cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("__cell") + d, F.col("__n"))))))
    asked = asked.withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.col("at") - reach_us), bucket(F.col("at") + reach_us))))).drop("__n")
    filed = strokes.withColumns({"__b": bucket(F.col("time")), "__band": band(F.col("stroke_lat"))})
    filed = filed.withColumn("__cell", cell(F.col("stroke_lon"), held(F.col("__band"))))
    keys = ["__b", "__band", "__cell"]
    met = asked.hint("merge").join(filed.hint("merge"), keys).where(F.abs(F.col("time") - F.col("at")) <= reach_us).drop(*keys)
    return met.withColumn("distance", geo.distance(F.col("lat"), F.col("lon"), F.col("stroke_lat"), F.col("stroke_lon"))).where(F.col("distance") <= reach_m)


def _delay_us() -> Column:
    return geo.arrival_ns(F.col("distance"), F.col("alt"), F.lit(geo.LIGHTNING_M)) / 1000


def associated(points: DataFrame, strokes: DataFrame, tolerance_us: int, reach_m: float) -> DataFrame:
    """Pairs whose stroke, seen from the satellite, is within the tolerance of the point's time."""
    pairs = near(points, strokes, tolerance_us + 100_000, reach_m)  # light takes far less than 0.1 s
    return pairs.where(F.abs(F.col("time") - (F.col("at") - _delay_us())) <= tolerance_us)


def _cells(reach_deg: float) -> list[tuple[int, float]]:
    """For each latitude band of twice reach_deg: how many longitude cells it has, and how far in longitude a point in it
    reaches. No cell is narrower than twice that; a band within reach of a pole is one cell."""
    out = []
    for k in range(math.ceil(90 / reach_deg)):
        far = max(abs(-90 + 2 * k * reach_deg), abs(-90 + 2 * (k + 1) * reach_deg))
        across = math.sin(math.radians(reach_deg)) / math.cos(math.radians(far)) if far + reach_deg < 90 else 1.0
        wide = 180.0 if across >= 1 else min(180.0, math.degrees(math.asin(across)) * (1 + 1e-9) + 1e-9)
        out.append((max(1, int(180 / wide)), wide))
    return out


def _overlap(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each k: how much of [lo[k], hi[k]] the intervals first[k] to last[k] - 1 cover together. The intervals [a, b] are
    equally long and in order, so that one covers up to the next one's start at most without it."""
    out, end = np.zeros(len(lo)), np.minimum(b, np.append(a[1:], np.inf))
    total = np.concatenate(([0.0], np.cumsum((end - a)[:-1])))
    begin = np.maximum(first, np.minimum(np.searchsorted(a, lo, "right"), last) - 1)
    final = np.minimum(last, np.searchsorted(a, hi)) - 1
    some = np.flatnonzero(begin <= final)
    x, y, lo, hi = begin[some], final[some], lo[some], hi[some]
    rest = np.minimum(b[y], hi)
    out[some] = total[y] - total[x] + rest - a[y] - np.maximum(0.0, np.minimum(np.where(x < y, end[x], rest), lo) - a[x])
    return out


def _covered(at: np.ndarray, place: tuple[float, float, float], strokes: np.ndarray, half: int, tolerance_us: int, reach_m: float) -> np.ndarray:
    """For each instant `at` of a place (lat, lon, alt): how many microseconds of the window around it the strokes (rows time,
    lat, lon, in order of time) cover."""
    lo, hi = at - half, at + half
    (lat, lon, alt), (x, y) = place, np.searchsorted(strokes[0], (lo.min(), hi.max() + 1))
    time, y1, x1 = strokes[:, x:y]
    h = np.sin(np.radians(y1 - lat) / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(np.radians(y1)) * np.sin(np.radians(x1 - lon) / 2) ** 2
    distance = 2 * geo.EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))
    near = distance <= reach_m
    time, distance = time[near], distance[near]
    if not len(time):
        return np.zeros(len(at))
    a, b = alt + geo.EARTH_M, geo.LIGHTNING_M + geo.EARTH_M
    seen = time + np.floor(np.sqrt(a * a + b * b - 2 * a * b * np.cos(distance / geo.EARTH_M)) / geo.LIGHT_M_S * 1e9 + 0.5) / 1000
    first, last = np.searchsorted(time, lo), np.searchsorted(time, hi, "right")
    order = np.sort(seen)
    out = _overlap(order - tolerance_us, order + tolerance_us, first, last, lo, hi)
    # A window's strokes are in one piece by time. They are so by arrival too, unless one just outside overtakes one inside.
    mixed = np.concatenate(([False], np.maximum.accumulate(seen)[:-1] > np.minimum.accumulate(seen[::-1])[::-1][1:], [False]))
    for k in np.flatnonzero(mixed[first] | mixed[last]):
        own = np.sort(seen[first[k] : last[k]])
        out[k] = _overlap(own - tolerance_us, own + tolerance_us, np.zeros(1, np.int64), np.array([len(own)]), lo[k : k + 1], hi[k : k + 1])[0]
    return out


_GROUP = ["__bucket", "__band", "__cell"]


def _shares(half: int, tolerance_us: int, reach_m: float):
    """(id, probability) of rows sorted by group, strokes first, then place: a group's strokes are held while its points pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, strokes = None, [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in _GROUP])
            at, lat, lon, alt = (pc.fill_null(batch[c], 0).to_numpy() for c in ("at", "lat", "lon", "alt"))
            point = batch["point"].to_numpy(zero_copy_only=False)
            places = np.stack([lat, lon, alt]) * point
            new = (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (point[1:] != point[:-1]) | (places[:, 1:] != places[:, :-1]).any(axis=0)
            edge = [*np.flatnonzero(np.concatenate(([True], new))).tolist(), batch.num_rows] if batch.num_rows else []
            covered = np.zeros(batch.num_rows)
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if (key := tuple(keys[:, x].tolist())) != group:
                    group, held, strokes = key, [], None
                if not point[x]:
                    held.append(np.stack([at[x:y], lat[x:y], lon[x:y]]))
                elif held:
                    if strokes is None:
                        strokes = np.concatenate(held, axis=1)
                        strokes = strokes[:, np.argsort(strokes[0], kind="stable")]
                        held = [strokes]
                    covered[x:y] = _covered(at[x:y], (lat[x], lon[x], alt[x]), strokes, half, tolerance_us, reach_m)
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(point)), pa.array(covered[point] / (2.0 * half))], ["id", "probability"])

    return run


def coincidence(points: DataFrame, strokes: DataFrame, tolerance_us: int, reach_m: float, window_us: int) -> DataFrame:
    """(id, probability) for every point: the share of a window around it that strokes' tolerance intervals cover.

    Pairs of points and strokes are never rows, as they grow with the square of the density. Time is cut into buckets of
    twice the window and the globe into bands and cells of at least twice the reach; a point has one group, and a stroke goes
    into the few groups (8 at most) that its window and its reach touch. A group's points pass one after another by its
    strokes. Points of one place share their strokes' distances and running sums, so each costs a few searches in them.
    Points with a null id, time, place or height meet nothing; nor do strokes with a null time or place.
    """
    half = tolerance_us + 1_000_000 + window_us // 2
    reach_deg = min(math.degrees(reach_m / geo.EARTH_M) * (1 + 1e-9) + 1e-9, 180.0)
    cells = _cells(reach_deg)
    band = lambda lat: F.greatest(F.lit(0), F.least(F.floor((lat + 90) / (2 * reach_deg)), F.lit(len(cells) - 1))).cast("int")
    at = lambda k, values: F.element_at(F.array(*map(F.lit, values)), k + 1)
    cell = lambda lon, n: F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360 * n), n - 1).cast("int")
    bucket = lambda t: F.floor(t / (4 * half)).cast("long")
    counts, widths = zip(*cells, strict=True)
    asked = points.select("id", F.col("at").cast("long").alias("at"), *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "alt")], F.lit(True).alias("point"))
    whole = F.col("id").isNotNull() & F.col("at").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("alt").isNotNull()
    asked = asked.withColumn("__bucket", F.when(whole, bucket(F.col("at"))).otherwise(F.lit(0).cast("long"))).withColumn("__band", F.when(whole, band(F.col("lat"))).otherwise(-1))
    # Points that meet nothing are dealt over many groups without strokes.
    asked = asked.withColumn("__cell", F.when(whole, cell(F.col("lon"), at(F.col("__band"), counts))).otherwise(F.pmod(F.xxhash64("id", "at", "lat", "lon"), F.lit(1024)).cast("int")))
    filed = strokes.where("time IS NOT NULL AND stroke_lat IS NOT NULL AND stroke_lon IS NOT NULL").select(F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.col("time").cast("long").alias("at"), F.col("stroke_lat").cast("double").alias("lat"), F.col("stroke_lon").cast("double").alias("lon"), F.lit(None).cast("double").alias("alt"), F.lit(False).alias("point"))
    filed = filed.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col("at") - half), bucket(F.col("at") + half)))))
    filed = filed.withColumn("__band", F.explode(F.sequence(band(F.col("lat") - reach_deg), band(F.col("lat") + reach_deg))))
    ends = [cell(F.col("lon") + side * at(F.col("__band"), widths), at(F.col("__band"), counts)) for side in (-1, 1)]
    filed = filed.withColumn("__cell", F.explode(F.array_distinct(F.array(*ends))))
    dealt = asked.unionByName(filed).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "point", "lat", "lon", "alt")
    return dealt.mapInArrow(_shares(half, tolerance_us, reach_m), T.StructType([T.StructField("id", points.schema["id"].dataType), T.StructField("probability", T.DoubleType())]))


def strokes_between(strokes: DataFrame, first: str, last: str) -> DataFrame:
    """Strokes whose time, a text with microseconds, lies between two texts, both included, in order."""
    return strokes.where(F.col("time").between(first, last)).orderBy("time")
