"""Scan statistic: improbably dense runs of events against the local Poisson background."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkburst.functions import poisson


@dataclass(frozen=True)
class ScanConfig:
    """Durations in microseconds; limit is false positives a year."""

    min_duration: int = 10
    max_duration: int = 1_000
    neighbor: int = 1_000_000
    hollow: int = 10_000
    limit: float = 20.0
    min_number: int = 8


def triggers(events: DataFrame, config: ScanConfig, chunk: str = "chunk", t: str = "t", start: str = "start", stop: str = "stop", group: str | None = None) -> DataFrame:
    """Pairs of events (ti, tj) of a chunk whose count is improbable: chunk, ti, tj, k, mean, p, fp.

    events has integer microseconds t and its chunk's span [start, stop). One window (chunk, t) serves every rank, so
    there is one shuffle and one sort, by chunk; a chunk is the unit of work (an hour's file), so partitions are bounded
    by the mission's hours and not by the mission. Pairs come from a range frame bounded by max_duration and are dropped
    before they are exploded if they are too few; those that a closed bound of their tail excludes are dropped before
    the tail is summed.

    Background counts reproduce the sequential search's pointers: on the left one event beyond the window is still
    counted; on the right the first event beyond the first snapshot's window is counted (clamped to the last event);
    counts aren't clipped at stop, while durations are. Null times are dropped. With a group column (integers from 0),
    all groups count towards min_number, k and mean, but the tail that is held against the limit is group 0's.
    """
    zero = F.lit(1) if group is None else F.when(F.col(group) == 0, 1).otherwise(0)
    order = F.lit(0) if group is None else F.col(group)
    rows = events.where(F.col(t).isNotNull() & (F.col(t) >= F.col(start))).select(F.col(chunk).alias("chunk"), F.col(t).alias("t"), F.col(start).alias("start"), F.col(stop).alias("stop"), zero.alias("g"), order.alias("o"))
    ranks = Window.partitionBy("chunk").orderBy("t", "o") if group else Window.partitionBy("chunk").orderBy("t")
    w = Window.partitionBy("chunk").orderBy("t")
    whole = Window.partitionBy("chunk")
    upto = lambda d: w.rangeBetween(Window.unboundedPreceding, d)
    halves = {"n": config.neighbor // 2, "h": config.hollow // 2}
    columns = {"rn": F.row_number().over(ranks) - 1, "n": F.count("*").over(whole), "t0": F.min("t").over(whole)}
    for x, half in halves.items():
        columns |= {f"lt_{x}": F.count("*").over(upto(half - 1)) - 1, f"fg_{x}": F.greatest(F.count("*").over(upto(-half - 1)) - 1, F.lit(0))}
    if group:
        columns["rn_0"] = F.sum("g").over(ranks.rowsBetween(Window.unboundedPreceding, 0))
        for x, half in halves.items():
            left = upto(-half - 1)
            columns |= {f"lt_{x}0": F.sum("g").over(upto(half - 1)), f"fg_{x}0": F.coalesce(F.sum("g").over(left) - F.last(F.struct("o", "g")).over(left)["g"], F.lit(0))}
    ranked = rows.withColumns(columns)
    firsts = {}
    for x, half in halves.items():
        before = F.col("t") < F.col("t0") + half
        firsts[f"f_{x}"] = F.least(F.count_if(before).over(whole), F.col("n") - 1)
        if group:
            beyond = F.when(~before, F.struct("t", "o", "g"))
            firsts[f"f_{x}0"] = F.sum(F.when(before, F.col("g"))).over(whole) + F.coalesce(F.min(beyond).over(whole)["g"], F.lit(0))
    kept = ["t", "rn", "lt_n", "lt_h", *(["rn_0", "lt_n0", "lt_h0"] if group else [])]
    ranked = ranked.withColumns(firsts).withColumn("near", F.collect_list(F.struct(*kept)).over(w.rangeBetween(0, config.max_duration - 1)))
    enough = F.filter("near", lambda x: (x["rn"] - F.col("rn") + 1 >= config.min_number) & (x["t"] < F.col("stop")) & (x["t"] - F.col("t") >= max(1, config.min_duration)))
    pairs = ranked.where(F.col("t") < F.col("stop")).withColumn("j", F.explode(enough))
    ti, tj = F.col("t"), F.col("j.t")
    inside = lambda half: F.least(tj + half, F.col("stop")) - F.greatest(ti - half, F.col("start"))
    count = lambda x: F.greatest(F.col(f"f_{x}"), F.col(f"j.lt_{x}")) - F.col(f"fg_{x}") + 1
    count_0 = lambda x: F.greatest(F.col(f"f_{x}0"), F.col(f"j.lt_{x}0")) - F.col(f"fg_{x}0")
    background = lambda c: F.try_divide((c("n") - c("h")) * (tj - ti), inside(halves["n"]) - inside(halves["h"]))
    own = (background(count), F.col("j.rn") - F.col("rn") + 1)
    tested = (background(count_0), F.col("j.rn_0") - F.col("rn_0") + F.col("g")) if group else own
    pairs = pairs.select("chunk", ti.alias("ti"), tj.alias("tj"), own[1].cast("long").alias("k"), own[0].alias("mean"), tested[1].cast("long").alias("k_0"), tested[0].alias("mean_0"))
    seconds = (F.col("tj") - F.col("ti")) / 1e6
    limit = poisson.threshold(config.limit, seconds)
    likely = pairs.where((F.col("mean_0") > 0) & (poisson.log_sf_floor(F.col("mean_0"), F.col("k_0")) < F.log(limit)))
    scored = likely.withColumn("p_0", poisson.search_sf(F.col("mean_0"), F.col("k_0"))).where(F.col("p_0") < limit)
    p = poisson.search_sf(F.col("mean"), F.col("k")) if group else F.col("p_0")
    return scored.select("chunk", "ti", "tj", "k", "mean", p.alias("p")).withColumn("fp", poisson.per_year(F.col("p"), seconds))


def _islands(vision: float):
    """Numbers the islands of triggers sorted by (chunk, ti, tj): a trigger joins if it begins by the island's stop and
    `vision` times the longest of the island's bins and its own. What that bin is so far depends on where earlier islands
    ended, so this is a fold in order; its state is three numbers, kept from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, stop, longest, island = None, 0, 0, 0
        for batch in batches:
            out = []
            for c, ti, tj in zip(*(batch[x].to_pylist() for x in ("chunk", "ti", "tj")), strict=True):
                if c != chunk:
                    chunk, island = c, 0
                joined = island > 0 and stop + max(longest, tj - ti) * vision >= ti
                if joined:
                    stop, longest = max(stop, tj), max(longest, tj - ti)
                else:
                    stop, longest, island = tj, tj - ti, island + 1
                out.append(island)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "island"])

    return run


def merged(found: DataFrame, vision: float = 0.0) -> DataFrame:
    """Touching triggers of a chunk as one candidate: its extent, extreme and best sub-intervals, and the best's figures.

    With a vision above 0, triggers that begin within `vision` longest bins behind a candidate belong to it too; chunks are
    then folded in order (see _islands), each in one task, as for the scan. Triggers of null chunks are dropped then.
    """
    w = Window.partitionBy("chunk").orderBy("ti", "tj")
    if vision > 0:
        rows = found.select("chunk", "ti", "tj", "k", "mean", "p", "fp").where("chunk IS NOT NULL").repartition("chunk").sortWithinPartitions("chunk", "ti", "tj")
        islands = rows.mapInArrow(_islands(vision), T.StructType([*rows.schema.fields, T.StructField("island", T.LongType())]))
    else:
        reach = F.max("tj").over(w.rowsBetween(Window.unboundedPreceding, -1))
        islands = found.withColumn("new", F.when(F.coalesce(reach < F.col("ti"), F.lit(True)), 1).otherwise(0))
        islands = islands.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by(F.struct("ti", "tj", "k", "mean", "p", "fp"), F.struct("fp", "ti", "tj"))
    out = islands.groupBy("chunk", "island").agg(F.min("ti").alias("start"), F.max("tj").alias("stop"), F.min(F.col("tj") - F.col("ti")).alias("bin_min"), F.max(F.col("tj") - F.col("ti")).alias("bin_max"), best.alias("b"))
    return out.select("chunk", "start", "stop", "bin_min", "bin_max", (F.col("b.tj") - F.col("b.ti")).alias("bin_best"), (F.col("b.ti") - F.col("start")).alias("delay"), F.col("b.k").alias("count"), F.col("b.mean").alias("mean"), F.col("b.p").alias("sf"), F.col("b.fp").alias("fp"))


def search(events: DataFrame, config: ScanConfig, vision: float = 0.0, **columns: str) -> DataFrame:
    return merged(triggers(events, config, **columns), vision)


def vetoed(candidates: DataFrame, interval: int, duration: int, count: int) -> DataFrame:
    """candidates without those in long or crowded sessions (gaps above interval part sessions).

    The last candidate of a chunk always stands alone and so always stays, as the sequential veto closes its session
    before it.
    """
    w = Window.partitionBy("chunk").orderBy("start")
    parts = (F.col("start") - F.lag("start").over(w) > interval) | F.lead("start").over(w).isNull()
    marked = candidates.withColumns({"__cut": F.when(F.coalesce(parts, F.lit(False)), 1).otherwise(0), "__last": F.lead("start").over(w).isNull()})
    marked = marked.withColumn("__session", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy("chunk", "__session")
    bad = (F.max("start").over(s) - F.min("start").over(s) > duration) | (F.count("*").over(s) >= count)
    return marked.withColumn("__bad", bad).where("NOT __bad OR __last").select(candidates.columns)
