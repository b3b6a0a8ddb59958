"""Photon events: derived columns and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scintillator(pulse_width: Column) -> Column:
    return F.when(pulse_width < 75, "NaI").otherwise("CsI")


def unfolded_channel(channel: Column) -> Column:
    """Channels below 20 have wrapped round."""
    return F.when(channel < 20, channel + 256).otherwise(channel)


def kept_hxmt(pulse_width: Column, event_type: Column, channel: Column) -> Column:
    """CsI events of unfolded channel 38 and above that aren't from the calibration source; anti-coincidence isn't asked."""
    return (pulse_width >= 75) & (event_type != 1) & (unfolded_channel(channel) >= 38)


def kept_analysis(pulse_width: Column, event_type: Column, channel: Column) -> Column:
    """The analysis' stricter twin: event type 0 only."""
    return (pulse_width >= 75) & (event_type == 0) & (unfolded_channel(channel) >= 38)


def around(df: DataFrame, time: str, centre: int, half: int) -> DataFrame:
    """Rows strictly within half of centre, with their offset."""
    return df.where((F.col(time) > centre - half) & (F.col(time) < centre + half)).withColumn("offset", F.col(time) - centre)


def merged_streams(streams: list[DataFrame]) -> DataFrame:
    """Detector streams as one with det_id; order by (time, det_id) where order matters."""
    return reduce(DataFrame.unionByName, (s.withColumn("det_id", F.lit(k)) for k, s in enumerate(streams, 1)))
