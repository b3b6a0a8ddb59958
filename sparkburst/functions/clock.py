"""Mission clocks: seconds since a mission's epoch, leap seconds included, against UTC in microseconds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days whose last second is a leap second.
LEAP_DAYS = (
    "1972-06-30", "1972-12-31", "1973-12-31", "1974-12-31", "1975-12-31", "1976-12-31", "1977-12-31", "1978-12-31", "1979-12-31",
    "1981-06-30", "1982-06-30", "1983-06-30", "1985-06-30", "1987-12-31", "1989-12-31", "1990-12-31", "1992-06-30", "1993-06-30",
    "1994-06-30", "1995-12-31", "1997-06-30", "1998-12-31", "2005-12-31", "2008-12-31", "2012-06-30", "2015-06-30", "2016-12-31",
)
SECOND, NANO = 1_000_000, 1_000_000_000


def micros(text: str) -> int:
    return round(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * SECOND


@dataclass(frozen=True)
class Mission:
    """A satellite and detector: name, clock epoch, first day of data, and how its events are told apart."""

    name: str
    epoch: str
    launch: str

    @property
    def leaps(self) -> list[int]:
        """UTC microseconds at the ends of the leap days after the epoch."""
        ends = (micros(d) + 86_400 * SECOND for d in LEAP_DAYS)
        return [t for t in ends if t > micros(self.epoch)]


HXMT = Mission("HXMT/HE", "2012-01-01", "2017-06-15")
SVOM = Mission("SVOM/GRM", "2017-01-01", "2024-06-22")
MISSIONS = {m.name: m for m in (HXMT, SVOM)}


def met_from_utc(utc_us: Column, mission: Mission) -> Column:
    """Elapsed seconds (double) of a UTC instant in microseconds: one more for every leap second passed."""
    passed = sum((F.when(utc_us >= t, 1).otherwise(0) for t in mission.leaps), F.lit(0))
    return ((utc_us - micros(mission.epoch)) + passed * SECOND) / float(SECOND)


def utc_from_met(met: Column, mission: Mission) -> Column:
    """UTC microseconds of elapsed seconds. A leap second itself falls on the second before; below zero fractions are lost."""
    whole = F.when(met < 0, F.ceil(met)).otherwise(F.floor(met)).cast("long")
    fraction = F.greatest(F.lit(0).cast("long"), F.round((met - whole) * SECOND).cast("long"))
    time = F.lit(micros(mission.epoch)) + whole * SECOND + fraction
    for t in mission.leaps:
        time = F.when(time >= t, time - SECOND).otherwise(time)
    return time


def nanos_of_text(text: Column) -> Column:
    """UTC nanoseconds (long) of a text like 2020-08-06T08:51:41.908577919Z with up to nine decimals, or null."""
    parts = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?Z?$"
    seconds = F.unix_seconds(F.try_to_timestamp(F.translate(F.regexp_extract(text, parts, 1), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))
    return seconds * NANO + F.rpad(F.regexp_extract(text, parts, 2), 9, "0").cast("long")


def text_of_nanos(nanos: Column) -> Column:
    """The text of UTC nanoseconds, with as few of 0, 3, 6 or 9 decimals as tell them."""
    part = F.pmod(nanos, F.lit(NANO))
    digits = F.lpad(part.cast("string"), 9, "0")
    shown = F.when(part == 0, "").when(part % 1_000_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3))).when(part % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6))).otherwise(F.concat(F.lit("."), digits))
    whole = F.timestamp_seconds(F.call_function("div", nanos - part, F.lit(NANO)))
    return F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), shown, F.lit("Z"))


def met_of_nanos(utc_ns: Column, mission: Mission) -> Column:
    """Elapsed seconds as an exact decimal(20,9) of UTC nanoseconds."""
    passed = sum((F.when(utc_ns >= t * 1000, 1).otherwise(0) for t in mission.leaps), F.lit(0))
    elapsed = (utc_ns - micros(mission.epoch) * 1000) + passed.cast("long") * NANO
    return (elapsed.cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(20,9)")


def nanos_of_met(met: Column, mission: Mission) -> Column:
    """UTC nanoseconds of elapsed seconds, exact for a decimal(20,9). A leap second itself falls on the second before."""
    time = F.lit(micros(mission.epoch) * 1000) + (met.cast("decimal(20,9)") * F.lit(NANO).cast("decimal(10,0)")).cast("long")
    for t in mission.leaps:
        time = F.when(time >= t * 1000, time - NANO).otherwise(time)
    return time
