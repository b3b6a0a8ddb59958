"""Bit fields of telemetry packets, from binary columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 4-bit remainders.
CRC4 = (0, 3, 6, 5, 12, 15, 10, 9, 11, 8, 13, 14, 7, 4, 1, 2)
TICK_S = 2e-6


def word(data: Column, place: int, n: int = 4) -> Column:
    """n bytes (seven at most) from number `place` (from 0) of a binary column, the first one highest, as a long."""
    return F.conv(F.hex(F.substring(data, place + 1, n)), 16, 10).cast("long")


def byte(data: Column, place: int | Column) -> Column:
    """Byte number `place` (from 0) of a binary column, as a long."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.conv(F.hex(F.substring(data, place + 1, F.lit(1))), 16, 10).cast("long")


def swapped(value: Column) -> Column:
    """Four bytes in reverse order."""
    part = lambda k: F.shiftright(value, 8 * k).bitwiseAND(255)
    return part(0) * 16_777_216 + part(1) * 65_536 + part(2) * 256 + part(3)


def _fold(value: int) -> int:
    """Remainder of a number of 15 half-bytes."""
    out = 0
    for k in range(14, -1, -1):
        out = CRC4[out ^ (value >> 4 * k & 15)]
    return out


#: The remainder is linear over bits: each of its four bits is the parity of some of the 64 bits, told by two words' masks.
_MASKS = [tuple(sum(1 << k for k in range(32) if shift + k >= 4 and _fold(1 << (shift + k - 4)) >> bit & 1) for shift in (32, 0)) for bit in range(4)]


def remainder(high: Column, low: Column) -> Column:
    """Remainder of 64 bits without the last four, given as two words of 32."""
    parity = lambda a, b: (F.bit_count(high.bitwiseAND(F.lit(a).cast("long"))) + F.bit_count(low.bitwiseAND(F.lit(b).cast("long")))) % 2
    return reduce(lambda x, y: x + y, [parity(a, b) * (1 << k) for k, (a, b) in enumerate(_MASKS)]).cast("long")


def crc4(data: Column) -> Column:
    """Remainder of the first 15 of the 16 half-bytes of 8 bytes."""
    return remainder(word(data, 0), word(data, 4))


def bus_time(data: Column) -> Column:
    """Seconds in the last four of six bytes, little end first, without the top bit."""
    return swapped(word(data, 2)).bitwiseAND(0x7FFFFFFF)


def packet_utc(data: Column) -> Column:
    """Seconds in bytes 878 to 881, little end first."""
    return swapped(word(data, 878))


def record(data: Column) -> Column:
    """struct(kind, stime, ptime) of an 8-byte record: event, second (a clock mark) or error (bad type bits or remainder)."""
    low = word(data, 4)
    type_ = low.bitwiseAND(0x30)
    ok = crc4(data) == low.bitwiseAND(0x0F)
    kind = F.when(ok & type_.isin(0x00, 0x20), "event").when(ok & (type_ == 0x10), "second").otherwise("error")
    ptime = F.shiftright(low, 6).bitwiseAND(0x7FFFF)
    stime = word(data, 0)
    return F.struct(kind.alias("kind"), F.when(kind == "second", stime).alias("stime"), F.when(kind != "error", ptime).alias("ptime"))


def acd_flags(acd: Column) -> Column:
    """The low 18 bits as booleans, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: F.call_function("shiftright", acd, i).bitwiseAND(1) == 1)


def packed(type_: Column, stime: Column, ptime: Column) -> Column:
    """The 8 bytes of a record with these type bits (0x00, 0x10, 0x20 or 0x30), clock and tick, its remainder included."""
    eight = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    high, low = stime.cast("long"), ptime.cast("long").bitwiseAND(0x7FFFF) * 64 + type_
    return F.unhex(F.concat(eight(high), eight(low + remainder(high, low))))


_TABLE = np.array(CRC4, np.uint16)
#: The remainder after one byte more, at 256 times the remainder before plus the byte.
_AFTER = _TABLE[_TABLE[np.arange(16)[:, None] ^ (np.arange(256)[None, :] >> 4)] ^ (np.arange(256)[None, :] & 15)].reshape(-1)


def remainders(b: np.ndarray) -> np.ndarray:
    """Remainders of records whose eight bytes lie along the first axis."""
    out = np.zeros(b.shape[1:], np.uint16)
    for k in range(7):
        out = _AFTER[(out << 8) | b[k]]
    return _TABLE[out ^ (b[7] >> 4)]


def records(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, record, crc, bus, kind) of every 8-byte record of every text (null: empty), in Arrow batches.

    Bytes left at the end, and empty texts, give one row of kind short without fields. A slice of records at a time is
    opened, however long a text is.
    """
    kinds, kind_of = pa.array(["event", "second", "error", "short"]), np.array([0, 1, 0, 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch[text].cast(pa.large_binary())
            bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
            data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
            size = np.diff(bounds)
            until = np.cumsum(np.maximum(-(-size // 8), 1))
            for a in range(0, int(until[-1]) if len(until) else 0, _RUN):
                number = np.arange(a, min(a + _RUN, int(until[-1])))
                doc = np.searchsorted(until, number, side="right")
                number -= until[doc] - np.maximum(-(-size[doc] // 8), 1)
                whole = 8 * number + 8 <= size[doc]
                b = np.zeros((8, len(number)), np.uint8)
                b[:, whole] = data[(bounds[doc] + 8 * number)[whole] + np.arange(8)[:, None]]
                crc = remainders(b)
                bus = b[2].astype(np.int64) | b[3].astype(np.int64) << 8 | b[4].astype(np.int64) << 16 | (b[5].astype(np.int64) & 127) << 24
                kind = np.where(whole, np.where(crc == (b[7] & 15), kind_of[(b[7] >> 4) & 3], 2), 3)
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(crc.astype(np.int64), mask=~whole), pa.array(bus, mask=~whole), kinds.take(pa.array(kind))], [key, "record", "crc", "bus", "kind"])

    kind_of_key = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(run, f"{key} {kind_of_key}, record int, crc long, bus long, kind string")


#: Fields of a packet that say when it was: its UTC second, its clock marks, and its first and last ticks before the first
#: mark (in ticks) and from it on (in seconds), and its last mark.
SUMMARY = "utc long, marks array<long>, early_low long, early_high long, low double, high double, last_mark long"
_PACKET, _RECORDS, _SLICE = 882, 109, 1024
#: Records of texts opened at once.
_RUN = 1 << 18


def summarised(science: DataFrame, data: str = "ccsds") -> DataFrame:
    """science with SUMMARY in place of its packets, which are opened once, in Arrow batches; packets of another length give no row."""
    names = [c for c in science.columns if c != data]
    schema = T.StructType([*science.select(names).schema.fields, *T.StructType.fromDDL(SUMMARY).fields])

    def opened(raw: list[bytes]) -> list[pa.Array]:
        grid = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), _PACKET)
        r = grid[:, 6 : 6 + 8 * _RECORDS].reshape(len(raw), _RECORDS, 8).astype(np.int64)
        whole = remainders(np.moveaxis(grid[:, 6 : 6 + 8 * _RECORDS].reshape(len(raw), _RECORDS, 8), 2, 0)) == (r[..., 7] & 15)
        type_ = r[..., 7] & 0x30
        second, event = whole & (type_ == 0x10), whole & ((type_ == 0) | (type_ == 0x20))
        ptime = ((r[..., 4] & 1) << 18) + (r[..., 5] << 10) + (r[..., 6] << 2) + (r[..., 7] >> 6)
        stime = (r[..., 0] << 24) + (r[..., 1] << 16) + (r[..., 2] << 8) + r[..., 3]
        last = np.maximum.accumulate(np.where(second, np.arange(_RECORDS), -1), axis=1)
        early, late = event & (last < 0), (event | second) & (last >= 0)
        tick = np.take_along_axis(stime, np.maximum(last, 0), axis=1) + ptime * TICK_S

        def ends(value: np.ndarray, held: np.ndarray, kind) -> tuple[pa.Array, pa.Array]:
            low, high = np.where(held, value, np.inf).min(axis=1), np.where(held, value, -np.inf).max(axis=1)
            none = ~held.any(axis=1)
            return tuple(pa.array(np.where(none, 0, x).astype(kind), mask=none) for x in (low, high))

        rows, _ = np.nonzero(second)
        marks = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(raw) + 1)).astype(np.int32)), pa.array(stime[second]))
        final = pa.array(np.take_along_axis(stime, np.maximum(last[:, -1:], 0), axis=1)[:, 0], mask=last[:, -1] < 0)
        utc = grid[:, 878:882].copy().view("<u4")[:, 0].astype(np.int64)
        return [pa.array(utc), marks, *ends(ptime, early, np.int64), *ends(tick, late, np.float64), final]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(a, _SLICE)
                batch = batch.filter(pc.fill_null(pc.equal(pc.binary_length(batch[data]), _PACKET), False))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *opened(batch[data].to_pylist())], schema.names)

    return science.select(*names, data).mapInArrow(run, schema)
