"""64-bit word hashes of many texts at once, with numpy inside a task."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE, WORD, MARK = 0, 1, 2


def byte_classes() -> np.ndarray:
    """Class of each byte: white space, part of a word (letters, digits, all non-ASCII), or a mark."""
    out = np.full(256, MARK, np.uint8)
    out[128:] = WORD
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        out[ord(a) : ord(b) + 1] = WORD
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    return out


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        row = np.full(max(n, 1 << 19), base, np.uint64)
        row[0] = 1
        _powers[base] = np.cumprod(row, dtype=np.uint64)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts[i]:ends[i]] (bytes): differences of one running polynomial sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    sums = total[1:]
    sums[:] = data
    sums += np.uint64(1)
    sums *= _power(_MULTIPLIER, len(data))
    np.cumsum(sums, out=sums)
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts])


def spans(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class other than SPACE."""
    if not len(classes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(classes)) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(classes)]))
    kept = classes[starts] != SPACE
    return starts[kept], ends[kept]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside white space; data (bytes) is empty or ends in white space."""
    solid = (data - np.uint8(0x09) > 4) & (data != 0x20)
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def chunks(sizes: list[int], most: int = 1 << 19):
    """Slices of consecutive items of about `most` bytes together; a larger item is alone."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if begin < len(sizes):
        yield begin, len(sizes)
