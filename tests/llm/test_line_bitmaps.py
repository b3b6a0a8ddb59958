"""The wide parity bitmaps of long lines, held against plain sets."""

from __future__ import annotations

import random

import numpy as np

from sparkburst.llm.line_dedup import _WIDE, _Lines


def test_wide_bitmaps_never_exceed_the_symmetric_difference():
    rng = random.Random(7)
    base = [f"w{n}" for n in range(300)]
    lines = [rng.sample(base, rng.choice([3, _WIDE - 1, _WIDE, 120, 250])) for _ in range(40)]
    lines.append([*lines[0], "extra"])
    text = "\n".join(" ".join(x) for x in lines).encode()
    found = _Lines([text], np.ones(1 << 22, np.uint8))
    assert found.size.tolist() == [len(x) for x in lines]
    parts = found.wide(found.size >= _WIDE).view(np.uint64)
    narrow = found.size < _WIDE
    assert not parts[:, narrow].any() and parts[:, ~narrow].any()
    bits = found.bits.view(np.uint64)
    whole = [*parts, bits ^ parts[0] ^ parts[1] ^ parts[2]]
    for i in np.flatnonzero(~narrow):
        for j in np.flatnonzero(~narrow):
            apart = sum(int(np.bitwise_count(w[i] ^ w[j])) for w in whole)
            truly = len(set(lines[i]) ^ set(lines[j]))
            assert int(np.bitwise_count(bits[i] ^ bits[j])) <= apart <= truly


def test_wide_bitmaps_of_texts_without_words():
    found = _Lines([b"", b" \n\t"], np.ones(1 << 22, np.uint8))
    assert found.wide(found.size >= _WIDE).shape == (3, 0)
