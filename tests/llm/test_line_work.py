"""What line dedup moves and reads again: packed prefixes, postings without empty bitmaps, only the lines that pairs name."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkburst.llm import line_dedup as L
from sparkburst.llm import wordhash as H

RARE = np.ones(1 << 22, np.uint8)


@pytest.mark.parametrize("text", [b"", b"\n", b"one\n", b" \t one\x0btwo\x0c\r\n\n", b"\x08\x0e\x1f\x21 \xc2\x85\xff\n", b"a  b\n\nc \n"])
def test_words_are_the_runs_outside_white_space(text):
    starts, ends = H.words(np.frombuffer(text, np.uint8))
    assert [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == text.split()


def test_only_asked_lines_are_taken_apart():
    texts, ids = [b"a b\n\nc", b"", b"d\ne\n"], np.array([7, L._NULL_ID, -3])
    places = [(i, k, x) for i, t in zip(ids.tolist(), texts, strict=True) for k, x in enumerate(t.split(b"\n"))]
    at = L._place(np.array([i for i, _, _ in places]), np.array([k for _, k, _ in places], np.int32))
    for asked in ([], [0], [2, 3], [4, 5], list(range(len(places)))):
        need = np.zeros(1 << L._NEED_BITS, bool)
        need[at[asked] & ((1 << L._NEED_BITS) - 1)] = True
        assert L._asked_lines(texts, ids, np.packbits(need, bitorder="little")) == [places[k][2] for k in asked]


@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [L._NULL_ID, -5, 0, 1 << 62]])
@pytest.mark.parametrize("repeated", [False, True])
def test_lists_are_in_order_and_hold_a_set_once(ids, repeated):
    rng = random.Random(5)
    line_of = lambda d, n: (d * 31 + n) % 40 if not repeated else rng.randrange(40)
    rows = [(rng.randrange(1 << 32) if k % 3 else k % 7 << 29, d := rng.choice(ids), n := rng.randrange(9), line_of(d, n) - 20) for k in range(800)]
    token, doc, line, sid = (np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64, np.int64), strict=True))
    want, seen = [], set()
    for row in sorted(rows):
        if (row[0], row[3]) not in seen:
            seen.add((row[0], row[3]))
            want.append(row)
    order = L._list_order(token, doc, line, sid)
    assert list(zip(*(c[order].tolist() for c in (token, doc, line, sid)), strict=True)) == want


def test_postings_carry_wide_bitmaps_only_where_sets_are_wide():
    text = "\n".join([" ".join(f"s{k}" for k in range(10)), " ".join(f"w{k}" for k in range(100))])
    docs = pa.RecordBatch.from_pydict({"doc_id": [5], "text_hash": [9], "text": [text]})

    class Docs:
        def mapInArrow(self, run, schema):
            assert "prefix binary" in schema
            return list(run(iter([docs])))

    rarity = type("Shared", (), {"value": RARE})
    (lines,) = L.line_sets(Docs(), rarity, L.MIN_JACCARD, packed=True)
    posts, lengths = L._posts(lines["prefix"])
    assert lengths.tolist() == [3, 21] and ((posts >> 16) & 0xFFFF).tolist() == [10] * 3 + [100] * 21
    lines = lines.append_column("probe", pa.array([True, True]))
    rows = pa.Table.from_batches(L._postings(1)(iter([lines])))
    assert sum(map(len, rows["data"].to_pylist())) == 24 * 6 * 8 and sum(map(len, rows["wide"].to_pylist())) == 21 * 3 * 8


def test_repeated_and_extreme_ids(spark):
    """Places name lines to read again, so rows that share an id or have the smallest one must not lose matches."""
    line = " ".join(f"w{k}" for k in range(20))
    near = [f"{line} x{k}" for k in range(4)]
    rows = [(L._NULL_ID, f"alone\n{near[0]}"), (None, f"{near[1]}\nother words"), (3, near[2]), (3, f"first here\n{near[3]}"), (3, near[2])]
    got = sorted((r.doc_id or 0, r.line) for r in L.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(L._NULL_ID, 1), (3, 0), (3, 1)]
    cleaned = [(r.text, r.n_lines_removed) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(cleaned) == sorted([("alone", 1), (rows[1][1], 0), ("", 1), ("first here", 1), ("", 1)])
