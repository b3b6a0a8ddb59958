"""Links among lines against all pairs by brute force."""

from __future__ import annotations

import random

import pytest
from sparkburst.llm import common, line_links


@pytest.mark.parametrize("block, few", [(4096, 20_000), (7, 20_000), (7, 0)])
def test_no_link_is_lost(spark, monkeypatch, block, few):
    """Whole lists, lists dealt by a broadcast table of long ones, and by a shuffled one."""
    monkeypatch.setattr(line_links, "BLOCK", block)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    rng = random.Random(11)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    rows = [(k, "\n".join(" ".join([*base, f"tail{k}", *rng.sample(base, 2)]) for _ in range(2))) for k in range(50)]  # one large group
    for k in range(100, 140):
        rows.append((k, "\n".join(" ".join(f"w{rng.randrange(12)}" for _ in range(rng.choice((3, 10, 14)))) for _ in range(4))))
    rows += [(200, None), (201, " \n\t"), (None, " ".join(base)), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {(i, n): frozenset(s.split()) for i, t in rows for n, s in enumerate((t or "").split("\n")) if s.split()}
    sets = set(lines.values())
    links = {s: {o for o in sets if o != s and 5 * len(s & o) >= 4 * len(s | o)} for s in sets}
    got = {(r.doc_id, r.line): r for r in line_links.line_links_report(docs).collect()}
    assert got.keys() == lines.keys()
    assert {p: r.n_links for p, r in got.items()} == {p: len(links[s]) for p, s in lines.items()}
    assert max(r.n_links for r in got.values()) >= 49
    named = {}
    for p, s in lines.items():
        assert named.setdefault(s, got[p].set_id) == got[p].set_id
    assert len(set(named.values())) == len(sets)
    for s in sets:
        reach, todo = {s}, [s]
        while todo:
            for o in links[todo.pop()] - reach:
                reach.add(o)
                todo.append(o)
        assert {r.class_id for p, r in got.items() if lines[p] == s} == {min(named[o] for o in reach)}


def test_empty_tables_and_texts(spark):
    for rows in ([], [(1, None), (None, ""), (2, " \n ")]):
        links, members = line_links.line_links(spark.createDataFrame(rows, "doc_id long, text string"))
        assert links.count() == 0 and members.count() == 0
