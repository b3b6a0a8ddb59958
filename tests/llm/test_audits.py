"""License scan, vector codes and source audit against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkburst.llm import code_books, divergence, license_scan, terms
from sparkburst.llm.license_scan import Template

DOCS = "doc_id long, text string, lang string, source string, n_words string, licenses int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- license scan ----


def plain_scan(text, templates):
    """Every block against every template, without any filter."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    out = []
    for k, t in enumerate(templates):
        own = [w.decode() for w in t.words]
        step = license_scan.stride_of(len(own))
        if t.in_a_row:
            out += [(k, t.label, t.base, p, len(own), 1.0) for p in range(len(words) - len(own) + 1) if words[p : p + len(own)] == own]
            continue
        for a in range(0, len(words), step):
            share = len(set(words[a : a + 2 * step]) & set(own)) / len(set(own))
            if share >= t.containment - 1e-12:
                out.append((k, t.label, t.base, a, len(words[a : a + 2 * step]), share))
    return len(words), sorted(out)


def license_texts():
    rng = random.Random(3)
    pool = sorted({w.decode() for t in license_scan.TEMPLATES for w in t.words}) + ["other", "straße", "naïve"]
    notice = license_scan.NOTICES[0][0].split()
    texts = [None, "", " \n\t ", "MIT", "Released under the MIT\n License. mit-license, MIT  LICENSE", "CC BY-NC 4.0 and cc by", "submit license", "apache license apache license version 2.0"]
    texts += [" ".join(rng.choices(pool, k=n)) for n in (3, 40, 300, 900)]
    for lost in (0, 10, 14, 20, 40):  # words of a notice replaced
        texts.append("x " * rng.randrange(300) + " ".join(w if rng.random() > lost / 60 else "y" for w in notice) + " z" * rng.randrange(200))
    for gap in range(0, 130, 13):
        texts.append("a " * gap + " ".join(notice) + " b GNU General, Public\tLicense version 3")
    return texts


def test_license_scan(spark):
    texts = license_texts()
    rows = [(k if k % 7 else None, t, None, None, "own", 5) for k, t in enumerate(texts)] * 2
    found = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    got = Counter((r["doc_id"], r["text"], r["n_words"], tuple(sorted(map(tuple, r["licenses"])))) for r in found)
    want = Counter()
    for k, t, *_ in rows:
        n, matches = plain_scan(t, license_scan.TEMPLATES)
        want[(k, t, n, tuple(matches))] += 1
    assert got == want
    assert any(m["label"] == "mit" and not m["base"] for r in found for m in r["licenses"])


def test_license_thresholds_and_report(spark):
    templates = [Template("one two three four five", "five", 0.6), Template("one two", "pair", 1.0, True, True), Template("", "none"), Template("...", "none")]
    df = spark.createDataFrame([(1, "five four three"), (2, "one four"), (3, "three one two one two"), (3, None)], "doc_id long, text string")
    got = [tuple(r) for r in license_scan.license_report(df, templates).orderBy("doc_id", "n_words").collect()]
    assert got == [(1, 3, 0, None, None, "", "five", 0.6), (2, 2, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (3, 5, 2, 1, 3, "pair", "five,pair", 1.0)]
    assert license_scan.license_report(df.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in license_scan.license_report(df, []).where("doc_id = 1").collect()] == [(3, 0, None, None, "", "", 0.0)]
    with pytest.raises(ValueError):
        license_scan.scan_licenses(df, [Template("w " * (license_scan.TEMPLATE_WORDS + 1), "big")])


def test_text_in_pieces():
    table = terms.term_table(True)
    for text in (None, "", "abc", "a b " * 50, "x" * 99, "Ab9é  ΩÖ;c" * 30):
        whole = [w for p in terms.term_pieces(text, table) for w in p]
        for most in (1, 2, 7, 64):
            assert [w for p in terms.term_pieces(text, table, most) for w in p] == whole
        assert [w.decode() for w in whole] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def test_license_index_orders_by_rarity():
    index = license_scan._Index([Template("common rare common middle", "x", 0.7)], {b"common": 100, b"middle": 10, b"rare": 1})
    assert [index.rank[w] for w in (b"rare", b"middle", b"common")] == [0, 1, 2]
    assert index.needed == [3] and set(index.prefix) == {0}  # all three words are needed: one is the prefix
    assert index.matches(np.array([2, 1, 0, 2], np.int32))[0]["containment"] == 1.0
    assert index.matches(np.array([2, 1, -1, 2], np.int32)) == []


# ---- vector codes ----


def plain_codes(vectors, parts=4, entries=256, rounds=4, scale=1024):
    """Lloyd rounds with every distance, in Python integers."""
    width = max((len(v) for v in vectors), default=0)
    width = -(-width // parts) if width else 0
    ints = [[math.floor(scale * x) for x in v] + [0] * (width * parts - len(v)) for v in vectors]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p):
        out = []
        for v in cut:
            d = [sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            near = nearest(p)
            for e in range(len(books[p])):
                mine = [v[p] for v, (k, _) in zip(cut, near, strict=True) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    near = [nearest(p) for p in range(parts)]
    return books, [[near[p][k][0] for p in range(parts)] for k in range(len(cut))], [sum(near[p][k][1] for p in range(parts)) for k in range(len(cut))]


VECTORS = "vec_id long, embedding array<float>, label int, code string, near string"


def test_vector_codes(spark):
    rng = np.random.default_rng(5)
    middles = rng.integers(-2, 3, (9, 8))
    vectors = [(middles[rng.integers(9)] / 4 + rng.integers(-3, 4, 8) / 512).astype(np.float32).tolist() for _ in range(400)]
    vectors[300:340] = [vectors[7]] * 40  # copies
    vectors[340:350] = [[0.0] * 8] * 10
    ids = [k // 2 for k in range(400)]  # each id twice
    bad = [None, [float("nan")] + [0.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7]
    rows = [(i, v, k % 3 if k % 5 else None, "own", "own") for k, (i, v) in enumerate(zip(ids, vectors, strict=True))] + [(-1, v, 1, None, None) for v in bad]
    got = code_books.codes_report(spark.createDataFrame(rows, VECTORS), entries=64).collect()
    ordered = sorted(range(400), key=lambda k: (ids[k], [math.floor(1024 * x) for x in vectors[k]]))
    books, codes, errors = plain_codes([vectors[k] for k in ordered], entries=64)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    labels = [rows[k][2] for k in ordered]
    want = Counter((ids[k], "".join(f"{x:02x}" for x in c), e, sum(y for x, y in zip(labels, errors, strict=True) if x == label), digest) for k, c, e, label in zip(ordered, codes, errors, labels, strict=True))
    assert Counter(map(tuple, got)) == want


def test_vector_codes_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert code_books.codes_report(frame([])).count() == 0
    assert code_books.codes_report(frame([(1, None, None)])).count() == 0
    short = frame([(2, [1.0, -0.0001], "a"), (1, [0.5, 0.25, 3.0, 1.0, 9.0], "a"), (None, [], None), (3, [1.0], None)])
    got = {r["vec_id"]: tuple(r)[1:4] for r in code_books.codes_report(short).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010100", 0, 0), 3: ("02010100", 0, 0), None: ("03010100", 0, 0)}  # equal parts go to the lower index
    assert code_books.codes_report(frame([(1, [], None)])).first()["code"] == "00000000"
    with pytest.raises(ValueError):
        code_books.codes_report(frame([(1, [1e12], None)]))
    codes, books = code_books.compress_vectors(short)
    row = codes.where("vec_id = 1").first()
    assert code_books.restored(row["near"], books).tolist()[:5] == [512, 256, 3072, 1024, 9216]


@pytest.mark.parametrize("size", [4, 1 << 24])
def test_group_bounds_skip_and_stay_exact(size):
    """Rounds with kept bounds give what full scans give, ties included, and compute fewer distances; size reaches both sums."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-40, 40, (60, 4))
    x = (middles[rng.integers(60, size=3000)] + rng.integers(-2, 3, (3000, 4))) * size
    book = x[:64].copy()
    groups = code_books.entry_groups(book)
    near, lower, drift, work = np.zeros(len(x), np.int64), np.zeros((len(x), len(groups))), np.zeros(len(groups)), []
    for _ in range(5):
        near, best, lower, n = code_books.assign(x, book, groups, near, lower, drift)
        full = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
        assert (near == full.argmin(1)).all() and (best == full.min(1)).all()
        for g, members in enumerate(groups):
            others = np.where(members[None, :] == near[:, None], np.inf, full[:, members]).min(1)
            assert (lower[:, g] <= np.sqrt(others)).all()
        lower = code_books._unpacked(code_books._packed(lower))
        work.append(n)
        new = book.copy()
        for e in range(len(book)):
            if (near == e).any():
                new[e] = x[near == e].sum(0) // (near == e).sum()
        drift = np.array([np.sqrt(((new[m] - book[m]) ** 2).sum(1).max()) for m in groups])
        book = new
    assert work[0] == len(x) * 65 and work[-1] < work[0] / 3


# ---- source audit ----


def plain_audit(rows, min_docs):
    docs = [tuple(x or "" for x in r) for r in rows]
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(words(d[2])))
        kept = sorted(w for w in df if df[w] >= min_docs)
        counts = {s: Counter(w for d in mine if d[1] == s for w in words(d[2]) if df[w] >= min_docs) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, w) - share(o, w)) for w in kept), t) for t, o in counts.items() if t != s]
            over = [(share(whole, w) - share(c, w), w) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", over, 50)):
                out += [(lang, s, part, t, -v, k + 1) for k, (v, t) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def audit_rows():
    rng = random.Random(11)
    vocabulary = ["a", "b", "Straße", "ß", "zz", "𝒳", "é", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None, "Ä"]), " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for _ in range(300)]
    return rows + [("en", "empty", None), ("fr", "x", "only one"), ("fr", "y", ""), ("en", "s1", "same same")] + [("en", "s1", "copy B,b-b9B\x00ß")] * 9


@pytest.mark.parametrize("shape", [{}, {"block": 2, "chunk": 3, "stripe": 1}, {"block": 3, "chunk": 4, "stripe": 2}])
def test_source_audit(spark, shape):
    rows = audit_rows()
    df = spark.createDataFrame([(1, *r, 7, "own") for r in rows], "doc_id int, lang string, source string, text string, value int, rank string").repartition(5)
    got = sorted(map(tuple, divergence.divergence_report(df, min_docs=9, **shape).collect()))
    assert got == plain_audit(rows, 9)


def test_source_audit_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence_report(empty).count() == 0
    df = spark.createDataFrame([("en", "a", "x"), ("en", "b", None), (None, None, None)], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.divergence_report(df).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact(spark):
    cases = [(0, 1 << 40), (10**12, 10**12 + 7), (3, 11), (10**13, 10**15 + 1), (0, 5)]
    want = [1 + 10**9 * (n + 5) // t for n, t in cases]
    assert [int(divergence.share(np.array([n]), t)[0]) for n, t in cases] == want
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, n long, t long")
    assert [r[0] for r in df.orderBy("k").select(divergence.share_column(df.n, df.t)).collect()] == want


def test_steps_count_long_texts_alike(monkeypatch):
    batch = pa.RecordBatch.from_pylist([{"lang": k, "text": t} for k, t in [("e", "a b a"), ("d", None), ("e", "b " * 40), ("e", "c A"), ("d", "ß" * 30)]])
    counted = lambda: sum((Counter({(r["lang"], r["term"], c): r[c]}) for b in divergence._in_langs(iter([batch])) for r in b.to_pylist() for c in ("n", "docs")), Counter())
    whole = counted()
    assert whole[("e", "a", "n")] == 3 and whole[("e", "b", "docs")] == 2
    for step in (1, 6, 50):
        monkeypatch.setattr(divergence, "STEP", step)
        assert counted() == whole
