"""Sharding, the classifier and the pipeline's stages against plain Python; SQL of the corpus queries; skewed inputs."""

import glob
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkburst.llm import chat, common, line_rules, mixing, packing, quality, queries, sharding
from sparkburst.llm import wordhash as H

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, n_lines_removed string, component string"


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, DATA), duck.execute(queries.oracle_sql()[name])
    names, order = [c[0] for c in theirs.description], sorted(ours.columns)
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    # Plain values, not pandas columns, in which a long with nulls is a float on one side only.
    assert sorted(str(tuple(r[c] for c in order)) for r in ours.collect()) == sorted(str(tuple(r[k] for k in at)) for r in theirs.fetchall())


# ---- sharding ----------------------------------------------------------------------------------------------------------
def test_shards_by_plain_draws(spark):
    """The shard with the highest draw, and a real run with one shard more: rows stay or go to the new one."""
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(300)] + [(None, "x"), (None, None)], "doc_id long, text string")
    draws = docs.select("doc_id", *[F.xxhash64(F.lit(7), F.lit(s), "doc_id").alias(f"d{s}") for s in range(6)]).distinct().collect()
    best = {r.doc_id: max(range(5), key=lambda s: r[f"d{s}"]) for r in draws}
    more = {r.doc_id: max(range(6), key=lambda s: r[f"d{s}"]) for r in draws}
    rows = sharding.shard_rows(docs, shards=5, bucket_bytes=600).collect()
    assert len(rows) == 302 and all(r.shard == best[r.doc_id] and r.grown_shard == more[r.doc_id] for r in rows)
    assert all(more[k] in (best[k], 5) for k in best) and any(more[k] == 5 for k in best)
    grown = {r.doc_id: r.shard for r in sharding.shard_rows(docs, shards=6, bucket_bytes=600).collect()}
    assert grown == more


def test_equal_rows_of_a_megabyte_fill_buckets_evenly(spark):
    """Forty equal rows of a megabyte and many small ones: no bucket over twice its bytes."""
    rows = spark.range(400).select(F.when(F.col("id") < 40, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 40, F.repeat(F.lit("x"), F.lit(1 << 20))).otherwise("small").alias("text"))
    h = (common.row_hash(rows), common.row_hash(rows, 7))
    lots = sharding._in_lots(rows, h, F.octet_length("text") + 16, (4 << 20) // sharding.LOT_SHARE)
    assert lots.where("octet_length(text) > 10").agg(F.count("*"), F.max("__m")).first() == (40, 1)
    held = sharding.shard_rows(rows, shards=2, bucket_bytes=4 << 20)
    assert held.count() == 400 and held.select("shard", "slot").distinct().count() == 400
    placed = lots.withColumn("shard", sharding.shard_of(F.col("doc_id"), 2, 7)).withColumn("b", F.pmod(F.pmod(F.xxhash64(F.lit(8), "__h1", "__h2", F.lit(0).cast("long")), F.lit(10)) + F.col("__lot"), F.lit(10)))
    most = placed.groupBy("shard", "b").agg(F.sum((F.octet_length("text") + 16) * F.col("__m")).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * (4 << 20)


def test_buckets_are_permuted_by_fisher_yates(spark):
    """Each bucket is the seeded permutation of its rows in hash order; slots run on from bucket to bucket."""
    docs = spark.createDataFrame([(k, "word " * (k % 9)) for k in range(200)], "doc_id long, text string")
    hashed = docs.select("doc_id", "text", common.row_hash(docs).alias("a"), common.row_hash(docs, 7).alias("b")).withColumn("shard", sharding.shard_of(F.col("doc_id"), 3, 7))
    plain = hashed.withColumn("draw", F.xxhash64(F.lit(8), "a", "b", F.lit(0).cast("long"))).collect()
    want = {}
    for s in range(3):
        mine = [r for r in plain if r.shard == s]
        n = max(1, -(-sum(len(r.text) + 16 for r in mine) // 900))
        slot = 0
        for bucket in range(n):
            rows = sorted((r for r in mine if r.draw % n == bucket), key=lambda r: (r.a, r.b))
            for k in np.random.Generator(np.random.PCG64([7, s, bucket])).permutation(len(rows)):
                want[rows[k].doc_id] = (s, slot)
                slot += 1
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs, shards=3, bucket_bytes=900).collect()}
    assert got == want


def test_hot_shards_have_more_buckets(spark, monkeypatch):
    """Null keys and equal rows fill one shard, but no bucket goes far beyond its bytes; nothing is lost."""
    monkeypatch.setattr(sharding, "LOT", 10)
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("a"), F.lit(100))).otherwise(F.concat(F.repeat(F.lit("b"), F.lit(95)), F.col("id").cast("string"))).alias("text"))
    rows = sharding.shard_rows(docs, shards=4, bucket_bytes=20_000).select("shard", "slot", "text").collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(4000))
    assert Counter(r.text for r in rows)["a" * 100] == 2000
    first = [r.text[0] for r in sorted(rows, key=lambda r: r.slot)]
    assert 0.3 < first[:800].count("a") / 800 < 0.7  # equal rows are spread over the shard's buckets
    again = sharding.shard_rows(docs.repartition(3), shards=4, bucket_bytes=20_000).select("slot", "text").collect()
    assert {(r.slot, r.text) for r in again} == {(r.slot, r.text) for r in rows}


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    rows = sharding.shard_rows(docs, shards=3)
    sharding.write_shards(rows, f"{tmp_path}/out")
    assert sorted((r.doc_id, r.shard, r.slot) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted((r.doc_id, r.shard, r.slot) for r in rows.collect())


# ---- the classifier ----------------------------------------------------------------------------------------------------
def plain_features(text):
    """Counts of feature numbers of one text's words, marks and pairs, token by token."""
    data = (text or "").lower().encode()
    classes = H.byte_classes()
    tokens, k = [], 0
    while k < len(data):
        end = k
        while end < len(data) and classes[data[end]] == classes[data[k]]:
            end += 1
        if classes[data[k]] != H.SPACE:
            tokens.append(data[k:end])
        k = end
    hashed = [int(H.hash_spans(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tokens]
    hashed = [int(quality._REPEAT) if k and tokens[k] == tokens[k - 1] else h for k, h in enumerate(hashed)]
    pairs = [int(H.mix(np.array([(a * int(quality._PAIR) + b) % 2**64], np.uint64))[0]) for a, b in zip(hashed[:-1], hashed[1:], strict=True)]
    return Counter(h >> (64 - quality.BITS) for h in hashed + pairs)


def plain_scores(examples, texts):
    """Scores of texts by weights that plain updates learn from examples (label, text), in the order of the sample."""
    examples = [(label, plain_features(t)) for label, t in examples]
    z, n, alpha, beta, l1, l2 = defaultdict(float), defaultdict(float), 0.3, 1.0, 1e-4, 1e-3

    def weight(i):
        if i == "bias":
            return -z[i] * alpha / (beta + math.sqrt(n[i]))
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    def shares(f):
        total = max(1, sum(f.values()))
        return {**{i: float(np.float32(quality.GAIN * c / total)) for i, c in f.items()}, "bias": 1.0}

    for epoch in range(quality.EPOCHS):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(examples)):
            label, f = examples[k][0], shares(examples[k][1])
            w = {i: weight(i) for i in f}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in f.items())))
            for i, v in f.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g

    def score(text):
        f = plain_features(text)
        return 1 / (1 + math.exp(-quality.GAIN * sum(weight(i) * c for i, c in f.items()) / max(1, sum(f.values())) - weight("bias")))

    return [score(t) for t in texts]


def learnt(labels):
    """(doc_id, label) of the rows that may be learnt from, in the order of the sample."""
    kept = labels.where(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality", F.xxhash64(F.lit(11), "doc_id").alias("o")).collect()
    return [(r.doc_id, r.quality) for r in sorted(kept, key=lambda r: r.o)]


def test_updates_and_scores_by_plain_python(spark):
    rng = random.Random(4)
    good, bad = "the quiet river ran past old stone walls and green hills".split(), "buy now!!! $$$ click here win win win free".split()
    texts = [" ".join(rng.choices(good if k % 2 else bad, k=rng.randint(3, 40))) for k in range(40)] + ["", None, "çà et là, été!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(43)], "doc_id long, quality int")
    want = plain_scores([(label, texts[k]) for k, label in learnt(labels)], texts)
    for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-5)


def test_sample_is_bounded_however_ids_repeat(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)] * 50, "doc_id long, quality int")
    one = docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    assert np.array_equal(quality.fit_quality(docs, labels), quality.fit_quality(one, labels))


# ---- mixing and chat under skew ------------------------------------------------------------------------------------------
def test_large_ids_stay_whole_beside_null(spark):
    base = 2**53
    rows = [(base + 2 * k + 1, "word " * (k % 30 + 1), f"s{k % 2}") for k in range(50)] + [(None, "one two", "s0"), (None, "one two", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("extra", F.col("doc_id"))
    report = mixing.mixing_report(docs).collect()
    assert Counter(r.doc_id for r in report) == Counter(r[0] for r in rows)
    taken = mixing.mixed_documents(docs).collect()
    assert Counter(r.doc_id for r in taken) == Counter({k: n for k, n in ((k, sum(r.copies for r in report if r.doc_id == k)) for k in {r.doc_id for r in report}) if n})
    assert all(r.extra == r.doc_id for r in taken)


def test_rows_that_differ_in_other_columns_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", k % 5, b"x") for k in range(40)], "doc_id long, text string, source string, other int, raw binary")
    taken = mixing.mixed_documents(docs)
    assert taken.count() == sum(r.copies for r in mixing.mix_sources(docs).collect()) and taken.columns == docs.columns
    assert sorted(map(tuple, taken.collect())) == sorted(map(tuple, mixing.mixed_documents(docs.repartition(7)).collect()))


def test_equal_rows_are_dealt_in_lots(spark, monkeypatch):
    """Many equal rows fill many blocks; the source still ends at its target."""
    monkeypatch.setattr(mixing, "LOT", 7)
    monkeypatch.setattr(mixing, "BLOCK", 40)
    docs = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("three short words").alias("text"), F.when(F.col("id") < 2500, "a").otherwise("b").alias("source"))
    rows = mixing.mixing_report(docs).groupBy("target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in rows) == 3000 and all(abs(r.taken - r.target) <= 3 for r in rows)


@pytest.mark.parametrize("sizes, rate", [([5, 9, 9, 20, 1, 0, 7, 3, 3, 12, 40, 2], 0.4), ([6] * 9, 0.25), ([3, 1000, 1, 1, 2, 8], 0.7), ([4], 0.3), ([0, 0, 0, 0], 0.5)])
def test_chances_keep_their_means(sizes, rate):
    """Over many draws each document is taken as often as its chance says, within five standard errors."""
    draws, taken = 6000, np.zeros(len(sizes))
    for k in range(draws):
        rng = random.Random(k)
        flown = mixing.flight(sizes, [rate] * len(sizes), rng)
        assert sum(flown) == pytest.approx(rate * len(sizes)) and sum(a * b for a, b in zip(flown, sizes, strict=True)) == pytest.approx(rate * sum(sizes))
        assert sum(0 < p < 1 for p in flown) <= 2
        landed = mixing.landing(sizes, flown, rng)
        assert set(landed) <= {0.0, 1.0}
        taken += landed
    assert (np.abs(taken / draws - rate) < 5 * math.sqrt(rate * (1 - rate) / draws)).all()


def test_long_conversation(spark):
    """4,000 turns: windows hold every turn once as new, prefix sums respect ties and the budget."""
    rows = [(1, k // 2, ("user", "assistant")[k % 2], "w " * (k % 40)) for k in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df).first().windows
    new = [s for w in windows for s in w.spans if not s.repeated]
    assert len(new) == 4000
    for w in windows:
        cost = sum(len(words(w.formatted[s.start : s.start + s.length])) + chat.OVERHEAD for s in w.spans)
        assert cost <= chat.BUDGET or sum(not s.repeated for s in w.spans) == 1


def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE", 5000)
    kept = packing._Chunks(lambda t: list(range(len(t))))
    for k in range(1000):
        assert len(kept[f"chunk {k}"]) == 4 * len(f"chunk {k}")
        assert kept.held <= 5000 and kept.held == sum(packing._ENTRY + len(a) + len(b) for a, b in kept.items())
    assert len(kept["x" * 100]) == 400 and "x" * 100 not in kept


# ---- line rules ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("line, bad", [
    ("Alle Rechte vorbehalten.", True), ("Tous droits réservés", True), ("Todos los derechos reservados.", True), ("Privacy Policy", True),
    ("Der Fluss fließt an alten Mauern vorbei.", False), ("La rivière coule près des murs.", False), ("El río corre junto al muro.", False), ("The river runs past old walls.", False),
    ("12 345 678 901", True), ("Room 12", False), ("a | b | c", True), ("$$$ %%% ###", True), ("", False), ("   ", False),
])
def test_rules_of_one_line(spark, line, bad):
    assert spark.createDataFrame([(line,)], "t string").select(line_rules.line_fails(F.col("t")).alias("x")).first().x == bad


def test_menus_and_stock_lines(spark):
    menu = "Home\nNews\nWeather today\nSports\nContact us"
    prose = lambda k: f"This is sentence number {k} of a text that is long enough to be judged by all of the rules here.\nAnother {k} follows it, with words of its own, and it ends as a sentence does."
    rows = [(k, f"{prose(k)}\nShare this page with friends\nLast words {k} of this text.") for k in range(12)] + [(50, f"{menu}\n{prose(50)}"), (51, f"Home\nNews\n{prose(51)}"), (52, f"{prose(52)}\nShare this page with friends of {52}")]
    rows += [(60 + k, f"{prose(60)}\nA copied line without an end") for k in range(30)]  # copies are one text
    got = {r.doc_id: r.cleaned_text.split("\n") for r in line_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Share this page with friends" not in got[k] and len(got[k]) == 3 for k in range(12))
    assert got[50] == prose(50).split("\n") and got[51] == ["Home", "News", *prose(51).split("\n")] and len(got[52]) == 3 and len(got[60]) == 3


def test_stock_lines_at_two_sizes(spark, monkeypatch):
    """A line of ten texts goes beside 40 other texts and beside 2,000, whether its hash is compared in place or joined."""
    prose = lambda k: f"This is sentence number {k} of a text that is long enough to be judged by all of the rules here."
    for others, few in ((40, 2000), (2000, 2000), (40, 0)):
        monkeypatch.setattr(line_rules, "FEW_STOCK", few)
        rows = [(k, f"{prose(k)}\nShare this page with friends\n\n{prose(-k)}\nRead it again later") for k in range(10)]
        rows += [(k, f"{prose(k)}\nOwn words of text {k}\nRead it once") for k in range(10, 10 + others)] + [(-1, None), (-2, "")]
        got = {r.doc_id: r.cleaned_text for r in line_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert len(got) == len(rows) and got[-1] == got[-2] == ""
        assert all(got[k] == f"{prose(k)}\n\n{prose(-k)}" for k in range(10))
        assert all(got[k] == f"{prose(k)}\nOwn words of text {k}" for k in range(10, 10 + others))


# ---- the pipeline --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) for _ in range(n))
    rows = [(k, f"{say(30)}.\n{say(12)}.\n{say(20)}.", "en", f"s{k % 3}") for k in range(40)]
    rows += [(100 + k, rows[k][1], "en", "s0") for k in range(5)] + [(200 + k, rows[k][1].replace(".\n", ".\nx" + "y" * k + " "), None, None) for k in range(5)]
    rows += [(7, rows[7][1], "en", "s1"), (None, rows[8][1], "en", "s1"), (None, None, None, None), (300, None, "en", "s2"), (301, "", None, "s2"), (302, "\n \n", "en", None), (2**53 + 1, say(4000), "en", "s0"), (2**53 + 3, say(9) + ".", "en", "s1")]
    return spark.createDataFrame([(a, b, c, d, None if b is None else len(b), 5, "mine", "y") for a, b, c, d in rows], DOCS).cache()


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows and clashing columns, against plain Python; then on no rows."""
    import corpus_pipeline as P

    labels = spark.createDataFrame([(k, 1) for k in range(0, 40, 2)] + [(k, 0) for k in range(1, 40, 2)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(P.STAGES)
    rows = lambda df: sorted(map(str, df.collect()))
    given = odd.collect()
    by_id = {r.doc_id: r.text for r in given}
    scores = plain_scores([(label, by_id[k]) for k, label in learnt(labels)], [r.text for r in given])
    first = stages["quality classifier"](spark, odd, str(tmp_path))
    assert min(abs(x - quality.THRESHOLD) for x in scores) > 1e-5  # so that rounding decides nothing
    assert first.columns == odd.columns and rows(first) == sorted(str(r) for r, x in zip(given, scores, strict=True) if x >= quality.THRESHOLD)

    second = stages["line dedup"](spark, odd, str(tmp_path))
    assert second.columns == odd.columns and second.count() == odd.count() and {r.n_lines_removed for r in second.collect()} == {"mine"}
    order = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    seen, want = [], []
    for r in order:
        lines, left = [] if r.text is None else r.text.split("\n"), []
        for k, line in enumerate(lines):
            s = frozenset(words(line))
            if not s or not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o, place in seen if place != (r.doc_id, r.text, k)):
                left.append(line)
            seen.append((s, (r.doc_id, r.text, k)))
        want.append((r.doc_id, None if r.text is None else "\n".join(left)))
    got = [(r.doc_id, r.text) for r in second.collect()]
    assert Counter(got) == Counter(want) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in second.collect())

    third = stages["simhash near-dedup"](spark, odd, str(tmp_path))
    shingles = lambda t: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words((t or "").lower())) else frozenset()
    docs = [(r.doc_id, r.text, shingles(r.text)) for r in order]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = docs[i][2], docs[j][2]
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b) > 0:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, d in zip(group, docs, strict=True):
        best.setdefault(g, []).append(d)
    kept = Counter((r.doc_id, r.text) for r in third.collect())
    assert third.columns == odd.columns and sum(kept.values()) == len(best) and all(n == 1 for n in kept.values())
    for members in best.values():
        ids = [d[0] for d in members if d[0] is not None]
        here = [k for k in kept if any(k == d[:2] for d in members)]
        assert len(here) == 1 and (here[0][0] == min(ids) if ids and None not in [d[0] for d in members] else True)

    fourth = stages["source mixing"](spark, odd, str(tmp_path))
    assert fourth.columns == odd.columns
    taken, weight = Counter(fourth.collect()), dict(zip(["s0", "s1", "s2", None], [3, 1, 2, 3], strict=True))
    most = {s: 2 * sum(len(words(r.text or "")) for r in given if r.source == s) for s in weight}
    goal, open_ = {}, set(weight)
    while open_:  # the share of what is left, until no source is above its most
        left, parts = 0.75 * sum(most.values()) - sum(goal.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / parts > most[s]} or open_
        goal.update({s: min(most[s], left * weight[s] / parts) for s in full})
        open_ -= full
    sizes = {r: len(words(r.text or "")) for r in given}
    assert set(taken) <= set(given) and all(n <= 2 * given.count(r) for r, n in taken.items())
    for s in weight:
        assert abs(sum(sizes[r] * n for r, n in taken.items() if r.source == s) - goal[s]) <= max(sizes[r] for r in given if r.source == s)

    fifth = stages["best-fit packing"](spark, odd, str(tmp_path)).collect()
    spans = defaultdict(list)
    for r in fifth:
        spans[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 2048 and [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] for s in spans.values())
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want, lengths = Counter(), []
    for r in given:
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 0]
        ends = list(range(len(ids), 0, -2048))[::-1]
        for piece, (low, high) in enumerate(zip([0, *ends], ends, strict=False)):
            want[r.doc_id, piece, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())] += 1
            lengths.append(high - low)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in fifth) == want
    assert -(-sum(lengths) // 2048) <= len(spans) <= -(-sum(lengths) // 2048) + 1

    for name, stage in P.STAGES:
        out = stage(spark, odd.where("false"), str(tmp_path))
        assert out.count() == 0, name
        assert name == "best-fit packing" or out.columns == odd.columns


def test_run_equals_its_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in P.STAGES:
        docs = common.stored(stage(spark, docs, DATA))
    assert sorted(map(str, P.run(spark, DATA).collect())) == sorted(map(str, docs.collect())) and docs.count() > 0
