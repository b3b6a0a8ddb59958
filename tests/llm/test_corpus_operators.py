"""Corpus operators against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkburst.llm import chat, embed_dedup, line_dedup, line_rules, mixing, packing, quality, sharding, simhash, url_filter
from sparkburst.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score int, component string"
DATA = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) + rng.choice(("", "", ",", ".")) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity; extra columns clash with output names."""
    rng = random.Random(3)
    texts = [None, "", "   \n\t ", "one", "one two", prose(rng, 30), prose(rng, 9000), "\n".join(prose(rng, 12) for _ in range(40))]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s1"), (5, texts[5], "en", "s1"), (5, "other text of the same id", None, "s0"), (None, "no id here", "en", "s2"), (None, None, None, None)]
    rows += [(100 + k, prose(rng, rng.randint(1, 80)), "en", f"s{k % 5}") for k in range(60)]
    rows += [(200 + k, texts[7].replace("beta", "BETA", k), "en", "s0") for k in range(6)]
    return spark.createDataFrame([(a, b, c, d, None if b is None else len(b), "x", 1, "y") for a, b, c, d in rows], DOCS).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def test_sharding(odd, none, spark):
    rows = sharding.shard_rows(odd, shards=4, bucket_bytes=2000).toPandas()
    assert len(rows) == odd.count() and "component" in rows
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = rows[rows.grown_shard != rows.shard]
    assert (moved.grown_shard == 4).all()
    again = sharding.shard_rows(odd.repartition(3), shards=4, bucket_bytes=2000).toPandas()
    key = ["shard", "slot"]
    assert rows.sort_values(key).text.fillna("").tolist() == again.sort_values(key).text.fillna("").tolist()
    report = {r.doc_id: r for r in sharding.sharding_report(odd.where("doc_id = 7")).collect()}
    text = odd.where("doc_id = 7").first().text.encode()
    assert report[7].text_crc32 == zlib.crc32(text) and report[7]["size"] == len(text) + 16
    assert sharding.shard_rows(none).count() == 0


def test_quality_learns_and_scores_all(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_report(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").toPandas()
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and (rows.predicted == rows.quality).mean() > 0.85
    weights = quality.fit_quality(odd, spark.createDataFrame([(None, 1), (7, None), (7, 1), (7, 0), (6, 0)], "doc_id long, quality int"))
    scored = quality.score_quality(odd, weights)
    assert scored.count() == odd.count() and scored.where("score is null").count() == 0
    empty = quality.fit_quality(none, labels)
    assert {r.score for r in quality.score_quality(odd, empty).collect()} == {0.5} and quality.score_quality(none, empty).count() == 0


def test_quality_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit_quality(docs, labels), quality.fit_quality(docs, flipped))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(base)]
    rows += [(100 + k, [float(x) for x in base[k] + 0.02 * rng.standard_normal(16)], k % 3) for k in range(20)]
    rows += [(200 + k, rows[0][1], 0) for k in range(30)]  # copies
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None] + [1.0] * 15, 0), (305, [float("inf")] * 16, 0), (306, rows[0][1], None), (307, [1.0] * 8, 1), (None, rows[1][1], 1), (5, rows[5][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("x"))
    got = embed_dedup.embedding_links(df, fit_rows=30)
    assert got.count() == len(rows)
    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = Counter()
    for i, a in enumerate(ok):
        for j, b in enumerate(ok):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                links[i] += x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93
    assert sum(r.n_links for r in got.collect()) == sum(links.values())
    by = {r.vec_id: r for r in got.collect()}
    assert by[200].component_id == 0 and not by[200].kept and by[300].n_links == 0 and by[300].kept and by[306].component_id == 306
    assert embed_dedup.embedding_links(df.where("false")).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    """Buckets larger than a block are dealt as pairs of blocks, without losing or repeating a pair."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(k, [float(x) for x in centre + 0.01 * rng.standard_normal(16)], 1) for k in range(100)]
    got = embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.n_links for r in got} == {99} and {r.component_id for r in got} == {0}


def test_line_rules(odd, none):
    got = line_rules.clean_lines(odd).toPandas()
    assert len(got) == odd.count() and "source" in got
    for r in got.itertuples():
        w = words(r.text)
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        cover = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert line_rules.clean_lines(none).count() == 0


def test_line_rules_remove_lines_first(spark):
    good = "This is a plain line of text, and it is long enough to be kept by every rule of the list."
    other = "Another line says something else, so that no window of words is found twice in here."
    rows = [(1, f"{good}\nAll rights reserved.\nHome | News | Sport | About\n$$$ *** ### %%%\n{other}"), (2, "Home | News | Sport | About | Home | News | Sport | Contact | Help | Terms | Privacy\n" + good)]
    got = {r.doc_id: r for r in line_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].cleaned_text.split("\n") == [good, other] and got[1].kept
    assert got[2].cleaned_text == good


def test_mixing(odd, none, spark):
    rows = mixing.mix_sources(odd).toPandas()
    assert len(rows) == odd.count()
    again = mixing.mix_sources(odd.repartition(5)).toPandas()
    key = ["doc_id", "size", "copies", "source"]
    assert rows[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()
    sizes = {k: int(v) for k, v in rows.assign(source=rows.source.fillna("~")).groupby("source")["size"].sum().items()}
    names, weigh = sorted(sizes), {}
    for k, s in enumerate(names):
        weigh[s] = (3, 1, 2)[k % 3]
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weigh[s] / sum(weigh[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        for s in over or list(open_):
            target[s] = 2 * sizes[s] if over else share[s]
            left -= target[s]
            open_.discard(s)
    for s, g in rows.assign(source=rows.source.fillna("~")).groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s]) and (g.copies <= 2).all()
        assert abs((g["size"] * g.copies).sum() - target[s]) <= g["size"].max()
    assert mixing.mix_sources(none).count() == 0
    taken = mixing.mixed_documents(odd)
    assert taken.columns == odd.columns and taken.count() == rows.copies.sum()


def test_flight_keeps_totals():
    rng = random.Random(5)
    sizes, chances = [rng.randint(0, 500) for _ in range(400)], [rng.random() for _ in range(400)]
    out = mixing.flight(sizes, chances, rng)
    assert sum(out) == pytest.approx(sum(chances)) and sum(a * b for a, b in zip(out, sizes)) == pytest.approx(sum(a * b for a, b in zip(chances, sizes)))
    assert sum(0 < p < 1 for p in out) <= 2
    assert set(mixing.landing(sizes, out, rng)) <= {0.0, 1.0}


def test_packing(odd, none, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    extra = spark.createDataFrame([(900, "a  b\n c\t d\u00a0e <|endoftext|> x", None, None, None, None, None, None), (901, " lead and trail ", None, None, None, None, None, None)], DOCS)
    docs = odd.unionByName(extra)
    rows = packing.packing_report(docs).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        stop, piece = len(ids) - (-(-len(ids) // 2048) - 1) * 2048, 0
        begin = 0
        while begin < len(ids):
            want[(-1 if r.doc_id is None else r.doc_id, piece, begin, stop - begin, zlib.crc32(np.array(ids[begin:stop], "<u4").tobytes()))] += 1
            begin, stop, piece = stop, stop + 2048, piece + 1
    got = Counter((int(a), int(b), int(c), int(d), int(e)) for a, b, c, d, e in rows.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].values)
    assert got == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.packing_report(none).count() == 0


def test_plan_matches_one_bin_at_a_time():
    rng = random.Random(2)
    counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 20), 7]) for _ in range(600))
    left, bins = Counter(counts), 0
    while left:
        gap, used = 100, []
        while fit := [n for n in left if left[n] > used.count(n) and n <= gap]:
            used.append(max(fit))
            gap -= used[-1]
        small = min(used)
        free = [n for n in left if left[n] > used.count(n)]
        pairs = [(a + b, a, b) for a in free for b in free if b <= a and a + b <= gap + small and (a != b or left[a] - used.count(a) >= 2)]
        if gap and pairs and max(pairs)[0] > small:
            used.remove(small)
            used += max(pairs)[1:]
        for n in used:
            left[n] -= 1
        left, bins = +left, bins + 1
    plan = packing.plan_bins(counts, 100)
    assert sum(t for _, t, _ in plan) <= bins + 2
    packed = Counter()
    for _, t, used in plan:
        assert sum(n * c for n, c in used.items()) <= 100
        packed.update({n: c * t for n, c in used.items()})
    assert packed == counts


def test_sequences(odd):
    packed = packing.pack(packing.tokenise_pieces(odd.select("doc_id", "text"), packing.default_tokenizer()))
    total = packed.agg(F.sum("length")).first()[0]
    assert packing.sequences(packed).agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * total


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "https://x.net", "https://x.net/", "http://example.com/de/", "http://www.example.com/de", "http://b.org/fr/1", "http://borg/fr/1", "x://h?y://z/", "http://İ.COM/É"]
    rows = [(k, u, "e") for k, u in enumerate(urls)] + [(100 + k, f"http://bad.example.org/{k}", "e") for k in range(60)] + [(300 + k, f"http://good.example.com/{k}", "e") for k in range(80)] + [(3, urls[3], "e"), (None, urls[3], None)]
    labels = spark.createDataFrame([(100 + k, 0) for k in range(60)] + [(300 + k, 1) for k in range(80)] + [(100, 1), (5, None), (None, 0)], "doc_id long, quality int")
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter.url_report(pages, labels).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[k].host for k in (0, 2, 3, 4, 10, 11)] == ["", "", "a.example.net", "x.net", "h", "İ.com"]
    assert [(by[k].rule, by[k].verdict) for k in (3, 4, 5, 6, 7, 8, 9)] == [("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow")]
    assert by[3].path == "/en/x" and by[110].verdict == "block"  # sixty bad pages, whatever the prior
    assert url_filter.url_report(pages.where("false"), labels).count() == 0 and url_filter.url_report(pages, labels.where("false")).count() == len(rows)


def test_chat(spark):
    rng = random.Random(7)
    rows = [(1, 0, "user", "</s>[INST] \\ok\\ <|turn|> [/INST]"), (1, 1, "assistant", "<|end|>\\n\n<|text|>"), (2, 0, "system", "be brief"), (3, 0, "assistant", None), (3, 0, "assistant", None), (3, None, None, "x"), (None, 0, "user", "a"), (None, 1, "assistant", "é")]
    rows += [(9, 0, "system", "rules"), *((9, k, ("assistant", "user")[k % 2], prose(rng, rng.choice((5, 60, 200, 700)))) for k in range(1, 30))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("windows", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    groups = defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = chat.format_conversations(df.where("conv_id = 9")).first().windows
    assert len(windows) > 3
    for w in windows[1:]:
        assert w.formatted.startswith("<|turn|>system<|text|>rules") and w.spans[0].repeated and sum(s.repeated for s in w.spans) <= 1 + chat.HISTORY_TURNS
        if sum(not s.repeated for s in w.spans) > 1:
            assert sum(len(words(w.formatted[s.start : s.start + s.length])) + chat.OVERHEAD for s in w.spans) <= chat.BUDGET
    assert chat.format_conversations(df.where("false")).count() == 0


def brute_lines(rows):
    """(doc_id, line) of lines that an earlier line matches."""
    sets = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        sets += [(i, k, frozenset(words(x))) for k, x in enumerate((t or "").split("\n")) if words(x)]
    return {(i, k) for n, (i, k, s) in enumerate(sets) if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for _, _, o in sets[:n])}


def test_line_dedup(spark, none, odd):
    rng = random.Random(11)
    lines = [prose(rng, rng.randint(1, 40)) for _ in range(60)]
    near = [" ".join(w if rng.random() > 0.06 else "new" + str(rng.randint(0, 99)) for w in rng.choice(lines).split()) for _ in range(250)]
    rows = [(k, "\n".join([rng.choice(near + lines + ["", " "]) for _ in range(rng.randint(0, 9))])) for k in range(80)] + [(None, lines[0]), (1000, None), (1001, prose(rng, 4000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("x"))
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(df).collect()}
    assert got == brute_lines(rows)
    cleaned = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert len(cleaned) == len(rows) and cleaned[1000].text is None
    for i, t in rows:
        if t is not None:
            assert cleaned[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_second_round(spark, monkeypatch):
    """With hardly any candidates in the first round the second one finds the rest."""
    monkeypatch.setattr(line_dedup, "FIRST_ROUND", (1, 1))
    rng = random.Random(12)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(120):
        line = list(base)
        for p in rng.sample(range(30), rng.choice((1, 3, 5))):
            line[p] = f"x{rng.randint(0, 12)}"
        rows.append((k, " ".join(line)))
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_simhash(spark, odd, none):
    import xxhash

    def plain(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = words(w)
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, plain(r.text)) for r in odd.collect()]
    got = simhash.simhash_report(odd).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in rows)
    parent = {f: f for _, f in rows}

    def find(f):
        return f if parent[f] == f else find(parent[f])

    for a in list(parent):
        for b in list(parent):
            if bin(a ^ b).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    by = dict((f"{f:016x}", least.get(find(f))) for _, f in rows)
    assert all(r.component_id == by[r.fingerprint] for r in got)
    kept = simhash.simhash_deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({find(f) for _, f in rows})
    assert simhash.simhash_report(none).count() == 0


def test_pigeonring_loses_no_pair(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    bits = set(base)
    for b in base:
        for n in (1, 2, 3, 3, 4, 5):
            x = b
            for p in rng.sample(range(64), n):
                x ^= 1 << p
            bits.add(x)
    bits = [b - (1 << 64) if b >> 63 else b for b in bits]
    got = {(r.a, r.b) for r in simhash.similar_fingerprints(spark.createDataFrame([(b,) for b in bits], "bits long")).collect()}
    assert got == {(a, b) for a in bits for b in bits if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}


def test_exploded_fingerprint_keys_are_not_broadcast(spark):
    bits = spark.range(40).selectExpr("xxhash64(id) AS bits").union(spark.range(40).selectExpr("xxhash64(id) ^ 5 AS bits"))
    found = simhash.similar_fingerprints(bits)
    assert found.count() == 40 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 90), (90, 100), (7, 7), (50, None), (200, 201), (201, 30)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(31)}, 200: 0, 201: 0, 90: 90, 100: 90}
    assert connected_components(edges.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, found = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, found, DATA).cache()
        if k < 4:
            assert found.columns == names, name
        if name == "line dedup":
            assert found.count() > 0
    assert found.where("offset + length > 2048").count() == 0 and found.count() > 0
