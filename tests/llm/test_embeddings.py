"""Embedding links against all pairs: per-vector counts, components, recall at the threshold, double vectors, repeated ids."""

import numpy as np
import pytest

from sparkburst.llm import embed_dedup


def brute(rows, least=0.93):
    """vec_id -> (n_links, component) of usable rows (vec_id, vector, label); ids may repeat."""
    x = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for _, v, _ in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least_id = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least_id[find(k)] = min(i, least_id.get(find(k), i))
    return sorted((i is None, i or 0, n, -1 if i is None else least_id[find(k)]) for k, ((i, *_), n) in enumerate(zip(rows, links, strict=True)))


def answer(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, -1 if r.component_id is None else r.component_id) for r in embed_dedup.embedding_links(df).collect())


def pair_at(rng, dim, cosine):
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * b


@pytest.mark.parametrize("block", [1500, 8])
def test_counts_and_components(spark, monkeypatch, block):
    """Every vector's links and component, with clusters, copies, repeated and null ids, other labels and lengths; blocks of any size."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(24)
        rows += [(len(rows) + k, [float(v) for v in centre + rng.choice([0.02, 0.2]) * rng.standard_normal(24)], c % 3) for k in range(8)]
    rows += [(500 + k, rows[k][1], rows[k][2]) for k in range(10)] + [(3, rows[40][1], rows[40][2]), (3, rows[50][1], 9), (None, rows[8][1], rows[8][2]), (None, [1.0] * 4, 1), (700, [1.0, 1.0, 1.0, 1.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert answer(df) == brute(rows)


def test_double_vectors_keep_their_digits(spark):
    """Pairs within 3e-9 of the threshold, which single precision can't tell apart."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        a, b = pair_at(rng, 16, 0.93 + (3e-9 if k % 2 else -3e-9))
        rows += [(2 * k, a.tolist(), k), (2 * k + 1, b.tolist(), k)]
    got = {r.vec_id: r.n_links for r in embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert not any(got[2 * k] for k in range(0, 150, 2)) and sum(got[2 * k] for k in range(1, 150, 2)) >= 68


def test_recall_near_the_threshold(spark):
    """Planted pairs at cosine 0.93 to 0.95 among 6,000 vectors of one label."""
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for k in range(1000):
        a, b = pair_at(rng, 64, rng.uniform(0.9301, 0.95))
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, b.tolist(), 1)]
        pairs.append(2 * k)
    rows += [(5000 + k, v.tolist(), 1) for k, v in enumerate(rng.standard_normal((4000, 64)))]
    got = {r.vec_id: r for r in embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = sum(got[k].n_links == 1 and got[k + 1].component_id == k for k in pairs)
    assert found >= 950 and sum(r.n_links for r in got.values()) <= 2000


def test_keys_grow_with_the_label(spark):
    """Buckets of unrelated vectors stay near their size, and tables grow slowly."""
    for n in (100, 10_000, 10**6, 10**8, 10**10):
        bits, tables = embed_dedup.shape(n, 0.93)
        assert n / 2**bits <= embed_dedup.BUCKET and tables <= 10 * max(1.0, n / 8192) ** 0.25


def test_lengths_that_the_sample_lacks(spark):
    """Vectors of rare lengths are linked as well as others, however small the sample is."""
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(8).tolist(), 1) for k in range(200)]
    want = set()
    for dim in (2, 5, 64, 300):
        v = rng.standard_normal(dim)
        for k in (0, 1):
            rows.append((1000 * dim + k, (v + k * 1e-6).tolist(), 1))
        want |= {1000 * dim, 1000 * dim + 1}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for fit_rows in (20, 0):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_links(df, fit_rows=fit_rows).collect()}
        assert len(got) == len(rows) and all(got[k] == (1, k // 1000 * 1000) for k in want)
