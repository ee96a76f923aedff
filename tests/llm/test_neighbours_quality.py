"""Neighbours against brute force; the classifier on held-out labels."""

import numpy as np
import pytest

from lathe.llm import neighbours, quality

VECTORS = "vec_id long, embedding array<float>, score double, list int"


def brute(vectors, top=5):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in ok:
        if q % 50 == 0:
            s = [(-float(ok[q] @ x / np.linalg.norm(ok[q]) / np.linalg.norm(x)), i) for i, x in ok.items() if i != q]
            out[q] = sorted(s)[:top]
    return out


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows[7] = (7, rows[50][1])
    rows[9] = (9, rows[50][1])
    rows[3], rows[4], rows[5], rows[6] = (3, None), (4, [0.0] * 8), (5, [float("nan")] * 8), (6, [1.0] * 7 + [None])
    rows[100] = (100, [float("inf")] + [1.0] * 7)
    df = spark.createDataFrame([(*x, 0.0, 1) for x in rows], VECTORS)
    want = brute(rows)
    got = {}
    for x in neighbours.search(df, "vec_id % 50 = 0").collect():
        got.setdefault(x.query_id, []).append((x.rank, -x.score, x.vec_id))
    assert set(got) == set(want) == {0, 50}
    for q, found in got.items():
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
        assert [f[2] for f in sorted(found)] == [w[1] for w in want[q]]
        assert np.allclose([f[1] for f in sorted(found)], [w[0] for w in want[q]], atol=1e-12)


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = df.toArrow()
    want = brute(list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist())))
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df, "vec_id % 50 = 0").collect()}
    pairs = {(q, i) for q, found in want.items() for _, i in found}
    assert len(got & pairs) >= 0.9 * len(pairs)


def test_recall_with_many_lists(spark):
    r = np.random.default_rng(5)
    heads = r.normal(size=(40, 16))
    rows = [(i, (heads[i % 40] + 0.5 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame([(*x, 0.0, 1) for x in rows], VECTORS)
    got = {(x.query_id, x.vec_id) for x in neighbours.search(df, "vec_id % 50 = 0", list_size=20).collect()}
    pairs = {(q, i) for q, found in brute(rows).items() for _, i in found}
    assert len(got & pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("list_size", [200, 2])
def test_repeated_rows_are_candidates_of_their_own(spark, list_size):
    a, b, c = [1.0, 0.0], [0.6, 0.8], [0.0, 1.0]
    rows = [(0, a), (1, b), (1, b), (2, c), (50, a), (50, c)]
    df = spark.createDataFrame([(*x, 0.0, 1) for x in rows], VECTORS)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.search(df, "vec_id % 50 = 0", list_size=list_size).collect())
    want = []
    for i, (q, x) in enumerate(rows):
        if q % 50 == 0:
            found = sorted((-float(np.dot(np.float32(x).astype(float), np.float32(y).astype(float))), v) for j, (v, y) in enumerate(rows) if j != i)[:5]
            want += [(q, k, v, round(-s, 6)) for k, (s, v) in enumerate(found, 1)]
    assert got == sorted(want)


def test_no_vectors(spark):
    assert neighbours.search(spark.createDataFrame([], VECTORS), "vec_id % 50 = 0").collect() == []
    assert neighbours.search(spark.createDataFrame([(0, None, 0.0, 1), (50, [1.0], 0.0, 1)], VECTORS), "vec_id % 50 = 0").collect()[0:] == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    verdict = quality.classify(docs, labels.where("doc_id % 2 = 0"))
    assert verdict.count() == docs.count()
    found = verdict.join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality").collect()
    good = [r.keep for r in found if r.quality == 1]
    bad = [r.keep for r in found if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_posteriors_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.source or "", r.lang or "", (r.text or "").encode()) for r in docs.collect()]
    x = np.concatenate([quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for *_, t in rows])
    label = {r.doc_id: r.quality for r in labels.collect()}
    known = [i for i, r in enumerate(rows) if r[0] in label]
    known.sort(key=lambda i: rows[i][0])
    model = quality.fit(x[known], np.array([float(label[rows[i][0]]) for i in known]))
    z = model.log_odds(x)
    p = 1 / (1 + np.exp(-z))
    sums, hosts = {}, {}
    for (_, h, q, _), v in zip(rows, p):
        n, s = sums.get((h, q), (0, 0.0))
        sums[h, q] = n + 1, s + v
        n, s = hosts.get(h, (0, 0.0))
        hosts[h] = n + 1, s + v

    def strength(m, v):
        return max(m * (1 - m) / v - 1, 1.0) if v > 1e-9 else 1e6

    docs_n, prior = len(rows), p.mean()
    between = (sum(s * s / n for n, s in hosts.values()) - docs_n * prior**2 - (len(hosts) - 1) * prior * (1 - prior)) / docs_n
    k = strength(prior, between)
    top = {h: (s + k * prior) / (n + k) for h, (n, s) in hosts.items()}
    excess = 0.0
    for (h, _), (n, s) in sums.items():
        m = hosts[h][1] / hosts[h][0]
        excess += n * (s / n - m) ** 2 - m * (1 - m)
    k = strength(prior, excess / docs_n)
    odds = lambda v: np.log(min(max(v, 1e-9), 1 - 1e-9) / (1 - min(max(v, 1e-9), 1 - 1e-9)))
    want = {}
    for (d, h, q, _), e, v in zip(rows, z, p):
        n, s = sums[h, q]
        total = e + odds((s - v + k * top[h]) / (n - 1 + k)) - odds(prior)
        want[d] = (e, top[h], (s + k * top[h]) / (n + k), 1 / (1 + np.exp(-total)))
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r.evidence, r.host_posterior, r.path_posterior, r.posterior), want[r.doc_id], rtol=1e-6, atol=1e-9) and r.keep == (r.posterior >= quality.THRESHOLD)


def test_the_sample_is_bounded(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = labels.select("doc_id", labels["quality"].cast("double").alias("quality"))
    few = quality._sample(quality._measured(docs, None, None), known, 200)
    assert 100 < len(few) < 300 and [r.doc_id for r in few] == sorted(r.doc_id for r in few)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep int, p double"


def test_quality_edges(spark):
    rows = [(1, None, None, None, 0, 1, 1.0), (None, "a", "en", "s", 1, 1, 1.0), (2, "", "en", "s", 0, 1, 1.0), (2, "x " * 100000, "en", "s", 1, 1, 1.0)]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, none).count() == 4
    kept = quality.kept(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4
    some = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.kept(docs, some).count() <= 4
    assert quality.classify(docs.limit(0), some).collect() == []


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 200 + [("bad", "a", 0.1)] * 200 + [("bad", "new", 0.9)] + [("new", "x", 0.1)]
    sites = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert sites["bad", "new"].path_posterior < 0.5  # one good page in a bad host stays doubtful
    prior = sites["new", "x"].prior
    assert 0.1 < sites["new", "x"].host_posterior < prior
    assert sites["big", "a"].host_posterior == pytest.approx(0.9, abs=0.02)
