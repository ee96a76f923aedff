"""SimHash classes against brute force over all fingerprints."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lathe.llm import components, shared, simhash_dedup as S

SCHEMA = "doc_id long, text string, a long, class_id string"


def texts(seed, n=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(900)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            t = r.choice(out).split()
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.choice([1, 3, 20, 80, 200]))]
        out.append(" ".join(t))
    return out


def brute(ids_texts):
    distinct = sorted({t for _, t in ids_texts if t and t.split()})
    raw, at = shared.texts_of(pa.array(distinct))
    f, _ = S.fingerprints(raw, at)
    n = len(distinct)
    d = sum(np.bitwise_count(f[:, i][:, None] ^ f[:, i][None, :]).astype(int) for i in range(4))
    near = (d <= S.LIMIT) & ~np.eye(n, dtype=bool)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(*np.nonzero(near)):
        label[find(x)] = find(y)
    return {t: (find(i), int(near[i].sum())) for i, t in enumerate(distinct)}


def check(spark, rows):
    got = {r.doc_id: r for r in S.classes(spark.createDataFrame([(*x, 1, "c") for x in rows], SCHEMA)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    least, links = {}, [0, 0]
    for d, t in sorted(rows):
        least.setdefault(want[t][0] if t in want else t, d)
    for d, t in rows:
        assert got[d].class_id == least[want[t][0] if t in want else t]
        links[0] += got[d].n_links
        links[1] += want[t][1] if t in want else 0
        assert got[d].n_copies == sum(x == t for _, x in rows)
    assert links[0] >= 0.99 * links[1] and links[0] <= links[1]


def test_classes(spark):
    rows = [(i * 2, t) for i, t in enumerate(texts(1))]
    rows += [(5001, None), (5003, None), (5005, ""), (5007, " \n"), (5009, "one"), (5011, "z " * 40000)]
    check(spark, rows)


def test_recursion(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_LIST", 60)
    monkeypatch.setattr(S, "SMALL", 8)
    check(spark, list(enumerate(texts(2))))
    monkeypatch.setattr(S, "MOST_LIST", 50)
    check(spark, list(enumerate(texts(3))))
    monkeypatch.setattr(S, "DEPTH", 0)
    check(spark, list(enumerate(texts(4))))


def test_edges(spark):
    assert S.classes(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c", 1, ""), (7, "a b c", 1, ""), (7, "a b c", 1, ""), (None, None, 1, ""), (3, None, 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.class_id, r.n_copies) for r in S.classes(docs).collect()) == [(3, 2), (3, 2), (7, 3), (7, 3), (7, 3)]
    kept = S.kept(docs)
    assert kept.columns == docs.columns and kept.count() == 5


@pytest.mark.parametrize("one", [0, 400_000])
def test_components(spark, monkeypatch, one):
    monkeypatch.setattr(components, "ONE_TASK", one)
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 500)] + [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(200)] + [(-5, 499), (-5, -9)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7), shared.Scratch(spark)).collect()}
    nodes, roots = components.roots(*np.array(edges).T)
    lone = {u for u, v in edges if u == v}
    assert {k: v for k, v in zip(nodes.tolist(), roots.tolist()) if k not in lone or k != v} == {k: v for k, v in got.items() if k not in lone or k != v}
    assert got[300] == -9 and got[-5] == -9
    assert components.components(spark.createDataFrame([], "u long, v long"), shared.Scratch(spark)).collect() == []


@pytest.mark.parametrize("block", [16_000, 100])
def test_a_large_class_is_not_listed_pair_by_pair(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block, raising=False)
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:k], f"x{i}", *words[k + 1 :]])) for i, k in enumerate(r.choices(range(400), k=600))]
    raw, at = shared.texts_of(pa.array([t for _, t in rows]))
    f = np.unique(S.fingerprints(raw, at)[0], axis=0)
    prints = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(f.view(np.int64))], "id long, f0 long, f1 long, f2 long, f3 long")
    assert len(f) > 300 and S.linked(prints, shared.Scratch(spark)).count() < 2 * len(f)
    assert [(r.class_id, r.n_links) for r in S.classes(spark.createDataFrame([(*x, 1, "c") for x in rows], SCHEMA)).collect()] == [(0, 599)] * 600
    check(spark, list(enumerate(texts(6))))


def test_tasks_that_share_a_list_find_its_classes(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARE", 100)
    monkeypatch.setattr(S, "SMALL", 8)
    check(spark, list(enumerate(texts(7))))
