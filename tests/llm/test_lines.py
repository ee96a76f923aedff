"""Line dedup against brute force over all pairs of lines."""

import hashlib
import random

import numpy as np
import pytest

from lathe.llm import line_dedup as D
from lathe.llm import shared

SCHEMA = "doc_id long, text string, line long, batch_id long"


def shingles(text):
    return frozenset(text[i : i + D.SHINGLE] for i in range(max(1, len(text) - D.SHINGLE + 1)))


def brute(rows):
    lines = [(d, i, x) for d, t in sorted(rows, key=lambda r: r[0]) if t for i, x in enumerate(t.encode().split(b"\n"))]
    live = list(dict.fromkeys(x for _, _, x in lines if x.strip(b" \t\n\x0b\x0c\r")))
    sets = [shingles(x) for x in live]
    parent = list(range(len(live)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(live)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= D.THRESHOLD * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    home = {x: find(i) for i, x in enumerate(live)}
    seen, kept, stats, met = set(), {}, {}, set()
    for d, i, x in lines:
        k = home.get(x)
        drop = k is not None and k in seen
        fuzzy = k is not None and live[k] != x and x not in met
        met.add(x)
        if k is not None:
            seen.add(k)
        n, r, f = stats.get(d, (0, 0, 0))
        stats[d] = (n + 1, r + drop, f + (drop and fuzzy))
        if not drop:
            kept.setdefault(d, []).append(x)
    return sorted((d, *stats.get(d, (0, 0, 0)), hashlib.sha256(b"\n".join(kept.get(d, []))).hexdigest()) for d, _ in rows)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwé") for _ in range(r.randint(1, 9)))
    pool, rows = [], []
    for i in range(n):
        out = []
        for _ in range(r.randint(0, 8)):
            kind = r.random()
            if pool and kind < 0.25:
                out.append(r.choice(pool))
            elif pool and kind < 0.5:
                w = r.choice(pool).split(" ")
                w[r.randrange(len(w))] = word()
                out.append(" ".join(w))
            elif kind < 0.6:
                out.append(r.choice(["", " ", "\t", "ok", "a", "Yes."]))
            else:
                out.append(" ".join(word() for _ in range(r.randint(1, 60))))
            pool.append(out[-1])
        rows.append((i * 2, "\n".join(out)))
    rows += [(901, None), (903, ""), (905, "\n"), (907, "\n\nend\n"), (909, "long " * 30000 + "\nlong " + "x"), (911, rows[3][1]), (913, "crlf\r\nline\r\n")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch", [(1, 1 << 20), (2, 1500), (3, 400)])
def test_against_brute_force(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(shared, "BATCH_BYTES", batch)
    if seed == 3:
        monkeypatch.setattr(D, "BLOCK", 3)
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA).repartition(3)
    got = sorted(tuple(x) for x in D.digest(df).collect())
    want = brute(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    # banding may miss a pair just above the threshold
    assert sum(g == w for g, w in zip(got, want)) >= len(want) - 2
    texts = {x.doc_id: x.text for x in D.texts(df).collect()}
    assert texts[901] is None and texts[903] == "" and texts[905] == "\n"
    assert all(hashlib.sha256((texts[g[0]] or "").encode()).hexdigest() == g[4] for g in got)


def test_edges(spark):
    assert D.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    got = D.digest(spark.createDataFrame([(None, "a b\nc", 1, 1), (4, "a b", 1, 1), (4, "a b", 1, 1), (9, None, 1, 1)], SCHEMA)).collect()
    assert sorted((x.doc_id or -1, x.n_lines, x.n_removed) for x in got) == [(-1, 2, 0), (4, 1, 1), (4, 1, 1), (9, 0, 0)]


def test_links_within_reach_all_pairs():
    r = random.Random(4)
    texts = ["".join(r.choice("ab") for _ in range(14)).encode() for _ in range(150)]
    links = D.links_within(np.arange(len(texts)), texts, np.zeros((len(texts), D.BINS), np.uint8))
    parent = list(range(len(texts)))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    full = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= D.THRESHOLD * len(sets[i] | sets[j]):
                full[max(find(full, i), find(full, j))] = min(find(full, i), find(full, j))
    assert [find(parent, i) for i in range(len(texts))] == [find(full, i) for i in range(len(texts))]
