"""Repeated passages of words and bytes against brute force."""

import hashlib
import random
import re

import pytest

from lathe.llm import passages, shared, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, extra string, id long"


def brute_words(rows, window):
    seen, words = {}, {}
    for d, t in rows:
        words.setdefault(d, []).append([] if t is None else re.findall(rb"[^\x20\x09-\x0D]+", t.encode()))
    for d, lists in words.items():
        for w in lists:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                seen[k] = min(seen.get(k, d), d)
    out = []
    for d, lists in words.items():
        for w in lists:
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i : i + window])] < d:
                    gone[i : i + window] = [True] * window
            out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def brute_bytes(rows, window):
    seen, out = set(), []
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "be", "çà", "the", "wordy", "x" * 30, "ñ"]
    passage = [[r.choice(vocabulary) for _ in range(r.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts += r.choice(passage)[r.randint(0, 6) :] if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 40))]
        rows.append((i * 3, r.choice([" ", "\n", "  ", "\t"]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "a " * 500), (1003, "z" * 3000), (1004, "z" * 120 + "y"), (1005, "a"), (1006, "ab" * 2000), (1007, " \n\t ")]
    rows += [(2000 + i, rows[5][1]) for i in range(10)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch", [(1, 1 << 20), (2, 2000), (3, 500)])
def test_words_against_brute_force(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(shared, "BATCH_BYTES", batch)
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "e", 7) for x in rows], SCHEMA).repartition(3)
    for window in (13, 3):
        assert sorted(map(tuple, substring_dedup.digest(df, window).collect())) == brute_words(rows, window)


@pytest.mark.parametrize("seed,batch", [(1, 1 << 20), (2, 2000), (3, 500)])
def test_bytes_against_brute_force(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(shared, "BATCH_BYTES", batch)
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "e", 7) for x in rows], SCHEMA).repartition(3)
    for window in (100, 20):
        assert sorted(map(tuple, suffix_dedup.digest(df, window).collect())) == brute_bytes(rows, window)


def test_texts_longer_than_a_slice(spark):
    r = random.Random(4)
    one = " ".join(r.choice(["alpha", "be", "gamma", "d", "x" * 9]) + str(r.randint(0, 400)) for _ in range(110_000))
    rows = [(1, one), (2, one[300_000:] + "q" * 400_000), (3, "q" * 350 + one[:5000]), (4, "short " * 30)]
    assert min(len(t) for _, t in rows[:2]) > 2 * passages.SLICE
    df = spark.createDataFrame([(*x, "e", 7) for x in rows], SCHEMA)
    assert sorted(map(tuple, substring_dedup.digest(df).collect())) == brute_words(rows, 13)
    assert sorted(map(tuple, suffix_dedup.digest(df).collect())) == brute_bytes(rows, 100)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.digest(df).collect() == []
    assert suffix_dedup.digest(df).collect() == []


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, t, "", 1), (5, t, "", 1), (5, t, "", 1)], SCHEMA)
    got = sorted(((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.digest(df).collect()))
    assert got == [(-1, 40, 0), (5, 40, 40), (5, 40, 40)]
    assert sorted(r.n_removed for r in suffix_dedup.digest(df).collect()) == [0, len(t), len(t)]
