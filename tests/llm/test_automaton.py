"""Suffix automata against plain search, and removal of a broadcast reference."""

import random

import pytest

from lathe.llm import passages, substring_dedup
from lathe.llm.automaton import SuffixAutomaton
from tests.llm.test_passages import SCHEMA, brute_words, corpus


def test_statistics():
    r = random.Random(8)
    for _ in range(300):
        added = ["".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 5))]
        automaton = SuffixAutomaton()
        for a in added:
            automaton.add(a)
        text = "".join(r.choice("abcd") for _ in range(20))
        want = [max((n for n in range(end + 2) if any(text[end + 1 - n : end + 1] in a for a in added)), default=0) for end in range(len(text))]
        assert automaton.statistics(text) == want
        assert len(automaton.next) <= max(1, 2 * sum(map(len, added)))


def test_sorting_and_streaming_agree(spark, monkeypatch):
    rows = corpus(7)
    df = spark.createDataFrame([(*x, "e", 7) for x in rows], SCHEMA).repartition(2)
    want = brute_words(rows, 5)
    for most in (0, 40, 12_000):
        monkeypatch.setattr(passages, "AUTOMATON_WINDOWS", most)
        assert sorted(map(tuple, substring_dedup.digest(df, 5).collect())) == want


def test_reference(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 30)
    w = [f"w{i}" for i in range(60)]
    reference = spark.createDataFrame([(" ".join(w[:40]),), (" ".join(w[30:]),), (None,), ("",)], "text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(w[5:25]) + " b", "", 1), (2, " ".join(w[5:17]), "", 1), (3, None, "", 1), (4, " ".join(w[25:45]), "", 1), (None, "x  y", "", 1)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.without_reference(docs, reference).collect()}
    assert got[1] == ("a b", 20) and got[2] == (" ".join(w[5:17]), 0) and got[3] == (None, 0) and got[None] == ("x  y", 0)
    assert got[4] == ("", 20)  # either passage covers a part
    assert substring_dedup.without_reference(docs.limit(0), reference).collect() == []
    assert substring_dedup.without_reference(docs, reference.limit(0)).count() == 5
    monkeypatch.setattr(substring_dedup, "MOST_REFERENCE", 10)
    with pytest.raises(ValueError):
        substring_dedup.without_reference(docs, reference)
