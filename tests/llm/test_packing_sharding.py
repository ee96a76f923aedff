"""Packing against tokenizers and a single pass; sharding against its contract."""

import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lathe.llm import packing, sharding

SCHEMA = "doc_id long, text string, part int, size string"
TEXTS = [None, "", "a", "a  b", "a   b \n c\t\t d", "naïve Ünïcode — ok 123 it's", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|><|endoftext|>", "word " * 900, "z" * 3000, "日本語 テキスト", " lead", "trail  ", "x\x1cy　z "]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("length,special", [(7, True), (1024, True), (7, False)])
def test_pieces(spark, length, special):
    tool = Tokenizer.from_file(packing.vocabulary())
    if not special:
        tool.encode_special_tokens = True
    ids = {i: [*tool.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    rows = packing.pack(frame(spark, TEXTS), length, special=special).collect()
    for d, own in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.start)), lambda r: r.doc_id):
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids[d]) and 0 < r.length <= length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    assert {r.doc_id for r in rows} == set(ids)
    last = max(r.sequence_id for r in rows)
    for s, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == length or s == last
    assert last == -(-sum(map(len, ids.values())) // length) - 1


def test_pack_edges(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, "a", 1, ""), (4, "a", 1, ""), (4, "a", 1, "")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 2), (4, 2), (4, 2)]


def test_differencing_is_tight():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 5000, 2000)
    loads, shard = sharding.difference_sizes(sizes, 8)
    assert sorted(loads) == sorted(np.bincount(shard, sizes, 8).astype(int).tolist())
    assert max(loads) - min(loads) <= 2
    assert sharding.difference_sizes(np.array([8, 7, 6, 5, 4]), 2)[0] in ([16, 14], [14, 16])  # the textbook case
    assert sharding.difference_sizes(np.zeros(0, np.int64), 8)[0] == [0] * 8


def test_shards(spark):
    texts = [f"t{i % 700}" * (i % 37) for i in range(2000)] + [None, None, "", "é" * 50]
    rows = sharding.assign(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    home = {}
    for r in rows:
        t = texts[r.doc_id]
        raw = (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert home.setdefault(t, r.shard) == r.shard
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) < 0.01 * sum(loads)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {r.shard for r in sharding.assign(frame(spark, ["same"] * 50)).collect()} <= set(range(8))


def test_a_heavy_group_is_offset_by_light_ones(spark):
    r = np.random.default_rng(3)
    light = [f"{i} " + "x" * int(k) for i, k in enumerate(r.integers(20, 400, 3000))]
    total = sum(len(x) + 1 for x in light)
    for share in (0.05, 1 / 3):
        copies = round(share / (1 - share) * total / 1001)
        rows = [(i, x, 1, 2) for i, x in enumerate(light + ["h" * 1000] * copies)]
        found = []
        for tasks in (2, 9):
            got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, u long, v long").repartition(tasks)).groupBy("shard").sum("size").collect()
            found.append(sorted(x[1] for x in got))
        assert found[0] == found[1] and len(found[0]) == 8
        loads = np.array(found[0])
        if share < 1 / 8:
            assert loads.max() < 1.001 * loads.mean()
        else:  # the group has a shard of its own, the others are level
            assert loads[-1] == copies * 1001 and loads[-2] < 1.001 * loads[0]
