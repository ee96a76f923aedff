"""The transducer against the sentencepiece library, and round trips."""

import random
import time
import zlib

import numpy as np
import sentencepiece

from lathe.llm import sentencepiece_fst as S

SCHEMA = "doc_id long, text string, ids string"
ALPHABETS = ["abcdefghij klmnop", "the and of re in er on  ", "  \t\nab", "éèàüß 123,.", "日本語テキスト 한국어", "🙂▁ x\x00~"]


def cases(n=3000):
    r = random.Random(2)
    for _ in range(n):
        a = r.choice(ALPHABETS)
        yield "".join(r.choice(a) for _ in range(r.randint(0, 40)))
    yield from [" " * k + w + " " * j for k in range(0, 40, 3) for j in (0, 1, 17, 40) for w in ("", "word", "日")]


def test_ids_are_those_of_the_library():
    tool, lib = S.Transducer(S.model_path()), sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    for text in cases():
        ids, fell = tool.encode(text)
        want = lib.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert fell == sum(lib.is_byte(i) for i in want)
        raw, at = tool.decode(np.array(want, np.int64), np.array([0, len(want)]))
        assert raw.tobytes().decode("utf-8") == text.replace(S.ESCAPE, " ")


def test_long_runs_and_words_stay_near_linear():
    tool, lib = S.Transducer(S.model_path()), sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    for text in (" " * 200_000, "a" * 300_000, "x" + " " * 99_999 + "y", "é日" * 50_000, "thequickbrownfox" * 20_000, "ab c" * 100_000):
        began = time.time()
        ids = np.frombuffer(tool.encode(text)[0], "<u4").tolist()
        assert time.time() - began < 20 and ids == lib.encode(text)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    got = {r.doc_id: r for r in S.digest(docs).collect()}
    for r in docs.collect():
        ids = lib.encode(r.text)
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and got[r.doc_id].round_trip and got[r.doc_id].n_pieces == len(ids)
    back = {r.doc_id: r.text for r in S.decode(S.encode(docs)).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_edges(spark):
    assert S.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    got = S.digest(spark.createDataFrame([(None, None, ""), (2, "", ""), (2, " ", ""), (3, "x" * 300000, ""), (4, " a", ""), (4, " a", "")], SCHEMA)).collect()
    assert [(r.doc_id, r.n_pieces > 0, r.round_trip) for r in got] == [(None, False, True), (2, False, True), (2, True, True), (3, True, True), (4, True, True), (4, True, True)]
    assert S.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()[0].text == ""
