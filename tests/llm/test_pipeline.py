"""The pipeline's stages on the small tables, and on awkward rows."""

import corpus_pipeline as P
from lathe.llm import packing, quality, simhash_dedup
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_passages import brute_words

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        before = {r.doc_id: r for r in docs.collect()}
        after = spark.read.parquet(f"{tmp_path}/{i}")
        rows = {r.doc_id: r for r in after.collect()}
        if name == "quality":
            keep = {r.doc_id for r in quality.classify(docs, labels).collect() if r.keep}
            assert set(rows) == keep and len(keep) > 0.7 * len(before)
        elif name == "lines":
            want = {w[0]: w for w in brute_lines([(d, r.text) for d, r in before.items()])}
            assert sum(want[d][2] for d in want) > 0
            same = [d for d in before if (rows[d].text if d in rows else "").count("\n") + 1 == want[d][1] - want[d][2]]
            assert len(same) >= 0.95 * len(rows)
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "near_duplicates":
            classes = {r.doc_id: r.class_id for r in simhash_dedup.classes(docs).collect()}
            assert set(rows) == set(classes.values())
        elif name == "passages":
            gone = {w[0]: w[2] for w in brute_words([(d, r.text) for d, r in before.items()], 13)}
            assert all(len(r.text.split()) == len(before[d].text.split()) - gone[d] for d, r in rows.items())
        else:
            assert set(rows) == set(before)
        docs = after


def test_awkward_rows(spark):
    rows = [(None, "a b", "en", "s", 1, 1), (1, None, None, None, 0, 1), (2, "", "en", "s", 0, 1), (3, "x y", "en", "s", 3, 1), (3, "x y", "en", "s", 3, 1), (4, "long line of words here", "en", "s", 2, 1), (5, "long line of words here", "en", "s", 2, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, count int")
    lines = P.distinct_lines(spark, docs, SF)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in lines.collect())
    # the null id counts as the smallest; of rows that share an id one keeps the line that they have in common
    assert got == [(-1, "a b"), (1, ""), (2, ""), (3, "x y"), (4, "long line of words here")]
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_rows_that_share_an_id_lose_what_repeats(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    names = "doc_id long, text string, n_chars int, key int, key_ int, twice int, new int, null int, rejected int, gone int, TEXT_ int"
    extra = (0,) * 9
    rows = [(2, f"{passage}\nfirst own line of this row", *extra), (2, f"{passage}\nanother own line that is here", *extra), (None, f"{passage}\nno id at all in this row", *extra), (1, f"{passage} and more words", *extra), (9, None, *extra)]
    docs = spark.createDataFrame(rows, names)
    lines = P.distinct_lines(spark, docs, SF)
    assert lines.columns == docs.columns and lines.dtypes == docs.dtypes
    kept = [r.text for r in lines.collect()]
    # the longer line of row 1 is similar to the passage; the row goes, as it has no other
    assert kept.count(None) == 1 and len(kept) == 4 and sum(passage in (t or "") for t in kept) == 1
    words = P.distinct_passages(spark, docs, SF)
    assert sum((t or "").count("w20") for t in (r.text for r in words.collect())) == 1
    assert P.distinct_documents(spark, docs, SF).columns == docs.columns
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.kept(docs, labels, None, None).columns == docs.columns


def test_run(spark):
    assert P.run(spark, SF).columns == packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).columns
