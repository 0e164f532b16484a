"""The pipeline's stages and its whole run, against what each operator must decide."""

import numpy as np
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_cases(spark, tmp_path):
    rng = np.random.default_rng(9)
    english = ["the", "of", "and", "that", "with", "from", "this", "ing", "tion", "ed", "er", "in", "was", "by", "is", "it", "on", "for", "are", "be"]
    text = lambda n: " ".join(f"{english[a]}{english[b]}" if c else english[a] for a, b, c in rng.integers(0, 20, (n, 3)))
    clean = [text(120) for _ in range(40)]
    item = text(30)
    rows = [(i, t, "en") for i, t in enumerate(clean)]
    near = clean[3].split()
    near[50] = "changed"
    rows += [(100, clean[1], "en"), (101, clean[2].replace(" ", "  "), None), (102, " ".join(near), "en"), (103, f"{clean[5]} {item} {text(50)}", "en"), (104, "123 456 !!!", "en"), (105, None, None)]
    docs = spark.createDataFrame([(i, t, x, "src", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, gone = docs, [{104, 105}, {1, 101} | {100} - {100}, set(), set()]
    kept = {i for i, _, _ in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, left, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in left.collect()}
        want = [kept - {104, 105}, kept - {104, 105, 100, 2}, kept - {104, 105, 100, 2, 102}, kept - {104, 105, 100, 2, 102, 103}][k]
        assert now == want, name


def test_whole_run(spark):
    pytest.importorskip("public_tokenizers")
    got = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0.7 * docs.count() < got.doc_id.nunique() < docs.count()
    sums = got.groupby("doc_id").agg(n=("length", "sum"), whole=("doc_tokens", "max"))
    assert (sums.n == sums.whole).all()
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "some words that stand for an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts and a column with a clashing name go through all stages."""
    long = " ".join(f"the{i % 977} of{i % 13}ing" for i in range(20_000))
    rows = [(1, "the words that was with from the and it is on", "en", 5), (1, "the words that was with from the and it is on", "en", 6), (None, "was the and of that with from by it is", "en", 7), (3, None, None, 8), (4, "", "en", 9), (5, long, "en", 1), (6, "x", "en", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, cell int")
    spark.createDataFrame([(1, "some words that stand for an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
            assert {r.cell for r in out.collect()} <= {r[3] for r in rows} and 1 in {r.cell for r in out.collect()}
        else:
            assert out.select("doc_id").distinct().count() == 6
