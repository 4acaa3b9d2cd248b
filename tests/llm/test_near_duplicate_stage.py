"""The pipeline's near-duplicate stage keeps one row of each group."""

import corpus_pipeline


def texts(n):
    return " ".join(f"w{n}x{k}" for k in range(100))


def test_one_row_of_each_group(spark):
    near = texts(1) + " end"
    rows = [(1, texts(1), "a"), (1, texts(1), "a"), (1, texts(1), "b"), (2, texts(2), "a"), (2, near, "a"), (3, near, "b"), (None, texts(3), "a"), (4, texts(3), "a"), (5, texts(5), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.one_of_each(spark, docs, None)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, texts(1), "a"), (2, texts(2), "a"), (4, texts(3), "a"), (5, texts(5), "a")]


def test_pairs_from_eighty_per_cent(spark):
    words = [f"w{k}" for k in range(104)]  # 100 shingles; a cut text of 82 has 82 of them
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:86])), (3, " ".join(words[:60]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, None).collect()) == [1, 3]
