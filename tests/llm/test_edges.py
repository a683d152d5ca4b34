"""Empty tables, repeated rows that differ elsewhere, and the shared folder's rules."""

import pytest

pytest.importorskip("agendum.llm")

from agendum.llm import common, licenses, ngramjoin, quality, topk, urls


def test_empty_tables_give_empty_results(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, Kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert licenses.scan(docs).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), [urls.UrlRule("block", "org")]).count() == 0
    assert urls.judge_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), []).first().verdict == "allow"
    assert quality.judge(docs, labels).count() == 0
    assert quality.judge(docs, spark.createDataFrame([(1, 0, 0)], labels.schema)).count() == 0
    assert ngramjoin.keep_one(docs).count() == 0


def test_the_pipeline_takes_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made = pipeline.run(spark, str(tmp_path))
    assert made.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(made.columns)


def test_the_row_that_stays_does_not_depend_on_order(spark):
    rows = [(1, "a b c d e f", f"x{n}", n) for n in (3, 1, 2)] + [(2, "a b c d e f", "y", 0), (None, "q r s t u v", "z", 5), (None, "q r s t u v", "z", 4)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id long, text string, other string, n_chars long").repartition(3)
        assert sorted(map(str, ngramjoin.keep_one(df).collect())) == sorted(map(str, [r for r in spark.createDataFrame([rows[1], rows[5]], df.schema).collect()]))


def test_waves_of_shards_find_the_best(spark):
    rows = [(n, [n % 7 - 3, n % 11 - 5, n % 13 - 6]) for n in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    asked = df.filter("vec_id % 40 = 0")
    one = topk.top_k(df, asked, k=3).collect()
    many = topk.top_k(df, asked, k=3, shard_rows=20, block_rows=3).collect()  # 20 shards: waves of 1, 3, 12 and 4
    assert sorted(one) == sorted(many) and len(one) == 30


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_a_repeated_key_is_one_labelled_row(spark):
    texts = [(1, "good words in a row " * 8)] * 500 + [(2, "bad *** " * 30), (3, " ".join(f"w{n}" for n in range(40)))]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    cells, _ = quality.labelled_cells(spark.createDataFrame(texts, "doc_id long, text string"), labels, "doc_id", "quality", "text", 100, 4)
    assert sum(c["count"] for c in cells) <= 3
