"""The pipeline's stages on the smallest tables."""

from pyspark.sql import functions as F


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from sheetspark.llm.storage import keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, sf_dir), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == first.columns and dict(out.dtypes) == dict(first.dtypes)
        if name == "n-gram Jaccard join":
            assert out.count() < docs.count() and out.count() == out.select("doc_id").distinct().count()
        if name == "personal data":
            assert out.count() == docs.count() and out.where(F.col("text").rlike(r"[a-z]@mail\d")).count() == 0
        docs = out
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def run_over(spark, tmp_path, rows, schema):
    import corpus_pipeline

    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row long, slot int, piece string, `with.dot` int"


def test_pipeline_over_nulls_repeats_and_clashing_names(spark, tmp_path):
    """What the stages leave of each kind of row, against what they say of themselves."""
    plain = lambda i: " ".join(f"word{(i * 37 + j * j) % 500}" for j in range(60 + i))
    rows = [(i, plain(i), "en", f"s{i % 3}", 1, 7, 7, "p", 7) for i in range(30)]
    rows += [(100, plain(3), "en", "s0", 1, 7, 7, "p", 7), (3, plain(3), "en", "s0", 1, 7, 7, "p", 7)]  # a copy, and a repeated row
    rows += [(4, plain(90), "en", "s1", 1, 7, 7, "p", 7)]  # another text under an id
    rows += [(200, None, None, None, None, None, None, None, None), (201, "", "en", "s1", 0, 7, 7, "p", 7), (None, plain(80), "en", "s2", 1, 7, 7, "p", 7)]
    out = run_over(spark, tmp_path, rows, EXTRA)
    got = out.toPandas()
    assert len(got) and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert set(got["doc_id"].dropna().astype(int)) <= {r[0] for r in rows if r[0] is not None} and 100 not in set(got["doc_id"].dropna())
    for _, s in got[got["length"] > 0].groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 2048 and s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]


def test_pipeline_over_an_empty_table(spark, tmp_path):
    assert run_over(spark, tmp_path, [], EXTRA).count() == 0
