import corpus_pipeline


def test_clean_rows_of_a_contaminated_id_stay(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "clean one"), (None, None), (5, f"so {item}"), (5, "clean two"), (6, "clean three"), (7, item), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, "clean one"), (None, None), (5, "clean two"), (6, "clean three")], key=repr)
