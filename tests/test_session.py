from geotrail.session import cut_lineage, ensure_checkpoint_dir, scratch_path, store


def test_cut_lineage_uses_the_session_checkpoint_folder(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/").split("/")[-1] in d
    df = cut_lineage(spark.range(10))
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LocalCheckpoint" not in plan and "Range" not in plan     # reads the written data


def test_store_keeps_schema_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, [1.5, None]), (2, "b", None)], "a long, b string, c array<double>")
    got = store(df)
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert store(df.limit(0)).collect() == []
    assert scratch_path(spark, "x").startswith(ensure_checkpoint_dir(spark)) and scratch_path(spark, "x") != \
        scratch_path(spark, "x")


def test_tables_of_a_scope_go_when_it_ends(spark):
    import os
    from geotrail.session import scratch_scope, store
    keep = store(spark.range(3), "outer")
    with scratch_scope(spark):
        first = store(spark.range(5), "inner")
        with scratch_scope(spark):
            second = store(first.filter("id > 2"), "inner")
            gone = [f.removeprefix("file:") for f in second.inputFiles()]
            assert second.count() == 2
        assert gone and not any(os.path.exists(f) for f in gone)
        assert first.count() == 5
        gone = [f.removeprefix("file:") for f in first.inputFiles()]
    assert gone and not any(os.path.exists(f.replace("///", "/")) for f in gone) and keep.count() == 3
