import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["case_id", "kind", "ref_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_run(spark, small):
    from changelode import queries

    for name in ("p2_found", "p3_found", "p4_found", "rank_score", "primary_subsystem", "percentile_midrank"):
        assert queries.queries()[name](spark, small).count() >= 0
