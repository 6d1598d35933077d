import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert df.columns == ["doc_id", "source", "n_mentions", "score"]


def test_every_oracle_has_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 40


def test_cheap_queries_run_at_smallest_scale(spark):
    q = entry.queries()
    for name in ("token_counts", "scored_scan", "split_random", "vocabulary", "unit_vectors", "month_report",
                 "day_interval", "label_codes", "type_frequencies"):
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0
