import __spark_entry__ as entry


def test_registry_and_oracles_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 6
