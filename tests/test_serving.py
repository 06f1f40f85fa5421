"""Statements on small fixtures, against counts made by hand."""

from netloom.sources.dialect import render
from netloom.plans.serving import STATEMENTS


def run(spark, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(t)
    try:
        return [tuple(r) for r in spark.sql(render(STATEMENTS[name][1], False)).collect()]
    finally:
        for t in tables:
            spark.catalog.dropTempView(t)


def test_severity_breakdown_counts_all_and_fills_gaps(spark):
    # severity, ts, acknowledged; severities 1 and 4 have no open alert
    rows = [(2, 10, False), (2, 11, False), (3, 11, False), (5, 13, False), (5, 14, False), (5, 15, False), (5, 17, False), (4, 10, True)]
    got = run(spark, "severity_breakdown", alerts=(rows, "severity int, ts long, acknowledged boolean"))
    assert sorted(got) == [(1, "info", 0, 0), (2, "low", 2, 50), (3, "medium", 1, 25), (4, "high", 0, 0), (5, "critical", 4, 100)]


def test_any_probe_run_counts(spark):
    domains = ([("a.org", 50, 10**6), ("b.org", 40, 10**6), ("c.org", 30, 10**6)], "domain string, risk_score int, last_seen long")
    runs = ([(1, "a.org", 10**6 - 5), (2, "b.org", 10**6 - 5), (3, "c.org", 1000)], "id long, domain string, ts long")
    assert run(spark, "domains_needing_probe", domains=domains, probe_runs=runs) == [("c.org", 30)]
