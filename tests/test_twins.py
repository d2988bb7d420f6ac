"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from peakflow import session
from peakflow.plans.registry import QUERIES, TWINS
from twins import connect, rows_of_query, rows_of_sql, types_of

NAMES = sorted(QUERIES)
# Queries whose rows come in a given order, and that order (descending columns with a minus).
ORDERED = {
    "product_leaderboard": ["-demand_date", "-gross_sales", "product_id"],
    "store_daily_summary": ["-demand_date", "store_id"],
    "order_status_summary": ["-order_count", "order_status"],
    "peak_alerts": ["-hour_start", "-pressure_ratio", "store_id"],
    "top_products": ["-units_sold", "product_id"],
    "store_totals": ["-orders", "store_id"],
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def stored(spark):
    folder = f"{session.checkpoint_root(spark)}/peakflow"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, sf_dir, con, name):
    before = stored(spark)
    with session.scratch():
        df = QUERIES[name](spark, sf_dir)
        sql = TWINS[name]
        assert rows_of_query(df) == rows_of_sql(con, sql)
        mine, theirs = types_of(df, con, sql)
        assert mine == theirs
        plan = df._jdf.queryExecution().executedPlan().toString()
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert operator not in plan
    assert stored(spark) == before


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_rows_come_in_order(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    wanted = rows
    for column in reversed(ORDERED[name]):
        wanted = sorted(wanted, key=lambda r: r[column.lstrip("-")], reverse=column.startswith("-"))
    assert rows == wanted and len(rows) > 1


@pytest.mark.parametrize("name, table, scans", [("key_skew", "events", 1), ("pm_kpis", "events", 3), ("error_counts", "events", 1)])
def test_scans_of_a_table(spark, sf_dir, name, table, scans):
    """How often a query reads a table, the copies it stores included."""
    seen = []
    plain = session.materialise

    def watched(df, label):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    import peakflow.operators.audit as audit
    import peakflow.plans.traffic_queries as traffic

    with pytest.MonkeyPatch.context() as patch:
        for module in (audit, traffic):
            patch.setattr(module, "materialise", watched)
        df = QUERIES[name](spark, sf_dir)
    seen.append(df._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count(f"{table}.parquet") for p in seen) == scans


def test_every_query_has_a_twin():
    assert set(TWINS) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_document_lines_make_one_json_text(spark, sf_dir, tmp_path):
    import json

    from peakflow.operators.dashboard import write_document

    write_document(QUERIES["dashboard_record"](spark, sf_dir), str(tmp_path / "doc"))
    parts = sorted((tmp_path / "doc").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert len(document["hourly_orders"]) == 24 and document["summary"]["total_orders"] == 1000
    alerts = [a["pressure_ratio"] for a in document["alerts"]]
    assert alerts == sorted(alerts, reverse=True)


def test_entry_gives_alerts(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 11
    assert {r.severity for r in rows} == {"CRITICAL"}
