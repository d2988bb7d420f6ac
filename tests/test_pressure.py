import json

import pytest
from pyspark.sql import functions as F

from cases import dicts, event, events_df, hourly_df
from peakflow.operators import dashboard, demand, pressure
from peakflow.operators.items import order_items
from peakflow.operators.pressure import severity

H = "2024-01-01 {:02d}:00:00".format


def test_null_store_has_a_baseline_in_the_window_form_only(spark):
    hourly = hourly_df(spark, [(None, H(1), 2), (None, H(2), 4), ("s", H(1), 5)])
    window = {(r.store_id, r.order_count): r for r in pressure.with_pressure(hourly).collect()}
    join = {(r.store_id, r.order_count): r for r in pressure.with_pressure_by_join(hourly).collect()}
    assert window[(None, 4)].baseline_order_count == 3.0 and window[(None, 2)].pressure_ratio == pytest.approx(2 / 3)
    assert join[(None, 4)].baseline_order_count is None and join[(None, 4)].pressure_ratio == 0.0
    assert join[("s", 5)].pressure_ratio == window[("s", 5)].pressure_ratio == 1.0


def test_baselines(spark):
    hourly = hourly_df(spark, [("s", H(h), 12) for h in range(6)] + [("tiny", H(0), 2)])

    def of(kind, store):
        rows = pressure.with_pressure(hourly, kind).where(F.col("store_id") == store)
        return rows.first().baseline_order_count

    assert of("active_hours", "s") == 12.0
    assert of("fixed_24", "s") == 3.0
    assert of("fixed_24", "tiny") == pytest.approx(2 / 24)
    assert of("fixed_24_floor1", "tiny") == 1.0
    with pytest.raises(ValueError):
        pressure.with_pressure(hourly, "median")


def test_alert_limits_are_inclusive_and_grade_rises_at_one_and_a_half(spark):
    rows = [("a", 20, 2.5), ("b", 19, 9.0), ("c", 99, 2.49), ("d", 20, 3.75), ("e", 20, 3.74)]
    df = spark.createDataFrame(rows, "store_id string, order_count long, pressure_ratio double").select(
        F.lit(H(18)).cast("timestamp").alias("hour_start"), "*", F.lit(8.0).alias("baseline_order_count")
    )
    alerts = {r["store_id"]: r for r in dicts(pressure.peak_alerts(df))}
    assert {s: a["severity"] for s, a in alerts.items()} == {"a": "WARNING", "d": "CRITICAL", "e": "WARNING"}
    assert alerts["a"]["alert_id"] == "a#2024010118"
    assert alerts["e"]["reason"] == "Hourly order pressure ratio 3.74 exceeded threshold 2.5"
    features = {r["store_id"]: r["weak_label"] for r in dicts(
        pressure.store_hour_features(df.withColumns({"units_sold": F.lit(1), "gross_sales": F.lit(1)}))
    )}
    assert features == {"a": 1, "b": 0, "c": 0, "d": 1, "e": 1}


def test_active_baseline_averages_to_one(spark, sf_dir):
    from peakflow.plans.traffic_queries import pressure_window

    means = pressure_window(spark, sf_dir).groupBy("store_id").agg(F.avg("pressure_ratio").alias("m")).collect()
    assert all(r.m == pytest.approx(1.0) for r in means)


def test_order_with_two_products_counts_twice_in_the_roll_up(spark):
    items = order_items(events_df(spark, [event(items=(("p1", 1, 1.0), ("p2", 1, 2.0)))]))
    daily = demand.product_demand_daily(items)
    assert demand.store_daily_summary(daily).first().order_count == 2
    both = demand.store_daily_summary_from_items(items).first()
    assert (both.order_count, both.distinct_orders, both.units_sold) == (2, 1, 2)


def test_both_hour_forms_agree(spark):
    items = order_items(
        events_df(spark, [event(f"e{i}", f"o{i % 7}", time=f"2024-01-0{1 + i % 3}T{i % 24:02d}:59:59Z") for i in range(60)])
    )
    a = sorted(map(tuple, pressure.hourly_store_load(items).collect()))
    b = sorted(map(tuple, pressure.hourly_store_load_truncated(items).collect()))
    assert a == b and sum(r[2] for r in a) > 0


def test_matrix_is_dense(spark):
    events = events_df(spark, [event("e1"), event("e2"), event("e3", store=None, time="2024-01-01T23:10:00Z")])
    matrix = dashboard.store_hour_matrix(dashboard.event_counts(events))
    rows = dicts(matrix)
    assert len(rows) == 48
    assert sum(r["orders"] for r in rows) == 3
    assert {r["baseline_orders"] for r in rows if r["store_id"] == "s1"} == {0.08}
    assert {r["ratio"] for r in rows if r["orders"] == 2} == {24.0}
    active = dashboard.store_hour_matrix(dashboard.event_counts(events), "active_hours")
    assert {r["baseline_orders"] for r in dicts(active) if r["store_id"] == "s1"} == {2.0}


def test_no_events_still_give_24_hours(spark):
    counts = dashboard.event_counts(events_df(spark, [event()]).limit(0))
    assert [r["orders"] for r in dicts(dashboard.hourly_orders(counts))] == [0] * 24


def test_expected_day_adds_up(spark):
    """Ten off-peak hours, seven shoulder, three ramp and four peak hours of the published replay."""
    from peakflow.functions.bands import expected_volume, traffic_band

    hours = spark.range(24).select(F.col("id").cast("int").alias("h"))
    rows = hours.select(expected_volume(F.col("h"), 5000, 10).alias("n"), traffic_band(F.col("h")).alias("b")).collect()
    assert sum(r.n for r in rows) == 281_660
    assert sorted(r.b for r in rows).count("peak") == 4
    assert {r.n for r in rows if r.b == "off-peak"} == {1666}
    assert round(101_386 / 24, 2) == 4224.42


def document(sections):
    lines = dashboard.document_lines(sections).orderBy("section", "part", F.desc("weight"), "entry_key").collect()
    return json.loads("".join(r.line for r in lines))


def test_an_unknown_ratio_is_a_warning(spark):
    rows = spark.createDataFrame([(None,), (3.75,), (3.74,)], "ratio double")
    graded = rows.select(severity(F.col("ratio"), 2.5).alias("s")).collect()
    assert [r.s for r in graded] == ["WARNING", "CRITICAL", "WARNING"]


def test_document_holds_all_sections(spark):
    events = events_df(spark, [event(f"e{i}", f"o{i}", time="2024-01-01T12:00:00Z") for i in range(30)])
    counts, totals = dashboard.event_counts(events), dashboard.product_totals(order_items(events))
    sections = dashboard.dashboard_sections(counts, totals)
    doc = document(sections)
    assert doc["summary"] == {
        "total_orders": 30, "peak_orders": 30, "total_sales": 300.0, "alert_count": 1, "store_count": 1
    }
    assert len(doc["hourly_orders"]) == len(doc["store_pressure"]) == 24
    assert doc["alerts"][0]["severity"] == "CRITICAL" and doc["top_products"][0]["units_sold"] == 30


def test_lists_of_the_document_keep_their_order(spark):
    sizes = {"a": 3, "b": 9, "c": 9}
    records = [
        event(f"{s}{i}", f"{s}{i}", store=s, time="2024-01-01T12:00:00Z", items=((f"p-{s}", 1, 1.0),))
        for s, n in sizes.items()
        for i in range(n)
    ]
    events = events_df(spark, records)
    sections = dashboard.dashboard_sections(
        dashboard.event_counts(events), dashboard.product_totals(order_items(events)), 2.5, 2
    )
    doc = document(sections)
    assert [t["store_id"] for t in doc["store_totals"]] == ["b", "c", "a"]
    assert [t["product_id"] for t in doc["top_products"]] == ["p-b", "p-c", "p-a"]
    assert [t["store_id"] for t in doc["alerts"]] == ["a", "b", "c"]


def test_volume_check_of_a_peaked_day(spark):
    counts = spark.createDataFrame(
        [("s", h, n) for h, n in {10: 100, 12: 500, 13: 499, 18: 1000, 19: 1000, 11: 200, 3: 33}.items()],
        "store_id string, hour int, events long",
    )
    rows = {r["hour"]: r for r in dicts(dashboard.volume_check(counts, 100, 10))}
    assert [h for h, r in rows.items() if not r["peak_shape"]] == ["13:00"]
    assert {h for h, r in rows.items() if r["as_expected"]} == {"03:00", "10:00", "11:00", "18:00", "19:00"}
    totals = {(r["run_orders"], r["run_expected"], r["run_as_expected"]) for r in rows.values()}
    assert totals == {(3332, 5630, False)}
    full = [("s", h, n) for h, n in enumerate([33] * 8 + [100] * 3 + [200, 1000, 1000] + [100] * 3 + [200, 1000, 1000, 200, 100] + [33] * 2)]
    df = spark.createDataFrame(full, "store_id string, hour int, events long")
    assert {r["run_as_expected"] for r in dicts(dashboard.volume_check(df, 100, 10))} == {True}
