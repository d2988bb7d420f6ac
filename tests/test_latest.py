import decimal

from cases import dicts, event, events_df
from peakflow.operators import latest
from peakflow.operators.items import order_items, order_total


def orders(spark, records):
    return {r["order_id"]: r for r in dicts(latest.latest_orders(events_df(spark, records)))}


def test_later_event_wins(spark):
    records = [
        event("e2", time="2024-01-01T10:00:00Z", event_type="PAID"),
        event("e1", time="2024-01-01T11:00:00Z", event_type="DONE"),
    ]
    assert orders(spark, records)["o1"]["order_status"] == "DONE"


def test_higher_event_id_breaks_a_tie(spark):
    records = [event("e10", event_type="A"), event("e9", event_type="B")]  # ids are text
    assert orders(spark, records)["o1"]["order_status"] == "B"


def test_order_total_folds_items(spark):
    two = event(items=(("p1", 1, 4500.0), ("p1", 2, 4500.0)))
    cases = [
        (two, decimal.Decimal("13500.00")),
        (event("e2", "o2", items=()), decimal.Decimal("0.00")),
        (event("e3", "o3", items=None or [("p", None, 1.0)]), None),
        ({**event("e4", "o4"), "items": None}, None),
        (event("e5", "o5", items=(("p", 3, 99_999_999_999.0),)), None),  # does not fit
    ]
    got = orders(spark, [r for r, _ in cases])
    assert [got[r["order_id"]]["order_total"] for r, _ in cases] == [total for _, total in cases]


def test_last_position_of_a_repeated_product_survives(spark):
    repeated = event(items=(("p1", 1, 1.0), ("p2", 5, 1.0), ("p1", 2, 1.0)))
    rows = {r["product_id"]: r["quantity"] for r in dicts(latest.latest_order_items(events_df(spark, [repeated])))}
    assert rows == {"p1": 2, "p2": 5}
    assert order_items(events_df(spark, [repeated])).count() == 3  # the flat form keeps every line


def test_unsound_items_are_left_out_of_the_flat_form(spark):
    mixed = event(items=(("p1", 1, 1.0), (None, 1, 1.0), ("p2", 0, 1.0), ("p3", 1, -1.0), ("p4", 1, 0.0)))
    rows = dicts(order_items(events_df(spark, [mixed])))
    assert [(r["product_id"], r["item_no"]) for r in rows] == [("p1", 0), ("p4", 4)]
    loaded = dicts(latest.latest_order_items(events_df(spark, [mixed])))
    assert {r["product_id"] for r in loaded} == {"p1", "p2", "p3", "p4"}


def test_hot_key_is_reduced_before_the_shuffle(spark, sf_dir):
    df = latest.latest_orders(events_df(spark, [event()]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan and "Final" in plan


def test_empty_list_folds_to_zero(spark):
    df = events_df(spark, [event(items=())]).select(order_total().alias("t"))
    assert df.first().t == 0


def test_first_delivery_stays(spark):
    records = [event("e1", time="2024-01-01T10:05:00Z"), event("e1", time="2024-01-01T10:00:00Z"), event("e2")]
    kept = dicts(latest.earliest_delivery(events_df(spark, records)))
    assert sorted((r["event_id"], r["event_time"]) for r in kept) == [
        ("e1", "2024-01-01T10:00:00Z"),
        ("e2", "2024-01-01T10:00:00Z"),
    ]
