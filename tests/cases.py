"""Small hand-written inputs."""

import json

from pyspark.sql import functions as F

from peakflow.schemas import ORDER_EVENT
from peakflow.sources.events import with_event_ts


def event(event_id="e1", order_id="o1", store="s1", time="2024-01-01T10:00:00Z", items=(("p1", 1, 10.0),), **more):
    record = {
        "event_id": event_id,
        "order_id": order_id,
        "customer_id": "c1",
        "store_id": store,
        "event_type": "PAID",
        "event_time": time,
        "items": [dict(zip(("product_id", "quantity", "unit_price"), i)) for i in items],
    }
    record.update(more)
    return record


def events_df(spark, records):
    return with_event_ts(spark.createDataFrame([_row(r) for r in records], ORDER_EVENT))


def _row(record):
    items = record.get("items")
    if items is not None:
        items = [(i.get("product_id"), i.get("quantity"), i.get("unit_price")) for i in items]
    return tuple(items if f == "items" else record.get(f) for f in ORDER_EVENT.fieldNames())


def write_jsonl(path, lines):
    text = "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines)
    path.write_text(text + "\n", encoding="utf-8")
    return str(path)


def hourly_df(spark, rows):
    """Rows (store, hour text, orders) as an hourly load table."""
    df = spark.createDataFrame(rows, "store_id string, hour string, order_count long")
    return df.select(
        F.to_timestamp("hour").alias("hour_start"),
        "store_id",
        "order_count",
        F.col("order_count").alias("units_sold"),
        F.col("order_count").cast("decimal(18,2)").alias("gross_sales"),
    )


def dicts(df):
    return [r.asDict() for r in df.collect()]
