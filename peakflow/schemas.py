"""Record and table layouts."""

from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.DoubleType()),
    ]
)

# Every field is nullable: the file sources relax nullability anyway, and the
# quality rules have to see the gaps.
ORDER_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("items", T.ArrayType(ITEM)),
    ]
)

PUBLISHED_EVENT = T.StructType(ORDER_EVENT.fields + [T.StructField("_published_at_utc", T.StringType())])

# Column names and types of the stored tables.
TABLE_DDL = {
    "orders_latest": (
        "order_id STRING, customer_id STRING, store_id STRING, order_status STRING, "
        "order_total DECIMAL(12,2), event_time TIMESTAMP, updated_at TIMESTAMP"
    ),
    "order_items_latest": (
        "order_id STRING, store_id STRING, product_id STRING, quantity INT, "
        "unit_price DECIMAL(12,2), line_total DECIMAL(12,2), event_time TIMESTAMP, updated_at TIMESTAMP"
    ),
    "product_demand_daily": (
        "demand_date DATE, store_id STRING, product_id STRING, order_count BIGINT, "
        "units_sold BIGINT, gross_sales DECIMAL(18,2), updated_at TIMESTAMP"
    ),
    "order_anomaly_events": (
        "event_id STRING, order_id STRING, anomaly_type STRING, severity STRING, "
        "reason STRING, event_time TIMESTAMP, detected_at TIMESTAMP"
    ),
    "store_order_pressure_hourly": (
        "hour_start TIMESTAMP, store_id STRING, order_count BIGINT, units_sold BIGINT, "
        "gross_sales DECIMAL(18,2), baseline_order_count DOUBLE, pressure_ratio DOUBLE, updated_at TIMESTAMP"
    ),
    "peak_order_alerts": (
        "alert_id STRING, store_id STRING, hour_start TIMESTAMP, order_count BIGINT, "
        "baseline_order_count DOUBLE, pressure_ratio DOUBLE, severity STRING, reason STRING, detected_at TIMESTAMP"
    ),
}

# Sums that demand and hourly load are kept up by.
FACT_SUMS = (
    "orders BIGINT, units BIGINT, unit_lines BIGINT, sales DECIMAL(28,2), sales_lines BIGINT, updated_at TIMESTAMP"
)

PUBLISH_PROGRESS = (
    "run_id STRING, batch_seq BIGINT, timestamp_utc TIMESTAMP, elapsed_seconds DECIMAL(18,3), event_hour STRING, "
    "batch_records BIGINT, published_records BIGINT, records_per_second DOUBLE, transient_failed_records BIGINT"
)

READ_LATENCY = (
    "read_timestamp_utc STRING, event_hour STRING, records_read BIGINT, publish_to_read_latency_ms STRING, "
    "arrival_latency_ms STRING, partition_key STRING, event_id STRING"
)


def column_names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]
