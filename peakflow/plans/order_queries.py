"""Queries on order events made of orders and their lines."""

from pyspark.sql import functions as F

from peakflow.operators import demand, latest, quality
from peakflow.operators.items import order_items as items_of
from peakflow.plans.registry import query
from peakflow.schemas import ORDER_EVENT
from peakflow.session import scratch_path
from peakflow.sources import tables
from peakflow.sources.events import stamped, with_event_ts, with_keys
from peakflow.sources.lines import land_lines

RUN_TS = "2024-02-01 00:00:00"

HEADERS = "headers AS (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"
BARE = "FROM headers WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
SHIPPED = (
    "FROM lineitem JOIN headers ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey"
)
EVENT_ID = "l_orderkey || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || l_linenumber || '-' || l_partkey"

LINE_EVENTS = f"""
WITH {HEADERS}, ev AS (
  SELECT {EVENT_ID} AS event_id, CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
    CAST(c_nationkey AS VARCHAR) AS store_id, l_linestatus AS event_type, l_shipdate AS event_time,
    'part-' || l_partkey AS product_0, CAST(l_quantity AS INTEGER) AS quantity_0, p_retailprice AS price_0,
    'supp-' || l_suppkey AS product_1, 1 AS quantity_1, l_extendedprice AS price_1
  {SHIPPED}
), bare AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_orderkey AS VARCHAR) AS order_id,
    CAST(o_custkey AS VARCHAR) AS customer_id, CAST(c_nationkey AS VARCHAR) AS store_id,
    o_orderstatus AS event_type, o_orderdate AS event_time
  {BARE}
), items AS (
  SELECT event_id, order_id, customer_id, store_id, event_type, event_time, 0 AS item_no, product_0 AS product_id,
    quantity_0 AS quantity, price_0 AS unit_price, CAST(quantity_0 * price_0 AS DECIMAL(12,2)) AS line_total FROM ev
  UNION ALL
  SELECT event_id, order_id, customer_id, store_id, event_type, event_time, 1, product_1,
    quantity_1, price_1, CAST(quantity_1 * price_1 AS DECIMAL(12,2)) FROM ev
)"""

RAW_EVENTS = f"""
WITH {HEADERS}, raw AS (
  SELECT {EVENT_ID} AS event_id, CASE WHEN l_returnflag <> 'R' THEN CAST(o_orderkey AS VARCHAR) END AS order_id,
    CAST(o_custkey AS VARCHAR) AS customer_id, CAST(c_nationkey AS VARCHAR) AS store_id,
    NULLIF(o_orderstatus, 'P') AS event_type,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN l_shipdate END AS event_ts,
    true AS has_items, CAST(l_quantity - 5 AS INTEGER) AS quantity,
    CAST(p_retailprice - 905 AS DECIMAL(12,2)) AS unit_price, l_extendedprice AS supply_price
  {SHIPPED}
  UNION ALL
  SELECT NULLIF(CAST(o_orderkey AS VARCHAR), '0'), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR),
    CAST(c_nationkey AS VARCHAR), NULLIF(o_orderstatus, 'P'),
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END, false, NULL, NULL, NULL
  {BARE}
), faults AS (
  SELECT *, event_id IS NULL AS missing_event_id, order_id IS NULL AS missing_order_id,
    event_type IS NULL AS missing_event_type, event_ts IS NULL AS invalid_event_time,
    NOT has_items AS missing_items,
    NOT coalesce(quantity > 0 AND unit_price >= 0 AND supply_price >= 0, false) AS invalid_items
  FROM raw
), flagged AS (
  SELECT *, NOT (missing_event_id OR missing_order_id OR missing_event_type OR invalid_event_time
    OR missing_items OR invalid_items) AS is_valid
  FROM faults
)"""

FLAG_LIST = ", ".join(quality.FLAGS)


def _raw(spark, sf_dir):
    return with_event_ts(tables.raw_line_events(spark, sf_dir))


def _flagged(spark, sf_dir):
    return quality.flag_events(_raw(spark, sf_dir))


def _items(spark, sf_dir):
    return items_of(tables.line_events(spark, sf_dir, with_bare_orders=False))


def _demand(spark, sf_dir):
    return demand.product_demand_daily(_items(spark, sf_dir))


@query(
    RAW_EVENTS
    + """ SELECT event_id, order_id, customer_id, store_id, event_type, event_ts FROM raw
    WHERE event_id IS NOT NULL AND order_id IS NOT NULL AND event_ts IS NOT NULL"""
)
def strict_events(spark, sf_dir):
    return with_keys(_raw(spark, sf_dir)).select(
        "event_id", "order_id", "customer_id", "store_id", "event_type", "event_ts"
    )


@query(
    LINE_EVENTS
    + """ SELECT event_id, order_id, customer_id, store_id, event_type, event_time, item_no, product_id, quantity,
    unit_price, line_total FROM items WHERE product_id IS NOT NULL AND quantity > 0 AND unit_price >= 0"""
)
def order_items(spark, sf_dir):
    return _items(spark, sf_dir)


@query(RAW_EVENTS + f" SELECT event_id, customer_id, {FLAG_LIST}, is_valid FROM flagged")
def quality_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("event_id", "customer_id", *quality.FLAGS, "is_valid")


@query(
    RAW_EVENTS
    + """ SELECT count(*) AS total_records, count(*) FILTER (NOT is_valid) AS invalid_records,
    CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (NOT is_valid) / count(*) END AS error_ratio FROM flagged"""
)
def quality_totals(spark, sf_dir):
    return quality.quality_totals(_flagged(spark, sf_dir))


@query(
    RAW_EVENTS
    + " SELECT "
    + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in quality.FLAGS)
    + " FROM flagged WHERE NOT is_valid"
)
def quality_summary(spark, sf_dir):
    return quality.quality_summary(_flagged(spark, sf_dir))


@query(
    RAW_EVENTS
    + " SELECT event_id, order_id, anomaly_type, event_ts AS event_time, detected_at FROM ("
    + " UNION ALL ".join(
        f"SELECT event_id, order_id, '{f}' AS anomaly_type, event_ts, TIMESTAMP '{RUN_TS}' AS detected_at "
        f"FROM flagged WHERE {f}"
        for f in quality.FLAGS
    )
    + ")"
)
def anomaly_events(spark, sf_dir):
    found = quality.anomaly_events(_flagged(spark, sf_dir), F.lit(RUN_TS).cast("timestamp"))
    return found.select("event_id", "order_id", "anomaly_type", "event_time", "detected_at")


@query(
    RAW_EVENTS
    + """ SELECT event_id, order_id, customer_id, errors FROM (
    SELECT event_id, order_id, customer_id, array_to_string(list_sort(list_filter([
      CASE WHEN event_id IS NULL THEN 'event_id:required' END,
      CASE WHEN order_id IS NULL THEN 'order_id:required' END,
      CASE WHEN event_type IS NULL THEN 'event_type:required' END,
      CASE WHEN quantity < 1 THEN 'items[0].quantity:minimum' END,
      CASE WHEN unit_price < 0 THEN 'items[0].unit_price:minimum' END], lambda e: e IS NOT NULL)), ';') AS errors
    FROM raw) WHERE errors <> ''"""
)
def schema_violations(spark, sf_dir):
    """The raw feed as JSON lines, checked against the event contract; NULL fields are absent keys.

    The lines are checked where they are read: files hold a bounded number of lines, whatever ids they hold,
    so no text is shuffled, and only what is broken goes on.
    """
    lines = F.to_json(F.struct(*ORDER_EVENT.fieldNames())).alias("value")
    path = scratch_path(spark, "raw-lines")
    land_lines(tables.raw_line_events(spark, sf_dir).select(lines), path)
    found = quality.contract_violations(spark.read.text(path))
    ids = [F.get_json_object("value", f"$.{c}").alias(c) for c in ("event_id", "order_id", "customer_id")]
    return found.select(*ids, F.array_join("errors", ";").alias("errors"))


@query(
    LINE_EVENTS
    + """, states AS (
  SELECT event_id, order_id, customer_id, store_id, event_type, event_time,
    CAST(quantity_0 * price_0 AS DECIMAL(12,2)) + CAST(quantity_1 * price_1 AS DECIMAL(12,2)) AS order_total FROM ev
  UNION ALL SELECT event_id, order_id, customer_id, store_id, event_type, event_time, NULL FROM bare
) SELECT order_id, customer_id, store_id, event_type AS order_status, CAST(order_total AS DECIMAL(12,2)) AS order_total,
  event_time FROM states
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY event_time DESC, event_id DESC, order_total DESC,
    event_type DESC, store_id DESC, customer_id DESC) = 1"""
)
def latest_orders(spark, sf_dir):
    return latest.latest_orders(tables.line_events(spark, sf_dir))


@query(
    LINE_EVENTS
    + """ SELECT order_id, store_id, product_id, quantity, CAST(unit_price AS DECIMAL(12,2)) AS unit_price, line_total,
  event_time FROM items WHERE product_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY order_id, product_id ORDER BY event_time DESC, event_id DESC, item_no DESC,
    quantity DESC, items.unit_price DESC) = 1"""
)
def latest_order_items(spark, sf_dir):
    return latest.latest_order_items(tables.line_events(spark, sf_dir, with_bare_orders=False))


DEMAND = (
    LINE_EVENTS
    + """, demand AS (
  SELECT CAST(event_time AS DATE) AS demand_date, store_id, product_id, count(DISTINCT order_id) AS order_count,
    CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(line_total) AS DECIMAL(18,2)) AS gross_sales
  FROM items WHERE product_id IS NOT NULL AND quantity > 0 AND unit_price >= 0 GROUP BY ALL)"""
)
SUMS = """CAST(sum(order_count) AS BIGINT) AS order_count, CAST(sum(units_sold) AS BIGINT) AS units_sold,
  CAST(sum(gross_sales) AS DECIMAL(18,2)) AS gross_sales"""


@query(DEMAND + " SELECT * FROM demand")
def product_demand_daily(spark, sf_dir):
    return _demand(spark, sf_dir)


@query(DEMAND + f" SELECT demand_date, product_id, {SUMS} FROM demand GROUP BY ALL")
def product_leaderboard(spark, sf_dir):
    return demand.product_leaderboard(_demand(spark, sf_dir))


@query(
    DEMAND
    + f""", sums AS (SELECT demand_date, store_id, {SUMS} FROM demand GROUP BY ALL),
  orders_once AS (SELECT CAST(event_time AS DATE) AS demand_date, store_id, count(DISTINCT order_id) AS distinct_orders
    FROM items WHERE product_id IS NOT NULL AND quantity > 0 AND unit_price >= 0 GROUP BY ALL)
  SELECT s.*, distinct_orders FROM sums s JOIN orders_once o
    ON s.demand_date = o.demand_date AND s.store_id IS NOT DISTINCT FROM o.store_id"""
)
def store_daily_summary(spark, sf_dir):
    return demand.store_daily_summary_from_items(_items(spark, sf_dir))


@query(
    LINE_EVENTS
    + f""", states AS (
  SELECT event_id, order_id, event_type, event_time,
    CAST(quantity_0 * price_0 AS DECIMAL(12,2)) + CAST(quantity_1 * price_1 AS DECIMAL(12,2)) AS order_total FROM ev
  UNION ALL SELECT event_id, order_id, event_type, event_time, NULL FROM bare
), newest AS (SELECT * FROM states
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY event_time DESC, event_id DESC, order_total DESC,
    event_type DESC) = 1)
SELECT event_type AS order_status, count(*) AS order_count, CAST(sum(order_total) AS DECIMAL(28,2)) AS gross_sales,
  TIMESTAMP '{RUN_TS}' AS latest_update_at FROM newest GROUP BY 1"""
)
def order_status_summary(spark, sf_dir):
    events = stamped(tables.line_events(spark, sf_dir), RUN_TS)
    return demand.order_status_summary(latest.latest_orders(events))
