"""Queries on the event table as a feed of one-item orders."""

from pyspark.sql import functions as F

from peakflow.operators import audit, comparison, dashboard, demand, kpis, latest, pressure
from peakflow.operators.items import order_items
from peakflow.plans.registry import query, two_digits
from peakflow.session import materialise
from peakflow.sources import tables
from peakflow.sources.events import first_events, head_and_tail

# The test tables have flat traffic, so alerts are asked for at lower limits than the defaults.
THRESHOLD, MIN_ORDERS = 1.5, 3
DAY_THRESHOLD = 1.1

EVENTS = """
WITH ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(event_id AS VARCHAR) AS order_id,
    CAST(user_id AS VARCHAR) AS customer_id, event_type AS store_id, ts AS event_ts,
    'k' || json_extract_string(props, '$.k') AS product_id, 1 AS quantity, value AS unit_price,
    CAST(value AS DECIMAL(12,2)) AS line_total
  FROM events
), items AS (SELECT * FROM ev WHERE product_id IS NOT NULL AND quantity > 0 AND unit_price >= 0)"""


def _hourly_sql(store: str) -> str:
    return f""", hourly AS (
  SELECT date_trunc('hour', event_ts) AS hour_start, {store} AS store_id, count(DISTINCT order_id) AS order_count,
    CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(line_total) AS DECIMAL(18,2)) AS gross_sales
  FROM items GROUP BY ALL)"""


HOURLY = EVENTS + _hourly_sql("store_id")
# A feed in which the stores of failed events are unknown.
HOURLY_NULL_STORE = EVENTS + _hourly_sql("NULLIF(store_id, 'error')")


def _pressure_sql(baseline: str) -> str:
    return f""", pressure AS (
  SELECT *, order_count / baseline_order_count AS pressure_ratio
  FROM (SELECT *, {baseline} AS baseline_order_count FROM hourly))"""


MEAN = "avg(order_count) OVER (PARTITION BY store_id)"
FLOOR1 = "greatest(1.0, sum(order_count) OVER (PARTITION BY store_id) / 24)"
PRESSURE = HOURLY + _pressure_sql(MEAN)

MATRIX = (
    EVENTS
    + f""", cells AS (
  SELECT s.store_id, h.hour_no, count(ev.event_id) AS orders
  FROM (SELECT DISTINCT store_id FROM ev) s CROSS JOIN (SELECT unnest(range(24)) AS hour_no) h
    LEFT JOIN ev ON ev.store_id IS NOT DISTINCT FROM s.store_id AND hour(ev.event_ts) = h.hour_no
  GROUP BY ALL
), rated AS (
  SELECT *, orders / baseline AS ratio
  FROM (SELECT *, sum(orders) OVER (PARTITION BY store_id) / 24 AS baseline FROM cells)
), matrix AS (
  SELECT store_id, lpad(CAST(hour_no AS VARCHAR), 2, '0') || ':00' AS hour, orders,
    {two_digits('baseline')} AS baseline_orders, {two_digits('ratio')} AS pressure_ratio, hour_no, ratio
  FROM rated
), day_alerts AS (
  SELECT store_id, hour, orders, baseline_orders, pressure_ratio,
    CASE WHEN ratio >= {DAY_THRESHOLD} * 1.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
  FROM matrix WHERE orders >= {MIN_ORDERS} AND ratio >= {DAY_THRESHOLD}
), products AS (
  SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(line_total) AS DECIMAL(18,2)) AS gross_sales
  FROM items GROUP BY 1
), summary AS (
  SELECT CAST(sum(orders) AS BIGINT) AS total_orders,
    CAST(sum(orders) FILTER (hour_no IN (12, 13, 18, 19)) AS BIGINT) AS peak_orders,
    (SELECT CAST(sum(gross_sales) AS DECIMAL(28,2)) FROM products) AS total_sales,
    (SELECT count(*) FROM day_alerts) AS alert_count, count(*) FILTER (hour_no = 0) AS store_count
  FROM matrix
)"""
)


def _items(spark, sf_dir):
    return order_items(tables.replay_events(spark, sf_dir))


def _hourly(spark, sf_dir):
    return pressure.hourly_store_load(_items(spark, sf_dir))


def _hourly_null_store(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("store_id", F.nullif("store_id", F.lit("error")))
    return pressure.hourly_store_load_truncated(items)


def _pressure(spark, sf_dir):
    return pressure.with_pressure(_hourly(spark, sf_dir))


def _counts(spark, sf_dir):
    return dashboard.event_counts(tables.replay_events(spark, sf_dir))


def _matrix(spark, sf_dir):
    return dashboard.store_hour_matrix(_counts(spark, sf_dir))


def _products(spark, sf_dir):
    return dashboard.product_totals(_items(spark, sf_dir))


def _stored_totals(spark, sf_dir):
    """Counts and product totals, stored once: figures are drawn from these small tables."""
    return materialise(_counts(spark, sf_dir), "counts"), materialise(_products(spark, sf_dir), "products")


@query(HOURLY + " SELECT * FROM hourly")
def hourly_store_window(spark, sf_dir):
    return _hourly(spark, sf_dir)


@query(HOURLY + " SELECT * FROM hourly")
def hourly_store_trunc(spark, sf_dir):
    return pressure.hourly_store_load_truncated(_items(spark, sf_dir))


@query(PRESSURE + " SELECT * FROM pressure")
def pressure_window(spark, sf_dir):
    return _pressure(spark, sf_dir)


@query(HOURLY + _pressure_sql(FLOOR1) + " SELECT * FROM pressure")
def pressure_day_floor(spark, sf_dir):
    return pressure.with_pressure(_hourly(spark, sf_dir), "fixed_24_floor1")


@query(HOURLY_NULL_STORE + _pressure_sql(MEAN) + " SELECT * FROM pressure")
def pressure_null_store(spark, sf_dir):
    return pressure.with_pressure(_hourly_null_store(spark, sf_dir))


@query(
    HOURLY_NULL_STORE
    + """, usual AS (SELECT store_id, avg(order_count) AS baseline_order_count FROM hourly GROUP BY 1)
  SELECT h.*, baseline_order_count,
    CASE WHEN baseline_order_count > 0 THEN order_count / baseline_order_count ELSE 0.0 END AS pressure_ratio
  FROM hourly h LEFT JOIN usual u ON h.store_id = u.store_id"""
)
def pressure_join(spark, sf_dir):
    """Both sides of the join read the stored hourly table, so the events are read once."""
    return pressure.with_pressure_by_join(materialise(_hourly_null_store(spark, sf_dir), "hourly"))


@query(
    PRESSURE
    + f""" SELECT concat_ws('#', store_id, strftime(hour_start, '%Y%m%d%H')) AS alert_id, store_id, hour_start,
  order_count, baseline_order_count, pressure_ratio,
  CASE WHEN pressure_ratio >= {THRESHOLD} * 1.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  'Hourly order pressure ratio ' || {two_digits('pressure_ratio')} || ' exceeded threshold {THRESHOLD}' AS reason
  FROM pressure WHERE order_count >= {MIN_ORDERS} AND pressure_ratio >= {THRESHOLD}"""
)
def peak_alerts(spark, sf_dir):
    return pressure.in_report_order(pressure.peak_alerts(_pressure(spark, sf_dir), THRESHOLD, MIN_ORDERS))


@query(
    PRESSURE
    + f""" SELECT hour_start, store_id, order_count, units_sold, gross_sales, baseline_order_count, pressure_ratio,
  CAST(hour(hour_start) AS INTEGER) AS hour_of_day, CAST(dayofweek(hour_start) + 1 AS INTEGER) AS day_of_week,
  CAST(order_count >= {MIN_ORDERS} AND pressure_ratio >= {THRESHOLD} AS INTEGER) AS weak_label FROM pressure"""
)
def store_hour_features(spark, sf_dir):
    return pressure.store_hour_features(_pressure(spark, sf_dir), THRESHOLD, MIN_ORDERS)


@query(
    EVENTS
    + """ SELECT customer_id, event_id, store_id, event_ts FROM ev
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_ts DESC, event_id DESC, store_id DESC) = 1"""
)
def latest_event_per_user(spark, sf_dir):
    events = tables.replay_events(spark, sf_dir).select("customer_id", "event_id", "store_id", "event_ts")
    return latest.latest_per_key(events, ["customer_id"], ["event_ts", "event_id", "store_id"])


@query(
    EVENTS
    + """, by_hour AS (SELECT h.hour_no, count(ev.event_id) AS orders
    FROM (SELECT unnest(range(24)) AS hour_no) h LEFT JOIN ev ON hour(event_ts) = hour_no GROUP BY 1)
  SELECT lpad(CAST(hour_no AS VARCHAR), 2, '0') || ':00' AS hour, orders,
    greatest(3.0, orders / max(orders) OVER () * 100) AS bar_percent FROM by_hour"""
)
def hourly_orders(spark, sf_dir):
    return dashboard.hourly_orders(_counts(spark, sf_dir))


@query(MATRIX + " SELECT store_id, hour, orders, baseline_orders, pressure_ratio FROM matrix")
def store_hour_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select(*dashboard.MATRIX)


@query(MATRIX + " SELECT * FROM summary")
def dashboard_summary(spark, sf_dir):
    return dashboard.dashboard_summary(_matrix(spark, sf_dir), _products(spark, sf_dir), DAY_THRESHOLD, MIN_ORDERS)


@query(MATRIX + " SELECT * FROM day_alerts ORDER BY pressure_ratio DESC, store_id, hour LIMIT 12")
def top_alerts(spark, sf_dir):
    return dashboard.top_alerts(dashboard.matrix_alerts(_matrix(spark, sf_dir), DAY_THRESHOLD, MIN_ORDERS))


@query(
    MATRIX
    + """ SELECT store_id, hour, orders, baseline_orders, pressure_ratio FROM matrix
  ORDER BY pressure_ratio DESC, store_id, hour LIMIT 8"""
)
def top_pressure(spark, sf_dir):
    return dashboard.top_pressure(_matrix(spark, sf_dir))


@query(MATRIX + " SELECT * FROM products ORDER BY units_sold DESC, product_id LIMIT 8")
def top_products(spark, sf_dir):
    return dashboard.top_products(_products(spark, sf_dir))


@query(EVENTS + " SELECT store_id, count(*) AS orders FROM ev GROUP BY 1")
def store_totals(spark, sf_dir):
    return dashboard.store_totals(_counts(spark, sf_dir))


@query(
    MATRIX
    + """, best AS (SELECT * FROM products ORDER BY units_sold DESC, product_id LIMIT 8),
  driver AS (SELECT * FROM best ORDER BY gross_sales DESC, units_sold DESC, product_id LIMIT 1),
  ceiling AS (SELECT * FROM matrix WHERE hour_no IN (12, 13, 18, 19)
    ORDER BY pressure_ratio DESC, store_id, hour_no LIMIT 1),
  fresh AS (SELECT CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / 1000 / count(*) AS ms FROM events)
  SELECT 'peak_share_percent' AS kpi, NULL AS subject, round(peak_orders * 100 / total_orders, 4) AS value,
    CASE WHEN peak_orders * 100 / total_orders >= 60 THEN 'watch' ELSE 'ok' END AS state FROM summary
  UNION ALL SELECT 'pressure_ceiling', store_id || ' ' || hour, round(pressure_ratio, 4),
    CASE WHEN pressure_ratio >= 3.5 THEN 'critical' ELSE 'watch' END FROM ceiling
  UNION ALL SELECT 'peak_revenue', NULL, round(CAST(total_sales AS DOUBLE) / total_orders * peak_orders, 4), 'ok'
    FROM summary
  UNION ALL SELECT 'demand_driver', product_id, CAST(gross_sales AS DOUBLE), 'ok' FROM driver
  UNION ALL SELECT 'alert_burden', NULL, CAST(alert_count AS DOUBLE),
    CASE WHEN alert_count >= 8 THEN 'watch' ELSE 'ok' END FROM summary
  UNION ALL SELECT 'decision_freshness_ms', NULL, round(ms, 4), CASE WHEN ms <= 3000 THEN 'ok' ELSE 'watch' END
    FROM fresh"""
)
def pm_kpis(spark, sf_dir):
    counts, products = _stored_totals(spark, sf_dir)
    matrix = dashboard.store_hour_matrix(counts)
    rows = kpis.pm_kpis(matrix, products, tables.read_log(spark, sf_dir), DAY_THRESHOLD, MIN_ORDERS)
    return rows.withColumn("value", F.round("value", 4))


@query(
    MATRIX
    + """ SELECT role, metric, CAST(value AS DOUBLE) AS value FROM (
  SELECT *, (SELECT count(*) FROM matrix) AS cells, (SELECT count(*) FROM products) AS products FROM summary) s,
  LATERAL (VALUES ('pm', 'total_orders', CAST(total_orders AS DOUBLE)), ('pm', 'peak_orders', peak_orders),
    ('pm', 'gross_sales', total_sales), ('pm', 'peak_alerts', alert_count),
    ('data-engineer', 'raw_events', total_orders), ('data-engineer', 'pressure_rows', cells),
    ('data-engineer', 'serving_views', 5), ('data-engineer', 'live_stream', 0),
    ('ml-engineer', 'feature_rows', cells), ('ml-engineer', 'weak_labels', alert_count),
    ('ml-engineer', 'peak_examples', peak_orders), ('ml-engineer', 'product_signals', products),
    ('sre', 'critical_windows', alert_count), ('sre', 'peak_orders', peak_orders),
    ('sre', 'stores_monitored', store_count), ('sre', 'export_healthy', CASE WHEN cells > 0 THEN 1 ELSE 0 END),
    ('leadership', 'revenue', total_sales), ('leadership', 'orders', total_orders),
    ('leadership', 'peak_share_percent', round(peak_orders * 100 / total_orders, 4)),
    ('leadership', 'active_stores', store_count)) AS m(role, metric, value)"""
)
def role_metrics(spark, sf_dir):
    counts, products = _stored_totals(spark, sf_dir)
    rows = kpis.role_metrics(dashboard.store_hour_matrix(counts), products, 5, DAY_THRESHOLD, MIN_ORDERS)
    return rows.withColumn("value", F.round("value", 4))


SECTIONS = (
    MATRIX
    + """, sections AS (
  SELECT section, entry_key, CAST(weight AS DOUBLE) AS weight, CAST(entry AS VARCHAR) AS entry FROM (
  SELECT 'summary' AS section, '' AS entry_key, 0.0 AS weight, to_json(summary) AS entry FROM summary
  UNION ALL SELECT 'hourly_orders', hour, 0, to_json({'hour': hour, 'orders': n})
    FROM (SELECT hour, CAST(sum(orders) AS BIGINT) AS n FROM matrix GROUP BY 1)
  UNION ALL SELECT 'store_pressure', concat_ws('#', store_id, hour), 0, to_json({'store_id': store_id, 'hour': hour,
    'orders': orders, 'baseline_orders': baseline_orders, 'pressure_ratio': pressure_ratio}) FROM matrix
  UNION ALL (SELECT 'alerts', concat_ws('#', store_id, hour), pressure_ratio, to_json(day_alerts) FROM day_alerts
    ORDER BY pressure_ratio DESC, store_id, hour LIMIT 12)
  UNION ALL (SELECT 'top_products', product_id, units_sold, to_json(products) FROM products
    ORDER BY units_sold DESC, product_id LIMIT 8)
  UNION ALL SELECT 'store_totals', store_id, n, to_json({'store_id': store_id, 'orders': n})
    FROM (SELECT store_id, count(*) AS n FROM ev GROUP BY 1)))"""
)


def _sections(spark, sf_dir):
    counts, products = _stored_totals(spark, sf_dir)
    return dashboard.dashboard_sections(counts, products, DAY_THRESHOLD, MIN_ORDERS)


@query(SECTIONS + " SELECT * FROM sections")
def dashboard_doc(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(
    SECTIONS
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY weight DESC, entry_key) AS n,
    dense_rank() OVER (ORDER BY section) AS s FROM sections)
  SELECT section, 1 AS part, weight, entry_key, CASE WHEN n > 1 THEN ',' ELSE '' END || entry AS line FROM placed
  UNION ALL SELECT section, 0, 0, '', CASE WHEN s = 1 THEN '{' ELSE ',' END || '"' || section || '":'
    || CASE WHEN section = 'summary' THEN '' ELSE '[' END FROM placed WHERE n = 1
  UNION ALL SELECT section, 2, 0, '', CASE WHEN section = 'summary' THEN '' ELSE ']' END
    || CASE WHEN s = (SELECT max(s) FROM placed) THEN '}' ELSE '' END FROM placed WHERE n = 1"""
)
def dashboard_record(spark, sf_dir):
    """The document as the lines of a JSON file."""
    return dashboard.document_lines(materialise(_sections(spark, sf_dir), "sections"))


BASE_ORDERS, PEAK_MULTIPLIER, TOLERANCE = 400, 10, 0.25


@query(
    EVENTS
    + f""", by_hour AS (SELECT h.hour_no, count(ev.event_id) AS orders
    FROM (SELECT unnest(range(24)) AS hour_no) h LEFT JOIN ev ON hour(event_ts) = hour_no GROUP BY 1),
  banded AS (SELECT *, max(orders) FILTER (hour_no = 10) OVER () AS normal,
    CASE WHEN hour_no IN (12, 13, 18, 19) THEN 'peak' WHEN hour_no IN (11, 17, 20) THEN 'ramp'
    WHEN hour_no < 8 OR hour_no > 21 THEN 'off-peak' ELSE 'shoulder' END AS band FROM by_hour),
  expected AS (SELECT *, CAST(CASE band WHEN 'peak' THEN {BASE_ORDERS * PEAK_MULTIPLIER}
    WHEN 'ramp' THEN {BASE_ORDERS * 2} WHEN 'off-peak' THEN {BASE_ORDERS // 3} ELSE {BASE_ORDERS} END AS BIGINT)
    AS expected_orders FROM banded)
  SELECT lpad(CAST(hour_no AS VARCHAR), 2, '0') || ':00' AS hour, band, orders, expected_orders,
    CAST(sum(orders) OVER () AS BIGINT) AS run_orders, CAST(sum(expected_orders) OVER () AS BIGINT) AS run_expected,
    abs(sum(orders) OVER () - sum(expected_orders) OVER ()) <= sum(expected_orders) OVER () * {TOLERANCE} AS run_as_expected,
    band <> 'peak' OR orders >= normal * 5 AS peak_shape,
    abs(orders - expected_orders) <= expected_orders * {TOLERANCE} AS as_expected FROM expected"""
)
def band_volume(spark, sf_dir):
    return dashboard.volume_check(_counts(spark, sf_dir), BASE_ORDERS, PEAK_MULTIPLIER, TOLERANCE)


@query(
    EVENTS
    + """ SELECT store_id AS partition_key, count(*) AS records, count(*) / sum(count(*)) OVER () AS share,
  count(*) / avg(count(*)) OVER () AS skew FROM ev GROUP BY 1"""
)
def key_skew(spark, sf_dir):
    return audit.key_load(tables.replay_events(spark, sf_dir))


@query(
    PRESSURE
    + f""" SELECT 'raw_events' AS view, count(*) AS rows FROM ev
  UNION ALL SELECT 'order_item_events', count(*) FROM items
  UNION ALL SELECT 'product_demand_daily', count(*) FROM (
    SELECT DISTINCT CAST(event_ts AS DATE), store_id, product_id FROM items)
  UNION ALL SELECT 'store_order_pressure_hourly', count(*) FROM pressure
  UNION ALL SELECT 'peak_order_alerts', count(*) FROM pressure
    WHERE order_count >= {MIN_ORDERS} AND pressure_ratio >= {THRESHOLD}"""
)
def view_row_counts(spark, sf_dir):
    """Every view is counted while it is written; none is read for its count."""
    counts = audit.RowCounts()
    columns = ("order_id", "store_id", "product_id", "quantity", "line_total", "event_time")
    items = order_items(counts.of(tables.replay_events(spark, sf_dir), "raw_events")).select(*columns)
    items = materialise(counts.of(items, "order_item_events"), "items")
    materialise(counts.of(demand.product_demand_daily(items), "product_demand_daily"), "demand")
    load = pressure.with_pressure(pressure.hourly_store_load(items))
    load = materialise(counts.of(load, "store_order_pressure_hourly"), "pressure")
    materialise(counts.of(pressure.peak_alerts(load, THRESHOLD, MIN_ORDERS), "peak_order_alerts"), "alerts")
    return counts.read(spark)



@query(EVENTS + " SELECT event_id, store_id, event_ts FROM ev ORDER BY event_ts, event_id, store_id LIMIT 100")
def first_n_events(spark, sf_dir):
    events = tables.replay_events(spark, sf_dir).select("event_id", "store_id", "event_ts")
    return first_events(events, 100, ["event_ts", "event_id", "store_id"])


@query(
    EVENTS
    + """ (SELECT event_id, event_ts, 'head' AS part FROM ev ORDER BY event_ts, event_id LIMIT 1000)
  UNION ALL (SELECT event_id, event_ts, 'tail' FROM ev ORDER BY event_ts DESC, event_id DESC LIMIT 1000)"""
)
def head_tail_sample(spark, sf_dir):
    events = tables.replay_events(spark, sf_dir).select("event_id", "event_ts")
    return head_and_tail(events, 1000, ["event_ts", "event_id"])


def _lag_sql(name: str, hours: int) -> str:
    then = f"(SELECT p.order_count FROM hourly p WHERE p.store_id = h.store_id AND p.hour_start = h.hour_start - INTERVAL {hours} HOUR)"
    since = f"""(SELECT sum(p.order_count) FROM hourly p WHERE p.store_id = h.store_id
      AND p.hour_start >= h.hour_start - INTERVAL {hours} HOUR AND p.hour_start < h.hour_start)"""
    known = f"h.hour_start - INTERVAL {hours} HOUR >= h.opened"
    return f"""CASE WHEN {known} THEN CAST(coalesce({then}, 0) AS BIGINT) END AS prior_{name},
    CASE WHEN {known} THEN CAST(coalesce({since}, 0) AS DOUBLE) / {hours} END AS trailing_{name}"""


@query(
    HOURLY
    + f""", opened AS (SELECT *, min(hour_start) OVER (PARTITION BY store_id) AS opened FROM hourly),
  lagged AS (SELECT h.hour_start, h.store_id, h.order_count, {_lag_sql("day", 24)}, {_lag_sql("week", 168)} FROM opened h)
  SELECT *, CASE WHEN prior_day > 0 THEN CAST(order_count - prior_day AS DOUBLE) / prior_day END AS change_day,
    CASE WHEN prior_week > 0 THEN CAST(order_count - prior_week AS DOUBLE) / prior_week END AS change_week FROM lagged"""
)
def store_hour_lags(spark, sf_dir):
    """Orders of each store hour beside the same hour a day and a week before."""
    lagged = comparison.with_lags(_hourly(spark, sf_dir).select("hour_start", "store_id", "order_count"))
    return lagged


@query(
    EVENTS
    + """, mix AS (SELECT store_id, product_id,
    CAST(coalesce(sum(quantity) FILTER (hour(event_ts) IN (12, 13)), 0) AS BIGINT) AS a,
    CAST(coalesce(sum(quantity) FILTER (hour(event_ts) IN (18, 19)), 0) AS BIGINT) AS b FROM items GROUP BY ALL),
  shares AS (SELECT *, a / nullif(sum(a) OVER w, 0) AS p, b / nullif(sum(b) OVER w, 0) AS q, sum(a) OVER w AS ta, sum(b) OVER w AS tb
    FROM mix WHERE a + b > 0 WINDOW w AS (PARTITION BY store_id)),
  parts AS (SELECT *, (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS share FROM shares)
  SELECT store_id, CAST(max(ta) AS BIGINT) AS first_units, CAST(max(tb) AS BIGINT) AS second_units, count(*) AS products,
    round(sum(share), 6) AS divergence, first(product_id ORDER BY round(share, 9) DESC, product_id) AS drifting_product
  FROM parts GROUP BY store_id"""
)
def product_mix_drift(spark, sf_dir):
    """Distance of the product mix at lunch from that at dinner, per store."""
    drift = comparison.mix_drift(_items(spark, sf_dir), F.hour("event_time"))
    return drift.withColumn("divergence", F.round("divergence", 6))


HOT_SHARE, SHARDS = 0.1, 16


@query(
    EVENTS
    + f""", counted AS (SELECT store_id, count(*) AS n, (SELECT count(*) FROM ev) AS total FROM ev GROUP BY 1),
  plan AS (SELECT *, CAST(ceil(n * {SHARDS}.0 / total) AS INTEGER) AS salts FROM counted WHERE n >= total * {HOT_SHARE}),
  loads AS (SELECT store_id, CAST(event_id AS BIGINT) % salts AS salt, count(*) AS load FROM ev JOIN plan USING (store_id) GROUP BY 1, 2)
  SELECT store_id AS partition_key, n AS records, salts, true AS within_error, max(load) AS largest_load
  FROM plan JOIN loads USING (store_id) GROUP BY 1, 2, 3"""
)
def hot_key_plan(spark, sf_dir):
    """Heavy stream keys from merged daily sketches, counted exactly, and the load once they are salted."""
    events = tables.replay_events(spark, sf_dir).withColumn("day", F.to_date("event_ts"))
    daily = materialise(audit.key_sketches(events, ["day"]), "sketches")
    heavy = audit.heavy_keys(daily, HOT_SHARE)
    plan = materialise(audit.hot_key_plan(events, heavy, SHARDS), "plan").where(F.col("records") >= F.col("all_records") * HOT_SHARE)
    loads = audit.salted(events, plan, F.col("event_id").cast("long")).groupBy("store_id", "shard_key").agg(F.count("*").alias("load"))
    largest = loads.groupBy(F.col("store_id").alias("partition_key")).agg(F.max("load").alias("largest_load"))
    within = F.abs(F.col("estimate") - F.col("records")) <= F.col("error")
    return plan.withColumn("within_error", within).join(largest, "partition_key").select(
        "partition_key", "records", "salts", "within_error", "largest_load"
    )
