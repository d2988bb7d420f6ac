"""Key figures for product management and per role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakflow.functions.bands import is_peak
from peakflow.functions.money import grand_total
from peakflow.operators.dashboard import matrix_summary, top_products
from peakflow.operators.pressure import MIN_ORDERS, PEAK_THRESHOLD

# Limits at which a figure changes its state.
PEAK_SHARE_WATCH = 60
PRESSURE_CRITICAL = 3.5
ALERT_WATCH = 8
FRESHNESS_TARGET_MS = 3000


def _facts(
    matrix: DataFrame, totals: DataFrame, latencies: DataFrame, threshold: float, min_orders: int
) -> DataFrame:
    """Everything the figures need in one row, from three small aggregates side by side."""
    # Highest pressure in a peak hour; the first store and hour win a tie.
    peak_cell = F.when(is_peak(F.col("hour_no")), F.struct(-F.col("pressure_ratio"), "store_id", "hour_no"))
    load = matrix.agg(
        *matrix_summary(matrix, threshold, min_orders),
        F.min_by(F.struct("store_id", "hour", "pressure_ratio"), peak_cell).alias("ceiling"),
    )
    money = totals.agg(grand_total(F.col("gross_sales")).alias("total_sales"))
    # Best seller by money among the best sellers by units; the more units win a tie.
    rank = F.struct(-F.col("gross_sales"), -F.col("units_sold"), "product_id")
    driver = top_products(totals).agg(F.min_by(F.struct("product_id", "gross_sales"), rank).alias("driver"))
    fresh = latencies.agg(F.avg(F.col("publish_to_read_latency_ms").try_cast("decimal(18,2)")).alias("freshness_ms"))
    rows = load
    for part in (money, driver, fresh):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def _state(bad: Column, name: str, otherwise: str) -> Column:
    return F.when(bad, name).otherwise(otherwise)


def pm_kpis(
    matrix: DataFrame, totals: DataFrame, latencies: DataFrame,
    threshold: float = PEAK_THRESHOLD, min_orders: int = MIN_ORDERS,
) -> DataFrame:
    """Six rows: figure, what it is about, value and state. Freshness is measured, and NULL without a log."""
    facts = _facts(matrix, totals, latencies, threshold, min_orders)
    share = _share(F.col("peak_orders") * 100, F.col("total_orders"))
    ceiling = F.col("ceiling.pressure_ratio")
    at_stake = _share(F.col("total_sales").cast("double"), F.col("total_orders")) * F.col("peak_orders")
    freshness = F.col("freshness_ms").cast("double")
    rows = [
        ("peak_share_percent", F.lit(None), share, _state(share >= PEAK_SHARE_WATCH, "watch", "ok")),
        (
            "pressure_ceiling",
            F.concat_ws(" ", "ceiling.store_id", "ceiling.hour"),
            ceiling,
            _state(ceiling >= PRESSURE_CRITICAL, "critical", "watch"),
        ),
        ("peak_revenue", F.lit(None), at_stake, F.lit("ok")),
        ("demand_driver", F.col("driver.product_id"), F.col("driver.gross_sales"), F.lit("ok")),
        ("alert_burden", F.lit(None), F.col("alert_count"), _state(F.col("alert_count") >= ALERT_WATCH, "watch", "ok")),
        (
            "decision_freshness_ms",
            F.lit(None),
            freshness,
            F.when(freshness.isNotNull(), _state(freshness <= FRESHNESS_TARGET_MS, "ok", "watch")),
        ),
    ]
    entries = [
        F.struct(
            F.lit(name).alias("kpi"),
            subject.cast("string").alias("subject"),
            value.cast("double").alias("value"),
            state.alias("state"),
        )
        for name, subject, value, state in rows
    ]
    return facts.select(F.inline(F.array(*entries)))


def role_metrics(
    matrix: DataFrame, totals: DataFrame, views: int,
    threshold: float = PEAK_THRESHOLD, min_orders: int = MIN_ORDERS, live: bool = False,
) -> DataFrame:
    """What each role looks at, as (role, metric, value). Counts are counted, switches are 0 or 1."""
    load = matrix.agg(*matrix_summary(matrix, threshold, min_orders), F.count("*").alias("pressure_rows"))
    money = totals.agg(grand_total(F.col("gross_sales")).alias("total_sales"), F.count("*").alias("products"))
    both = load.unionByName(money, allowMissingColumns=True)
    facts = both.agg(*[F.max(c).alias(c) for c in both.columns])
    share = _share(F.col("peak_orders") * 100, F.col("total_orders"))
    board = {
        "pm": {
            "total_orders": "total_orders", "peak_orders": "peak_orders",
            "gross_sales": "total_sales", "peak_alerts": "alert_count",
        },
        "data-engineer": {
            "raw_events": "total_orders", "pressure_rows": "pressure_rows",
            "serving_views": F.lit(views), "live_stream": F.lit(int(live)),
        },
        "ml-engineer": {
            "feature_rows": "pressure_rows", "weak_labels": "alert_count",
            "peak_examples": "peak_orders", "product_signals": "products",
        },
        "sre": {
            "critical_windows": "alert_count", "peak_orders": "peak_orders",
            "stores_monitored": "store_count", "export_healthy": (F.col("pressure_rows") > 0).cast("int"),
        },
        "leadership": {
            "revenue": "total_sales", "orders": "total_orders",
            "peak_share_percent": share, "active_stores": "store_count",
        },
    }
    entries = [
        F.struct(
            F.lit(role).alias("role"),
            F.lit(metric).alias("metric"),
            (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"),
        )
        for role, metrics in board.items()
        for metric, value in metrics.items()
    ]
    return facts.select(F.inline(F.array(*entries)))
