"""Dashboard figures: hours of the day, store by hour, products, stores, and the document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakflow.functions.bands import expected_volume, is_peak, traffic_band
from peakflow.functions.money import sales
from peakflow.functions.times import hour_label
from peakflow.operators.pressure import MIN_ORDERS, PEAK_THRESHOLD, baseline, is_alert, ratio_to, severity
from peakflow.session import materialise

# Lengths of the lists, and the smallest bar of the hourly chart in percent.
TOP_ALERTS = 12
TOP_PRODUCTS = 8
TOP_PRESSURE = 8
MIN_BAR = 3.0
# An ordinary hour, and how much busier a peak hour has to be.
NORMAL_HOUR = 10
PEAK_FACTOR = 5
HOURS = range(24)


def _by_hour(hour: Column, weight: Column) -> Column:
    """24 sums, one per hour of the day; hours without rows give 0. No spine has to be joined."""
    return F.array(*[F.coalesce(F.sum(F.when(hour == h, weight)), F.lit(0)) for h in HOURS])


def event_counts(events: DataFrame, time: str = "event_ts") -> DataFrame:
    """Events per store and hour of the day."""
    return events.groupBy("store_id", F.hour(time).alias("hour")).agg(F.count("*").alias("events"))


def hourly_orders(counts: DataFrame) -> DataFrame:
    """24 rows with the events of each hour, and each hour's share of the busiest one in percent."""
    day = counts.agg(_by_hour(F.col("hour"), F.col("events")).alias("by_hour"))
    share = F.coalesce(F.try_divide("orders", F.array_max("by_hour")) * 100, F.lit(0.0))
    return day.select("by_hour", F.posexplode("by_hour").alias("hour_no", "orders")).select(
        hour_label(F.col("hour_no")).alias("hour"), "orders", F.greatest(F.lit(MIN_BAR), share).alias("bar_percent")
    )


def store_hour_matrix(counts: DataFrame, kind: str = "fixed_24") -> DataFrame:
    """Every store with all 24 hours, its baseline and the pressure of each hour.

    `ratio` is exact and decides alerts; `baseline_orders` and `pressure_ratio` are rounded.
    """
    stores = counts.groupBy("store_id").agg(_by_hour(F.col("hour"), F.col("events")).alias("by_hour"))
    total = F.aggregate("by_hour", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    active = F.size(F.filter("by_hour", lambda n: n > 0))
    usual = stores.withColumn("baseline", baseline(total, active, kind))
    cells = usual.select("store_id", "baseline", F.posexplode("by_hour").alias("hour_no", "orders"))
    return cells.withColumn("ratio", ratio_to(F.col("orders"), F.col("baseline"))).select(
        "store_id",
        hour_label(F.col("hour_no")).alias("hour"),
        "orders",
        F.round("baseline", 2).alias("baseline_orders"),
        F.round("ratio", 2).alias("pressure_ratio"),
        "hour_no",
        "ratio",
    )


MATRIX = ("store_id", "hour", "orders", "baseline_orders", "pressure_ratio")


def matrix_alerts(matrix: DataFrame, threshold: float = PEAK_THRESHOLD, min_orders: int = MIN_ORDERS) -> DataFrame:
    hot = matrix.where(is_alert(F.col("orders"), F.col("ratio"), threshold, min_orders))
    return hot.select(*MATRIX, severity(F.col("ratio"), threshold).alias("severity"))


def top_alerts(alerts: DataFrame, n: int = TOP_ALERTS) -> DataFrame:
    return alerts.orderBy(F.desc("pressure_ratio"), "store_id", "hour").limit(n)


def top_pressure(matrix: DataFrame, n: int = TOP_PRESSURE) -> DataFrame:
    return matrix.select(*MATRIX).orderBy(F.desc("pressure_ratio"), "store_id", "hour").limit(n)


def product_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold"), sales(F.col("line_total")).alias("gross_sales")
    )


def top_products(totals: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    return totals.orderBy(F.desc("units_sold"), "product_id").limit(n)


def store_totals(counts: DataFrame) -> DataFrame:
    per_store = counts.groupBy("store_id").agg(F.sum("events").alias("orders"))
    return per_store.orderBy(F.desc("orders"), "store_id")


def matrix_summary(matrix: DataFrame, threshold: float = PEAK_THRESHOLD, min_orders: int = MIN_ORDERS) -> list[Column]:
    """Aggregates over the matrix, which has 24 rows per store whatever the number of events."""
    orders = F.col("orders")
    return [
        F.coalesce(F.sum(orders), F.lit(0)).alias("total_orders"),
        F.coalesce(F.sum(F.when(is_peak(F.col("hour_no")), orders)), F.lit(0)).alias("peak_orders"),
        F.count_if(is_alert(orders, F.col("ratio"), threshold, min_orders)).alias("alert_count"),
        F.count_if(F.col("hour_no") == 0).alias("store_count"),
    ]


def dashboard_summary(
    matrix: DataFrame, totals: DataFrame, threshold: float = PEAK_THRESHOLD, min_orders: int = MIN_ORDERS
) -> DataFrame:
    """One row: events, events in peak hours, sales, alerts, stores."""
    load = matrix.agg(*matrix_summary(matrix, threshold, min_orders))
    total = F.coalesce(F.sum("gross_sales"), F.lit(0)).try_cast("decimal(28,2)")
    money = totals.agg(total.alias("total_sales"))
    both = load.unionByName(money, allowMissingColumns=True)
    columns = ("total_orders", "peak_orders", "total_sales", "alert_count", "store_count")
    return both.agg(*[F.max(c).alias(c) for c in columns])


def volume_check(counts: DataFrame, base: int, multiplier: int, tolerance: float = 0.0) -> DataFrame:
    """Events per hour of the day beside the volume its traffic band should bring.

    `as_expected` allows the given relative deviation; `peak_shape` asks of each peak hour that it
    brings several times the events of an ordinary one. `run_orders` and `run_expected` are the totals
    of the run, and `run_as_expected` compares them.
    """
    hour = F.col("hour_no")
    day = counts.agg(_by_hour(F.col("hour"), F.col("events")).alias("by_hour"))
    zero = F.lit(0).cast("bigint")
    run_orders = F.aggregate("by_hour", zero, lambda total, n: total + n)
    hours = F.array(*[F.lit(h) for h in HOURS])
    run_expected = F.aggregate(hours, zero, lambda total, h: total + expected_volume(h, base, multiplier))
    rows = day.select(
        F.col("by_hour")[NORMAL_HOUR].alias("normal"),
        run_orders.alias("run_orders"),
        run_expected.alias("run_expected"),
        F.posexplode("by_hour").alias("hour_no", "orders"),
    )
    rows = rows.select(
        "run_orders",
        "run_expected",
        hour_label(hour).alias("hour"),
        traffic_band(hour).alias("band"),
        "orders",
        expected_volume(hour, base, multiplier).alias("expected_orders"),
        (~is_peak(hour) | (F.col("orders") >= F.col("normal") * PEAK_FACTOR)).alias("peak_shape"),
    )

    def near(found: str, expected: str) -> Column:
        return F.abs(F.col(found) - F.col(expected)) <= F.col(expected) * tolerance

    return rows.withColumns(
        {"as_expected": near("orders", "expected_orders"), "run_as_expected": near("run_orders", "run_expected")}
    )


def dashboard_sections(
    counts: DataFrame, totals: DataFrame, threshold: float = PEAK_THRESHOLD, min_orders: int = MIN_ORDERS,
    kind: str = "fixed_24",
) -> DataFrame:
    """The dashboard document as rows: section, key, weight and one JSON entry.

    Within a section entries go by weight, heaviest first, then by key. Sections of any length stay
    distributed; `document_lines` makes the lines of a file from them.
    """
    matrix = store_hour_matrix(counts, kind)
    parts = {
        "summary": (dashboard_summary(matrix, totals, threshold, min_orders), [], None),
        "hourly_orders": (hourly_orders(counts).select("hour", "orders"), ["hour"], None),
        "store_pressure": (matrix.select(*MATRIX), ["store_id", "hour"], None),
        "alerts": (top_alerts(matrix_alerts(matrix, threshold, min_orders)), ["store_id", "hour"], "pressure_ratio"),
        "top_products": (top_products(totals), ["product_id"], "units_sold"),
        "store_totals": (store_totals(counts), ["store_id"], "orders"),
    }
    entries = [
        part.select(
            F.lit(name).alias("section"),
            (F.concat_ws("#", *keys) if keys else F.lit("")).alias("entry_key"),
            (F.col(weight) if weight else F.lit(0)).cast("double").alias("weight"),
            F.to_json(F.struct(*part.columns)).alias("entry"),
        )
        for name, (part, keys, weight) in parts.items()
    ]
    return reduce(DataFrame.unionByName, entries)


SINGLE_SECTIONS = ("summary",)


def document_lines(sections: DataFrame) -> DataFrame:
    """The lines of one JSON document of all sections: section, part, weight, entry_key, line.

    Ordered by section, part, weight (heaviest first) and entry_key, the lines make up the document.
    A section opens in part 0, has its entries in part 1 and closes in part 2. Nothing is gathered:
    only the first entry of each section is looked for, to know which lines begin with a comma.
    """
    first = F.min(F.struct(-F.col("weight"), F.col("entry_key"), F.col("entry"))).alias("first")
    firsts = materialise(sections.groupBy("section").agg(first), "first-entries")
    bounds = firsts.agg(F.struct(F.min("section").alias("low"), F.max("section").alias("high"))).scalar()
    single = F.col("section").isin(*SINGLE_SECTIONS)
    opening = F.concat(
        F.when(F.col("section") == bounds["low"], F.lit("{")).otherwise(F.lit(",")),
        F.concat(F.lit('"'), F.col("section"), F.lit('":')),
        F.when(single, F.lit("")).otherwise(F.lit("[")),
    )
    closing = F.concat(
        F.when(single, F.lit("")).otherwise(F.lit("]")),
        F.when(F.col("section") == bounds["high"], F.lit("}")).otherwise(F.lit("")),
    )
    here = F.struct(-F.col("weight"), F.col("entry_key"), F.col("entry"))
    entry = F.concat(F.when(here == F.col("first"), F.lit("")).otherwise(F.lit(",")), F.col("entry"))

    def frame(part: int, line: Column) -> DataFrame:
        return firsts.select(
            "section", F.lit(part).alias("part"), F.lit(0.0).alias("weight"), F.lit("").alias("entry_key"), line.alias("line")
        )

    named = ["section", F.lit(1).alias("part"), "weight", "entry_key", entry.alias("line")]
    entries = sections.join(firsts, "section").select(*named)
    return entries.unionByName(frame(0, opening)).unionByName(frame(2, closing))


def write_document(lines: DataFrame, path: str) -> None:
    """The document as text files which, read in the order of their names, make up one JSON text."""
    ordered = lines.orderBy("section", "part", F.desc("weight"), "entry_key")
    ordered.select(F.col("line").alias("value")).write.text(path)
