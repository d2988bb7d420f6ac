"""A store hour beside the same hour before, and one mix of products beside another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = {"day": 24, "week": 7 * 24}
# The two peaks of the day.
LUNCH_HOURS, DINNER_HOURS = (12, 13), (18, 19)


def with_lags(hourly: DataFrame, lags: Mapping[str, int] = LAGS, value: str = "order_count") -> DataFrame:
    """Per lag: the value so many hours before (`prior_<lag>`), the change against it, and the mean since.

    Hours are aligned by their number, not by their place among the rows, so hours without a row do not
    shift them: such an hour counts 0 once the store has opened, and before that the value is NULL, as
    is a change against nothing. `trailing_<lag>` is the mean over the hours from then up to the one
    before, those without a row included. The window holds one row per hour of a store.
    """
    store = Window.partitionBy("store_id").orderBy("_hour_no")
    numbered = hourly.withColumn("_hour_no", F.floor(F.unix_seconds("hour_start") / 3600))
    opened = F.min("_hour_no").over(Window.partitionBy("store_id"))
    columns: dict[str, Column] = {}
    for name, hours in lags.items():
        known = F.col("_hour_no") - hours >= opened
        then = F.sum(value).over(store.rangeBetween(-hours, -hours))
        since = F.sum(value).over(store.rangeBetween(-hours, -1))
        prior = F.when(known, F.coalesce(then, F.lit(0)))
        columns[f"prior_{name}"] = prior
        columns[f"change_{name}"] = F.try_divide(F.col(value) - prior, F.nullif(prior, F.lit(0)))
        columns[f"trailing_{name}"] = F.when(known, F.coalesce(since, F.lit(0)) / F.lit(hours))
    return numbered.withColumns(columns).drop("_hour_no")


def mix_drift(
    lines: DataFrame, hour: Column, first: Sequence[int] = LUNCH_HOURS, second: Sequence[int] = DINNER_HOURS
) -> DataFrame:
    """How far the product mix of each store differs between two bands of the day: Jensen-Shannon, in bits.

    Shares are of units. 0 is the same mix and 1 nothing in common; NULL when one band has no units. A
    product that one band lacks counts with share 0, so the two sparse mixes need no common list of
    products. `drifting_product` adds most to the distance; of equals the first by name.
    """
    units = {name: F.sum(F.when(hour.isin(*hours), F.col("quantity"))) for name, hours in (("a", first), ("b", second))}
    mixes = lines.groupBy("store_id", "product_id").agg(*[F.coalesce(u, F.lit(0)).alias(n) for n, u in units.items()])
    mixes = mixes.where("a + b > 0")
    totals = mixes.groupBy(F.col("store_id").alias("_store")).agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    # The mixes hold a row per store and product; Spark sends the totals along or splits a large store.
    rated = mixes.join(totals, F.col("store_id").eqNullSafe(F.col("_store")))
    p, q = F.try_divide("a", "_a"), F.try_divide("b", "_b")
    middle = (p + q) / 2

    def part(share: Column) -> Column:
        return F.when(share > 0, share * F.log2(share / middle)).when(share == 0, 0.0)

    rated = rated.withColumn("_share", (part(p) + part(q)) / 2)
    leader = F.struct(-F.round("_share", 9), F.col("product_id"))
    return rated.groupBy("store_id").agg(
        F.max("_a").alias("first_units"),
        F.max("_b").alias("second_units"),
        F.count("*").alias("products"),
        F.when(F.count("_share") == F.count("*"), F.sum("_share")).alias("divergence"),
        F.min_by("product_id", F.when(F.col("_share").isNotNull(), leader)).alias("drifting_product"),
    )
