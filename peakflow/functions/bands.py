"""Traffic bands of the day."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hours of each band.
PEAK_HOURS = (12, 13, 18, 19)
RAMP_HOURS = (11, 17, 20)
FIRST_DAY_HOUR = 8
LAST_DAY_HOUR = 21
# Latency reports know three segments; ramp hours count as shoulder there.
SHOULDER_SEGMENT_HOURS = (8, 9, 10, 11, 14, 15, 16, 17, 20, 21)
OFF_PEAK_SEGMENT_HOURS = (0, 1, 2, 3, 4, 5, 6, 7, 22, 23)


def is_peak(hour: Column) -> Column:
    return hour.isin(*PEAK_HOURS)


def traffic_band(hour: Column) -> Column:
    return (
        F.when(is_peak(hour), "peak")
        .when(hour.isin(*RAMP_HOURS), "ramp")
        .when(hour.between(FIRST_DAY_HOUR, LAST_DAY_HOUR), "shoulder")
        .when(hour.isNotNull(), "off-peak")
    )


def expected_volume(hour: Column, base: int, multiplier: int) -> Column:
    """Orders expected in an hour when an ordinary hour brings `base`."""
    by_band = {
        "peak": base * multiplier,
        "ramp": base * 2,
        "shoulder": base,
        "off-peak": max(1, base // 3),
    }
    lookup = F.create_map(*[F.lit(x) for pair in by_band.items() for x in pair])
    return lookup[traffic_band(hour)].cast("bigint")


def latency_segment(hour: Column) -> Column:
    return (
        F.when(is_peak(hour), "peak")
        .when(hour.isin(*SHOULDER_SEGMENT_HOURS), "shoulder")
        .when(hour.isin(*OFF_PEAK_SEGMENT_HOURS), "off-peak")
    )
