"""Stream records: an event as compact JSON plus its publish time, keyed by store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakflow.functions.times import utc_text
from peakflow.schemas import ORDER_EVENT, PUBLISHED_EVENT


def encode(events: DataFrame, published_at: Column) -> DataFrame:
    """`partition_key` and base64 `data`, with any further columns kept."""
    fields = ORDER_EVENT.fieldNames()
    body = F.struct(*fields, utc_text(published_at).alias("_published_at_utc"))
    rest = [c for c in events.columns if c not in fields]
    return events.select(
        F.col("store_id").alias("partition_key"),
        F.base64(F.to_json(body).cast("binary")).alias("data"),
        *rest,
    )


def decode(records: DataFrame) -> DataFrame:
    """Payload back to columns; `data` may be base64 text or plain bytes.

    A record that cannot be decoded stays, with NULL in every column of the payload.
    """
    is_text = dict(records.dtypes)["data"] == "string"
    raw = F.try_to_binary("data", F.lit("base64")) if is_text else F.col("data")
    rest = [c for c in records.columns if c != "data"]
    parsed = F.from_json(raw.cast("string"), PUBLISHED_EVENT)
    return records.select(*rest, parsed.alias("payload")).select(*rest, "payload.*")
