"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_stored: list[tuple[SparkSession, str]] = []


def use_utc(spark: SparkSession) -> SparkSession:
    """Days and hours are cut in UTC, whatever zone the cluster runs in."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def state_on_disk(spark: SparkSession) -> SparkSession:
    """Keep the state of streams in RocksDB, so that many open keys need disk and not heap.

    A stream that was started with another store goes on with that one.
    """
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    return spark


def drop_shuffles(spark: SparkSession) -> SparkSession:
    """Shuffle files go when the query that wrote them has ended, not when the driver happens to collect its garbage.

    A frame that is run twice shuffles again; steps that are read more than once are stored (`materialise`).
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


OPEN_FILES = 8


def write_as_dealt(spark: SparkSession) -> SparkSession:
    """Rows that come dealt to buckets or folders are written as they come instead of being sorted by them first.

    A task keeps a file open for each of `OPEN_FILES` at most, and sorts what is left where it meets more.
    """
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; without it, one in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, to be removed with the scope it was made in."""
    path = f"{checkpoint_root(spark)}/peakflow/{label}-{uuid.uuid4().hex}"
    _stored.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def make_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


# Ids and amounts have nearly as many values as rows: a dictionary of them costs more than all else in a write, and
# fills up. Plain they are written and read faster, and zstd packs them as small.
MANY_VALUES = ("order_id", "product_id", "event_id", "unit_price", "line_total", "sales", "gross_sales")
_IN_ITEMS = tuple(f"items.list.element.{c}" for c in ("product_id", "unit_price"))
PACKED = {"compression": "zstd", **{f"parquet.enable.dictionary#{c}": "false" for c in (*MANY_VALUES, *_IN_ITEMS)}}


def _coded(codec: str) -> dict[str, str]:
    return PACKED if codec == "zstd" else {"compression": codec}


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write `df` once to the shared folder and go on from the stored copy.

    Later branches read the columns they need instead of recomputing the plan, a lost
    executor costs a re-read only, and values that depend on the physical layout stay fixed.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**_coded(codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_in_buckets(df: DataFrame, label: str, count: int, column: str, codec: str = "snappy") -> DataFrame:
    """Like `materialise`, dealt to `count` buckets by a column: grouping or joining by it does not shuffle the copy.

    The name of the table goes at once; the frame reads the files on.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    name = f"scratch_{uuid.uuid4().hex}"
    df.write.options(path=path, **_coded(codec)).bucketBy(count, column).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


@contextmanager
def bucket_table(spark: SparkSession, label: str, count: int, column: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A stored copy that grows: what it gives adds rows and returns all so far, shuffled once, when they are added.

    The name of the table goes at the end; frames read the files on.
    """
    name, path = f"scratch_{uuid.uuid4().hex}", scratch_path(spark, label)

    def add(df: DataFrame) -> DataFrame:
        writer = df.repartition(count, column).write.mode("append").bucketBy(count, column)
        (writer if spark.catalog.tableExists(name) else writer.option("path", path)).saveAsTable(name)
        return spark.table(name)

    try:
        yield add
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def materialise_alone(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """Store what `build` returns, and remove all copies that were stored on the way to it."""
    path = scratch_path(spark, label)
    with scratch():
        df = build()
        df.write.options(**PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(copy: DataFrame) -> None:
    """Remove a stored copy before its scope ends, when all steps that read it have."""
    folders = {file.rsplit("/", 2)[-2] for file in copy.inputFiles()}
    for spark, path in [s for s in _stored if s[1].rsplit("/", 1)[-1] in folders]:
        _stored.remove((spark, path))
        delete_path(spark, path)


def clear_scratch(since: int = 0) -> None:
    """Remove the copies stored since a point; frames that still read them end with this."""
    while len(_stored) > since:
        delete_path(*_stored.pop())


def in_parallel(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Run steps that do not wait for one another side by side, so that their small stages share the cluster.

    Returns when all have ended; the first error of any is raised then.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    for step in running:
        step.result()


@contextmanager
def scratch() -> Iterator[None]:
    """Remove at the end, also after an error, whatever was stored inside."""
    since = len(_stored)
    try:
        yield
    finally:
        clear_scratch(since)


@atexit.register
def _clear_at_exit() -> None:
    with suppress(Exception):  # the session may be gone already
        clear_scratch()
