"""State that micro-batches add to, kept as plain Parquet folders.

    <path>/batch/id=00000007      what batch 7 added
    <path>/base/through=00000005  batches up to 5 folded into one

A batch that runs again writes the same folder again, so nothing is added twice. Folding takes
only batches before the current one, because only the current one can run again. A reader uses
the newest finished base and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from peakflow.session import delete_path

_DIGITS = 12


class StateTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        fold: Callable[[DataFrame], DataFrame],
        fold_every: int = 20,
    ):
        """`fold` merges rows of several batches into one state; folding twice must not change it."""
        self.spark, self.path, self.schema, self.fold, self.fold_every = spark, path, schema, fold, fold_every

    def apply(self, batch_id: int, rows: DataFrame) -> None:
        if len(self._ids("batch", after=self._folded_through(), before=batch_id)) >= self.fold_every:
            self.remove_folded()  # a reader has had all the batches since the last folding to end
            self.compact(batch_id)
        names = self.schema.fieldNames()
        self.fold(rows).select(names).write.mode("overwrite").parquet(self._folder("batch", batch_id))

    def compact(self, before: int) -> None:
        """Fold the batches before `before` into a new base; older folders stay until `remove_folded`."""
        through = before - 1
        self.read(before).write.mode("overwrite").parquet(self._folder("base", through))

    def remove_folded(self) -> None:
        """Delete folders a newer base stands for. Readers that began before that base must have ended."""
        base = self._folded_through()
        if base is None:
            return
        for i in self._ids("batch", before=base + 1):
            delete_path(self.spark, self._folder("batch", i))
        for i in self._ids("base", before=base):
            delete_path(self.spark, self._folder("base", i))

    def read(self, before: int | None = None) -> DataFrame:
        """The state over all batches, or over those before a given one."""
        base = self._folded_through()
        folders = [] if base is None else [self._folder("base", base)]
        folders += [self._folder("batch", i) for i in self._ids("batch", after=base, before=before)]
        known = self.spark.read.schema(self.schema).parquet(*folders) if folders else self._empty()
        return self.fold(known)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _folded_through(self) -> int | None:
        return max(self._ids("base"), default=None)

    def _folder(self, kind: str, number: int) -> str:
        label = {"batch": "id", "base": "through"}[kind]
        return f"{self.path}/{kind}/{label}={number:0{_DIGITS}d}"

    def _ids(self, kind: str, after: int | None = None, before: int | None = None) -> list[int]:
        """Numbers of the finished folders of a kind, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        found = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop)
        ids = sorted(int(s.getPath().getParent().getName().rpartition("=")[2]) for s in found or [])
        return [i for i in ids if (after is None or i > after) and (before is None or i < before)]
