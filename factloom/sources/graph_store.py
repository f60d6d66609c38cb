"""A property graph as tables: one for each node label and each relation, in numbered versions under a path.

A write reads the latest finished version and makes the next, so readers and a failed write never disturb one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import graph


class TableStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        """Numbers of the finished versions, by the file system that the path belongs to."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/v*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName()[1:]) for s in done)

    def read(self, name: str) -> DataFrame | None:
        """None if it has never been written."""
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.path}/{name}/v{versions[-1]}") if versions else None

    def _write(self, name: str, rows: DataFrame) -> None:
        versions = self._versions(name)
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/v{versions[-1] + 1 if versions else 0}")

    def merge_nodes(self, label: str, rows: DataFrame, keys: list[str], order: list[str]) -> None:
        """Stored nodes stay; of new rows of a key the first in order is added."""
        own = graph.first_write(rows, keys, order, [c for c in rows.columns if c not in keys])
        stored = self.read(f"nodes/{label}")
        self._write(f"nodes/{label}", own if stored is None else graph.upsert_nodes(stored, own, keys))

    def merge_edges(self, rel_type: str, rows: DataFrame, identity: list[str], order: list[str]) -> None:
        """The last row of an identity, in order, takes the place of a stored edge."""
        own = graph.last_write(rows, identity, order, [c for c in rows.columns if c not in identity])
        stored = self.read(f"edges/{rel_type}")
        self._write(f"edges/{rel_type}", own if stored is None else graph.replace_edges(stored, own, identity))

    def delete_edges(self, rel_type: str, gone: DataFrame, identity: list[str]) -> None:
        stored = self.read(f"edges/{rel_type}")
        if stored is not None:
            self._write(f"edges/{rel_type}", graph.delete_edges(stored, gone, identity))


#: Stores by name; further ones are added here.
STORES: dict[str, Callable[[SparkSession, str], TableStore]] = {"tables": TableStore}


def open_store(name: str, spark: SparkSession, path: str) -> TableStore:
    if name not in STORES:
        raise ValueError(f"no store {name!r}; there are {sorted(STORES)}")
    return STORES[name](spark, path)
