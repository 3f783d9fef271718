"""Keyed tables: rows by key in buckets, changed copy-on-write, with a manifest that says which folder
each bucket is in now.

A merge reads and rewrites only the buckets that its rows fall into; the others stay where they are.
A new manifest is written under a name of its own and then renamed, so a reader sees the state
before or after a merge, never a part of it; merging the same rows again changes nothing.
Merges of one table are made one at a time: a manifest that came meanwhile makes the later one fail.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    key: Sequence[str]
    schema: StructType
    buckets: int = BUCKETS

    def _fs(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def state(self) -> tuple[int, dict[int, str]]:
        """Number of the newest manifest, and the folder of each bucket that has rows."""
        found = self._fs().globStatus(self._at("manifest-*.json")) or []
        newest = max((f.getPath().getName() for f in found), default=None)
        if newest is None:
            return 0, {}
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/{newest}").collect())  # a row of one number a bucket
        return int(newest[9:-5]), {int(b): f for b, f in json.loads(text).items()}

    def _publish(self, number: int, folders: dict[int, str]) -> None:
        fs, own = self._fs(), self._at(f".manifest-{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        name = self._at(f"manifest-{number:012d}.json")
        if fs.exists(name) or not fs.rename(own, name):
            fs.delete(own, False)
            raise RuntimeError(f"manifest {number} of {self.path} is there already: another merge came first")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        _, folders = self.state()
        return self._rows({b: f for b, f in folders.items() if only is None or b in only})

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}/bucket={b}" for b, f in sorted(folders.items())])

    def merge(self, rows: DataFrame, order: Sequence[str] = (), gone: Column | None = None) -> int:
        """Put rows in by key: of a key's rows the last in ``order`` stays, the new one if they are
        equal, whatever else the table holds; rows for which ``gone`` holds take their key
        out. Returns how many buckets were rewritten."""
        number, folders = self.state()
        new = rows.select(*self.schema.names, F.lit(1).alias("__new"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("__gone"))
        new = new.withColumn("bucket", self._bucket())
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most the buckets
        if not touched:
            return 0
        old = self._rows({b: f for b, f in folders.items() if b in touched}).withColumns({"__new": F.lit(0), "__gone": F.lit(False), "bucket": self._bucket()})
        both = old.unionByName(new)
        rest = [c for c in self.schema.names if c not in self.key]
        last = F.max_by(F.struct("__gone", *rest), F.struct(*order, "__new", F.xxhash64(*self.schema.names))).alias("row")
        kept = both.groupBy("bucket", *self.key).agg(last).where("not row.__gone")
        kept = kept.select("bucket", *[F.col(c) if c in self.key else F.col(f"row.{c}").alias(c) for c in self.schema.names])
        folder = f"data-{uuid.uuid4().hex}"
        kept.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        there = {int(f.getPath().getName()[7:]) for f in self._fs().globStatus(self._at(f"{folder}/bucket=*")) or []}
        self._publish(number + 1, {b: f for b, f in folders.items() if b not in touched} | {b: folder for b in sorted(there)})
        return len(touched)
