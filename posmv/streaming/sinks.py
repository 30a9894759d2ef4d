"""Keyed tables in the shared folder, written by micro-batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names; a temporary one where it is unset and Spark runs on
    one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="posmv-")
    return f"{base.rstrip('/')}/posmv/{name}-{uuid.uuid4().hex}"


class KeyedTable:
    """The newest row of each key. A micro-batch writes the keys it changed under its own number, so a batch that
    is replayed replaces its rows instead of adding to them; the last number that has a key wins. Every
    `fold_after` batches those before the current one, which cannot be replayed any more, are folded into one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], guarantee: str = "exactly-once", fold_after: int = 64):
        self.spark, self.path, self.schema, self.keys, self.guarantee, self.fold_after = spark, path, schema, keys, guarantee, fold_after
        empty = spark.createDataFrame([], schema)
        self.columns = empty.columns
        if not self._exists():
            # so that readers find the table before the first batch
            empty.withColumn("batch", F.lit(-1).cast("bigint")).write.mode("append").parquet(f"{path}/b=-1")

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self) -> bool:
        fs, where = self._fs()
        return fs.exists(where)

    def upsert(self, changed: DataFrame, batch: int) -> None:
        """changed: one row for each key at most."""
        rows = changed.select(*self.columns).withColumn("batch", F.lit(batch).cast("bigint"))
        # at-least-once: a replay adds the rows again; the newest still wins, but the log has them twice
        mode = "append" if self.guarantee == "at-least-once" else "overwrite"
        rows.write.mode(mode).parquet(f"{self.path}/b={batch}")
        if batch > 0 and batch % self.fold_after == 0:
            self.fold(batch - 1)

    def log(self, before: int | None = None) -> DataFrame:
        found = self.spark.read.schema(f"{self.schema}, batch BIGINT").option("recursiveFileLookup", "true").parquet(self.path)
        return found if before is None else found.filter(F.col("batch") < before)

    def read(self, before: int | None = None) -> DataFrame:
        """The state, or as it was before a batch."""
        rest = [c for c in self.columns if c not in self.keys]
        last = self.log(before).groupBy(*self.keys).agg(F.max(F.struct("batch", *rest)).alias("v"))
        return last.select(*[F.col(c) if c in self.keys else F.col(f"v.{c}") for c in self.columns])

    def fold(self, upto: int) -> None:
        """Replace all batches up to one by their state, if there are more than fold_after.

        The state is written beside them, under the last of their numbers, and only then are they deleted. Its rows are
        those that they stand for, so a reader sees the same state before, between and after, wherever it breaks off.
        """
        fs, where = self._fs()
        number = re.compile(r"b=(-?\d+)")
        old = [s.getPath() for s in fs.listStatus(where) if int(number.match(s.getPath().getName())[1]) <= upto]
        if len(old) <= self.fold_after:
            return
        self.read(upto + 1).withColumn("batch", F.lit(upto).cast("bigint")).write.parquet(f"{self.path}/b={upto}-fold-{uuid.uuid4().hex}")
        for p in old:
            fs.delete(p, True)


def broker_options(servers: str, topic: str, guarantee: str = "exactly-once", prefix: str = "posmv", more: dict[str, str] | None = None) -> dict[str, str]:
    """Options of the broker's writer. Its records may come twice after a failure, so a reader takes the last value of
    each key; `none` does not wait for replicas."""
    found = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.client.id": f"{prefix}-{topic}"}
    found["kafka.acks"] = "0" if guarantee == "none" else "all"
    return found | {f"kafka.{k}": v for k, v in (more or {}).items()}


def start_topic(rows: DataFrame, options: dict[str, str], checkpoint: str, trigger: dict):
    """key, value rows of a stream in update mode to a topic; needs the broker's package on the class path."""
    writer = rows.writeStream.format("kafka").outputMode("update").options(**options)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
