"""Fingerprints, change detection, upserts, and the registry of snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import fast_hash, fingerprint  # noqa: F401  part of what snapshots offer
from .content import content_hash_of, parts_of
from .keep import keep_last


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n_rows and the content hash of all rows (see content), from one partial aggregation."""
    return parts_of(df, columns).select(F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), content_hash_of().alias("content_hash"))


def schema_hash(df: DataFrame) -> str:
    import hashlib

    return hashlib.sha256(",".join(sorted(df.columns)).encode()).hexdigest()


def change_actions(incoming: DataFrame, state: DataFrame, keys: Sequence[str], hash_col: str = "content_hash") -> DataFrame:
    """incoming with action: CREATE (new key), SKIP (same hash) or MERGE."""
    old = state.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(hash_col).alias("__hash"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    action = F.when(F.col("__hash").isNull(), "CREATE").when(F.col("__hash") == F.col(hash_col), "SKIP").otherwise("MERGE")
    return incoming.join(old, on, "left").withColumn("action", action).drop("__hash", *[f"__{k}" for k in keys])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """old without the keys of new, and new with one (the last) row per key. Idempotent."""
    latest = keep_last(new, keys, order or [c for c in new.columns if c not in keys])
    return old.join(latest.select(*keys), list(keys), "left_anti").select(old.columns).unionByName(latest)


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of either side; new values replace old ones unless they are null. Keys must be unique per side."""
    values = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    return old.join(renamed, list(keys), "full_outer").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in values])


def write_years(df: DataFrame, path: str, year: str = "year") -> None:
    """One Parquet folder per year; only the years in df are replaced. A year of many rows is written by many tasks."""
    df.hint("rebalance", year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(path)


class Table:
    """A Parquet table replaced as a whole: a new version is written beside the old one, then the pointer file moves.

    A failed write leaves the old version current. The pointer is one small file, written through Spark.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _current(self) -> str | None:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current")
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return None
        rows = [r[0] for r in self.spark.read.text(f"{self.path}/_current").collect()]
        return max(rows) if rows else None

    def read(self) -> DataFrame | None:
        at = self._current()
        return None if at is None else self.spark.read.parquet(f"{self.path}/{at.split(' ')[1]}")

    def near(self, rows: DataFrame) -> DataFrame | None:
        """What of the table may share a key with rows: all of it (see buckets.BucketedTable)."""
        return self.read()

    def replace(self, df: DataFrame) -> DataFrame:
        at = self._current()
        number = int(at.split(" ")[0]) + 1 if at else 0
        name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(f"{number:08d} {name}",)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_current")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def upsert(self, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
        old = self.read()
        return self.replace(upsert(old, new, keys, order) if old is not None else keep_last(new, keys, order or [c for c in new.columns if c not in keys]))


def apply_changes(incoming: DataFrame, keys: Sequence[str], columns: Sequence[str], nodes: Table, state: Table) -> DataFrame:
    """Writes new and changed rows to nodes, then their hashes to state, and returns the counts of actions.

    State moves last, so a failed run is repeated rather than skipped. Where nodes and state are bucketed tables, what is
    read of the state and written of both is the buckets of the incoming and of the changed keys.
    """
    hashed = keep_last(incoming, keys, [c for c in incoming.columns if c not in keys]).withColumn("content_hash", fingerprint(columns))
    old = state.near(hashed)
    actions = change_actions(hashed, old, keys) if old is not None else hashed.withColumn("action", F.lit("CREATE"))
    # written once: counts, nodes and state come from the same rows, whatever incoming is computed from
    path = f"{nodes.path}/_actions/{uuid.uuid4().hex}"
    actions.write.parquet(path)
    actions = incoming.sparkSession.read.schema(actions.schema).parquet(path)
    counts = actions.groupBy("action").agg(F.count("*").alias("n")).orderBy("action").collect()
    changed = actions.filter("action <> 'SKIP'").drop("action")
    if any(r["action"] != "SKIP" for r in counts):
        nodes.upsert(changed.drop("content_hash"), keys)
        state.upsert(changed.select(*keys, "content_hash"), keys)
    return incoming.sparkSession.createDataFrame([tuple(r) for r in counts], "action string, n long")


def registry_row(df: DataFrame, dataset: str, version: str, path: str, source: str, columns: Sequence[str]) -> DataFrame:
    return content_hash(df, columns).select(F.lit(dataset).alias("dataset"), F.lit(version).alias("version"), F.lit(path).alias("path"), F.col("n_rows").alias("row_count"), F.lit(schema_hash(df)).alias("schema_hash"), "content_hash", F.lit(source).alias("source_id"))
