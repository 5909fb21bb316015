"""Snapshots in buckets: an upsert reads and writes only the buckets that its rows fall into.

A row's bucket is a hash of its key; `data/v=<version>-<run>/bucket=<number>` holds what one run wrote of a bucket.
Data go first, then one small file, the list of the current buckets with their sizes and content hashes, makes them
current. Spark commits that file as a whole, so a run that is killed before changes nothing, and one that is repeated
gives the same table. Nothing is overwritten; `vacuum` removes what the current list doesn't name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .content import PARTS, content_hash_of, parts_of
from .keep import keep_last

FIELDS = ("version", "run", "folder", "bucket", "n_buckets", "batch", "row_schema", "n_rows", *PARTS)
LIST = "version long, run string, folder string, bucket int, n_buckets int, batch string, row_schema string, n_rows long, " + ", ".join(f"{p} decimal(38,0)" for p in PARTS)
#: Rows that a bucket should have: a table gets its number of buckets when it is first written.
BUCKET_ROWS = 1_000_000


def bucket_of(keys: Sequence[str], n: int) -> Column:
    """The first 32 bits of an MD5 of the keys as strings, modulo n, so any engine finds a row's bucket. Null is a value."""
    parts = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for k in keys])
    return (F.conv(F.substring(F.md5(parts), 1, 8), 16, 10).cast("long") % n).cast("int")


class BucketedTable:
    """A Parquet table with one row per key; it stands in where a snapshots.Table does. `by`: those of the keys that a
    row's bucket depends on, if not all, so that rows which change together are written together."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], n_buckets: int | None = None, by: Sequence[str] | None = None):
        self.spark, self.path, self.keys, self.n, self.by = spark, path.rstrip("/"), list(keys), n_buckets, list(by or keys)

    def entries(self) -> list[Row]:
        """The current list, a row a bucket, in the order of buckets; the driver reads it, a row for BUCKET_ROWS of data.
        Of two runs that wrote the same version the one with the least name counts, the other has failed."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return []
        lists = self.spark.read.schema(LIST).parquet(f"{self.path}/lists")
        last = lists.agg(F.max_by(F.struct("version", "run"), F.struct(F.col("version"), F.negative(F.conv(F.substring("run", 1, 15), 16, 10).cast("long"))))).first()[0]
        return [] if last is None else lists.filter((F.col("version") == last["version"]) & (F.col("run") == last["run"])).sort("bucket").collect()

    def summary(self) -> DataFrame:
        """(bucket, version, n_rows, content_hash) of the current buckets; version is that which wrote the bucket."""
        rows = self.spark.createDataFrame(self.entries(), LIST)
        return rows.filter("n_rows > 0").select("bucket", F.substring_index(F.substring_index("folder", "-", 1), "=", -1).cast("long").alias("version"), "n_rows", content_hash_of().alias("content_hash"))

    def hash(self) -> tuple[int, str]:
        """(rows, content hash) of the table, added up from the list: no row is read."""
        entries = self.entries()
        n = sum(e["n_rows"] for e in entries)
        return n, f"{n:016x}" + "".join(f"{sum(int(e[p]) for e in entries) % (1 << 60):015x}" for p in PARTS)

    def read(self) -> DataFrame | None:
        return self._rows(self.entries())

    def near(self, rows: DataFrame) -> DataFrame | None:
        """The rows of the buckets that the keys of `rows` fall into: all that can share a key with them."""
        entries = self.entries()
        touched = self._touched(rows, entries[0]["n_buckets"]) if entries else set()
        return self._rows(entries, touched)

    def _rows(self, entries: Sequence[Row], only: set[int] | None = None) -> DataFrame | None:
        if not entries:
            return None
        schema = StructType.fromJson(json.loads(entries[0]["row_schema"]))
        paths = [f"{self.path}/data/{e['folder']}/bucket={e['bucket']}" for e in entries if e["n_rows"] and (only is None or e["bucket"] in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _touched(self, rows: DataFrame, n: int) -> set[int]:
        """Numbers of buckets, at most n."""
        return {r[0] for r in rows.select(bucket_of(self.by, n).alias("b")).distinct().collect()}

    def _write(self, rows: DataFrame, n: int, kept: Sequence[Row], batch: str | None, version: int) -> None:
        """Stores rows (with their bucket) beside the kept buckets and makes both the current version."""
        run, columns = uuid.uuid4().hex, [c for c in rows.columns if c != "bucket"]
        folder = f"v={version:08d}-{run}"
        schema = rows.select(columns).schema
        rows.select(*columns, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = self.spark.read.schema(StructType([*schema.fields, rows.schema["bucket"]])).parquet(f"{self.path}/data/{folder}")
        own = [r.asDict() | {"folder": folder} for r in parts_of(written, columns, ["bucket"]).collect()]
        nothing = {"folder": folder, "bucket": 0, "n_rows": 0} | dict.fromkeys(PARTS, Decimal(0))
        both = [e.asDict() for e in kept] + own or [nothing]
        now = {"version": version, "run": run, "n_buckets": n, "batch": batch, "row_schema": schema.json()}
        listed = self.spark.createDataFrame([tuple((e | now)[f] for f in FIELDS) for e in both], LIST)
        listed.coalesce(1).write.mode("append").parquet(f"{self.path}/lists")
        if self.entries()[0]["run"] != run:
            raise RuntimeError(f"another run has written version {version}; this one is to be repeated")

    def _change(self, new: DataFrame, batch: str | None, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Makes fold(old rows of the touched buckets and new ones, told apart by __new) the content of these buckets."""
        entries = self.entries()
        if batch is not None and entries and entries[0]["batch"] == batch:
            return self.read()
        n = entries[0]["n_buckets"] if entries else self.n or max(1, -(-new.count() // BUCKET_ROWS))
        touched = self._touched(new, n) if entries else set()  # the first rows are all written
        if entries and not set(new.columns) <= set(self._rows(entries).columns):
            touched = set(range(n))  # a new column is part of every row, and of its hash
        if entries and not touched:
            return self.read()
        both = new.withColumn("__new", F.lit(1))
        if entries:
            both = self._rows(entries, touched).withColumn("__new", F.lit(0)).unionByName(both, allowMissingColumns=True)
        # one shuffle, by bucket: rows of a key are together then, and a bucket is one file
        both = both.withColumn("bucket", bucket_of(self.by, n)).repartition("bucket")
        version = entries[0]["version"] + 1 if entries else 0
        self._write(fold(both).drop("__new"), n, [e for e in entries if e["bucket"] not in touched], batch, version)
        return self.read()

    def upsert(self, new: DataFrame, keys: Sequence[str] | None = None, order: Sequence[str] | None = None, batch: str | None = None) -> DataFrame:
        """Rows of new (of several with one key the last in the order) replace those of the table, or join them. Columns
        that only one side has are null on the other. Idempotent; a named batch that was the last one is left out."""
        order = list(order or [c for c in new.columns if c not in self.keys])
        return self._change(new, batch, lambda both: keep_last(both, ["bucket", *self.keys], ["__new", *order]))

    def combine(self, new: DataFrame, how: Mapping[str, Callable[[str], Column]], batch: str) -> DataFrame:
        """Rows with one key, old and new, become one row: of each column the given aggregate. That is rarely idempotent,
        so a batch has a name, and that which was the last one is not combined again."""
        kinds = dict(new.dtypes)
        return self._change(new, batch, lambda both: both.groupBy("bucket", *self.keys).agg(*[f(c).cast(kinds[c]).alias(c) for c, f in how.items()]))

    def add(self, new: DataFrame, sums: Sequence[str], batch: str) -> DataFrame:
        """Adds counters; null is no number."""
        return self.combine(new, dict.fromkeys(sums, F.sum), batch)

    def rebucket(self, n: int) -> DataFrame | None:
        """Deals all rows to n buckets, for a table that has outgrown its own."""
        entries = self.entries()
        if entries:
            rows = self._rows(entries).withColumn("bucket", bucket_of(self.by, n)).repartition("bucket")
            self._write(rows, n, [], entries[0]["batch"], entries[0]["version"] + 1)
        return self.read()

    def vacuum(self) -> int:
        """Removes the folders of buckets that the current list doesn't name, and returns their number. Not while others read."""
        entries = self.entries()
        named = {(e["folder"], f"bucket={e['bucket']}") for e in entries}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs, gone = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), 0
        for run in fs.listStatus(path) if entries else []:
            for bucket in fs.listStatus(run.getPath()) if run.isDirectory() else []:
                if bucket.isDirectory() and (run.getPath().getName(), bucket.getPath().getName()) not in named:
                    gone += fs.delete(bucket.getPath(), True)
        return gone
