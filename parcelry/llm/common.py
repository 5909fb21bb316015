"""Helpers shared by the operators: lineage cuts, running sums over salted buckets, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of the text contracts: \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the cluster names none (tests)."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("parcelry.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="parcelry-")
        spark.conf.set("parcelry.checkpoint.dir", d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lost executors cost no recomputation, and
    values that depend on partition ids are frozen. Files stay under <dir>/parcelry/<application id>."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parcelry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have, in any case, one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: str | None = None, how: str = "left", least: int = 2048, most: int = 4096) -> DataFrame:
    """rows joined (left or inner) with table on keys, which are unique in table; rows with a null key match nothing.
    If a column of table holds the number of rows of its key already, `size` names it.

    A key of more than max(least, rows / most) rows is hot: there are at most `most` of these, so their table rows
    are broadcast and their rows stay where they are; only the others are shuffled.
    """
    new = [c for c in table.columns if c not in keys]
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    counts = table if size else cut(rows.filter(some).groupBy(*keys).agg(F.count("*").alias("__rows")))
    n = F.col(size or "__rows")
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = counts.filter(n > max(least, total // most))
    hot = hot if size else hot.drop("__rows").join(table, keys)
    if hot.isEmpty():
        return rows.join(table, keys, how).select(*rows.columns, *new)
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    if how == "inner":
        rest = rows.join(hot.select(*keys), keys, "left_anti").join(table, keys).select(*rows.columns, *new)
        return rows.join(hot, keys).select(*rows.columns, *new).unionByName(rest)
    first = rows.join(hot, keys, "left")
    done = first.filter(F.col("__hot") | ~some).select(*rows.columns, *new)
    rest = first.filter(F.col("__hot").isNull() & some).select(*rows.columns).join(table, keys, "left").select(*rows.columns, *new)
    return done.unionByName(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows before each row within `keys`, in the order (bucket, *order).

    Only the rows of one bucket meet in one task, so a hot key is spread over its buckets; the sums of the buckets
    (one row each) give the offsets. Rows that tie in `order` are taken in any order.
    """
    total, inner, before, at, key, own = fresh(df.withColumn(out, F.lit(0)), "total", "inner", "before", "at", "key", "own")
    # keys as a struct: two structs of null fields are equal, so the join is a plain one and uses the window's partitioning
    keyed = df.withColumn(key, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    sums = keyed.groupBy(key, bucket).agg(F.sum(value).alias(total))
    w = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias(own), F.col(bucket).alias(at), F.coalesce(F.sum(total).over(w), F.lit(0)).alias(before))
    here = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn(inner, F.coalesce(F.sum(value).over(here), F.lit(0)))
    joined = within.join(sums, (F.col(key) == F.col(own)) & (F.col(bucket) == F.col(at)), "left")
    return joined.withColumn(out, F.col(inner) + F.col(before)).drop(inner, before, at, key, own)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40, least: int = 2048, most: int = 4096) -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each an aggregation and a join; the edge
    table is written and reread after each round. Edges between equal nodes only make the node appear. Hubs (nodes of
    over max(least, edges / most) edges, so at most 2 * most of them) get their minimum by broadcast, and their edges
    stay where they are.
    """
    def star(e: DataFrame, large: bool, n: int, hub: int) -> DataFrame:
        both = e.select(F.col("u"), F.col("v"))
        if large:
            both = both.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
        bound = max(least, n // most)
        hot = F.col("n") > bound
        if hub <= bound:
            return ended(both.join(low, F.col("u") == F.col("k")), large)
        first = both.join(F.broadcast(low.filter(hot)), F.col("u") == F.col("k"), "left")
        rest = first.filter("k is null").select("u", "v").join(low.filter(~hot), F.col("u") == F.col("k"))
        return ended(first.filter("k is not null").unionByName(rest), large)

    def ended(joined: DataFrame, large: bool) -> DataFrame:
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        return out.filter("u > v").distinct()

    base = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null").distinct())
    e = base.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    seen = None
    for _ in range(rounds):
        by_low = e.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        n, h, hub = by_low.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if not n or (n, h) == seen:
            break
        seen = (n, h)
        e = cut(star(star(e, True, n, hub), False, n, hub))
    else:
        raise RuntimeError("components did not converge")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = base.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, a function for mapInArrow, that hands freed memory back to the system when a partition is done: Python
    workers are kept for later tasks, and what each holds on to adds up over the stages of a job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def blocks(rows: int, per_block: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_block))


def bitmap_split(df: DataFrame, column: str, ids: DataFrame, id_col: str, bits: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """(rows whose `column` may be among the ids, rows whose `column` is not), without a shuffle of df.

    The ids set bits of a bitmap of fixed size, held as at most bits / 64 rows, which is what is broadcast whatever
    the number of ids. Nulls are one value.
    """
    word, mask, h = fresh(df, "word", "mask", "h")
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` % 64 as int))")
    marks = ids.select(slot(id_col).alias(h)).select(F.floor(F.col(h) / 64).cast("long").alias(word), bit(h).alias(mask))
    words = F.broadcast(cut(marks.groupBy(word).agg(F.bit_or(mask).alias(mask))))
    marked = df.withColumn(h, slot(column)).join(words, F.floor(F.col(h) / 64).cast("long") == F.col(word), "left")
    hit = F.coalesce(F.col(mask), F.lit(0).cast("long")).bitwiseAND(bit(h)) != 0
    return marked.filter(hit).select(df.columns), marked.filter(~hit).select(df.columns)
