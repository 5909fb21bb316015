"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, up to CAP times over. An item (one document, once) has a
virtual finish time: the words of its source up to and with it, divided by the source's target weight. The items of
all sources are sorted globally by ranges of finish time and taken until the total budget is used; only the item in
which the budget ends is taken in part. Nothing is counted by source after the finish times: that each source comes
out near its target, within the one document it is at, is what the common clock does.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, blocks, cut, fresh, read, running_sum

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this part of all words; a source gives at most CAP times its words.
SHARE, CAP = 1.5, 2
#: Rows that one task orders within a source.
PER_BUCKET = 2_000


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds weight and target to (source, source_size): shares by weight, no source above cap times its size.

    Water filling: with sources ordered by size / weight, those below the water level are full and the rest get
    level * weight. One row per source; sources are a dimension of the corpus, so one task orders them.
    """
    n = len(WEIGHTS)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    every = Window.partitionBy(F.lit(1))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * float(share))
    rows = rows.withColumn("full", F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    level = F.greatest((F.col("budget") - F.col("full")) / F.col("open"), F.lit(0.0))
    # the level of the first source that is not full holds for it and all after it
    rows = rows.withColumn("here", F.when(F.col("most") / F.col("weight") >= level, level))
    rows = rows.withColumn("level", F.first("here", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _shuffled(id_col: str, text_col: str) -> F.Column:
    """The place of a document in its queue: a hash of its id and text, so that reruns agree and ids that are null
    or repeat do not meet in one place."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), text))


def fair_mix(docs: DataFrame, share: float = SHARE, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, key, size, source_size, target, taken, copies (items taken, in part or whole), finish (the first
    item's virtual finish time) for every row of docs.

    size: words of the whole text (null: 0). Null sources are one source, sorted last. Documents without words take
    nothing. Rows that repeat id and text follow each other in the queue, in any order. Other columns are ignored.
    Empty table: empty.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    items = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _shuffled(id_col, text_col).alias("key")))
    sources = cut(targets(items.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap))
    n = blocks(items.count(), PER_BUCKET)
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(float(1 << 32))).cast("long")
    queued = running_sum(items.withColumn("bucket", bucket), ["source"], "bucket", [F.col("key"), F.col("doc_id"), F.col("size")], "size", "before").drop("bucket")
    s = sources.select(F.col("source").alias("s"), "source_size", "target")
    queued = queued.join(F.broadcast(s) if sources.count() <= 100_000 else s, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    finish = lambda e: F.when(F.col("target") > 0, (F.col("before") + F.col("source_size") * e + F.col("size")) / F.col("target"))
    queued = cut(queued.withColumn("finishes", F.array(*[finish(e) for e in range(cap)])))
    total = items.agg(F.sum("size")).first()[0] or 0
    last, over = cut_time(queued, math.floor(min(share, cap) * total))
    part = F.lit(0)
    items_taken = F.lit(0)
    for e in range(cap):
        f = F.col("finishes")[e]
        # items that end with the budget's last word's item are taken in the order of their sources
        here = F.when(f == F.lit(last), F.least(F.col("size"), F.greatest(F.lit(0), F.lit(over) - F.coalesce(F.col("first_of_tie"), F.lit(0)))))
        own = F.when(f < F.lit(last), F.col("size")).otherwise(F.coalesce(here, F.lit(0)))
        part, items_taken = part + own, items_taken + (own > 0).cast("int")
    # at one finish time a source has one item with words at most, so these ties are as few as the sources
    tie = queued.filter(F.array_contains("finishes", F.lit(last)) & (F.col("size") > 0)).select(F.col("source").alias("s"), F.col("key").alias("k"), F.coalesce(F.sum("size").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_of_tie"))
    queued = queued.join(F.broadcast(tie) if sources.count() <= 100_000 else tie, F.array_contains("finishes", F.lit(last)) & (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return queued.select("doc_id", "source", "key", "size", "source_size", "target", part.cast("long").alias("taken"), items_taken.alias("copies"), F.col("finishes")[0].alias("finish"))


def cut_time(queued: DataFrame, budget: int, bins: int = 4096) -> tuple[float, int]:
    """(finish time of the item in which the budget ends, words that the items of just that time may have).

    Items that end before it are taken, later ones are not. The global order is made by ranges of finish time: the
    words of each range are summed, and only the range in which the budget ends is split again, until all its items
    end at one time. At most `bins` sums a pass reach the driver.
    """
    one = queued.select("size", F.explode("finishes").alias("f")).filter("f is not null and size > 0")
    r = one.agg(F.min("f"), F.max("f"), F.sum("size")).first()
    if r[2] is None or r[2] <= budget:
        return math.inf, 0
    lo, hi, before = float(r[0]), float(r[1]), 0
    while lo < hi:
        place = F.least(F.lit(bins - 1), F.floor((F.col("f") - lo) / max(hi - lo, 1e-300) * bins))
        sums = one.filter(F.col("f").between(lo, hi)).groupBy(place.alias("b")).agg(F.min("f"), F.max("f"), F.sum("size")).collect()
        for _, first, final, p in sorted(tuple(x) for x in sums):
            if before + p > budget:
                break
            before += p
        lo, hi = float(first), float(final)
    return lo, budget - before


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns as they are, each as often as the mix takes an item of it.

    A source takes its items in the order of their keys, so all that is needed of the mix is, for each round of its
    queue, the last key taken: no text is shuffled. Of rows that repeat id and text, of which the last key may take
    only some, that many are taken.
    """
    found = cut(fair_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    sources = found.select("source").distinct()
    key, mark, s, last, again, n, us, uk, ut = fresh(docs, "key", "mark", "s", "last", "again", "n", "us", "uk", "ut")
    ends = []
    for e in range(1, CAP + 1):
        end = found.filter(F.col("copies") >= e).groupBy("source").agg(F.max("key").alias(f"k{e}"))
        ends.append(end.withColumnRenamed("source", "s"))
    bounds = sources.withColumnRenamed("source", s)
    for e, end in enumerate(ends, 1):
        bounds = bounds.join(end.select(F.col("s").alias(f"s{e}"), f"k{e}"), F.col(s).eqNullSafe(F.col(f"s{e}")), "left")
    bounds = cut(bounds.select(s, F.array(*[F.col(f"k{e}") for e in range(1, CAP + 1)]).alias(last)))
    # keys of the last items whose rows repeat, where some are taken more often than others
    uneven = found.groupBy("source", "key").agg(F.count("*").alias("rows"), *[F.sum((F.col("copies") >= e).cast("long")).alias(f"t{e}") for e in range(1, CAP + 1)], F.min("copies").alias("lo"), F.max("copies").alias("hi"))
    uneven = cut(uneven.filter("rows > 1 and lo < hi").select(F.col("source").alias(us), F.col("key").alias(uk), F.array(*[F.col(f"t{e}") for e in range(1, CAP + 1)]).alias(ut)))
    keyed = docs.withColumn(key, _shuffled(id_col, text_col))
    keyed = keyed.join(F.broadcast(bounds) if bounds.count() <= 100_000 else bounds, F.col(source_col).eqNullSafe(F.col(s)))
    times = sum((F.when(F.col(key) <= F.col(last)[e], 1).otherwise(0) for e in range(CAP)), F.lit(0))
    repeated = lambda times: F.explode(F.sequence(F.lit(1), times))
    words = F.col(text_col).rlike(WORD)
    some = keyed.filter(words)
    if uneven.isEmpty():
        return some.withColumn(n, times).filter(F.col(n) > 0).withColumn(again, repeated(F.col(n))).select(docs.columns)
    # at most CAP keys of a source are uneven
    some = some.join(F.broadcast(uneven) if bounds.count() <= 100_000 else uneven, F.col(source_col).eqNullSafe(F.col(us)) & (F.col(key) == F.col(uk)), "left")
    even = some.filter(F.col(uk).isNull()).withColumn(n, times)
    odd = cut(some.filter(F.col(uk).isNotNull()).withColumn(mark, F.lit(1).cast("long")))
    odd = odd.withColumn(again, F.monotonically_increasing_id()).withColumn(last, F.shiftright(F.col(again), 33))
    odd = running_sum(odd, [key], last, [F.col(again)], mark, n).withColumn(n, sum((F.when(F.col(n) < F.col(ut)[e], 1).otherwise(0) for e in range(CAP)), F.lit(0)))
    out = even.select(*docs.columns, n).unionByName(odd.select(*docs.columns, n))
    return out.filter(F.col(n) > 0).withColumn(again, repeated(F.col(n))).select(docs.columns)


def op8_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: 150 % of all words, weights 3, 1, 2 repeating, at most 2 times a document. Each source's
    taken words are within one document of its target."""
    return fair_mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_NAMED = ", ".join(f"({i}, {float(w)})" for i, w in enumerate(WEIGHTS))
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS most, weight FROM s JOIN (VALUES {_NAMED}) v(turn, weight) USING (turn)),
l AS (SELECT a.source, (SELECT 1.5 * sum(source_size) FROM w) AS budget, a.most / a.weight AS ratio,
  (SELECT coalesce(sum(b.most), 0) FROM w b WHERE b.most / b.weight < a.most / a.weight) AS filled,
  (SELECT sum(b.weight) FROM w b WHERE b.most / b.weight >= a.most / a.weight) AS openw FROM w a),
level AS (SELECT arg_min((budget - filled) / openw, ratio) AS level FROM l WHERE ratio >= (budget - filled) / openw),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM level), 1e300) * weight) AS target FROM w),
q AS (SELECT d.r, d.doc_id, d.source, d.size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT *, e, (upto + source_size * e) / target AS finish FROM q, (VALUES (0), (1)) v(e) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) - size AS before FROM i),
k AS (SELECT r, sum(greatest(0, least(size, (SELECT floor(1.5 * sum(size)) FROM d) - before)))::BIGINT AS taken FROM o GROUP BY r)
SELECT q.doc_id, q.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (r)
"""
