"""Sharding by a k-d tree whose cuts are distributed weighted medians. DataFrame functions only.

Points are documents, weighted by their size in bytes. Equal texts belong together, so the dimensions are metadata
that the text determines (size, bytes a character, characters a word); source, language or date would part copies.
Texts whose copies weigh over HEAVY of a shard are placed first, whole, each in the emptiest shard that has room; a group
that no shard can hold beside the even share of bytes is cut. The tree then deals out the rest: each round cuts
every open node along its widest dimension (its extent as a part of the whole table's) at the weighted quantile that
the room of its leaves asks for. A quantile is found by histograms of a bounded number of bins, refined until the
bin that holds it is light enough; MAX_BINS rows of histograms a pass reach the driver, and one row for each node
and heavy group, whose numbers the number of shards bounds.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, fresh, read, running_sum

DIMS = ("d_size", "d_width", "d_word")
#: Rows of histograms that reach the driver in one pass, and bins that a cut has at least and at most.
MAX_BINS, LEAST_BINS, MOST_BINS = 1 << 14, 16, 2048
#: A cut may miss its quantile by this part of the node's bytes.
NEAR = 0.0005
#: Copies of a text that weigh more than this part of a shard are placed before the tree: at most 1 / HEAVY a shard.
HEAVY = 0.02
#: What a cut compares, in this order: a dimension, then the text, the document and the row, to part ties.
KEYS = ("c0", "t_text", "t_doc", "t_row")


@dataclass
class _Cut:
    """Search for one node's quantile: the key searched (an index of KEYS), what is fixed before it, the bounds."""

    node: int
    dim: str
    goal: float
    near: float
    heavy: float
    lo: float
    hi: float
    key: int = 0
    below: float = 0.0
    fixed: list = field(default_factory=list)
    found: tuple | None = None


def _points(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """size (UTF-8 bytes plus 1; null text: 1), CRC, dimensions and tie-breakers, and the columns to keep as _c0, _c1 and so on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, chars = F.octet_length(text).cast("long") + 1, F.char_length(text)
    unit = lambda c: F.shiftrightunsigned(c, 12).cast("double")  # noqa: E731  exact in a double
    spaces = chars - F.char_length(F.translate(text, " \t\n", ""))
    return docs.select(
        size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.log2(size.cast("double")).alias("d_size"), (size / (chars + 1)).alias("d_width"), (chars / (spaces + 1)).cast("double").alias("d_word"),
        unit(F.xxhash64(text)).alias("t_text"), unit(F.xxhash64(F.col(id_col), F.lit(7))).alias("t_doc"), unit(F.xxhash64(F.monotonically_increasing_id())).alias("t_row"), F.lit(0).cast("long").alias("node"),
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)],
    )


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, ...] = ("size", "text_crc32", "shard", "slot")) -> DataFrame:
    """docs (or its columns in `keep`) with size, text_crc32, shard and slot (gapless from 0 in each shard) for every row.

    Either the number of shards or the bytes a shard should hold. Sizes are near equal unless single documents are as
    large as shards. Equal texts share a shard unless no shard can hold them beside its even share. Null texts count as
    empty, null ids as one id; repeated rows are rows of their own; very long texts are points like others. New
    columns whose name docs has already get an underscore at the end. Empty table: empty.
    """
    keep = docs.columns if keep is None else keep
    own = fresh(docs.select(*[f"`{c}`" for c in keep]), *names)
    points = cut(_points(docs, id_col, text_col, keep))
    placed = _shards(points, n_shards, target_bytes).select("size", "text_crc32", "shard", "t_row", *[f"_c{i}" for i in range(len(keep))])
    # rows of a shard are numbered bucket by bucket; buckets are by row, so copies of one row are spread too
    n = blocks(points.count(), 20_000, 64)
    one = placed.withColumn("bucket", F.pmod(F.xxhash64("t_row"), F.lit(n))).withColumn("one", F.lit(1).cast("long"))
    slots = running_sum(one, ["shard"], "bucket", [F.col("t_row")], "one", "slot")
    return slots.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(o) for c, o in zip(("size", "text_crc32", "shard", "slot"), own, strict=True)])


def _shards(points: DataFrame, n_shards: int | None, target_bytes: int | None) -> DataFrame:
    """points with shard."""
    spark = points.sparkSession
    total = points.agg(F.sum("size")).first()[0]
    if total is None:
        return points.withColumn("shard", F.lit(0))
    n_shards = n_shards or blocks(total, target_bytes or 1 << 30)
    heavy, room = _place_heavy(points, total / n_shards, n_shards)
    whole = F.broadcast(spark.createDataFrame(heavy, "h_text double, h_crc long, h_size long, whole int"))
    same = (F.col("t_text") == F.col("h_text")) & (F.col("text_crc32") == F.col("h_crc")) & (F.col("size") == F.col("h_size"))
    points = points.join(whole, same, "left").drop("h_text", "h_crc", "h_size")
    levels, leaves = _fit(points.filter("whole is null").select("size", "node", *DIMS, *KEYS[1:]), room, HEAVY * total / n_shards)
    if not levels:  # one shard, or heavy groups alone
        return points.withColumn("shard", F.coalesce("whole", F.lit(0)))
    for level in levels:
        points = _descend(points, level)
    shard = F.broadcast(spark.createDataFrame(list(leaves.items()), "leaf long, at int"))
    return points.join(shard, F.col("node") == F.col("leaf"), "left").withColumn("shard", F.coalesce("whole", "at"))


def _place_heavy(points: DataFrame, goal: float, n_shards: int) -> tuple[list[tuple], list[float]]:
    """(text hash, CRC, size, shard) of the heavy groups of equal texts that are placed whole, and the room left in each shard."""
    groups = points.groupBy("t_text", "text_crc32", "size").agg(F.sum("size").alias("w"), F.count("*").alias("n")).filter(F.col("w") > HEAVY * goal)
    free = [(-goal, i) for i in range(n_shards)]
    placed = []
    for g in sorted(groups.collect(), key=lambda g: (-g["w"], g["t_text"])):
        if g["w"] <= -free[0][0] or g["n"] == 1:
            left, shard = heapq.heappop(free)
            heapq.heappush(free, (left + g["w"], shard))
            placed.append((g["t_text"], g["text_crc32"], g["size"], shard))
    return placed, [max(-left, 0.0) for left, _ in sorted(free, key=lambda x: x[1])]


def _fit(points: DataFrame, room: list[float], heavy: float) -> tuple[list[list[_Cut]], dict[int, int]]:
    """The cuts of each level of the tree, and the shard of each leaf."""
    extent = [f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
    span = points.agg(*extent).first()
    whole = {d: max(span[f"hi_{d}"] - span[f"lo_{d}"], 1e-12) for d in DIMS} if span[0] is not None else {}
    nodes = {0: (0, len(room))}  # node -> first shard, number of shards
    levels: list[list[_Cut]] = []
    tree = points
    while whole and any(k > 1 for _, k in nodes.values()):
        cuts = []
        for s in tree.groupBy("node").agg(F.sum("size").alias("w"), *extent).collect():
            at, k = nodes[s["node"]]
            if k > 1:
                dim = max(DIMS, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"]) / whole[d])
                left = sum(room[at : at + k // 2]) / max(sum(room[at : at + k]), 1e-12)
                cuts.append(_Cut(s["node"], dim, s["w"] * left, NEAR * s["w"], heavy, s[f"lo_{dim}"], s[f"hi_{dim}"]))
        for i in range(0, len(cuts), MAX_BINS // LEAST_BINS):
            _search(tree, cuts[i : i + MAX_BINS // LEAST_BINS])
        levels.append(cuts)
        tree = cut(_descend(tree, cuts))
        open_nodes = {c.node for c in cuts}
        children = {}
        for node, (at, k) in nodes.items():
            if node in open_nodes:
                children |= {2 * node + 1: (at, k // 2), 2 * node + 2: (at + k // 2, k - k // 2)}
            else:
                children[node] = (at, 1)
        nodes = children
    return levels, {node: at for node, (at, _) in nodes.items()}


def _coordinate() -> Column:
    return F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMS])


def _search(tree: DataFrame, cuts: list[_Cut]) -> None:
    """Narrows every open cut by one histogram pass at a time until all are found."""
    spark, todo = tree.sparkSession, [c for c in cuts if c.found is None]
    while todo:
        bins = max(LEAST_BINS, min(MOST_BINS, MAX_BINS // len(todo)))
        rows = [(c.node, c.dim, c.key, float(c.lo), float(c.hi), *([float(x) for x in c.fixed] + [0.0] * 3)[:3]) for c in todo]
        plan = F.broadcast(spark.createDataFrame(rows, "at long, dim string, key int, lo double, hi double, f0 double, f1 double, f2 double"))
        part = tree.join(plan, F.col("node") == F.col("at")).withColumn("c0", _coordinate())
        for i, k in enumerate(KEYS[:-1]):
            part = part.filter((F.col("key") <= i) | (F.col(k) == F.col(f"f{i}")))
        part = part.withColumn("v", F.coalesce(*[F.when(F.col("key") == i, F.col(k)) for i, k in enumerate(KEYS)])).filter("v between lo and hi")
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(F.lit(0))
        found: dict[int, list] = {}
        for r in part.groupBy("at", place.cast("int").alias("bin")).agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("size").alias("one")).collect():
            found.setdefault(r["at"], []).append((r["bin"], r["w"], r["lo"], r["hi"], r["one"]))
        for c in todo:
            below = c.below
            for _, w, lo, hi, _ in sorted(found[c.node]):
                if below + w >= c.goal:
                    break
                below += w
            before, after = (*c.fixed, math.nextafter(lo, -math.inf)), (*c.fixed, hi)
            light = lo == hi and c.key == 1 and w <= c.heavy  # copies of one text, few enough to move together
            if w <= c.near or light or (lo == hi and c.key == len(KEYS) - 1):
                c.found = before if c.goal - below < below + w - c.goal else after
            elif lo == hi:
                c.key, c.below, c.fixed, c.lo, c.hi = c.key + 1, below, [*c.fixed, lo], 0.0, float(1 << 52)
            else:
                c.below, c.lo, c.hi = below, lo, hi
        todo = [c for c in todo if c.found is None]


def _descend(tree: DataFrame, cuts: list[_Cut]) -> DataFrame:
    """Moves each row of a cut node to its child: left if (coordinate, text, document, row) is at most the cut."""
    rows = [(c.node, c.dim, len(c.found), *([float(x) for x in c.found] + [0.0] * 4)[:4]) for c in cuts]
    plan = F.broadcast(tree.sparkSession.createDataFrame(rows, "at long, dim string, depth int, x0 double, x1 double, x2 double, x3 double"))
    joined = tree.join(plan, F.col("node") == F.col("at"), "left").withColumn("c0", _coordinate())
    left = F.lit(True)  # equal in all that the cut names
    for i in range(len(KEYS) - 1, -1, -1):
        here, there = F.col(KEYS[i]), F.col(f"x{i}")
        left = F.when(F.col("depth") <= i, F.lit(True)).otherwise((here < there) | ((here == there) & left))
    child = F.when(F.col("at").isNull(), F.col("node")).when(left, F.col("node") * 2 + 1).otherwise(F.col("node") * 2 + 2)
    return joined.withColumn("node", child).select(*tree.columns)


def op4_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`."""
    sharded = kd_shards(read(spark, sf_dir, "documents"), n_shards=8, keep=["doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
