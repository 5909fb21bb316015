"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its permutation: its NEAREST nearest pivots, the nearest first. The inverted lists are keyed
by label and pivot, and a vector stands in the lists of its first LISTS pivots, with its permutation. In a list, the
pivots that two vectors share are counted and the distance of their orders is summed; only pairs with SHARED shared
pivots whose order distance is at most FOOTRULE are verified by their cosine, each in the list of the smallest pivot
that both stand under, which counts it once. Lists longer than BLOCK are verified block by block, so that no task holds a whole
list, and a block returns counts and a spanning star for each component, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, lookup, read

COSINE, NEAREST, LISTS, BLOCK = 0.98, 8, 3, 400
#: Pivots a pair must share, and the most its order distance may be (induced footrule: places between the shared
#: pivots of both, and NEAREST less its place for each pivot of one alone; the largest is NEAREST * (NEAREST + 1)).
SHARED, FOOTRULE = 4, 40
#: Pivots come from a sample of at most SAMPLE vectors (least hashes of their ids), no two nearer than SPREAD. There
#: are as many as the root of the number of vectors, so lists and work per vector grow alike.
SAMPLE, SPREAD, LEAST_PIVOTS = 20_000, 0.7, 128
#: Least part of the sample's near pairs that the index finds; else fewer pivots are used.
SAMPLE_RECALL = 0.97


def choose_pivots(sample: np.ndarray, count: int, spread: float = SPREAD) -> np.ndarray:
    """Unit rows of the sample, in order, that are not within `spread` of one chosen before.

    A narrow sample has few of them; the rows farthest from all chosen ones then fill them up to LEAST_PIVOTS. As
    close pivots separate near vectors, only so many of these are used that the index finds the sample's near pairs;
    with at most LISTS pivots, all vectors of a label meet.
    """
    dim = sample.shape[1] if sample.ndim == 2 else 0
    pivots, n = np.zeros((min(count, len(sample)), dim)), 0
    for x in sample:
        if n == len(pivots):
            break
        if not n or (pivots[:n] @ x).max() < spread:
            pivots[n], n = x, n + 1
    if n < min(LEAST_PIVOTS, len(pivots)):
        nearest = (sample @ pivots[:n].T).max(axis=1) if n else np.zeros(0)
        while n < min(LEAST_PIVOTS, len(pivots)):
            pivots[n] = sample[np.argmin(nearest)]
            nearest = np.maximum(nearest, sample @ pivots[n])
            n += 1
    for k in sorted({n, *(2**i for i in range(2, 15) if 2**i < n)}, reverse=True):
        if k <= LISTS or sample_recall(sample, pivots[:k]) >= SAMPLE_RECALL:
            return pivots[:k]
    return pivots[: min(LISTS, n)]


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the NEAREST nearest pivots of each unit row, the nearest first; ties: the smaller number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int32)


def order_distance(top: np.ndarray, other: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Order distance of the permutations in the same row of two tables."""
    k = top.shape[1]
    i, j = np.arange(k)[:, None], np.arange(k)[None, :]
    weight = (np.abs(i - j) - (k - i) - (k - j)).ravel().astype(np.float32)
    out = np.full(len(top), k * (k + 1), np.float32)
    for at in range(0, len(top), step):
        same = top[at : at + step, :, None] == other[at : at + step, None, :]
        out[at : at + step] += same.reshape(len(same), -1) @ weight
    return np.rint(out).astype(np.int32)


def candidates(top: np.ndarray, other: np.ndarray, pivots: int) -> np.ndarray:
    """Which pairs of rows are verified: they share SHARED pivots (all, if there are fewer), in orders near enough."""
    known, which = np.unique(np.concatenate([top.ravel(), other.ravel()]), return_inverse=True)
    marks = np.zeros((len(top) + len(other), len(known)), np.float32)
    marks[np.repeat(np.arange(len(marks)), top.shape[1]), which] = 1
    may = marks[: len(top)] @ marks[len(top) :].T > min(SHARED, pivots) - 0.5
    i, j = np.nonzero(may)
    may[i, j] = order_distance(top[i], other[j]) <= FOOTRULE
    return may


def sample_recall(sample: np.ndarray, pivots: np.ndarray, rows: int = 2000, step: int = 200) -> float:
    """Of the near pairs of the first `rows` sample rows with any, the part that the index finds; 1 if there is none."""
    top = permutations(sample, pivots)
    marks = np.zeros((len(sample), len(pivots)), np.float32)
    np.put_along_axis(marks, top[:, :LISTS], 1, axis=1)
    pairs = met = 0
    for at in range(0, min(rows, len(sample)), step):
        near = sample[at : at + step] @ sample.T >= COSINE
        near[np.arange(len(near)), at + np.arange(len(near))] = False
        some = near.any(axis=0)
        if not some.any():
            continue
        pairs += int(near.sum())
        found = candidates(top[at : at + step], top[some], len(pivots)) & (marks[at : at + step] @ marks[some].T > 0)
        met += int((near[:, some] & found).sum())
    return met / pairs if pairs else 1.0


def _unit(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(kind: str):
    """(vec_id, label, bytes of the vector, its length); bytes are null where the vector can't be compared."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for v in b.column(2):
                x = np.array(v.as_py(), np.float64) if v.is_valid and None not in v.as_py() else np.zeros(0)
                good = bool(len(x)) and bool(np.isfinite(x).all()) and bool(x.any())
                out.append(x.astype(kind).tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "label", "vec", "dim"])
    return pack


def verify_block(key: tuple, nid: np.ndarray, vec: list[bytes], top: np.ndarray, copies: np.ndarray, part: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of one block, rows in ascending nid: its linked nodes, the copies they link with in pairs of this list's own,
    and the least node of each one's local component. key: label, length, number of pivots, the list's pivot, block."""
    _, dim, pivots, p, bx, by = key
    may = candidates(top, top, pivots)
    np.fill_diagonal(may, False)
    if bx != by:
        may &= part[:, None] != part[None, :]
    some = may.any(axis=1)
    if not some.any():
        return None
    x = _unit([v for v, s in zip(vec, some, strict=True) if s], dim, kind)
    near, nid, top, copies = may[np.ix_(some, some)] & (x @ x.T >= COSINE), nid[some], top[some], copies[some]
    some = near.any(axis=1)
    if not some.any():
        return None
    near, nid, top, copies = near[np.ix_(some, some)], nid[some], top[some], copies[some]
    label = np.arange(len(nid))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(nid)).min(axis=1))
        if (low == label).all():
            break
        label = low
    lists = top[:, :LISTS]
    smaller = np.unique(lists[lists < p])
    marks = (lists[:, :, None] == smaller[None, None, :]).any(axis=1).astype(np.float32)
    own = near & (marks @ marks.T == 0)
    return nid, (own * copies[None, :]).sum(axis=1), nid[label]


def _verify(kind: str):
    """Rows sorted by block and nid; one block (at most 2 * BLOCK rows or so) is held at a time."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, list] | None = None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim", "pivots", "p", "x", "y")), strict=True))
            rows = list(zip(*(b.column(c).to_pylist() for c in ("nid", "vec", "top", "copies", "part")), strict=True))
            found, at = [], 0
            for end in [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]:
                if held and (end == at or keys[at] != held[0]):
                    found.append(_done(held, kind))
                    held = None
                if end > at:
                    held = (keys[at], (held[1] if held else []) + rows[at:end])
                at = end
            yield _table([f for f in found if f])
        if held:
            yield _table([f for f in [_done(held, kind)] if f])
    return verify


def _done(held: tuple[tuple, list], kind: str) -> tuple | None:
    key, rows = held
    if len(rows) < 2:
        return None
    nid, vec, top, copies, part = zip(*rows, strict=True)
    return verify_block(key, np.array(nid), list(vec), np.array(top), np.array(copies), np.array(part), kind)


def _table(found: list[tuple]) -> pa.RecordBatch:
    each = [np.concatenate([np.asarray(f[c], np.int64) for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in each], ["nid", "links", "root"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Vectors are compared only under equal, non-null labels and equal lengths. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing. Equal vectors of one label are one class with a number of
    copies, which link with each other. Repeated rows are copies. A null id is a component's id only if all its ids
    are null. Other columns are ignored. Empty table: empty.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    types = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    packed = rows.mapInArrow(_pack(kind), f"vec_id {types['vec_id']}, label {types['label']}, vec binary, dim int")
    base = cut(packed.withColumn("hash", F.when(F.col("label").isNotNull() & F.col("vec").isNotNull(), F.md5("vec"))))
    reps = base.filter("hash is not null").groupBy("label", "hash").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    reps = cut(reps.withColumn("nid", F.monotonically_increasing_id()))
    dims = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    spark, tops = rows.sparkSession, []
    for dim, n in dims.items():
        sample = reps.filter(F.col("dim") == dim).orderBy(F.xxhash64("hash")).limit(SAMPLE).select("vec").collect()
        pivots = choose_pivots(_unit([r[0] for r in sample], dim, kind), max(LEAST_PIVOTS, math.isqrt(n)))
        shared = spark.sparkContext.broadcast(pivots)

        def describe(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    top = permutations(_unit(b.column(1).to_pylist(), dim, kind), shared.value)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top.tolist(), pa.list_(pa.int32()))], ["nid", "top"])

        described = reps.filter(F.col("dim") == dim).select("nid", "vec").mapInArrow(describe, "nid long, top array<int>")
        tops.append(described.withColumn("pivots", F.lit(len(pivots))))
    if not tops:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    top = cut(top)
    lists = reps.select("nid", "label", "dim").join(top, "nid").withColumn("p", F.explode(F.slice("top", 1, LISTS)))
    keys = ["label", "dim", "pivots", "p"]
    sizes = lists.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1")
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    members = lists.join(sizes, keys).withColumn("n", n).withColumn("part", F.pmod(F.xxhash64("nid"), F.col("n")).cast("int"))
    block = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least(i, "part").alias("x"), F.greatest(i, "part").alias("y"))))
    placed = members.withColumn("b", block).select(*keys, "b.x", "b.y", "nid", "top", "part").join(reps.select("nid", "vec", "copies"), "nid")
    dealt = placed.repartition(*keys, "x", "y").sortWithinPartitions(*keys, "x", "y", "nid")
    found = cut(dealt.select(*keys, "x", "y", "nid", "vec", "top", "copies", "part").mapInArrow(_verify(kind), "nid long, links long, root long"))
    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("nid").alias("a"), F.col("root").alias("b")))
    ids = roots.join(reps.select("nid", "rep_id"), F.col("node") == F.col("nid")).groupBy("root").agg(F.min("rep_id").alias("component_id"))
    named = lookup(roots, ids, ["root"]).join(links, F.col("node") == F.col("nid"), "left").select("node", "component_id", "links")
    classes = cut(reps.join(named, F.col("nid") == F.col("node"), "left").select("label", "hash", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep_id").alias("component_id")))
    out = lookup(base.select("vec_id", "label", "hash"), classes, ["label", "hash"]).withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
