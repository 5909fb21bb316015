"""Near-duplicates by MinHash, with sequential Bayesian verification of banded candidates and an exact check.

1. Documents with the same word sequence are one class; the rest works on classes.
2. BANDS bands of ROWS minimum hashes: at similarity 0.75 a pair shares none with probability 2e-5. The buckets
   with the same least class form a group, whose members carry the bands by which they are in it; candidates are the
   pairs of a group that share such a band, which are exactly the pairs of some bucket.
3. Signatures of candidates are compared in batches of hashes (one byte each). A pair goes when the posterior
   probability that its similarity reaches the threshold, under a uniform prior, is at most MISS. Whole texts are
   fetched for survivors only, and compared on their full sets.
4. First each class is compared with the least class of its buckets alone, so a family of near copies becomes one
   component at the cost of its members, not of its pairs. Then only groups that hold several components are left;
   in these, members of different components are compared. A large group is dealt into parts of PART members, a large
   component into parts of its own, which do not meet each other; all other parts meet in blocks of two, so pairs
   never become rows, and a block returns one link a member at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import tokens
from .common import bitmap_split, connected_components, cut, fresh, frugal, lookup, read

BANDS, ROWS, WIDTH = 40, 5, 5
#: Least similarity in per cent, exact: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
BATCH, MISS, PART = 40, 1e-7, 128
#: Columns (shingles) of the membership matrix that counts intersections at a time.
COLUMNS = 1 << 15

_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum hashes, one row of BANDS * ROWS per nonempty set."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], at[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    each = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return tokens.mix((each * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def small_hashes(sig: np.ndarray) -> np.ndarray:
    """A byte of each minimum, from its mixed bits: the leading bits of a minimum of many hashes are zero."""
    return (tokens.mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def class_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's word sequence."""
    n = np.diff(at)
    place = (np.arange(len(h)) - np.repeat(at[:-1], n)).astype(np.uint64)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        v = tokens.mix(h + tokens.mix(place * np.uint64(2) + np.uint64(salt)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        out.append(tokens.mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = tokens.utf8(b.column(1))
        for i, j in tokens.slices(bounds):
            h, at = tokens.word_hashes(data, bounds[i : j + 1])
            sets, s_at = tokens.shingle_sets(h, at, WIDTH)
            n = np.diff(s_at)
            full = n > 0
            a, c = class_hashes(h, at)
            keys, sig = [None] * (j - i), [None] * (j - i)
            if full.any():
                own = signatures(sets, np.concatenate([s_at[:-1][full], s_at[-1:]]))
                bands, small = band_keys(own), small_hashes(own)
                for at_row, k in enumerate(np.flatnonzero(full)):
                    keys[k], sig[k] = bands[at_row], small[at_row].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(a, mask=~full), pa.array(c, mask=~full), pa.array(n.astype(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "ca", "cb", "n", "bands", "sig"])


@lru_cache
def least_matches(threshold: float = THRESHOLD / 100, batch: int = BATCH, total: int = BANDS * ROWS, miss: float = MISS) -> list[int]:
    """For each number of hashes compared so far, the least matches at which P(similarity >= threshold) > miss.

    One-byte hashes also match by chance: p = s + (1 - s) / 256 for similarity s.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p, out = s + (1 - s) / 256, []
    for n in range(batch, total + 1, batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        out.append(int(np.argmax(like[:, s >= threshold].sum(axis=1) > miss * like.sum(axis=1))))
    return out


def candidates(sig: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which allowed pairs of a block survive the bounds on sizes and, batch by batch, on matching hashes."""
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    i, j = np.nonzero(np.triu(allowed, 1) & (100 * low >= THRESHOLD * high))
    matches = np.zeros(len(i), np.int64)
    for k, need in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (sig[i, part] == sig[j, part]).sum(axis=1)
        left = matches >= need
        i, j, matches = i[left], j[left], matches[left]
    return np.stack([i, j], axis=1)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of membership matrices of COLUMNS shingles at a time."""
    known, which = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(which, kind="stable")
    which, row, out = which[order], row[order], np.zeros((len(sets), len(sets)))
    for at in range(0, len(known), COLUMNS):
        lo, hi = np.searchsorted(which, [at, at + COLUMNS])
        member = np.zeros((len(sets), min(COLUMNS, len(known) - at)), np.float32)
        member[row[lo:hi], which[lo:hi] - at] = 1
        out += member @ member.T
    return np.rint(out).astype(np.int64)


def allowed_pairs(part: np.ndarray, mask: np.ndarray, root: np.ndarray, same_part: bool) -> np.ndarray:
    """Pairs of a block that share a band of the group, are in different components, and are this block's to compare."""
    low, high = (mask & 0xFFFFF).astype(np.int64), (mask >> 20).astype(np.int64)
    bits = np.arange(20)
    own = np.concatenate([(low[:, None] >> bits) & 1, (high[:, None] >> bits) & 1], axis=1).astype(np.float32)
    may = (own @ own.T > 0) & (root[:, None] != root[None, :])
    return may if same_part else may & (part[:, None] != part[None, :])


def block_links(nid: np.ndarray, pairs: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(member, least member of its local component) for the members of a block that reach the threshold with another."""
    if not len(pairs):
        return []
    used, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    size = np.array([len(sets[u]) for u in used])
    if len(pairs) > 4 * len(used):
        both = intersections([sets[u] for u in used])[at[:, 0], at[:, 1]]
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs])
    linked = at[100 * both >= THRESHOLD * (size[at[:, 0]] + size[at[:, 1]] - both)]
    label = nid[used].copy()
    while len(linked):
        low = np.minimum(label[linked[:, 0]], label[linked[:, 1]])
        new = label.copy()
        np.minimum.at(new, linked[:, 0], low)
        np.minimum.at(new, linked[:, 1], low)
        if (new == label).all():
            break
        label = new
    some = np.unique(linked)
    return [(int(nid[used[k]]), int(label[k])) for k in some if nid[used[k]] != label[k]]


#: Columns of a block's rows: the block, the member, its part, bands and component, its signature and set size.
_BLOCK = ("low", "x", "y")
_MEMBER = ("nid", "part", "mask", "root", "sig", "n")


class _Blocks:
    """Gathers rows that are sorted by block, one block (at most two parts of a group) at a time."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.rows: dict[int, tuple] = {}

    def pairs(self) -> tuple[np.ndarray, np.ndarray, list]:
        """Members in ascending order, the pairs of them whose signatures survive, and what else they carry."""
        nid = np.array(sorted(self.rows))
        part, mask, root, sig, size, more = zip(*(self.rows[i] for i in nid.tolist()), strict=True)
        may = allowed_pairs(np.array(part), np.array(mask), np.array(root), self.key[1] == self.key[2])
        signatures = np.frombuffer(b"".join(sig), np.uint8).reshape(len(nid), -1)
        return nid, candidates(signatures, np.array(size), may), list(more)


_BLOCK_SCHEMA = "low long, x long, y long, nid long, part long, mask long, root long, sig binary, n long"


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block's members that some pair of signatures leaves to the exact check."""
    held, types = _Blocks(), [pa.int64()] * 7 + [pa.binary(), pa.int64()]

    def done() -> list[tuple]:
        if len(held.rows) < 2:
            return []
        nid, pairs, _ = held.pairs()
        return [(*held.key, i, *held.rows[i][:5]) for i in nid[np.unique(pairs)].tolist()]

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], [*_BLOCK, *_MEMBER])

    for b in batches:
        out: list[tuple] = []
        for row in zip(*(b.column(c).to_pylist() for c in (*_BLOCK, *_MEMBER)), strict=True):
            if held.key != row[:3]:
                out += done()
                held.key, held.rows = row[:3], {}
            held.rows[row[3]] = (*row[4:], None)
        yield table(out)
    yield table(done())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block's survivors, by their full sets."""
    held = _Blocks()

    def done() -> list[tuple[int, int]]:
        return block_links(*held.pairs()) if len(held.rows) > 1 else []

    for b in batches:
        data, bounds = tokens.utf8(b.column("text"))
        columns = [b.column(c).to_pylist() for c in (*_BLOCK, *_MEMBER)]
        rows = list(zip(*columns, strict=True))
        found: list[tuple[int, int]] = []
        for i, j in tokens.slices(bounds):
            h, at = tokens.word_hashes(data, bounds[i : j + 1])
            sets, s_at = tokens.shingle_sets(h, at, WIDTH)
            for k in range(i, j):
                if held.key != rows[k][:3]:
                    found += done()
                    held.key, held.rows = rows[k][:3], {}
                held.rows[rows[k][3]] = (*rows[k][4:], sets[s_at[k - i] : s_at[k - i + 1]].copy())
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["a", "b"])
    found = done()
    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["a", "b"])


def _verified(placed: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of the blocks in placed (the columns of _BLOCK and _MEMBER)."""
    dealt = placed.select(*_BLOCK, *_MEMBER).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    left = cut(dealt.mapInArrow(frugal(_survivors), _BLOCK_SCHEMA))
    if left.isEmpty():
        return left.select(F.col("low").alias("a"), F.col("nid").alias("b"))
    # one text for each surviving class: of the rows under its least id, one of its words
    member = cut(left.select("nid").distinct().join(reps.select("nid", "rep_id", "ca", "cb"), "nid"))
    near, _ = bitmap_split(docs, "doc_id", member, "rep_id")
    texts = _with_class(near, "ca", "cb").groupBy("ca", "cb").agg(F.min("text").alias("text"))
    texts = texts.join(member.select("nid", "ca", "cb"), ["ca", "cb"]).select("nid", "text")
    rows = left.join(texts, "nid").select(*_BLOCK, *_MEMBER, "text")
    return cut(rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(frugal(_compare), "a long, b long").distinct())


def _components(groups: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the classes in groups (low, nid, mask): every link of two members of a bucket counts."""
    parts = lambda size: F.ceil(F.col(size) / PART).cast("long")
    part = lambda n: F.pmod(F.xxhash64("nid"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # a class and its groups, of which it has at most BANDS
    classes = groups.groupBy("nid").agg(F.collect_list(F.struct("low", "mask")).alias("in")).join(reps.select("nid", "sig", "n"), "nid")
    classes = cut(classes.withColumn("first", F.array_min("in")))
    # each class, in part x, meets the least class of its buckets, in part -1 of each block
    others = classes.select("first.low", "first.mask", "nid", "sig", "n").filter("nid != low")
    sizes = cut(others.groupBy("low").agg(F.count("*").alias("size")).withColumn("parts", parts("size")))
    others = lookup(others, sizes, ["low"], "size", "inner").withColumn("x", part("parts")).withColumn("part", F.col("x"))
    least = classes.join(sizes.withColumnRenamed("low", "nid"), "nid").withColumn("low", F.col("nid")).withColumn("mask", F.lit((1 << BANDS) - 1))
    least = least.withColumn("x", F.explode(upto("parts"))).withColumn("part", F.lit(-1).cast("long"))
    columns = ["low", "x", F.lit(-1).cast("long").alias("y"), "nid", "part", "mask", F.col("nid").alias("root"), "sig", "n"]
    first = _verified(others.select(*columns).unionByName(least.select(*columns)), reps, docs)
    roots = cut(connected_components(first))
    # groups of several components; a pair alone in its group is done only if the group was the first of its greater class
    known = classes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    known = known.withColumn("g", F.explode("in")).withColumn("open", ~F.col("g.low").isin(F.col("nid"), F.col("first.low")))
    known = cut(known.select("g.low", "g.mask", "nid", "root", "sig", "n", "open"))
    sizes = known.groupBy("low", "root").agg(F.count("*").alias("of_root"), F.bool_or("open").alias("open"))
    spread = sizes.groupBy("low").agg(F.count("*").alias("roots"), F.sum("of_root").alias("size"), F.sum(F.when(F.col("of_root") <= PART, F.col("of_root")).otherwise(0)).alias("pooled"), F.bool_or("open").alias("open"))
    spread = spread.filter("roots > 1 and (size > 2 or open)").drop("open")
    spread = cut(spread.withColumn("pool", parts("pooled")))
    if spread.isEmpty():
        return roots
    # parts of the pool of small components come first in a group, then those of each large one
    large = sizes.filter(F.col("of_root") > PART).join(spread.select("low", "pool"), "low").withColumn("own", parts("of_root"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("low").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = cut(large.select("low", "root", "own", (F.col("pool") + before).alias("start")))
    ends = cut(spread.join(large.groupBy("low").agg(F.sum("own").alias("large")), "low", "left").select("low", "size", "pool", (F.col("pool") + F.coalesce("large", F.lit(0))).alias("parts")))
    rest = lookup(known.drop("open"), ends, ["low"], "size", "inner")
    rest = rest.join(F.broadcast(large) if large.count() <= 100_000 else large, ["low", "root"], "left")
    rest = rest.withColumn("part", F.when(F.col("own").isNull(), part("pool")).otherwise(F.col("start") + part("own")))
    meets = F.filter(upto("parts"), lambda i: F.col("own").isNull() | (i < F.col("start")) | (i >= F.col("start") + F.col("own")))
    block = F.explode(F.transform(meets, lambda i: F.struct(F.least(i, "part").alias("x"), F.greatest(i, "part").alias("y"))))
    second = _verified(rest.withColumn("b", block).select("low", "b.x", "b.y", "nid", "part", "mask", "root", "sig", "n"), reps, docs)
    if second.isEmpty():
        return roots
    return connected_components(first.unionByName(second))


def _decided(docs: DataFrame) -> DataFrame:
    """doc_id, ca, cb, n of every row of docs (doc_id, text), and the id and class that stand for its component: the
    least id, nulls last, and of the classes under it the least. They are null for texts without words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = cut(docs.mapInArrow(frugal(_describe), f"doc_id {id_type}, ca long, cb long, n long, bands array<long>, sig binary"))
    reps = base.filter("n > 0").groupBy("ca", "cb").agg(F.min("doc_id").alias("rep_id"), F.first(F.struct("n", "bands", "sig")).alias("x"))
    reps = cut(reps.select("ca", "cb", "rep_id", "x.*", F.monotonically_increasing_id().alias("nid")))
    band = reps.select("nid", F.posexplode("bands").alias("band", "key"))
    full = cut(band.groupBy("key").agg(F.min("nid").alias("low"), F.count("*").alias("size")).filter("size > 1"))
    mask = F.bit_or(F.expr("shiftleft(1L, band)"))
    groups = cut(lookup(band, full, ["key"], "size").filter("low is not null").groupBy("low", "nid").agg(mask.alias("mask")))
    roots = _components(groups, reps, docs)
    own = F.struct(F.col("rep_id").isNull().alias("none"), F.col("rep_id").alias("id"), F.col("ca").alias("ca"), F.col("cb").alias("cb"))
    best = roots.join(reps.select("nid", own.alias("own")), F.col("node") == F.col("nid")).groupBy("root").agg(F.min("own").alias("best"))
    named = lookup(roots, best, ["root"]).select("node", "best")
    classes = reps.join(named, F.col("nid") == F.col("node"), "left").withColumn("best", F.coalesce("best", own))
    classes = cut(classes.select("ca", "cb", F.col("best.id").alias("best_id"), F.col("best.ca").alias("best_ca"), F.col("best.cb").alias("best_cb")))
    return lookup(base.select("doc_id", "ca", "cb", "n"), classes, ["ca", "cb"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts without words (null, empty, white space) have no set: they are linked with nothing and kept. Rows of the
    same words are one class, whatever their ids; rows that repeat an id and text are in one class too and share
    `kept`. A null id takes part, but is never a component's id unless all its ids are null. Other columns are
    ignored. Empty table: empty.
    """
    found = _decided(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    out = found.withColumn("component_id", F.coalesce("best_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def _with_class(docs: DataFrame, ca: str, cb: str) -> DataFrame:
    """Adds the class of each row under the names ca and cb; null for texts without words."""
    at, names = docs.columns.index("text"), [*docs.columns, ca, cb]

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = tokens.utf8(b.column(at))
            for i, j in tokens.slices(bounds):
                h, own = tokens.word_hashes(data, bounds[i : j + 1])
                none = np.diff(own) == 0
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, *(pa.array(c, mask=none) for c in class_hashes(h, own))], names)

    return docs.mapInArrow(frugal(classes), StructType([*docs.schema.fields, StructField(ca, LongType()), StructField(cb, LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs of each component of near_duplicates, the one of the least id, nulls last (of several texts of
    that id one, by a hash), and the rows without words, of which those that repeat an id and text are one. Of rows
    that repeat an id and words, the least stays, by all columns.

    Rows go by id and text, not by id: ids may be null or stand for several texts. Columns of any name are kept as they are.
    """
    found = cut(_decided(docs.select("doc_id", "text")))
    stands = F.col("ca").eqNullSafe(F.col("best_ca")) & F.col("cb").eqNullSafe(F.col("best_cb")) & (F.col("ca").isNull() | F.col("doc_id").eqNullSafe(F.col("best_id")))
    ca, cb, gone_id, gone_ca, gone_cb, row, bare = fresh(docs, "ca", "cb", "gone_id", "gone_ca", "gone_cb", "row", "bare")
    gone = found.filter(~stands).select(F.col("doc_id").alias(gone_id), F.col("ca").alias(gone_ca), F.col("cb").alias(gone_cb)).distinct()
    maybe, kept = bitmap_split(docs, "doc_id", gone, gone_id)
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(ca) == F.col(gone_ca)) & (F.col(cb) == F.col(gone_cb))
    rest = _with_class(maybe, ca, cb).join(gone, same, "left_anti").select(docs.columns)
    twice = found.filter(stands).groupBy("doc_id", "ca", "cb").count().filter("count > 1").select(F.col("doc_id").alias(gone_id))
    out = kept.unionByName(rest)
    if twice.isEmpty():
        return out
    again, once = bitmap_split(out, "doc_id", twice, gone_id)
    again = _with_class(again, ca, cb).withColumn(bare, F.when(F.col(ca).isNull(), F.col("text")))
    least = F.first if "map<" in docs.schema.simpleString() else F.min  # maps have no order
    one = again.groupBy(F.col("doc_id"), ca, cb, bare).agg(least(F.struct(*[F.col(c) for c in docs.columns])).alias(row))
    return once.unionByName(one.select(f"{row}.*"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON a = sa.doc_id JOIN s sb ON b = sb.doc_id WHERE 100 * n >= 75 * (len(sa.s) + len(sb.s) - n)),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON a = doc_id
"""
