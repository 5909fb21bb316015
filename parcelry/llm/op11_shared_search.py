"""Ranked lexical search for many items at once, with common subexpressions evaluated once.

An item's score of a document is a sum over the item's terms, so items that hold the same terms share partial sums. The
terms of a block of items are mined for shared sets: terms of the same items become one atom, then pairs of nodes that
several items hold become a node of their own, again and again. The result is a directed acyclic graph whose leaves are
terms and whose nodes are term sets. For each batch of documents every node's partial sums are made once, level by
level, and each item adds the nodes that are left to it. Integers add in any order, so scores are exact.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, cut, fresh, read

TOP = 20
#: A block of items has about so many term occurrences, and so many bytes of terms; more items take more passes.
BLOCK_TERMS, BLOCK_BYTES = 100_000, 4_000_000
#: Pairs of an item's nodes that are counted: each with so many that follow it in the order of support.
REACH = 8
#: Cells of the partial sums of one step (8 bytes each).
CELLS = 4_000_000
#: Salts of the first of the two rankings.
SALTS = 64

# Terms: bytes of UTF-8 other than ASCII punctuation, space and control; A-Z as a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


class Plan:
    """The query-sharing graph of some items, as arrays.

    Nodes are atoms first, then sums of two earlier nodes. `atom_terms`, `atom_times`, `atom_at`: the terms of each atom
    and how often each counts. `levels`: arrays (node, left, right) whose operands lie in earlier levels. `item_nodes`,
    `item_at`: the nodes whose sum is the item's score.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        counts = [Counter(terms) for _, terms in items if terms]
        self.ids = [i for i, terms in items if terms]
        self.terms = sorted({t for c in counts for t in c})
        number = {t: k for k, t in enumerate(self.terms)}
        holders: dict[tuple[int, int], list[int]] = defaultdict(list)  # the j-th occurrence of a term: the items that have it
        for i, c in enumerate(counts):
            for t, n in c.items():
                for j in range(n):
                    holders[number[t], j].append(i)
        atoms: dict[tuple[int, ...], Counter] = defaultdict(Counter)
        for (t, _), who in holders.items():
            atoms[tuple(who)][t] += 1
        self.held: list[set[int]] = []
        flat, times, at = [], [], [0]
        for who, inside in sorted(atoms.items()):
            self.held.append(set(who))
            flat += sorted(inside)
            times += [inside[t] for t in sorted(inside)]
            at.append(len(flat))
        self.atom_terms, self.atom_times, self.atom_at = np.array(flat, np.int64), np.array(times, np.int64), np.array(at, np.int64)
        self.n_atoms = len(self.held)
        pairs = self._shared(len(counts))
        depth = [0] * self.n_atoms
        for a, b in pairs:
            depth.append(1 + max(depth[a], depth[b]))
        by_level: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (a, b) in enumerate(pairs, self.n_atoms):
            by_level[depth[k]].append((k, a, b))
        self.levels = [np.array(by_level[d], np.int64) for d in sorted(by_level)]
        self.n_nodes = self.n_atoms + len(pairs)
        lists: list[list[int]] = [[] for _ in counts]
        for node, who in enumerate(self.held):
            for i in who:
                lists[i].append(node)
        self.item_nodes = np.array([n for x in lists for n in x], np.int64)
        self.item_at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.plain_adds = sum(map(len, counts)) - len(counts)
        self.adds = len(flat) - self.n_atoms + len(pairs) + len(self.item_nodes) - len(counts)
        del self.held

    def _shared(self, n_items: int) -> list[tuple[int, int]]:
        """Merges pairs of nodes that two or more items hold, those of most items first, until there are none within
        REACH; a merged item holds the new node instead of the two."""
        pairs: list[tuple[int, int]] = []
        while True:
            lists: list[list[int]] = [[] for _ in range(n_items)]
            for node in sorted((k for k, who in enumerate(self.held) if len(who) > 1), key=lambda k: (-len(self.held[k]), k)):
                for i in self.held[node]:
                    lists[i].append(node)
            seen = Counter((a, b) for x in lists for p, a in enumerate(x) for b in x[p + 1 : p + 1 + REACH])
            merged = False
            for (a, b), n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
                if n < 2:
                    break
                both = self.held[a] & self.held[b]
                if len(both) > 1:
                    self.held[a] -= both
                    self.held[b] -= both
                    self.held.append(both)
                    pairs.append((a, b))
                    merged = True
            if not merged:
                return pairs

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """weights (terms x documents): what one occurrence of a term in an item adds; returns items x documents."""
        nodes = np.empty((self.n_nodes, weights.shape[1]), np.int64)
        if self.n_atoms:
            nodes[: self.n_atoms] = np.add.reduceat(weights[self.atom_terms] * self.atom_times[:, None], self.atom_at[:-1], axis=0)
        for level in self.levels:
            nodes[level[:, 0]] = nodes[level[:, 1]] + nodes[level[:, 2]]
        return np.add.reduceat(nodes[self.item_nodes], self.item_at[:-1], axis=0)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(terms_of(t)) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def plans(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(block, plan): the pickled graph of each block of items. Rows that repeat id and terms are one item; items of one
    id with other terms are items of their own; items without terms are in no plan."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(_item_terms, f"item_id {kind}, terms array<binary>").filter("size(terms) > 0").distinct())
    n_terms, n_bytes = rows.agg(F.sum(F.size("terms")), F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t)))).first()
    n = max(blocks(n_terms or 0, BLOCK_TERMS), blocks(n_bytes or 0, BLOCK_BYTES))

    def mine(table: pa.Table) -> pa.Table:
        found = sorted(zip(table["item_id"].to_pylist(), table["terms"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        return pa.table({"block": table["block"][:1], "plan": pa.array([pickle.dumps(Plan(found))], pa.binary())})

    return cut(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(n))).groupBy("block").applyInArrow(mine, "block long, plan binary"))


def _held_terms(docs: DataFrame, kind: str, vocabulary) -> DataFrame:
    """(doc_id, n, t, f) of the documents that have terms: number of terms, the known ones and how often each occurs."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            ids, n, t, f, at = [], [], [], [], [0]
            for i, text in enumerate(b.column(1)):
                terms = terms_of(text.cast(pa.large_binary()).as_py())
                if terms:
                    own = [(known[x], c) for x, c in Counter(terms).items() if x in known]
                    own.sort()
                    ids.append(i)
                    n.append(len(terms))
                    t += [k for k, _ in own]
                    f += [c for _, c in own]
                    at.append(len(t))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (t, f)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "t", "f"])

    return docs.mapInArrow(held, f"doc_id {kind}, n long, t array<int>, f array<int>")


class Best:
    """The `top` best documents of each item so far: by score, then by id, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, np.int64)
        self.item, self.score, self.lost, self.doc = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, docs: np.ndarray, lost: np.ndarray) -> None:
        item, k = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        parts = [np.concatenate(x) for x in ((self.item, item), (self.score, scores[item, k]), (self.lost, lost[k]), (self.doc, docs[k]))]
        order = np.lexsort((parts[3], parts[2], -parts[1], parts[0]))
        item = parts[0][order]
        first = np.searchsorted(item, item, "left")
        order = order[np.arange(len(item)) - first < self.top]
        self.item, self.score, self.lost, self.doc = (x[order] for x in parts)
        full, n = np.unique(self.item, return_counts=True)
        last = np.searchsorted(self.item, full, "right") - 1
        self.floor[full[n == self.top]] = self.score[last[n == self.top]]


def _ranked(held: DataFrame, kind: str, item_kind: str, plan, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best documents of each item within each partition."""

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        step = max(1, CELLS // max(1, p.n_nodes + len(p.terms) + len(p.item_nodes)))
        found = Best(len(p.ids), top)
        for b in batches:
            t, f = b.column(2), b.column(3)
            at = np.asarray(t.offsets, np.int64)
            t, f = np.asarray(t.values, np.int64), np.asarray(f.values, np.int64)
            lost = np.asarray(b.column(0).is_null()).astype(np.int64)
            docs = np.asarray(b.column(0).cast(pa.int64()).fill_null(0), np.int64)
            m = 100 - 25 + (25 * np.asarray(b.column(1), np.int64) * n_docs) // n_terms
            for lo in range(0, b.num_rows, step):
                hi = min(lo + step, b.num_rows)
                own = slice(at[lo], at[hi])
                which = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                cells = np.zeros((len(p.terms), hi - lo), np.int64)
                cells[t[own], which] = weights[t[own]] * ((1_000_000_000 * f[own]) // (1000 * f[own] + 12 * m[lo:hi][which]))
                found.add(p.scores(cells), docs[lo:hi], lost[lo:hi])
        ids = pa.array([p.ids[i] for i in found.item.tolist()])
        out = pa.array(found.doc, pa.int64(), mask=found.lost.astype(bool))
        yield pa.RecordBatch.from_arrays([ids.cast(item_kind), pa.array(found.item), out, pa.array(found.score)], ["item_id", "item", "doc_id", "score"])

    item_kind = pa.int64() if item_kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    return held.mapInArrow(best, f"item_id {'long' if item_kind == pa.int64() else 'string'}, item long, doc_id long, score long")


def shared_search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of score above 0 of each item; equal scores by ascending id,
    null ids last. Ids of documents are integers, ids of items integers or strings.

    Null, empty and wordless texts have no terms: such documents are found by no item and count in no statistic, such
    items find nothing. Rows that repeat a document are documents of their own with ranks of their own; repeated items are
    one. Empty tables give an empty result. Only the id and text columns are read, whatever else there is.

    The documents are read once for each block of items; what is kept of them is one row each, of the block's terms in
    it. Each partition sends at most `top` rows an item to the ranking, which is salted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"))
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    found = plans(items, item_id, text_col)
    out = None
    for (block,) in found.select("block").sort("block").collect():
        plan = pickle.loads(found.filter(F.col("block") == block).select("plan").first()[0])
        vocabulary = spark.sparkContext.broadcast({t: k for k, t in enumerate(plan.terms)})
        held = cut(_held_terms(rows, kind, vocabulary))
        n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        # at most a row for each of the block's terms
        weight = held.select(F.explode("t").alias("t")).groupBy("t").count().select("t", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("count") + 1))).alias("w"))
        weights = np.zeros(len(plan.terms), np.int64)
        for t, w in weight.collect():
            weights[t] = w
        part = _ranked(held, kind, item_kind, spark.sparkContext.broadcast(plan), weights, n_docs, n_terms, top).withColumn("block", F.lit(block))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    salt, place = fresh(out, "salt", "rank")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    out = out.withColumn(salt, F.spark_partition_id() % SALTS)
    for keys in (["block", "item", salt], ["block", "item"]):
        out = out.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) <= top)
    return out.select(F.col("item_id").cast(item_kind).alias("item_id"), F.col(place).alias("rank"), F.col("doc_id").cast(kind).alias("doc_id"), "score")


def op11_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return shared_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(text="text")} AS t FROM documents),
n AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM n),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT nd FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
i AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS.format(text="text")}) AS term FROM benchmark) GROUP BY item_id, term),
c AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))) AS c FROM p JOIN n USING (r) JOIN w USING (term), s),
x AS (SELECT item_id, r, sum(times * c)::BIGINT AS score FROM i JOIN c USING (term) GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM x JOIN n USING (r) WHERE score > 0 QUALIFY rank <= {TOP}
"""
