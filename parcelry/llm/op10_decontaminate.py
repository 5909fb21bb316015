"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over windows of SPAN words ignore some positions, so a window still matches when those words were
substituted. Seeds of the benchmark and of every document are joined on their hash; around each hit the whole item
is compared with the text along the hit's diagonal, and the overlap counts if enough of its words agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import blocks, frugal, read

# Fixed masks: positions of a window that are hashed.
MASKS = (
    (0, 1, 3, 6, 7, 10), (0, 2, 3, 4, 8, 9), (0, 1, 4, 5, 7, 9), (2, 6, 7, 8, 9, 10), (1, 2, 3, 4, 5, 10), (0, 1, 5, 6, 8, 9),
    (0, 4, 5, 6, 7, 10), (1, 5, 7, 8, 9, 10), (1, 3, 4, 6, 7, 8), (0, 2, 3, 5, 7, 9), (0, 1, 3, 4, 8, 10), (1, 2, 3, 5, 6, 10),
)
SPAN = 11
#: An overlap has at least this many agreeing words, and this part of its words agree; where a whole item of SPAN words or
#: more is compared, this part of it is enough, and a shorter item must agree in all words.
LEAST_WORDS, IDENTITY = 13, 0.7
#: Words of benchmark items that one pass over the documents joins; more items take more passes.
BLOCK_WORDS = 2_000_000
_BITS = 22


class Seeds:
    """Seeds of one block of items, sorted by hash, with a bitmap that rules out most other hashes."""

    def __init__(self, items: list[tuple[object, list[int]]]):
        self.ids = [i for i, _ in items]
        self.words = [np.array(w, np.int64).view(np.uint64) for _, w in items]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        h = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        at = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.widths = [(SPAN, list(m)) for m in MASKS] + [(int(n), None) for n in np.unique(self.lengths[(self.lengths > 0) & (self.lengths < SPAN)])]
        self.tables = []
        for width, picks in self.widths:
            seed, s_at = tokens.windows(h, at, width, picks)
            item = np.repeat(np.arange(len(items)), np.diff(s_at))
            place = np.arange(len(seed)) - s_at[:-1][item]
            if picks is None:  # a short item is one seed; other items have masks
                own = self.lengths[item] == width
                seed, item, place = seed[own], item[own], place[own]
            order = np.argsort(seed, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[seed >> np.uint64(64 - _BITS)] = True
            self.tables.append((seed[order], item[order], place[order], bitmap))

    def hits(self, h: np.ndarray, at: np.ndarray, share: float = 1.0, any_item: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, agreeing words, words compared): the best overlap of each row and item. Where all of
        an item of SPAN words or more meets the text, `share` of its words are enough, if these are under LEAST_WORDS.
        any_item: some overlap of each row that has one, and no more is looked for, however many items share its seeds."""
        met = []  # of each mask: text row, word, and the range of equal seeds
        for (width, picks), (seed, item, place, bitmap) in zip(self.widths, self.tables, strict=True):
            own, own_at = tokens.windows(h, at, width, picks)
            maybe = np.flatnonzero(bitmap[own >> np.uint64(64 - _BITS)])
            lo = np.searchsorted(seed, own[maybe], "left")
            n = np.searchsorted(seed, own[maybe], "right") - lo
            maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
            if len(maybe):
                row = np.searchsorted(own_at, maybe, "right") - 1
                met.append((row, maybe - own_at[row], lo, n, item, place))
        if not any_item:
            return self._compared(h, at, share, met)
        some = self._compared(h, at, share, [(row, word, lo, np.minimum(n, 1), item, place) for row, word, lo, n, item, place in met], once=True)
        left = np.ones(len(at) - 1, bool)  # texts for which one item of each seed didn't do
        left[[r for r, *_ in some]] = False
        return some + self._compared(h, at, share, [(m[0][left[m[0]]], *(x[left[m[0]]] for x in m[1:4]), *m[4:]) for m in met], once=True)

    def _compared(self, h: np.ndarray, at: np.ndarray, share: float, met: list[tuple], once: bool = False) -> list[tuple[int, int, int, int, int]]:
        """The overlaps around seeds that met; once: one of each row."""
        rows, items, diagonals = [], [], []
        for row, word, lo, n, item, place in met:
            entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            rows.append(np.repeat(row, n))
            items.append(item[entry])
            diagonals.append(np.repeat(word, n) - place[entry])
        if not sum(map(len, rows)):
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done = -1  # the last row with an overlap; rows come in order
        for r, i, d in np.unique(np.stack([np.concatenate(x) for x in (rows, items, diagonals)], axis=1), axis=0).tolist():
            if once and r == done:
                continue
            text, item = h[at[r] : at[r + 1]], self.words[i]
            a, b = max(0, -d), min(len(item), len(text) - d)
            same = item[a:b] == text[a + d : b + d]
            whole = share if SPAN <= len(item) == b - a else 1.0
            got = overlap(same, min(LEAST_WORDS, math.ceil(whole * len(item) - 1e-9)))
            if got and got[0] > best.get((r, i), (0, 0, 0))[0]:
                best[r, i] = (got[0], got[1], a + d + got[2])
                done = r
        return [(r, i, start, m, n) for (r, i), (m, n, start) in best.items()]


def overlap(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(agreeing words, words, first word) of a stretch of which IDENTITY of the words agree and that has `least`
    agreeing words: the one with the most of them, the shortest of these; None if there is none."""
    ones = np.concatenate([[0], np.cumsum(same)])
    total = 10 * ones - round(10 * IDENTITY) * np.arange(len(ones))  # in tenths of a word: exact
    # from each place, the last end whose sum is not below: the largest sum from an end on is at least that of the place
    rest = np.maximum.accumulate(total[::-1])[::-1]
    end = len(rest) - 1 - np.searchsorted(rest[::-1], total, "left")
    m = ones[end] - ones
    if m.max() < max(least, 1):
        return None
    start = int(np.flatnonzero(m == m.max())[-1])
    stop = int(np.searchsorted(ones, ones[end[start]]))  # ends with the last agreeing word
    return int(m[start]), stop - start, start


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = tokens.utf8(b.column(1))
        h, at = tokens.word_hashes(data, bounds)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["item_id", "words"])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Seeds]:
    """Blocks of distinct item texts by a hash of the text, of about BLOCK_WORDS words; one at a time on the driver."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    words = rows.mapInArrow(_item_words, f"item_id {kind}, words array<long>").filter("size(words) > 0")
    words = words.groupBy("words").agg(F.min("item_id").alias("item_id"))
    n = blocks(words.agg(F.sum(F.size("words"))).first()[0] or 0, BLOCK_WORDS)
    for k in range(n):
        part = words.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == k)
        yield Seeds(sorted(((r["item_id"], r["words"]) for r in part.select("item_id", "words").collect()), key=lambda x: x[1]))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, matched, compared: each row of docs with each benchmark text that it overlaps.

    Items of the same words are one, under their least id. Null and empty texts and items overlap with nothing; an
    item under SPAN words must appear whole. Very long texts are compared whole. Repeated rows are rows of their own;
    other columns are ignored. Empty tables: empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = rows.schema["doc_id"].dataType, benchmark.schema[item_col].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, first_word long, matched long, compared long"
    sc, out = rows.sparkSession.sparkContext, None
    for seeds in _blocks(benchmark, item_col, item_text):
        shared = sc.broadcast(seeds)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                data, bounds = tokens.utf8(b.column(1))
                for i, j in tokens.slices(bounds):
                    h, at = tokens.word_hashes(data, bounds[i : j + 1])
                    got = own.hits(h, at, IDENTITY)
                    if got:
                        ids = [b.column(0).take(pa.array([i + r for r, *_ in got])), pa.array([own.ids[k] for _, k, *_ in got])]
                        yield pa.RecordBatch.from_arrays([*ids, *(pa.array([g[c] for g in got], pa.int64()) for c in (2, 3, 4))], ["doc_id", "item_id", "first_word", "matched", "compared"])

        part = rows.mapInArrow(frugal(find), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that overlap with no benchmark text."""
    sc, at = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    for seeds in _blocks(benchmark, item_col, item_text):
        shared = sc.broadcast(seeds)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, bounds = tokens.utf8(b.column(at))
                keep = np.ones(b.num_rows, bool)
                for i, j in tokens.slices(bounds):
                    h, own = tokens.word_hashes(data, bounds[i : j + 1])
                    keep[[i + r for r, *_ in shared.value.hits(h, own, IDENTITY, any_item=True)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(frugal(clean), docs.schema)
    return docs


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
