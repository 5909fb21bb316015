"""Stupid-backoff language-model scores of every document under the counts of all the others.

Documents are dealt into batches by a hash of their id and text and a salt of their row. Each batch sends its distinct
n-grams, as hashes with counts, to the n-gram count tables, which are partitioned by the leading bits of the hash; a
partition adds the counts of all batches and answers each batch with the totals of its n-grams. The answers are joined
to the batch's documents, whose n-grams are scored and summed. Orders 1 and 2 go first; an n-gram of a higher order
can only occur in another document if the two (n-1)-grams in it do, so only such n-grams are sent, order by order.
That loses nothing: the others count 0 elsewhere. An n-gram crosses the network once for each batch that holds it, packed with its
neighbours, and a frequent one is counted in its batch before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import blocks, read, shuffle_partitions

ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a batch of documents, and n-grams that one partition of the count tables receives, about.
BATCH_BYTES, PARTITION_GRAMS = 8 << 20, 1 << 20


def grams(column: pa.Array, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of all n-grams of a column by n from 1 to order, the row offsets of each, and the row of each word."""
    data, bounds = tokens.utf8(column)
    parts = [tokens.word_hashes(data, bounds[i : j + 1]) for i, j in tokens.slices(bounds)]
    h = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts] or [[]]))]).astype(np.int64)
    found = [tokens.windows(h, at, k) for k in range(1, order + 1)]
    return [f[0] for f in found], [f[1] for f in found], at


def pack(values: np.ndarray) -> bytes:
    """Nonnegative integers as planes of bytes, as many as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


_ASKED = "batch long, k int, part long, grams binary, counts binary"
_ANSWERED = "batch long, k int, part long, totals binary"
#: Bits of a hash beyond those that number the n-grams of the corpus: one in 2 ** SPARE of them meets another, until 64
#: bits are all there are.
SPARE = 34


def shorter(h: np.ndarray, width: int) -> np.ndarray:
    """The leading `width` bits of hashes."""
    return h >> np.uint64(64 - width)


def _questions(batch: int, k: int, h: np.ndarray, bits: int, width: int) -> list[tuple]:
    """Distinct n-grams of one order: a row for each partition; hashes as differences in ascending order."""
    own, counts = np.unique(h, return_counts=True)
    part = own >> np.uint64(width - bits) if bits else np.zeros(len(own), np.uint64)
    inner = own & np.uint64((1 << (width - bits)) - 1)
    ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(own) else []
    at, rows = 0, []
    for end in ends:
        rows.append((batch, k, int(part[at]), pack(np.diff(inner[at:end], prepend=np.uint64(0))), pack(counts[at:end].astype(np.uint64))))
        at = end
    return rows


def _asked(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["batch", "k", "part", "grams", "counts"])


def _ask(order: int, bits: int, width: int):
    """The questions of a batch for the orders 1 to `order`."""
    def ask(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        found = grams(table.column("text"), order)[0]
        return _asked([r for k, h in enumerate(found, 1) for r in _questions(batch, k, shorter(h, width), bits, width)])
    return ask


def elsewhere(hashes: list[np.ndarray], offsets: list[np.ndarray], at: np.ndarray, answers: pa.Table, order: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order up to `order`, how often each n-gram of the batch occurs in other rows; and which n-grams of the
    next order can occur there at all."""
    n = np.diff(at)
    by_order: dict[int, dict[int, bytes]] = {}
    for k, p, t in zip(*(answers.column(c).to_pylist() for c in ("k", "part", "totals")), strict=True):
        by_order.setdefault(k, {})[p] = t
    out: list[np.ndarray] = []
    may = np.ones(len(hashes[0]), bool)
    for k in range(1, order + 1):
        rows = np.repeat(np.arange(len(n)), np.diff(offsets[k - 1]))[may]
        own, which = np.unique(shorter(hashes[k - 1][may], width), return_inverse=True)
        totals = np.concatenate([unpack(t) for _, t in sorted(by_order.get(k, {}).items())] or [np.zeros(0, np.uint64)]).astype(np.int64)
        assert len(totals) == len(own)
        _, mine, times = np.unique(rows * max(len(own), 1) + which, return_inverse=True, return_counts=True)
        count = np.zeros(len(may), np.int64)
        count[may] = totals[which] - times[mine]
        out.append(count)
        if k < len(hashes):
            rows = np.repeat(np.arange(len(n)), np.diff(offsets[k]))
            first = np.arange(len(rows)) - offsets[k][rows] + offsets[k - 1][rows]
            may = (count[first] > 0) & (count[first + 1] > 0) if k > 1 else np.ones(len(rows), bool)
    return out, may


def _ask_next(k: int, bits: int, width: int):
    """The questions of a batch for order k, from the answers for those below."""
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _asked([])
        hashes, offsets, at = grams(docs.column("text"), k)
        _, may = elsewhere(hashes, offsets, at, answers, k - 1, width)
        return _asked(_questions(docs.column("batch")[0].as_py(), k, shorter(hashes[k - 1][may], width), bits, width))
    return ask


def _answer(table: pa.Table) -> pa.Table:
    """One partition of the count table of one order: the totals of all n-grams of each row."""
    asked = [np.cumsum(unpack(x), dtype=np.uint64) for x in table.column("grams").to_pylist()]
    counts = [unpack(x) for x in table.column("counts").to_pylist()]
    known, which = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.zeros(len(known), np.uint64)
    np.add.at(totals, which, np.concatenate(counts))
    split = np.split(totals[which], np.cumsum([len(x) for x in asked])[:-1])
    return pa.table([table.column("batch"), table.column("k"), table.column("part"), pa.array([pack(x) for x in split], pa.binary())], ["batch", "k", "part", "totals"])


def _score(order: int, words: int, backoff: float, width: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([docs.column("doc_id"), pa.array([], pa.int64()), pa.array([], pa.float64())], ["doc_id", "n_words", "log_sum"])
        hashes, offsets, at = grams(docs.column("text"), order)
        found, _ = elsewhere(hashes, offsets, at, answers, order, width)
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(at[-1]) - at[row]
        rest = np.maximum(words - n, 0)[row].astype(np.float64)  # words of all other documents
        result = backoff ** np.minimum(place + 1, order) / np.maximum(rest, 1)
        below = None  # counts elsewhere of the (k-1)-gram that begins at each word
        for k, count in enumerate(found, 1):
            rows = np.repeat(np.arange(len(n)), np.diff(offsets[k - 1]))
            start = np.arange(len(rows)) - offsets[k - 1][rows] + at[rows]
            end = start + k - 1
            given = rest[end] if k == 1 else below[start]
            hit = count > 0
            top = np.minimum(place[end[hit]] + 1, order)
            result[end[hit]] = backoff ** (top - k) * count[hit] / given[hit]
            below = np.zeros(at[-1])
            below[start] = count
        total = np.bincount(row, np.log10(result), len(n)) if len(row) else np.zeros(len(n))
        return pa.table([docs.column("doc_id"), pa.array(n), pa.array(total)], ["doc_id", "n_words", "log_sum"])
    return score


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = tokens.utf8(b.column(0))
        words = sum(len(tokens.word_hashes(data, bounds[i : j + 1])[0]) for i, j in tokens.slices(bounds))
        yield pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64()), pa.array([words], pa.int64())], ["bytes", "words"])


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_sum, score for every row of docs; log_sum is the sum over its words of log10 of the word's
    score, and score that sum a word, which compares documents of all lengths.

    A word's score is count(n-gram) / count(context) for the longest n-gram of at most `order` words that ends in it
    and occurs in another row, times `backoff` for each order less than the word's place allows. Counts leave the
    row itself out. A word that occurs nowhere else has `backoff` to the power of all its orders, over the words of
    all other rows. Null and empty texts: 0 words, 0 and 0. Repeated rows count as other rows of each other. Very long
    texts are a batch of their own. Other columns are ignored. Empty table: empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.select("text").mapInArrow(_measure, "bytes long, words long").agg(F.sum("bytes"), F.sum("words")).first()
    n_batches, words = blocks(size[0] or 0, BATCH_BYTES), size[1] or 0
    bits = (blocks(words * order, PARTITION_GRAMS) - 1).bit_length()
    width = min(64, max(words, 1).bit_length() + SPARE)
    # as many partitions as there are batches or parts of the count tables, so a task holds one or two at any size
    by_batch = max(shuffle_partitions(spark), n_batches)
    by_part = max(shuffle_partitions(spark), order << bits)
    # rows that repeat are dealt apart: any row may go to any batch
    salt = F.shiftright(F.monotonically_increasing_id(), 33) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(salt, "doc_id"), F.lit(n_batches))).repartition(by_batch, "batch")

    def answered(asked: DataFrame) -> DataFrame:
        asked = asked.repartition(by_part, "k", "part")
        return asked.groupBy("k", "part").applyInArrow(_answer, _ANSWERED)

    first = min(order, 2)
    answers = answered(dealt.groupBy("batch").applyInArrow(_ask(first, bits, width), _ASKED)).repartition(by_batch, "batch")
    for k in range(first + 1, order + 1):
        asked = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_ask_next(k, bits, width), _ASKED)
        answers = answers.unionByName(answered(asked).repartition(by_batch, "batch"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(order, words, backoff, width), f"doc_id {id_type}, n_words long, log_sum double")
    return found.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_sum") / F.col("n_words")).otherwise(F.lit(0.0)))


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under trigram counts of all others."""
    found = backoff_scores(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_sum", 5).alias("log_sum"), F.round("score", 6).alias("score"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT sum(len(w)) AS n FROM d),
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS c, len(w) AS own FROM d),
p AS (SELECT t.*, lag(c) OVER (PARTITION BY r ORDER BY i) AS b, lag(c, 2) OVER (PARTITION BY r ORDER BY i) AS a FROM t),
u AS (SELECT c, count(*) AS n FROM p GROUP BY 1), ud AS (SELECT r, c, count(*) AS n FROM p GROUP BY 1, 2),
g AS (SELECT b, c, count(*) AS n FROM p WHERE i > 1 GROUP BY 1, 2), gd AS (SELECT r, b, c, count(*) AS n FROM p WHERE i > 1 GROUP BY 1, 2, 3),
h AS (SELECT a, b, c, count(*) AS n FROM p WHERE i > 2 GROUP BY 1, 2, 3), hd AS (SELECT r, a, b, c, count(*) AS n FROM p WHERE i > 2 GROUP BY 1, 2, 3, 4),
e AS (SELECT p.r, p.i, p.own, h.n - hd.n AS n3, g.n - gd.n AS n2, u.n - ud.n AS n1, ab.n - abd.n AS given3, ub.n - ubd.n AS given2
  FROM p JOIN u ON u.c = p.c JOIN ud ON ud.r = p.r AND ud.c = p.c
  LEFT JOIN g ON g.b = p.b AND g.c = p.c LEFT JOIN gd ON gd.r = p.r AND gd.b = p.b AND gd.c = p.c
  LEFT JOIN h ON h.a = p.a AND h.b = p.b AND h.c = p.c LEFT JOIN hd ON hd.r = p.r AND hd.a = p.a AND hd.b = p.b AND hd.c = p.c
  LEFT JOIN g ab ON ab.b = p.a AND ab.c = p.b LEFT JOIN gd abd ON abd.r = p.r AND abd.b = p.a AND abd.c = p.b
  LEFT JOIN u ub ON ub.c = p.b LEFT JOIN ud ubd ON ubd.r = p.r AND ubd.c = p.b),
s AS (SELECT r, CASE WHEN n3 > 0 THEN n3::DOUBLE / given3
    WHEN n2 > 0 THEN pow({BACKOFF}, least(i, 3) - 2) * n2 / given2
    WHEN n1 > 0 THEN pow({BACKOFF}, least(i, 3) - 1) * n1 / (n.n - own)
    ELSE pow({BACKOFF}, least(i, 3)) / greatest(n.n - own, 1) END AS s FROM e CROSS JOIN n)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(x.s, 0), 5) AS log_sum, round(coalesce(x.s / len(d.w), 0), 6) AS score
FROM d LEFT JOIN (SELECT r, sum(log10(s)) AS s FROM s GROUP BY r) x USING (r)
"""
