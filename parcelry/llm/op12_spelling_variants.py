"""Grouping of spelling variants by finite-state composition.

The vocabulary is an acceptor A; E reads a word and writes one that differs in exactly one inserted, deleted or replaced
code point; the accepted pairs of A o E o A are the pairs of near words. The composition is enumerated per initial state:
words that share all outside an interval of places (a prefix, a suffix or both) meet in one group, and the group's
machine is the minimal acceptor of what lies inside, entered at the state that the shared part leads to. Every pair
belongs to exactly one interval, that of its first differing place. A group of too many words is parted into the two
halves of its interval, so its words move on with more of them shared; an interval of one place has few words at most.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup, read

LEAST_LENGTH, LEAST_COUNT, SLIP = 5, 3, 97
#: Words of a group beyond which it is parted.
MOST = 20_000
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def slipped(doc_id: object, run: str) -> str:
    """The run as the corpus has it: one in SLIP, by a checksum of id and run, loses a code point. A null id is empty."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    i = h % len(run)
    return run if h % SLIP else run[:i] + run[i + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: dict[str, int] = defaultdict(int)
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
            own: dict[str, int] = defaultdict(int)
            for run in _RUN.findall((text.as_py() or b"").lower().decode("utf-8", "replace")):  # bytes: A-Z only
                own[run] += 1
            for run, n in own.items():
                if len(run) >= LEAST_LENGTH:
                    word = slipped(doc_id, run)
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
            if len(counts) > HELD:
                yield sent()
                counts.clear()
    if counts:
        yield sent()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points and LEAST_COUNT occurrences. Null texts have none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words: states with equal rest languages are one state."""

    def __init__(self, words: list[str]):
        self.moves: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, before = [0], ""

        def closed(to: int) -> None:
            while len(path) - 1 > to:
                state = path.pop()
                shape = (self.final[state], *self.moves[state].items())
                self.moves[path[-1]][before[len(path) - 1]] = known.setdefault(shape, state)

        for word in words:
            same = 0
            for x, y in zip(before, word):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                same += 1
            closed(same)
            for c in word[same:]:
                self.moves.append({})
                self.final.append(False)
                self.moves[path[-1]][c] = len(self.moves) - 1
                path.append(len(self.moves) - 1)
            self.final[path[-1]] = True
            before = word
        closed(0)

    def both(self, x: int, y: int, n: int, but: str = "") -> list[str]:
        """The strings of n code points that x and y accept, without those that begin with `but`."""
        found, open_ = [], [(x, y, "")]
        while open_:
            x, y, s = open_.pop()
            if len(s) == n:
                if self.final[x] and self.final[y]:
                    found.append(s)
                continue
            mx, my = self.moves[x], self.moves[y]
            for c in mx if len(mx) <= len(my) else my:
                if c in mx and c in my and (s or c != but):
                    open_.append((mx[c], my[c], s + c))
        return found

    def near(self, n: int, at_end: bool) -> list[tuple[str, str]]:
        """Accepted pairs of the composition: words u of n code points with v, each unordered pair once: v has n + 1
        code points, or n and comes after u. The edit stands at the first place where they differ; at_end: v may be u
        with a code point added."""
        layers = [{0}]
        for _ in range(n):
            layers.append({q for p in layers[-1] for q in self.moves[p].values()})
        later: dict[int, list[tuple[str, str]]] = {}
        for depth in range(n, -1, -1):
            here = {}
            for p in layers[depth]:
                moves, found = self.moves[p], []
                if depth < n:
                    for c, q in moves.items():
                        found += [(c + u, c + v) for u, v in later[q]]
                    steps = list(moves.items())
                    for i, (a, x) in enumerate(steps):
                        for b, y in steps[i + 1 :]:
                            found += [(a + s, b + s) for s in self.both(x, y, n - depth - 1)]
                if depth < n or at_end:
                    for b, y in moves.items():
                        found += [(s, b + s) for s in self.both(p, y, n - depth, but=b)]
                here[p] = found
            later = here
        return later[0]


def _parted(lo: Column, rest: Column, short: Column) -> Column:
    """The two halves of a group's interval: (pre, suf, rest) after the shared parts of its words have grown. short: code
    points of the interval in the group's shorter words; lo: (pre, suf)."""
    half = (short / 2).cast("int")
    first = F.struct(F.concat(lo["pre"], F.substring(rest, F.lit(1), half)).alias("pre"), lo["suf"].alias("suf"), F.substring(rest, half + 1, F.length(rest)).alias("rest"))
    kept = F.length(rest) - (short - half)
    second = F.struct(lo["pre"].alias("pre"), F.concat(F.substring(rest, kept + 1, short), lo["suf"]).alias("suf"), F.substring(rest, F.lit(1), kept).alias("rest"))
    return F.array(first, second)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        near: dict[str, list] = {}
        for size, pre, suf, members in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
            n_of = {m["rest"]: m["n"] for m in members}
            for u, v in Acceptor(sorted(n_of)).near(size - len(pre) - len(suf), not suf):
                wu, wv = pre + u + suf, pre + v + suf
                for word, other, n in ((wu, wv, n_of[v]), (wv, wu, n_of[u])):
                    own = near.setdefault(word, [0, -n, other])
                    own[0] += 1
                    if (-n, other) < (own[1], own[2]):
                        own[1:] = -n, other
        cols = zip(*[(w, *x) for w, x in near.items()], strict=True) if near else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "minus", "other"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, minus, other): partial counts of each word's near words, and of these the one of largest n (minus:
    its n, negative; ties: the smallest), for the distinct words of (word, n)."""
    size = F.length("word")
    whole = F.struct(F.lit("").alias("pre"), F.lit("").alias("suf"))
    # a pair belongs to the length of its shorter word
    rows = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda k: k >= LEAST_LENGTH)).alias("size"))
    rows = rows.select("size", F.explode(_parted(whole, F.col("word"), F.col("size"))).alias("p"), "n").select("size", "p.*", "n")
    keys, out = ["size", "pre", "suf"], None
    while True:
        # at most rows / MOST groups are large; most of the time there are none
        large = cut(rows.groupBy(*keys).count().filter((F.col("count") > MOST) & (F.col("size") - F.length("pre") - F.length("suf") > 1)))
        some = not large.isEmpty()
        known = lookup(rows, large, keys, size="count") if some else rows
        groups = (known.filter("count is null") if some else known).groupBy(*keys).agg(F.collect_list(F.struct("rest", "n")).alias("members")).filter(F.size("members") > 1)
        part = groups.mapInArrow(_found, "word string, n_near long, minus long, other string")
        out = part if out is None else out.unionByName(part)
        if not some:
            return out
        halves = _parted(F.struct("pre", "suf"), F.col("rest"), F.col("size") - F.length("pre") - F.length("suf"))
        rows = cut(known.filter("count is not null").select("size", F.explode(halves).alias("p"), "n").select("size", "p.*", "n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of docs.

    form is the near word of largest n, ties by code points, where that n is at least twice the word's; root is what
    forms lead to, the word itself without a form. Null and empty texts add no words, an empty table has none; a null id
    counts as an empty one; repeated rows count as often as they occur; long texts and words are taken whole. Only the id
    and text columns are read, whatever else there is.
    """
    words = cut(vocabulary(docs, id_col, text_col))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus:long,other:string>").alias("best"))
    near = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct("minus", "other").alias("best"))
    found = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.minus") >= 2 * F.col("n")
    found = cut(found.select("word", F.when(is_form, F.col("best.other")).alias("form"), "n", "n_near", F.when(is_form, -F.col("best.minus")).alias("form_n")))
    # n doubles from form to form, so no chain is longer than the logarithm of the largest n; each round doubles what is followed
    most = found.agg(F.max("n")).first()[0] or 1
    ends = found.filter("form is not null").select("word", F.col("form").alias("at"))
    for _ in range(math.ceil(math.log2(max(1, math.log2(most))))):
        ends = cut(lookup(ends, ends.select(F.col("word").alias("at"), F.col("at").alias("next")), ["at"]).select("word", F.coalesce("next", "at").alias("at")))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("at", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the vocabulary of all documents."""
    return spelling_variants(read(spark, sf_dir, "documents"))


def _checksums() -> list[int]:
    """Remainders of all bytes by the reflected polynomial 0xEDB88320."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


ORACLE = f"""
WITH RECURSIVE tab AS (SELECT {_checksums()} AS tab),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT id, run, count(*)::BIGINT AS k FROM d WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run),
b AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS bytes FROM c),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
g AS (SELECT word, n, i, substr(word, 1, i) AS pre, substr(word, i + 2) AS suf FROM i),
r AS (SELECT x.word, y.word AS other, y.n AS other_n FROM g x JOIN g y ON x.i = y.i AND x.pre = y.pre AND x.suf = y.suf AND x.word <> y.word),
e AS (SELECT DISTINCT g.word AS long, g.n AS long_n, v.word AS short, v.n AS short_n FROM g JOIN v ON v.word = g.pre || g.suf),
p AS (SELECT * FROM r UNION ALL SELECT long, short, short_n FROM e UNION ALL SELECT short, long, long_n FROM e),
f AS (SELECT v.word, v.n, count(p.other) AS n_near, max(p.other_n) AS most, min(p.other) FILTER (p.other_n = m.most) AS best
  FROM v LEFT JOIN p USING (word) LEFT JOIN (SELECT word, max(other_n) AS most FROM p GROUP BY word) m USING (word) GROUP BY v.word, v.n),
o AS (SELECT word, n, n_near, CASE WHEN most >= 2 * n THEN best END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM f),
w AS (SELECT word, word AS at, form AS next FROM o UNION ALL SELECT w.word, o.word, o.form FROM w JOIN o ON o.word = w.next)
SELECT o.word, o.form, w.at AS root, o.n, o.n_near, o.form_n FROM o JOIN w ON w.word = o.word AND w.next IS NULL
"""
