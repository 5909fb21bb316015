"""Secret scan: three fixed kinds of secrets, and strings whose sliding-window entropy is that of random keys.

A candidate is a run of key characters. A window of WINDOW characters slides over it, and the window's Shannon entropy
is kept by incremental counts. It counts at or above the threshold of the whole candidate's class (hex, alphanumeric,
base64), unless an allow-list suppresses the candidate, and also, within a run of letters and digits, of base64 or of
URL-safe characters, at or above the threshold of its own class, unless it meets a stretch that an allow-list covers.
A maximal stretch of such windows is a span.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

KINDS = ("assign", "access", "hex", "entropy")
# Fixed patterns of the base kinds (with the least lengths of the value, key and run).
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character from which a window of its class counts; letters alone are words, so they are no class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Suppressed candidates: placeholders, paths and identifiers made of words, UUID-like examples.
ALLOW = re.compile(r"(?i:example|sample|placeholder|your|xxxx|0000|1234567|abcdef|localhost|http)|(?:/[a-z_-]+){2,}|^[a-z]+(?:[-_][a-z]+)+$")
#: The same for windows: what is suppressed is the stretch, and for placeholder words the letters and digits around.
ALLOW_HERE = re.compile(r"(?i:xxxx|0000|1234567|abcdef)|(?:/[a-z_-]{3,}){2,}")
ALLOW_WORD = re.compile(r"(?i:example|sample|placeholder|your|localhost|http)")
#: Runs of one character class; windows do not cross their ends.
RUNS = [re.compile(r) for r in (r"[A-Za-z0-9]{20,}", r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}")]
#: Least letters of each case in a window of letters alone, and its threshold.
LEAST_CASE, LETTERS = 6, 3.7
_PLOGP = [0.0, 0.0, *(c * math.log2(c) for c in range(2, WINDOW + 1))]


def char_class(s: str) -> str | None:
    """hex, alnum or base64; None for strings of letters alone (words) or digits alone (numbers)."""
    digits = sum(c.isdigit() for c in s)
    if digits < 3 or digits == len(s):
        return None
    if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def entropy_spans(s: str, window: int = WINDOW, thresholds: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Maximal stretches of s that windows at or above the threshold of its class cover."""
    kind = char_class(s)
    if kind is None or len(s) < window or ALLOW.search(s):
        return []
    least = (thresholds or THRESHOLDS)[kind]
    plogp = _PLOGP if window == WINDOW else [0.0, 0.0, *(c * math.log2(c) for c in range(2, window + 1))]
    counts: dict[str, int] = {}
    weight, spans, base = 0.0, [], math.log2(window)
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        weight += plogp[k + 1] - plogp[k]
        if i >= window:
            k = counts[old := s[i - window]]
            counts[old] = k - 1
            weight += plogp[k - 1] - plogp[k]
        if i >= window - 1 and base - weight / window >= least - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def window_threshold(digits: int, upper: int, lower: int, other: int, hexes: int, window: int) -> float | None:
    """Least entropy of a window of so many characters of each kind (hexes: the most hex digits of one case); None if
    it can only be words or a number. Letters need both cases in about equal parts, which words with capitals lack."""
    mixed = min(upper, lower)
    if digits == window or digits + other == window:
        return None
    if hexes == window and digits >= 3:
        return THRESHOLDS["hex"]
    if other:
        return THRESHOLDS["base64"] if mixed >= (window // 5 if digits else LEAST_CASE) else None
    if digits >= 3:
        return THRESHOLDS["alnum"]
    if mixed >= LEAST_CASE:
        return THRESHOLDS["alnum"] if digits else LETTERS
    return THRESHOLDS["base64"] if digits else None


def allowed_stretches(s: str) -> list[tuple[int, int]]:
    """What allow patterns cover in s; a placeholder word covers the letters and digits around it too."""
    out = [m.span() for m in ALLOW_HERE.finditer(s)]
    for m in ALLOW_WORD.finditer(s):
        a, b = m.span()
        while a and s[a - 1].isalnum():
            a -= 1
        while b < len(s) and s[b].isalnum():
            b += 1
        out.append((a, b))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def key_spans(s: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal stretches of s that windows within a run of one character class cover, whose entropy reaches the
    threshold of the window's own class, and which meet no allowed stretch."""
    shut = [0] * (len(s) + 1)
    for a, b in allowed_stretches(s):
        shut[a:b] = [1] * (b - a)
    spans = []
    for a, b in sorted({m.span() for r in RUNS for m in r.finditer(s)}):
        counts: dict[str, int] = {}
        kinds, weight, closed = [0] * 6, 0.0, 0
        for i in range(a, b):
            for at, sign in ((i - window, -1), (i, 1)):
                if at < a:
                    continue
                c = s[at]
                k = counts.get(c, 0)
                counts[c] = k + sign
                weight += _PLOGP[k + sign] - _PLOGP[k]
                closed += sign * shut[at]
                kinds[0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3] += sign
                kinds[4] += sign * (c in "0123456789abcdef")
                kinds[5] += sign * (c in "0123456789ABCDEF")
            if i - a < window - 1 or closed:
                continue
            least = window_threshold(*kinds[:4], max(kinds[4:]), window)
            if least is not None and math.log2(window) - weight / window >= least - 1e-9:
                spans.append((i - window + 1, i + 1))
    return merged(spans)


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted: base spans, and entropy spans beside or over them."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE] if _HINT.search(text) else []
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    added = []
    for m in CANDIDATE.finditer(text):
        added += [(a + m.start(), 3, b + m.start()) for a, b in merged(entropy_spans(m[0]) + key_spans(m[0]))]
    return sorted(base + added)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of (kind, start, end) in code points, end exclusive, for every row of docs.

    Null and empty texts find nothing. Very long texts are scanned whole. Repeated rows are rows of their own; other
    columns are ignored. Empty table: empty.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_secrets(t.as_py() or "")] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "found"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<struct<kind string, start int, end int>>")


def op2_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; the digests are of the spans, in the order of start, then kind."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    kind = lambda k: F.filter("found", lambda x: x["kind"] == k)
    count = lambda k: F.size(kind(k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("found", lambda x: x["kind"] != "entropy"), one), ",")
    found = secret_scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("found", one), ",").alias("spans"), count("entropy"))

