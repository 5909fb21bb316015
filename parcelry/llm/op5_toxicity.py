"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two words is that of their subsequences of LENGTH characters whose neighbours are at most GAP apart,
each weighted by DECAY to the power of its span (Lodhi et al. 2002, with bounded gaps), normalised. A word begins
with a boundary character, so stems weigh more than endings; skipped characters only weaken a match, so gapped and
inserted-character forms stay near. Single letters in a row are read as one word. Landmarks are words and stems (a
word's first letters, so the forms of a stem are counted together). Two machines use their Nystroem map:

- that of sentences: a sentence is described by its nearest word to each landmark. It is trained on sentences of labelled
  documents (those of clean documents; of each toxic document those that hold a toxic landmark nearly as it is, and the
  sentence that scores highest, chosen anew in each round); a document has the margin of its most toxic sentence.
- that of whole texts: the kernel of a text and a landmark is the mean over the text's words (a convolution kernel), which
  tells texts that use a stem densely from those that hold it by chance.

A document's score is the probability that a logistic function of both margins gives.

Landmarks and machine are fitted on the driver to a sample of at most TRAIN_ROWS labelled documents (TRAIN_CHARS
characters each at most); everything else covers all rows and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, read

LENGTH, GAP, DECAY = 4, 3, 0.7
LANDMARKS, TRAIN_ROWS, TRAIN_CHARS = 96, 4000, 20_000
#: Letters of a stem; means over a text count SCALE times and as if it had SPARE words more, which are near nothing.
STEM, SCALE, SPARE = range(4, 9), 30.0, 20
#: Kernel values below this count as 0; words that reach it with no toxic landmark are not looked at again.
FLOOR = 0.2
_TABLE_BITS = 22
#: Words that a task remembers as near or far from the landmarks; beyond it, it begins anew.
_REMEMBERED = 300_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_OTHER = re.compile(r"[\W\d_]+")
_RUN = 24
_SPACED = re.compile(r"(?<!\S)[^\W\d_]\W?(?:\s+[^\W\d_]\W?){2,}(?!\S)")

#: Distances between neighbouring characters of a subsequence, and its weight.
_STEPS = [(a, b, c) for a in range(1, GAP + 1) for b in range(1, GAP + 1) for c in range(1, GAP + 1)]
_WEIGHTS = [DECAY ** (a + b + c + 1) for a, b, c in _STEPS]


def word_of(token: str) -> str:
    """The letters of a token; tokens of under three letters are no words."""
    w = token if token.isalpha() else _OTHER.sub("", token)
    return w if len(w) > 2 else ""


def tokens_of(lower: str) -> list[str]:
    """Tokens of a lower-case text, and its runs of three or more single letters, from each of their letters on."""
    out = lower.split()
    for run in _SPACED.findall(lower):
        letters = _OTHER.sub("", run)
        out += [letters[i : i + _RUN] for i in range(len(letters) - 2)]
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code of a subsequence, weight) of all words, each word begun by a boundary character."""
    text = "\x02" + "\x02".join(words)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.flatnonzero(chars == 2)
    word = np.repeat(np.arange(len(words)), np.diff(np.append(begins, len(chars))))
    mixed = (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    owners, codes, weights = [], [], []
    for (a, b, c), weight in zip(_STEPS, _WEIGHTS, strict=True):
        d = a + b + c
        n = len(chars) - d
        if n <= 0:
            continue
        inside = word[:n] == word[d:]
        code = ((mixed[:n] * np.uint64(3) + mixed[a : n + a]) * np.uint64(0xBF58476D1CE4E5B9) + mixed[a + b : n + a + b]) * np.uint64(0x94D049BB133111EB) + mixed[d:]
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        owners.append(word[:n][inside])
        codes.append(code[inside])
        weights.append(np.full(int(inside.sum()), weight))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return np.concatenate(owners), np.concatenate(codes), np.concatenate(weights)


class Kernel:
    """Kernel values of words against fixed landmark words."""

    def __init__(self, landmarks: list[str], first: int | None = None):
        """Words near none of the `first` landmarks (all by default) count as near none."""
        self.landmarks, self.first = landmarks, first or len(landmarks)
        owner, code, weight = subsequences(landmarks)
        self.codes, column = np.unique(code, return_inverse=True)
        self.matrix = np.zeros((len(self.codes), len(landmarks)), np.float32)
        np.add.at(self.matrix, (column, owner), weight)
        self.matrix /= np.sqrt(np.einsum("ij,ij->j", self.matrix, self.matrix))[None, :] + np.float32(1e-12)
        # for each code, the most any of the first landmarks has of it: bounds a word's largest value from above
        self.table = np.zeros(1 << _TABLE_BITS, np.float32)
        np.maximum.at(self.table, self.codes >> np.uint64(64 - _TABLE_BITS), self.matrix[:, : self.first].max(axis=1))

    def values(self, words: list[str]) -> np.ndarray:
        """One row per word; values under FLOOR are 0. Words that cannot reach it are ruled out by the table."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not words:
            return out
        owner, code, weight = subsequences(words)
        bound = np.bincount(owner, weight * self.table[code >> np.uint64(64 - _TABLE_BITS)], len(words))
        least = np.sqrt(np.bincount(owner, weight * weight, len(words)))  # the norm is at least that: weights only add up
        open_words = bound >= FLOOR * least - 1e-9
        mine = open_words[owner]
        owner, code, weight = owner[mine], code[mine], weight[mine]
        if not len(owner):
            return out
        order = np.lexsort((code, owner))
        owner, code, weight = owner[order], code[order], weight[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))
        weight, owner, code = np.add.reduceat(weight, np.flatnonzero(new)), owner[new], code[new]
        norm = np.sqrt(np.bincount(owner, weight * weight, len(words)))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[at] == code
        owner, at, weight = owner[known], at[known], weight[known]
        if len(owner):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[begins]] = np.add.reduceat(self.matrix[at] * weight[:, None], begins) / norm[owner[begins]][:, None]
        out[out < FLOOR] = 0
        out[~out[:, : self.first].any(axis=1)] = 0
        return out


class Model:
    """Landmarks, Nystroem map, the machines (weights, bias) of sentences and of texts, and the logistic function of their margins."""

    def __init__(self, kernel: Kernel, root: np.ndarray, sentence: tuple[np.ndarray, float], whole: tuple[np.ndarray, float], logistic: tuple[float, float, float]):
        self.kernel, self.logistic = kernel, np.array(logistic)
        (w, self.bias), (v, self.whole_bias) = sentence, whole
        self.w, self.v = root @ w, root @ v

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.logistic[:2] + self.logistic[2], -50, 50)))

    def margins(self, texts: list[str], reader: Reader | None = None) -> np.ndarray:
        """A row per text: the largest margin of its sentences (without a near word: that of an empty one), and its own."""
        owners, rows, means = (reader or Reader(self.kernel)).read(texts)
        out = np.empty((len(texts), 2))
        out[:, 0], out[:, 1] = self.bias, means @ self.v + self.whole_bias
        if rows:
            np.maximum.at(out[:, 0], owners, np.array(rows) @ self.w + self.bias)
        return out


class Reader:
    """Finds the words of texts that are near a landmark, and remembers what it has seen."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.near, self.far = kernel, {}, set()

    def learn(self, tokens: set[str]) -> None:
        if len(self.near) + len(self.far) > _REMEMBERED:
            self.near, self.far = {}, set()
        names = [t for t in tokens if t not in self.far and t not in self.near]
        words = [word_of(t) for t in names]
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (size < 16_000 or end == at):
                size += len(words[end]) + 1
                end += 1
            values = self.kernel.values(words[at:end])
            near = values.any(axis=1)
            for i in range(at, end):
                if near[i - at]:
                    self.near[names[i]] = values[i - at].copy()  # a view would keep all of values
                else:
                    self.far.add(names[i])
            at = end

    def read(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], np.ndarray]:
        """Text and kernel values of the nearest words of every sentence with a word near a landmark, and the scaled mean
        values of each text's words."""
        lower = [t.lower() for t in texts]
        own = [Counter(tokens_of(t)) for t in lower]
        self.learn(set().union(*own))
        owners, rows, means = [], [], np.zeros((len(texts), len(self.kernel.landmarks)))
        for i, (text, tokens) in enumerate(zip(lower, own, strict=True)):
            near = self.near.keys() & tokens.keys()
            if near:
                known = sorted(near)  # sums do not depend on the order of a set
                means[i] = np.array([tokens[t] for t in known]) @ np.array([self.near[t] for t in known]) * (SCALE / (tokens.total() + SPARE))
                for s in _SENTENCE.split(text):
                    hit = [self.near[t] for t in tokens_of(s) if t in near]  # few texts get here
                    if hit:
                        owners.append(i)
                        rows.append(np.max(hit, axis=0))
        return owners, rows, means


def _excess(a: int, b: int, share: float) -> float:
    """Log-likelihood ratio of a word in a toxic and b clean documents against chance; 0 if it does not mark toxic ones."""
    n = a + b
    if a <= share * n:
        return 0.0
    return a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b else 0.0)


def choose_landmarks(texts: list[str], toxic: np.ndarray, count: int = LANDMARKS, most: int = 300) -> tuple[list[str], int]:
    """Landmarks, and how many of them, the first, mark toxic documents: up to two thirds are words and stems that mark toxic documents, no two of them alike; the rest are clean words most like them."""
    sentences = [{s for t, k in zip(texts, toxic, strict=True) if k == y for s in _SENTENCE.split(t.lower())} for y in (0, 1)]
    words, forms = [Counter(), Counter()], [Counter(), Counter()]
    for y in (1, 0):
        for sentence in sentences[y]:  # copies count once
            own = {w for t in tokens_of(sentence) if (w := word_of(t))}
            words[y].update(own)
            own |= {w[:n] for w in own for n in STEM}
            forms[y].update(own if y else own & forms[1].keys())  # those of clean sentences alone mark nothing
        forms[y] = Counter({w: c for w, c in forms[y].items() if c >= 2 or not y})
    share = (len(sentences[1]) + 1) / (len(sentences[0]) + len(sentences[1]) + 2)
    strength = {w: _excess(a, forms[0][w], share) for w, a in forms[1].items()}
    sure = 3 + math.log(max(len(words[0]) + len(words[1]), 1))
    strong = [w for w in sorted(strength, key=lambda w: (-strength[w], -len(w), w)) if strength[w] > sure][:most]
    chosen: list[str] = []
    if strong:
        kernel = Kernel(strong)
        near = np.vstack([kernel.values(strong[i : i + 25]) for i in range(0, len(strong), 25)])  # a few rows at a time: they are wide
        del kernel
        left = np.ones(len(strong), bool)
        for i, w in enumerate(strong):
            if left[i] and len(chosen) < count * 2 // 3:
                chosen.append(w)
                left &= near[:, i] < 0.6
    clean = sorted(w for w, c in words[0].items() if c >= 2 and w not in strength)
    if chosen and clean:
        kernel = Kernel(chosen)
        alike = np.concatenate([kernel.values(clean[i : i + 200]).max(axis=1) for i in range(0, len(clean), 200)])
        first = len(chosen)
        return chosen + [clean[i] for i in np.lexsort((np.arange(len(clean)), -alike))[: count - first]], first
    known = chosen or sorted(strength, key=lambda w: (-strength[w], w))[:1] or clean[:1] or ["none"]
    return known, len(known)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient steps; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    keep = np.append(np.full(x.shape[1], reg), 1e-6)
    weight = weight / weight.sum()
    spread = sum(z[i : i + 10_000].T @ (z[i : i + 10_000] * weight[i : i + 10_000, None]) for i in range(0, len(z), 10_000))  # no second table of all rows
    step = 1 / (2 * np.linalg.eigvalsh(spread)[-1] + reg)
    w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for k in range(steps):
        loss = np.maximum(0, 1 - y * (z @ v))
        new = v - step * (keep * v - 2 * z.T @ (weight * loss * y))
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def logistic(margins: np.ndarray, goal: np.ndarray, steps: int = 100) -> tuple[float, float, float]:
    """Slopes and shift of the logistic function of the margins that fits smoothed labels best, by Newton steps that are
    halved until they help."""
    z = np.hstack([margins, np.ones((len(margins), 1))])

    def loss(x: np.ndarray) -> float:
        f = z @ x
        return float((np.logaddexp(0, f) - goal * f).sum() + 1e-6 * (x @ x))

    x = np.array([0.5, 0.5, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ x, -50, 50)))
        gradient = z.T @ (p - goal) + 2e-6 * x
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(3), gradient)
        size, now = 1.0, loss(x)
        while size > 1e-8 and loss(x - size * step) > now - 1e-12:
            size /= 2
        if size <= 1e-8:
            break
        x = x - size * step
    return float(x[0]), float(x[1]), float(x[2])


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 3) -> Model:
    """Landmarks, machine and calibration from labelled documents. With one class only, scores are its constant."""
    kernel = Kernel(*choose_landmarks(texts, toxic))
    gram = kernel.matrix.T.astype(np.float64) @ kernel.matrix
    value, vector = np.linalg.eigh(gram)
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        none = (np.zeros(int(good.sum())), 0.0)
        return Model(kernel, root, none, none, (0.0, 0.0, 4.0 if share >= 0.5 else -4.0))
    owners, parts, nearest, means, reader = [], [], [], [], Reader(kernel)
    for i in range(0, len(texts), 200):
        some, found, mean = reader.read(texts[i : i + 200])
        rows = np.array(found).reshape(len(found), len(kernel.landmarks))
        owners += [i + t for t in some]
        parts.append(rows @ root)
        nearest.append(rows[:, : kernel.first].max(axis=1, initial=0.0))
        means.append(mean)
    owner = np.array(owners, np.int64)
    x, score = np.concatenate([*parts, np.zeros((0, root.shape[1]))]), np.concatenate([*nearest, np.zeros(0)])
    del parts, nearest, reader  # the words seen are many
    clean = toxic[owner] == 0 if len(owner) else np.zeros(0, bool)
    exact, like = score >= 0.9, score >= 0.5  # a toxic document without a sentence like any landmark teaches nothing
    nothing = np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        best: dict[int, int] = {}
        for i in np.argsort(score, kind="stable"):
            if not clean[i] and like[i]:
                best[int(owner[i])] = int(i)
        top = np.array(sorted({*best.values(), *np.flatnonzero(~clean & exact).tolist()}), np.int64)
        train = np.vstack([x[top], x[clean], nothing])
        y = np.concatenate([np.ones(len(top)), -np.ones(int(clean.sum()) + 1)])
        weight = np.where(y > 0, 1 / max(len(top), 1), 1 / (clean.sum() + max(len(top), 1)))
        weight[-1] = max(weight[-1], 0.5)
        w, bias = fit_svm(train, y, weight)
        score = x @ w + bias
    whole = np.vstack(means) @ root
    v, whole_bias = fit_svm(whole, np.where(toxic == 1, 1.0, -1.0), np.where(toxic == 1, 1 / (toxic == 1).sum(), 1 / (toxic == 0).sum()), steps=400)
    margins = np.stack([np.full(len(texts), bias), whole @ v + whole_bias], axis=1)
    np.maximum.at(margins[:, 0], owner, score)
    goal = np.where(toxic == 1, 1 - 1 / (2 + (toxic == 1).sum()), 1 / (2 + (toxic == 0).sum()))
    return Model(kernel, root, (w, bias), (v, whole_bias), logistic(margins, goal))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model of the labelled rows that are not held out: at most `rows`, half of each class where there are as many,
    texts of at most `chars` characters, chosen by a hash of the id; at most `rows` texts reach the driver."""
    marked = labels.filter(~held_out(id_col)).filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.groupBy("label_id").agg(F.max("y").alias("y"))
    picks = None
    for y in (0, 1):
        one = marked.filter(F.col("y") == y).orderBy(F.md5(F.col("label_id").cast("string"))).limit(rows // 2)
        picks = one if picks is None else picks.unionByName(one)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.char_length("text") <= chars)
    # one text of each labelled id, the least, however many rows repeat it
    found = known.join(F.broadcast(picks), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    found = sorted({(r["text"], r["y"]) for r in found})
    return fit([t for t, _ in found], np.array([y for _, y in found], np.int64))


def _scores(model: Model, column: pa.Array, reader: Reader) -> np.ndarray:
    out, texts, size = [], [], 0
    for v in column:
        texts.append(v.as_py() or "")
        size += len(texts[-1])
        if size > 2 << 20:
            out.append(model.margins(texts, reader))
            texts, size = [], 0
    if texts:
        out.append(model.margins(texts, reader))
    return model.probabilities(np.concatenate(out)) if out else np.zeros(0)


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score for every row of docs; only the text counts.

    Null and empty texts get the score of a text without any near word. Very long texts are read whole. Repeated rows
    score alike. Other columns are ignored. Empty table: empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.kernel)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(_scores(shared.value, b.column(1), reader))], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(frugal(score), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under 0.5."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.kernel)
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, b.column(at), reader) < 0.5))

    return docs.mapInArrow(frugal(keep), docs.schema)


def op5_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = read(spark, sf_dir, "documents")
    found = toxicity_scores(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
