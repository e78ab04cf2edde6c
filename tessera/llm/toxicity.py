"""Toxicity: a support vector machine over a gapped subsequence kernel, with Nystroem landmarks.

The kernel compares two words by the subsequences of ORDER letters they share; one that spans s letters weighs
DECAY**s and may span at most SPAN, so gapped and inserted-character spellings stay close to the plain one. Words are
divided by the norm that a word of their length has. A sentence is compared by its most telling word.

Training (on the driver, bounded): the documents of at most SAMPLE labelled rows a class outside the held-out fold are
cut into sentences. Landmarks are words; a word's Nystroem features are its kernels with them, whitened. The machine
learns which words set sentences of toxic documents apart (their witnesses), against all sentences of the others,
witnesses and weights in turns; sentences of toxic documents without such a word take no part. Witnesses are also taught
with a letter inserted at each place, so that such spellings stay toxic however many clean words there are. Because the kernel has finitely many subsequences, the learnt function collapses
into one weight for each of them: a word's score is a sum of table look-ups, whatever the number of landmarks. Words that a
space splits are read as well: neighbouring pieces are joined, unless a piece is a word of clean labelled documents.
A document's score is that of its worst sentence, put through a logistic curve fitted on the sample.

Nulls and edges: a null text is empty; a text without words has the score of a word without subsequences; words of any
length are covered by overlapping windows; a null id has no label; without both classes, or without a word in toxic
labelled documents, every score is the share of label 1 (0 without any). Extra columns are ignored; repeated rows are scored
each and train as one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import held_out, training_labels

ORDER, SPAN, DECAY = 3, 7, 0.5
#: Letters a word is looked at at once, and the step between such windows in longer words.
WINDOW, STEP = 24, 12
#: Labelled documents of class 0 and of class 1 the machine is trained on, at most (the first by a hash of the id), and
#: the bytes of their texts, at most; texts are taken whole or not at all, one for each id.
SAMPLE, SAMPLE_BYTES = (3000, 1500), (12_000_000, 6_000_000)
#: Steepest logistic curve over decision values.
STEEPEST = 10.0
#: Letters of a word's shorter piece, where a space splits it, at most (of the longer one twice as many), and of both, at least.
PIECE, WHOLE = 4, 5
LANDMARKS = 80
ROUNDS = 3
#: Least odds of a word in toxic documents, and at first its least distance from chance in standard errors, for it to make
#: a sentence toxic; the weight of such a sentence.
ODDS, EVIDENCE, POSITIVE = 4.0, 2.5, 4.0
#: Weight of a spelling with an inserted letter against the word's own.
INSERTED = 0.2
THRESHOLD = 0.3
CACHE_WORDS = 400_000

#: Letter classes: a-z, the small letters U+00DF to U+00FF, then other letters dealt over the rest. 0: no letter.
CLASSES = 64
#: Put before each word, so that beginnings count; the class of the sign U+00FF, too rare to matter.
START = "^"
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _classes() -> np.ndarray:
    table = np.zeros(0x250, np.int32)
    for code in range(0x80, 0x250):
        table[code] = 60 + code % 4 if chr(code).isalpha() else 0
    table[0xDF:0x100] = np.arange(27, 60)
    table[ord(START)] = 59
    for k in range(26):
        table[ord("a") + k] = k + 1
    for mark, letter in _LEET.items():
        table[ord(mark)] = ord(letter) - ord("a") + 1
    return table


_TABLE = _classes()
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\w@$]|_")
_SPELT = re.compile(r"(?<!\w)\w(?:[^\w\n]{1,3}\w){2,}(?!\w)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = (np.array(x) for x in zip(*[(a, b, c) for a in range(n) for b in range(a + 1, min(n, a + SPAN)) for c in range(b + 1, min(n, a + SPAN))]))
    return i, j, k, DECAY ** (k - i + 1.0)


_SHAPES = {n: _triples(n) for n in range(ORDER, WINDOW + 1)}
_NORM = {n: float(np.sqrt((w**2).sum())) for n, (*_, w) in _SHAPES.items()}


def plain(word: str) -> str:
    """The word without punctuation around or inside it, lower-cased."""
    return word if word.isalpha() else _INNER.sub("", _OUTER.sub("", word))


def words_of(text: str) -> set[str]:
    """Distinct words of a text, and runs of single letters ("i d i o t") joined."""
    text = text.lower()
    found = set(text.split())
    found.update(_INNER.sub("", x).replace(" ", "") for x in _SPELT.findall(text))
    return found


class Pieces(dict):
    """The piece of a split word that a word may be, empty if it is none: too long, or a word of clean documents."""

    def __init__(self, known: frozenset[str]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> str:
        if len(self) > CACHE_WORDS:
            self.clear()
        bare = plain(word)
        piece = self[word] = bare if len(bare) <= 2 * PIECE and bare not in self.known else ""
        return piece


def split_words(text: str, pieces: Pieces) -> set[str]:
    """Neighbouring pieces joined ("id iot"): one of them short, none a word of clean documents, long enough together."""
    found, before = set(), ""
    for word in text.lower().split():
        piece = pieces[word]
        if piece and before and min(len(before), len(piece)) <= PIECE and len(before) + len(piece) >= WHOLE:
            found.add(before + piece)
        before = piece
    return {w for w in found if w not in pieces.known}


def inserted(word: str) -> list[str]:
    """The word with a letter put in at each place inside it; which letter follows from word and place."""
    word = plain(word)
    return [word[:k] + chr(ord("a") + zlib.crc32(f"{word}{k}".encode("utf-8", "surrogatepass")) % 26) + word[k:] for k in range(1, len(word))]


def _windows(words: Iterable[str]) -> dict[int, tuple[list[int], list[str]]]:
    """By length: which word, which window of it."""
    out: dict[int, tuple[list[int], list[str]]] = {}
    for at, word in enumerate(words):
        w = START + plain(word)
        for start in (*range(0, len(w) - WINDOW, STEP), max(len(w) - WINDOW, 0)):
            part = w[start : start + WINDOW]
            if len(part) >= ORDER:
                ids, parts = out.setdefault(len(part), ([], []))
                ids.append(at)
                parts.append(part)
    return out


def _codes(parts: list[str], n: int) -> np.ndarray:
    raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
    return _TABLE[np.minimum(raw, len(_TABLE) - 1)]


def kernels(words: list[str], table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sum over a word's subsequences of their weight times table[subsequence], normed; of several windows, the largest.

    rows, if given, maps subsequences to rows of the table.
    """
    width = 1 if table.ndim == 1 else table.shape[1]
    out = np.full((len(words), width), -np.inf, np.float32)
    flat = table.reshape(-1, width)
    for n, (ids, parts) in _windows(words).items():
        i, j, k, weight = _SHAPES[n]
        step = max(1, 2_000_000 // (len(i) * width))
        for a in range(0, len(parts), step):
            c = _codes(parts[a : a + step], n)
            u = (c[:, i] * CLASSES + c[:, j]) * CLASSES + c[:, k]
            u = u if rows is None else rows[u]
            weights = (weight / _NORM[n]).astype(np.float32)
            got = (table[u] @ weights)[:, None] if width == 1 else np.matmul(weights, flat[u])
            np.maximum.at(out, np.array(ids[a : a + step]), got)
    out[np.isinf(out)] = 0.0
    return out[:, 0] if table.ndim == 1 else out


def _profiles(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' normed subsequence weights: a matrix over the subsequences that occur in them, and the row of each subsequence (0: in none).

    Words longer than a window are as many landmarks as they have windows.
    """
    entries, column = [], 0
    for n, (_, parts) in sorted(_windows(marks).items()):
        i, j, k, weight = _SHAPES[n]
        for c in _codes(parts, n):
            entries += [(u, column, x) for u, x in zip(((c[i] * CLASSES + c[j]) * CLASSES + c[k]).tolist(), (weight / _NORM[n]).tolist())]
            column += 1
    used = sorted({u for u, _, _ in entries})
    rows = np.zeros(CLASSES**ORDER, np.int32)
    rows[used] = np.arange(1, len(used) + 1)
    matrix = np.zeros((len(used) + 1, column), np.float32)
    for u, column, x in entries:
        matrix[rows[u], column] += x
    return matrix, rows


def _svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss over x[rows], by Newton steps on the primal; strip by strip, to save memory."""
    width = x.shape[1]
    v, reg = np.zeros(width + 1), np.diag([ridge] * width + [1e-3])
    for _ in range(25):
        left, right = reg.copy(), np.zeros(width + 1)
        for k in range(0, len(rows), 20_000):
            part = slice(k, k + 20_000)
            a = np.hstack([x[rows[part]], np.ones((len(rows[part]), 1))])
            on = y[part] * (a @ v) < 1
            a, w = a[on], weight[part][on]
            left += (a * w[:, None]).T @ a
            right += a.T @ (w * y[part][on])
        new = np.linalg.solve(left, right)
        if np.abs(new - v).max() < 1e-5:
            break
        v = new
    return v[:-1], float(v[-1])


def _logistic(f: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of P(1 | f), with the classes weighted to the given share of label 1."""
    w = np.where(y == 1, prior / max((y == 1).sum(), 1), (1 - prior) / max((y == 0).sum(), 1)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p) + 1e-6
        hess = np.array([[(h * f * f).sum() + 1e-3, (h * f).sum()], [(h * f).sum(), h.sum()]])
        step = np.linalg.solve(hess, [(g * f).sum() + 1e-3 * a, g.sum()])
        if a - step[0] > STEEPEST:  # else words a little less telling than those of the sample would get no score
            step = np.array([a - STEEPEST, (g.sum() - hess[1, 0] * (a - STEEPEST)) / hess[1, 1]])
        step = np.clip(step, -3, 3)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return a, b


@dataclass
class Model:
    table: np.ndarray  # weight of each subsequence
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    known: frozenset[str] = frozenset()  # words of clean documents, which aren't pieces of others
    marks: list[str] = field(default_factory=list, repr=False)  # the landmarks, and the weight of the kernel with each of their windows
    alpha: np.ndarray | None = field(default=None, repr=False)
    cache: dict[str, float] = field(default_factory=dict, repr=False)
    pieces: Pieces | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "pieces": None}

    def worst(self, texts: list[str]) -> np.ndarray:
        """The decision value of each text's most telling word; the bias for texts without words."""
        if self.pieces is None:
            self.pieces = Pieces(self.known)
        sets = [words_of(t) | split_words(t, self.pieces) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list({w for s in sets for w in s if w not in self.cache})
        if new:
            self.cache.update(zip(new, (kernels(new, self.table) + self.bias).tolist()))
        get = self.cache.__getitem__
        return np.array([max(map(get, s), default=self.bias) for s in sets])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(self.worst(texts), 1.0) + self.offset, -30, 30)))


def train(texts: list[str], labels: list[int], prior: float) -> Model:
    """From whole texts and their labels; prior: the share of label 1 among all labelled rows."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(CLASSES**ORDER, np.float32), constant=float(prior))
    seen = (Counter(), Counter())
    bags = []  # the sentences of toxic documents
    for text, label in zip(texts, labels):
        if label:
            bags += [s for s in map(words_of, SENTENCE.split(text)) if s]
        seen[label].update(words_of(text))
    for s in bags:
        for w in s:
            seen[1].setdefault(w, 1)  # pieces that only sentences show
    if not any(len(plain(w)) >= ORDER for s in bags for w in s):
        return Model(np.zeros(CLASSES**ORDER, np.float32), constant=float(prior))
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())

    def telling(w: str) -> float:
        p1, p0 = (seen[1][w] + 0.1) / (n1 + 1), (seen[0][w] + 0.1) / (n0 + 1)
        return (p1 - p0) / np.sqrt(p1 / (n1 + 1) + p0 / (n0 + 1))

    usable = sorted(w for w in seen[1] if len(plain(w)) >= ORDER)
    ranked = sorted(usable, key=lambda w: (-telling(w), w))
    # Landmarks: the most telling words, and common words of the other class.
    common = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if len(plain(w)) >= ORDER]
    marks = list(dict.fromkeys([*ranked[: LANDMARKS // 2], *common[: LANDMARKS - LANDMARKS // 2]]))
    profiles, rows_of = _profiles(marks)
    gram = profiles.T @ profiles
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    white = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    vocabulary = sorted({*seen[0], *seen[1]})
    at = {w: k for k, w in enumerate(vocabulary)}
    negative = np.array([at[w] for w in seen[0]])
    weight0 = np.array([seen[0][w] for w in seen[0]], float)
    value = np.array([telling(w) for w in vocabulary])
    # A first guess at what makes a sentence toxic: in several toxic documents, and far rarer in the others.
    odds = np.array([(seen[1][w] + 0.1) / (n1 + 1) * (n0 + 1) / (seen[0][w] + 0.1) for w in vocabulary])
    marked = first = (value >= EVIDENCE) & (odds >= ODDS)
    sentences = [np.array([at[w] for w in s], np.int32) for s in bags]
    del bags, ranked, usable
    # Spellings of those words with a letter inserted, which the machine learns as well.
    spelt = [(k, v) for k in np.flatnonzero(first) for v in inserted(vocabulary[k])]
    known = len(vocabulary)
    vocabulary += [v for _, v in spelt]
    x = np.empty((len(vocabulary), white.shape[1]), np.float32)
    for k in range(0, len(vocabulary), 20_000):
        x[k : k + 20_000] = kernels(vocabulary[k : k + 20_000], profiles, rows_of) @ white.astype(np.float32)
    source = np.array([k for k, _ in spelt], np.int64)
    for _ in range(ROUNDS):
        best = np.array([s[value[s].argmax()] for s in sentences])
        witness, times = np.unique(best[marked[best]] if marked[best].any() else best, return_counts=True)
        own = np.minimum(times * POSITIVE, 400.0)
        at_witness = np.searchsorted(witness, source).clip(max=len(witness) - 1)
        taught = np.flatnonzero(witness[at_witness] == source)
        rows = np.concatenate([witness, known + taught, negative])
        target = np.concatenate([np.ones(len(witness) + len(taught)), -np.ones(len(negative))])
        weights = np.concatenate([own, INSERTED * own[at_witness[taught]], np.minimum(weight0, 100.0)])
        v, bias = _svm(x, rows, target, weights)
        value = x[:known] @ v + bias
        marked = first | (value > 0) & (odds >= ODDS)
    model = Model((profiles @ (white @ v)).astype(np.float32)[rows_of], bias, marks=marks, alpha=white @ v)
    model.known = frozenset(plain(w) for w, n in seen[0].items() if n >= 2 or len(plain(w)) < ORDER)
    model.slope, model.offset = _logistic(np.minimum(model.worst(texts), 1.0), y, prior)
    model.cache.clear()
    return model


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """Trained on at most SAMPLE labelled rows and SAMPLE_BYTES of text a class, the first ones by a hash of the id."""
    known = training_labels(labels, column)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[k]) for k in (0, 1)]
    sample = chosen[0].union(chosen[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    bound = F.when(F.col("label") == 0, SAMPLE_BYTES[0]).otherwise(SAMPLE_BYTES[1])
    rows = rows.withColumn("bytes", so_far).where(F.col("bytes") <= bound).orderBy("doc_id").select("text", "label").collect()
    return train([r["text"] for r in rows], [r["label"] for r in rows], prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score([t.as_py() or "" for t in part.column(1)]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return scored(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
