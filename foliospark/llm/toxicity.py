"""Toxicity by a linear-chain conditional random field over words.

Labels are given to documents, so words are labelled first: a feature of words
(the word itself or one of its prefixes) marks toxic words if it stands in
many different contexts of toxic documents and hardly in others. Counting
contexts, not documents, keeps copies of one document from marking its rare
words. The words of toxic documents that have such a feature are the labelled
toxic tokens, and a two-state chain is trained on them by stochastic gradients
of its likelihood: word, prefix, suffix and neighbour features, and transitions.

Every text is scored whole: forward-backward gives each word's marginal, runs
of words over one half are the offending spans, and a logistic function,
fitted on sampled documents that the chain was not trained on, turns a
document's marginals into its score.

Training takes ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` labelled rows at most, those
whose hashed ids are smallest, and ``TRAIN_BYTES`` of text; the bounds are
parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import by_bytes, map_batches

TRAIN_TOXIC = 1200
TRAIN_CLEAN = 1800
#: Bytes of the texts that are learned from, half of them for each kind.
TRAIN_BYTES = 64 << 20
FOLDS = 5
BITS = 18
SEGMENT = 256
EPOCHS = 4
#: Words that a worker keeps with their scores.
KNOWN_WORDS = 400_000
#: Words handled at once by forward-backward.
CELLS = 1 << 20

_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 0 by 5; null ids too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _marks(word: str) -> list[str]:
    """The features of a word that may mark it: itself and its prefixes."""
    low = word.lower()
    return ["=" + low] + ["^" + low[:n] for n in range(4, 8) if len(low) >= n]


def _feature_table(words: list[str]) -> list[np.ndarray]:
    """Hashed features of words, a row each: as the one tagged, as the one before, as the one after.

    Places that a word does not fill hold ``1 << BITS``, which belongs to no feature.
    """
    hashed, unused, shift = xxhash.xxh64_intdigest, 1 << BITS, 64 - BITS
    own, before, after = [], [], []
    for word in words:
        low = word.lower()
        head = low[:5]
        marks = _marks(word)
        names = [*marks, "^" + low[:3], "$" + low[-3:], f"#{min(len(low), 12)}"]
        own.append([hashed(n) >> shift for n in names] + [unused] * (8 - len(names)))
        before.append((hashed("<=" + low) >> shift, hashed("<^" + head) >> shift))
        after.append((hashed(">=" + low) >> shift, hashed(">^" + head) >> shift))
    return [np.array(x, np.int32).reshape(-1, n) for x, n in ((own, 8), (before, 2), (after, 2))]


class Sample:
    """Documents as word numbers, laid end to end, with their words' features."""

    def __init__(self, texts: list[str]) -> None:
        known: dict[str, int] = {}
        ids = [np.fromiter((known.setdefault(m[0], len(known)) for m in _WORD.finditer(t)), np.int32) for t in texts]
        self.words = list(known)
        self.lengths = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        none = len(known)
        first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        self.before, self.after = np.full(len(self.ids), none, np.int32), np.full(len(self.ids), none, np.int32)
        self.before[1:], self.after[:-1] = self.ids[:-1], self.ids[1:]
        if len(first):
            self.before[first] = none
            self.after[np.append(first[1:], len(self.ids)) - 1] = none
        none_row = lambda x: np.full((1, x.shape[1]), 1 << BITS, np.int32)
        self.features = [np.vstack([x, none_row(x)]) for x in _feature_table(self.words)]

    def of(self, at: np.ndarray) -> np.ndarray:
        """Features of the words at places, a row each; the last index is unused."""
        return np.hstack([f[i[at]] for f, i in zip(self.features, (self.ids, self.before, self.after))])


def toxic_marks(s: Sample, toxic: np.ndarray) -> np.ndarray:
    """Whether each known word has a feature with many contexts in toxic documents and hardly any in others.

    ``toxic`` says it of each document.
    """
    doc = np.repeat(np.arange(len(s.lengths)), s.lengths)
    names: dict[str, int] = {}
    marks = [[names.setdefault(m, len(names)) for m in _marks(w)] for w in s.words]
    width = max(map(len, marks), default=1)
    table = np.array([m + [-1] * (width - len(m)) for m in marks], np.int64).reshape(-1, width)

    def spread(where: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Of each mark, the number of different kinds among the words at places."""
        out = np.zeros(len(names), np.int64)
        for k in range(width):  # prefixes of different lengths are different marks
            m = table[s.ids[where], k]
            pairs = np.unique(np.stack([m[m >= 0], kind[m >= 0]], 1), axis=0)
            out += np.bincount(pairs[:, 0], minlength=len(names))
        return out

    bad = toxic[doc]
    there = np.flatnonzero(bad)
    around = s.before[there].astype(np.int64) << 32 | s.after[there]
    contexts, holders = spread(there, around), spread(there, doc[there])
    others = np.flatnonzero(~bad)
    elsewhere = spread(others, doc[others])
    n, rest = toxic.sum(), (~toxic).sum()
    marked = (contexts >= max(4, 0.008 * n)) & (elsewhere * n <= 0.02 * holders * max(rest, 1))
    return (marked[table] & (table >= 0)).any(1) if len(table) else np.zeros(0, bool)


def forward_backward(odds: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1 to state 0, and what comes back from the next word.

    ``odds`` is laid out by time and sequence, sequences longest first;
    ``step[a, b]`` is the factor of going from a to b.
    """
    ahead, behind, after = np.empty_like(odds), np.ones_like(odds), np.ones_like(odds)
    active = np.searchsorted(-lengths, -np.arange(len(odds)), side="left")  # sequences longer than t
    ahead[0] = odds[0] * start
    (s00, s01), (s10, s11) = step
    for t in range(1, len(odds)):
        n = active[t]
        a = ahead[t - 1, :n]
        ahead[t, :n] = odds[t, :n] * (s01 + a * s11) / (s00 + a * s10)
    for t in range(len(odds) - 2, -1, -1):
        n = active[t + 1]
        g = odds[t + 1, :n] * behind[t + 1, :n]
        after[t, :n] = g
        behind[t, :n] = (s10 + s11 * g) / (s00 + s01 * g)
    return ahead, behind, after


def _by_length(lengths: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Sequences longest first, in blocks of so many padded cells."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, cells // int(lengths[order[at]]))
        yield order[at : at + n]
        at += n


@dataclass
class Chain:
    """A two-state chain: emission weights of hashed features, transitions, document calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = -3.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    calibration: np.ndarray = field(default_factory=lambda: np.array([-4.0, 4.0, 2.0, 2.0]))

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marginals of state 1 for sequences laid end to end."""
        out = np.zeros(len(scores))
        first = np.cumsum(lengths) - lengths
        odds = np.exp(np.clip(scores, -30, 30))
        for own in _by_length(lengths):
            size, begin = lengths[own], first[own]
            t = np.arange(size[0])[:, None]
            inside = t < size
            at = np.where(inside, begin + t, 0)
            ahead, behind, _ = forward_backward(np.where(inside, odds[at], 1.0), size, np.exp(self.step), np.exp(self.start))
            p = ahead * behind
            out[at[inside]] = (p / (1 + p))[inside]
        return out

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.calibration, _summary(p)))))


def _summary(p: np.ndarray) -> np.ndarray:
    """What a document's score depends on: bias, most, number and share of likely toxic words."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    likely = p[p > 0.1].sum()
    return np.array([1.0, p.max(), np.log1p(likely), np.sqrt(likely / len(p))])


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Chain:
    """A chain trained on three in four of the documents and calibrated on the others."""
    chain = Chain()
    rng = np.random.default_rng(seed)
    apart = rng.random(len(texts)) < 0.25
    fit = [i for i in range(len(texts)) if not apart[i]]
    known = Sample([texts[i] for i in fit])
    toxic = np.array([labels[i] for i in fit], bool)
    goal = (np.append(toxic_marks(known, toxic), False)[known.ids] & np.repeat(toxic, known.lengths)).astype(float)
    ends = np.cumsum(known.lengths)
    pieces = [(a, min(a + SEGMENT, e)) for s, e in zip((ends - known.lengths).tolist(), ends.tolist()) for a in range(s, e, SEGMENT)]
    weights = np.zeros((1 << BITS) + 1)  # the last belongs to no feature
    squares, step_squares, bias_square = np.full(len(weights), 0.1), np.full((2, 2), 1.0), 1.0
    for _ in range(epochs):
        for block in np.array_split(rng.permutation(len(pieces)), max(1, len(pieces) // 64)):
            own = sorted((pieces[k] for k in block.tolist()), key=lambda x: x[0] - x[1])
            if not own:
                continue
            size = np.array([b - a for a, b in own])
            place = np.concatenate([np.arange(a, b) for a, b in own])
            spots = known.of(place)
            u = weights[spots].sum(1) + chain.bias
            t = np.arange(size[0])[:, None]
            inside = t < size
            at = np.where(inside, np.cumsum(size) - size + t, 0)
            y = np.where(inside, goal[place][at], 0.0)
            step = np.exp(chain.step)
            ahead, behind, after = forward_backward(np.where(inside, np.exp(np.clip(u, -30, 30))[at], 1.0), size, step, np.exp(chain.start))
            p = ahead * behind / (1 + ahead * behind)
            error = np.zeros(len(place))
            error[at[inside]] = (y - p)[inside]
            g = np.bincount(spots.ravel(), np.repeat(error, spots.shape[1]), len(weights)) - 1e-4 * weights
            g[-1] = 0
            squares += g * g
            weights += 0.5 * g / np.sqrt(squares)
            bias_square += error.sum() ** 2
            chain.bias += 0.5 * error.sum() / np.sqrt(bias_square)
            paired = inside[1:]
            a, b = ahead[:-1][paired], after[:-1][paired]
            z = step[0, 0] + step[0, 1] * b + a * step[1, 0] + a * step[1, 1] * b
            expected = np.array([[(step[0, 0] / z).sum(), (step[0, 1] * b / z).sum()], [(a * step[1, 0] / z).sum(), (a * step[1, 1] * b / z).sum()]])
            y0, y1 = y[:-1][paired], y[1:][paired]
            seen = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
            step_squares += (seen - expected) ** 2
            chain.step += 0.2 * (seen - expected) / np.sqrt(step_squares)
    chain.weights = weights[:-1]
    del known
    rest = [i for i in range(len(texts)) if apart[i]] or fit
    tagged = [p for i in range(0, len(rest), 256) for p in tag(chain, [_WORD.findall(texts[k]) for k in rest[i : i + 256]])]
    chain.calibration = _logistic(np.array([_summary(p) for p in tagged]), np.array([labels[i] for i in rest], float))
    return chain


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method, with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
    return w


class Lexicon:
    """Words with their numbers and emission scores: as the word tagged, as the one before, as the one after."""

    def __init__(self, chain: Chain, size: int = KNOWN_WORDS) -> None:
        self.weights, self.size = np.append(chain.weights, 0.0), size
        self.known: dict[str, int] = {}
        self.values = np.zeros((1024, 3))

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.known) > self.size:
            self.known = {}
        known, had = self.known, len(self.known)
        ids = np.fromiter((known.setdefault(w, len(known)) for x in texts for w in x), np.int64)
        if len(known) > had:
            new = list(islice(known, had, None))
            if len(known) > len(self.values):
                self.values = np.vstack([self.values, np.zeros((len(known), 3))])
            for k, spots in enumerate(_feature_table(new)):
                self.values[had : len(known), k] = self.weights[spots].sum(1)
        return ids


def tag(chain: Chain, texts: list[list[str]], lexicon: Lexicon | None = None) -> list[np.ndarray]:
    """Each word's marginal, for every text. A ``lexicon`` may be kept between calls."""
    lexicon = lexicon or Lexicon(chain)
    lengths = np.array([len(x) for x in texts], np.int64)
    ids = lexicon.numbers(texts)
    if not len(ids):
        return [np.zeros(0)] * len(texts)
    values = lexicon.values[ids]
    scores = values[:, 0] + chain.bias
    inner = np.ones(len(ids), bool)  # words with one before them in the text
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    scores[1:] += values[:-1, 1] * inner[1:]
    scores[:-1] += values[1:, 2] * inner[1:]
    return np.split(chain.marginals(scores, lengths), np.cumsum(lengths)[:-1])


def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Offsets of runs of words whose marginals are over one half, in code points."""
    out: list[tuple[int, int]] = []
    last = -2
    places = [m.span() for m in _WORD.finditer(text)] if (p > 0.5).any() else []
    for i in np.flatnonzero(p > 0.5).tolist():
        out[-1:] = [(out[-1][0], places[i][1])] if i == last + 1 else [*out[-1:], places[i]]
        last = i
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], id_col: str = "doc_id", columns: tuple[str, ...] = ("text",), most_bytes: int = TRAIN_BYTES) -> list[dict]:
    """Labelled rows outside the held-out part: ``id``, ``y`` and the columns, by id.

    They are at most ``most[y]`` labelled y, those of smallest hashed ids, and
    of each kind the first whose texts have ``most_bytes / 2`` in all. These
    numbers bound what is broadcast and what the driver gets. Of rows that
    repeat an id the least by their columns is taken; an id with labels of
    both kinds has the larger.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("i")).agg(F.max(label).cast("int").alias("y"))
    by_class = [one.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(most[y]) for y in (0, 1)]
    picked = by_class[0].unionByName(by_class[1])
    own = docs.select(F.col(id_col).cast("bigint").alias("i"), F.struct(*[F.col(c).alias(c) for c in columns]).alias("r"))
    rows = own.join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min("r").alias("r"))
    size = F.sum(F.coalesce(F.octet_length(F.col("r")[columns[0]]), F.lit(0))).over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))
    kept = rows.withColumn("size", size).filter(F.col("size") <= most_bytes // 2).select("i", "y", "r").collect()
    return [{"id": r["i"], "y": r["y"], **r["r"].asDict()} for r in sorted(kept, key=lambda r: r["i"])]


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (TRAIN_CLEAN, TRAIN_TOXIC)) -> Chain | float:
    """A trained chain, or where labels of either kind are missing the constant score."""
    rows = sample(docs, labels, "toxic", most)
    y = [r["y"] for r in rows]
    if len(set(y)) < 2:
        return float(bool(y and y[0]))
    return train([r["text"] or "" for r in rows], y)


def score(docs: DataFrame, model: Chain | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted, spans``.

    ``spans`` are offsets of offending words in code points.

    Defined results: null and empty texts have no words and the score of a
    text without toxic ones; repeated rows are scored alike; rows with a null
    id count as held out; without labels of both kinds the score is constant;
    an empty table gives an empty result; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = None if isinstance(model, float) else Lexicon(model)
        for batch in batches:
            for part in by_bytes(batch, 2):
                texts = [t or "" for t in part.column(2).to_pylist()]
                if isinstance(model, float):
                    scores, found = [model] * len(texts), [[] for _ in texts]
                else:
                    marginals = tag(model, [_WORD.findall(t) for t in texts], lexicon)
                    scores = [model.score(p) for p in marginals]
                    found = [spans(t, p) for t, p in zip(texts, marginals)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([[{"start": a, "stop": b} for a, b in f] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                    ["doc_id", "held_out", "score", "predicted", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(map_batches, run, "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start:int,stop:int>>")
