"""Quality classifier by co-training a text view and a metadata view.

One classifier sees a document's content (the bytes and pairs of bytes it is
made of, repetition, word and line lengths), the other only what an index of
records says of it without its words: language, source, stated length, bytes,
lines and packed size. Both are logistic regressions. In each round they are
fitted on the labelled rows and on what the other taught so far. Then each
scores all unlabelled documents and hands the ``TAUGHT`` of either kind of
which it is surest, with a calibrated confidence of ``CONFIDENT`` or more, to
the other. In the end each view is calibrated on labelled rows kept apart, the
calibrated log-odds are combined by a logistic function fitted there too, and
every document is scored.

Learned from are at most ``LABELLED`` labelled rows of each class, those whose
hashed ids are smallest; the bound is a parameter. Pseudo-labels are sought
among all unlabelled documents outside the held-out part, which are scored
anew in each round; only numbers are shuffled for that.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import by_bytes, cut, drop_cut, map_batches
from foliospark.llm.toxicity import held_out, sample

LABELLED = 2000
ROUNDS = 2
TAUGHT = 150
CONFIDENT = 0.98
APART = 0.3
_NAMES = 32
_PAIRS = 256
_BINS = 24
_PACKER = zstandard.ZstdCompressor(level=1)
WIDTHS = 128 + _PAIRS + 7, 2 * _NAMES + 1 + 4 * (_BINS + 1)


def text_view(text: str | None) -> np.ndarray:
    """What a document is made of, whatever its length."""
    raw = (text or "").encode()
    words = raw.split()
    line = np.frombuffer(raw, np.uint8)
    counts = np.bincount(line, minlength=256).astype(float)
    pairs = np.bincount(line[:-1] * np.uint8(31) + line[1:], minlength=_PAIRS)  # bytes wrap around
    n, k = max(1, len(raw)), max(1, len(words))
    again = sum(map(operator.eq, words, islice(words, 1, None)))
    lines = raw.count(b"\n") + 1
    rest = [np.sqrt(counts[128:].sum() / n), len(set(words)) / k, again / k, len(raw) / k / 10, np.log1p(len(words)) / 10, np.log1p(n / lines) / 10, float(not words)]
    return np.concatenate([np.sqrt(counts[:128] / n), np.sqrt(pairs / n), rest])


def facts_of(text: str | None) -> tuple[int, int, int]:
    """What an index of records has besides names: bytes, lines, and bytes when packed."""
    raw = (text or "").encode()
    return len(raw), raw.count(b"\n") + bool(raw), len(_PACKER.compress(raw))


def meta_view(lang: str | None, source: str | None, n_chars: int | None, facts: tuple[int, int, int]) -> np.ndarray:
    """What is known of a document without its words: names, and numbers with the step of their scale they fall in."""
    out = np.zeros(WIDTHS[1])
    out[0 if lang is None else 1 + xxhash.xxh64_intdigest(lang) % (_NAMES - 1)] = 1
    out[_NAMES + (0 if source is None else 1 + xxhash.xxh64_intdigest(source) % (_NAMES - 1))] = 1
    out[2 * _NAMES] = float(n_chars is None)
    n_bytes, lines, packed = facts
    # Scales run from 0 to 1: length, bytes a line, packed share, bytes a character.
    scales = np.log1p(max(0, n_chars or 0)) / 14, np.log1p(n_bytes / max(1, lines)) / 12, (packed - 20) / max(1, n_bytes) / 0.8, n_bytes / max(1, n_chars or n_bytes) - 1
    for k, x in enumerate(scales):
        at = 2 * _NAMES + 1 + k * (_BINS + 1)
        x = min(max(x, 0.0), 1.0)
        out[at] = x
        out[at + 1 + min(int(x * _BINS), _BINS - 1)] = 1
    return out


class Logistic:
    """Weighted logistic regression on standardised features, with a ridge, by Newton's method."""

    def __init__(self, ridge: float = 1.0) -> None:
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = self._standard(x)
        w = np.zeros(z.shape[1])
        pull = np.full(len(w), self.ridge)
        pull[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9)
            move = np.linalg.solve(h, z.T @ (weight * (y - p)) - pull * w)
            w += move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
            if np.abs(move).max() < 1e-5:
                break
        self.w = w
        return self

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._standard(x) @ self.w, -30, 30)


def _p(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


@dataclass
class CoTrained:
    views: list[Logistic]
    calibrations: list[Logistic]
    together: Logistic
    #: What was taught: round, teaching view, label, number of rows.
    lessons: list[tuple[int, int, int, int]] = field(default_factory=list)

    def odds(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The two views' calibrated log-odds of good quality, a column each."""
        return _odds(self.views, self.calibrations, (content, meta))

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: the text view's, the metadata view's and the combined probability of good quality."""
        odds = self.odds(content, meta)
        return np.stack([_p(odds[:, 0]), _p(odds[:, 1]), _p(self.together.odds(odds))], 1)


def _odds(views: list[Logistic], calibrations: list[Logistic], rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.stack([c.odds(v.odds(x)[:, None]) for v, c, x in zip(views, calibrations, rows)], 1)


#: Unlabelled rows by key, and both views' features of them.
Rows = tuple[list[int], list[np.ndarray]]
#: For views, calibrations and the keys that each view knows already: by view and label the surest rows.
Choice = Callable[[list[Logistic], list[Logistic], list[set[int]]], dict[tuple[int, int], Rows]]


def of_arrays(pool: list[np.ndarray], taught: int = TAUGHT) -> Choice:
    """Chooses from unlabelled rows held as arrays; their keys are their places."""

    def choose(views: list[Logistic], calibrations: list[Logistic], known: list[set[int]]) -> dict[tuple[int, int], Rows]:
        out = {}
        p = _p(_odds(views, calibrations, tuple(pool)))
        for k in (0, 1):
            for label, sure in ((1, p[:, k]), (0, 1 - p[:, k])):
                best = [i for i in np.argsort(-sure, kind="stable").tolist() if i not in known[1 - k] and sure[i] >= CONFIDENT][:taught]
                out[k, label] = best, [x[best] for x in pool]
        return out

    return choose


def co_train(labelled: list[np.ndarray], y: np.ndarray, choose: Choice, rounds: int = ROUNDS, seed: int = 3) -> CoTrained:
    """``labelled`` holds the two views' features, row by row."""
    rng = np.random.default_rng(seed)
    apart = np.zeros(len(y), bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        apart[rng.permutation(own)[: int(len(own) * APART)]] = True
    if len(set(y[apart])) < 2:
        apart[:] = True
    own = ~apart if len(set(y[~apart])) == 2 else np.ones(len(y), bool)
    learned: list[tuple[list[np.ndarray], list[float]]] = [([], []), ([], [])]  # what each view was taught
    known: list[set[int]] = [set(), set()]
    lessons = []

    def fitted() -> tuple[list[Logistic], list[Logistic]]:
        views, calibrations = [], []
        for k in (0, 1):
            x, goal = np.vstack([labelled[k][own], *learned[k][0]]), np.concatenate([y[own], learned[k][1]])
            weight = np.concatenate([np.ones(own.sum()), np.full(len(learned[k][1]), 0.5)])
            view = Logistic().fit(x, goal, weight)
            views.append(view)
            calibrations.append(Logistic(0.1).fit(view.odds(labelled[k][apart])[:, None], y[apart], np.ones(apart.sum())))
        return views, calibrations

    for turn in range(rounds):
        taught = 0
        for (k, label), (keys, rows) in choose(*fitted(), known).items():
            new = [i for i, key in enumerate(keys) if key not in known[1 - k]]  # in one turn a view may not be told both labels
            known[1 - k].update(keys)
            learned[1 - k][0].append(rows[1 - k][new])
            learned[1 - k][1].extend([float(label)] * len(new))
            lessons.append((turn, k, label, len(new)))
            taught += len(new)
        if not taught:
            break
    views, calibrations = fitted()
    odds = _odds(views, calibrations, tuple(x[apart] for x in labelled))
    return CoTrained(views, calibrations, Logistic(0.1).fit(odds, y[apart], np.ones(apart.sum())), lessons)


def _views(rows: list[dict]) -> list[np.ndarray]:
    content = [text_view(r["text"]) for r in rows]
    meta = [meta_view(r["lang"], r["source"], r["n_chars"], facts_of(r["text"])) for r in rows]
    return [np.array(content).reshape(-1, WIDTHS[0]), np.array(meta).reshape(-1, WIDTHS[1])]


_INPUTS = ("text", "lang", "source", "n_chars")


def of_documents(docs: DataFrame, labels: DataFrame, taught: int = TAUGHT) -> Choice:
    """Chooses from all documents outside the held-out part that have no label.

    Rows are keyed by a hash of id and text. Every document is scored by both
    views; keys and scores are held against the labels' ids, the surest are
    taken, and these rows alone, ``4 * taught`` at most, are read again.
    """
    own = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("key"), *_INPUTS)
    labelled = labels.filter("quality IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"))

    def choose(views: list[Logistic], calibrations: list[Logistic], known: list[set[int]]) -> dict[tuple[int, int], Rows]:
        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, 2):
                    odds = np.round(_odds(views, calibrations, tuple(_views(part.select(_INPUTS).to_pylist()))), 6)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(odds[:, 0]), pa.array(odds[:, 1])], ["id", "key", "odds0", "odds1"])

        rows = own.transform(map_batches, scored, "id bigint, key bigint, odds0 double, odds1 double")
        rows = cut(rows.join(labelled, "id", "left_anti").dropDuplicates(["key"]))
        least = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        best = []
        for k in (0, 1):
            for label in (1, 0):
                sure = F.col(f"odds{k}") * (1 if label else -1)
                fresh = rows.filter((sure >= least) & ~F.col("key").isin(sorted(known[1 - k])))
                best.append(fresh.orderBy(sure.desc(), "key").limit(taught).select("key", F.lit(k).alias("view"), F.lit(label).alias("label")))
        picked = cut(best[0].unionByName(best[1]).unionByName(best[2]).unionByName(best[3]))

        def viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _views(batch.select(_INPUTS).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v.tolist(), pa.list_(pa.float64())) for v in x)], ["key", "content", "meta"])

        wanted = F.broadcast(picked.select("key").distinct())
        found = own.join(wanted, "key", "left_semi").select("key", *_INPUTS).transform(map_batches, viewed, "key bigint, content array<double>, meta array<double>")
        features = {r["key"]: (r["content"], r["meta"]) for r in found.dropDuplicates(["key"]).collect()}
        out: dict[tuple[int, int], Rows] = {}
        lists: dict[tuple[int, int], list[int]] = {(k, label): [] for k in (0, 1) for label in (1, 0)}
        for r in picked.orderBy("key").collect():
            lists[r["view"], r["label"]].append(r["key"])
        for where, keys in lists.items():
            out[where] = keys, [np.array([features[key][v] for key in keys]).reshape(-1, WIDTHS[v]) for v in (0, 1)]
        drop_cut(rows, picked)
        return out

    return choose


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, taught: int = TAUGHT) -> CoTrained | float:
    """A co-trained pair, or where labels of either kind are missing the constant score.

    Only ids outside the held-out part are learned from. ``docs`` may have
    columns of any names besides those it needs.
    """
    rows = sample(docs, labels, "quality", (labelled, labelled), columns=_INPUTS)
    y = np.array([float(r["y"]) for r in rows])
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 1.0
    return co_train(_views(rows), y, of_documents(docs, labels, taught), rounds)


def _scored(model: CoTrained | float, part: pa.RecordBatch) -> np.ndarray:
    """Scores of a batch with the columns text, lang, source and n_chars."""
    if isinstance(model, float):
        return np.full((part.num_rows, 3), model)
    return model.scores(*_views(part.select(_INPUTS).to_pylist()))


def score(docs: DataFrame, model: CoTrained | float) -> DataFrame:
    """One row a document: ``doc_id, held_out, text_score, meta_score, score, predicted``.

    Scores are probabilities of good quality; ``predicted`` is 1 from one half.

    Defined results: null and empty texts and null metadata have features of
    their own; repeated rows are scored alike; without labels of both kinds
    the score is constant, 1 without any; rows with a null id count as held
    out; an empty table gives an empty result; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2):
                s = _scored(model, part)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(s[:, k]) for k in range(3)), pa.array((s[:, 2] >= 0.5).astype(np.int32))], ["doc_id", "held_out", "text_score", "meta_score", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), *_INPUTS)
    return rows.transform(map_batches, run, "doc_id bigint, held_out boolean, text_score double, meta_score double, score double, predicted int")


def keep_good(docs: DataFrame, model: CoTrained | float) -> DataFrame:
    """The rows of ``docs`` of good quality, with all their columns, whatever these are called; nothing is shuffled.

    Defined results: rows are judged as ``score`` does, repeated ones alike;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, batch.schema.get_field_index("text")):
                yield part.filter(pa.array(_scored(model, part)[:, 2] >= 0.5))

    return docs.transform(map_batches, run, docs.schema)
