"""Near dedup on five-word shingles against all pairs' Jaccard similarity."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, frame, some_docs
from pyspark.sql import functions as F
from test_dedup import brute_fingerprint, components

import corpus_pipeline
from foliospark.llm import near_dedup
from foliospark.llm.simhash import row_key


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_near(rows):
    """The (id, text) that stay."""
    rows = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    sets = [shingles(t) for *_, t in rows]
    similar = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    groups = {}
    for r, c in zip(rows, root):
        groups.setdefault(c, []).append(r)
    return groups.values()


def check(rows, kept):
    """One row of each component, of the smallest id."""
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    groups = brute_near(rows)
    assert len(got) == len(groups)
    for own in groups:
        assert sum(r in own for r in got) == 1
        assert [r[:2] for r in got if r in own] == [own[0][:2]]


def near_rows(seed=3):
    """Crowds of near copies in chains, shared passages of several crowds, and lone texts."""
    r = random.Random(seed)
    word = lambda: f"v{r.randrange(3000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for g in range(8):
        words = [word() for _ in range(r.choice([20, 60, 120]))]
        if g % 2:
            words[5:5] = passage
        for _ in range(r.choice([2, 5, 30])):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(r.choice([1, 1, 2, 6])):
                words[r.randrange(len(words))] = word()
    texts += [" ".join([*passage, *[word() for _ in range(k)]]) for k in (0, 1, 4, 5, 6, 7, 8, 9, 30)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("long_list", [1, 3, 64])
def test_near_dedup(spark, long_list):
    rows = near_rows() + [(7000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in some_docs()]
    check(rows, near_dedup.near_dedup(frame(spark, rows), long_list=long_list))


def test_near_dedup_keeps_columns(spark):
    docs = clashing(frame(spark, some_docs()))
    assert near_dedup.near_dedup(docs).columns == docs.columns


def test_stage_removes_texts_with_two_words_changed(spark):
    """J is 0.8 or more here, but fingerprints of three-word shingles differ in more than two bits."""
    r = random.Random(4)
    rows = []
    for i in range(30):
        words = [f"u{r.randrange(5000)}" for _ in range(100)]
        rows.append((i, " ".join(words), "en", "a", 1))
        words[30], words[70] = "other", "words"
        rows.append((1000 + i, " ".join(words), "en", "a", 1))
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, rows), "")
    assert {x["doc_id"] for x in kept.collect()} == set(range(30))


def test_stage_links_what_fingerprints_link(spark):
    """Fingerprints see how often a shingle stands, sets do not: these texts share few of their five-word shingles."""
    r = random.Random(8)
    rows = []
    for i in range(12):
        often = " ".join([f"w{i}", f"x{i}", f"y{i}"] * 400)
        rows += [(1000 * k + i, " ".join([often, *[f"u{r.randrange(10**6)}" for _ in range(20)]]), "en", "a", 1) for k in range(3)]
    fps = {x[0]: brute_fingerprint(x[1]) for x in rows}
    assert all((fps[i] ^ fps[1000 * k + i]).bit_count() <= 2 for i in range(12) for k in (1, 2))
    assert len(near_dedup.near_dedup(frame(spark, rows)).collect()) == 36
    twice = frame(spark, [*rows, rows[5], rows[30]])
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, twice, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(12))


def test_given_links_and_similar_sets_join(spark):
    """A chain of a given link and a similar pair is one component, whatever group is named."""
    r = random.Random(9)
    text = [" ".join(f"t{r.randrange(5000)}" for _ in range(60)) for _ in range(4)]
    docs = frame(spark, [(1, text[0], "en", "a", 1), (2, text[1], "en", "a", 1), (3, text[1] + " more", "en", "a", 1), (4, text[2], "en", "a", 1), (5, text[3], "en", "a", 1)])
    group = F.when(F.col("doc_id").isin(1, 3), 77).otherwise(F.col("doc_id"))
    linked = docs.select(row_key("doc_id", "text").alias("row"), group.cast("bigint").alias("group"))
    assert sorted(x["doc_id"] for x in near_dedup.near_dedup(docs, linked=linked).collect()) == [1, 4, 5]


def test_long_lists_write_only_pairs_that_sketches_leave(spark):
    """All similar pairs of different components, and few others, of a crowd that shares one shingle."""
    r = random.Random(10)
    level = Fraction("0.8")
    passage = [f"p{k}" for k in range(12)]
    own = []
    for g in range(30):
        words = [f"v{r.randrange(10**6)}" for _ in range(r.choice([40, 90, 700]))]
        for _ in range(4):
            own.append(near_dedup.shingle_set(" ".join([*passage, *words])))
            words[r.randrange(len(words))] = "other"
    n = len(own)
    sketches = [near_dedup._folded(near_dedup.sketch(x), near_dedup.SHORT_SKETCH).tobytes() for x in own]
    column = lambda x: pa.array(x, pa.int64())
    batch = pa.RecordBatch.from_arrays([column([1] * n), column([0] * n), column(range(n)), pa.array(map(len, own), pa.int32()), pa.array([0] * n, pa.int32()), column(range(n)), pa.array(sketches, pa.binary())], ["key", "main", "node", "k", "pos", "root", "sketch"])
    found = {(a, b) for out in near_dedup._open_pairs(level)([batch.slice(0, 50), batch.slice(50)]) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    similar = {(i, j) for j in range(n) for i in range(j) if 5 * len(both := np.intersect1d(own[i], own[j])) >= 4 * (len(own[i]) + len(own[j]) - len(both))}
    assert similar <= found and len(similar) > 50
    assert len(found) < n * (n - 1) // 2 / 5


def test_rows_of_one_id_are_told_apart_by_text(spark):
    r = random.Random(6)
    text = lambda: " ".join(f"t{r.randrange(5000)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(5, a, "en", "a", 1), (5, b, "en", "a", 1), (2, a + " more", "en", "a", 1), (9, c, "en", "a", 1), (9, c, "en", "a", 1), (None, c + " more", "en", "a", 1)]
    kept = near_dedup.near_dedup(frame(spark, rows))
    assert sorted((x["doc_id"], x["text"]) for x in kept.collect()) == sorted([(2, a + " more"), (5, b), (9, c)])


def test_near_dedup_empty(spark):
    assert near_dedup.near_dedup(frame(spark, [])).collect() == []
