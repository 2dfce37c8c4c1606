"""The pipeline stage by stage against plain versions, and what the entry registers."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from helpers import DOCS, awkward
from test_dedup import WHITE, brute_fingerprint, components

import __spark_entry__
import corpus_pipeline
from foliospark.llm import mixing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(300):
        good = r.random() < 0.8
        words = [word() for _ in range(r.randint(10, 150))]
        if not good:
            words = [w for w in words[:10] for _ in range(9)]
        docs.append((i, " ".join(words), "en", r.choice(["a", "b", None]), 1))
        labels.append((i, int(good), 0))
    for i in range(0, 60):
        text = docs[i][1]
        docs.append((1000 + i, text.replace(" ", "\n") if i % 2 else text.upper(), "en", "c", 1))
    docs += [docs[3], (2000, None, None, None, None), (2001, "", "en", "a", 0)]
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, folder)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = docs.collect()
    kept = [r for r in rows if model.scores(*(np.array([v]) for v in (quality.text_view(r["text"]), quality.meta_view(r["lang"], r["source"], r["n_chars"], quality.facts_of(r["text"])))))[0, 2] >= 0.5]
    assert good.columns == columns and Counter(good.collect()) == Counter(kept)

    one = stages["exact_dedup"](spark, good, folder)
    best = {}
    for r in kept:
        key = re.sub(WHITE, "", r["text"] or "")
        if key not in best or (-len(r["text"] or ""), r["doc_id"]) < (-len(best[key]["text"] or ""), best[key]["doc_id"]):
            best[key] = r
    assert one.columns == columns and Counter(one.collect()) == Counter(best.values())

    near = stages["near_dedup"](spark, one, folder)
    left = list(best.values())
    fps = [brute_fingerprint(r["text"]) for r in left]
    root = components(len(left), [(i, j) for i in range(len(left)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    first = {}
    for r, c in zip(left, root):
        first[c] = min(first.get(c, r), r, key=lambda x: x["doc_id"])
    assert near.columns == columns and Counter(near.collect()) == Counter(first.values())

    mixed = stages["mixing"](spark, near, folder)
    whole = {r["doc_id"]: r for r in first.values()}
    taken = mixing.mix(near).collect()
    count = Counter()
    for r in mixed.collect():
        words, full = (r["text"] or "").split(), (whole[r["doc_id"]]["text"] or "").split()
        walk = iter(full)
        assert all(w in walk for w in words)  # words of the document, in its order
        count[r["doc_id"]] += len(words)
    assert mixed.columns == columns
    assert {r["doc_id"]: r["taken"] for r in taken if r["taken"]} == {k: v for k, v in count.items() if v}

    tokens = stages["tokens"](spark, mixed, folder).collect()
    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    want = Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in mixed.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens) == want


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark, folder, tmp_path):
    """Empty tables, and repeated rows with columns of any names, go through every stage but keep the columns."""
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b", "en", "a", 3), (3, "a b", "en", "a", 3), (None, "word " * 400_000, "en", None, 5)]
    for rows in ([], odd):
        docs = awkward(spark.createDataFrame(rows, DOCS))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            got = out.collect()
            assert (len(got) > 0) == bool(rows), name
        assert len(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == len(rows)


def test_all_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
