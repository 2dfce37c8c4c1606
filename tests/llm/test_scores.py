"""Mixing, tokens, toxicity and quality: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from helpers import DOCS, awkward, clashing, frame, some_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import mixing, quality, sentencepiece, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# mixing


def brute_seats(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps) if v > 0))):
        open_ = [i for i in range(len(votes)) if votes[i] > 0 and out[i] < caps[i]]
        best = max(open_, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=9), st.integers(0, 60))
def test_sainte_lague(parties, seats):
    votes, caps = np.array([v for v, _ in parties]), np.array([c for _, c in parties])
    assert mixing.sainte_lague(votes, seats, caps).tolist() == brute_seats(votes.tolist(), seats, caps.tolist())


def test_targets_reach_the_share_and_no_cap_is_passed():
    r = random.Random(1)
    for _ in range(50):
        sizes = np.array([r.choice([0, 1, 10, 1000, 50_000]) for _ in range(r.randint(1, 12))])
        aim = mixing.targets(sizes)
        assert (aim <= 2 * sizes + 1e-6).all() and aim.sum() == pytest.approx(1.5 * sizes.sum())
        weights = np.array([(5, 2, 1)[i % 3] for i in range(len(sizes))])
        free = aim < 2 * sizes - 1e-6
        if free.any():  # those below their cap share by weight, and no capped one would get less
            rate = aim[free] / weights[free]
            assert np.allclose(rate, rate[0]) and (aim[~free] <= rate[0] * weights[~free] + 1e-6).all()


def test_draw_takes_whole_blocks():
    sizes = np.array([3, 0, 40, 17, 5, 100])
    part, chosen = mixing.draw(sizes, 4, 16, 7)
    line = np.repeat(np.arange(len(sizes)), sizes)
    want = Counter(line[[i for i in range(len(line)) if chosen[i // 16]]].tolist())
    assert chosen.sum() == 4 and part.tolist() == [want.get(i, 0) for i in range(len(sizes))]


def test_mix(spark):
    rows = some_docs(4, 150)
    df = clashing(frame(spark, rows))
    first, again = (sorted(map(tuple, mixing.mix(x).collect()), key=str) for x in (df, frame(spark, rows, parts=2)))
    assert first == again
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aim = dict(zip(order, mixing.targets(np.array([sizes[s] for s in order]))))
    assert Counter(x[2] for x in first) == Counter(sizes[r[3]] for r in rows)
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in first)
    for s in order:
        taken = sum(x[4] for x in first if x[2] == sizes[s])
        assert abs(taken - aim[s]) <= 2 * mixing.BLOCK_WORDS
    mixed = mixing.mixed_documents(frame(spark, rows)).collect()
    assert sum(len((r["text"] or "").encode().split()) for r in mixed) == sum(x[4] for x in first)


def brute_mix(rows, block):
    """Quotas and blocks by the definitions, all in one place."""
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    own = np.array([sizes[s] for s in order])
    aim = mixing.targets(own)
    quota = brute_seats(aim.tolist(), round(aim.sum() / block), (-(-2 * own // block)).tolist())
    return {s: min(q * block, 2 * n) for s, q, n in zip(order, quota, own.tolist())}


@pytest.mark.parametrize("bundle", [1, 1000])
def test_whole_mix_takes_the_blocks_of_its_quotas(spark, monkeypatch, bundle):
    """Many shards and bundles: each source's words are its quota's blocks, up to the last blocks of its shards."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 7)
    monkeypatch.setattr(mixing, "BUNDLE", bundle)
    rows = some_docs(7, 60)
    got = mixing.mix(frame(spark, rows), block=4).collect()
    want = brute_mix(rows, 4)
    by_source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        taken[by_source[r["doc_id"]]] += r["taken"]
    shards = len(rows)
    for s, n in want.items():
        assert abs(taken[s] - n) <= 4 * (1 + shards // 7)


def test_mix_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])).collect()] == [0, 0]


# tokens


def test_tokens_are_the_library_s(spark):
    sp = library.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(2)
    parts = ["a", " ", "  ", "▁", "\n", "\t", "é", "\x00", "😀", "　", "�", "the", "<s>", "ﬁ", "word", "́", "<0x0A>", "日本語"]
    rows = [*some_docs(), *[(5000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 30))), None, None, None) for i in range(400)]]
    got = sorted(map(tuple, sentencepiece.encode_decode(clashing(frame(spark, rows)), MODEL).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t, *_ in rows]
    assert got == sorted(want, key=str)


def test_a_full_chunk_table_is_started_anew():
    sp = sentencepiece.load(MODEL)
    table = sentencepiece.ChunkTable(sp, size=3)
    for text in ("a b c d e f", "g h", "a b c", "c c c"):
        assert table.encode([text])[0][1] == ",".join(map(str, sp.encode(text)))


def test_tokens_empty(spark):
    assert sentencepiece.encode_decode(frame(spark, []), MODEL, keep_ids=True).collect() == []


# toxicity


def toxic_corpus(n=700, seed=3):
    """Prose in which toxic documents hold insults, some of them inflected."""
    r = random.Random(seed)
    syllables = ["an", "er", "on", "th", "in", "ti", "es", "or"]
    vocabulary = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        toxic = int(r.random() < 0.25)
        for _ in range(r.randint(2, 5) if toxic else 0):
            bad = r.choice(["moron", "trash", "zzloweg" + r.choice(syllables), "qqvest" + r.choice(syllables)])
            words.insert(r.randrange(len(words) + 1), bad)
        docs.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, toxic))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    truth = {i: y for i, _, y in labels}
    df = frame(spark, [*docs, (9001, None, None, None, None), (9002, "", None, None, 0), (None, "moron trash", None, None, 1), docs[0]])
    model = toxicity.fit(awkward(df), spark.createDataFrame([*labels, (8888, None, None), (None, 1, 1), labels[0]], "doc_id bigint, quality int, toxic int"))
    got = toxicity.score(clashing(df), model).collect()
    assert len(got) == len(docs) + 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    apart = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in apart) / len(apart)
    assert right > 0.95
    texts = dict((d[0], d[1]) for d in docs)
    for r in apart:
        for s in r["spans"]:
            assert truth[r["doc_id"]] == 0 or len(texts[r["doc_id"]][s["start"] : s["stop"]]) > 2
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9001]["score"] == by_id[9002]["score"] < 0.5 and by_id[9001]["spans"] == []


def test_forward_backward_is_exact():
    """Against sums over all paths."""
    rng = np.random.default_rng(0)
    chain = toxicity.Chain(step=rng.normal(size=(2, 2)), start=0.3)
    lengths = np.array([3, 0, 7, 1, 7])
    scores = rng.normal(size=18)
    got = chain.marginals(scores, lengths)
    at = 0
    for n in lengths.tolist():
        u = scores[at : at + n]
        total, ones = 0.0, np.zeros(n)
        for path in range(1 << n):
            y = [path >> t & 1 for t in range(n)]
            w = np.exp(sum(u[t] * y[t] for t in range(n)) + sum(chain.step[a, b] for a, b in zip(y, y[1:])) + (chain.start * y[0] if n else 0))
            total += w
            ones += w * np.array(y, float)
        assert np.allclose(got[at : at + n], ones / total)
        at += n


def test_toxicity_without_labels_of_both_kinds(spark):
    df = frame(spark, [(1, "a b", None, None, 1), (2, None, None, None, 1)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(df, toxicity.fit(df, none)).collect()] == [0.0, 0.0]
    assert toxicity.score(frame(spark, []), toxicity.Chain()).collect() == []


# quality


def test_quality(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(800):
        good = r.random() < 0.8
        words = [word() for _ in range(r.randint(10, 150))]
        if not good:
            words = [w for w in words[:10] for _ in range(9)] if i % 2 else [w + " |" for w in words]
        docs.append((i, " ".join(words), "en", "good" if good == (r.random() < 0.7) else "bad", sum(map(len, words))))
        if i % 2:
            labels.append((i, int(good), 0))
        else:
            labels.append((i, int(good), 0)) if i % 3 else None
    truth = {i: y for i, y, _ in labels}
    df = frame(spark, [*docs, (9001, None, None, None, None), (9002, "", "xx", "new", 0), docs[1]])
    model = quality.fit(awkward(df), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert any(n for *_, n in model.lessons)
    got = quality.score(clashing(df), model).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r["score"] <= 1 for r in got)
    apart = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in apart) / len(apart) > 0.95
    kept = {r["doc_id"] for r in quality.keep_good(df, model).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"]}


def test_co_training_exchanges_lessons():
    """A view that few labels teach little learns from the other's confident rows."""
    rng = np.random.default_rng(4)

    def rows(n):
        y = rng.integers(0, 2, n)
        return [y[:, None] * 2.0 + rng.normal(size=(n, 3)) * 0.2, y[:, None] * 2.0 + rng.normal(size=(n, 12)) * 3], y.astype(float)

    labelled, y = rows(40)
    pool, _ = rows(600)
    test, truth = rows(800)
    alone = quality.co_train(labelled, y, quality.of_arrays([p[:0] for p in pool]))
    taught = quality.co_train(labelled, y, quality.of_arrays(pool))
    assert all(any(n for _, k, _, n in taught.lessons if k == view) for view in (0, 1)) and not any(n for *_, n in alone.lessons)
    accuracy = lambda m: ((m.scores(*test)[:, 1] >= 0.5) == truth).mean()
    assert accuracy(taught) > accuracy(alone)
    assert ((taught.scores(*test)[:, 2] >= 0.5) == truth).mean() > 0.97


def test_lessons_are_those_of_all_unlabelled_documents(spark):
    """One round's choice against brute force; repeated rows teach once, held-out and labelled ones never."""
    r = random.Random(2)
    docs = [(i, " ".join(r.choice("ab" if i % 3 else "abcdefgh") * r.randint(1, 9) for _ in range(r.randint(3, 60))), r.choice(["en", None]), "s", r.choice([None, 40, 400])) for i in range(300)]
    labels = [(i, i % 3 > 0, 0) for i in range(0, 300, 4)]
    rows = [dict(zip(("id", "text", "lang", "source", "n_chars"), d)) for d in docs]
    x = quality._views([rows[i] for i, *_ in labels])
    y = np.array([float(q) for _, q, _ in labels])
    views = [quality.Logistic().fit(v, y, np.ones(len(y))) for v in x]
    calibrations = [quality.Logistic(0.1).fit(v.odds(a)[:, None], y, np.ones(len(y))) for v, a in zip(views, x)]
    pool = [d for d in rows if d["id"] % 4 and zlib.crc32(str(d["id"]).encode()) % 5]
    df = awkward(frame(spark, [*docs, docs[1], docs[2], docs[5], (None, "a a a", "en", "s", 3)]))
    choose = quality.of_documents(df, spark.createDataFrame([(i, int(q), z) for i, q, z in labels], "doc_id bigint, quality int, toxic int"), taught=12)
    got = choose(views, calibrations, [set(), set()])
    want = quality.of_arrays(quality._views(pool), taught=12)(views, calibrations, [set(), set()])
    seen = 0
    for where in want:
        odds = [np.sort(np.round(quality._odds(views, calibrations, tuple(c[where][1]))[:, where[0]], 4)) for c in (got, want)]
        assert odds[0].tolist() == odds[1].tolist()
        seen += len(odds[0])
    assert seen > 10
    more = choose(views, calibrations, [set(got[1, 1][0]), set(got[0, 1][0])])
    assert not set(more[0, 1][0]) & set(got[0, 1][0])


def test_fits_take_rows_whole_in_any_company(spark):
    docs = [(i, t, "en", "a", 1) for i, t in enumerate(["a b c", None, "", "x " * 500_000, "moron " * 20, "d e f"])] * 2 + [(3, "another text", "en", "a", 1)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)] + [(2, None, None)], "doc_id bigint, quality int, toxic int")
    df = awkward(frame(spark, docs))
    rows = toxicity.sample(df, labels, "toxic", (10, 10))
    wanted = [i for i in range(6) if zlib.crc32(str(i).encode()) % 5]
    assert [r["id"] for r in rows] == wanted and all(r["y"] == r["id"] % 2 for r in rows)
    assert {r["id"]: r["text"] for r in rows}[wanted[0]] == docs[wanted[0]][1]
    assert 3 not in [r["id"] for r in toxicity.sample(df, labels, "toxic", (10, 10), most_bytes=1000)] or len("another text") < 500
    scored = quality.score(df, quality.fit(df, labels)).collect()
    assert len(scored) == len(docs)
    assert len(toxicity.score(df, toxicity.fit(df, labels)).collect()) == len(docs)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame([(1, "a", None, None, None)], DOCS)
    assert quality.score(df, quality.fit(df, none)).first()["score"] == 1.0
    assert quality.keep_good(frame(spark, []), 1.0).collect() == []
