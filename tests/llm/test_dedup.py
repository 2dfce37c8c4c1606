"""Exact, near, substring and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import awkward, clashing, frame, some_docs
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup, line_dedup, simhash, substring_dedup

WHITE = "[ \t\n\x0b\x0c\r]"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


# exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(WHITE, "", r[1] or "")].append(i)
    out = []
    for norm, own in groups.items():
        best = min(own, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        kept = False
        for i in own:
            wins = rows[i][0] == rows[best][0] and len(rows[i][1] or "") == len(rows[best][1] or "") and not kept
            kept |= wins
            out.append((rows[i][0], rows[best][0], len(own), wins, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("salts", [1, 16])
def test_exact_dedup(spark, salts):
    rows = some_docs()
    assert rows_of(exact_dedup.decisions(clashing(frame(spark, rows)), salts=salts), *EXACT) == brute_exact(rows)


def test_exact_dedup_tells_collisions_apart(spark):
    rows = some_docs(2)
    weak = lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)
    assert rows_of(exact_dedup.decisions(frame(spark, rows), digest=weak), *EXACT) == brute_exact(rows)


def test_exact_dedup_hot_group(spark):
    rows = [(i, "same " * (1 + i % 3), "en", "a", 1) for i in range(900)] + [(2000 + i, f"other {i}", "en", "a", 1) for i in range(300)]
    assert rows_of(exact_dedup.decisions(frame(spark, rows, parts=9)), *EXACT) == brute_exact(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup.decisions(frame(spark, [])).collect() == []


def test_exact_dedup_of_a_row_that_repeats_without_end(spark):
    rows = [(7, "same text", "en", "a", 1)] * 500 + [(8, "same  text", "en", "a", 1)] * 3 + [(9, f"t {i}", "en", "a", 1) for i in range(40)]
    df = frame(spark, rows, parts=6)
    assert rows_of(exact_dedup.decisions(df), *EXACT) == brute_exact(rows)
    kept = exact_dedup.exact_dedup(df).collect()
    assert len(kept) == 41 and sum(r["text"] == "same  text" for r in kept) == 1


def test_exact_dedup_keeps_whole_rows(spark):
    rows = some_docs()
    docs = awkward(frame(spark, rows))
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    want = sorted((r[0], r[4]) for r in brute_exact(rows) if r[3] and r[0] is not None)
    got = sorted((r["doc_id"], hashlib.sha256(re.sub(WHITE, "", r["text"] or "").encode()).hexdigest()) for r in kept.collect() if r["doc_id"] is not None)
    assert got == want


# SimHash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute_groups(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    found = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    ids = defaultdict(list)
    for r, c in zip(rows, found):
        if r[0] is not None:
            ids[c].append(r[0])
    return sorted([(r[0], f"{f:016x}", min(ids[c], default=None)) for r, f, c in zip(rows, fps, found)], key=str)


@pytest.mark.parametrize("long_list", [1, 64])
def test_simhash_groups(spark, long_list):
    rows = some_docs()
    assert rows_of(simhash.simhash_groups(clashing(frame(spark, rows)), long_list=long_list), "doc_id", "fingerprint", "component_id") == brute_groups(rows)


def test_spark_hash_is_the_contract_hash(spark):
    texts = ["a b c", "ä ö ü", ""]
    got = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("long_list", [1, 4, 1000])
def test_links_of_planted_fingerprints(spark, long_list):
    """Chains, crowds and far pairs: components agree with all pairs, whether lists are long or not."""
    r = random.Random(long_list)
    fps = set()
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 14)):
            fps.add(f)
            f ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3])))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges, degree = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), long_list)
    linked = [(signed.index(e["a"]), signed.index(e["b"])) for e in edges.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in linked)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want, got = components(len(fps), pairs), components(len(fps), linked)
    assert [[w == x for x in want] for w in want] == [[g == x for x in got] for g in got]
    counts = Counter(i for pair in pairs for i in pair)
    assert {signed.index(r["fp"]): r["n_links"] for r in degree.collect()} == dict(counts)


def test_hits_tell_shared_positional_bytes():
    """Every choice of shared positions meets in as many lists as the count filter takes for granted."""
    for shared in (set(c) for n in range(9) for c in combinations(range(8), n)):
        hits = sum(shared.issuperset(p) for p in simhash.PLANES)
        assert (hits >= simhash.LEAST_HITS) == (len(shared) >= 8 - simhash.MAX_BITS)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 120)] + [(500, 501)], "a bigint, b bigint")
    assert rows_of(simhash.components(edges), "node", "root") == sorted([(i, 0) for i in range(121)] + [(500, 500), (501, 500)], key=str)


def test_simhash_empty_and_dedup(spark):
    assert simhash.simhash_groups(frame(spark, [])).collect() == []
    rows = [r for r in some_docs() if r[0] is not None]
    docs = awkward(frame(spark, rows))
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_groups(rows)})


def test_simhash_dedup_tells_rows_of_one_id_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(5, text(1), "en", "a", 1), (5, text(2), "en", "a", 1), (2, text(1), "en", "a", 1), (9, text(3), "en", "a", 1), (9, text(3), "en", "a", 1), (None, text(3), "en", "a", 1), (None, text(4), "en", "a", 1)]
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.simhash_dedup(frame(spark, rows)).collect()), key=str) == sorted([(2, text(1)), (5, text(2)), (9, text(3)), (None, text(4))], key=str)


# substring dedup


def brute_substrings(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < ((1 << 62) if r[0] is None else r[0]):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "minimiser", "buckets"), [(50, 6, None), (10, 3, 7), (4, 1, 3), (1, 1, 2)])
def test_substring_dedup(spark, window, minimiser, buckets):
    rows = some_docs()
    got = substring_dedup.substring_dedup(clashing(frame(spark, rows)), window=window, minimiser=minimiser, buckets=buckets)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, window)


def test_substring_dedup_in_small_blocks_and_parts(monkeypatch):
    """Blocks, memory of popular strings and sorting in parts change nothing; nor do equal hashes of different words."""
    rows = [r for r in some_docs(3) if r[0] is not None and r[1]]
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 400)
    window = 10
    runs = substring_dedup.Words.runs
    monkeypatch.setattr(substring_dedup.Words, "runs", lambda self, n: runs(self, n) % np.uint64(11) if n == window else runs(self, n))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([r[1] for r in rows])], ["doc", "row", "text"])
    sent = list(substring_dedup._sender(5, window, substring_dedup.Order(np.zeros(0, np.uint64), 3))(iter([batch])))
    blobs = defaultdict(list)
    for b in sent:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            blobs[k].append(x)
    gone = defaultdict(set)
    for held in blobs.values():
        for _, row, a, b in substring_dedup.repeated_ranges(held, window, at_once=50).tolist():
            gone[row].update(range(a, b))
    want = brute_substrings(rows, window)
    got = sorted([(r[0], len(r[1].split()), len(gone[i]), hashlib.sha256(" ".join(w for k, w in enumerate(re.findall("[^\x20\x09-\x0d]+", r[1])) if k not in gone[i]).encode()).hexdigest()) for i, r in enumerate(rows)], key=str)
    assert [g[::3] for g in got] == [w[::3] for w in want] and [g[2] for g in got] == [w[2] for w in want]


def test_substring_dedup_empty(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).collect() == []


# line dedup


def brute_lines(rows, run):
    seen, place = {}, []
    keyed = sorted({(r[0] is None, r[0] or 0, xxhash.xxh3_64_intdigest(r[1] or ""), r[1]) for r in rows}, key=str)
    del keyed
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    out = [None] * len(rows)
    done = {}
    for i in order:
        text = rows[i][1]
        if (rows[i][0], text) in done:
            out[i] = done[rows[i][0], text]
            continue
        lines = (text or "").split("\n") if text else []
        solid = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for s in range(len(solid) - run + 1):
            key = tuple(lines[k] for k in solid[s : s + run])
            if key in seen:
                gone.update(solid[s : s + run])
            seen.setdefault(key, i)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text or ""
        out[i] = done[rows[i][0], text] = (rows[i][0], len(solid), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    del place
    return sorted(out, key=str)


def line_rows():
    r = random.Random(5)
    pool = [f"line {i}" for i in range(40)] + ["", "  ", "common"] * 4
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 25))), "en", "a", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "a", 1) for i in range(6)] + [(200, "common\n" * 30, None, None, None), (201, None, None, None, None), (202, "", None, None, 0), (None, rows[3][1], None, None, None)]
    return [*rows, rows[4], rows[4]]


@pytest.mark.parametrize("run", [1, 2, 5])
def test_line_dedup(spark, run):
    rows = line_rows()
    got = line_dedup.line_dedup(clashing(frame(spark, rows)), min_lines=run)
    assert rows_of(got, "doc_id", "n_lines", "n_removed", "kept_sha256") == brute_lines(rows, run)


def test_suffix_ranks_sort_all_suffixes(spark):
    """Doubled to the end, ranks are the suffix array: how many suffixes are smaller."""
    r = random.Random(9)
    docs = [[r.randint(1, 3) for _ in range(r.randint(1, 12))] for _ in range(14)]
    docs += [docs[0], [2] * 9]
    items = [(d, 0, p, x, 0) for d, own in enumerate(docs) for p, x in enumerate(own)]
    frame_ = spark.createDataFrame(items, "doc bigint, row bigint, pos int, high bigint, low bigint").repartition(4)
    suffixes = {(d, p): own[p:] for d, own in enumerate(docs) for p in range(len(own))}
    rows = line_dedup.suffix_ranks(frame_).collect()
    got = {(x["doc"], x["pos"]): (x["rank"], x["size"]) for x in rows}
    assert got == {k: (sum(o < s for o in suffixes.values()), sum(o == s for o in suffixes.values())) for k, s in suffixes.items()}
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for x in rows:  # the longest prefix that stands before, up to the depth of a round
        k = (x["doc"], x["pos"])
        best = max((common(s, suffixes[k]) for o, s in suffixes.items() if o < k), default=0)
        assert x["copied"] <= best and (x["copied"] > best / 4 or best == 0)
    for depth in (1, 3):
        own = {(x["doc"], x["pos"]): x["size"] for x in line_dedup.suffix_ranks(frame_, depth).collect()}
        assert own == {k: sum(o[:depth] == s[:depth] for o in suffixes.values()) for k, s in suffixes.items()}


def test_line_dedup_empty(spark):
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []
