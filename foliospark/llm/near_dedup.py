"""Near dedup by exact Jaccard similarity of word shingles, with a prefix filter.

The stage's pairs are those whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. SimHash with byte positions cannot guarantee them:
at 0.8 about 15 % of a fingerprint's bits differ whatever its length, and with
more than one differing bit in eight no byte need be shared. A prefix filter
can: with all sets sorted by one order, two sets of that similarity share a
shingle among the first ``k - ceil(0.8 k) + 1`` of each, so the inverted index
holds a fifth of each set. Which order it is changes the cost only; shingles
that a 1/32 sample of documents shows to be frequent come last.

SimHash links (``simhash.row_groups``) may be given beside: what fingerprints
have linked is linked here too, and the index finds what they cannot reach.

Pairs that meet in a list are let go where their sizes and places rule the
similarity out if that shingle is the first they share (similar ones pass in
that list at the latest), then where parity sketches do: a
sketch has a bit for each hash bucket that holds an odd number of shingles, so
sketches cannot differ in more bits than the sets do in shingles. All others
are verified on the whole sets. A list of over ``LONG_LIST`` sets is not paired
off at first: its members meet the least by hash of the sets of about their
size, which is the same in most lists of a crowd. Components of what that
links are then known, and only sets of *different* components still meet in
the list, which leaves nothing to do where a crowd has become one component;
they meet in a worker that holds short sketches of the list's sets, so that
pairs which these rule out are never written. No list is cut, so components
are those of all pairs.

Only distinct sets are indexed; rows of equal sets form one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import cut, drop_cut, join_by_group, map_batches
from foliospark.llm.simhash import components, keep_first, row_key, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Sets in a list from which only different components are paired off.
LONG_LIST = 16
#: Members of a size class that all others of it in a long list meet at first.
CENTRES = 8
#: Shingles, at most, that are known as frequent.
FREQUENT = 1 << 16

#: Bytes of the sketches that go with the entries of long lists, at most.
SHORT_SKETCH = 64

_INDEX = "doc_id bigint, row bigint, node bigint, k int, keys array<bigint>, sketch binary"
_ENTRY = "a bigint, b bigint, key bigint, k int, pos int"


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; empty if it has no words."""
    return np.unique(shingle_hashes(text, shingle))


def _least(n, similarity: Fraction):
    """The smallest whole number that is ``similarity * n`` or more."""
    return -(-n * similarity.numerator // similarity.denominator)


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity of each hash bucket's number of shingles, packed; at least as many buckets as shingles, a power of two."""
    m = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits(np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1 > 0)


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded: never more than the shingles in one set only."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch folded to ``size`` bytes at most."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _hashes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], ["key"])

    return run


def _index(shingle: int, similarity: Fraction, frequent: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, sketches = [], [], [], []
            for t in batch.column(2):
                own = shingle_set(t.as_py(), shingle)
                weight = np.zeros(len(own), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    weight = np.where(frequent[at] == own, counts[at], 0)
                prefix = len(own) - _least(len(own), similarity) + 1 if len(own) else 0
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                sketches.append(sketch(own).tobytes())
                keys.append(own[np.lexsort((own, weight))[:prefix]].view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, pa.array(sketches, pa.binary())], ["doc_id", "row", "node", "k", "keys", "sketch"])

    return run


def _possible(ka, pa_, kb, pb, similarity: Fraction):
    """Whether sets of these sizes can be similar enough if what they share first stands at these places.

    A pair that is similar enough passes in the list of the first shingle that
    it shares, so it may be let go in all lists where it does not pass.
    """
    num, den = similarity.numerator, similarity.denominator
    most = 1 + np.minimum(ka - pa_ - 1, kb - pb - 1)
    return most * (den + num) >= num * (ka + kb)


def _pairs(similarity: Fraction, long_list: int):
    """Possible pairs ``a, b`` of short lists and first pairs of long ones; members of long lists with null ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, node, k, pos = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4))
        order = np.lexsort((node, k, key))
        key, node, k, pos = key[order], node[order], k[order].astype(np.int64), pos[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        crowd = np.repeat(size > long_list, size)
        left, right = [node[:0]], [node[:0]]
        for d in range(1, long_list):
            i = np.flatnonzero((key[d:] == key[:-d]) & ~crowd[:-d])
            if not len(i):
                break
            i = i[_possible(k[i], pos[i], k[i + d], pos[i + d], similarity)]
            left.append(node[i])
            right.append(node[i + d])
        # In a long list all meet a few of their size class, and of the class below: those least by
        # hash, so that the sets of one crowd meet the same few in all their lists.
        star = np.flatnonzero(crowd)
        tier = np.floor(np.log(k[star]) / np.log(float(1 / similarity))).astype(np.int64)
        star = star[np.lexsort((node[star], tier, key[star]))]
        tier = np.floor(np.log(k[star]) / np.log(float(1 / similarity))).astype(np.int64)
        new = np.ones(len(star), bool)
        new[1:] = (key[star[1:]] != key[star[:-1]]) | (tier[1:] != tier[:-1])
        heads, of = np.flatnonzero(new), np.cumsum(new) - 1  # each class's first, and the class of each member
        ends = np.append(heads[1:], len(star))
        below = np.maximum(of - 1, 0)
        lower = (key[star[heads[below]]] == key[star]) & (tier[heads[below]] == tier - 1) if len(star) else np.zeros(0, bool)
        for cls, ok in ((of, np.ones(len(star), bool)), (below, lower)):
            for c in range(CENTRES):
                at = heads[cls] + c
                i = np.flatnonzero(ok & (at < ends[cls]))
                i, j = star[i], star[at[i]]
                fits = (i != j) & _possible(k[i], pos[i], k[j], pos[j], similarity)
                left.append(node[i[fits]])
                right.append(node[j[fits]])
        a, b = np.concatenate(left), np.concatenate(right)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        for at in range(0, len(both), 50_000):
            part = both[at : at + 50_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), none, none.cast(pa.int32()), none.cast(pa.int32())], ["a", "b", "key", "k", "pos"])
        for at in range(0, len(star), 50_000):
            s = star[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(node[s]), pa.nulls(len(s), pa.int64()), pa.array(key[s]), pa.array(k[s].astype(np.int32)), pa.array(pos[s].astype(np.int32))], ["a", "b", "key", "k", "pos"])

    return run


def _open_pairs(similarity: Fraction):
    """Possible pairs ``a, b`` of different components in long lists: ``key, main, node, k, pos, root, sketch``.

    Members outside a list's largest component (``main``) meet all of other
    components. One member meets the list at a time, so a list costs memory
    by its length only.
    """
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, main, node, k, pos, root = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(6))
        k, pos = k.astype(np.int64), pos.astype(np.int64)
        short = [np.frombuffer(x.as_py(), np.uint8) for b in held for x in b.column(6)]
        sizes = np.array([len(x) for x in short])
        order = np.argsort(key, kind="stable")
        left, right = [], []
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            # Sketches of each length, folded to every shorter one where such sets are met.
            tables = {}
            for n in np.unique(sizes[own]):
                tables[n] = np.stack([_folded(short[i], n) if sizes[i] >= n else np.zeros(n, np.uint8) for i in own])
            for at, i in enumerate(own):
                if root[i] == main[i]:
                    continue
                ok = (root[own] != root[i]) & ((root[own] == main[i]) | (node[own] > node[i])) & _possible(k[i], pos[i], k[own], pos[own], similarity)
                for n in np.unique(sizes[own[ok]]):
                    there = np.flatnonzero(ok & (sizes[own] == n))
                    m = min(n, sizes[i])
                    apart = np.bitwise_count(tables[m][there] ^ tables[m][at]).sum(1)
                    both = k[i] + k[own[there]]
                    good = own[there[(both - apart) * den >= num * (both + apart)]]
                    left.append(np.minimum(node[good], node[i]))
                    right.append(np.maximum(node[good], node[i]))
        if left:
            found = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
            for at in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 50_000, j]) for j in (0, 1)], ["a", "b"])

    return run


def _short_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = [_folded(np.frombuffer(x.as_py(), np.uint8), SHORT_SKETCH).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], ["node", "sketch"])


def _whole(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in part.column(1)], pa.binary())], ["node", "items"])

    return run


def _sifted(similarity: Fraction):
    """Pairs ``a, b`` whose sketches ``x, y`` and sizes ``kx, ky`` leave the similarity possible."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column("kx").to_numpy().astype(np.int64) + batch.column("ky").to_numpy()).tolist()
            good = []
            for x, y, k in zip(batch.column("x"), batch.column("y"), sizes):
                apart = _apart(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8))
                # Similar enough: (k - apart) / 2 shared of (k + apart) / 2 shingles.
                good.append((k - apart) * den >= num * (k + apart))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * similarity.denominator >= similarity.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _with_ends(pairs: DataFrame, total: int, values: DataFrame, **columns: str) -> DataFrame:
    """``pairs`` with columns of ``values`` (one row a node) for both ends, named with x and y."""
    out = pairs
    for end, names in (("a", {c: f"{n}x" for c, n in columns.items()}), ("b", {c: f"{n}y" for c, n in columns.items()})):
        ends = pairs.groupBy(end).agg(F.count("*").alias("n")).join(values.select(F.col("node").alias(end), *[F.col(c).alias(n) for c, n in names.items()]), end)
        out = join_by_group(out, ends, end, "n", total).drop("n")
    return out.select("a", "b", *[F.col(f"{n}{e}") for n in columns.values() for e in "xy"])


def _similar(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Those of ``pairs`` whose whole sets are similar enough."""
    met = cut(pairs.distinct())
    pairs = cut(_with_ends(met, met.count(), nodes, sketch="", k="k").transform(map_batches, _sifted(similarity), "a bigint, b bigint"))
    drop_cut(met)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = nodes.select("node", "row").join(ends, "node")
    sets = cut(texts.join(needed, "row").select("node", "text").dropDuplicates(["node"]).transform(map_batches, _whole(shingle), "node bigint, items binary"))
    edges = cut(_with_ends(pairs, pairs.count(), sets, items="").transform(map_batches, _verified(similarity), "a bigint, b bigint"))
    drop_cut(sets)
    drop_cut(pairs)
    return edges


def _given(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Links ``a, b`` of each node of ``rows`` (``row, node``) to the least node that shares a group of ``linked``."""
    own = rows.groupBy("row").agg(F.min("node").alias("node")).join(linked.groupBy("row").agg(F.min("group").alias("group")), "row")
    own = cut(own.select("node", "group").distinct())
    least = cut(own.groupBy("group").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    out = cut(join_by_group(own, least, "group", "n", own.count()).filter("a <> node").select("a", F.col("node").alias("b")))
    drop_cut(own, least)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, long_list: int = LONG_LIST, linked: DataFrame | None = None) -> DataFrame:
    """``doc_id, row, group``: for each row, with its ``row_key``, the component of its shingle set.

    Words are parted by ASCII white space and compared without the case of
    ASCII letters. A text of fewer words than a shingle has one shingle of all
    of them. Texts without words, nulls among them, are equal and like no other.
    Rows that have one group in ``linked`` (``row, group``, the same keys) are
    linked however like their sets are.
    """
    level = Fraction(str(similarity))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    sampled = texts.filter(F.pmod("row", F.lit(32)) == 7).select("text").transform(map_batches, _hashes(shingle), "key bigint")
    often = sampled.groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    frequent = np.array([r["key"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    counts = np.array([r["n"] for r in often], np.int64)[order]

    rows = cut(texts.transform(map_batches, _index(shingle, level, frequent[order], counts), _INDEX))
    nodes = cut(rows.groupBy("node").agg(F.min("row").alias("row"), F.first("k").alias("k"), F.first("sketch").alias("sketch")))
    entries = rows.groupBy("node").agg(F.first("k").alias("k"), F.first("keys").alias("keys")).select("node", "k", F.posexplode("keys").alias("pos", "key")).select("key", "node", "k", "pos")
    met = cut(entries.repartition("key").transform(map_batches, _pairs(level, long_list), _ENTRY))
    named = cut(rows.select("doc_id", "row", "node"))
    drop_cut(rows)
    edges = _similar(met.filter("b IS NOT NULL").select("a", "b"), texts, nodes, shingle, level)
    if linked is not None:
        edges = edges.unionByName(_given(named, linked))

    crowds = met.filter("b IS NULL").select("key", F.col("a").alias("node"), "k", "pos")
    if crowds.head(1):
        known = components(edges)
        rooted = cut(crowds.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")))
        shares = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("key", "main")
        open_ = cut(rooted.join(main, "key"))
        drop_cut(rooted)
        members = open_.groupBy("node").agg(F.count("*").alias("n"))
        short = cut(nodes.join(members.select("node"), "node", "left_semi").select("node", "sketch").transform(map_batches, _short_sketches, "node bigint, sketch binary"))
        sketched = join_by_group(open_, members.join(short, "node"), "node", "n", open_.count()).select("key", "main", "node", "k", "pos", "root", "sketch")
        rest = cut(sketched.repartition("key").transform(map_batches, _open_pairs(level), "a bigint, b bigint"))
        drop_cut(open_, short)
        edges = edges.unionByName(_similar(rest, texts, nodes, shingle, level))
    roots = components(edges)
    return named.join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("group"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, long_list: int = LONG_LIST, linked: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the first.

    First is the smallest id, null ids last, then the smaller row key; rows
    that repeat an id and a text are one document, of which one row stays. An
    empty table gives an empty result.
    """
    return keep_first(docs, near_groups(docs, id_col, text_col, shingle, similarity, long_list, linked), id_col, text_col)
