"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints of 64 bits are read as eight positional bytes. Two that differ in
at most two bits share at least six of the eight, at their positions. Lists
of one positional byte would hold a 256th of the corpus each, so the inverted
index is keyed by four positional bytes at a time: by the 14 quadruples of
eight positions in which any three positions stand together once (the planes
of a cube with corners 0 to 7). The lists that bring a pair together tell how
many positional bytes it shares: 14 lists mean eight, 7 seven and 3 six,
while five are shared by pairs that meet once, and fewer by pairs that meet
once or never. So hits are tallied per pair, pairs with under ``LEAST_HITS``
are let go, which keeps exactly those that share the guaranteed six bytes, and
the rest are verified by the bits that differ.

A list that is longer than ``LONG_LIST`` is never paired off: its
fingerprints, all distinct, are entered under themselves and their 64
one-bit neighbours instead. Any two in a neighbour's list differ in at most
two bits, and any two that differ in one or two bits share exactly two such
lists, so linking each to the list's smallest keeps every link, and list sizes
count the links. A pair meets in a long list, and both are entered there, or
in short ones only, and all its hits are tallied.

Only distinct fingerprints are indexed; equal ones form one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import cut, drop_cut, free_name, join_by_group, map_batches, one_of_each, whole_order

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Fingerprints in a list from which neighbours replace pairs.
LONG_LIST = 64

#: For each byte value, its bits from the highest to the lowest.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a whole text's word shingles in order; one of all words if these are fewer; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text, unsigned; 0 if it has no words."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    # Bit counts by byte histograms: each of the eight positional bytes adds its values' bits.
    positional = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(positional[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row, as a signed long."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).transform(map_batches, _fingerprints, "doc_id bigint, fp bigint")


#: The quadruples of positions: the 14 planes of a cube whose corners are the positions.
PLANES = tuple(tuple(x for x in range(8) if (x & n).bit_count() % 2 == side) for n in range(1, 8) for side in (0, 1))
#: In how many of them six shared bytes meet at least, and five at most once.
LEAST_HITS = 3


def _planes(fp: Column) -> Column:
    """The index keys of a fingerprint: quadruples of its positional bytes with the quadruple's number."""
    byte = lambda k: F.shiftrightunsigned(fp, 56 - 8 * k).bitwiseAND(F.lit(255))
    keys = []
    for n, places in enumerate(PLANES):
        key = F.lit(n).cast("bigint")
        for k in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte(k))
        keys.append(key)
    return F.array(*keys)


def links(distinct: DataFrame, long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` that connect all fingerprints within two bits, and ``fp, n_links``, how many are within two bits of each.

    ``distinct`` has one column ``fp`` without repeats. Links of fingerprints
    in long lists are stars, and any other link is a pair of its own; the
    numbers are exact for both. Fingerprints without links are left out.
    """
    entries = distinct.select("fp", F.explode(_planes(F.col("fp"))).alias("key"))
    sizes = cut(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    total = len(PLANES) * distinct.count()
    listed = cut(join_by_group(entries, sizes, "key", "n", total))

    short = listed.filter(F.col("n") <= long_list)
    met = short.select("key", F.col("fp").alias("a")).join(short.select("key", F.col("fp").alias("b")), "key").filter("a < b")
    tallied = met.groupBy("a", "b").agg(F.count("*").alias("hits")).filter(F.col("hits") >= LEAST_HITS)
    near = cut(tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b"))

    crowded = cut(listed.filter(F.col("n") > long_list).select("fp").distinct())
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)])
    balls = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    least = balls.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = cut(balls.join(least, "near").select("fp", "a", "n"))
    stars = shared.filter("fp <> a").select("a", F.col("fp").alias("b"))
    edges = cut(near.unionByName(stars).distinct())

    # Pairs of two crowded fingerprints are counted by their balls, all others one by one.
    ends = near.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    is_in = lambda c: crowded.select(F.col("fp").alias(c), F.lit(True).alias(f"_{c}"))
    apart = ends.join(is_in("fp"), "fp", "left").join(is_in("other"), "other", "left").filter("_fp IS NULL OR _other IS NULL")
    counts = apart.groupBy("fp").agg(F.count("*").alias("n")).unionByName(shared.groupBy("fp").agg((F.sum(F.col("n") - 1) / 2).cast("bigint").alias("n")))
    degree = cut(counts.groupBy("fp").agg(F.sum("n").alias("n_links")).filter("n_links > 0"))
    drop_cut(sizes, listed, near, crowded, shared)
    return edges, degree


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``edges`` (a, b) the smallest node it can reach.

    Labels start as the node itself. Each round every node takes the smallest
    label among its neighbours, and then its label's label; labels only fall,
    and paths halve at least, so rounds grow with the logarithm of the longest
    path. All is written to the shared folder each round.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        low = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        low = cut(low)
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = cut(low.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("further", "root")).alias("root")))
        moved = new.filter("root <> was").head(1)
        drop_cut(labels, low)
        labels = new.select("node", "root")
        if not moved:
            drop_cut(both)
            return labels


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """One row a document: ``doc_id, fingerprint, component_id, n_links``.

    ``fingerprint`` has 16 lowercase hex digits, ``component_id`` is the
    smallest id that links reach, and ``n_links`` is the number of other
    fingerprints that are within two bits.

    Defined results: null and empty texts have fingerprint zero and link like
    any other; repeated rows give repeated rows; ids that are null never name
    a component unless all its ids are null; an empty table gives an empty
    result; further columns are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    named = _components(fps, long_list)
    out = join_by_group(fps, named, "fp", "n", fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def _components(fps: DataFrame, long_list: int) -> DataFrame:
    """``fp, n, root, component_id, n_links``, a row a distinct fingerprint of ``doc_id, fp``."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges, degree = links(nodes.select("fp"), long_list)
    roots = components(edges)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(degree, "fp", "left")
    rooted = cut(rooted.select("fp", "least", "n", "root", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    drop_cut(nodes, edges, degree, roots)
    wholes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(wholes, "root").select("fp", "n", "root", "component_id", "n_links"))
    drop_cut(rooted)
    return named


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of id and text: rows that share it are one document."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the first by id (null last), then by row key.

    ``groups`` has ``doc_id, row, group`` for every row of ``docs``, with
    ``row_key``. Of rows that repeat a key one stays, the first by all columns.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = cut(groups.groupBy("doc_id", "row").agg(F.min("group").alias("group"), F.count("*").alias("times")))
    firsts = cut(groups.groupBy("group").agg(F.min(place)["row"].alias("first"), F.count("*").alias("n")).filter("n > 1"))
    key = free_name(docs, "_row")
    gone = join_by_group(groups, firsts, "group", "n", groups.count()).filter("row <> first").select(F.col("row").alias(key + "_gone"))
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(gone, F.col(key) == F.col(key + "_gone"), "left_anti")
    again = groups.filter("times > 1").select(F.col("row").alias(key + "_gone"))
    if again.head(1):
        same = F.col(key) == F.col(key + "_gone")
        kept = kept.join(again, same, "left_anti").unionByName(one_of_each(kept.join(again, same, "left_semi"), [F.col(key)], whole_order(docs)))
    return kept.drop(key)


def row_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """``doc_id, row, group``: for each row, with its ``row_key``, the component of its fingerprint."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    fps = cut(own.transform(map_batches, _keyed_fingerprints, "doc_id bigint, row bigint, fp bigint"))
    named = _components(fps.select("doc_id", "fp"), long_list).select("fp", "n", F.col("root").alias("group"))
    return join_by_group(fps, named, "fp", "n", fps.count()).select("doc_id", "row", "group")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component, as ``keep_first`` says.

    Defined results: rows are told apart by id and text, so a repeated id
    with different texts is several documents; an empty table gives an empty
    result; columns may have any names.
    """
    return keep_first(docs, row_groups(docs, id_col, text_col, long_list), id_col, text_col)
