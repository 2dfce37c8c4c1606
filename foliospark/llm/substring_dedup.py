"""Substring dedup by super-k-mer partitioning of word windows.

A window is ``WINDOW`` consecutive words of a document. Its minimiser is the
smallest mixed hash among its ``MINIMISER``-word runs. Consecutive windows with
one minimiser form a super-k-mer: the words from the first window's start to
the last one's end, packed as one string, which goes to the bucket that the
minimiser names. Equal windows have equal minimisers, so each bucket alone
can tell which of its windows recur. There, windows are sorted by a rolling
hash and every run of equal hashes is compared word by word.

Copies are combined before they travel: of equal super-k-mers that a worker
holds, only the one of the smallest document is sent, and the others are
known to repeat it already. A passage that a third of all documents share so
reaches its bucket once a worker's block, not once a document.

Word runs that many documents hold make poor minimisers: at the edges of a
passage that many documents share, every document's own words would follow it
into one bucket. So runs that a sample of documents shows to be frequent, and
runs of one repeated word, are minimisers only where a window has no other.
Such windows are parted by a second key, the least of their runs by another
hash, so that a minimiser which many different windows share fills no bucket.
Equal windows have equal keys of both kinds: all this decides where windows
are compared and never which are equal.

The number of buckets follows the bytes of the texts, so that the strings of
one, which a worker holds at once, do not grow with the corpus.

The strings of one block and bucket are packed and compressed together. Which
words to remove goes back as ranges, joined to the documents by a key of id
and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import cut, map_batches, parallelism

WINDOW = 50
MINIMISER = 6
#: Bytes of text that a worker takes as one block.
BLOCK_BYTES = 4 << 20
#: Super-k-mers that recurred in a worker and are remembered by it.
POPULAR = 10_000
#: Words of a bucket that are sorted at once; minimisers part the bucket.
SORTED_WORDS = 200_000
#: Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20
#: One in so many documents is sampled for frequent runs; a run is frequent in this share of them.
SAMPLED = 32
FREQUENT = 0.0005
#: Frequent runs that are remembered, most frequent first: what is sent to all workers is bounded.
FREQUENT_RUNS = 20_000
#: Stands for a null id: larger than any other, so never the earlier document.
NO_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOB = "bucket int, blob binary"
_RANGE = "doc bigint, row bigint, start int, stop int"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Word ids, exact within one object, and hashes that agree everywhere."""

    def __init__(self, words: list[bytes]) -> None:
        known: dict[bytes, int] = {}
        add = known.setdefault
        self.ids = np.fromiter((add(w, len(known)) for w in words), np.int32, len(words))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        n = len(words)
        sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(hashes[self.ids] * _powers(_BASE, n), out=sums[1:])
        self.sums, self.inverse = sums, _powers(_INVERSE, n + 1)

    def runs(self, length: int) -> np.ndarray:
        """The rolling hash of the ``length`` words from each place on."""
        n = max(0, len(self.ids) - length + 1)
        return (self.sums[length : length + n] - self.sums[:n]) * self.inverse[:n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _spans(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for every count c, in a row."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


class Order:
    """The order of word runs in which the least is a window's minimiser."""

    def __init__(self, frequent: np.ndarray, minimiser: int) -> None:
        self.minimiser, self.frequent = minimiser, np.sort(frequent.astype(np.uint64))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.frequent & np.uint64(0x3FFFF)).astype(np.int64)] = True

    def values(self, words: Words) -> np.ndarray:
        """A value for each run: mixed hashes, with frequent runs and those of one word last."""
        out = _mixed(words.runs(self.minimiser)) >> np.uint64(1)
        if not len(out):
            return out
        late = np.zeros(len(out), bool)
        if self.minimiser > 1:
            other = np.concatenate([[0], np.cumsum(words.ids[1:] != words.ids[:-1])])
            late |= other[self.minimiser - 1 :] == other[: len(out)]
        hits = np.flatnonzero(self.maybe[(out & np.uint64(0x3FFFF)).astype(np.int64)])
        if len(hits) and len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, out[hits]), len(self.frequent) - 1)
            late[hits[self.frequent[at] == out[hits]]] = True
        return np.where(late, out | np.uint64(1 << 63), out)


def _sampled_runs(minimiser: int):
    plain = Order(np.zeros(0, np.uint64), minimiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                values = np.unique(plain.values(Words((t.as_py() or "").encode().split())))
                low = values[values < np.uint64(1 << 60)]  # an eighth of all: others are rarely least
                if len(low):
                    yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int64))], ["run"])

    return run


def _sampled(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(SAMPLED)) == 0


def frequent_runs(docs: DataFrame, id_col: str, text_col: str, minimiser: int, n: int) -> np.ndarray:
    """Order values of runs that many of the ``n`` sampled documents hold."""
    counts = docs.filter(_sampled(id_col)).select(F.col(text_col).cast("string")).transform(map_batches, _sampled_runs(minimiser), "run bigint").groupBy("run").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") >= max(3.0, FREQUENT * n)).orderBy(F.desc("n"), "run").limit(FREQUENT_RUNS)
    return np.array([r["run"] for r in often.select("run").collect()], np.uint64)


def super_kmers(lengths: np.ndarray, words: Words, window: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: each super-k-mer's document, first word, number of windows, minimiser."""
    counts = np.maximum(lengths - window + 1, 0)
    first = np.cumsum(lengths) - lengths
    starts = np.repeat(first, counts) + _spans(counts)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    values = order.values(words)
    least = _least(values, window - order.minimiser + 1)[starts]
    late = least >> np.uint64(63) > 0
    if late.any():  # no choice but a frequent run: a second key parts what would meet there
        second = _least(_mixed(values * np.uint64(_BASE) | np.uint64(1)), window - order.minimiser + 1)[starts]
        least = np.where(late, _mixed(least ^ second) | np.uint64(1 << 63), least)
    doc = np.repeat(np.arange(len(lengths)), counts)
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    at = np.flatnonzero(new)
    return doc[at], starts[at], np.diff(np.append(at, len(starts))), least[at]


def _pack(doc: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray, least: np.ndarray, texts: list[bytes], ranges: list[tuple[int, int, int, int]]) -> bytes:
    body = b"\n".join(texts)
    head = np.array([len(doc), len(ranges), len(body)], np.int64)
    known = np.array(ranges, np.int64).reshape(-1, 4)
    parts = (head, doc.astype(np.int64), row.astype(np.int64), pos.astype(np.int64), n.astype(np.int64), least.astype(np.uint64), known)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in parts) + body)


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, r, size = np.frombuffer(raw, np.int64, 3)
    numbers = np.frombuffer(raw, np.int64, 5 * k + 4 * r, 24)
    texts = raw[len(raw) - size :].split(b"\n") if k else []
    return numbers[: 5 * k].reshape(5, k), texts, numbers[5 * k :].reshape(r, 4)


def _sender(buckets: int, window: int, order: Order):
    def block(docs: list[int], rows: list[int], texts: list[bytes], popular: dict[bytes, int]) -> Iterator[tuple[int, bytes]]:
        split = [t.split() for t in texts]
        lengths = np.array([len(x) for x in split], np.int64)
        words = [w for x in split for w in x]
        whose, start, count, least = super_kmers(lengths, Words(words), window, order)
        if not len(start):
            return
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        doc, row = np.array(docs, np.int64)[whose], np.array(rows, np.int64)[whose]
        pos, n = start - (np.cumsum(lengths) - lengths)[whose], count + window - 1
        packed = [joined[a:b] for a, b in zip((ends - size)[start].tolist(), ends[start + n - 1].tolist())]
        # Of equal strings the smallest document's is sent; larger documents repeat it.
        smallest: dict[bytes, int] = {}
        seen_twice = []
        for p, d in zip(packed, doc.tolist()):
            was = smallest.setdefault(p, popular.get(p, d))
            if was != d:
                seen_twice.append(p)
                if d < was:
                    smallest[p] = d
        sent = np.fromiter((smallest[p] == d for p, d in zip(packed, doc.tolist())), bool, len(packed))
        for p in seen_twice:
            if p in popular or len(popular) < POPULAR:
                popular[p] = smallest[p]
        bucket = (_mixed(least) % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(by_bucket))):
            own = by_bucket[a:b]
            go, stay = own[sent[own]], own[~sent[own]]
            ranges = list(zip(doc[stay].tolist(), row[stay].tolist(), pos[stay].tolist(), (pos + n)[stay].tolist()))
            yield int(bucket[own[0]]), _pack(doc[go], row[go], pos[go], n[go], least[go], [packed[i] for i in go.tolist()], ranges)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        popular: dict[bytes, int] = {}
        for batch in batches:
            docs, rows, texts, held = [], [], [], 0
            out: list[tuple[int, bytes]] = []
            columns = [batch.column(i) for i in range(3)]
            for i in range(batch.num_rows + 1):
                if held and (i == batch.num_rows or held >= BLOCK_BYTES):
                    out += block(docs, rows, texts, popular)
                    docs, rows, texts, held = [], [], [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])
                        out = []
                if i < batch.num_rows and (t := columns[2][i].as_py()):
                    docs.append(columns[0][i].as_py())
                    rows.append(columns[1][i].as_py())
                    texts.append(t.encode())
                    held += len(texts[-1])

    return send


def repeated_ranges(blobs: Iterator[bytes], window: int, at_once: int = SORTED_WORDS) -> np.ndarray:
    """Of one bucket's super-k-mers: rows (doc, row, start, stop) of words that repeat a smaller document.

    Equal strings are combined first; what is left is sorted in parts by
    minimiser, as equal windows have equal minimisers.
    """
    known: list[tuple[int, int, int, int]] = []
    lists, first, records = [], {}, []
    for blob in blobs:
        numbers, texts, ranges = _unpack(blob)
        lists.append(ranges)
        for *rec, text in zip(*numbers.tolist(), texts):
            rec.append(text)
            held = first.setdefault(text, len(records))
            if held == len(records) or rec[0] == records[held][0]:
                records.append(rec)
                continue
            if rec[0] < records[held][0]:
                records[held], rec = rec, records[held]
            known.append((rec[0], rec[1], rec[2], rec[2] + rec[3]))
    # Where equal strings had come with equal ids, some may exceed an id that came later.
    low = {text: records[i][0] for text, i in first.items()}
    known += [(r[0], r[1], r[2], r[2] + r[3]) for r in records if r[0] > low[r[5]]]
    records = [r for r in records if r[0] == low[r[5]]]
    del first, low
    lists.append(np.array(known, np.int64).reshape(-1, 4))
    parts = max(1, -(-sum(r[3] for r in records) // at_once))
    dealt: list[list] = [[] for _ in range(parts)]
    for r in records:
        dealt[(r[4] >> 20) % parts].append(r)
    del records
    return np.concatenate(lists + [_recurring(part, window) for part in dealt])


def _recurring(records: list[list], window: int) -> np.ndarray:
    """The ranges of windows that recur in a larger document, by sorting all windows."""
    doc, row, pos, n = (np.array([r[k] for r in records], np.int64) for k in range(4))
    words = Words(b" ".join([r[5] for r in records]).split())
    before = np.cumsum(n) - n
    counts = n - window + 1
    offset = _spans(counts)
    at = np.repeat(before, counts) + offset
    of = np.repeat(np.arange(len(n)), counts)
    nothing = np.zeros((0, 4), np.int64)
    if not len(at):
        return nothing
    hashes = words.runs(window)[at]
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
    recurs = same[:-1] | same[1:]
    shared, begins = order[recurs], np.flatnonzero(~same[:-1][recurs])
    if not len(shared):
        return nothing
    groups = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(shared))))
    groups = _told_apart(words.ids, at[shared], groups, begins, window)
    whose = doc[of[shared]]
    low = np.full(groups.max() + 1, NO_ID, np.int64)
    np.minimum.at(low, groups, whose)
    gone = np.sort(shared[whose > low[groups]])
    if not len(gone):
        return nothing
    new = np.ones(len(gone), bool)
    new[1:] = (gone[1:] != gone[:-1] + 1) | (of[gone[1:]] != of[gone[:-1]])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(gone)) - 1
    r = of[gone[a]]
    return np.stack([doc[r], row[r], pos[r] + offset[gone[a]], pos[r] + offset[gone[b]] + window], 1)


def _told_apart(ids: np.ndarray, at: np.ndarray, groups: np.ndarray, begins: np.ndarray, window: int, step: int = 16384) -> np.ndarray:
    """Groups of windows with equal hashes, split where their words differ."""
    wrong = []
    reach = np.arange(window)
    for i in range(0, len(at), step):
        own, lead = at[i : i + step], at[begins[groups[i : i + step]]]
        wrong.append(i + np.flatnonzero((ids[own[:, None] + reach] != ids[lead[:, None] + reach]).any(1)))
    if len(wrong := np.concatenate(wrong)):
        groups, names = groups.copy(), {}
        for i in wrong.tolist():
            groups[i] = names.setdefault((int(groups[i]), ids[at[i] : at[i] + window].tobytes()), len(begins) + len(names))
    return groups


def _receiver(window: int):
    def rows(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32)), pa.array(found[:, 3].astype(np.int32))], ["doc", "row", "start", "stop"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != bucket:
                    if held:
                        yield rows(repeated_ranges(held, window))
                    bucket, held = b, []
                held.append(blob.as_py())
        if held:
            yield rows(repeated_ranges(held, window))

    return receive


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their ranges -> words kept."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            words = (batch.column(1)[i].as_py() or "").encode().split()
            ranges = batch.column(2)[i].as_py() or []
            gone = np.zeros(len(words) + 1, np.int64)
            for r in ranges:
                gone[r["start"]] += 1
                gone[r["stop"]] -= 1
            keep = np.cumsum(gone)[: len(words)] == 0
            kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
            text = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()))
            if len(out) == 256 or i == batch.num_rows - 1:
                n, gone_n, sha, text = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + 1 - len(out), len(out)), pa.array(n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(sha), pa.array(text)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
                out = []


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, buckets: int | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    Removed is each word covered by a window whose words also start in a
    document with a smaller id. ``buckets`` is one for each ``BUCKET_BYTES``
    of text unless given; a worker holds one bucket's strings.

    Defined results: null and empty texts have no words; texts shorter than a
    window keep all; a null id counts as larger than any other and null ids do
    not precede each other; rows that repeat an id do not remove each other's
    words; an empty table gives an empty result; further columns are not read.
    """
    if not 1 <= minimiser <= window:
        raise ValueError("a minimiser has between one word and a window's")
    facts = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("size"), F.count_if(_sampled(id_col)).alias("sampled")).head()
    buckets = buckets or max(parallelism(docs.sparkSession), -(-(facts["size"] or 0) // BUCKET_BYTES))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")
    order = Order(frequent_runs(docs, id_col, text_col, minimiser, facts["sampled"]), minimiser)
    blobs = keyed.transform(map_batches, _sender(buckets, window, order), _BLOB)
    ranges = cut(blobs.repartitionById(buckets, F.col("bucket")).transform(map_batches, _receiver(window), _RANGE))
    # Rows that repeat an id and a text found the same ranges.
    each = ranges.distinct().groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    marked = own.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("row", F.xxhash64("doc_id", "text")).join(each, ["doc", "row"], "left")
    return marked.select("doc_id", "text", "ranges").transform(map_batches, _trimmed, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
