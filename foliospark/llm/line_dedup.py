"""Line dedup with a suffix array over line-ID sequences, by distributed prefix doubling.

Every line that is not blank gets a 128-bit ID of its content, and a document
is the sequence of its IDs. Suffixes are sorted by prefix doubling: a suffix's
rank for its first ``d`` lines and that of the suffix ``s`` lines further on
(``s`` up to ``d``) give its rank for ``d + s`` lines; from ``min_lines`` on a
round doubles twice, with the suffixes ``d``, ``2 d`` and ``3 d`` lines on. A rank is the number of
smaller suffixes, so suffixes of one rank are the interval of the suffix
array, from that index on, whose longest common prefix has ``d`` lines or
more, or all lines of its suffixes where these are shorter. Doubling goes on
until every suffix is placed: alone in its interval, or equal to all others in
it to its end. Documents whose suffixes are all placed take no part in further
rounds, and of documents with the same lines only the first is sorted.

Ranks come from the distinct keys only, counted with partial aggregation and
dealt by range, so that neither a very common line nor a common line followed
by many others fills one task.

Of each interval with a common prefix of ``min_lines`` or more, the first
suffix in document order is the original, and all others begin later copies
of at least that prefix. A suffix remembers the longest prefix for which it
was a later copy. Copies that overlap join to the maximal repeated runs, and
these are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import by_bytes, cut, join_by_group, map_batches, parallelism

MIN_LINES = 2
#: Stands for a null id: the last document.
NO_ID = (1 << 63) - 1


def _places(text: str | None) -> tuple[list[str], list[int]]:
    """All lines, and which of them are not blank."""
    lines = (text or "").split("\n") if text else []
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that is not blank, and one at place -1 with the digest of all of them."""
    for batch in batches:
        for part in by_bytes(batch, 2):
            doc, row, pos, ids, counts = [], [], [], [], []
            for d, r, t in zip(*(c.to_pylist() for c in part.columns)):
                lines, solid = _places(t)
                digests = b"".join([xxhash.xxh3_128_digest(lines[i]) for i in solid])
                n = len(solid)
                ids.append(xxhash.xxh3_128_digest(digests) + digests)
                doc.append(np.full(n + 1, d, np.int64))
                row.append(np.full(n + 1, r, np.int64))
                pos.append(np.arange(-1, n, dtype=np.int32))
                counts.append(np.full(n + 1, n, np.int32))
            both = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            columns = [np.concatenate(doc), np.concatenate(row), np.concatenate(pos), both[:, 0], both[:, 1], np.concatenate(counts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc", "row", "pos", "high", "low", "n"])


def _running(group: str | None):
    """Adds the partition's number and the running sum of ``n`` before each row, within its group if there is one; rows are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, last, base = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            upto = total + np.cumsum(n)
            before, total = upto - n, int(upto[-1])
            if group is not None:
                g = batch.column(group).to_numpy()
                begins = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
                first = np.maximum.accumulate(np.where(begins, before, -1))
                first = np.where(first < 0, base, first)
                before, last, base = before - first, g[-1], int(first[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(before)], [*batch.schema.names, "part", "before"])

    return run


def _numbered(keys: DataFrame, columns: list[str], group: str | None = None) -> tuple[DataFrame, int, bool]:
    """Distinct keys with ``start``, the sum of ``n`` over all smaller keys, or over those of the same group.

    Also the sum of all ``n``, and whether a key that others share has something after it (``more``).
    Keys are dealt by range, and only a row a partition comes to the driver.
    """
    spark = keys.sparkSession
    dealt = keys.repartitionByRange(parallelism(spark), *columns).sortWithinPartitions(*columns)
    local = cut(dealt.transform(map_batches, _running(group), T.StructType([*keys.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])))
    by = F.lit(0) if group is None else F.col(group)
    parts = local.groupBy("part").agg(F.sum("n").alias("n"), F.min(by).alias("low"), F.max(F.struct(by.alias("g"), (F.col("before") + F.col("n")).alias("sum"))).alias("high"), F.max((F.col("n") > 1) & F.col("more")).alias("open")).orderBy("part").collect()
    offsets, here, at = [], None, 0
    for p in parts:
        offsets.append((p["part"], p["low"], at if p["low"] == here else 0))
        at = p["high"]["sum"] + (at if p["high"]["g"] == here else 0)
        here = p["high"]["g"]
    starts = spark.createDataFrame(offsets, "part int, _low bigint, _offset bigint")  # a row a partition
    start = F.col("before") + F.when(by == F.col("_low"), F.col("_offset")).otherwise(0)
    out = local.join(F.broadcast(starts), "part").withColumn("start", start).drop("part", "before", "_low", "_offset", "more")
    return out, sum(p["n"] for p in parts), any(p["open"] for p in parts)


def suffix_ranks(sequences: DataFrame, depth: int | None = None, min_lines: int = 1) -> DataFrame:
    """``doc, row, pos, rank, size, copied``: each suffix's interval, how many share it, and what it copies.

    ``sequences`` has ``doc, row, pos, high, low``: the items' IDs by place,
    places without gaps. Suffixes are told apart to their ends, or only for
    their first ``depth`` items; equal ones share a rank. A suffix that ends
    early stands before all that go on.

    ``copied`` is the longest known prefix, of ``min_lines`` or more, with
    which a suffix before in document order begins too; 0 without one. A
    prefix is known up to the depth of a round or the suffix's end; what it
    goes on with begins a copy of its own.
    """
    place = Window.partitionBy("doc", "row").orderBy("pos")
    whole = Window.partitionBy("doc", "row")
    at = F.struct("doc", "row", "pos")
    first = F.min(at).alias("first")
    counted = F.count("*").alias("n")
    # Rows that repeat a document stand once; they meet by document, where suffixes are needed together too.
    items = cut(sequences.repartition("doc", "row").dropDuplicates(["doc", "row", "pos"]))

    def copies(have: int, left: Column) -> Column:
        """The common prefix if the suffix, with so many items left, is a later copy by it."""
        common = F.least(F.lit(have), left)
        return F.when((F.col("n") > 1) & (common >= min_lines) & (at != F.col("first")), common).otherwise(F.lit(0)).cast("int")

    keyed = lambda df, *c: df.withColumn("_k", F.xxhash64(*c))
    keys, total, more = _numbered(items.groupBy("high", "low").agg(counted, first).withColumn("more", F.lit(True)), ["high", "low"])
    ranked = join_by_group(keyed(items, "high", "low"), keyed(keys, "high", "low").withColumnRenamed("high", "_h").withColumnRenamed("low", "_l"), "_k", "n", total)
    state = ranked.filter("high = _h AND low = _l").select("doc", "row", "pos", F.col("start").alias("rank"), F.col("n").alias("size"), copies(1, F.lit(1)).alias("copied"), (F.col("n") > 1).alias("open"))
    done, out, have = [], ["doc", "row", "pos", "rank", "size", "copied"], 1
    goal = min_lines if depth is None else depth
    while more and (depth is None or have < depth):
        step, leads = (min(have, goal - have), 1) if have < goal else (have, 3)
        then = F.array(*[F.coalesce(F.lead("rank", step * k).over(place), F.lit(-1).cast("bigint")) for k in range(1, leads + 1)])
        goes_on = F.get("then", F.lit(leads - 1)) >= 0
        ahead = cut(state.withColumns({"then": then, "left": F.max("pos").over(whole) - F.col("pos") + 1, "busy": F.max("open").over(whole)}))
        done.append(ahead.filter("NOT busy").select(*out))
        live = ahead.filter("open")
        split, total, more = _numbered(live.groupBy("rank", "then").agg(counted, first).withColumn("more", goes_on), ["rank", "then"], "rank")
        moved = split.select(F.col("rank").alias("_r"), F.col("then").alias("_t"), (F.col("rank") + F.col("start")).alias("new"), "n", "first", F.xxhash64("rank", "then").alias("_k"))
        found = join_by_group(keyed(live, "rank", "then"), moved, "_k", "n", total).filter("rank = _r AND then = _t")
        have += step * leads
        # A suffix that ended here equals all of its interval to the end: nothing further tells them apart.
        found = found.select("doc", "row", "pos", F.col("new").alias("rank"), F.col("n").alias("size"), F.greatest("copied", copies(have, F.col("left"))).alias("copied"), ((F.col("n") > 1) & goes_on).alias("open"))
        state = ahead.filter("busy AND NOT open").select(*out, "open").unionByName(found)
    return reduce(DataFrame.unionByName, done, state.select(*out))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the copies that begin in them -> what is left."""
    for batch in batches:
        for part in by_bytes(batch, 1):
            out = []
            for t, copies in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                lines, solid = _places(t)
                turns = np.zeros(len(solid) + 1, np.int64)
                for c in copies or ():
                    turns[c["pos"]] += 1
                    turns[min(c["pos"] + c["copied"], len(solid))] -= 1
                gone = np.cumsum(turns) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[: len(solid)].view(np.int8), [0]])))
                spent = {i for i, g in zip(solid, gone.tolist()) if g}
                text = "\n".join([x for i, x in enumerate(lines) if i not in spent]) if spent else t or ""
                out.append((len(solid), len(spent), len(edges) // 2, int(np.diff(edges)[::2].max(initial=0)), hashlib.sha256(text.encode()).hexdigest(), text))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_lines", "n_removed", "n_runs", "longest_run", "kept_sha256", "kept_text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """One row a document: ``doc_id, n_lines, n_removed, n_runs, longest_run, kept_sha256, kept_text``.

    Removed is each line in a run of ``min_lines`` or more lines that stands
    before too: in a document with a smaller id, or further up in the same.

    Defined results: lines end at line feeds; blank lines count for nothing
    and stay; null and empty texts have no lines; a null id counts as larger
    than any other; rows that repeat an id and a text are one document and
    are treated alike, and of different texts with one id the one with the
    smaller hash counts as first; an empty table gives an empty result;
    further columns are not read.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = own.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")
    lines = cut(keyed.select("doc", "row", "text").transform(map_batches, _lines, "doc bigint, row bigint, pos int, high bigint, low bigint, n int"))
    # Of documents with the same lines only the first is sorted; the others are copies of it as a whole.
    wholes = lines.filter("pos < 0").select("doc", "row", F.xxhash64("high", "low", "n").alias("_k"), "high", "low", "n").dropDuplicates(["doc", "row"])
    wholes = cut(wholes)
    place = F.struct("doc", "row")
    firsts = cut(wholes.groupBy("_k", F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("n").alias("_n")).agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1"))
    later = cut(join_by_group(wholes, firsts, "_k", "times", wholes.count()).filter((F.col("high") == F.col("_h")) & (F.col("low") == F.col("_l")) & (F.col("n") == F.col("_n")) & (place != F.col("first"))).select("doc", "row", "n"))
    ranks = suffix_ranks(lines.filter("pos >= 0").join(later, ["doc", "row"], "left_anti").drop("n"), min_lines=min_lines)
    found = ranks.filter("copied > 0").select("doc", "row", "pos", "copied").unionByName(later.filter(F.col("n") >= min_lines).select("doc", "row", F.lit(0).alias("pos"), F.col("n").alias("copied")))
    copies = found.groupBy("doc", "row").agg(F.collect_list(F.struct("pos", "copied")).alias("copies"))
    return keyed.join(copies, ["doc", "row"], "left").select("doc_id", "text", "copies").transform(map_batches, _kept, "doc_id bigint, n_lines bigint, n_removed bigint, n_runs bigint, longest_run bigint, kept_sha256 string, kept_text string")
