"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's words are dealt in equal blocks. The mix's blocks go to the sources
by highest quotients of their targets, and a source's blocks beyond its whole
passes go to its shards by highest quotients of their sizes, first to bundles
of ``BUNDLE`` shards and then within each; all give whole quotas that add up
exactly. A shard holds documents by a hash of id and text,
about ``SHARD_WORDS`` words or ``SHARD_ROWS`` rows of one source, so a source
with most of the corpus has many shards. Within a shard the documents stand in
seeded order as one line of words, which is cut into blocks, and the quota of
blocks is drawn by a seeded permutation.

The driver holds one row a source: the weights are a list of sources. What is
grouped by shard is bounded by the shard's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import cut, join_by_group, map_batches

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 16
SHARD_WORDS = 1_000_000
SHARD_ROWS = 20_000
#: Shards of a source that are apportioned together.
BUNDLE = 1000
SEED = 20240607


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Whole seats by the highest quotients votes / (2 k + 1), at most ``caps`` each.

    Ties go to the earlier. A divisor that gives no more than ``seats`` in all
    is found by bisection, and the seats then left go one by one.
    """
    votes, caps = np.asarray(votes, float), np.where(np.asarray(votes, float) > 0, np.asarray(caps, np.int64), 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(np.minimum(votes / divisor, 2.0**62) + 0.5), caps).astype(np.int64)

    low, high = 0.0, 4 * votes.max()
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    # A vote exactly at a rounding edge has its seat already, as have its ties; take back none.
    waiting = [(-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if out[i] < caps[i]]
    heapq.heapify(waiting)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(waiting)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(waiting, (-votes[i] / (2 * out[i] + 1), i))
    return out


def targets(sizes: np.ndarray, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Words to take of each source: by weight, at most ``most`` times its size."""
    sizes = np.asarray(sizes, float)
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        left = share * sizes.sum() - out[~free].sum()
        out[free] = max(0.0, left) * w[free] / w[free].sum()
        over = free & (out > most * sizes)
        if not over.any():
            break
        out[over] = most * sizes[over]
        free &= ~over
    return out


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        text = batch.column(names.index("_text"))
        n = pa.array([len(t.as_py().encode().split()) if t.is_valid else 0 for t in text], pa.int64())
        yield pa.RecordBatch.from_arrays([n if c == "_size" else batch.column(c) for c in names], names)


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int) -> DataFrame:
    """One row a source: its size, target, whole passes and further blocks."""
    per = rows.groupBy("_src", "_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).toPandas()
    order = sorted(range(len(per)), key=lambda i: (per["_source"][i] is None, per["_source"][i] or ""))
    per = per.iloc[order].reset_index(drop=True)
    sizes = per["size"].to_numpy(np.int64)
    aim = targets(sizes, weights, share, most)
    quota = sainte_lague(aim, round(aim.sum() / block), -(-most * sizes // block))
    passes = np.minimum(most, np.where(sizes > 0, quota * block // np.maximum(sizes, 1), 0))
    rest = np.where(passes < most, np.rint((quota * block - passes * sizes) / block), 0).astype(np.int64)
    shards = np.maximum(1, np.maximum(-(-sizes // SHARD_WORDS), -(-per["n"].to_numpy(np.int64) // SHARD_ROWS)))
    table = pd.DataFrame({"_src": per["_src"], "_source_size": sizes, "_target": aim, "_passes": passes.astype(np.int64), "_rest": np.maximum(rest, 0), "_shards": shards, "_rows": per["n"].astype(np.int64)})
    return rows.sparkSession.createDataFrame(table, "_src string, _source_size bigint, _target double, _passes bigint, _rest bigint, _shards bigint, _rows bigint")


def _quotas(part: str, seats: str, out: str):
    """Apportions the blocks ``seats`` of a source or bundle to its parts by their words, at most ``_most`` each."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(part, ignore_index=True)
        parts[out] = sainte_lague(parts["_words"].to_numpy(np.int64), int(parts[seats].iloc[0]), parts["_most"].to_numpy(np.int64))
        return parts[["_src", part, out]]

    return run


def draw(sizes: np.ndarray, quota: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document that the drawn blocks hold, and which blocks were drawn."""
    total = int(sizes.sum())
    blocks = -(-total // block)
    chosen = np.zeros(blocks + 1, bool)
    chosen[np.random.default_rng(seed).permutation(blocks)[:quota]] = True
    before = np.concatenate([[0], np.cumsum(chosen)]) * block
    ends = np.cumsum(sizes)
    upto = lambda x: before[x // block] + (x % block) * chosen[x // block]
    return upto(ends) - upto(ends - sizes), chosen


def _taker(block: int, seed: int, columns: list[str], text: str | None):
    """Decisions for a shard's rows, or with ``text`` the mixed rows themselves."""

    def run(rows: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in columns})
        rows = rows.sort_values(["_key", "_size"], ignore_index=True)
        sizes = rows["_size"].to_numpy(np.int64)
        name = f"{seed}|{rows['_src'][0]}|{rows['_shard'][0]}"
        part, chosen = draw(sizes, int(quota["_quota"].iloc[0]) if len(quota) else 0, block, xxhash.xxh64_intdigest(name))
        passes = int(rows["_passes"][0])
        rows["_taken"] = passes * sizes + part
        if text is None:
            return rows[columns]
        out = [rows] * passes
        some = part > 0
        if some.any():
            starts = np.cumsum(sizes) - sizes
            piece = rows[some].copy()
            piece[text] = [" ".join(w.decode() for w, c in zip(t.encode().split(), chosen[np.arange(s, s + n) // block].tolist()) if c) for t, s, n in zip(piece[text], starts[some], sizes[some])]
            out.append(piece)
        return (pd.concat(out, ignore_index=True) if out else rows[:0])[columns]

    return run


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, carried: list[str], weights, share, most, block) -> tuple[DataFrame, DataFrame]:
    base = docs.select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(source_col).cast("string").alias("_source"),
        F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).alias("_key"), F.lit(0).cast("bigint").alias("_size"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)],
    )
    sized = base.transform(map_batches, _sized, base.schema).withColumn("_src", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")))
    small = cut(sized.select("_id", "_key", "_size", "_src", "_source"))
    plan = cut(_plan(small, weights, share, most, block))
    total = small.count()
    shard = lambda rows: join_by_group(rows, plan, "_src", "_rows", total).withColumn("_shard", F.pmod(F.xxhash64("_key"), F.col("_shards")))
    dealt = shard(small)
    words = cut(dealt.groupBy("_src", "_shard").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest")).withColumns({"_most": F.ceil(F.col("_words") / block), "_bundle": F.floor(F.col("_shard") / BUNDLE)}))
    bundles = words.groupBy("_src", "_bundle").agg(F.sum("_words").alias("_words"), F.sum("_most").alias("_most"), F.first("_rest").alias("_rest"))
    given = bundles.groupBy("_src").applyInPandas(_quotas("_bundle", "_rest", "_given"), "_src string, _bundle bigint, _given bigint")
    quotas = words.join(given, ["_src", "_bundle"]).groupBy("_src", "_bundle").applyInPandas(_quotas("_shard", "_given", "_quota"), "_src string, _shard bigint, _quota bigint")
    return (shard(sized) if carried else dealt), quotas


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken``.

    ``weights`` repeat over the sources by code point, null last.

    Defined results: null and empty texts have no words and none are taken;
    null and empty source names are sources of their own; documents with a
    null id are placed by their text; repeated rows are drawn as rows of their
    own; an empty table gives an empty result; further columns are not read.
    """
    dealt, quotas = _prepared(docs, id_col, text_col, source_col, [], weights, share, most, block)
    columns = ["_id", "_size", "_source_size", "_target", "_taken"]
    taken = dealt.groupBy("_src", "_shard").cogroup(quotas.groupBy("_src", "_shard")).applyInPandas(_taker(block, seed, columns, None), "_id bigint, _size bigint, _source_size bigint, _target double, _taken bigint")
    return taken.toDF("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever these are called.

    A document stands there once for each whole pass, and once more with the
    words of its drawn blocks, joined by spaces, if it has any.

    Defined results: as ``mix`` decides, so documents without words stand
    there as often as their source has whole passes; an empty table gives an
    empty result.
    """
    dealt, quotas = _prepared(docs, id_col, text_col, source_col, docs.columns, weights, share, most, block)
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(c, f.dataType, True) for c, f in zip(columns, docs.schema.fields)])
    rows = dealt.drop("_text", "_id", "_source")
    text = f"_c{docs.columns.index(text_col)}"
    mixed = rows.groupBy("_src", "_shard").cogroup(quotas.groupBy("_src", "_shard")).applyInPandas(_taker(block, seed, columns, text), schema)
    return mixed.toDF(*docs.columns)
