"""Exact deduplication by skew-safe combining, with native operations only.

Every text is normalised (ASCII white space deleted) and digested, and all
rows are grouped by digest *and* whole normalised text, so that full content
is compared at every stage:

1. locally: the partial aggregation removes the copies within a partition;
2. salted: what partitions left is merged by digest, salt and text. A digest
   with a large share of all rows (512 at most can have it) is dealt to many
   salts by partition, any other has one salt and is finished here;
3. globally: the winners of a hot digest's salts are combined.

Texts are shuffled once, after local combining. Rows then find their group by
digest: where all contents of a digest proved equal, every row was compared
with them. Where a digest has several contents (a collision), rows find
their group by digest and text.

Defined results: null text counts as empty; of equal texts the row with the
most code points in the original text stays, then the smallest id, null ids
last; of rows that repeat an id and a text one stays; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import HOT_SHARE, cut, free_name, join_by_group, one_of_each, unbroken, whole_order

#: Ranks are decimals: code points * 2**65 + (2**63 - id), or + 0 for a null id.
_STEP, _TOP = Decimal(1 << 65), Decimal(1 << 63)


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rank(n: Column, doc: Column) -> Column:
    place = F.coalesce((F.lit(_TOP) - doc.cast("decimal(19,0)")).cast("decimal(20,0)"), F.lit(Decimal(0)).cast("decimal(20,0)"))
    return (n.cast("decimal(10,0)") * F.lit(_STEP) + place).cast("decimal(38,0)")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of, salts: int = 16) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``digest`` makes the grouping digest; ``text_sha256`` is SHA-256 always.
    """
    norm = unbroken(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), norm.alias("_norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"))
    texts = rows.withColumn("_digest", digest(F.col("_norm")))
    sha = F.col("_digest") if digest is sha256_of else sha256_of(F.col("_norm"))
    ids = cut(texts.select("doc_id", "_n", "_digest", sha.alias("text_sha256")))
    total = ids.count()
    hot = ids.groupBy("_digest").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > max(1.0, total * HOT_SHARE)).select("_digest", F.lit(True).alias("_hot"))

    dealt = texts.join(F.broadcast(hot), "_digest", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(salts)) + 1).otherwise(0)
    best = F.max(_rank(F.col("_n"), F.col("doc_id"))).alias("_best")
    salted = dealt.withColumn("_salt", salt).groupBy("_digest", "_salt", "_norm").agg(best, F.count("*").alias("_size"))
    salted = cut(salted.withColumn("_norm", F.when(F.col("_salt") > 0, F.col("_norm"))))
    winners = salted.filter("_salt > 0").groupBy("_digest", "_norm").agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"))
    groups = salted.filter("_salt = 0").select("_digest", "_best", "_size").unionByName(winners.select("_digest", "_best", "_size"))
    by_digest = groups.groupBy("_digest").agg(F.count("*").alias("_contents"), F.sum("_size").alias("_rows"), F.max("_best").alias("_best"))
    by_digest = cut(by_digest)

    clean = by_digest.filter("_contents = 1").select("_digest", "_rows", *_unranked(), F.col("_rows").alias("group_size"))
    found = join_by_group(ids, clean, "_digest", "_rows", total)
    wins = ((F.col("_n") == F.col("_best_n")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("_wins")
    out = ["doc_id", "keep_id", "group_size", wins, "text_sha256"]
    found = found.select(*out)
    collided = by_digest.filter("_contents > 1").select("_digest")
    if collided.head(1):
        mixed = texts.withColumn("text_sha256", sha).join(collided, "_digest", "left_semi")
        each = mixed.groupBy("_digest", "_norm").agg(best, F.count("*").alias("group_size")).select("_digest", "_norm", *_unranked(), "group_size")
        found = found.unionByName(mixed.join(each, ["_digest", "_norm"]).select(*out))
    return _one_winner(found)


def _unranked() -> list[Column]:
    """The winner's code points and id, from its rank."""
    n = F.floor((F.col("_best") / F.lit(_STEP)).cast("decimal(38,10)")).cast("int")
    low = (F.col("_best") - (n.cast("decimal(10,0)") * F.lit(_STEP)).cast("decimal(38,0)")).cast("decimal(20,0)")
    return [n.alias("_best_n"), F.when(low > 0, (F.lit(_TOP) - low).cast("bigint")).alias("keep_id")]


def _one_winner(found: DataFrame) -> DataFrame:
    """Of rows that repeat the winner's id and text, one is kept.

    They are numbered in two steps, within their partition and then the
    partitions' firsts, so that a row which repeats without end fills no task.
    """
    wins, repeats = F.col("_wins"), F.col("_wins") & (F.col("group_size") > 1)
    same = ["text_sha256", "keep_id"]
    nth = lambda *by: F.row_number().over(Window.partitionBy(*same, *by).orderBy("group_size"))
    local = found.filter(repeats).withColumn("_part", F.spark_partition_id()).withColumn("_nth", nth("_part")).drop("_part")
    # Partitions' firsts meet by their own number, all others stay where they are.
    numbered = local.withColumn("_turn", F.when(F.col("_nth") > 1, F.monotonically_increasing_id() + 1).otherwise(0))
    again = numbered.withColumn("kept", (nth("_turn") == 1) & (F.col("_turn") == 0)).drop("_nth", "_turn")
    return found.filter(~repeats).withColumn("kept", wins).unionByName(again).drop("_wins")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    The rows to drop are found by (id, digest) in an anti join, a key that the
    rows of a group do not share. Of rows that repeat their group's winner the
    longest text stays, then the first by all columns.
    """
    spent = cut(decisions(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("gone"), F.col("text_sha256").alias("sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")).distinct())
    key = free_name(docs, "_key")
    # One column of the rows, and one of what is joined: a struct each, so no names can clash.
    marked = docs.withColumn(key, F.struct(F.col(id_col).cast("bigint").alias("id"), sha256_of(unbroken(text_col)).alias("sha")))
    keys = lambda rows: rows.select(F.struct(F.col("gone").alias("id"), F.col("sha")).alias(key + "_gone"))
    same = (F.col(key)["sha"] == F.col(key + "_gone")["sha"]) & F.col(key)["id"].eqNullSafe(F.col(key + "_gone")["id"])
    kept = marked.join(keys(spent.filter("NOT again")), same, "left_anti")
    again = spent.filter("again")
    if again.head(1):
        order = [F.char_length(F.col(text_col)).desc_nulls_last(), *whole_order(docs)]
        kept = kept.join(keys(again), same, "left_anti").unionByName(one_of_each(kept.join(keys(again), same, "left_semi"), [F.col(key)], order))
    return kept.drop(key)
