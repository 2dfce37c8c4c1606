"""Containers and what they hold, as rows with paths of ordinals.

``child_path`` sorts as depth-first preorder, so no recursion is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import views
from foliospark.functions.text import is_blank
from foliospark.schema import CONTAINERS, MAX_MEMBERS, MAX_RATIO, MAX_TOTAL_BYTES, SKIP_NAMES


def leaves(docs: DataFrame) -> DataFrame:
    """Documents that hold no others."""
    return docs.filter("n_children = 0")


def leaves_by_join(nodes: DataFrame, id_col: str = "doc_id", parent_col: str = "parent_id") -> DataFrame:
    """The same from bare parent links: an anti join."""
    parents = nodes.select(F.col(parent_col).alias("_parent")).filter("_parent IS NOT NULL").distinct()
    return nodes.join(parents, F.col(id_col) == F.col("_parent"), "left_anti")


def labelled(origin: Column, text: Column) -> Column:
    return F.when(F.coalesce(origin, F.lit("")) != "", F.concat(F.lit("--- "), origin, F.lit(" ---\n"), text)).otherwise(text)


def all_body_text(nodes: DataFrame, root: str = "root_id", path: str = "child_path", text: str = "body_text", origin: str = "origin") -> DataFrame:
    """``root, all_body_text``: the body texts of each tree in preorder, parts labelled with their origin.

    Partial lists are combined before the shuffle; what one root gathers is one tree.
    """
    part = F.when(~is_blank(F.col(text)), labelled(F.col(origin), F.col(text)))
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(F.col(path).alias("at"), part.alias("part")))))
    return nodes.groupBy(root).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("all_body_text"))


def union(docs: DataFrame) -> DataFrame:
    """One row a root with ``text`` and ``images`` of its whole tree.

    A root without children is itself: its own text, unlabelled.
    """
    own = docs.select("root_id", "child_path", "depth", "n_children", "kind", "name", "origin", "error", views.body_text(F.col("blocks")).alias("body_text"), views.images(F.col("blocks")).alias("images"))
    part = F.struct(F.col("child_path").alias("at"), F.when(~is_blank(F.col("body_text")), labelled(F.col("origin"), F.col("body_text"))).alias("part"), "images")
    top = lambda c: F.max(F.when(F.col("depth") == 0, F.col(c))).alias(c)
    tree = own.groupBy("root_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), *[top(c) for c in ("n_children", "kind", "name", "origin", "error", "body_text")])
    texts = F.transform(F.filter("parts", lambda x: x["part"].isNotNull()), lambda x: x["part"])
    # Places of images are renewed: a tree's images stand in preorder.
    flat = F.flatten(F.transform("parts", lambda x: x["images"]))
    images = F.transform(flat, lambda b, i: b.withField("pos", i.cast("int")))
    text = F.when(F.col("n_children") > 0, F.array_join(texts, "\n\n")).otherwise(F.col("body_text"))
    return tree.select(F.col("root_id").alias("doc_id"), "root_id", "name", "origin", "kind", "n_children", "error", text.alias("text"), images.alias("images"))


def with_blobs(images: DataFrame, docs: DataFrame) -> DataFrame:
    """Image rows (``doc_id, sha256``) with their bytes; only images asked for are read."""
    blobs = docs.select("doc_id", F.explode("blobs").alias("b")).select("doc_id", "b.sha256", "b.data")
    return images.join(blobs, ["doc_id", "sha256"])


def archive_caps(members: DataFrame, archive: str, order: list[str], size: str, packed: str, max_members: int = MAX_MEMBERS, max_total: int = MAX_TOTAL_BYTES, max_ratio: int = MAX_RATIO) -> DataFrame:
    """Members of archives with ``idx, status``: ``kept``, ``bomb`` or ``cut``.

    A bomb (declared size over ``max_ratio`` times its packed size) counts as a
    member but not towards the bytes. The first member over either cap and
    all after it are cut.
    """
    by = Window.partitionBy(archive).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    bomb = (F.col(packed) > 0) & (F.col(size) > max_ratio * F.col(packed))
    out = members.withColumn("idx", F.row_number().over(by)).withColumn("_bomb", bomb)
    total = F.sum(F.when(F.col("_bomb"), 0).otherwise(F.col(size)).cast("bigint")).over(upto)
    breach = (F.col("idx") > max_members) | (~F.col("_bomb") & (total > max_total))
    out = out.withColumn("_cut", F.max(breach).over(upto))
    return out.withColumn("status", F.when(F.col("_cut"), "cut").when(F.col("_bomb"), "bomb").otherwise("kept")).drop("_bomb", "_cut")


def opened_names(name: Column) -> Column:
    """Whether a member of an archive is a file to open."""
    leaf = F.regexp_extract(name, r"([^/]*)$", 1)
    return (leaf != "") & ~leaf.startswith(".") & ~F.lower(leaf).isin(*SKIP_NAMES)


def skipped_containers(kind: Column, n_blocks: Column) -> Column:
    """Containers without a block of their own, which ``prepare_all`` leaves out."""
    return kind.isin(*CONTAINERS) & (n_blocks == 0)
