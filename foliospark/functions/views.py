"""Computed columns of documents: text layers, tables, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import schema as S
from foliospark.functions.detect import family_of
from foliospark.functions.text import is_blank, label_key, stripped


def _joined(blocks: Column, keep) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: ~b["is_image"] & keep(b)), lambda b: b["text"])
    return F.array_join(F.filter(texts, lambda t: ~is_blank(t)), "\n")


def text(blocks: Column) -> Column:
    """All texts in list order, blank ones left out."""
    return _joined(blocks, lambda b: F.lit(True))


def body_text(blocks: Column) -> Column:
    """The text without page headers and footers."""
    return _joined(blocks, lambda b: ~b["role"].isin(*S.BOILERPLATE_ROLES))


def images(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["is_image"])


def interleaved(blocks: Column) -> Column:
    """Blocks in reading order; equal places as listed."""
    return F.transform(F.array_sort(F.transform(blocks, lambda b: F.struct(b["ord"].alias("ord"), b["pos"].alias("pos"), b.alias("block")))), lambda x: x["block"])


def piped_rows(rows: Column) -> Column:
    """Table rows as lines, cells parted by bars."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | ")), "\n")


def cells(rows: Column) -> Column:
    return F.flatten(rows)


def pairs(rows: Column) -> Column:
    """Label and value of rows with exactly two cells."""
    return F.transform(F.filter(rows, lambda r: F.size(r) == 2), lambda r: F.struct(stripped(r[0]).alias("label"), stripped(r[1]).alias("value")))


def lookup(rows: Column, label: Column | str, default: str = "") -> Column:
    """The value beside the first label that reads alike."""
    key = label_key(F.lit(label) if isinstance(label, str) else label)
    found = F.filter(rows, lambda r: (F.size(r) >= 2) & (label_key(F.get(r, F.lit(0))) == key))
    return F.coalesce(stripped(F.get(F.get(found, F.lit(0)), F.lit(1))), F.lit(default))


def summary(name: Column, kind: Column, strategy: Column, blocks: Column, n_children: Column) -> Column:
    """One line on a document: ``name [kind] strategy=.. text=..ch images=n (WxH, ..) +k attached``."""
    own = images(blocks)
    sizes = F.transform(F.slice(own, 1, 6), lambda b: F.when(b["width"].isNull(), "?").otherwise(F.concat_ws("x", b["width"].cast("string"), b["height"].cast("string"))))
    return F.concat(
        name, F.lit(" ["), kind, F.lit("] strategy="), strategy, F.lit(" text="), F.length(text(blocks)).cast("string"), F.lit("ch images="), F.size(own).cast("string"),
        F.when(F.size(own) > 0, F.concat(F.lit(" ("), F.array_join(sizes, ", "), F.lit(")"))).otherwise(""),
        F.when(n_children > 0, F.concat(F.lit(" +"), n_children.cast("string"), F.lit(" attached"))).otherwise(""),
    )


def with_views(docs: DataFrame) -> DataFrame:
    """Adds ``family, text, body_text``."""
    return docs.withColumns({"family": family_of(F.col("kind")), "text": text(F.col("blocks")), "body_text": body_text(F.col("blocks"))})
