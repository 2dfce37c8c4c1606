"""Parts of packages as relations: relationship targets, unused media, cells and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.schema import MAX_COLS, MAX_ROWS


def resolved(references: DataFrame, relations: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """References with ``target`` and ``status``: ``ok``, ``no target`` or ``not inside``.

    ``references`` has ``key, rid``, ``relations`` ``key, rid, target`` and
    ``parts`` the package's names as ``key[0], name``.
    """
    found = references.join(relations, [*key, "rid"], "left")
    held = parts.select(key[0], F.col("name").alias("target"), F.lit(True).alias("_held"))
    out = found.join(held, [key[0], "target"], "left")
    return out.withColumn("status", F.when(F.col("target").isNull(), "no target").when(F.col("_held"), "ok").otherwise("not inside")).drop("_held")


def unused_media(media: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Media that no reference reached and that are not empty."""
    return media.filter("nbytes > 0").join(used.select(key, F.col("target").alias("name")).distinct(), [key, "name"], "left_anti")


def cell_text(cells: DataFrame, strings: DataFrame, key: str) -> DataFrame:
    """Cells (``key, t, v``) with ``text``; ``strings`` has ``key, idx, s``."""
    shared = cells.withColumn("idx", F.when((F.col("t") == "s") & F.col("v").rlike(r"^\s*\d+\s*$"), F.expr("try_cast(trim(v) AS int)")))
    out = shared.join(strings, [key, "idx"], "left")
    text = F.when(F.col("v").isNull(), "").when(F.col("t") == "s", F.coalesce("s", F.lit(""))).when(F.col("t") == "b", F.when(F.col("v") == "1", "TRUE").otherwise("FALSE")).otherwise(F.col("v"))
    return out.withColumn("text", text).drop("idx", "s")


def sheet_rows(cells: DataFrame, sheet: str, row: list[str], col: list[str], text: str = "text", max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> DataFrame:
    """``sheet, row_no, cells`` of the rows that stay: capped, without empty ends and empty rows.

    Rows are numbered before empty ones go, so these count for the cap.
    """
    numbered = cells.withColumn("row_no", F.dense_rank().over(Window.partitionBy(sheet).orderBy(*row))).filter(F.col("row_no") <= max_rows)
    placed = numbered.withColumn("_col", F.row_number().over(Window.partitionBy(sheet, "row_no").orderBy(*col))).filter(F.col("_col") <= max_cols)
    rows = placed.groupBy(sheet, "row_no").agg(F.array_sort(F.collect_list(F.struct("_col", F.col(text).alias("text")))).alias("c"))
    last = F.coalesce(F.array_max(F.transform(F.filter("c", lambda x: x["text"] != ""), lambda x: x["_col"])), F.lit(0))
    return rows.withColumn("_last", last).filter("_last > 0").select(sheet, "row_no", F.transform(F.slice("c", 1, F.col("_last")), lambda x: x["text"]).alias("cells"))


def capped(items: DataFrame, key: str, order: list[Column | str], most: int | None) -> DataFrame:
    """The first ``most`` items of each key: pages, slides or sheets."""
    if most is None:
        return items
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
