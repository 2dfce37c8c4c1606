"""A report on prepared documents, as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_META = ("author", "subject", "created", "modified", "page_count", "sheet_names", "slide_count", "attachment_count", "member_count")


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label:<13}"), value)


def _padded(c: Column, n: int) -> Column:
    return F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)


def report(prepared: DataFrame, docs: DataFrame, text: bool = False) -> DataFrame:
    """``doc_id, n, line``: what is said of each prepared document, in order."""
    more = docs.select("doc_id", F.col("name").alias("_file"), "meta", "sheet_names", "warnings", F.size("tables").alias("n_tables"))
    rows = prepared.join(more, "doc_id")
    s = lambda c: c.cast("string")
    size = lambda i: F.when(F.coalesce(i["width"], F.lit(0)) > 0, F.concat(s(i["width"]), F.lit("x"), s(i["height"]))).otherwise("?x?")
    kept = F.transform("kept", lambda i: F.concat(F.lit("  + "), _padded(i["name"], 20), F.lit(" "), _padded(i["mime"], 14), F.lit(" "), F.lpad(size(i), 11, " "), F.lit(" "), F.lpad(F.format_string("%.1f", i["nbytes"] / 1024), 8, " "), F.lit(" KB  "), i["source"], F.when(i["referenced"], "").otherwise(" [unreferenced]"), F.coalesce(F.concat(F.lit(" "), i["section"]), F.lit(""))))
    gone = F.transform("rejected", lambda r: F.concat(F.lit("  - "), _padded(r["image"]["name"], 20), F.lit(" "), r["reason"]))
    meta = [F.when(F.col("sheet_names").isNotNull(), _line(k, F.array_join("sheet_names", ", "))) if k == "sheet_names" else _line(k, F.get_json_object(F.to_json("meta"), f"$.{k}")) for k in _META]
    head = [
        F.when(F.col("name") != F.col("_file"), _line("member", F.col("name"))), _line("kind", F.col("kind")), _line("strategy", F.col("strategy")), _line("text", F.concat(s(F.length("text")), F.lit(" chars"))),
        _line("tables", s(F.col("n_tables"))), _line("images", F.concat(s(F.size("kept")), F.lit(" kept, "), s(F.size("rejected")), F.lit(" filtered"))),
    ]
    tail = [F.transform("notes", lambda x: _line("note", x)), F.transform("warnings", lambda x: _line("warning", x))]
    if text:
        tail.append(F.when(F.col("text") != "", F.concat(F.array(F.lit("--- text ---")), F.split("text", "\n"))).otherwise(F.array().cast("array<string>")))
    lines = F.concat(F.array_compact(F.array(*head)), kept, gone, F.array_compact(F.array(*meta)), *tail)
    return rows.select("doc_id", F.posexplode(lines).alias("n", "line"))


def counts(prepared: DataFrame) -> DataFrame:
    """Documents by kind and strategy."""
    return prepared.groupBy("kind", "strategy").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
