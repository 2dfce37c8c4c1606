"""Images out of documents, as rows or as files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foliospark.functions.images import file_suffix


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def image_files(prepared: DataFrame) -> DataFrame:
    """``path, data`` of kept images: ``{document}/{nnn}-{image}{suffix}``."""
    kept = prepared.select("root_id", "name", "blobs", F.posexplode("kept").alias("i", "img"))
    data = F.get(F.filter("blobs", lambda b: b["sha256"] == F.col("img.sha256")), F.lit(0))["data"]
    path = F.concat(stem(F.col("root_id")), F.lit("/"), stem(F.col("name")), F.lit("/"), F.lpad(F.col("i").cast("string"), 3, "0"), F.lit("-"), stem(F.col("img.name")), file_suffix(F.col("img.mime")))
    return kept.select(path.alias("path"), data.alias("data"))


def document_images(docs: DataFrame) -> DataFrame:
    """``path, data`` of all images of documents: ``{stem}-{nnn}{suffix}``."""
    own = docs.select("doc_id", "name", "blobs", F.posexplode(F.filter("blocks", lambda b: b["is_image"])).alias("i", "img"))
    data = F.get(F.filter("blobs", lambda b: b["sha256"] == F.col("img.sha256")), F.lit(0))["data"]
    return own.select(F.concat(stem(F.col("name")), F.lit("-"), F.lpad(F.col("i").cast("string"), 3, "0"), file_suffix(F.col("img.mime"))).alias("path"), data.alias("data"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row's bytes under ``folder``, by the executors; the folder is one that all of them see."""

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            safe = [re.sub(r"[\x00-\x1f]", "", p) for p in row["path"].split("/") if p not in ("", ".", "..")]
            target = os.path.join(folder, *safe)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as out:
                out.write(row["data"])

    files.foreachPartition(write)
