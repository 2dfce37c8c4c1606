"""The public names in one place."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from foliospark.errors import ConversionFailed, CorruptDocument, EvidenceError, MissingDependency, UnsupportedFormat
from foliospark.functions.detect import can_render, detect, sniff_mime, supported_kinds, unreadable_reason, with_kind
from foliospark.functions.json import object_in, parse_reply
from foliospark.functions.views import body_text, images, interleaved, lookup, pairs, text, with_views
from foliospark.operators.filters import DEFAULT, KEEP_ALL, STRICT, ImageFilter, apply_filter, partition_images
from foliospark.operators.model_call import build_prompt, field, read
from foliospark.operators.payload import data_url, image_part, normalized, text_part, to_content, with_sendable_images
from foliospark.operators.prepare import prepare, prepare_all, summary
from foliospark.operators.strategy import decide, explain, needs_vision, threshold_for
from foliospark.operators.tree import all_body_text, leaves
from foliospark.sources.extract import binary_files, extract, text_documents
from foliospark.sources.readers import register

__all__ = [
    "DEFAULT", "KEEP_ALL", "STRICT", "ConversionFailed", "CorruptDocument", "EvidenceError", "ImageFilter", "MissingDependency", "UnsupportedFormat", "all_body_text", "apply_filter", "binary_files", "body_text", "build_prompt",
    "can_render", "data_url", "decide", "detect", "explain", "extract", "field", "image_part", "images", "interleaved", "leaves", "lookup", "needs_vision", "normalized", "object_in", "pairs", "parse_reply", "partition_images",
    "prepare", "prepare_all", "read", "read_all", "read_files", "register", "sniff_mime", "summary", "supported_kinds", "text", "text_documents", "text_part", "threshold_for", "to_content", "unreadable_reason", "with_kind",
    "with_sendable_images", "with_views",
]


def _asked(files: DataFrame, whole: bool, image_filter: ImageFilter, fields: dict[str, str] | None, prompt: str | None, call: dict[str, Any]) -> DataFrame:
    docs = extract(files)
    if whole:
        # A tree's images are its root's: their bytes come together by root.
        ready = prepare(docs, files, image_filter)
        blobs = docs.selectExpr("root_id", "explode(blobs) AS b").groupBy("root_id").agg({"b": "collect_set"}).toDF("_root", "blobs")
        ready = ready.join(blobs, ready["root_id"] == blobs["_root"], "left").drop("_root")
    else:
        ready = prepare_all(docs, files, image_filter)
    if "page_blobs" in ready.columns:
        ready = ready.selectExpr("* EXCEPT (blobs, page_blobs)", "concat(coalesce(blobs, array()), coalesce(page_blobs, array())) AS blobs")
    return read(with_sendable_images(ready), fields, prompt, **call)


def read_files(files: DataFrame, fields: dict[str, str] | None = None, prompt: str | None = None, image_filter: ImageFilter = DEFAULT, **call: Any) -> DataFrame:
    """One reading a file; a container is read as a whole."""
    return _asked(files, True, image_filter, fields, prompt, call)


def read_all(files: DataFrame, fields: dict[str, str] | None = None, prompt: str | None = None, image_filter: ImageFilter = DEFAULT, **call: Any) -> DataFrame:
    """One reading a leaf."""
    return _asked(files, False, image_filter, fields, prompt, call)
