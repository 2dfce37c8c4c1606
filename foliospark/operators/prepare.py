"""From documents to what would be sent: kept images, text, strategy and notes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from foliospark.functions import views
from foliospark.functions.detect import family_of
from foliospark.operators import strategy as st
from foliospark.operators import tree
from foliospark.operators.filters import DEFAULT, ImageFilter, partition_images
from foliospark.schema import BLOCK, MIN_TEXT_CHARS, RENDER_DPI

WARNING = "WARNING: this document needs vision but has no sendable image; treat it as unverifiable rather than as a clean result"
CONTAINER_NOTE = "containers are not rendered; use prepare_all() to handle each member on its own"
OFF_NOTE = "no sendable image and render_fallback is off"


def decided(rows: DataFrame, n_images: Column, n_kept: Column, n_rejected: Column, min_text_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Adds ``threshold, strategy, notes`` to rows with ``kind, text``, from numbers of images alone."""
    text, kind = F.col("text"), F.col("kind")
    out = rows.withColumn("threshold", st.threshold_for(family_of(kind), min_text_chars))
    out = out.withColumn("strategy", st.decide(text, F.col("threshold"), n_images, n_kept, kind))
    return out.withColumn("notes", F.array(st.explain(F.col("strategy"), text, F.col("threshold"), n_kept, n_rejected)))


def judged(rows: DataFrame, image_filter: ImageFilter = DEFAULT, min_text_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Adds ``kept, rejected, threshold, strategy, notes`` to rows with ``kind, text, images``.

    Where many rows share a set of images, ``apply_filter`` judges each set
    once, and ``decided`` takes the numbers.
    """
    out = rows.withColumn("_p", partition_images(F.col("images"), image_filter)).withColumns({"kept": F.col("_p.kept"), "rejected": F.col("_p.rejected")}).drop("_p")
    return decided(out, F.size("images"), F.size("kept"), F.size("rejected"), min_text_chars)


def _rendered(rows: DataFrame, files: DataFrame, dpi: int, max_pages: int | None) -> DataFrame:
    """Adds ``pages, page_blobs, render_error`` to rows that want their pages as images."""
    schema = f"doc_id string, pages array<{BLOCK}>, page_blobs array<struct<sha256:string,data:binary>>, render_error string"

    arrow = to_arrow_schema(DataType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from foliospark.sources.draft import Draft, Options
        from foliospark.sources.readers.optional import render_pages
        from foliospark.sources.readers.pictures import read_image

        for batch in batches:
            for row in range(batch.num_rows):
                doc = batch.slice(row, 1).to_pylist()[0]
                draft, error = Draft(doc["name"], doc["kind"]), None
                try:
                    if doc["content"] is None:
                        raise FileNotFoundError(f"the bytes of {doc['name']} are not at hand")
                    if doc["kind"] == "image":
                        draft = read_image(doc["content"], doc["name"], Options(), 0)
                    else:
                        for p in render_pages(doc["content"], doc["name"], doc["kind"], dpi, max_pages):
                            draft.add_picture(p)
                except Exception as e:
                    error = str(e)
                pages = [{"pos": i, **b} for i, b in enumerate(draft.blocks)]
                yield pa.RecordBatch.from_pylist([{"doc_id": doc["doc_id"], "pages": pages, "page_blobs": [{"sha256": k, "data": v} for k, v in draft.blobs.items()], "render_error": error}], arrow)

    wanted = rows.select("doc_id", "root_id", "name", "kind").join(files.select(F.col("path").alias("root_id"), "content"), "root_id", "left")
    content = F.when(F.col("doc_id") == F.col("root_id"), F.col("content"))
    return wanted.select("doc_id", "name", "kind", content.alias("content")).mapInArrow(run, schema)


def finish(rows: DataFrame, files: DataFrame | None = None, render_fallback: bool = True, render_dpi: int = RENDER_DPI, max_pages: int | None = None, n_kept: Column | None = None) -> DataFrame:
    """Adds ``rendered``, and to ``notes`` what follows where no image can be sent.

    Pages are rendered only for rows that want them and only if ``files``
    (``path, content``) gives their bytes; a failure becomes a note. Rows
    without ``kept`` say by ``n_kept`` how many images are; they get no pages.
    """
    if render_fallback and n_kept is not None:
        raise ValueError("pages are rendered in place of the images in kept")
    n_kept = F.size("kept") if n_kept is None else n_kept
    wants = (n_kept == 0) & (F.col("strategy") != "text_only")
    inside = F.col("n_children") > 0
    add = lambda c: F.concat("notes", F.array(c))
    if render_fallback:
        want = rows.filter(wants & ~inside)
        if files is None:
            pages = want.select("doc_id", F.lit(None).cast(f"array<{BLOCK}>").alias("pages"), F.lit(None).cast("array<struct<sha256:string,data:binary>>").alias("page_blobs"), F.lit("no file bytes were given").alias("render_error"))
        else:
            pages = _rendered(want, files, render_dpi, max_pages)
        out = rows.join(pages, "doc_id", "left")
        ok = wants & ~inside & F.col("render_error").isNull() & F.col("pages").isNotNull()
        note = F.when(ok, F.concat(F.lit("fell back to "), F.size("pages").cast("string"), F.lit(f" page render(s) at {render_dpi} dpi"))).when(~inside, F.concat(F.lit("page rendering unavailable: "), F.col("render_error"))).otherwise(CONTAINER_NOTE)
        out = out.withColumn("notes", F.when(wants, add(note)).otherwise(F.col("notes")))
        # All three read the strategy and the kept images as they were.
        out = out.withColumns({"rendered": F.coalesce(ok, F.lit(False)), "kept": F.when(ok, F.col("pages")).otherwise(F.col("kept")), "strategy": F.when(ok, F.when(F.col("text") != "", "hybrid").otherwise("image_only")).otherwise(F.col("strategy"))}).drop("pages", "render_error")
    else:
        out = rows.withColumn("notes", F.when(wants, add(F.when(inside, CONTAINER_NOTE).otherwise(OFF_NOTE))).otherwise(F.col("notes"))).withColumn("rendered", F.lit(False))
    blind = st.needs_vision(F.col("strategy")) & (n_kept == 0)
    out = out.withColumn("notes", F.when(blind, add(F.lit(WARNING))).otherwise(F.col("notes")))
    return out.withColumn("needs_vision", st.needs_vision(F.col("strategy")))


def prepare(docs: DataFrame, files: DataFrame | None = None, image_filter: ImageFilter = DEFAULT, min_text_chars: int = MIN_TEXT_CHARS, render_fallback: bool = True, render_dpi: int = RENDER_DPI, max_pages: int | None = None) -> DataFrame:
    """One row a root; a container is taken as a whole."""
    return finish(judged(tree.union(docs), image_filter, min_text_chars), files, render_fallback, render_dpi, max_pages)


def prepare_all(docs: DataFrame, files: DataFrame | None = None, image_filter: ImageFilter = DEFAULT, min_text_chars: int = MIN_TEXT_CHARS, render_fallback: bool = True, render_dpi: int = RENDER_DPI, max_pages: int | None = None) -> DataFrame:
    """One row a leaf; empty containers are left out. Nothing is shuffled but what rendering needs."""
    own = tree.leaves(docs).filter(~tree.skipped_containers(F.col("kind"), F.size("blocks")))
    rows = own.select("doc_id", "root_id", F.coalesce(F.nullif(F.col("origin"), F.lit("")), "name").alias("name"), "origin", "kind", "n_children", "error", views.body_text(F.col("blocks")).alias("text"), views.images(F.col("blocks")).alias("images"), "blobs")
    return finish(judged(rows, image_filter, min_text_chars), files, render_fallback, render_dpi, max_pages)


def summary(prepared: DataFrame) -> DataFrame:
    """Adds one line a row on what would be sent."""
    pages = F.when(F.col("rendered"), " (page renders)").otherwise("")
    return prepared.withColumn("summary", F.concat("name", F.lit(" ["), "kind", F.lit("]: "), "strategy", F.lit(", "), F.size("kept").cast("string"), F.lit(" image(s)"), pages, F.lit(", "), F.length("text").cast("string"), F.lit(" text chars")))
