"""Which images are worth a look: thresholds, duplicates, ranking and a cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.images import pixels
from foliospark.schema import VECTOR_MIMES


@dataclass(frozen=True)
class ImageFilter:
    """Thresholds for keeping an image. Sizes below them are logos and seals."""

    min_width: int = 200
    min_height: int = 200
    min_bytes: int = 15_000
    min_pixels: int = 90_000
    max_images: int | None = None
    drop_duplicates: bool = True
    drop_vector: bool = False
    keep_unsized: bool = True

    def reason(self, img: Column) -> Column:
        """``ok``, or why the first test that fails rejects the image (or that its size is unknown)."""
        text = lambda c: c.cast("string")
        w, h, n = img["width"], img["height"], img["nbytes"]
        area = w.cast("bigint") * h.cast("bigint")
        vector = F.lit(self.drop_vector) & F.coalesce(img["mime"].isin(*VECTOR_MIMES), F.lit(False))
        return (
            F.when(vector, F.concat(F.lit("vector format "), img["mime"]))
            .when(n < self.min_bytes, F.concat(text(n), F.lit(f"B under min_bytes={self.min_bytes}")))
            .when(w.isNull() | h.isNull(), "dimensions unknown")
            .when((w < self.min_width) | (h < self.min_height), F.concat(text(w), F.lit("x"), text(h), F.lit(" under minimum")))
            .when(area < self.min_pixels, F.concat(text(area), F.lit("px under min_pixels")))
            .otherwise("ok")
        )

    def accepts(self, reason: Column) -> Column:
        return reason.isin("ok", "dimensions unknown") if self.keep_unsized else reason == "ok"


DEFAULT = ImageFilter()
#: Everything stays, duplicates too.
KEEP_ALL = ImageFilter(min_width=0, min_height=0, min_bytes=0, min_pixels=0, drop_duplicates=False)
#: Only large scans.
STRICT = ImageFilter(min_width=600, min_height=600, min_bytes=60_000, min_pixels=500_000)

_DUPLICATE = "duplicate of an earlier image"


def apply_filter(images: DataFrame, flt: ImageFilter = DEFAULT, key: str | list[str] = "doc_id", pos: str = "pos") -> DataFrame:
    """Image rows with ``status, reason, rank``.

    ``images`` has ``key, pos, ord, mime, width, height, nbytes, sha256``.
    ``rank`` counts kept images from the largest; rejected ones have none. One
    shuffle by ``key`` serves both windows.
    """
    keys = [key] if isinstance(key, str) else key
    row = F.struct("mime", "width", "height", "nbytes")
    out = images.withColumn("reason", flt.reason(row)).withColumn("_ok", flt.accepts(F.col("reason")))
    if flt.drop_duplicates:
        # Rejected rows are partitions of their own, so the first of the accepted is the first there.
        nth = F.row_number().over(Window.partitionBy(*keys, "_ok", F.when(F.col("_ok"), F.col("sha256"))).orderBy(pos))
        out = out.withColumn("_again", F.col("_ok") & (nth > 1))
        out = out.withColumn("reason", F.when(F.col("_again"), _DUPLICATE).otherwise(F.col("reason"))).withColumn("_ok", F.col("_ok") & ~F.col("_again")).drop("_again")
    order = [F.coalesce(pixels(F.col("width"), F.col("height")), F.lit(0)).desc(), F.col("nbytes").desc(), F.col("ord"), F.col(pos)]
    out = out.withColumn("rank", F.when(F.col("_ok"), F.row_number().over(Window.partitionBy(*keys, "_ok").orderBy(*order))))
    if flt.max_images is not None:
        over = F.col("_ok") & (F.col("rank") > flt.max_images)
        out = out.withColumn("reason", F.when(over, f"beyond max_images={flt.max_images}").otherwise(F.col("reason"))).withColumn("_ok", F.col("_ok") & ~over)
    return out.withColumn("status", F.when(F.col("_ok"), "kept").otherwise("rejected")).withColumn("rank", F.when(F.col("_ok"), F.col("rank"))).drop("_ok")


def partition_images(images: Column, flt: ImageFilter = DEFAULT) -> Column:
    """``struct<kept, rejected>`` of one document's image array, without a shuffle.

    The same partition as ``apply_filter``: kept images from the largest,
    rejected ones as met, those over the cap after them, by rank.
    """
    judged = F.transform(images, lambda b: F.struct(b.alias("image"), flt.reason(b).alias("reason")))
    refused = F.filter(judged, lambda x: ~flt.accepts(x["reason"]))
    passed = F.filter(judged, lambda x: flt.accepts(x["reason"]))
    if flt.drop_duplicates:
        hashes = F.transform(passed, lambda x: x["image"]["sha256"])
        first = lambda x, i: F.array_position(hashes, x["image"]["sha256"]) == i + 1
        again = F.filter(passed, lambda x, i: ~first(x, i))
        again = F.transform(again, lambda x: F.struct(x["image"].alias("image"), F.lit(_DUPLICATE).alias("reason")))
        passed = F.filter(passed, first)
        refused = F.array_sort(F.transform(F.concat(refused, again), lambda x: F.struct(x["image"]["pos"].alias("pos"), x["image"].alias("image"), x["reason"].alias("reason"))))
        refused = F.transform(refused, lambda x: F.struct(x["image"].alias("image"), x["reason"].alias("reason")))
    area = lambda b: F.coalesce(pixels(b["width"], b["height"]), F.lit(0))
    ranked = F.array_sort(F.transform(passed, lambda x: F.struct((-area(x["image"])).alias("a"), (-x["image"]["nbytes"]).alias("n"), x["image"]["ord"].alias("o"), x["image"]["pos"].alias("p"), x["image"].alias("image"))))
    kept = F.transform(ranked, lambda x: x["image"])
    if flt.max_images is not None:
        over = F.transform(F.slice(kept, flt.max_images + 1, F.greatest(F.size(kept), F.lit(1))), lambda b: F.struct(b.alias("image"), F.lit(f"beyond max_images={flt.max_images}").alias("reason")))
        kept, refused = F.slice(kept, 1, flt.max_images), F.concat(refused, over)
    return F.struct(kept.alias("kept"), refused.alias("rejected"))
