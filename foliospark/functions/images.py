"""Pixel sizes and media types of image bytes as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schema as S


def _number(data: Column, at: int, n: int, little: bool = False) -> Column:
    """An unsigned number of ``n`` bytes from byte ``at``."""
    places = range(at + n - 1, at - 1, -1) if little else range(at, at + n)
    text = F.concat(*[F.hex(F.substring(data, p + 1, 1)) for p in places])
    return F.conv(text, 16, 10).cast("bigint")


def _signed(data: Column, at: int) -> Column:
    n = _number(data, at, 4, True)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


@F.pandas_udf(T.StructType().add("width", T.LongType()).add("height", T.LongType()))
def jpeg_size(data: pd.Series) -> pd.DataFrame:
    """Of JPEG bytes; null for anything else."""
    from foliospark.sources.probe import jpeg_size as walk

    found = [walk(bytes(d)) if d is not None and bytes(d[:2]) == b"\xff\xd8" else None for d in data]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int64"), "height": pd.array([f and f[1] for f in found], "Int64")})


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("bigint").alias("width"), height.cast("bigint").alias("height"))


def image_size(data: Column, jpeg: bool = False) -> Column:
    """``struct<width, height>``, null if unknown: PNG, GIF, BMP and WebP natively, JPEG in Python if asked."""
    long = lambda n: F.octet_length(data) >= n
    starts = lambda b: F.startswith(data, F.lit(b))
    chunk = F.substring(data, 13, 4)
    webp = starts(b"RIFF") & (F.substring(data, 9, 4) == F.lit(b"WEBP"))
    low = lambda at, n: F.coalesce(_number(data, at, n, True), F.lit(0))  # noqa: E731  bytes that are missing count as zero
    bits = low(21, 4)
    out = (
        F.when(starts(b"\x89PNG\r\n\x1a\n") & (chunk == F.lit(b"IHDR")) & long(24), _size(_number(data, 16, 4), _number(data, 20, 4)))
        .when((starts(b"GIF87a") | starts(b"GIF89a")) & long(10), _size(_number(data, 6, 2, True), _number(data, 8, 2, True)))
        .when(starts(b"BM") & long(26), _size(F.abs(_signed(data, 18)), F.abs(_signed(data, 22))))
        .when(webp & (chunk == F.lit(b"VP8X")), _size(low(24, 3) + 1, low(27, 3) + 1))
        .when(webp & (chunk == F.lit(b"VP8 ")) & long(30), _size(_number(data, 26, 2, True).bitwiseAND(F.lit(0x3FFF)), _number(data, 28, 2, True).bitwiseAND(F.lit(0x3FFF))))
        .when(webp & (chunk == F.lit(b"VP8L")), _size(bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1))
    )
    walked = jpeg_size(F.when(starts(b"\xff\xd8"), data))
    return F.coalesce(out, F.when(walked["width"].isNotNull(), walked)) if jpeg else out


def pixels(width: Column, height: Column) -> Column:
    """Null if a side is unknown or zero."""
    return F.when((width != 0) & (height != 0), width.cast("bigint") * height.cast("bigint"))


def file_suffix(mime: Column) -> Column:
    from foliospark.functions.detect import _mapped

    return _mapped(mime, S.MIME_SUFFIX, F.lit(".bin"))
