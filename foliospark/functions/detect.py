"""Kinds of files as Column expressions over ``content`` and ``name``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schema as S
from foliospark.functions.text import suffix_of
from foliospark.sources import readers

#: A UTF-8 character at the end of Latin-1 characters that lacks its last bytes.
_BEGUN = (
    r"([\xc2-\xdf]|\xe0[\xa0-\xbf]?|[\xe1-\xec\xee\xef][\x80-\xbf]?|\xed[\x80-\x9f]?"
    r"|\xf0([\x90-\xbf][\x80-\xbf]?)?|[\xf1-\xf3][\x80-\xbf]{0,2}|\xf4([\x80-\x8f][\x80-\xbf]?)?)\z"
)
_HTML = r"(?i)<\s*(!doctype\s+html|html|head|body|table|div|p|img)\b"


def _starts(data: Column, magic: bytes) -> Column:
    return F.startswith(data, F.lit(magic))


def _mapped(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    by_value: dict[str, list[str]] = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    return reduce(lambda out, kv: out.when(key.isin(*kv[1]), kv[0]), list(by_value.items())[1:], F.when(key.isin(*next(iter(by_value.values()))), next(iter(by_value)))).otherwise(otherwise)


def as_latin(data: Column) -> Column:
    """Bytes as characters one to one, for patterns."""
    return F.decode(data, "ISO-8859-1")


def sniff_mime(data: Column, name: Column | None = None) -> Column:
    """Media type of image bytes, by content and then by suffix."""
    out = F.when(_starts(data, S.MAGIC[0][0]), S.MAGIC[0][1])
    for magic, mime in S.MAGIC[1:]:
        out = out.when(_starts(data, magic), mime)
    four = F.substring(data, 9, 4)
    out = out.when(_starts(data, b"RIFF") & (four == F.lit(b"WEBP")), "image/webp")
    out = out.when((F.substring(data, 5, 4) == F.lit(b"ftyp")) & four.isin(*[F.lit(b) for b in S.HEIC_BRANDS]), "image/heic")
    out = out.when(as_latin(F.substring(data, 1, 4096)).rlike(r"^[\s\x0b]*(<svg |<\?xml)"), "image/svg+xml")
    other = F.lit("application/octet-stream")
    return out.otherwise(other if name is None else _mapped(suffix_of(name), S.SUFFIX_MIME, other))


def is_mail(data: Column) -> Column:
    window = as_latin(F.substring(data, 1, S.MAIL_BYTES))
    hits = sum((window.rlike(f"(?m)(?d)^{h}").cast("int") for h in S.MAIL_HEADERS[1:]), window.rlike(f"(?m)(?d)^{S.MAIL_HEADERS[0]}").cast("int"))
    mime = F.contains(F.substring(data, 1, S.SNIFF_BYTES), F.lit(b"MIME-Version:"))
    return window.startswith("From ") | (hits >= 3) | ((hits == 2) & mime)


def _whole_characters(data: Column) -> Column:
    """The head of whole files without the UTF-8 character that its end may part."""
    last = as_latin(F.substring(data, S.SNIFF_BYTES - 2, 3))
    begun = F.octet_length(F.encode(F.regexp_extract(last, _BEGUN, 0), "ISO-8859-1"))
    return F.substring(data, F.lit(1), F.lit(S.SNIFF_BYTES) - F.when(F.octet_length(data) > S.SNIFF_BYTES, begun).otherwise(0))


def is_textual(data: Column) -> Column:
    """Decodable, without NUL near the start, and with few control characters; ``data`` is the whole file."""
    head = F.substring(data, 1, S.SNIFF_BYTES)
    line = as_latin(head)
    western = ~line.rlike(r"[\x81\x8d\x8f\x90\x9d]")
    control = F.octet_length(head) - F.length(F.regexp_replace(line, r"[\x00-\x08\x0e-\x1f]", ""))
    return (F.octet_length(head) > 0) & ~F.contains(F.substring(data, 1, 1024), F.lit(b"\0")) & (F.is_valid_utf8(_whole_characters(data).cast("string")) | western) & (control < 0.05 * F.octet_length(head))


@F.pandas_udf(T.StructType().add("names", T.ArrayType(T.StringType())).add("mimetype", T.StringType()))
def zip_facts(content: pd.Series) -> pd.DataFrame:
    """Member names of zips and the text of ``mimetype``; null for anything else."""
    from foliospark.sources.sniff import zip_facts as facts

    found = [facts(bytes(c)) if c is not None and bytes(c[:4]) == b"PK\x03\x04" else None for c in content]
    return pd.DataFrame({"names": [f and f[0] for f in found], "mimetype": [f and f[1] for f in found]}, dtype=object)


def detect(content: Column, name: Column, facts: Column | None = None) -> Column:
    """The kind of a file. ``facts`` is what ``zip_facts`` says; without it zips are ``unknown``."""
    head, suffix = F.substring(content, 1, S.SNIFF_BYTES), suffix_of(name)
    by_suffix = lambda other: _mapped(suffix, S.SUFFIX_KIND, F.lit(other))
    stream = lambda text: F.contains(head, F.lit(text.encode("utf-16-le")))
    ole = F.when(stream(S.OLE_MESSAGE), "unknown")
    for text, kind in S.OLE_STREAMS:
        ole = ole.when(stream(text), kind)
    ole = ole.otherwise(by_suffix("doc"))
    zipped = F.lit("unknown")
    if facts is not None:
        names, mimetype = facts["names"], facts["mimetype"]
        zipped = F.when(names.isNull(), "unknown")
        for part, kind in S.OPC_PARTS:
            zipped = zipped.when(F.array_contains(names, part), kind)
        zipped = zipped.when(F.array_contains(names, "content.xml"), _mapped(F.coalesce(mimetype, F.lit("")), S.ODF_MIMES, F.lit("odt"))).when(suffix.isin(".zip", ""), "archive").otherwise("unknown")
    return (
        F.when(_starts(head, b"%PDF"), "pdf").when(_starts(head, b"{\\rt"), "rtf").when(_starts(head, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ole).when(_starts(head, b"PK\x03\x04"), zipped)
        .when(sniff_mime(head, name).startswith("image/"), "image").when(is_mail(head), "email").when(as_latin(F.substring(head, 1, S.HINT_BYTES)).rlike(_HTML), "html")
        .when(is_textual(content), "text").otherwise(by_suffix("unknown"))
    )


def with_kind(files: DataFrame, zips: bool = True) -> DataFrame:
    """Adds ``kind`` to files (``path``, ``content``); only zips reach Python, and only if ``zips``."""
    if not zips:
        return files.withColumn("kind", detect(F.col("content"), F.col("path")))
    # Rows that are no zips go to the worker as nulls.
    zipped = F.when(_starts(F.col("content"), b"PK\x03\x04"), F.col("content"))
    return files.withColumn("_facts", zip_facts(zipped)).withColumn("kind", detect(F.col("content"), F.col("path"), F.col("_facts"))).drop("_facts")


def unreadable_reason(name: Column) -> Column:
    """Why a known kind of file cannot be read; null for others."""
    return _mapped(suffix_of(name), S.UNREADABLE, F.lit(None).cast("string"))


def supported_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in readers.supported_kinds()], "kind string")


def family_of(kind: Column) -> Column:
    return _mapped(kind, S.FAMILY_OF, F.lit("unknown"))


def is_container(kind: Column) -> Column:
    return kind.isin(*S.CONTAINERS)


def can_hold_images(kind: Column) -> Column:
    return kind != "text"


def can_render(kind: Column, has_soffice: bool) -> Column:
    from foliospark.sources.readers.optional import CONVERTIBLE

    return kind.isin("pdf", "image") | (kind.isin(*CONVERTIBLE) & F.lit(has_soffice))


@F.pandas_udf(T.StringType())
def charset_of(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The guessed encoding of HTML or text bytes."""
    from foliospark.sources.readers.markup import charset_of as guess

    for part in content:
        yield part.map(lambda c: None if c is None else guess(bytes(c)))
