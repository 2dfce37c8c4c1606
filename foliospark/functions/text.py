"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, in ASCII and beyond.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at both ends, Unicode's too. ``trim`` alone takes blanks only, and patterns are slow."""
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return stripped(text) == ""


def label_key(text: Column) -> Column:
    """Letters and digits in lower case, for comparing labels."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def suffix_of(name: Column) -> Column:
    """The file suffix in lower case, with its dot; empty if there is none."""
    leaf = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(leaf, r"[^.](\.[^.]+)$", 1))


def safe_name(name: Column) -> Column:
    """The last part of a path, of harmless characters only."""
    leaf = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    kept = stripped(F.regexp_replace(leaf, r"[^\p{L}\p{N} ._\-()\[\]]", ""))
    return F.substring(F.when(kept == "", F.lit("attachment")).otherwise(kept), 1, 120)


def natural_key(name: Column) -> Column:
    """Sorts with digits by value: runs of digits are padded to 20."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


def base64_of(data: Column) -> Column:
    """Base64 in one line, whatever the session says of chunks."""
    return F.translate(F.base64(data), "\r\n", "")
