"""How a document should reach a model: as text, as pixels, as both or not at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import is_blank
from foliospark.schema import FAMILY_THRESHOLDS, MIN_TEXT_CHARS


def threshold_for(family: Column, min_text_chars: int = MIN_TEXT_CHARS) -> Column:
    """Characters from which a text layer is trusted; a given value other than the default holds for all families."""
    if min_text_chars != MIN_TEXT_CHARS:
        return F.lit(min_text_chars)
    first, *others = FAMILY_THRESHOLDS.items()
    return reduce(lambda out, kv: out.when(family == kv[0], kv[1]), others, F.when(family == first[0], first[1])).otherwise(MIN_TEXT_CHARS)


def decide(body: Column, threshold: Column, n_images: Column, n_kept: Column, kind: Column) -> Column:
    """``hybrid, text_only, image_only`` or ``empty``.

    Weak text is no emptiness: pixels are looked at, unless the kind can have none.
    """
    long = F.length(body) >= threshold
    return (
        F.when(long & (n_kept > 0), "hybrid").when(long, "text_only").when(n_kept > 0, "image_only").when(is_blank(body) & (n_images == 0), "empty").when((n_images == 0) & (kind == "text"), "text_only").otherwise("image_only")
    )


def explain(strategy: Column, body: Column, threshold: Column, n_kept: Column, n_rejected: Column) -> Column:
    """One line of reasoning, for audit."""
    s = lambda c: c.cast("string")
    return F.concat(strategy, F.lit(": "), s(F.length(body)), F.lit(" body chars (threshold "), s(threshold), F.lit("), "), s(n_kept), F.lit(" image(s) kept, "), s(n_rejected), F.lit(" filtered out"))


def needs_vision(strategy: Column) -> Column:
    return strategy.isin("image_only", "hybrid")
