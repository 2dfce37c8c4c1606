"""JSON objects out of what models reply."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.+?)```", re.S)


def object_in(reply: str | None) -> dict | None:
    """The first of the whole reply, a fenced block and the outermost braces that is an object or a list led by one."""
    text = (reply or "").strip()
    if not text:
        return None
    fence, first, last = _FENCE.search(text), text.find("{"), text.rfind("}")
    for tried in (text, fence and fence[1].strip(), text[first : last + 1] if 0 <= first < last else None):
        try:
            value = json.loads(tried) if tried else None
        except ValueError:
            continue
        value = value[0] if isinstance(value, list) and value else value
        if isinstance(value, dict):
            return value
    return None


def _finite(value: object) -> object:
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def parse_reply(reply: pd.Series) -> pd.Series:
    """The object of a reply as canonical JSON, or null. Numbers that are not finite become null.

    Spark's own JSON parsers take trailing garbage and refuse repeated keys,
    so validity is judged here; ``parse_json`` makes the result a VARIANT.
    """

    def one(text: str | None) -> str | None:
        found = object_in(text)
        return None if found is None else json.dumps(_finite(found), ensure_ascii=False, separators=(",", ":"))

    return reply.map(one)
