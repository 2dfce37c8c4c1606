"""Asking a model for fields, and reading its replies."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.errors import MissingDependency
from foliospark.functions.json import parse_reply
from foliospark.functions.text import is_blank, stripped
from foliospark.operators.payload import TEXT_PREFIX, text_part, to_content
from foliospark.operators.strategy import needs_vision

# The prompt's wording, and what is said where nothing could be read.
ASK = "Read this document and extract the fields below."
KEYS = "Return ONLY a JSON object with exactly these keys:"
RULES = (
    "- Use null for any field that is absent or not legible. Never guess.",
    "- Copy values exactly as written, including spelling and formatting.",
    "- If the document is not the expected type, set every field to null.",
)
NOTHING = "nothing extractable in this document"
UNSENDABLE = "document needs vision but no image could be sent, and it has no text layer to fall back on; treat it as unverifiable"
UNPARSABLE = "model response was not parseable JSON"


def build_prompt(fields: dict[str, str], instructions: str = "") -> str:
    lines = [instructions.strip() or ASK, "", KEYS, *(f"  {k}: {v}" for k, v in fields.items()), "", "Rules:", *RULES]
    return "\n".join(lines)


def prompt_of(fields: Column, instructions: Column) -> Column:
    """The same from a column of ``array<struct<name, description>>``; the array keeps the fields' order."""
    lead = F.when(is_blank(instructions), ASK).otherwise(stripped(instructions))
    lines = F.transform(fields, lambda f: F.concat(F.lit("  "), f["name"], F.lit(": "), f["description"]))
    return F.array_join(F.concat(F.array(lead, F.lit(""), F.lit(KEYS)), lines, F.array(F.lit(""), F.lit("Rules:"), *map(F.lit, RULES))), "\n")


def message_text(response: Any) -> str:
    """The reply's text, from objects or dicts, whole or in parts."""
    get = lambda x, k: x.get(k) if isinstance(x, dict) else getattr(x, k, None)
    choices = get(response, "choices") or []
    content = get(get(choices[0], "message") or {}, "content") if choices else None
    if isinstance(content, list):
        return "".join(get(p, "text") or "" for p in content)
    return content if isinstance(content, str) else ""


def default_client() -> Any:
    """A client for a server that speaks the OpenAI protocol, made on the executor that uses it."""
    try:
        from openai import OpenAI
    except ImportError:
        raise MissingDependency("the openai package", "Install it with: pip install openai -- or pass a client factory") from None
    url = os.environ.get("FOLIOSPARK_BASE_URL") or os.environ.get("OPENAI_BASE_URL")
    return OpenAI(base_url=url, api_key=os.environ.get("OPENAI_API_KEY") or "not-needed-for-local")


def read(
    prepared: DataFrame, fields: dict[str, str] | None = None, prompt: str | None = None, instructions: str = "", client_factory: Callable[[], Any] = default_client, model: str = "default",
    dialect: str = "openai", temperature: float = 0.0, max_tokens: int = 1500, skip_vision_when_text: bool = True, **create_kwargs: Any,
) -> DataFrame:
    """Readings of prepared documents: ``doc_id, name, strategy, data, raw, used_vision, images_sent, model, notes, error, ok``.

    ``data`` is canonical JSON. Rows that need no call pass as they are, without
    their content; calls run with one client a partition.
    """
    if prompt is None:
        if not fields:
            raise ValueError("pass either fields= or prompt=")
        prompt = build_prompt(fields, instructions)
    full = to_content(prepared.withColumn("_plain_notes", F.col("notes")), prompt, dialect)
    pixels = needs_vision(F.col("strategy")) | F.lit(not skip_vision_when_text)
    asked = full.withColumns(
        {
            "images_sent": F.when(pixels, F.col("images_sent")).otherwise(0),
            "content": F.when(pixels, F.col("content")).otherwise(F.array(text_part(F.lit(prompt)), text_part(F.concat(F.lit(TEXT_PREFIX), F.col("text"))))),
            "notes": F.when(pixels, F.col("notes")).otherwise(F.col("_plain_notes")),
        }
    )
    blocked = F.when(F.col("strategy") == "empty", NOTHING).when(pixels & (F.col("images_sent") == 0) & is_blank(F.col("text")), UNSENDABLE)
    rows = asked.withColumn("error", blocked).select("doc_id", "name", "strategy", "content", "images_sent", "notes", "error")
    rows = rows.withColumn("images_sent", F.when(F.col("strategy") == "empty", 0).otherwise(F.col("images_sent")))
    schema = "doc_id string, name string, strategy string, images_sent int, notes array<string>, error string, raw string"

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        client = None
        for frame in frames:
            raws, errors = [], []
            for content, error in zip(frame["content"], frame["error"]):
                raw = ""
                if content is not None:
                    try:
                        client = client or client_factory()
                        reply = client.chat.completions.create(model=model, messages=[{"role": "user", "content": json.loads(content)}], temperature=temperature, max_tokens=max_tokens, **create_kwargs)
                        raw = message_text(reply)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                raws.append(raw)
                errors.append(error)
            yield frame.drop(columns=["content"]).assign(error=errors, raw=raws)

    sent = rows.withColumn("content", F.when(F.col("error").isNull(), F.to_json("content"))).mapInPandas(call, schema)
    out = sent.withColumn("data", parse_reply("raw"))
    out = out.withColumn("error", F.when(F.col("error").isNull() & F.col("data").isNull(), UNPARSABLE).otherwise(F.col("error")))
    out = out.withColumns({"used_vision": F.col("images_sent") > 0, "model": F.lit(model)})
    return out.withColumn("ok", F.col("error").isNull() & F.col("data").isNotNull())


def field(reading: DataFrame, name: str) -> Column:
    """A field of the reply as text, or null."""
    return F.get_json_object("data", f"$['{name}']")
