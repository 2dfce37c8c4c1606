"""Tries the engine on a small document and says what does not work."""

from __future__ import annotations

from pyspark.sql import SparkSession

from foliospark.operators.payload import to_content
from foliospark.operators.prepare import prepare
from foliospark.plans import fixtures as fx
from foliospark.sources.extract import extract


def run(spark: SparkSession) -> bool:
    scan = fx.png(900, 700)
    body = fx.para("A caption above the scan.") + fx.blip("rId1") + fx.word_table([["Field", "Value"], ["Name", "Ann"]])
    files = spark.createDataFrame([("check/scan.pdf", bytearray(fx.docx(body, {"scan.png": scan})))], "path string, content binary")
    docs = extract(files).cache()
    row = docs.first()
    ready = prepare(docs, render_fallback=False)
    kept = ready.first()
    tests = {
        "the kind comes from the bytes": row["kind"] == "docx",
        "text, image and table are read": [b["is_image"] for b in row["blocks"]] == [False, True, False],
        "the image's size is known": row["blocks"][1]["width"] == 900,
        "image bytes are unchanged": bytes(row["blobs"][0]["data"]) == scan,
        "a short caption with a scan needs vision": kept["strategy"] == "image_only" and len(kept["kept"]) == 1,
    }
    with_bytes = ready.join(docs.select("doc_id", "blobs"), "doc_id")
    for dialect in ("openai", "anthropic"):
        content = to_content(with_bytes, "Read this.", dialect).first()
        tests[f"a payload for {dialect} has the image"] = content["images_sent"] == 1
    for name, ok in tests.items():
        print(f"{'ok  ' if ok else 'FAIL'} {name}")
    return all(tests.values())
