"""``python -m foliospark FILES``: what is found in documents, and how they would be sent."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from foliospark.operators.filters import DEFAULT, KEEP_ALL, STRICT
from foliospark.operators.prepare import prepare_all
from foliospark.plans.report import report
from foliospark.schema import FAMILY_OF, RENDER_DPI
from foliospark.sources.extract import binary_files, extract
from foliospark.sources.readers import supported_kinds
from foliospark.sources.readers.optional import soffice
from foliospark.sources.sinks import image_files, write_files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m foliospark", description=__doc__)
    parser.add_argument("paths", nargs="*", help="files or folders that Spark can read")
    parser.add_argument("--dump", metavar="DIR", help="write kept images into DIR")
    parser.add_argument("--filter", choices=("default", "strict", "all"), default="default")
    parser.add_argument("--dpi", type=int, default=RENDER_DPI)
    parser.add_argument("--no-render", action="store_true", help="never render pages")
    parser.add_argument("--text", action="store_true", help="print the text layer")
    parser.add_argument("--formats", action="store_true", help="list what can be read")
    parser.add_argument("--selfcheck", action="store_true", help="try the engine here")
    args = parser.parse_args(argv)
    if args.formats:
        print("Supported formats:", *(f"  {k:<9} {FAMILY_OF.get(k, 'unknown')}" for k in supported_kinds()), "", f"LibreOffice: {'found' if soffice() else 'NOT found'}", sep="\n")
        return 0
    if not args.paths and not args.selfcheck:
        parser.error("give at least one file, or --formats / --selfcheck")
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    if args.selfcheck:
        from foliospark.plans.selfcheck import run

        return 0 if run(spark) else 1
    files = binary_files(spark, args.paths)
    docs = extract(files).cache()
    chosen = {"default": DEFAULT, "strict": STRICT, "all": KEEP_ALL}[args.filter]
    ready = prepare_all(docs, files, chosen, render_fallback=not args.no_render, render_dpi=args.dpi)
    bad = [(r["path"], r["error"]) for r in docs.filter("error IS NOT NULL").select("path", "error").toLocalIterator()]
    last = None
    for r in report(ready, docs.filter("error IS NULL"), args.text).orderBy("doc_id", "n").toLocalIterator():
        if r["doc_id"] != last:
            last = r["doc_id"]
            print(f"=== {last}")
        print(f"  {r['line']}")
    for path, error in bad:
        print(f"=== {path}\n  FAILED: {error['type']}: {error['message']}", file=sys.stderr)
    if args.dump:
        write_files(image_files(ready), args.dump)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
