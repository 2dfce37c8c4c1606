"""Files to documents: one scan, Arrow batches through Python readers, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from foliospark import schema as S
from foliospark.functions.text import stripped
from foliospark.sources import readers
from foliospark.sources.draft import Draft, Options
from foliospark.sources.sniff import detect

#: Rows of whole files that go to a worker at once.
FILES_AT_ONCE = 16


def binary_files(spark: SparkSession, path: str | list[str], **options: object) -> DataFrame:
    """Files as ``path, content``; a missing path raises on the driver."""
    return spark.read.format("binaryFile").options(**options).load(path).select("path", "content")


def extract(files: DataFrame, include_headers: bool = True, embedded_images: bool = True, max_pages: int | None = None, compat_meta: bool = False, mode: str = "column", sidecars: bool = False, loose_references: bool = True) -> DataFrame:
    """Documents of ``files`` (``path``, ``content``), one row a node of each tree.

    What a reader raises becomes the ``error`` column, or with
    ``mode="raise"`` fails the job. With ``sidecars`` the files of a page's
    folder are brought beside it for its images; otherwise nothing is shuffled.
    Without ``loose_references`` a page's character references count only with
    their semicolon; others stay as they are written.
    """
    options = Options(include_headers, embedded_images, max_pages, compat_meta, loose_references, readers=dict(readers.REGISTERED))

    def one(path: str, data: bytes | None, beside: dict[str, bytes] | None) -> list[dict]:
        name = path.rstrip("/").rpartition("/")[2]
        options.siblings = beside
        try:
            draft = readers.read(data or b"", name, options)
        except Exception as e:
            if mode == "raise":
                raise
            draft = Draft(name, detect(data or b"", name), error=(type(e).__name__, str(e)))
        return draft.rows(path, path)

    schema = to_arrow_schema(DataType.fromDDL(S.DOCUMENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                rows = []
                for file in batch.slice(at, FILES_AT_ONCE).to_pylist():
                    beside = file.get("beside")
                    rows += one(file["path"], file["content"], None if beside is None else {x["name"]: x["data"] for x in beside})
                yield pa.RecordBatch.from_pylist(rows, schema)

    own = files.select("path", "content")
    if sidecars:
        own = _with_siblings(own)
    return own.mapInArrow(run, S.DOCUMENTS)


def _with_siblings(files: DataFrame) -> DataFrame:
    """HTML files with the images of their folder and below, joined by folder."""
    image = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*S.SUFFIX_MIME)
    page = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(".html", ".htm", ".xhtml")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    pages = files.filter(page).select("path", "content", folder.alias("folder"))
    # An image stands beside pages of each folder above it.
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    images = files.filter(image).select(F.explode(ups).alias("folder"), "path", F.col("content").alias("data"))
    near = images.select("folder", F.expr("substr(path, length(folder) + 1)").alias("name"), "data").join(pages.select("folder").distinct(), "folder", "left_semi")
    sets = near.groupBy("folder").agg(F.collect_list(F.struct("name", "data")).alias("beside"))
    return pages.join(sets, "folder", "left").select("path", "content", "beside").unionByName(files.filter(~page).withColumn("beside", F.lit(None).cast("array<struct<name:string,data:binary>>")))


def text_block(text: Column, role: Column | str = "paragraph", pos: Column | int = 0) -> Column:
    """One text block from columns."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    known = {"pos": lit(pos).cast("int"), "ord": lit(pos).cast("int"), "is_image": F.lit(False), "text": text, "role": lit(role)}
    return F.struct(*[known[f.name].alias(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in DataType.fromDDL(S.BLOCK).fields])


def image_block(pos: Column, order: Column, mime: Column, name: Column, width: Column, height: Column, nbytes: Column, sha256: Column) -> Column:
    """One image block from columns; its bytes are elsewhere."""
    known = {"pos": pos.cast("int"), "ord": order.cast("int"), "is_image": F.lit(True), "mime": mime, "name": name, "width": width.cast("int"), "height": height.cast("int"), "nbytes": nbytes.cast("int"), "sha256": sha256, "source": F.lit("embedded"), "referenced": F.lit(True)}
    return F.struct(*[known[f.name].alias(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in DataType.fromDDL(S.BLOCK).fields])


def document(doc_id: Column, name: Column, kind: Column | str, blocks: Column, root_id: Column | None = None, parent_id: Column | None = None, child_path: Column | None = None, origin: Column | None = None, n_children: Column | int = 0) -> list[Column]:
    """The columns of ``schema.DOCUMENTS`` from columns, for tables that already hold text."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None)
    at = F.array().cast("array<int>") if child_path is None else child_path
    known = {
        "doc_id": doc_id, "root_id": doc_id if root_id is None else root_id, "parent_id": none if parent_id is None else parent_id, "child_path": at, "depth": F.size(at), "path": doc_id if root_id is None else root_id,
        "name": name, "origin": none if origin is None else origin, "kind": lit(kind), "n_children": lit(n_children), "blocks": blocks, "blobs": F.array(), "tables": F.array(), "meta": F.create_map(),
        "sheet_names": none, "warnings": F.array(), "error": none,
    }
    return [known[f.name].cast(f.dataType).alias(f.name) for f in DataType.fromDDL(S.DOCUMENTS).fields]


def text_documents(df: DataFrame, id_col: str, text_col: str, kind: Column | str = "text") -> DataFrame:
    """Text columns as documents of one paragraph, without any Python.

    Equal to reading each text as a ``.txt`` file of under four million bytes.
    """
    text, own = stripped(F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col).cast("string")
    return df.select(*document(own, own, kind, F.when(text != "", F.array(text_block(text))).otherwise(F.array())))
