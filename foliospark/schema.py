"""Names, kinds and row types that the whole engine shares."""

from __future__ import annotations

# Kinds of documents, by family.
FAMILIES = {
    "word": ("docx", "doc", "odt", "rtf"),
    "sheet": ("xlsx", "xls", "ods"),
    "slides": ("pptx", "ppt", "odp"),
    "paged": ("pdf",),
    "image": ("image",),
    "markup": ("html", "text"),
    "container": ("email", "archive"),
}
FAMILY_OF = {kind: family for family, kinds in FAMILIES.items() for kind in kinds}
KINDS = tuple(sorted(FAMILY_OF))
CONTAINERS = FAMILIES["container"]
STRATEGIES = ("text_only", "image_only", "hybrid", "empty")
BOILERPLATE_ROLES = ("header", "footer")

# Media types, what sniffs them, and their file suffixes.
SUFFIX_MIME = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".jpe": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp",
    ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heic",
    ".emf": "image/x-emf", ".wmf": "image/x-wmf", ".svg": "image/svg+xml",
}
MIME_SUFFIX = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/webp": ".webp", "image/heic": ".heic", "image/x-emf": ".emf", "image/x-wmf": ".wmf", "image/svg+xml": ".svg"}
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"),
    (b"II*\x00", "image/tiff"), (b"MM\x00*", "image/tiff"), (b"\x01\x00\x00\x00", "image/x-emf"), (b"\xd7\xcd\xc6\x9a", "image/x-wmf"),
)
HEIC_BRANDS = (b"heic", b"heix", b"hevc", b"mif1")
VECTOR_MIMES = ("image/x-emf", "image/x-wmf", "image/svg+xml")
API_SAFE_MIMES = ("image/png", "image/jpeg", "image/webp", "image/gif")
SUFFIX_KIND = {
    **dict.fromkeys((".docx", ".docm"), "docx"), **dict.fromkeys((".xlsx", ".xlsm"), "xlsx"), **dict.fromkeys((".pptx", ".pptm"), "pptx"),
    ".doc": "doc", ".xls": "xls", ".ppt": "ppt", ".odt": "odt", ".ods": "ods", ".odp": "odp", ".pdf": "pdf", ".rtf": "rtf", ".eml": "email", ".zip": "archive",
    **dict.fromkeys((".html", ".htm", ".xhtml", ".mht", ".mhtml"), "html"), **dict.fromkeys((".txt", ".csv", ".tsv", ".md", ".log", ".json"), "text"),
}
OPC_PARTS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))
ODF_MIMES = {"application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp"}
OLE_STREAMS = (("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt"))
OLE_MESSAGE = "__substg1.0"
MAIL_HEADERS = ("Subject:", "From:", "To:", "Date:", "Received:", "Message-ID:")
UNREADABLE = {
    ".msg": "Outlook .msg is an OLE2 container with no stdlib reader. Convert it to .eml, or install extract-msg and register a backend for it.",
    ".pages": "Apple Pages is a proprietary bundle; export to .docx or PDF.",
    ".numbers": "Apple Numbers is a proprietary bundle; export to .xlsx or PDF.",
    ".key": "Apple Keynote is a proprietary bundle; export to .pptx or PDF.",
    ".7z": "7-Zip archives need py7zr; only .zip is built in.",
    ".rar": "RAR archives need rarfile plus an unrar binary.",
}

# Limits.
SNIFF_BYTES, HINT_BYTES, MAIL_BYTES, TEXT_BYTES = 65536, 8192, 2048, 4_000_000
MAX_MEMBERS, MAX_TOTAL_BYTES, MAX_RATIO, MAX_DEPTH = 200, 512 * 1024 * 1024, 200, 3
MAX_ROWS, MAX_COLS, MAX_REPEAT = 2000, 64, 32
SKIP_NAMES = (".ds_store", "thumbs.db", "desktop.ini")
MIN_TEXT_CHARS = 180
FAMILY_THRESHOLDS = {"slides": 400, "sheet": 80, "markup": 120}
MAX_EDGE, RENDER_DPI = 1600, 250

BLOCK = (
    "struct<pos:int,ord:int,is_image:boolean,text:string,role:string,page:int,section:string,mime:string,name:string,"
    "width:int,height:int,nbytes:int,sha256:string,source:string,referenced:boolean>"
)
#: One row a document; children of containers are rows with a path of ordinals.
#: Image bytes stand apart in ``blobs``: pruning stops at functions over ``blocks``.
DOCUMENTS = (
    "doc_id string, root_id string, parent_id string, child_path array<int>, depth int, path string, name string, origin string, kind string, n_children int, "
    f"blocks array<{BLOCK}>, blobs array<struct<sha256:string,data:binary>>, "
    "tables array<struct<ord:int,section:string,rows:array<array<string>>>>, meta map<string,string>, sheet_names array<string>, warnings array<string>, "
    "error struct<type:string,message:string>"
)
