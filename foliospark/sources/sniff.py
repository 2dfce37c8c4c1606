"""Kinds of files by their bytes, in a worker. ``functions.detect`` says the same in Column terms."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from pathlib import PurePosixPath

from foliospark import schema as S

_HTML = re.compile(rb"<\s*(!doctype\s+html|html|head|body|table|div|p|img)\b", re.I)
_MAIL = [re.compile(rb"^" + h.encode(), re.M) for h in S.MAIL_HEADERS]


def suffix_of(name: str) -> str:
    return PurePosixPath(name.replace("\\", "/")).suffix.lower()


def sniff_mime(data: bytes, name: str = "") -> str:
    for magic, mime in S.MAGIC:
        if data.startswith(magic):
            return mime
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    if data[4:8] == b"ftyp" and data[8:12] in S.HEIC_BRANDS:
        return "image/heic"
    if data[:65536].lstrip()[:5] in (b"<svg ", b"<?xml"):
        return "image/svg+xml"
    return S.SUFFIX_MIME.get(suffix_of(name), "application/octet-stream")


def zip_kind(names: list[str], mimetype: str | None, suffix: str) -> str:
    """The kind of a zip with these members; ``mimetype`` is that member's text, if it is there."""
    held = set(names)
    for part, kind in S.OPC_PARTS:
        if part in held:
            return kind
    if "content.xml" in held:
        return "odt" if mimetype is None else S.ODF_MIMES.get(mimetype, "odt")
    return "archive" if suffix in (".zip", "") else "unknown"


def zip_facts(data: bytes) -> tuple[list[str], str | None] | None:
    """Member names and the text of ``mimetype``; None if it is no zip."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            text = z.read("mimetype").decode("ascii", "ignore").strip() if "mimetype" in names and "content.xml" in names else None
            return names, text
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
        return None


def detect(data: bytes, name: str = "") -> str:
    """The kind of a file from its bytes; the name decides only where they cannot."""
    head, suffix = data[: S.SNIFF_BYTES], suffix_of(name)
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"{\\rt"):
        return "rtf"
    if head.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        if S.OLE_MESSAGE.encode("utf-16-le") in head:
            return "unknown"
        return next((k for s, k in S.OLE_STREAMS if s.encode("utf-16-le") in head), S.SUFFIX_KIND.get(suffix, "doc"))
    if head.startswith(b"PK\x03\x04"):
        facts = zip_facts(data)
        return "unknown" if facts is None else zip_kind(*facts, suffix)
    if sniff_mime(head, name).startswith("image/"):
        return "image"
    if is_mail(head):
        return "email"
    if _HTML.search(head[: S.HINT_BYTES]):
        return "html"
    return "text" if is_textual(data) else S.SUFFIX_KIND.get(suffix, "unknown")


def is_mail(head: bytes) -> bool:
    window = head[: S.MAIL_BYTES]
    if window.startswith(b"From "):
        return True
    hits = sum(bool(p.search(window)) for p in _MAIL)
    return hits >= 3 or hits == 2 and b"MIME-Version:" in head


def is_textual(data: bytes) -> bool:
    """``data`` is the whole file; a character that the end of its head parts is no error."""
    head = data[: S.SNIFF_BYTES]
    if not head or b"\0" in head[:1024]:
        return False
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=len(data) <= S.SNIFF_BYTES)
    except UnicodeDecodeError:
        if any(b in head for b in b"\x81\x8d\x8f\x90\x9d"):
            return False
    control = len(head) - len(head.translate(None, bytes([*range(9), *range(14, 32)])))
    return control < 0.05 * len(head)


def unreadable_reason(name: str) -> str | None:
    return S.UNREADABLE.get(suffix_of(name))
