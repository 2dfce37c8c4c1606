"""Small files of every kind, made in code: for checks of an installation, round trips and tests.

All writers take plain values and give bytes, so that they run in workers.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from email.message import EmailMessage
from xml.sax.saxutils import escape, quoteattr

# Namespaces of the formats.
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_V = 'xmlns:v="urn:schemas-microsoft-com:vml"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CORE = 'xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"'
_ODF = (
    'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" '
    'xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:meta="urn:oasis:names:tc:opendocument:xmlns:meta:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/"'
)


def png(width: int, height: int, shade: int = 120) -> bytes:
    """A PNG of noise-like grey lines, whose bytes grow with its area."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + bytes((shade + (x * y * 7 + x * 3 + y) % 61) & 255 for x in range(width)) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def zipped(members: dict[str, bytes | str], compress: bool = True) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def _relations(*rels: tuple[str, str, str]) -> str:
    return f'<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="{i}" Type="{_TYPES}/{kind}" Target={quoteattr(target)}/>' for i, kind, target in rels) + "</Relationships>"


def _core(author: str) -> str:
    return f"<cp:coreProperties {_CORE}><dc:creator>{escape(author)}</dc:creator></cp:coreProperties>"


def para(text: str) -> str:
    return f"<w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p>"


def deleted(text: str) -> str:
    return f"<w:p><w:del><w:r><w:delText>{escape(text)}</w:delText></w:r></w:del></w:p>"


def word_table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def blip(rid: str) -> str:
    return f'<w:p><w:r><w:drawing><a:blip r:embed="{rid}"/></w:drawing></w:r></w:p>'


def vml(rid: str) -> str:
    return f'<w:p><w:r><w:pict><v:imagedata r:id="{rid}"/></w:pict></w:r></w:p>'


def docx(body: str, media: dict[str, bytes] | None = None, related: bool = True, author: str = "Clerk", more: dict[str, bytes | str] | None = None) -> bytes:
    """``media`` gets the relationship ids rId1, rId2 and so on, in order."""
    media = media or {}
    rels = [(f"rId{n}", "image", f"media/{name}") for n, name in enumerate(media, 1)] if related else []
    return zipped({"word/document.xml": f"<w:document {_W} {_A} {_R} {_V}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": _relations(*rels), "docProps/core.xml": _core(author), **{f"word/media/{k}": v for k, v in media.items()}, **(more or {})})


def xlsx(sheets: dict[str, list[list[str]]], image: bytes | None = None) -> bytes:
    """Cells through the table of shared strings; ``image`` stands on the first sheet."""
    strings: dict[str, int] = {}
    parts: dict[str, bytes | str] = {}
    for n, rows in enumerate(sheets.values(), 1):
        body = "".join("<row>" + "".join(f'<c t="s"><v>{strings.setdefault(c, len(strings))}</v></c>' for c in r) + "</row>" for r in rows)
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {_S}><sheetData>{body}</sheetData></worksheet>"
    tabs = "".join(f'<sheet name={quoteattr(t)} sheetId="{n}" r:id="rId{n}"/>' for n, t in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f"<workbook {_S} {_R}><sheets>{tabs}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = _relations(*[(f"rId{n}", "worksheet", f"worksheets/sheet{n}.xml") for n in range(1, len(sheets) + 1)])
    parts["xl/sharedStrings.xml"] = f"<sst {_S}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>"
    if image is not None:
        parts["xl/worksheets/_rels/sheet1.xml.rels"] = _relations(("rId1", "drawing", "../drawings/drawing1.xml"))
        parts["xl/drawings/drawing1.xml"] = f'<d xmlns:x="urn:x" {_A} {_R}><a:blip r:embed="rId1"/></d>'
        parts["xl/drawings/_rels/drawing1.xml.rels"] = _relations(("rId1", "image", "../media/image1.png"))
        parts["xl/media/image1.png"] = image
    return zipped(parts)


def pptx(slides: list[tuple[list[str], bytes | None]], notes: dict[int, str] | None = None) -> bytes:
    """Slides of lines and maybe an image; ``notes`` by slide number from 1."""
    parts: dict[str, bytes | str] = {"ppt/presentation.xml": f"<p:presentation {_P}/>"}
    page = lambda lines, more: f"<p:sld {_P} {_A} {_R}>" + "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines) + more + "</p:sld>"
    for n, (lines, image) in enumerate(slides, 1):
        rels = []
        if image is not None:
            rels.append(("rId1", "image", f"../media/image{n}.png"))
            parts[f"ppt/media/image{n}.png"] = image
        if notes and n in notes:
            rels.append(("rId2", "notesSlide", f"../notesSlides/notesSlide{n}.xml"))
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = page([notes[n]], "")
        parts[f"ppt/slides/slide{n}.xml"] = page(lines, '<a:blip r:embed="rId1"/>' if image is not None else "")
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = _relations(*rels)
    return zipped(parts)


def odf(paragraphs: list[str], rows: list[list[str]] | None = None, image: bytes | None = None, kind: str = "text", drawn: str = "", more: dict[str, bytes | str] | None = None) -> bytes:
    """``kind`` is text, spreadsheet or presentation; ``drawn`` stands in the body as it is."""
    body = "".join(f"<text:p>{escape(t)}</text:p>" for t in paragraphs) + drawn
    if rows:
        cell = lambda c: f"<table:table-cell><text:p>{escape(c)}</text:p></table:table-cell>"
        body += '<table:table table:name="T1">' + "".join("<table:table-row>" + "".join(map(cell, r)) + "</table:table-row>" for r in rows) + "</table:table>"
    parts: dict[str, bytes | str] = {"mimetype": f"application/vnd.oasis.opendocument.{kind}"}
    if image is not None:
        body += '<text:p><draw:image xlink:href="Pictures/scan.png"/></text:p>'
        parts["Pictures/scan.png"] = image
    parts["content.xml"] = f"<office:document-content {_ODF}><office:body>{body}</office:body></office:document-content>"
    parts["meta.xml"] = f"<office:document-meta {_ODF}><office:meta><meta:initial-creator>Clerk</meta:initial-creator></office:meta></office:document-meta>"
    return zipped(parts | (more or {}))


def rtf(lines: list[str], image: bytes | None = None) -> bytes:
    units = lambda c: [int.from_bytes(c.encode("utf-16-le")[i : i + 2], "little", signed=True) for i in range(0, len(c.encode("utf-16-le")), 2)]
    code = lambda c: c if " " <= c < "\x7f" and c not in "\\{}" else "\\" + c if c in "\\{}" else "".join(f"\\u{n}?" for n in units(c))
    text = "\\par ".join("".join(map(code, x)) for x in lines)
    pict = "{\\pict\\pngblip\\picw10 " + image.hex() + "}" if image is not None else ""
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Times;}}{\\colortbl;}{\\*\\generator x;}{\\info{\\author A}}" + text + "\\par" + pict + "}").encode("ascii")


def eml(subject: str, body: str, attachments: dict[str, bytes] | None = None, subtype: str = "plain") -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "a@example.org", "b@example.org", subject, "Tue, 12 Mar 2024 10:00:00 +0000"
    m.set_content(body, subtype=subtype)
    for name, data in (attachments or {}).items():
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m.as_bytes()
