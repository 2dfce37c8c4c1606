"""Readers on files made in code: what is found, in which order, and what is said of the rest."""

from __future__ import annotations

import pytest

from foliospark.plans import fixtures as fx
from foliospark.sources import readers
from foliospark.sources.draft import Draft, Options
from foliospark.sources.probe import image_size
from foliospark.sources.sniff import detect, sniff_mime

SCAN = fx.png(300, 400)
LINE = "Certificate of record, issued by the county clerk, with names, dates and places as entered. " * 3


def read(data, name="file", **options):
    return readers.read(data if isinstance(data, bytes) else data.encode(), name, Options(**options))


def texts(draft, role=None):
    return [b["text"] for b in draft.blocks if not b["is_image"] and role in (None, b["role"])]


def images(draft):
    return [b for b in draft.blocks if b["is_image"]]


# kinds


@pytest.mark.parametrize(
    ("data", "name", "kind"),
    [
        (fx.docx(fx.para("x")), "a.pdf", "docx"), (fx.zipped({"a": "b"}), "a.docx", "unknown"), (fx.zipped({"a": "b"}), "a.zip", "archive"), (fx.zipped({"a": "b"}), "bundle", "archive"),
        (fx.xlsx({"S": [["x"]]}), "x", "xlsx"), (fx.pptx([(["x"], None)]), "x", "pptx"), (fx.odf(["x"]), "x", "odt"), (fx.odf(["x"], kind="spreadsheet"), "x", "ods"), (fx.odf(["x"], kind="presentation"), "x", "odp"),
        (fx.zipped({"content.xml": "<a/>"}), "x", "odt"), (b"PK\x03\x04broken", "a.zip", "unknown"), (b"%PDF-1.7", "a.txt", "pdf"), (b"{\\rtf1 x}", "a.doc", "rtf"), (SCAN, "scan", "image"), (b"plain", "a.png", "image"),
        (b"BMW is a make", "a.txt", "image"), (b"<?xml version='1.0'?><a/>", "a", "image"), (b"From here on", "a.txt", "email"), (b"Subject: a\nFrom: b\nTo: c\n\nx", "a", "email"), (b"Subject: a\nFrom: b\n\nx", "a", "text"),
        (b"Subject: a\nFrom: b\nMIME-Version: 1.0\n\nx", "a", "email"), (b"  <DIV>x", "a.txt", "html"), (b"", "a.csv", "text"), (b"", "a", "unknown"), (b"\x00\x01", "a.md", "text"), (b"\x81\x82", "a", "unknown"), ("na\xefve".encode("cp1252"), "a", "text"),
        (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "WordDocument".encode("utf-16-le"), "a.xls", "doc"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "__substg1.0".encode("utf-16-le"), "a.msg", "unknown"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a.xls", "xls"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a", "doc"),
    ],
)
def test_kinds(data, name, kind):
    assert detect(data, name) == kind


def test_mime_and_size():
    assert sniff_mime(b"\0\0\0\x18ftypheic") == "image/heic"
    assert sniff_mime(b"RIFF____WEBPVP8 ") == "image/webp"
    assert sniff_mime(b"??", "a.JPE") == "image/jpeg"
    assert image_size(fx.png(321, 123)) == (321, 123)
    assert image_size(b"GIF89a\x05\x00\x07\x00") == (5, 7)
    assert image_size(b"BM" + bytes(16) + (9).to_bytes(4, "little") + (-4).to_bytes(4, "little", signed=True)) == (9, 4)
    assert image_size(b"\xff\xd8\xff\xe0\x00\x04AB\xff\xc0\x00\x11\x08\x00\x30\x00\x40\x03") == (64, 48)
    assert image_size(b"RIFF____WEBPVP8X" + bytes(8) + b"\x09\0\0\x04\0\0") == (10, 5)
    assert image_size(b"RIFF____WEBPVP8L____\x2f" + (99 | 49 << 14).to_bytes(4, "little")) == (100, 50)
    assert image_size(b"junk") is None and image_size(b"\x89PNG\r\n\x1a\n") is None and image_size(b"") is None


# Word


def test_docx_order_images_and_warnings():
    body = '<w:p><w:r><w:t>Caption</w:t></w:r><w:r><w:drawing><a:blip r:embed="rId1"/></w:drawing></w:r></w:p>' + fx.deleted("gone") + fx.vml("rId2") + fx.para("after") + fx.blip("rId9") + '<w:altChunk r:id="x"/>'
    d = read(fx.docx(body, {"one.png": SCAN, "two.png": fx.png(10, 10)}, more={"word/media/lost.png": fx.png(20, 20), "word/embeddings/o.bin": b"x"}))
    assert [b.get("text") or b["name"] for b in d.blocks] == ["Caption", "one.png", "two.png", "after", "lost.png"]
    assert [b["ord"] for b in d.blocks] == [0, 1, 2, 3, 4]
    assert [b["referenced"] for b in images(d)] == [True, True, False]
    assert d.blobs[images(d)[0]["sha256"]] == SCAN and d.meta["media_count"] == "3" and d.meta["author"] == "Clerk"
    said = "\n".join(d.warnings)
    assert "relationship rId9 has no target" in said and "altChunk" in said and "1 media part(s) unreferenced" in said and "OLE embeddings" in said


def test_docx_tables_and_headers():
    inner = fx.word_table([["in"]])
    table = f"<w:tbl><w:tr><w:tc>{fx.para('a')}{fx.para('b')}</w:tc><w:tc>{inner}{fx.blip('rId1')}</w:tc></w:tr></w:tbl>"
    header = '<w:hdr xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>'
    data = fx.docx(fx.para("p") + table + f"<w:sdt><w:sdtContent>{fx.para('control')}</w:sdtContent></w:sdt>", {"i.png": SCAN}, more={"word/header1.xml": header})
    d = read(data)
    assert [t["rows"] for t in d.tables] == [[["in"]], [["a\nb", "in"]]]
    assert texts(d) == ["p", "a b | in", "control", "Head"] and texts(d, "header") == ["Head"]
    places = [(b["is_image"], b["ord"]) for b in d.blocks]
    assert places[1][1] > places[2][1] and places[2][0]  # an image in a table stands after its text but is numbered before
    assert texts(read(data, include_headers=False)) == ["p", "a b | in", "control"]


def test_docx_bad_parts():
    d = read(fx.zipped({"word/document.xml": "<broken"}))
    assert d.blocks == [] and "unparseable XML" in d.warnings[0]
    d = read(fx.docx(fx.blip("rId1"), {"a.png": SCAN}, more={"word/_rels/x": ""}).replace(b"a.png", b"b.png", 0))
    assert len(images(d)) == 1


# Excel and PowerPoint


def test_xlsx():
    d = read(fx.xlsx({"Main": [["Field", "", "Value"], ["", ""], ["Name", "Ann & Bob", "", ""]], "Other": [["x"]]}, SCAN))
    assert d.sheet_names == ["Main", "Other"] and d.meta["sheet_count"] == "2"
    assert d.tables[0]["rows"] == [["Field", "", "Value"], ["Name", "Ann & Bob"]]
    assert texts(d) == ["[Main]\nField | Value\nName | Ann & Bob", "[Other]\nx"]
    assert images(d)[0]["section"] == "Main" and images(d)[0]["referenced"]
    one = read(fx.xlsx({f"S{i}": [[str(i)]] for i in range(5)}), max_pages=2)
    assert one.meta["sheet_count"] == "2" and len(one.tables) == 2
    assert not images(read(fx.xlsx({"S": [["x"]]}, SCAN), embedded_images=False))


def test_xlsx_cells_and_caps():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<c t="inlineStr"><is><t>in</t><t>line</t></is></c><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c t="s"><v>99</v></c><c t="s"><v>-1</v></c><c><v>4.5</v></c><c/>'
    sheet = f"<worksheet {ns}><sheetData><row>{cells}</row><row/>" + "<row><c><v>1</v></c></row>" * 2100 + "<row>" + "<c><v>2</v></c>" * 70 + "</row></sheetData></worksheet>"
    d = read(fx.zipped({"xl/workbook.xml": f"<workbook {ns}/>", "xl/worksheets/sheet10.xml": sheet, "xl/worksheets/sheet9.xml": f"<worksheet {ns}><row>" + "<c><v>2</v></c>" * 70 + "</row></worksheet>"}))
    assert d.sheet_names == ["sheet9", "sheet10"] and len(d.tables[0]["rows"][0]) == 64
    assert d.tables[1]["rows"][0] == ["inline", "TRUE", "FALSE", "", "", "4.5"] and len(d.tables[1]["rows"]) == 1999
    assert d.warnings == ["sheet 'sheet10' exceeded 2000 rows; text layer truncated"]


def test_pptx():
    d = read(fx.pptx([(["Title", "Point"], SCAN), *[([f"s{i}"], None) for i in range(2, 12)]], {1: "Say hello"}))
    assert texts(d)[:3] == ["Title\nPoint", "Say hello", "s2"] and texts(d, "notes") == ["Say hello"]
    assert [b["page"] for b in d.blocks if not b["is_image"]] == [1, 1, *range(2, 12)] and d.blocks[0]["section"] == "slide1"
    assert images(d)[0]["page"] == 1
    capped = read(fx.pptx([(["a"], None), (["b"], SCAN)]), max_pages=1)
    assert capped.meta["slide_count"] == "1" and [b["referenced"] for b in images(capped)] == [False]


# OpenDocument and RTF


def test_odf():
    d = read(fx.odf(["Hello"], [["a", "b"], ["", ""]], SCAN))
    assert d.kind == "odt" and d.meta["author"] == "Clerk" and d.tables[0]["rows"] == [["a", "b"]]
    assert texts(d) == ["Hello", "a | b", "a", "b"] and images(d)[0]["name"] == "scan.png"
    assert texts(read(fx.odf([], [["a"]], kind="spreadsheet")), "sheet") == ["a"]
    loose = read(fx.zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "<x", "Pictures/p.png": SCAN}))
    assert "content.xml: unreadable" in loose.warnings[0] and not images(loose)[0]["referenced"]


def test_odf_repeats():
    from xml.etree import ElementTree as ET

    from foliospark.sources.readers.odf import table_rows

    ns = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    row = '<table:table-row><table:table-cell table:number-columns-repeated="3">x</table:table-cell><table:table-cell table:number-columns-repeated="900"/><table:table-cell table:number-columns-repeated="99">y</table:table-cell></table:table-row>'
    rows = table_rows(ET.fromstring(f"<table:table {ns}>{row}</table:table>"))
    assert rows == [["x"] * 3 + [""] + ["y"] * 33]


def test_rtf():
    d = read(fx.rtf(["José Muñoz 😀 {x} \\y", LINE], SCAN))
    assert texts(d)[0].split("\n")[0] == "José Muñoz 😀 {x} \\y" and len(texts(d)[0]) < 500
    assert d.blobs[images(d)[0]["sha256"]] == SCAN and images(d)[0]["name"] == "pict1.png"
    assert "Times" not in texts(d)[0]
    raw = b"{\\rtf1 a\\'e9b\\tab c\\line d{\\stylesheet{\\s0 N;}}{\\pict\\jpegblip\\bin4 \x01}{\x02}e}"
    assert texts(read(b"{\\rtf1 a\\'e9b\\tab c\\line d{\\stylesheet{\\s0 N;}} \\u-10179?\\u-8704?}")) == ["aéb\tc\nd  😀"]
    assert images(read(raw))[0]["mime"] == "image/jpeg"
    assert len(texts(read(fx.rtf(["x"], SCAN), embedded_images=False))[0]) > 500


# HTML and text


def test_html():
    page = "<html><head><title> A &amp; B </title><meta charset=utf-8><style>p{}</style></head><body><script>no()</script><p>Hello</p><div>wide   space</div><table><tr><th>k<th>v</tr><tr><td>1</td><td>2</td></tr><tr><td></td></tr></table>"
    page += "<img src='data:image/png;base64,iVBORw0KGgo='><img src='pics/a%20b.png?x=1'><img src='pics/a%20b.png?x=1'><img src='../up.png'><img src='https://e.org/x.png'><img src='none.png'></body></html>"
    d = read(page, siblings={"pics/a b.png": SCAN})
    assert d.kind == "html" and d.meta == {"title": "A & B", "media_count": "2"}
    assert texts(d)[0].startswith("Hello\n\nwide space") and "no()" not in texts(d)[0]
    assert d.tables[0]["rows"] == [["1", "2"]] or d.tables[0]["rows"][-1] == ["1", "2"]
    assert [b["name"] for b in images(d)] == ["inline1", "a b.png"]
    assert d.warnings == ["image path escapes the document folder: ../up.png", "remote image not fetched: https://e.org/x.png", "referenced image not found on disk: none.png"]
    assert texts(read(page, compat_meta=True)) == [] and read(page, compat_meta=True).meta["title"] == "A & B"


def test_references_without_semicolon():
    page = "<title>a &amp; b &amp</title><p>&lt;x&gt; &ampy; &notit; &#38; &#38 &eacute &x; &\ue000<img src='data:,a&amp;b&lt'>"
    loose, strict = read(page, "a.html"), read(page, "a.html", loose_references=False)
    assert loose.meta["title"] == "a & b &" and strict.meta["title"] == "a & b &amp"
    assert texts(loose) == ["<x> &y; ¬it; & & é &x; &\ue000"] and texts(strict) == ["<x> &ampy; &notit; & &#38 &eacute &x; &\ue000"]
    assert [list(d.blobs.values()) for d in (loose, strict)] == [[b"a&b<"], [b"a&b&lt"]]


def test_charsets():
    assert texts(read('<p>é<meta charset="latin-1">'.encode("latin-1"), "a.html")) == ["é"]
    assert texts(read("﻿<p>ü".encode(), "a.html")) == ["ü"]
    assert texts(read("<p>x<meta charset=nonsense>é", "a.html")) == ["xé"]


def test_text_and_tables():
    assert texts(read("  \n hello \n", "a.txt")) == ["hello"]
    d = read("a;b;c\n1;;3\n;;\n", "t.csv")
    assert d.tables[0]["rows"] == [["a", "b", "c"], ["1", "", "3"]] and texts(d, "table") == ["a | b | c\n1 |  | 3"]
    assert read("a,b\tc\n", "t.tsv").tables[0]["rows"] == [["a,b", "c"]]
    assert read("", "t.csv").blocks == []


# containers


def test_email():
    d = read(fx.eml("Papers", LINE, {"cert.docx": fx.docx(fx.para("hi")), "../../scan.png": SCAN, "Thumbs.db": b"x", "bad.docx": b"PK\x03\x04zz"}))
    assert d.meta["subject"] == "Papers" and d.meta["attachment_count"] == "2"
    assert texts(d, "subject")[0].startswith("From: a@example.org\nTo: b@example.org\nSubject: Papers\nDate: ") and texts(d, "paragraph") == [LINE.strip()]
    assert [(c.origin, c.kind) for c in d.children] == [("cert.docx", "docx"), ("scan.png", "image")]
    assert d.warnings == ["bad.docx: skipped (UnsupportedFormat: bad.docx: detected unknown, which has no registered backend)"]


def test_archive():
    d = read(fx.zipped({"x/good.txt": LINE, "x/": "", "../../escaped.txt": "e", "broken.docx": b"PK\x03\x04", ".hidden": "h", "x/.DS_Store": "d", "mystery.msg": b"\0\1", "bomb.txt": b"0" * 2_000_000}), "a.zip")
    assert [(c.origin, c.name, c.kind) for c in d.children] == [("x/good.txt", "good.txt", "text"), ("../../escaped.txt", "escaped.txt", "text")]
    assert any("compression ratio over 200:1" in w for w in d.warnings) and any("extract-msg" in w for w in d.warnings) and any(w.startswith("broken.docx: skipped") for w in d.warnings)
    many = read(fx.zipped({f"{i:03}.txt": "x" for i in range(205)}), "a.zip")
    assert len(many.children) == 200 and "more than 200 files" in many.warnings[0]


def test_nesting_stops():
    data = fx.zipped({"deep.txt": "x"})
    for i in range(5):
        data = fx.zipped({f"z{i}.zip": data})
    d, depth = read(data, "top.zip"), 0
    while d.children:
        d, depth = d.children[0], depth + 1
    assert depth == 3 and d.warnings == ["nesting depth 3 reached; members not opened"]


def test_rows_of_a_tree():
    rows = read(fx.zipped({"a.txt": "x", "in.zip": fx.zipped({"b.txt": "y"})}), "t.zip").rows("root", "root")
    assert [(r["doc_id"], r["parent_id"], r["child_path"], r["n_children"]) for r in rows] == [("root", None, [], 2), ("root#0", "root", [0], 0), ("root#1", "root", [1], 1), ("root#1.0", "root#1", [1, 0], 0)]


def test_registered_readers_win(monkeypatch):
    monkeypatch.setitem(readers.REGISTERED, "text", lambda data, name, options, depth: Draft(name, "text", warnings=["mine"]))
    assert read("x", "a.txt").warnings == ["mine"]
    assert "text" in readers.supported_kinds() and len(readers.supported_kinds()) == 16


def test_missing_programs_are_named():
    from foliospark.errors import MissingDependency
    from foliospark.sources.readers import optional

    if optional.soffice() is None:
        with pytest.raises(MissingDependency, match="LibreOffice"):
            optional.to_pdf(b"x", "a.doc")
        assert not optional.can_render("docx")
    with pytest.raises(ValueError, match="prepare_all"):
        optional.render_pages(b"", "a.zip", "archive")
