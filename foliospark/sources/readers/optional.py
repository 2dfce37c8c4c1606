"""PDF by PyMuPDF, and legacy Office files by way of LibreOffice, where they are installed."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from pathlib import Path

from foliospark import schema as S
from foliospark.errors import ConversionFailed, CorruptDocument, MissingDependency
from foliospark.sources.draft import Draft, Options, Picture

CONVERTIBLE = ("docx", "xlsx", "pptx", "doc", "xls", "ppt", "odt", "ods", "odp", "rtf", "html")
TIMEOUT = 180


def _mupdf():
    try:
        import fitz
    except ImportError:
        raise MissingDependency("PyMuPDF", "Install it with: pip install pymupdf") from None
    return fitz


def soffice() -> str | None:
    """The LibreOffice program, if it is installed here."""
    named = os.environ.get("FOLIOSPARK_SOFFICE")
    return named or shutil.which("soffice") or shutil.which("libreoffice")


def can_render(kind: str) -> bool:
    """Whether pages of this kind can be made into images in this process."""
    return kind in ("pdf", "image") or kind in CONVERTIBLE and soffice() is not None


def to_pdf(data: bytes, name: str) -> bytes:
    """A document as PDF; converters run with a profile and a folder of their own."""
    program = soffice()
    if program is None:
        raise MissingDependency("LibreOffice", "Install it and put soffice on the PATH, or set FOLIOSPARK_SOFFICE")
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder, "in" + Path(name).suffix)
        source.write_bytes(data)
        try:
            subprocess.run([program, f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "pdf", "--outdir", folder, str(source)], timeout=TIMEOUT, check=True, capture_output=True)
        except (subprocess.SubprocessError, OSError) as e:
            raise ConversionFailed(f"{name}: {e}") from e
        made = source.with_suffix(".pdf")
        if not made.exists():
            raise ConversionFailed(f"{name}: the converter wrote no file")
        return made.read_bytes()


def read_pdf(data: bytes, name: str, options: Options, depth: int) -> Draft:
    fitz = _mupdf()
    draft = Draft(name, "pdf")
    try:
        book = fitz.open(stream=data, filetype="pdf")
    except Exception as e:
        raise CorruptDocument(f"{name} is not a readable PDF: {e}") from e
    with book:
        if book.needs_pass:
            raise CorruptDocument(f"{name} is password-protected")
        draft.meta.update({k: str(v) for k, v in (book.metadata or {}).items() if v})
        draft.meta["page_count"] = str(book.page_count)
        for n in range(book.page_count)[: options.max_pages]:
            page = book[n]
            if text := page.get_text().strip():
                draft.add_text(text, "page", page=n + 1)
            for ref in dict.fromkeys(i[0] for i in page.get_images(full=True)) if options.embedded_images else ():
                try:
                    found = book.extract_image(ref)
                except Exception as e:
                    draft.warnings.append(f"page {n + 1}: image {ref} could not be read ({e})")
                    continue
                suffix = found["ext"]
                draft.add_picture(Picture(found["image"], f"p{n + 1}-x{ref}.{suffix}", "image/" + {"jpg": "jpeg"}.get(suffix, suffix), page=n + 1))
    return draft


def _read_legacy(kind: str):
    def read(data: bytes, name: str, options: Options, depth: int) -> Draft:
        draft = read_pdf(to_pdf(data, name if Path(name).suffix else f"{name}.{kind}"), name, options, depth)
        draft.kind = kind
        draft.warnings.append(f"legacy {kind} was converted to PDF by LibreOffice before extraction; image bytes are re-encoded rather than original")
        return draft

    return read


read_doc, read_xls, read_ppt = map(_read_legacy, ("doc", "xls", "ppt"))


def render_pages(data: bytes, name: str, kind: str, dpi: int = S.RENDER_DPI, max_pages: int | None = None) -> list[Picture]:
    """Pages as PNG images."""
    if kind not in ("pdf", *CONVERTIBLE):
        hint = "; use prepare_all() on its members" if kind in S.CONTAINERS else ""
        raise ValueError(f"cannot render {kind}{hint}")
    pdf = data if kind == "pdf" else to_pdf(data, name)
    with _mupdf().open(stream=pdf, filetype="pdf") as book:
        return [Picture(book[n].get_pixmap(dpi=dpi).tobytes("png"), f"page{n + 1}.png", "image/png", page=n + 1, source="rendered") for n in range(book.page_count)[:max_pages]]
