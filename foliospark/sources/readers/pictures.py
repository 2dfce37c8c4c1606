"""Image files: one block each; TIFF pages one by one where Pillow is there."""

from __future__ import annotations

import io
import posixpath

from foliospark.sources.draft import Draft, Options, Picture, picture


def read_image(data: bytes, name: str, options: Options, depth: int) -> Draft:
    draft = Draft(name, "image")
    whole = picture(data, posixpath.basename(name), page=1)
    if whole.mime == "image/heic":
        try:
            from pillow_heif import register_heif_opener

            register_heif_opener()
        except ImportError:
            draft.warnings.append("HEIC input and pillow-heif is not installed; the bytes are passed through unconverted and most vision APIs will reject them. Install with: pip install pillow-heif")
    frames = _frames(data, draft) if whole.mime == "image/tiff" else []
    for image in frames or [whole]:
        draft.add_picture(image)
    if frames:
        draft.meta["page_count"] = str(len(frames))
    return draft


def _frames(data: bytes, draft: Draft) -> list[Picture]:
    """Each frame of a TIFF as a PNG; none if it cannot be split here."""
    try:
        from PIL import Image, ImageSequence
    except ImportError:
        draft.warnings.append("TIFF input and Pillow is not installed; multi-page files will be truncated to the first page by downstream consumers. Install with: pip install pillow")
        return []
    out = []
    try:
        with Image.open(io.BytesIO(data)) as tiff:
            for n, frame in enumerate(ImageSequence.Iterator(tiff), 1):
                held = io.BytesIO()
                frame.convert("RGB").save(held, "PNG")
                out.append(Picture(held.getvalue(), f"page{n}.png", "image/png", page=n, source="rendered"))
    except Exception as e:
        draft.warnings.append(f"TIFF pages could not be split ({e})")
        return []
    return out
