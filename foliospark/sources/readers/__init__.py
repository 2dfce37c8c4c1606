"""Readers by kind: ``read(data, name, options, depth) -> Draft``.

Each takes bytes and a name, never a path, so that it runs on any executor.
Registered readers win over the built-in ones; the registry in use is
captured when a job is planned and travels with it.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from foliospark.errors import UnsupportedFormat
from foliospark.schema import KINDS
from foliospark.sources.draft import Draft, Options
from foliospark.sources.sniff import detect, unreadable_reason

Reader = Callable[[bytes, str, Options, int], Draft]

_MODULES = {
    **dict.fromkeys(("docx", "xlsx", "pptx"), "ooxml"), **dict.fromkeys(("odt", "ods", "odp"), "odf"), **dict.fromkeys(("doc", "xls", "ppt", "pdf"), "optional"),
    "rtf": "rtf", "html": "markup", "text": "markup", "image": "pictures", "email": "bundles", "archive": "bundles",
}
#: Readers that users registered, by kind.
REGISTERED: dict[str, Reader] = {}


def register(kind: str, reader: Reader) -> None:
    """Use ``reader`` for a kind in jobs planned from now on."""
    REGISTERED[kind] = reader


def supported_kinds() -> list[str]:
    return sorted({*KINDS, *REGISTERED})


def reader_for(kind: str, registered: dict[str, Reader]) -> Reader:
    if kind in registered:
        return registered[kind]
    return getattr(import_module(f"{__name__}.{_MODULES[kind]}"), f"read_{kind}")


def read(data: bytes, name: str, options: Options, depth: int = 0) -> Draft:
    """Detect and read one file; raises if there is no reader for it."""
    registered = REGISTERED if options.readers is None else options.readers
    kind = detect(data, name)
    if kind not in registered and kind not in _MODULES:
        raise UnsupportedFormat(f"{name}: {unreadable_reason(name) or f'detected {kind}, which has no registered backend'}")
    return reader_for(kind, registered)(data, name, options, depth)
