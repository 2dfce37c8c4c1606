"""Rich text: its words, and the pictures written into it."""

from __future__ import annotations

import binascii
import re
from dataclasses import dataclass, field

from foliospark.sources.draft import Draft, Options, Picture

# Destinations whose groups hold no text, and kinds of pictures.
_NO_TEXT = (
    "fonttbl", "colortbl", "stylesheet", "info", "listtable", "listoverridetable", "revtbl", "rsidtbl", "generator", "themedata", "colorschememapping", "latentstyles",
    "datastore", "xmlnstbl", "upr", "mmathPr", "pntext", "pntxta", "pntxtb", "atrfstart", "atrfend", "annotation", "nesttableprops",
)
_BLIPS = {"pngblip": ("image/png", ".png"), "jpegblip": ("image/jpeg", ".jpg"), "emfblip": ("image/x-emf", ".emf"), "wmetafile": ("image/x-wmf", ".wmf"), "dibitmap": ("image/bmp", ".bmp"), "wbitmap": ("image/bmp", ".bmp")}
_BREAKS = {b"par": "\n", b"line": "\n", b"sect": "\n", b"page": "\n", b"tab": "\t", b"cell": "\t"}
#: One token: a unicode character, a byte in hex, a control word with its number, an escaped byte, a brace or a run of plain bytes.
_TOKEN = re.compile(rb"\\u(?P<code>-?\d+)\s?\??|\\'(?P<byte>[0-9a-fA-F]{2})|\\(?P<word>[a-zA-Z]+)(?P<number>-?\d+)?[ ]?|\\(?P<escaped>.?)|(?P<brace>[{}])|(?P<plain>[^\\{}]+)", re.S)


@dataclass
class Group:
    """What stands between two braces: tokens and inner groups, in order."""

    items: list[tuple[str, bytes] | Group] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    binary: bytes | None = None

    def textless(self) -> bool:
        """Whether it begins with a destination without text; names match by their first letters, as readers of the format do."""
        first = next((x for x in self.items if isinstance(x, Group) or x not in (("escaped", b"*"),) and x[1].strip()), None)
        return isinstance(first, tuple) and first[0] == "word" and first[1].decode().startswith(_NO_TEXT)

    def pictured(self) -> bool:
        return any(w.startswith("pict") for w in self.words)


def groups_of(data: bytes) -> Group:
    """The document as nested groups; bytes after a word ``bin`` belong to it, whatever they are."""
    root = Group()
    open_, at = [root], 0
    while m := _TOKEN.match(data, at):
        at, kind, here = m.end(), m.lastgroup, open_[-1]
        if kind == "brace":
            if m[0] == b"{":
                open_.append(Group())
                here.items.append(open_[-1])
            elif len(open_) > 1:
                open_.pop()
            continue
        if m["word"] is not None:
            here.words.append(m["word"].decode())
            kind = "word"
            if m["word"] == b"bin" and int(m["number"] or 0) > 0:
                here.binary = data[at : at + int(m["number"])]
                at += int(m["number"])
        here.items.append((kind, m[kind]))
    return root


def read_rtf(data: bytes, name: str, options: Options, depth: int) -> Draft:
    draft = Draft(name, "rtf")
    root = groups_of(data)
    if text := plain_text(root, options.embedded_images).strip():
        draft.add_text(text, "paragraph")
    count = 0
    for group in pictures(root) if options.embedded_images else ():
        if payload := picture_bytes(group):
            count += 1
            mime, suffix = next((_BLIPS[w] for w in _BLIPS if w in all_words(group)), ("application/octet-stream", ".bin"))
            draft.add_picture(Picture(payload, f"pict{count}{suffix}", mime))
    draft.meta["media_count"] = str(count)
    return draft


def pictures(root: Group) -> list[Group]:
    """Groups with a picture, in order; those inside another are its own."""
    found, waiting = [], [root]
    while waiting:
        group = waiting.pop()
        if group.pictured():
            found.append(group)
        else:
            waiting += [x for x in reversed(group.items) if isinstance(x, Group)]
    return found


def all_words(group: Group) -> set[str]:
    return set(group.words).union(*(all_words(x) for x in group.items if isinstance(x, Group)))


def picture_bytes(group: Group) -> bytes:
    """Raw bytes after a ``bin`` word, else what the group's own plain bytes say in hex."""
    if group.binary is not None:
        return group.binary
    digits = re.sub(rb"[^0-9a-fA-F]", b"", b"".join(x[1] for x in group.items if isinstance(x, tuple) and x[0] == "plain"))
    return binascii.unhexlify(digits[: len(digits) & ~1]) if len(digits) >= 16 else b""


def _character(kind: str, said: bytes) -> str:
    """What a token adds to the text."""
    if kind == "code":
        code = int(said)
        code += 65536 if code < 0 else 0
        return chr(code) if 0 <= code < 0x110000 else ""
    if kind == "word":
        return _BREAKS.get(said, "")
    raw = binascii.unhexlify(said) if kind == "byte" else said
    return raw.decode("latin-1") if kind == "escaped" else raw.decode("cp1252", "replace")


def plain_text(root: Group, without_pictures: bool) -> str:
    """The text of all groups in order; one without text, or a picture's, leaves a space."""
    out: list[str] = []
    waiting: list = [root]
    while waiting:
        x = waiting.pop()
        if isinstance(x, tuple):
            out.append(_character(*x))
        elif x.textless() or without_pictures and x.pictured():
            out.append(" ")
        else:
            waiting += reversed(x.items)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out)))
