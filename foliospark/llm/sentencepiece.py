"""SentencePiece encoding and decoding over a table of distinct chunks.

White space becomes the marker U+2581 before segmentation. If no piece of the
vocabulary has a marker after another character, no piece crosses from the
end of a word into the next marker, and a text may be cut before every run of
markers: each distinct marked word is segmented once, entered in a table with
its ids and its decoded text, and every text takes its words' entries by
position. Workers keep a table each, bounded by ``TABLE_CHUNKS`` entries, and
start a new one when it is full; nothing is shuffled.

A vocabulary that fails the test, or that normalises texts, is refused:
``crosses_markers`` says so before any row is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import by_bytes, map_batches

MARK = "▁"
TABLE_CHUNKS = 400_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_PROBES = ("a  b", " a", "ﬁ ½ Ａ", "é  x", "a\tb\nc ")


def load(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def crosses_markers(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether words may not be segmented apart: pieces cross markers, or texts are normalised."""
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or any(sp.normalize(t) != MARK + t.replace(" ", MARK) for t in _PROBES)


class ChunkTable:
    """Marked word -> (number of ids, its ids as decimal text, its decoded text).

    The decoded text is that of a word inside a text: its markers are spaces.
    """

    def __init__(self, sp: sentencepiece.SentencePieceProcessor, size: int = TABLE_CHUNKS) -> None:
        self.sp, self.size = sp, size
        self.entries: dict[str, tuple[int, str, str]] = {}

    def learn(self, chunks: list[str]) -> None:
        """Segment words that are not in the table yet, each once."""
        # The library puts one marker before a text itself, and takes it away in decoding.
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        lone = [self.sp.piece_to_id(MARK)]  # of a lone marker the library would make no ids
        found = [ids or lone for ids in found]
        for chunk, ids, decoded in zip(chunks, found, self.sp.decode(found, num_threads=1)):
            self.entries[chunk] = (len(ids), ",".join(map(str, ids)), " " + decoded)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text its number of ids, its ids joined by commas, its decoded text."""
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = set().union(*cut)
        if len(self.entries) > self.size:
            self.entries = {}
        if new := [w for w in words if w not in self.entries]:
            self.learn(new)
        out = []
        for chunks in cut:
            rows = [self.entries[c] for c in chunks]
            out.append((sum(r[0] for r in rows), ",".join([r[1] for r in rows]), "".join([r[2] for r in rows])[1:]))
        return out


def encode_decode(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids, decoded`` if ``keep_ids``.

    ``model`` is the path of a model file that every executor can read.

    Defined results: null and empty texts have no ids and decode to an empty
    text; every row gives a row, repeated ones too; a null id stays null; an
    empty table gives an empty result; further columns are not read.
    """
    if crosses_markers(load(model)):
        raise ValueError("words cannot be segmented apart with this vocabulary")
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(load(model))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in by_bytes(batch, 1, 4 << 20, 256):
                rows = known.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([sha(i) for _, i, _ in rows], pa.string()), pa.array([sha(d) for *_, d in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array([list(map(int, i.split(","))) if i else [] for _, i, _ in rows], pa.list_(pa.int32())), pa.array([d for *_, d in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).transform(map_batches, run, schema)
