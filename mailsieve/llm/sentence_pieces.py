"""SentencePiece encoding and decoding over a table of distinct marked words.

A text is a run of chunks: white-space markers followed by what stands up to the next marker.
If no piece of the vocabulary continues into a marker, no merge crosses a chunk boundary, and
a text's ids are the ids of its chunks in order. Each task keeps a table of the distinct chunks
it has met, lets the library segment each once, and joins ids and decoded words back by
position. The table is bounded: it starts anew when it holds ``TABLE_ROWS`` chunks, and chunks
longer than ``LONG_CHUNK`` characters stay out of it.

No shuffle; a lost executor costs its tasks. Defined cases: a null text is the empty text and
has no ids; other columns are passed through, and a column named like an added one is replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from mailsieve.llm.common import slices

MARK = "▁"
TABLE_ROWS = 200_000
LONG_CHUNK = 80
_SLICE_BYTES = 2 << 20
_DIGEST_BYTES = 512 << 10
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The library's processor; an error if its pieces or its rules let chunks touch each other."""
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = library.id_to_piece(list(range(library.get_piece_size())))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces of this vocabulary cross white-space markers")
    probe = " a  Åb\n c "
    if library.decode(library.encode(probe)) != probe:
        raise ValueError("this vocabulary's normalisation changes texts")
    return library


class ChunkTable:
    """Distinct chunks with their ids (one flat array) and decoded words."""

    def __init__(self, library: sentencepiece.SentencePieceProcessor, rows: int = TABLE_ROWS):
        self.library, self.rows, self.mark = library, rows, library.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.words: list[str] = []
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, chunks: list[str]) -> None:
        # The library puts a marker of its own in front; a lone marker has nothing behind it.
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        found = [ids if ids else [self.mark] for ids in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes) + len(self.ids)
        self.at.update(zip(chunks, range(len(self.words), len(self.words) + len(chunks)), strict=True))
        self.words.extend(" " + word for word in self.library.decode(found, num_threads=1))
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Number of ids of each text, all ids in order, and decoded texts."""
        chunks = [_CHUNK.findall(f" {t}") if t else [] for t in texts]
        if len(self.at) > self.rows:
            self.clear()
        fresh = set(itertools.chain.from_iterable(chunks)).difference(self.at)
        if fresh:
            self.add(sorted(fresh))
        per_text = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(
            map(self.at.__getitem__, itertools.chain.from_iterable(chunks)), np.int64, int(per_text.sum())
        )
        words = self.words
        decoded = ["".join([words[self.at[c]] for c in own])[1:] for own in chunks]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)
        edges = np.concatenate([[0], np.cumsum(per_text)])
        counts = np.diff(np.concatenate([[0], ends])[edges])
        if any(len(c) > LONG_CHUNK for c in fresh):
            ids = self.ids[take]
            self.clear()
            return counts, ids, decoded
        return counts, self.ids[take], decoded


def encode_pieces(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` (all ids) and ``decoded`` (the text they decode to)."""
    with open(model_path, "rb") as f:
        model = f.read()
    load(model)
    rest = [c for c in docs.columns if c not in (text_column, "ids", "decoded")]
    rows = docs.select(*[f"`{c}`" for c in rest], f"`{text_column}`")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "ids array<int>", "decoded string"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(load(model))
        for part in slices(batches, text_column, _SLICE_BYTES):
            texts = [t or "" for t in part.column(text_column).to_pylist()]
            counts, ids, decoded = table.encode(texts)
            edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(edges, pa.array(ids))
            kept = [part.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays(
                [*kept, lists, pa.array(decoded, pa.string())], names=[*rest, "ids", "decoded"]
            )

    return rows.mapInArrow(encode, schema)


def piece_digests(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256``. Ids and decoded texts stay in the task, which holds small slices of texts at a time."""
    with open(model_path, "rb") as f:
        model = f.read()
    load(model)
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    rest = [c for c in docs.columns if c != text_column and c not in added]
    rows = docs.select(*[f"`{c}`" for c in rest], f"`{text_column}`")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | added
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*rest, *added])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(load(model))
        for part in slices(batches, text_column, _DIGEST_BYTES):
            texts = [t or "" for t in part.column(text_column).to_pylist()]
            counts, ids, decoded = table.encode(texts)
            ends = np.cumsum(counts)
            joined = (",".join(map(str, ids[a:b].tolist())) for a, b in zip(ends - counts, ends, strict=True))
            columns = [
                pa.array(counts.astype(np.int64)),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in joined], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *columns], names=[*rest, *added])

    return rows.mapInArrow(digest, schema)
