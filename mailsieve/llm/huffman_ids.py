"""Token ids in files: canonical length-limited Huffman codes from global counts.

``write_token_files`` encodes texts (each distinct word once per task), counts ids over all
documents, derives one canonical code with lengths up to ``MAX_BITS`` (package-merge), and
writes documents in ascending id order as independent blocks. A row of the block table is one
block: the document ids and sizes, the bits, and the bit offset of every ``STRIDE``-th id. A
reader needs the code lengths and any one block; it decodes all strides of a block at once with
a table over the next ``MAX_BITS`` bits. ``read_token_files`` gives the documents back with the
number of ids before each.

The folder holds ``codes`` (id, bits) and ``blocks``; Spark writes and commits both, so lost
executors only repeat tasks. The driver sees at most one count per vocabulary entry. Blocks
close behind the document that fills them: a block is as long as ``BLOCK_IDS``, or one longer
document.

Defined cases: a null text is the empty text (only its end id is stored); null ids come first;
repeated document ids are all kept, ordered by a hash of their ids; an empty table gives empty
files. Other columns are not stored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsieve.llm.common import slices, written

MAX_BITS = 18
STRIDE = 128
BLOCK_IDS = 1 << 16
TABLE_ROWS = 500_000
_WORDS_AT_ONCE = 2000
_COUNT_AT_ONCE = 1 << 20
_LONG_WORD = 80
_LONG_HELD = 1 << 20  # characters of longer words that a table may hold
_SLICE_BYTES = 6 << 20


# Whether the tokenizer always ends a pre-token between two bytes: a letter and a mark, in either order. The
# apostrophe is left out, as it may go with the letters behind it.
_KIND = np.zeros(256, np.int8)
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_KIND[[b for b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = -1
_PLAIN = re.compile("[a-z]+")


def parted(texts: pa.StringArray) -> pa.StringArray:
    """Texts with a space put between ASCII letters and marks that stand side by side."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return texts
    flat = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[flat]
    at = np.flatnonzero(kind[1:] * kind[:-1] < 0) + 1
    moved = offsets + np.searchsorted(at, offsets, side="left")
    longer = np.insert(flat, at, ord(" "))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved.astype(np.int32)), pa.py_buffer(longer))


class WordTable:
    """Ids of distinct words; words are what stands between ASCII white space.

    The tokenizer turns white space into nothing but a boundary, so the ids of a text are
    those of its words in order. It also ends a pre-token between a letter and a mark; parted there, a
    text has far fewer different words. Plain words are one pre-token each and go to its model directly."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.long = 0  # characters of long words in the table

    def add(self, words: list[str]) -> None:
        plain = [w for w in words if len(w) <= _LONG_WORD and _PLAIN.fullmatch(w)]
        known, tokenize = set(plain), self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in plain]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        words = [w for w in words if w not in known]
        # Some words at a time: the library's time grows faster than a long text.
        all_sizes, all_ids = [self.sizes, sizes], [self.ids, flat]
        for at in range(0, len(words), _WORDS_AT_ONCE):
            part = words[at : at + _WORDS_AT_ONCE]
            found = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            begins = np.fromiter(map(len, part), np.int64, len(part)) + 1
            begins = np.cumsum(begins) - begins
            places = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            own = np.searchsorted(begins, places, side="right") - 1
            all_sizes.append(np.bincount(own, minlength=len(part)))
            all_ids.append(np.array(found.ids, np.uint32))
        words = plain + words
        self.at.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.sizes, self.ids = np.concatenate(all_sizes), np.concatenate(all_ids)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in order."""
        # The tokenizer lower-cases; doing so first makes words fewer. Its special strings are
        # recognised before that and only as they are written.
        special = pc.match_substring(texts, "<|")
        lists = pc.ascii_split_whitespace(pc.if_else(special, texts, parted(pc.ascii_lower(texts))))
        words = lists.flatten().dictionary_encode()
        if len(self.at) > TABLE_ROWS:
            self.clear()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)  # far faster than a list of scalars
        place = np.fromiter(map(self.at.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        fresh = distinct[new].tolist()
        if fresh:
            self.add(fresh)
            place[new] = np.fromiter(map(self.at.__getitem__, fresh), np.int64, len(fresh))
        at = place[words.indices.to_numpy()]
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = np.diff(ends[edges]), self.ids[take]
        self.long += sum(len(w) for w in fresh if len(w) > _LONG_WORD)
        if self.long > _LONG_HELD:
            self.clear()
        return out


class _Cells:
    """Ids of a document between the passes: 16 or 32 bits each, compressed."""

    def __init__(self):
        self.compressor, self.decompressor = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, ids: np.ndarray) -> bytes:
        narrow = not len(ids) or int(ids.max()) < 1 << 16
        return (b"2" if narrow else b"4") + self.compressor.compress(ids.astype("<u2" if narrow else "<u4").tobytes())

    def unpack(self, cell: bytes) -> np.ndarray:
        return np.frombuffer(self.decompressor.decompress(cell[1:]), "<u" + cell[:1].decode()).astype("<u4")


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, ids``: ids with the end id behind them, narrowed and compressed by ``_Cells``."""
    with open(tokenizer_path) as f:
        model = f.read()
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
        table, packed = WordTable(Tokenizer.from_str(model)), _Cells()
        for part in slices(batches, "text", _SLICE_BYTES):
            counts, ids = table.encode(pc.fill_null(part.column("text"), ""))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends = ends + np.arange(1, len(ends) + 1)
            cells = [packed.pack(ids[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cells, pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(encode, "doc_id bigint, ids binary")


def id_counts(ids: DataFrame) -> DataFrame:
    """``id, n`` over all documents; tasks count before the shuffle."""

    def add(total: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        found = np.bincount(np.concatenate([*held, np.zeros(0, np.uint32)]), minlength=len(total))
        found[: len(total)] += total
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, packed, held, size = np.zeros(0, np.int64), _Cells(), [], 0
        for batch in batches:
            for cell in batch.column("ids").to_pylist():
                held.append(packed.unpack(cell))
                size += len(held[-1])
                if size >= _COUNT_AT_ONCE:
                    total, held, size = add(total, held), [], 0
        total = add(total, held)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < n)
        merged = merged[place]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: shorter ones first, equal lengths in the order of ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        widths = np.int64(1) << (MAX_BITS - self.lengths)
        first = np.cumsum(widths) - widths  # codes, filled up with zeros to MAX_BITS
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = (first >> (MAX_BITS - self.lengths)).astype(np.uint64)
        self.bits[self.ids] = self.lengths
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.width = np.ones(1 << MAX_BITS, np.uint8)
        used = int(widths.sum())
        self.symbol[:used] = np.repeat(self.ids, widths)
        self.width[:used] = np.repeat(self.lengths, widths)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, and the bit offset of every ``STRIDE``-th one."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        offsets = ends - bits
        if not len(ids):
            return b"", offsets
        # Each code touches one or two 64-bit words; codes that share a word are or-ed together.
        word, shift = offsets >> 6, 64 - (offsets & 63) - bits
        high = np.where(shift >= 0, self.code[ids] << np.maximum(shift, 0).astype(np.uint64), 0)
        over = np.maximum(-shift, 0).astype(np.uint64)
        high = np.where(shift < 0, self.code[ids] >> over, high)
        low = np.where(shift < 0, self.code[ids] << (np.uint64(64) - np.maximum(over, 1)), 0)
        out = np.zeros((int(ends[-1]) + 63 >> 6) + 1, np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(high, starts)
        spill = np.flatnonzero(shift < 0)
        out[word[spill] + 1] |= low[spill]
        return out.astype(">u8").tobytes()[: int(ends[-1]) + 7 >> 3], offsets[::STRIDE]

    def unpack(self, data: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        """The ids of a block; all strides are decoded side by side."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, last = offsets.astype(np.int64), len(window) - 1
        out = np.empty((STRIDE, len(offsets)), np.uint32)
        for step in range(min(STRIDE, count)):
            here = window[np.minimum(at >> 3, last)] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)
            entry = here & np.uint32((1 << MAX_BITS) - 1)
            out[step] = self.symbol[entry]
            at += self.width[entry]
        return out.T.reshape(-1)[:count]


_BLOCKS = "part int, block int, doc_ids array<bigint>, sizes array<int>, bits binary, checkpoints array<bigint>"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    spark = docs.sparkSession
    ids = written(encode_ids(docs, tokenizer_path, end_id, id_column, text_column), "ids")
    found = sorted(id_counts(ids).collect())  # at most one row per vocabulary entry
    used = np.array([r[0] for r in found], np.int64)
    lengths = code_lengths(np.array([r[1] for r in found], np.int64))
    table = [(int(i), int(n)) for i, n in zip(used, lengths, strict=True)]
    spark.createDataFrame(table, "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codes")
    # The second key splits a document id that is repeated very often.
    keys = ("doc_id", "_tie")
    ranged = ids.withColumn("_tie", F.xxhash64("ids")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packed, part, number = Code(used, lengths), _Cells(), TaskContext.get().partitionId(), 0
        docs_held, cells, held = [], [], 0

        def block() -> pa.RecordBatch:
            bits, checkpoints = code.pack(np.concatenate(cells).astype(np.int64))
            sizes = [len(c) for c in cells]
            row = [part], [number], [docs_held], [sizes], [bits], [checkpoints.tolist()]
            kinds = pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64())
            names = ["part", "block", "doc_ids", "sizes", "bits", "checkpoints"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs_held.append(doc)
                cells.append(packed.unpack(cell))
                held += len(cells[-1])
                if held >= block_ids:
                    yield block()
                    docs_held, cells, held, number = [], [], 0, number + 1
        if docs_held:
            yield block()

    ranged.select("doc_id", "ids").mapInArrow(pack, _BLOCKS).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids``: ids as little-endian unsigned 32-bit integers, behind ``start`` others."""
    found = spark.read.parquet(f"{path}/codes").collect()  # at most one row per vocabulary entry
    used = np.array([r.id for r in found], np.int64)
    lengths = np.array([r.bits for r in found], np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    held = blocks.select("part", "block", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, s: a + s).alias("n"))
    # Parts are numbered in document order. One row per part: few, and of known size.
    parts = held.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    within = held.select("part", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_within"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(used, lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ids = code.unpack(row["bits"], np.array(row["checkpoints"], np.int64), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                cells = [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                n = len(cells)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes), pa.array(cells, pa.binary()),
                    ],
                    ["part", "block", "doc_id", "_in_block", "ids"],
                )

    rows = blocks.mapInArrow(unpack, "part int, block int, doc_id bigint, _in_block bigint, ids binary")
    return (
        rows.join(F.broadcast(parts), "part")
        .join(within, ["part", "block"])
        .select("doc_id", (F.col("_before") + F.col("_within") + F.col("_in_block")).alias("start"), "ids")
    )


def crc32(ids: np.ndarray) -> int:
    """The checksum that the query derives natively, for tests."""
    return zlib.crc32(ids.astype("<u4").tobytes())
