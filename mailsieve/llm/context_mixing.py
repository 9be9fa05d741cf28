"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and one end. Every word is told bit by bit, along its Huffman code
over the frequent training words; all others are an escape in that code and then their bytes, eight
bits each, with a blank behind. Predictors of a code's bit: the counts of the code's node, and
hashed contexts of the node with the previous word, the two previous words, and the coarse
classes of both. Predictors of a byte's bit: the node with the last one, two, three, four and six bytes
of the word. Hashed contexts lead to counts of zeros and ones; the counts of four bits in a row lie
side by side. Predictions meet in the logistic
domain with weights chosen by how much two of the contexts have seen (the gates) and learned
online, in small steps along the training texts, where a bit never counts for itself.

1. Tasks count words; the counts meet in one table, as long as there are words.
2. At most ``FREQUENT`` of the most frequent training words, each seen twice or more, get codes,
   which are sent to all tasks; texts are written down as numbers of words, strangers apart.
3. Tasks count bits by slot; blocks of slots are added up in the shuffle. A table has two slots for
   each training token (texts) or eight for each distinct training word (spelling), rounded up to a
   power of two, but 2^``SLOT_BITS`` at most, since every task holds it (two bytes a slot).
   Spelling is counted once for each training word.
4. Weights are learned from all training texts and words, and are the mean over tasks.
5. Texts are scored; the price of escaped words, found once for each word, is joined. An escaped
   word is one of the training words without a code, by its count, or spelled; how often which,
   follows from how many words were seen once and how many a little more often (Good-Turing).

Defined cases: a null text is empty and costs its end; without training documents all counts
are 0 and the model is uniform over bits; null ids are trained on; other columns are ignored;
repeated rows count each time. ``bits_per_byte`` of an empty text is null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import slices, written
from mailsieve.llm.words import mix

SLOT_BITS = 22
FREQUENT = 1 << 19
WORD_CONTEXTS = 3
ORDERS = (1, 2, 3, 4, 6)
BLANK = b" "
SMOOTHING = 0.1  # of the base score
RATE = 0.1
_GATES = 64
_STEP = 4096  # bits per online step
_RANGE = 8192  # tokens or bytes whose bits are laid out side by side
_GROUP = 4  # bits whose slots lie side by side
_CLASSES = 8  # leading code bits that make a word's class
_STRANGERS = 1 << 16  # escaped words as contexts, by checksum
_DISTINCT = 1_500_000  # words counted together in a task
_SLICE_BYTES = 1 << 18  # of words to spell
_TEXT_BYTES = 1 << 22  # of texts whose words are counted or numbered at once
_TOKENS = 1 << 17  # of a slice of numbered texts
_TASK_TOKENS = 1 << 26  # counted by one task, which sends a whole table
_TASK_WORDS = 1 << 20
_BLOCK_BITS = 14
_EXACT, _FINE = 64, 7.6  # between tasks: counts told exactly, and steps per power of two beyond them
_COARSE = 12  # steps of counts per power of two in the tables
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words every text has, and the lower-cased words of all."""
    found = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
    words = found.flatten()
    real = pa.compute.not_equal(words, "")  # white space at the ends makes empty ones
    sums = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    edges = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(found).to_numpy())])
    return np.diff(sums[edges]), words.filter(real)


def _counted(docs: DataFrame) -> DataFrame:
    """``word, n, seen``: count in training and in all documents; the empty word is the end."""
    names = ["word", "n", "seen"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in slices(batches, "text", _TEXT_BYTES):
            for learned in (1, 0):
                texts = part.column("text").filter(pa.compute.equal(part.column("train"), bool(learned)))
                if len(texts):
                    found = _words(texts)[1].value_counts()
                    n = found.field("counts").to_numpy()
                    held.append(pa.Table.from_arrays([found.field("values"), pa.array(n * learned), pa.array(n)], names))
                    end = pa.array([""], found.field("values").type)
                    held.append(pa.Table.from_arrays([end, pa.array([len(texts) * learned]), pa.array([len(texts)])], names))
            if sum(map(len, held)) > _DISTINCT:
                held = [_summed(held)]
                if len(held[0]) > _DISTINCT // 2:
                    yield from held.pop().to_batches(100_000)
        if held:
            yield from _summed(held).to_batches(100_000)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    def _summed(held: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum"), ("seen", "sum")])
        return whole.select(["word", "n_sum", "seen_sum"]).rename_columns(names)

    counted = docs.select("text", "train").mapInArrow(count, "word string, n bigint, seen bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


@dataclass
class Code:
    """Huffman codes of the end (0), the escape (1) and frequent words (2 and on), laid end to end."""

    start: np.ndarray
    size: np.ndarray
    step: np.ndarray  # by bit: its node, the path to it inside its group of four bits, and its value
    prior: np.ndarray  # by node: log odds of a one
    kind: np.ndarray  # by word: its class, the first bits of its code
    tree: tuple[np.ndarray, ...]

    @property
    def bit(self) -> np.ndarray:
        return (self.step & 1).astype(np.uint8)

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        weight, parent, side = np.empty(2 * n - 1), np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        weight[:n] = counts[order]
        leaf, inner = 0, n
        for made in range(n, 2 * n - 1):
            total = 0.0
            for bit in (0, 1):
                if inner >= made or (leaf < n and weight[leaf] <= weight[inner]):
                    at, leaf = leaf, leaf + 1
                else:
                    at, inner = inner, inner + 1
                parent[at], side[at] = made, bit
                total += weight[at]
            weight[made] = total
        ones = np.zeros(2 * n - 1)
        ones[parent[:-1][side[:-1] == 1]] = weight[:-1][side[:-1] == 1]
        prior = np.log((ones + 0.5) / (weight - ones + 0.5)).astype(np.float32)
        return Code.laid(order.astype(np.int32), parent.astype(np.int32), side, prior[n:])

    @staticmethod
    def laid(order: np.ndarray, parent: np.ndarray, side: np.ndarray, prior: np.ndarray) -> Code:
        """From the tree: words by leaf, and every node's parent and side."""
        n = len(order)
        at, rounds = np.arange(n), []
        size = np.zeros(n, np.int64)
        while (open_ := at != 2 * n - 2).any():
            size += open_
            rounds.append((at, open_))
            at = np.where(open_, parent[at], at)
        start = np.cumsum(size) - size
        step = np.zeros(size.sum(), np.uint32)
        for back, (at, open_) in enumerate(rounds):
            place = (start + size - 1 - back)[open_]
            step[place] = (parent[at[open_]] - n) << 5 | side[at[open_]]
        kind, path = np.ones(n, np.int64), np.ones(n, np.uint32)
        for depth in range(len(rounds)):
            has = np.flatnonzero(size > depth)
            place = start[has] + depth
            bits = step[place] & 1
            if depth < _CLASSES:
                kind[has] = kind[has] * 2 + bits
            if depth % _GROUP == 0:
                path[has] = 1
            step[place] |= path[has] << 1
            path[has] = path[has] * 2 + bits
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)  # the leaf of every word
        return Code(start[back], size[back], step, prior, kind[back], (order, parent, side, prior))

    def __reduce__(self):
        return Code.laid, self.tree  # a tenth of the size; tasks lay the codes out again


@dataclass
class Bits:
    """Bits to tell, in runs of one token or byte each: where runs begin, what they belong to; by bit
    its value, its slots by context, and a prediction that needs no slot."""

    runs: np.ndarray
    owner: np.ndarray
    value: np.ndarray
    slots: list[np.ndarray]
    prior: np.ndarray | None


def _short(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(32)).astype(np.uint32)


def _slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of contexts, which are hashes already, with nodes, which are multiples of ``_A``. Four bits
    share one, whose last digits change with the path inside the four, so they lie side by side."""
    hashed = context ^ node
    hashed *= _B
    hashed >>= np.uint32(32 - bits)
    return hashed.astype(np.intp)


def code_bits(code: Code, ids: np.ndarray, first: np.ndarray, bits: int) -> Iterator[Bits]:
    """Bits of tokens, by ranges. ``ids``: words by code, strangers beyond them; ``first``: begins a text."""
    known = len(code.size)
    told = np.where(ids < known, ids, 1)
    kind = np.where(ids < known, code.kind[told], 0)

    def before(x: np.ndarray) -> np.ndarray:
        return np.where(first, 0, np.concatenate([x[:1] * 0, x[:-1]]))

    last, last_kind = before(ids), before(kind)
    second, second_kind = before(last), before(last_kind)
    hashes = [
        _short(mix((last.astype(np.uint64) << np.uint64(2)) + np.uint64(1))),
        _short(mix(((last << 26) + second).astype(np.uint64) * np.uint64(4) + np.uint64(2))),
        _short(mix(((last_kind << 26) + second_kind).astype(np.uint64) * np.uint64(4) + np.uint64(3))),
    ]
    for begin in range(0, len(ids), _RANGE):
        here = slice(begin, begin + _RANGE)
        size = code.size.take(told[here])
        runs = np.cumsum(size) - size
        at = np.repeat(code.start.take(told[here]) - runs, size)
        at += np.arange(len(at))
        step = code.step.take(at)
        prior = code.prior.take(step >> 5)
        value = step.astype(np.uint8) & 1
        path = (step >> 1 & 15).astype(np.intp)
        fours = (size + _GROUP - 1) // _GROUP
        ends = np.cumsum(fours)
        heads = np.arange(ends[-1]) * _GROUP
        heads += np.repeat(code.start.take(told[here]) - (ends - fours) * _GROUP, fours)
        node = (code.step.take(heads) >> 5) * _A
        widths = np.full(ends[-1], _GROUP)
        widths[ends - 1] = size - (fours - 1) * _GROUP
        slots = [np.repeat(_slots(np.repeat(h[here], fours), node, bits), widths) for h in hashes]
        for own in slots:
            own ^= path
        yield Bits(runs, np.arange(begin, begin + len(size)), value, slots, prior)


def spelled_bits(words: list[bytes], bits: int) -> Iterator[Bits]:
    """Bits of the bytes of words, each with its blank, by ranges."""
    flat = np.frombuffer(b"".join(w + BLANK for w in words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    wide = flat.astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = []
    for kind, order in enumerate(ORDERS):
        hashed = np.full(len(flat), kind + 1, np.uint64)
        for back in range(1, order + 1):
            far = np.full(len(flat), 256, np.uint64)
            far[back:] = np.where(place[back:] >= back, wide[:-back], 256)
            hashed = hashed * np.uint64(0x100000001B3) + far
        hashes.append(_short(mix(hashed)))
    depth = np.arange(8)
    for begin in range(0, len(flat), _RANGE):
        here = slice(begin, begin + _RANGE)
        own = flat[here][:, None]
        value = (own >> (7 - depth).astype(np.uint8) & 1).reshape(-1)
        node = np.concatenate([own * 0 + np.uint32(1), own >> 4 | np.uint32(16)], axis=1) * _A  # of both groups of four bits
        four = np.stack([own[:, 0] >> 4, own[:, 0] & 15], axis=1)[:, :, None]
        path = (1 << depth[:4]) | (four >> (4 - depth[:4]))
        runs = np.arange(0, len(value), 8)
        slots = [(_slots(h[here][:, None], node, bits)[:, :, None] ^ path).reshape(-1) for h in hashes]
        yield Bits(runs, word[here], value, slots, None)


def _table() -> np.ndarray:
    """By whether a bit is its own witness (0: no, 1: it was a zero, 2: a one) and by stored counts:
    predictions in the logistic domain, as floats whose last three bits are grades of how much was seen."""
    seen = np.exp2(np.arange(256) / _COARSE) - 1
    seen = np.where(seen < 16, np.rint(seen), seen)
    odds, grade = np.zeros((3, 256, 256), np.float32), np.zeros((3, 256, 256), np.uint32)
    for own in range(3):
        zeros = np.maximum(seen - (own == 1), 0)[:, None]
        ones = np.maximum(seen - (own == 2), 0)[None, :]
        # A context that has seen much in one direction is trusted the more, the more it has seen.
        smooth = 0.4 / (1 + np.sqrt(zeros + ones) / 4)
        odds[own] = np.clip(np.log((ones + smooth) / (zeros + smooth)), -12, 12)
        grade[own] = np.minimum(np.log2(zeros + ones + 1) * 0.75, 7)
    odds[odds == 0] = 1e-6  # a grade alone would be a denormal number, which is slow
    return ((odds.view(np.uint32) & ~np.uint32(7)) | grade).reshape(-1)


class Model:
    """Stored counts ``[context, slot]`` (zeros in the high byte, ones in the low), and weights ``[gate, input]``."""

    def __init__(self, counts: np.ndarray, inputs: int, weights: np.ndarray | None = None):
        self.counts = counts
        self.inputs = inputs
        # Rows of 16 or 32 bytes are taken faster than others.
        self.weights = np.zeros((_GATES, inputs + -inputs % 4), np.float32)
        self.weights[:, :inputs] = 0.35 if weights is None else weights
        self.table = _table()
        self.mass = 0

    def _inputs(self, told: Bits, own: bool) -> tuple[np.ndarray, np.ndarray]:
        shift = (told.value.astype(np.intp) + 1) << 16 if own else None
        x = np.empty((self.inputs, len(told.value)), np.float32)
        found = x.view(np.uint32)
        for kind, slots in enumerate(told.slots):
            seen = self.counts[kind].take(slots).astype(np.intp)
            if own:
                seen += shift
            self.table.take(seen, out=found[kind], mode="clip")
        high, low = -2, -1
        if told.prior is not None:
            high, low = 0, 1
            x[-1] = told.prior
        gate = found[high] & 7
        gate <<= 3
        gate |= found[low] & 7
        return x, gate.astype(np.intp)

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weighted = self.weights.take(gate, axis=0)[:, : self.inputs].T * x
        out = weighted.sum(axis=0)
        np.minimum(out, 14, out=out)
        return np.maximum(out, -14, out=out)

    def learn(self, told: Bits) -> None:
        x, gate = self._inputs(told, True)
        value = told.value.astype(np.float32)
        begins = np.arange(self.inputs)[:, None] * _GATES
        for at in range(0, len(gate), _STEP):
            part, g = x[:, at : at + _STEP], gate[at : at + _STEP]
            error = self._mixed(part, g)
            np.exp(np.negative(error, out=error), out=error)
            error += 1
            np.subtract(value[at : at + _STEP], np.reciprocal(error, out=error), out=error)
            mass = np.maximum(np.bincount(g, minlength=_GATES), 32)
            sums = np.bincount((g + begins).reshape(-1), (part * error).reshape(-1), begins.size * _GATES)
            self.weights[:, : self.inputs] += (RATE * sums.reshape(-1, _GATES) / mass).T
        self.mass += len(gate)

    def log10(self, told: Bits, owners: int) -> np.ndarray:
        """Log10 probabilities by owner."""
        mixed = self._mixed(*self._inputs(told, False))
        mixed *= 1 - 2 * told.value.astype(np.float32)
        np.exp(mixed, out=mixed)
        mixed += 1
        # One logarithm for a run: fewer than 50 bits of at most 14 stay in a double.
        inverse = np.multiply.reduceat(mixed, told.runs, dtype=np.float64)
        return np.bincount(told.owner, np.log10(inverse), owners) * -1


def _told_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each, exact where small, and deflated: most are 0 or 1."""
    beyond = _EXACT + np.rint(np.log2(np.maximum(counts, _EXACT) / _EXACT) * _FINE)
    return zlib.compress(np.where(counts < _EXACT, counts, np.minimum(beyond, 255)).astype(np.uint8).tobytes(), 1)


_TOLD = np.concatenate([np.arange(_EXACT), np.rint(_EXACT * np.exp2(np.arange(256 - _EXACT) / _FINE))])


def _sent_table(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _received(table: bytes, contexts: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint16).reshape(contexts, -1)


Told = Callable[[Iterator[pa.RecordBatch]], Iterator[Bits]]


def _bit_counts(rows: DataFrame, told: Told, contexts: int, bits: int) -> np.ndarray:
    """Counts by slot over all ``rows``, as ``Model`` stores them."""
    block = min(bits, _BLOCK_BITS)
    schema = "block int, counts binary"

    def packed(block_at: int, counts: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block_at], pa.int32()), pa.array([counts], pa.binary())], ["block", "counts"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((contexts, 2 << bits), np.int32)
        for part in told(batches):
            for own, slots in zip(total, part.slots, strict=True):
                slots <<= 1
                slots |= part.value
                np.add.at(own, slots, np.int32(1))
        for at, own in enumerate(total.reshape(-1, 2 << block)):
            if own.any():
                yield packed(at, _told_counts(own))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = _TOLD[np.frombuffer(zlib.decompress(counts), np.uint8)]
                total[at] = total[at] + own if at in total else own
        for at, own in total.items():
            own = own.reshape(-1, 2)
            own = own / np.maximum(own.sum(axis=1, keepdims=True) / (1 << 20), 1)
            stored = np.rint(np.log2(1 + own) * _COARSE).astype(np.uint16)
            yield packed(at, _sent_table((stored[:, 0] << 8) | stored[:, 1]))

    out = np.zeros((contexts << bits >> block, 1 << block), np.uint16)
    added = rows.mapInArrow(count, schema).repartition("block").mapInArrow(add_up, schema)
    for row in added.collect():  # contexts * 2^bits numbers of two bytes at most, deflated
        out[row.block] = _received(row.counts, 1)[0]
    return out.reshape(contexts, -1)


def _mean_weights(rows: DataFrame, told: Told, shared, contexts: int, inputs: int) -> np.ndarray | None:
    """Every task learns from its rows; the mean, weighted by bits."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(_received(shared.value, contexts), inputs)
        for part in told(batches):
            model.learn(part)
        if model.mass:
            weights = model.weights[:, :inputs].reshape(-1).astype(float)
            n = weights.size
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n)), pa.array(weights * model.mass), pa.array([float(model.mass)] * n)],
                ["at", "total", "mass"],
            )

    learned = rows.mapInArrow(learn, "at bigint, total double, mass double")
    means = learned.groupBy("at").agg((F.sum("total") / F.sum("mass")).alias("weight")).collect()
    if not means:
        return None
    return np.array([r.weight for r in sorted(means, key=lambda r: r["at"])]).reshape(_GATES, inputs)


def _frequent(words: DataFrame) -> int:
    """The least count of words with codes: as many of the most frequent ones seen twice or more as fit, by powers of two."""
    level = F.floor(F.log2("n")).cast("int")
    least, held = 62, 0
    levels = words.where("n > 0").groupBy(level.alias("level")).count().collect()  # at most 63 rows
    for found, n in sorted(levels, reverse=True):
        held += n
        if held > FREQUENT or not found:  # words seen once are spelled, as new words will be
            break
        least = found
    return 1 << least


def _listed_share(words: DataFrame, least: int) -> float:
    """How many of the escaped words of a new text were seen in training: a word seen ``n`` times
    would, without one of its occurrences, be a word seen ``n - 1`` times, or a new one."""
    plain = words.where((F.col("word") != "") & F.col("n").between(1, least))
    new, again = plain.agg(
        F.count(F.when(F.col("n") == 1, 1)), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    ).first()
    return (again + 0.5) / (new + again + 1)


def numbered(names: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Of every text the numbers of its words, strangers beyond the code, with the end, as 32-bit
    integers laid end to end; and its strangers."""
    sizes, words = _words(texts)
    place = pa.compute.index_in(words, value_set=names.cast(words.type))
    known = place.is_valid().to_numpy(zero_copy_only=False)
    strange = words.filter(pa.compute.is_null(place)).cast(pa.string())
    text = np.repeat(np.arange(len(sizes)), sizes)
    ids = pa.compute.fill_null(place, 0).to_numpy() + np.int32(2)
    if len(strange):
        _, edges, letters = strange.buffers()
        letters = memoryview(letters)
        checks = [zlib.crc32(letters[a:b]) for a, b in pairwise(np.frombuffer(edges, np.int32)[: len(strange) + 1].tolist())]
        ids[~known] = len(names) + 2 + np.array(checks, np.uint32) % _STRANGERS
    told = np.zeros(len(ids) + len(sizes), np.int32)
    told[np.arange(len(ids)) + text] = ids
    ends = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32) * np.int32(4)
    found = np.concatenate([[0], np.cumsum(np.bincount(text[~known], minlength=len(sizes)))])
    return (
        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(told)]),
        pa.ListArray.from_arrays(found.astype(np.int32), strange),
    )


def _told_texts(batches: Iterator[pa.RecordBatch], code: Code, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Iterator[Bits]]]:
    """Slices of numbered texts, with the sizes of these, the numbers of their words and the bits of these."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column("ids")).to_numpy() // 4
        ends = np.cumsum(sizes)
        numbers = np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.int32)
        slice_of = (ends - sizes) // _TOKENS
        edges = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), batch.num_rows]
        for begin, end in pairwise(edges):
            own = sizes[begin:end]
            ids = numbers[ends[begin] - sizes[begin] : ends[end - 1]].astype(np.int64)
            first = np.zeros(len(ids), bool)
            first[np.cumsum(own) - own] = True
            yield batch.slice(begin, end - begin), own, ids, code_bits(code, ids, first, bits)


def score_documents(
    docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``train`` says which documents are learned from. ``base_score`` is the smoothed unigram log10
    probability of the tokens, ``score`` the model's, and ``bits_per_byte`` its total bits over the text's bytes."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text_column}`").alias("text"),
        F.coalesce(train, F.lit(True)).alias("train"),
    )
    words = written(_counted(rows), "words")
    tokens, distinct = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = min(max(int(tokens).bit_length() + 1, 12), SLOT_BITS)
    word_bits = min(max(int(distinct).bit_length() + 3, 12), SLOT_BITS)
    least = _frequent(words)
    often = (F.col("n") >= least) | (F.col("word") == "")
    listed = words.where(often & (F.col("word") != "")).select("word", "n").toArrow()  # at most FREQUENT rows
    listed = listed.sort_by([("n", "descending"), ("word", "ascending")])
    counts = listed["n"].to_numpy()
    ends = words.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    unlisted = int(tokens - ends - counts.sum())
    share = _listed_share(words, least) if unlisted else 0.0
    code = Code.of(np.concatenate([[ends + 0.5, unlisted + 0.5], counts]))
    whole = np.log10(tokens + SMOOTHING * (distinct + 1))
    base = np.log10(np.concatenate([[ends, 0], counts]) + SMOOTHING) - whole
    names = spark.sparkContext.broadcast(listed["word"].combine_chunks())
    sent = spark.sparkContext.broadcast((code, base))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", _TEXT_BYTES):
            texts = part.column("text")
            ids, strange = numbered(names.value, texts)
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(ids))), part.column("doc_id"), part.column("train"),
                    n_bytes, ids, strange,
                ],
                ["row", "doc_id", "train", "n_bytes", "ids", "strange"],
            )
            row += len(ids)
        pa.default_memory_pool().release_unused()

    texts = written(
        rows.mapInArrow(
            number, "row bigint, doc_id bigint, train boolean, n_bytes bigint, ids binary, strange array<string>"
        ),
        "numbered",
    )

    def texts_told(batches: Iterator[pa.RecordBatch]) -> Iterator[Bits]:
        for _, _, _, told in _told_texts(batches, sent.value[0], bits):
            yield from told

    def words_told(batches: Iterator[pa.RecordBatch]) -> Iterator[Bits]:
        for part in slices(batches, "word", _SLICE_BYTES):
            yield from spelled_bits([w.encode() for w in part.column("word").to_pylist()], word_bits)

    learned = texts.where("train").select("ids")
    rest = words.where(~often)
    types = words.where("n > 0 AND word != ''").select("word")
    # Few tasks count, each of many rows, since every one sends a table.
    tasks = max(spark.sparkContext.defaultParallelism, tokens // _TASK_TOKENS)
    counts = _bit_counts(learned.coalesce(tasks), texts_told, WORD_CONTEXTS, bits)
    text_counts = spark.sparkContext.broadcast(_sent_table(counts))
    tasks = 1 + distinct // _TASK_WORDS
    counts = _bit_counts(types.coalesce(tasks), words_told, len(ORDERS), word_bits)
    word_counts = spark.sparkContext.broadcast(_sent_table(counts))
    text_weights = _mean_weights(learned, texts_told, text_counts, WORD_CONTEXTS, WORD_CONTEXTS + 1)
    word_weights = _mean_weights(types, words_told, word_counts, len(ORDERS), len(ORDERS))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(_received(word_counts.value, len(ORDERS)), len(ORDERS), word_weights)
        for part in slices(batches, "word", _SLICE_BYTES):
            costs = np.full(part.num_rows, np.log10(1 - share))
            for told in spelled_bits([w.encode() for w in part.column("word").to_pylist()], word_bits):
                costs += model.log10(told, part.num_rows)
            seen = share * part.column("n").to_numpy() / max(unlisted, 1)
            found = seen > 0
            costs[found] = np.logaddexp(np.log(seen[found]), costs[found] * np.log(10)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(costs)], [*part.schema.names, "cost"])

    priced = written(
        rest.select("word", "n").mapInArrow(spell, "word string, n bigint, cost double").select(
            "word", (F.col("n") > 0).alias("known"), (F.log10(F.col("n") + SMOOTHING) - float(whole)).alias("base"), "cost"
        ),
        "priced",
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, plain = sent.value
        known = len(own.size)
        model = Model(_received(text_counts.value, WORD_CONTEXTS), WORD_CONTEXTS + 1, text_weights)
        for part, sizes, ids, told in _told_texts(batches, own, bits):
            doc = np.repeat(np.arange(part.num_rows), sizes)
            cost = np.zeros(part.num_rows)
            for some in told:
                some.owner = doc[some.owner]
                cost += model.log10(some, part.num_rows)
            inside = ids < known
            base = np.bincount(doc, np.where(inside, plain[np.where(inside, ids, 0)], 0), part.num_rows)
            sure = np.bincount(doc, inside & ((ids > 0) | (ends > 0)), part.num_rows).astype(np.int64)
            numbers = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), *map(pa.array, (numbers, sure, base, cost))],
                [*kept, "n_tokens", "n_known", "base_score", "score"],
            )

    kept = ["row", "doc_id", "train", "n_bytes"]
    parts = texts.select(*kept, "ids").mapInArrow(
        add_up,
        "row bigint, doc_id bigint, train boolean, n_bytes bigint, n_tokens bigint, n_known bigint, "
        "base_score double, score double",
    )
    more = (
        texts.select("row", F.explode("strange").alias("word"))
        .join(priced, "word")
        .groupBy("row")
        .agg(
            F.sum(F.col("known").cast("bigint")).alias("more_known"),
            F.sum("base").alias("more_base"),
            F.sum("cost").alias("more_score"),
        )
    )
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return (
        parts.join(more, "row", "left")
        .select(
            "doc_id", "train", "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(tokens).cast("bigint").alias("train_tokens"),
            (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
            score.alias("score"),
            F.when(F.col("n_bytes") > 0, score * float(-np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )
