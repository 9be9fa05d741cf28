"""Token counts that follow edits: a segment tree of pre-tokens per document.

The leaves of a document's tree are its pre-tokens with their characters and tokens; nodes hold
a few dozen leaves, and a binary tree above the nodes holds sums. An edit finds its leaf from the
root, re-encodes from a little before the edit (``CONTEXT`` characters, as far as a pre-token can
look ahead) until a new pre-token boundary meets an old one behind the edit, puts the new leaves
in place of the old ones, and updates the sums on the paths to the root. Pre-tokens are found
from their start without looking back, so everything behind a common boundary stays as it was.

``count_tokens`` gives every document its tree as a column, ``apply_edits`` takes and returns
such rows. No shuffle; the tree travels and is stored with its document.

Defined cases: a null text is the empty text; null edits are none; an edit's place and length
are cut to the text; edits of a row apply in order, each to the text that the previous one left;
a null replacement is empty. Other columns are passed through, a column named like an added one
is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import slices

CONTEXT = 2
NODE_LEAVES = 32
TABLE_ROWS = 300_000
_SLICE_BYTES = 1 << 20
TREE = "struct<chars:array<int>,tokens:array<int>,nodes:array<int>>"
EDITS = "array<struct<at:int,cut:int,put:string>>"


class Counter(dict):
    """Pre-tokens by the pattern, and a table that counts the tokens of each distinct one once."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.library = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= TABLE_ROWS:
            self.clear()
        found = self[piece] = len(self.library.encode_ordinary(piece))
        return found

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        pieces = self.pattern.findall(text)
        return list(map(len, pieces)), list(map(self.__getitem__, pieces))


class SegmentTree:
    """Leaves in nodes, and sums of characters and tokens in a binary tree above them."""

    def __init__(self, chars: list[int], tokens: list[int], nodes: list[int] | None = None):
        if nodes is None:
            nodes = [min(NODE_LEAVES, len(chars) - at) for at in range(0, len(chars), NODE_LEAVES)] or [0]
        self.nodes, at = [], 0
        for size in nodes:
            self.nodes.append((chars[at : at + size], tokens[at : at + size]))
            at += size
        while len(self.nodes) & (len(self.nodes) - 1):  # empty nodes fill up a full binary tree
            self.nodes.append(([], []))
        self._sum_up()

    def _sum_up(self) -> None:
        n = len(self.nodes)
        self.chars, self.tokens = [0] * n + [sum(c) for c, _ in self.nodes], [0] * n + [sum(t) for _, t in self.nodes]
        for i in range(n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def columns(self) -> dict:
        return {
            "chars": list(chain.from_iterable(c for c, _ in self.nodes)),
            "tokens": list(chain.from_iterable(t for _, t in self.nodes)),
            "nodes": [len(c) for c, _ in self.nodes],
        }

    def _update(self, node: int) -> None:
        at = node + len(self.nodes)
        self.chars[at], self.tokens[at] = map(sum, self.nodes[node])
        while at > 1:
            at //= 2
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]

    def find(self, place: int) -> tuple[int, int, int]:
        """Node, leaf and start of the leaf that holds the character at ``place`` (or the last leaf)."""
        at, start = 1, 0
        while at < len(self.nodes):
            at *= 2
            if place - start >= self.chars[at]:
                start += self.chars[at]
                at += 1
        node = at - len(self.nodes)
        leaf, chars = 0, self.nodes[node][0]
        while leaf + 1 < len(chars) and place >= start + chars[leaf]:
            start += chars[leaf]
            leaf += 1
        return node, leaf, start

    def edit(self, counter: Counter, text: str, at: int, cut: int, put: str) -> tuple[str, int]:
        """The edited text, and how many pre-tokens were encoded for it."""
        at = min(max(at, 0), len(text))
        cut = min(max(cut, 0), len(text) - at)
        after = text[:at] + put + text[at + cut :]
        node, leaf, start = self.find(max(at - CONTEXT, 0))
        # Old boundaries from there on, walked together with the new pre-tokens.
        last_node, last_leaf, old, shift = node, leaf, start, len(put) - cut
        chars, tokens, end = [], [], start

        def met() -> bool:
            """Whether an old boundary stands where the new pre-tokens have come to, behind the edit."""
            nonlocal last_node, last_leaf, old
            if end < at + len(put):
                return False
            while old < at + cut or old + shift < end:
                while last_node < len(self.nodes) and last_leaf >= len(self.nodes[last_node][0]):
                    last_node, last_leaf = last_node + 1, 0
                if last_node == len(self.nodes):
                    return False
                old += self.nodes[last_node][0][last_leaf]
                last_leaf += 1
            return old + shift == end

        if not met():
            for piece in counter.pattern.finditer(after, start):
                chars.append(piece.end() - piece.start())
                tokens.append(counter[piece.group()])
                end = piece.end()
                if met():
                    break
            else:  # the new pre-tokens reach the end: all old ones go
                last_node, last_leaf = len(self.nodes) - 1, len(self.nodes[-1][0])
        self._replace(node, leaf, min(last_node, len(self.nodes) - 1), last_leaf, chars, tokens)
        return after, len(chars)

    def _replace(self, node: int, leaf: int, to_node: int, to_leaf: int, chars: list[int], tokens: list[int]) -> None:
        first, last = self.nodes[node], self.nodes[to_node]
        self.nodes[node] = (first[0][:leaf] + chars + last[0][to_leaf:], first[1][:leaf] + tokens + last[1][to_leaf:])
        for between in range(node + 1, to_node + 1):
            self.nodes[between] = ([], [])
        if len(self.nodes[node][0]) > 4 * NODE_LEAVES:  # an outgrown node: lay the leaves out anew
            own = self.columns()
            self.__init__(own["chars"], own["tokens"])
            return
        for changed in range(node, to_node + 1):
            self._update(changed)


_TREE = pa.struct([(name, pa.list_(pa.int32())) for name in ("chars", "tokens", "nodes")])


def _to_column(trees: list[SegmentTree]) -> pa.StructArray:
    """Trees as a column; their numbers are laid out at once, which is much faster than one list after the other."""
    rows = [t.columns() for t in trees]
    lists = []
    for field in _TREE:
        sizes = np.fromiter((len(r[field.name]) for r in rows), np.int64, len(rows))
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.fromiter(chain.from_iterable(r[field.name] for r in rows), np.int32, int(edges[-1]))
        lists.append(pa.ListArray.from_arrays(edges, values))
    return pa.StructArray.from_arrays(lists, fields=list(_TREE))


def _from_column(column: pa.StructArray) -> Iterator[SegmentTree]:
    lists = []
    for field in _TREE:
        own = column.field(field.name)
        values, edges = own.values.to_numpy(), own.offsets.to_numpy()
        lists.append([values[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return (SegmentTree(*row) for row in zip(*lists, strict=True))


def _columns(df: DataFrame, drop: tuple[str, ...]) -> tuple[DataFrame, list[str], str]:
    rest = [c for c in df.columns if c not in drop]
    rows = df.select(*[f"`{c}`" for c in rest])
    return rows, rest, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and the ``tree`` of its pre-tokens."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    rows, rest, schema = _columns(docs, ("n_tokens", "tree"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for part in slices(batches, text_column, _SLICE_BYTES):
            trees = [SegmentTree(*counter.leaves(t or "")) for t in part.column(text_column).to_pylist()]
            counts = pa.array([t.total() for t in trees], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, counts, _to_column(trees)], names=[*rest, "n_tokens", "tree"]
            )

    return rows.mapInArrow(build, f"{schema}, n_tokens bigint, tree {TREE}")


def apply_edits(
    counted: DataFrame, ranks_path: str, pattern: str, text_column: str = "text", edits_column: str = "edits"
) -> DataFrame:
    """Rows of ``count_tokens`` with their edits made: text, tree and ``n_tokens`` are the new ones;
    ``n_before`` is the old count, ``n_segments`` the pre-tokens now, ``n_reencoded`` those encoded anew.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    added = ("n_before", "n_segments", "n_reencoded")
    edits = F.col(f"`{edits_column}`").cast(EDITS)
    rows, rest, schema = _columns(counted.withColumn(edits_column, edits), added)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for part in slices(batches, text_column, _SLICE_BYTES):
            texts, trees, before, segments, encoded = [], [], [], [], []
            own = (part.column(c).to_pylist() for c in (text_column, edits_column))
            for text, changes, tree in zip(*own, _from_column(part.column("tree")), strict=True):
                text, n = text or "", 0
                before.append(tree.total())
                for e in changes or []:
                    if e is not None:
                        text, more = tree.edit(counter, text, e["at"] or 0, e["cut"] or 0, e["put"] or "")
                        n += more
                texts.append(text)
                encoded.append(n)
                segments.append(sum(len(c) for c, _ in tree.nodes))
                trees.append(tree)
            new = {
                text_column: pa.array(texts, pa.string()),
                "tree": _to_column(trees),
                "n_tokens": pa.array([t.total() for t in trees], pa.int64()),
            }
            counts = [pa.array(c, pa.int64()) for c in (before, segments, encoded)]
            kept = [new[c] if c in new else part.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, *counts], names=[*rest, *added])

    return rows.mapInArrow(update, f"{schema}, " + ", ".join(f"{c} bigint" for c in added))
