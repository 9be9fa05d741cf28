"""Jaccard join of word shingles with a prefix tree: classes of documents linked by similarity.

Sets are put in one global order: shingles that many documents hold come last, so that what two
sets have in common first is rare. Equal sets are one record.

1. Prefixes. Two similar sets share a shingle within the first n - ceil(0.75 n) + 1 of each; only
   these prefixes are shuffled, and shingles that a single record holds end there.
2. Leaders. Each record is verified against one central record that shares much of its prefix;
   this joins most of a group of near copies with work in proportion to its size. On shingles with
   many records further rounds with other members follow while they still join a good part.
3. Shingles of at most ``CROWD`` records in different components: pairs, with the records outside the
   shingle's largest component on one side. Pairs that the shared part of their prefixes cannot
   bring to the threshold fall away; the others are verified.
4. Shingles of more records: no pairs. Their records live in prefix trees of at most ``GROUP`` sets, each
   record in one tree, chosen by its first crowded shingle, so that sets that begin alike stand
   together. A record outside a shingle's largest component asks every tree with a record of that
   shingle once, and a tree answers with one link for each other component it finds.
5. Verification. Pairs of step 2 and 3 whose sketches (parities of hashes, a bound on what two sets share)
   rule a link out end here. Candidates are stored as a prefix tree of their ordered sets (edges of ``STRIDE``
   shingles). A record's set is taken down the tree: the overlap of a shared path is counted once,
   and a subtree is left as soon as its overlap plus the shorter remaining length cannot reach
   what the threshold needs.

Every pair of different components that could be linked is verified, so no link is lost; pairs
within a component are not listed. Shingles are compared by 64-bit hashes; records are sets by a
64-bit hash that is checked against a second one (another seed is taken if two sets clash).

Defined cases: a null text is empty; an empty set links with nothing; a document of fewer than
five words has its whole word sequence as its only shingle; rows that repeat an id are documents
of their own with that id; null ids count as larger than all others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailsieve.llm.common import components, slices, written
from mailsieve.llm.words import mix, shingle_sets

STRIDE = 32
GROUP = 256
_SLICE_BYTES = 1 << 20
CROWD = 64
_WORTH = 0.1  # a round of leaders goes on if the last one linked this share of what it tried
_SURE = 12  # shingles seen 2^12 times in chunks are shared without asking
_CHUNK = 4_000_000  # shingles counted together in a task
_FREQUENT_IN_CHUNK = 2
_FREQUENT = 1 << 20  # at most so many shingles are known as frequent; this bounds what tasks are sent
_MAP_BITS = (16, 27)  # of the bitmap of wanted records, by their number


def needed(a, b):
    """Smallest overlap of two sets of these sizes with 100 * overlap >= 75 * union."""
    return -(-3 * (a + b) // 7)


def _records(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record id, second hash and size of each set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def sums(hashes: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
        return total[ends[1:]] - total[ends[:-1]]

    return mix(sums(mix(flat + np.uint64(7)))).view(np.int64), sums(mix(~flat)).view(np.int64), sizes


def sketch(keys: np.ndarray) -> bytes:
    """Parities of a set: bit ``p`` tells whether an odd number of its hashes end in ``p``; two bits a hash at least.

    Shingles of both sets cancel out, so the bits in which two sketches of one size differ number at most as
    many as the shingles that only one of the sets has. A sketch is folded to half its size by or-ing its
    halves exclusively."""
    bits = max(256, 1 << (2 * len(keys) - 1).bit_length())
    odd = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """Whether two sets with these sketches can overlap as much as a link needs."""
    x, y = sorted((np.frombuffer(s, np.uint8) for s in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return size_a + size_b - apart >= 2 * needed(size_a, size_b)


def _screened(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sketches allow a link. Sketches are a thirtieth of the sets."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("record")).distinct()
    held = rows.join(involved, "record", "left_semi").groupBy("record").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    side = {c: held.select(F.col("record").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "na", "nb", "sa", "sb")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb"))
            fits = [may_link(*row) for row in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return both.mapInArrow(screen, "a bigint, b bigint")


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in part.column("text").to_pylist()]


def _summaries(docs: DataFrame, seed: int) -> DataFrame:
    """A row per document (record, second hash, size, sketch) and rows of shingles that are frequent in a chunk."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "record", "check", "n", "shingle", "seen", "sketch"]

        def rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            columns.setdefault("sketch", pa.nulls(n, pa.binary()))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, pa.int64())) for c in names], names)

        def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
            shingles, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= _FREQUENT_IN_CHUNK
            found = {"shingle": pa.array(shingles[often].view(np.int64)), "seen": pa.array(seen[often])}
            return rows(found, int(often.sum()))

        held, size = [], 0
        for part in slices(batches, "text", _SLICE_BYTES):
            sets = shingle_sets(_texts(part), seed)
            record, check, n = _records(sets)
            columns = {"record": pa.array(record), "check": pa.array(check), "n": pa.array(n)}
            columns["sketch"] = pa.array([sketch(keys) if len(keys) else None for keys in sets], pa.binary())
            yield rows(columns | {"doc_id": part.column("doc_id")}, part.num_rows)
            held.extend(sets)
            size += int(n.sum())
            if size >= _CHUNK:
                yield frequent(held)
                held, size = [], 0
        if held:
            yield frequent(held)

    schema = "doc_id bigint, record bigint, check bigint, n bigint, shingle bigint, seen bigint, sketch binary"
    return docs.mapInArrow(summarise, schema)


class Order:
    """The global order: 6 bits of how frequent a shingle is, then bits of its hash."""

    def __init__(self, summaries: DataFrame):
        counts = summaries.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen"))
        counts = written(counts.withColumn("level", F.floor(F.log2("seen")).cast("int")), "frequent")
        level, held = 62, 0
        for found, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
            held += n
            if held > _FREQUENT:
                break
            level = found
        rows = counts.where(F.col("level") >= level).select("shingle", "level").toArrow()
        shingles = rows["shingle"].to_numpy().astype(np.int64).view(np.uint64)
        at = np.argsort(shingles)
        self.shingles = shingles[at]
        self.levels = rows["level"].to_numpy().astype(np.uint64)[at]
        self.near = np.zeros(1 << 22, bool)
        self.near[(self.shingles & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        keys = shingles >> np.uint64(6)
        maybe = np.flatnonzero(self.near[(shingles & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(maybe) and len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, shingles[maybe]), len(self.shingles) - 1)
            hit = self.shingles[at] == shingles[maybe]
            keys[maybe[hit]] |= (self.levels[at[hit]] + np.uint64(1)) << np.uint64(58)
        return np.sort(keys)


def _prefixes(docs: DataFrame, order: Order, seed: int) -> DataFrame:
    """``key, record, n, pos`` of the prefix of every record; a task skips sets it has met."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part in slices(batches, "text", _SLICE_BYTES):
            sets = shingle_sets(_texts(part), seed)
            record, _, sizes = _records(sets)
            keys, owners, places = [], [], []
            for at, (r, n) in enumerate(zip(record.tolist(), sizes.tolist(), strict=True)):
                if not n or r in met:
                    continue
                if len(met) < 1_000_000:
                    met.add(r)
                size = n - -(-3 * n // 4) + 1
                keys.append(order.keys(sets[at])[:size])
                owners.append(np.full(size, at))
                places.append(np.arange(size, dtype=np.int32))
            if keys:
                owner = np.concatenate(owners)
                columns = [np.concatenate(keys).view(np.int64), record[owner], sizes[owner].astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(np.concatenate(places))], ["key", "record", "n", "pos"]
                )

    return docs.mapInArrow(emit, "key bigint, record bigint, n int, pos int")


def _sets(docs: DataFrame, records: DataFrame, order: Order, seed: int) -> DataFrame:
    """``record, n, keys`` (ordered set) of the given records."""
    # A bitmap of the records' hashes, put together by Spark and of bounded size, keeps most other sets out of
    # the shuffle; the join below is what decides.
    bits = min(max(_MAP_BITS[0], int(records.count()).bit_length() + 3), _MAP_BITS[1])
    slot = F.pmod(F.col("record"), F.lit(1 << bits)) + 1  # the bitmap functions count from one
    pages = records.groupBy((F.bitmap_bucket_number(slot) - 1).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for page, held in pages.collect():  # pages of 4096 bytes, 16 MB together at most
        at = page * 4096
        packed[at : at + 4096] = np.frombuffer(held, np.uint8)[: len(packed) - at]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, met = np.unpackbits(packed, bitorder="little").astype(bool), set()
        for part in slices(batches, "text", _SLICE_BYTES):
            sets = shingle_sets(_texts(part), seed)
            record, _, sizes = _records(sets)
            take = np.flatnonzero(wanted[record & ((1 << bits) - 1)] & (sizes > 0))
            take = [i for i in take.tolist() if not (record[i] in met or (len(met) < 1_000_000 and met.add(record[i])))]
            if take:
                cells = [order.keys(sets[i]).tobytes() for i in take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(record[take]), pa.array(sizes[take].astype(np.int32)), pa.array(cells, pa.binary())],
                    ["record", "n", "keys"],
                )

    found = docs.mapInArrow(emit, "record bigint, n int, keys binary")
    return found.join(records, "record", "left_semi").groupBy("record").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


def walk(members: list[np.ndarray], lead: np.ndarray) -> np.ndarray:
    """Which members are linked with ``lead``: one descent of the tree of the members' sets."""
    sizes = np.fromiter(map(len, members), np.int64, len(members))
    need = needed(sizes, len(lead))
    alive = np.flatnonzero(np.minimum(sizes, len(lead)) >= need)
    node = np.zeros(len(members), np.int64)  # of the current depth
    overlap = np.zeros(1, np.int64)
    linked = np.zeros(len(members), bool)
    depth = 0
    while len(alive):
        children: dict[tuple[int, bytes], int] = {}
        parents, edges, last = [], [], []
        for i in alive.tolist():
            edge = members[i][depth * STRIDE : (depth + 1) * STRIDE]
            child = children.setdefault((int(node[i]), edge.tobytes()), len(children))
            if child == len(parents):
                parents.append(node[i])
                edges.append(edge)
                last.append(edge[-1])
            node[i] = child
        flat = np.concatenate(edges)
        at = np.minimum(np.searchsorted(lead, flat), len(lead) - 1)
        gained = np.concatenate([[0], np.cumsum(lead[at] == flat)])
        ends = np.cumsum(np.fromiter(map(len, edges), np.int64, len(edges)))
        overlap = overlap[parents] + np.diff(gained[np.concatenate([[0], ends])])
        left_of_lead = len(lead) - np.searchsorted(lead, np.array(last), side="right")
        depth += 1
        here = node[alive]
        left = np.maximum(sizes[alive] - depth * STRIDE, 0)
        linked[alive] = overlap[here] >= need[alive]
        best = overlap[here] + np.minimum(left, left_of_lead[here])
        alive = alive[(left > 0) & (best >= need[alive]) & ~linked[alive]]
    return linked


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of the pairs ``a, b``, by descents of b's set in trees of a's sets."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    placed = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    placed = written(placed.select("a", "b", "part"), "pairs")
    member = placed.join(sets.withColumnRenamed("record", "a"), "a").select("b", "part", "a", "keys")
    leads = placed.select("b", "part").distinct()
    lead = leads.join(sets.withColumnRenamed("record", "b"), "b").select(
        "b", "part", F.lit(None).cast("bigint").alias("a"), "keys"
    )

    def descend(table: pa.Table) -> pa.Table:
        rows = [(a, np.frombuffer(k, np.uint64)) for a, k in zip(*(table[c].to_pylist() for c in ("a", "keys")), strict=True)]
        own = next(k for a, k in rows if a is None)
        others = [(a, k) for a, k in rows if a is not None]
        linked = walk([k for _, k in others], own)
        found = [a for (a, _), yes in zip(others, linked, strict=True) if yes]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([table["b"][0].as_py()] * len(found), pa.int64())})

    met = member.unionByName(lead).groupBy("b", "part")
    return written(met.applyInArrow(descend, "a bigint, b bigint"), "links")


def _answered(asks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between records ``b`` that ask trees (``record, own, home, part``) and the trees' members
    (``record, component, home, part``): for each other component that a tree finds, one member."""
    tree = ["home", "part"]
    turns = asks.groupBy(*tree).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("turns"))
    asking = asks.join(turns, tree).withColumn("turn", F.pmod(F.xxhash64("record"), F.col("turns")).cast("int"))
    asking = asking.select(*tree, "turn", "record", F.col("own").alias("component"), F.lit(True).alias("asks"))
    told = members.join(turns, tree).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    told = told.select(*tree, "turn", "record", "component", F.lit(False).alias("asks"))
    met = asking.unionByName(told).join(sets.select("record", "keys"), "record")

    def descend(table: pa.Table) -> pa.Table:
        record, component = table["record"].to_numpy(), table["component"].to_numpy()
        asks = table["asks"].to_numpy(zero_copy_only=False)
        keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        inside, a, b = np.flatnonzero(~asks), [], []
        stored = [keys[i] for i in inside]
        for lead in np.flatnonzero(asks):
            linked = inside[walk(stored, keys[lead])]
            others, first = np.unique(component[linked], return_index=True)
            first = first[others != component[lead]]
            a.append(record[linked[first]])
            b.append(np.full(len(first), record[lead]))
        none = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate([*a, *none]), "b": np.concatenate([*b, *none])})

    return written(met.groupBy(*tree, "turn").applyInArrow(descend, "a bigint, b bigint"), "links")


def _asks(crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who asks which tree (``record, own, home, part``), and the trees' members (``record, component, home, part``)."""
    homes = crowd.groupBy("record").agg(F.min("key").alias("home"), F.first("component").alias("component"))
    parts = homes.groupBy("home").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    members = homes.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("record"), F.col("parts")).cast("int"))
    members = written(members.select("record", "component", "home", "part"), "trees")
    trees = crowd.select("key", "record").join(members.select("record", "home", "part"), "record")
    trees = trees.select("key", "home", "part").distinct()
    sizes = crowd.groupBy("key", "component").count()
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    outside = crowd.join(largest, "key").where("component != largest").select("key", "record", F.col("component").alias("own"))
    asks = outside.join(trees, "key").select("record", "own", "home", "part").distinct()
    return written(asks, "asks"), members


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_shingles, component_id``, one row per row of ``docs``."""
    docs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    seed = 0
    while True:
        summaries = written(_summaries(docs, seed), "summaries")
        rows = summaries.where("record IS NOT NULL")
        clash = rows.groupBy("record").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x != y")
        if clash.isEmpty():
            break
        seed += 1
    order = Order(summaries)
    # A shingle seen very often is shared; its rows need not meet in one task to find out.
    sure = F.shiftrightunsigned("key", 58) > _SURE
    by_key = W.partitionBy("key", "apart")
    apart = F.when(sure, F.col("record")).otherwise(F.lit(0).cast("bigint"))
    shared = (
        _prefixes(docs, order, seed)
        .withColumn("apart", apart)
        .withColumns({"low": F.min("record").over(by_key), "high": F.max("record").over(by_key)})
        .where(sure | (F.col("low") != F.col("high")))
        .dropDuplicates(["key", "apart", "record"])
        .drop("apart", "low", "high")
    )
    shared = written(shared, "shared")
    records = written(shared.select("record").distinct(), "records")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets(docs, written(wanted.distinct(), "involved"), order, seed)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(_screened(written(pairs, "candidates"), rows), "screened")
        return _verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("record"))))

    def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Rows of shingles whose records are in several components, and whether these are crowded."""
        rows = rows.drop("component", "crowded").join(found.withColumnRenamed("node", "record"), "record")
        several = rows.withColumn("apart", apart).withColumns(
            {
                "low": F.min("component").over(by_key),
                "high": F.max("component").over(by_key),
                "crowded": sure | (F.count("*").over(by_key) > CROWD),
            }
        )
        return written(several.where(sure | (F.col("low") != F.col("high"))).drop("apart", "low", "high"), "open")

    def led_by(rows: DataFrame, rank: Column) -> DataFrame:
        """``a, b``: each record with the leader of its shingles it shares most of them with."""
        central = rows.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), "record", "component")).alias("lead"))
        led = rows.join(central, "key").where("component != lead.component")
        counted = led.groupBy("record", "n", F.col("lead.record").alias("b")).count().where("28 * count >= 3 * n")
        leaders = counted.groupBy("record").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
        return leaders.withColumnRenamed("record", "a")

    # Central records share most of their prefix with others; the original of edited copies does.
    degree = shared.groupBy("record").agg(F.count("*").alias("degree"))
    open_ = shared.select("key", "record", "n", "pos").join(degree, "record").withColumn("component", F.col("record"))
    nodes = records.withColumnRenamed("record", "node")
    links = [verified(led_by(written(open_, "open"), F.col("degree")))]
    found = components(nodes, links[0])
    open_ = labelled(shared.select("key", "record", "n", "pos"), found)
    turn = 0
    while True:  # in crowds, other members lead while that still joins many
        turn += 1
        tried = written(led_by(open_.where("crowded"), F.xxhash64("record", F.lit(turn))), "tried")
        asked = tried.count()
        if not asked:
            break
        links.append(verified(tried))
        found = components(nodes, reduce(DataFrame.unionByName, links))
        open_ = labelled(open_, found)
        if links[-1].count() < _WORTH * asked:
            break
    crowd = open_.where("crowded")
    if not crowd.isEmpty():
        asks, members = _asks(crowd)
        involved = asks.select("record").unionByName(members.join(asks, ["home", "part"], "left_semi").select("record"))
        links.append(_answered(asks, members, sets_of(involved)))
    tagged = open_.where("NOT crowded")
    sizes = tagged.groupBy("key", "component").count()
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    some = tagged.join(largest, "key").where("component != largest")
    left = some.select("key", *[F.col(c).alias(f"{c}1") for c in ("record", "n", "pos", "component")])
    right = tagged.join(largest, "key").withColumn("outside", F.col("component") != F.col("largest"))
    right = right.select("key", "outside", *[F.col(c).alias(f"{c}2") for c in ("record", "n", "pos", "component")])
    meets = left.join(right, "key").where(
        "component1 != component2 AND (NOT outside OR record1 < record2)"
        " AND 4 * least(n1, n2) >= 3 * greatest(n1, n2)"
    )
    # A pair may meet either way round, depending on a shingle's largest component.
    turned = F.col("record1") > F.col("record2")
    meets = meets.select(
        *[F.when(turned, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}a") for c in ("record", "n", "pos")],
        *[F.when(turned, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}b") for c in ("record", "n", "pos")],
    )
    pairs = meets.groupBy("recorda", "recordb", "na", "nb").agg(
        F.count("*").alias("k"), F.max("posa").alias("pa"), F.max("posb").alias("pb")
    )
    # All that both have up to their last common shingle has been counted.
    pairs = pairs.where("7 * (k + least(na - pa, nb - pb) - 1) >= 3 * (na + nb)")
    second = verified(pairs.select(F.col("recorda").alias("a"), F.col("recordb").alias("b")))
    found = components(nodes, reduce(DataFrame.unionByName, [*links, second]))

    smallest = rows.where("n > 0").groupBy("record").agg(F.min("doc_id").alias("least"))
    named = smallest.join(found.withColumnRenamed("node", "record"), "record", "left").withColumn(
        "component", F.coalesce("component", "record")
    )
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_record = named.join(ids, "component").select("record", "component_id")
    # A set that very many documents repeat makes this join uneven; adaptive execution splits it.
    return rows.join(by_record, "record", "left").select(
        F.col("doc_id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
