"""Operators on pairs and on the whole corpus, against brute force; the pipeline."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from mailsieve.llm import byte_convnet
from mailsieve.llm.common import components
from mailsieve.llm.context_mixing import score_documents
from mailsieve.llm.projection_dedup import calibrate, near_vectors
from mailsieve.llm.trie_join import needed, similar_documents, walk
from mailsieve.llm.words import shingle_sets


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def reach(n, linked):
    """Smallest index reachable from each index."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    label = reach(len(rows), linked)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[label[i]] = min(doc, least.get(label[i], doc))
    return [(doc, len(s), least.get(label[i])) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def families(seed=3, groups=12):
    """Texts with copies at all distances around the threshold, and a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 6, 30, 80, 150]))
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(" ".join(rng.choices(words, k=40) + passage))
        texts.append(" ".join(rng.choices(words, k=8) + passage))
    return texts + texts[:5] + ["", "   ", None, "One two", "one TWO"]


def test_similar_documents(spark):
    rows = list(enumerate(families()))
    got = similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_classes(rows))


def test_similar_documents_of_odd_rows(odd_documents, no_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    got = similar_documents(odd_documents).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_classes(rows)))
    assert similar_documents(no_documents).count() == 0


def test_walk_is_exact():
    rng = np.random.default_rng(1)
    lead = np.unique(rng.integers(0, 1000, 300).astype(np.uint64))
    members = [np.unique(rng.permutation(lead)[: rng.integers(1, len(lead))]) for _ in range(60)]
    members += [np.unique(np.concatenate([m, rng.integers(0, 1000, 40).astype(np.uint64)])) for m in members] + [lead]
    want = [100 * len(np.intersect1d(m, lead)) >= 75 * len(np.union1d(m, lead)) for m in members]
    assert walk(members, lead).tolist() == want and any(want) and not all(want)
    assert [needed(a, b) for a, b in ((4, 4), (7, 7), (100, 75))] == [4, 6, 75]


def test_shingle_hashes_follow_words():
    a, b, c, d = shingle_sets([b"a b c d e f", b"A  B\tc\nd e F ", b"ab c d e f", b"a b c"])
    assert a.tolist() == b.tolist() and len(a) == 2 and not set(a) & set(c) and len(d) == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    nodes = spark.range(150).withColumnRenamed("id", "node")
    got = components(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert [r.component for r in sorted(got)] == reach(150, edges)
    none = components(nodes, spark.createDataFrame([], "a bigint, b bigint"))
    assert none.where("node != component").count() == 0


def brute_links(rows, cosine):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64) / max(map(abs, v))
        return v / np.linalg.norm(v)

    units = [unit(v) if i is not None else None for i, v in rows]
    linked = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b])
        and units[a] @ units[b] >= cosine
    ]
    degree = [0] * len(rows)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    label, least = reach(len(rows), linked), {}
    for i, (vec, _) in enumerate(rows):
        least[label[i]] = min(vec, least.get(label[i], vec)) if vec is not None else None
    return [(vec, degree[i], least[label[i]], vec == least[label[i]] or vec is None) for i, (vec, _) in enumerate(rows)]


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    near = [b + rng.standard_normal(16) * s for b in base[:10] for s in (0.02, 0.05, 0.1, 0.1)]
    hot = [base[0] + rng.standard_normal(16) * 0.01 for _ in range(700)]  # a list that must be split
    vectors = [v.tolist() for v in [*base, *near, *hot]] + [(base[1] * 2).tolist(), base[2].tolist()]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(vectors)) + [(3, vectors[3]), (None, vectors[3]), (2_000, [1e-40] * 16)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    want = brute_links(rows, 0.9)
    assert len(got) == len(want)
    found, asked = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert 0.95 * asked <= found <= asked
    clear = {w for w in want if w[1] == 0}
    assert clear <= {tuple(r) for r in got}


def test_calibration_reaches_its_recall():
    for dim, directions in ((16, 256), (64, 1024)):
        tails, need = calibrate(dim, directions, 0.9)
        assert need >= 1 and 4 <= tails <= 64
    assert near_recall() >= 0.9


def near_recall():
    """Share of simulated pairs at the threshold that meet in a list, for other pairs than the calibration's."""
    from mailsieve.llm.projection_dedup import WINDOW, _directions, _furthest

    tails, need = calibrate(64, 1024, 0.9)
    rng = np.random.default_rng(99)
    a = rng.standard_normal((500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((500, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    la, ra = _furthest(a, _directions(64, 1024), tails)
    lb, rb = _furthest(0.9 * a + math.sqrt(0.19) * b, _directions(64, 1024), tails)
    same = (la[:, :, None] == lb[:, None, :]) & (np.abs(ra[:, :, None] - rb[:, None, :]) <= WINDOW)
    return (same.sum(axis=(1, 2)) >= need).mean()


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert near_vectors(empty).count() == 0


def test_scores(spark, sf, odd_documents, no_documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    rows = score_documents(docs, train).collect()
    words = {r.doc_id: lower(r.text).encode().split() + [None] for r in docs.collect()}
    learned = {r.doc_id for r in rows if r.train}
    counts = {}
    for doc in learned:
        for w in words[doc]:
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(words)
    for r in rows:
        own = words[r.doc_id]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r.n_tokens, r.n_known) == (len(own), sum(w in counts for w in own)) and r.train_tokens == total
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    odd = score_documents(odd_documents, F.lit(True)).collect()
    assert len(odd) == odd_documents.count() and all(r.n_known == r.n_tokens for r in odd)
    assert {r.n_tokens for r in odd if r.doc_id in (3, 4, 5)} == {1}
    untaught = score_documents(odd_documents, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untaught)
    assert score_documents(no_documents, F.lit(True)).count() == 0


def test_a_model_is_a_distribution():
    from mailsieve.llm.context_mixing import ORDERS, WORD_CONTEXTS, Code, Model, code_bits, spelled_bits

    rng = np.random.default_rng(0)
    counts = rng.integers(0, 1 << 16, (len(ORDERS), 1 << 12)).astype(np.uint16)
    model = Model(counts, len(ORDERS))
    one_byte = [bytes([b]) for b in range(256)]  # each followed by the same blank
    (told,) = spelled_bits(one_byte, 12)
    told.owner[1::2] = 256
    assert np.isclose((10 ** model.log10(told, 257)[:256]).sum(), 1, rtol=1e-5)

    code = Code.of(np.array([3, 0.5, 9, 4, 2, 2, 2, 0.5]))
    words = Model(counts[:WORD_CONTEXTS], WORD_CONTEXTS + 1)
    before = np.array([5, 3])  # the next word, after the same two
    total = 0
    for word in range(len(code.size)):
        ids = np.append(before, word)
        (told,) = code_bits(code, ids, np.arange(3) == 0, 12)
        total += 10 ** words.log10(told, 3)[2]
    assert np.isclose(total, 1, rtol=1e-5)


def test_a_code_is_the_shortest():
    from mailsieve.llm.context_mixing import Code

    code = Code.of(np.array([8, 1, 1, 2, 4, 16], float))
    assert code.size.tolist() == [2, 5, 5, 4, 3, 1]
    paths = {tuple(code.bit[a : a + n]) for a, n in zip(code.start, code.size, strict=True)}
    assert len(paths) == 6 and not any(p != q and q[: len(p)] == p for p in paths for q in paths)


def test_slots_count_every_bit_once(spark):
    """Rare words train the spelling as often as their bits, in any number of tasks."""
    from mailsieve.llm.context_mixing import _COARSE, ORDERS, _bit_counts, spelled_bits

    words = ["once", "other", "x"]

    def told(batches):
        for batch in batches:
            yield from spelled_bits([w.encode() for w in batch.column("word").to_pylist()], 12)

    rows = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    found = _bit_counts(rows, told, len(ORDERS), 12)
    want = np.zeros((len(ORDERS), 1 << 12, 2))
    for word in words:
        for part in spelled_bits([word.encode()], 12):
            for kind, slots in enumerate(part.slots):
                np.add.at(want[kind], (slots, part.value), 1)
    assert want.sum() == len(ORDERS) * 8 * (sum(map(len, words)) + len(words))
    stored = np.rint(np.log2(1 + want) * _COARSE).astype(np.int64)
    assert (found == (stored[..., 0] << 8) + stored[..., 1]).all()


def test_four_bits_in_a_row_share_a_block_of_slots():
    from mailsieve.llm.context_mixing import Code, code_bits, spelled_bits

    rng = np.random.default_rng(1)
    code = Code.of(rng.integers(1, 1000, 300).astype(float))
    ids = rng.integers(0, 300, 50)
    (told,) = code_bits(code, ids, np.arange(50) == 0, 16)
    for begin, size in zip(told.runs, code.size[ids], strict=True):
        for slots in told.slots:
            own = slots[begin : begin + size]
            for four in (own[at : at + 4] for at in range(0, size, 4)):
                assert len(set(four // 16)) == 1 and len(set(four)) == len(four)
    (told,) = spelled_bits([b"some", b"words"], 16)
    for slots in told.slots:
        assert (slots.reshape(-1, 4) // 16 == slots.reshape(-1, 4)[:, :1] // 16).all()


def test_texts_are_numbered_by_their_words():
    """White space at the ends and in runs, words split by the six ASCII spaces only, null and blank texts."""
    from mailsieve.llm.context_mixing import numbered

    texts = [" b\tA  c\x0bb\x0cnew\r\n", None, "", " \n ", "\u00c4 x\u00a0y\x1cz a", "b"]
    names = ["a", "b", "c"]
    ids, strange = numbered(pa.array(names), pa.array(texts))
    for text, own, strangers in zip(texts, ids.to_pylist(), strange.to_pylist(), strict=True):
        words = [w.decode() for w in (text or "").encode().lower().split()]
        found = np.frombuffer(own, np.int32).tolist()
        assert found.pop() == 0 and len(found) == len(words)
        assert [names[i - 2] for i in found if i < 5] == [w for w in words if w in names]
        assert strangers == [w for w in words if w not in names]
    ids, strange = numbered(pa.array([], pa.string()), pa.array(["a b"]))
    assert strange.to_pylist() == [["a", "b"]] and len(ids[0].as_py()) == 12


def test_scores_know_the_order_of_words(spark):
    """Words in a known order score higher than the same words in another; bits per byte follow the score."""
    from mailsieve.llm import context_mixing as m

    text = "the cat sat on the mat and the dog sat on the log"
    docs = [(i, text) for i in range(30)] + [(100, "the dog sat on the cat"), (101, "cat the on sat dog the"), (102, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in m.score_documents(frame, F.col("doc_id") < 100).collect()}
    assert rows[100].score > rows[101].score + 1 and math.isclose(rows[100].base_score, rows[101].base_score)
    assert rows[102].bits_per_byte is None and rows[102].n_tokens == 1
    assert math.isclose(rows[100].bits_per_byte, -rows[100].score * math.log2(10) / len(docs[30][1]))


def test_held_out_texts_score_above_the_base(spark):
    """On 1,000 documents, though new words are spelled and cost the base a single small count (on 100 they are too many)."""
    from mailsieve.llm.queries import op3

    held = op3(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] and held[2] > 0


def test_escaped_words_seen_before_are_priced_by_their_count(spark):
    """A word seen once costs less than its spelling, and the share of such words follows from the counts."""
    from mailsieve.llm import context_mixing as m

    words = spark.createDataFrame([("", 9), ("a", 1), ("b", 1), ("c", 2), ("d", 7), ("e", 0)], "word string, n bigint")
    assert math.isclose(m._listed_share(words, 2), (2 + 0.5) / (2 + 2 + 1))
    assert m._listed_share(words.where("n = 0"), 2) == 0.5  # no evidence
    docs = [(i, "some words that come often") for i in range(20)] + [(50, "unheardof"), (51, "qzxjkvwyp"), (60, "unheardof"), (61, "qzxjkvwyq")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in m.score_documents(frame, F.col("doc_id") < 60).collect()}
    assert rows[60].score > rows[61].score and rows[60].n_known == 2 and rows[61].n_known == 1


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    network = byte_convnet.train(byte_convnet.training_windows(docs, "doc_id", "text", "lang"))
    spoken = byte_convnet.identify(docs, network).where("lang_pred != 'und' AND score >= 0.3")
    last = {}
    for r in spoken.select("doc_id", "text").collect():
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    rows = sorted((doc, text) for text, doc in last.items())
    kept = {doc for doc, _, least in brute_classes(rows) if doc == least}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for doc, text in rows:
        if doc in kept:
            ids = library.encode(text)
            digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            want.add((doc, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_stages_on_odd_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert tuple(rows.columns) == corpus_pipeline.COLUMNS
        corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()


def test_dedup_stages_keep_one_row_of_each_group(spark, odd_documents):
    docs = odd_documents.where("text IS NOT NULL")
    once = corpus_pipeline.exact(spark, docs, "")
    last = {}
    for r in docs.collect():
        last[r.text] = max(last.get(r.text, -1), -1 if r.doc_id is None else r.doc_id)
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.text)
    assert sorted(map(key, once.collect())) == sorted((i, t) for t, i in last.items())
    assert (-1, "no id but some words here") in map(key, once.collect())
    rows = [tuple(r) for r in once.select("doc_id", "text").collect()]
    alone = [(-1 if i is None else i) for i, _, least in brute_classes(rows) if i == least]
    assert sorted(key(r)[0] for r in corpus_pipeline.near(spark, once, "").collect()) == sorted(alone)

    same = " ".join(f"w{i}" for i in range(40))
    rows = [(5, "x"), (5, "y"), (9, "y"), (5, "x"), (7, same), (7, same + " z"), (None, same + " q"), (None, "alone"), (7, "other")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    once = corpus_pipeline.exact(spark, docs, "").select("doc_id", "text").collect()
    want = [(5, "x"), (9, "y"), (7, same), (7, same + " z"), (None, same + " q"), (None, "alone"), (7, "other")]
    assert sorted(map(str, map(tuple, once))) == sorted(map(str, want))
    left = [tuple(r) for r in corpus_pipeline.near(spark, docs, "").select("doc_id", "text").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(5, "x"), (5, "y"), (7, same), (None, "alone"), (7, "other")]))


def brute_mixture(rows, block_rows=16):
    """Rows ``(doc_id, source)`` in the order of the mixture: one slot after the other, earliest deadline first."""
    from mailsieve.llm.pfair_mixing import UNIT, quotas

    queues = {}
    for doc, source in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        queues.setdefault(source, []).append(doc)
    weights = {s: len(queues[s]) ** 0.5 for s in sorted(queues)}
    blocks = {s: [q[i : i + block_rows] for i in range(0, len(q), block_rows)] for s, q in queues.items()}
    out = []
    while blocks:
        share = quotas({s: w for s, w in weights.items() if s in blocks}, UNIT)
        names, done, slot = list(share), dict.fromkeys(share, 0), 0
        while all(blocks.values()):
            free = [s for s in names if done[s] * UNIT // share[s] <= slot]
            s = min(free, key=lambda s: (-(-(done[s] + 1) * UNIT // share[s]), names.index(s)))
            out += blocks[s].pop(0)
            done[s] += 1
            slot += 1
        blocks = {s: b for s, b in blocks.items() if b}
    return out


def test_pipeline_returns_the_place_in_the_mixture(spark):
    from mailsieve.llm.common import written

    rows = [(i, "word " * (1 + 40 * (i % 17)), "en", "abc"[(i % 7) // 3], 1) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        mixed = written(stages["mixing"](spark, docs, ""), "mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(mixed.inputFiles()) > 1
    want = brute_mixture([(r[0], r[3]) for r in rows])
    for read in (mixed, mixed.select("*")):
        got = sorted(stages["sentence_pieces"](spark, read, "").collect(), key=lambda r: r.place)
        assert [r.place for r in got] == list(range(700)) and [r.doc_id for r in got] == want
    unwritten = stages["sentence_pieces"](spark, stages["mixing"](spark, docs, ""), "").collect()
    assert [r.doc_id for r in sorted(unwritten, key=lambda r: r.place)] == want


def crowds(seed=9):
    """Near copies at all distances and texts that are mostly one passage: more of each than a shingle may pair."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage, base = rng.choices(words, k=50), rng.choices(words, k=60)
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 14)) + passage) for _ in range(60)]
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_crowded_shingles_lose_no_link(spark, monkeypatch):
    from mailsieve.llm import trie_join

    rows = list(enumerate(crowds()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(brute_classes(rows))
    assert len({w[2] for w in want}) > 5 and max(w[2] for w in want) > 0
    for crowd, group, worth, sure in ((64, 256, 0.1, 12), (16, 7, 2.0, 12), (16, 7, 2.0, 3)):
        monkeypatch.setattr(trie_join, "CROWD", crowd)
        monkeypatch.setattr(trie_join, "GROUP", group)
        monkeypatch.setattr(trie_join, "_WORTH", worth)
        monkeypatch.setattr(trie_join, "_SURE", sure)
        assert sorted(map(tuple, similar_documents(docs).collect())) == want


def test_sketches_rule_out_no_link():
    from mailsieve.llm.trie_join import may_link, sketch

    rng = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64))
        kept = a[rng.random(len(a)) < rng.choice([0.3, 0.8, 0.9, 1.0])]
        b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, rng.integers(0, 200)).astype(np.uint64)]))
        if len(b):
            links = 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
            may = may_link(sketch(a), sketch(b), len(a), len(b))
            assert may or not links
            ruled_out += not may
    assert ruled_out > 150
