"""Resampling, nearest neighbours and hard negatives against direct versions on small inputs."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from mailsieve.llm import importance_resampling, permutation_index, query_blocks, slot_negatives
from mailsieve.llm.importance_resampling import resample
from mailsieve.llm.permutation_index import nearest
from mailsieve.llm.slot_negatives import hard_negatives

VECTORS = "vec_id bigint, embedding array<double>, label int, id string, number string, dim string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "x", "x") for i, v, l in rows], VECTORS)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


# Importance resampling


def direct_resampling(docs, target, percent, least, longest, buckets, seed):
    def features(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]
        return len(found), [zlib.crc32(r.encode()) % buckets for r in runs]

    source, wanted = [features(t) for _, t in docs], [b for t in target for b in features(t)[1]]
    all_source = [b for _, f in source for b in f]
    s, t = np.bincount(all_source, minlength=buckets), np.bincount(wanted, minlength=buckets)
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (len(wanted) + 0.0 + len(all_source) - len(wanted) + buckets) / ((s[b] + 1) * (len(wanted) + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for at, ((doc, _), (words, found)) in enumerate(zip(docs, source)):
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, words >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranked = [(*r[:4], i + 1) for i, r in enumerate(able[: percent * len(able) // 100])]
    rest = able[len(ranked) :] + [r for r in rows if not r[4]]
    return sorted([*ranked, *((*r[:4], None) for r in rest)], key=repr)


@pytest.mark.parametrize("longest,percent", [(1, 50), (3, 100), (2, 0)])
def test_resampling_of_odd_documents(spark, odd_documents, longest, percent):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("same text here",), (None,), ("",), ("Écoute 12 mots",)], "text string")
    got = resample(odd_documents, target, percent, least_words=3, longest=longest, buckets=97)
    want = direct_resampling(rows, ["same text here", None, "", "Écoute 12 mots"], percent, 3, longest, 97, 2024)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_resampling_of_nothing(spark, no_documents, odd_documents):
    target = spark.createDataFrame([("a",)], "text string")
    assert resample(no_documents, target).collect() == []
    assert resample(odd_documents, target.limit(0), least_words=1).count() == odd_documents.count()


def test_resampling_prefers_the_target(spark):
    docs = [(i, ("apple pear plum " if i % 2 else "steel iron zinc ") * 10) for i in range(400)]
    target = spark.createDataFrame([("apple plum pear " * 20,)], "text string")
    got = resample(spark.createDataFrame(docs, "doc_id bigint, text string"), target).where("rank is not null").collect()
    assert len(got) == 40 and sum(r.doc_id % 2 for r in got) > 30


@pytest.mark.parametrize("spread", [1, 3, 10**18])
def test_cutoff_by_counts(spark, spread):
    keys = [int(x) * spread for x in np.random.default_rng(3).integers(-9, 9, 300)]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for wanted in (1, 7, 150, 299, 300):
        cut = sorted(keys, reverse=True)[wanted - 1]
        assert importance_resampling._cutoff(rows, F.col("k"), wanted) == (cut, sum(k > cut for k in keys))


def test_drawn_rows_are_ranked_through_ties(spark):
    rows = [(None if i % 7 == 0 else i // 3, f"one two three {i % 2}") for i in range(90)]
    target = spark.createDataFrame([("one",)], "text string")
    got = resample(spark.createDataFrame(rows, "doc_id bigint, text string"), target, 43, least_words=2, buckets=11)
    drawn = sorted(got.where("rank is not null").collect(), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 43 * 90 // 100 + 1))
    keys = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in drawn]
    assert keys == sorted(keys)
    out = min((-r.score, r.doc_id is None, r.doc_id or 0) for r in got.where("rank is null").collect())
    assert keys[-1] <= out


# Nearest neighbours


def direct_nearest(rows, asked, k):
    good = [(i, v) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    out = []
    for i, v in (r for r in good if asked(r[0])):
        found = {(-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v)}
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def rounded(rows):
    return sorted((*r[:3], round(r[3], 9)) for r in rows)


def test_odd_vectors_have_their_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-4, 5, 6).astype(float).tolist(), 1) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], 2) for i in range(30)]  # copies: ties
    rows += [(20, rows[20][1], 1), (20, rows[20][1], 1)]  # a repeated row
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 6, 1), (403, [None] + [1.0] * 5, 1), (404, [math.nan] * 6, 1)]
    rows += [(405, [math.inf] * 6, 1), (None, [1.0] * 6, 1), (420, [3.0, 4.0], 1), (421, [1.0, 1.0], 1), (440, [5.0], None)]
    got = nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect()
    assert rounded(map(tuple, got)) == rounded(direct_nearest(rows, lambda i: i % 20 == 0, 5))


def test_no_vectors_no_neighbours(spark):
    assert nearest(vectors(spark, []), F.lit(True)).collect() == []
    assert nearest(vectors(spark, [(1, [1.0], 1), (2, [0.0], 1)]), F.lit(True)).collect() == []


def test_longer_vectors_come_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * (1 + i % 9)).tolist(), 1) for i in range(3000)]
    got = nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=10).collect()
    want = {r[:1] + r[2:3] for r in direct_nearest(rows, lambda i: i % 100 == 0, 10)}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_recall_of_the_query(spark, sf):
    from mailsieve.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(table.embedding).astype(float)
    ids = table.vec_id.to_numpy()
    got = QUERIES["op12_nearest_neighbours"](spark, sf).toPandas()
    hits = 0
    for query in ids[ids % 20 == 0]:
        score = x @ x[ids == query][0]
        score[ids == query] = -np.inf
        own = got[got.query_id == query].sort_values("rank")
        order = np.lexsort((ids, -score))
        by_id = dict(zip(ids, score))
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, [by_id[v] for v in own.vec_id], rtol=0, atol=1e-12)
        hits += len(set(own.vec_id) & set(ids[order[:20]]))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_footrule_of_prefixes():
    rng = np.random.default_rng(2)
    prefixes = np.array([rng.permutation(12)[:5] for _ in range(40)], np.int16)
    gains = permutation_index._Files(prefixes, 12).gains(prefixes)
    for a in range(40):
        for b in range(40):
            one, two = ({p: i for i, p in enumerate(prefixes[x])} for x in (a, b))
            distance = sum(abs(one.get(p, 5) - two.get(p, 5)) for p in one | two)
            assert distance == 5 * 6 - 2 * gains[a, b]


def test_calibration_ends_with_everything():
    plan = permutation_index.calibrate(np.random.default_rng(0).standard_normal((300, 40)) * 1e-9, 1.0, 299)
    assert plan.share > 0.9


def test_shape_of_the_grid():
    assert query_blocks.shape(0, 0, 20, 8) == (1, 1)
    assert query_blocks.shape(500, 10_000, 20, 12) == query_blocks.shape(2_500, 50_000, 20, 12) == (1, 12)
    assert query_blocks.shape(10**6, 10**6, 20, 8000) == (134, 60)
    blocks, stripes = query_blocks.shape(10**8, 10**9, 20, 100)
    assert blocks * query_blocks.QUERIES >= 10**8 and stripes == 1


# Hard negatives


def direct_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    good = [(i, v, l) for i, v, l in rows if i is not None and l is not None and usable(v) and sum(x * x for x in v) < 2**53]
    out = []
    for i, v, label in (r for r in good if anchor(r[0])):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, l) for j, w, l in good if j != i and len(w) == len(v))
        for p, own, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(n, j) for n, j, l in scored if l != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(i, own, rank, j, -p, -n) for rank, (n, j) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def whole(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 7) for i, v, l in rows], "vec_id bigint, vector array<bigint>, label int, slot string, score int")


@pytest.mark.parametrize("anchors,rows_a_stripe", [(32_768, 256), (3, 10)])
def test_negatives_of_odd_rows(spark, monkeypatch, anchors, rows_a_stripe):
    monkeypatch.setattr(query_blocks, "QUERIES", anchors)
    monkeypatch.setattr(query_blocks, "ROWS", rows_a_stripe)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 9, 4).tolist(), int(rng.integers(0, 4))) for i in range(160)]
    rows += [(200 + i, [2, 2, 2, 2], i % 3) for i in range(80)]  # copies: ties
    rows += [(10, rows[10][1], rows[10][2]), (33, rows[33][1], rows[33][2])]  # repeated rows, one of them an anchor
    rows += [(500, None, 1), (510, [1, 2, 3, 4], None), (None, [1, 2, 3, 4], 1), (520, [], 1), (530, [None, 1, 1, 1], 1)]
    rows += [(540, [0, 0, 0, 0], 1), (550, [3, 1], 2), (551, [2, 1], 2), (552, [1, 1], 3), (560, [2**40, 0, 0, 0], 1)]
    got = hard_negatives(whole(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == direct_negatives(rows, lambda i: i % 10 == 0)


def test_no_rows_no_negatives(spark):
    assert hard_negatives(whole(spark, []), F.lit(True)).collect() == []
    assert hard_negatives(whole(spark, [(0, [1], 1), (1, [1], 1)]), F.lit(True)).collect() == []


def test_best_of_slots_over_batches():
    best = slot_negatives._Best(2, 3)
    rng = np.random.default_rng(4)
    seen = []
    for _ in range(6):
        place, ids, scores = rng.integers(0, 6, 50), rng.integers(0, 99, 50), rng.integers(0, 9, 50).astype(float)
        seen += zip(place.tolist(), (-scores).tolist(), ids.tolist())
        best.add(place, ids, scores)
    want = [r for p in range(6) for r in sorted(x for x in seen if x[0] == p)[:3]]
    assert list(zip(best.place.tolist(), (-best.scores).tolist(), best.ids.tolist())) == want
    assert best.least(3)[0, 0] == -want[2][1]
