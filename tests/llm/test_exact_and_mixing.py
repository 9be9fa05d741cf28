import hashlib
import heapq

import pytest
from pyspark.sql import functions as F

from mailsieve.llm import pfair_mixing as pf
from mailsieve.llm.exact_dedup import exact_dedup


@pytest.mark.parametrize("bits", [4, 128])  # with 4 bits nearly every hash collides
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(odd_documents, bits, keep):
    rows = odd_documents.select("doc_id", "text").collect()
    got = exact_dedup(odd_documents, keep=keep, hash_bits=bits).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", []).append(r.doc_id)
    best = {t: (max if keep == "max" else min)([i for i in ids if i is not None] or [None]) for t, ids in by_text.items()}
    want = sorted(
        (str(r.doc_id), best[r.text or ""], len(by_text[r.text or ""]), r.doc_id == best[r.text or ""],
         hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in rows
    )
    assert sorted((str(g.doc_id), g.keep_id, g.group_size, g.kept, g.text_sha256) for g in got) == want


def test_exact_dedup_is_native(odd_documents, no_documents):
    plan = exact_dedup(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert exact_dedup(no_documents).count() == 0


def earliest_deadline_first(quotas, frame):
    """One slot after the other with a heap of released blocks."""
    waiting = sorted((i * frame // q, -(-(i + 1) * frame // q), s, i) for s, q in enumerate(quotas) for i in range(q))
    ready, out = [], []
    for slot in range(frame):
        while waiting and waiting[0][0] <= slot:
            release, due, s, i = waiting.pop(0)
            heapq.heappush(ready, (due, s, i))
        due, s, i = heapq.heappop(ready)
        assert slot < due
        out.append((slot, s, i))
    return out


@pytest.mark.parametrize("quotas", [[1, 2, 7], [5, 5], [10], [3, 3, 3, 1], [1] * 10])
def test_frame_schedule(spark, quotas):
    frame = sum(quotas)
    got = spark.range(1).select(pf._schedule(F.array(*map(F.lit, quotas)), frame).alias("s")).first().s
    assert [tuple(r) for r in got] == earliest_deadline_first(quotas, frame)
    for s, q in enumerate(quotas):
        for slot in range(frame + 1):
            done = sum(1 for r in got if r.source == s and r.slot < slot)
            assert abs(done - slot * q / frame) < 1


def test_mixture_follows_weights_and_is_whole(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 9 = 1 THEN 's1' ELSE 's2' END AS source")
    weights = {"big": 0.5, "s1": 0.2, "s2": 0.3}
    rows = pf.mix(docs, weights, frame=10, block_rows=2).orderBy("position").collect()
    assert sorted(r.doc_id for r in rows) == list(range(900))
    assert len({r.position for r in rows}) == 900
    first = [r for r in rows if r.phase == 0]
    seen = {}
    for n, r in enumerate(first, 1):
        seen[r.source] = seen.get(r.source, 0) + 1
        for s, w in weights.items():
            assert abs(seen.get(s, 0) - w * n) < 2 * 2  # less than a block, and the block at hand
    for phase in {r.phase for r in rows}:
        assert [r.slot for r in rows if r.phase == phase] == sorted(r.slot for r in rows if r.phase == phase)


def test_mixture_of_odd_rows(odd_documents, no_documents):
    mixed = pf.mix(odd_documents)
    assert mixed.count() == odd_documents.count()
    assert set(mixed.columns) == set(odd_documents.columns)  # clashing columns are replaced
    assert pf.mix(odd_documents, {"a": 1.0}).count() == odd_documents.count()
    assert pf.mix(no_documents).count() == 0
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_unlisted_sources_come_last(odd_documents):
    rows = pf.mix(odd_documents, {"a": 1.0}, block_rows=1).orderBy("position").collect()
    listed = [r.source == "a" for r in rows]
    assert listed == sorted(listed, reverse=True)


def test_quotas_add_up():
    assert pf.quotas({"x": 1, "y": 1, "z": 1}, 10) == {"x": 4, "y": 3, "z": 3}
    assert sum(pf.quotas({str(i): i**0.5 for i in range(1, 40)}, 1000).values()) == 1000


@pytest.mark.parametrize(
    "weights, sizes",
    [
        ({"big": 1 / 3} | {f"s{i}": 2 / 57 for i in range(19)}, {"big": 1000} | {f"s{i}": 106 for i in range(19)}),
        ({"most": 0.9996, "tiny": 0.0004}, {"most": 5997, "tiny": 3}),
    ],
)
def test_deviation_from_true_weights_over_many_frames(spark, weights, sizes):
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id bigint, source string")
    rows = pf.mix(docs, weights, frame=20, block_rows=1).orderBy("position").collect()
    assert len(rows) == sum(sizes.values()) and [r.position for r in rows] == list(range(len(rows)))
    assert rows == sorted(rows, key=lambda r: (r.phase, r.slot))
    first = [r.source for r in rows if r.phase == 0]
    assert len(first) > 0.9 * len(rows)
    seen = dict.fromkeys(weights, 0)
    for n, source in enumerate(first, 1):
        seen[source] += 1
        assert all(abs(seen[s] - w * n) < 1.001 for s, w in weights.items())
