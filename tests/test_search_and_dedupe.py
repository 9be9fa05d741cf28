"""Indexed phrase search, the earliest message of arriving batches, and merged sender sketches."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.operators import analyses as an
from mailsieve.operators.search_index import build_index, candidates, indexed_search, trigrams
from mailsieve.plans.mailbox import dump
from mailsieve.sources import files
from mailsieve.sources.messages import DUMP_SCHEMA, land_messages, read_landed, stream_messages, with_parts
from mailsieve.sources.session import work_path
from mailsieve.streaming.dedupe import dedupe_arriving, dedupe_batch, read_deduped


@pytest.fixture(scope="module")
def mail(spark, sf):
    path = work_path(spark, "landed")
    land_messages(dump(spark, sf).drop("headers"), path)
    return read_landed(spark, path)


@pytest.fixture(scope="module")
def index(spark, mail):
    path = work_path(spark, "index")
    build_index(mail, path)
    return path


@pytest.mark.parametrize("phrase", ["Que La", "the", "de", "", "no such phrase anywhere", "éo", "çã", "th the"])
def test_indexed_search_equals_the_full_one(spark, mail, index, phrase):
    want = sorted(map(tuple, an.body_search(mail, phrase).collect()))
    assert sorted(map(tuple, indexed_search(mail, index, phrase).collect())) == want


def test_a_search_renders_candidates_only(spark, mail, index):
    text = an.body_search(mail, "").where("length(body_text) > 40").orderBy("id").first().body_text
    phrase = text[10:30]
    hits = indexed_search(mail, index, phrase).count()
    few = candidates(spark, index, phrase).count()
    assert 1 <= hits <= few < mail.count() / 4
    plan = indexed_search(mail, index, phrase)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(gram" in plan and "PartitionFilters: [" in plan


def test_trigrams():
    assert trigrams("ab").tolist() == trigrams("").tolist() == []
    assert len(trigrams("abcabc")) == 3  # abc, bca, cab
    assert set(trigrams("bcd")) <= set(trigrams("abcde")) and len(trigrams("a😀bc")) == 2
    assert trigrams("\ud800ab").dtype == np.int64


def _row(i, key, at):
    headers = [{"name": "Message-ID", "value": key}] if key else []
    return (f"m{i:03}", at, "t", None, None, json.dumps({"headers": headers}))


def test_arriving_copies_keep_the_earliest(spark, tmp_path):
    draw = random.Random(3)
    rows = [
        _row(i, draw.choice([None, "<a>", "<b>", "<c>", "<d>"]), datetime(2024, 5, 1) - timedelta(days=draw.randint(0, 9)))
        for i in range(80)
    ]
    source, path, progress = (str(tmp_path / x) for x in ("in", "kept", "progress"))
    for at in range(0, 80, 20):
        spark.createDataFrame(rows[at : at + 20], DUMP_SCHEMA).coalesce(1).write.mode("append").json(source)
        kept = dedupe_arriving(stream_messages(spark, source, files_per_batch=1), path, progress)
        batch = an.dedupe_message_id(with_parts(spark.createDataFrame(rows[: at + 20], DUMP_SCHEMA)))
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    last = max(int(n) for n in files.names(spark, f"{progress}/commits") if n.isdigit())
    files.remove(spark, f"{progress}/commits/{last}")  # the last batch runs again
    again = dedupe_arriving(stream_messages(spark, source, files_per_batch=1), path, progress)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_keys_settle_when_their_delay_is_over(spark, tmp_path):
    path = str(tmp_path)

    def fold(batch, rows, day):
        messages = with_parts(spark.createDataFrame(rows, DUMP_SCHEMA))
        dedupe_batch(messages, path, batch, "3 days", F.lit(datetime(2024, 1, day)))

    def settled():
        return sorted(r.id for r in read_deduped(spark, path, settled_only=True).collect())

    fold(0, [_row(1, "<a>", datetime(2024, 1, 5)), _row(2, None, datetime(2024, 1, 5))], 10)
    assert settled() == [] and read_deduped(spark, path).count() == 2
    fold(1, [_row(3, "<a>", datetime(2024, 1, 1)), _row(4, "<b>", None)], 12)
    assert settled() == []
    fold(2, [_row(5, "<c>", datetime(2024, 1, 1))], 13)
    assert settled() == ["m002", "m003"]  # the later copy was the earlier message
    fold(3, [_row(6, "<a>", datetime(2024, 1, 1))], 30)
    assert settled() == ["m002", "m003", "m004", "m005"]
    assert sorted(r.id for r in read_deduped(spark, path).collect()) == ["m002", "m003", "m004", "m005", "m006"]
    assert len(files.names(spark, f"{path}/held")) == 2


def test_sketches_of_days_merge_to_months(spark, mail):
    sketches = an.sender_sketches(mail)
    assert sketches.count() > 1
    halves = sketches.where("dayofmonth(day) < 15").unionByName(sketches.where("dayofmonth(day) >= 15"))
    rows = an.sender_months_check(mail, halves).collect()
    assert rows and all(r.estimate_is_near for r in rows)
