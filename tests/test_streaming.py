"""The stream of traces against a batch over the same log, with a restart halfway."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tidemark.streaming.traces import append_stream, closed_counts, trace_stream

NOON = datetime(2025, 1, 1, 12, 0)


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(json.dumps({"trace_id": i, "timestamp": t.isoformat(), "query": "q", "refused": r, "analysis": {"intent": k, "product_area": None}}) for i, t, k, r in rows))


def made(first, count):
    return [(f"t{i}", NOON + timedelta(minutes=i), ("how_to", "opinion")[i % 2], i % 3 == 0) for i in range(first, first + count)]


def plain(rows):
    out = Counter()
    for _, t, kind, refused in rows:
        start = t - timedelta(minutes=t.minute % 10)
        out[start, kind, "questions"] += 1
        out[start, kind, "refused"] += refused
    return {(s, k): (out[s, k, "questions"], out[s, k, "refused"]) for s, k, _ in out}


def counted(spark, target):
    return {(r.start, r.intent): (r.questions, r.refused) for r in spark.read.parquet(target).collect()}


@pytest.mark.parametrize("files", [None, 1])
def test_counts_over_a_restart(spark, tmp_path, files):
    log, target, place = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "place")
    early, later = made(0, 60), made(60, 60)
    write(log, "a", early[:30])
    write(log, "b", early[30:])
    closed_counts(spark, str(log), target, place, files=files)
    before = counted(spark, target)
    write(log, "c", later)
    # Too late by hours, and one long after, which closes all windows before it.
    write(log, "d", [("late", NOON - timedelta(hours=5), "how_to", False)])
    write(log, "e", [("last", NOON + timedelta(hours=9), "how_to", False)])
    closed_counts(spark, str(log), target, place, files=files)
    closed_counts(spark, str(log), target, place, files=files)
    want = plain(early + later)
    assert counted(spark, target) == want and before.items() <= want.items()
    assert spark.read.parquet(target).count() == len(want)


def test_append_goes_on_where_it_was(spark, tmp_path):
    log, target, place = tmp_path / "log", str(tmp_path / "copy"), str(tmp_path / "place")
    for name, rows in (("a", made(0, 5)), ("b", made(5, 7))):
        write(log, name, rows)
        query = append_stream(trace_stream(spark, str(log)), target, place)
        query.processAllAvailable()
        query.stop()
    assert sorted(r.trace_id for r in spark.read.json(target).collect()) == sorted(f"t{i}" for i in range(12))
