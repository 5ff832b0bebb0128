import random

import pytest

from sparktrace.operators import linking

SCHEMA = "event_id long, event_type string, start_us long, end_us long, duration_us long, dataset_id string, user string, usr_raw string, process string, thread string, session string, connect_id string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def call(i, start, end, session="A", **over):
    base = dict(event_id=i, event_type="CALL", start_us=start, end_us=end, duration_us=end - start, dataset_id="d", user="U", usr_raw="U", process="p", thread="7", session=session, connect_id=None)
    return tuple((base | over).values())


def event(i, end, session="A", **over):
    base = dict(event_id=i, event_type="DBPOSTGRS", start_us=None if end is None else end - 1, end_us=end, duration_us=1, dataset_id="d", user="U", usr_raw="U", process="p", thread="7", session=session, connect_id=None)
    return tuple((base | over).values())


def decisions(spark, rows, least=2):
    return {r.event_id: r for r in linking.link(frame(spark, rows), least).select("event_id", "parent_call_id", "status", "reason_code", "candidate_count", "eligible_count", "fallback_applied").collect()}


def test_boundaries_and_nesting(spark):
    d = decisions(spark, [call(1, 0, 10), call(2, 6, 8), event(11, 7), event(12, 8), event(13, 0), event(14, 10), event(15, 11)])
    assert [d[i].parent_call_id for i in (11, 12, 13, 14, 15)] == [1, 1, 1, 1, None]
    assert [d[i].status for i in (11, 12, 13, 14, 15)] == ["ambiguous", "ambiguous", "linked_unique", "linked_unique", "unlinked"]


def test_session_preference(spark):
    d = decisions(spark, [call(1, 2, 12, "A"), call(2, 4, 14, "B"), event(11, 7, "B"), event(12, 7, "C"), event(13, 7, None)])
    assert [(d[i].parent_call_id, d[i].status, d[i].fallback_applied, d[i].eligible_count) for i in (11, 12, 13)] == [(2, "linked_unique", False, 1), (1, "ambiguous", True, 2), (1, "ambiguous", True, 2)]


def test_reasons(spark):
    rows = [call(1, 0, 10), event(11, 5, "B"), event(12, 5, None), event(13, None), event(14, 5, thread=""), event(15, 5, user="other"), event(16, 5, usr_raw=" ")]
    d = decisions(spark, rows)
    assert [d[i].reason_code for i in range(11, 17)] == ["session_no_match", "missing_session", "missing_timestamp", "missing_thread", "no_containing_call", "missing_user_or_process"]


@pytest.mark.parametrize("seed", [0, 1, 7, 42])
def test_against_naive(spark, seed):
    rng = random.Random(seed)
    pick = lambda: dict(user=rng.choice("UV"), process=rng.choice(["p", ""]), thread=rng.choice(["7", "8", "", None]))
    calls = [call(i, s := rng.randint(0, 60), s + rng.randint(0, 30), rng.choice(["A", "B", "", " ", None]), **pick()) for i in range(1, 46)]
    events = [event(100 + i, rng.choice([None, rng.randint(0, 90)]), rng.choice(["A", "B", "", " ", None]), usr_raw=rng.choice(["U", "", None]), **pick()) for i in range(120)]
    d = decisions(spark, calls + events, least=rng.choice([0, 3, 20]))
    for e in events:
        found = [c for c in calls if e[3] is not None and e[9] and (c[5], c[6], c[8], c[9]) == (e[5], e[6], e[8], e[9]) and c[2] <= e[3] <= c[3]]
        match = [c for c in found if e[10] and c[10] == e[10]]
        best = min(match or found, key=lambda c: (-c[4], c[0]), default=None)
        got = d[e[0]]
        assert got.parent_call_id == (best and best[0])
        assert got.candidate_count == len(found)
        fallback = bool(found) and (not match or not (e[7] or "").strip() or not e[8])
        assert got.fallback_applied == fallback
        assert got.status == ("unlinked" if not found else "ambiguous" if len(match or found) > 1 else "linked_by_rule" if fallback else "linked_unique")


def test_short_calls_of_a_busy_scope_meet_few_events(spark):
    """Calls of a millisecond, one after another, beside a few of hours: pairs tried stay near the pairs found."""
    calls = [call(i, 1000 * i, 1000 * i + 900) for i in range(4000)] + [call(9000 + i, 0, 4_000_000) for i in range(3)]
    events = [event(10_000 + i, 1000 * i + 500) for i in range(4000)]
    frames = [frame(spark, rows) for rows in (events, calls)]
    found = linking.candidates(*frames, least=10)
    assert found.count() == 16_000
    timed = frames[1].withColumn("level", linking.level_of("start_us", "end_us", 10))
    tried = timed.selectExpr("level", "explode(sequence(shiftright(start_us, level), shiftright(end_us, level))) bin").crossJoin(frames[0].select("end_us")).where("bin = shiftright(end_us, level)")
    assert tried.count() < 4 * 16_000


def test_levels(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1024), (0, 1025), (-5, 4096 * 4), (7, 2**50 + 1)], "s long, e long")
    got = [r.w for r in rows.select(linking.level_of("s", "e", 10).alias("w")).collect()]
    assert got == [10, 10, 12, 16, 50] and all(2**w >= e - s for w, (s, e) in zip(got, [(0, 0), (0, 1024), (0, 1025), (-5, 4096 * 4), (7, 2**50)], strict=True))
