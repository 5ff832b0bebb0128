"""Owner decisions: which call an event belongs to, with the evidence.

The join has equality on the scope, on a level and on a time bin. A call's level gives bins no
narrower than the call and under four times as wide (or LEAST wide), so it is listed under two bins at most;
an event looks into its bin of every level that calls have. Pairs that meet in vain are as many as
calls of the same length nearby, and a busy scope is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrace.functions.text import key_relation

SCOPE = ["dataset_id", "user", "process", "thread"]
#: Power of two of the narrowest bins' width (about a second), and of the widest.
LEAST, MOST = 20, 60


def level_of(start: str, end: str, least: int = LEAST) -> Column:
    """Power of two of the width of a call's bins: every second one from least on."""
    long = F.greatest(F.col(end) - F.col(start), F.lit(1)).cast("double")
    return F.least(F.lit(MOST), F.greatest(F.lit(least), least + 2 * F.ceil((F.log2(long) - least) / 2))).cast("int")


def candidates(events: DataFrame, calls: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs of an event and a call of its scope with call.start <= event.end <= call.end."""
    timed = calls.where("start_us is not null").withColumn("level", level_of("start_us", "end_us", least))
    levels = F.broadcast(timed.agg(F.sort_array(F.collect_set("level")).alias("levels")))  # one row of (MOST - least) / 2 + 1 numbers at most
    each = events.where("end_us is not null and coalesce(thread, '') <> ''").select(
        *SCOPE, "event_id", "end_us", F.col("start_us").alias("event_start_us"), F.col("session").alias("event_session"), F.col("connect_id").alias("event_connect"),
    ).join(levels).withColumn("level", F.explode("levels")).withColumn("bin", F.expr("shiftright(end_us, level)")).drop("levels")
    own = timed.select(
        *SCOPE, F.col("event_id").alias("call_id"), F.col("start_us").alias("call_start"), F.col("end_us").alias("call_end"),
        F.col("duration_us").alias("call_duration"), F.col("session").alias("call_session"), F.col("connect_id").alias("call_connect"),
        "level", F.explode(F.expr("sequence(shiftright(start_us, level), shiftright(end_us, level))")).alias("bin"),
    )
    pairs = each.join(own, [*SCOPE, "level", "bin"]).where("call_start <= end_us and end_us <= call_end")
    return pairs.withColumn("session_match", F.expr("coalesce(event_session, '') <> '' and event_session <=> call_session"))


def decide(events: DataFrame, pairs: DataFrame, *more: str) -> DataFrame:
    """One row per event: owner call, status, reason and counts, beside further columns on request. Partial aggregates; no list of candidates is kept."""
    best = F.struct("call_duration", -F.col("call_id"))
    some = pairs.groupBy("event_id").agg(
        F.count("*").alias("candidate_count"),
        F.count_if("session_match").alias("session_match_count"),
        F.max_by("call_id", best).alias("longest"),
        F.max_by(F.when(F.col("session_match"), F.col("call_id")), F.when(F.col("session_match"), best)).alias("longest_match"),
    )
    d = events.join(some, "event_id", "left").withColumns({"candidate_count": F.coalesce("candidate_count", F.lit(0)), "session_match_count": F.coalesce("session_match_count", F.lit(0))})
    matched = F.col("session_match_count") > 0
    fallback = ~matched | (F.trim(F.coalesce("usr_raw", F.lit(""))) == "") | (F.coalesce("process", F.lit("")) == "")
    d = d.withColumn("eligible_count", F.when(matched, F.col("session_match_count")).otherwise(F.col("candidate_count")))
    d = d.withColumn("parent_call_id", F.when(matched, F.col("longest_match")).otherwise(F.col("longest")))
    status = F.when(F.col("candidate_count") == 0, "unlinked").when(F.col("eligible_count") > 1, "ambiguous").when(fallback, "linked_by_rule").otherwise("linked_unique")
    reason = (
        F.when(F.col("end_us").isNull(), "missing_timestamp")
        .when(F.coalesce("thread", F.lit("")) == "", "missing_thread")
        .when(F.col("candidate_count") == 0, "no_containing_call")
        .when(F.col("eligible_count") > 1, "multiple_candidates_legacy_longest")
        .when(fallback & matched, "missing_user_or_process")
        .when(fallback & (F.coalesce("session", F.lit("")) == ""), "missing_session")
        .when(fallback, "session_no_match")
        .otherwise("same_session_unique")
    )
    return d.select(
        "event_id", *more, "parent_call_id", status.alias("status"), reason.alias("reason_code"), "candidate_count", "eligible_count", "session_match_count",
        ((F.col("candidate_count") > 0) & fallback).alias("fallback_applied"),
    )


def evidence(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per candidate pair with what spoke for and against it."""
    told = pairs.join(decisions.select("event_id", "parent_call_id", "session_match_count"), "event_id")
    eligible = (F.col("session_match_count") == 0) | F.col("session_match")
    selected = F.col("call_id") == F.col("parent_call_id")
    return told.select(
        "event_id", "call_id",
        key_relation("event_session", "call_session").alias("session_relation"),
        key_relation("event_connect", "call_connect").alias("connect_relation"),
        F.expr("call_start <= event_start_us and event_start_us <= end_us and end_us <= call_end").alias("full_interval_contained"),
        eligible.alias("eligible"), selected.alias("selected"),
        F.when(selected, "selected_legacy_rule").when(~eligible, "excluded_by_session_preference").otherwise("not_selected_duration_or_legacy_order").alias("reason_code"),
    )


def link(events: DataFrame, least: int = LEAST) -> DataFrame:
    """Decisions of all events that aren't calls, as columns beside the events; rows that share an id stay as many as they are."""
    calls, others = events.where("event_type = 'CALL'"), events.where("event_type <> 'CALL'")
    return decide(others, candidates(others, calls, least), *[c for c in others.columns if c != "event_id"])
