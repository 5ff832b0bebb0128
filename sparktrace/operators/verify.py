"""Checks of saved tables: each gives a name and a number of violations, which must be zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.functions import counters, text


def count(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def conditions(rows: DataFrame, named: dict) -> DataFrame:
    """One pass over rows for any number of conditions that none may meet."""
    told = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in named.items()])
    return told.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in named])))


def links(decisions: DataFrame, evidence: DataFrame, calls: DataFrame, some: bool = False) -> DataFrame:
    """Decisions against their evidence; with some, evidence was only kept of some of the events."""
    selected = evidence.where("selected").groupBy("event_id").agg(F.count("*").alias("n"), F.min("call_id").alias("call_id"))
    parents = decisions.where("parent_call_id is not null")
    told = parents.join(evidence.select("event_id").distinct(), "event_id", "left_semi") if some else parents
    checks = {
        "more_than_one_selected": selected.where("n > 1"),
        "selected_is_not_the_parent": told.join(selected, "event_id", "left").where("not (parent_call_id <=> call_id)"),
        "parent_is_no_call": parents.join(calls.select(F.col("event_id").alias("parent_call_id")), "parent_call_id", "left_anti"),
        "selected_is_not_eligible": evidence.where("selected and not eligible"),
        "unlinked_with_candidates": decisions.where("status = 'unlinked' and candidate_count > 0"),
        "evidence_without_decision": evidence.join(decisions, "event_id", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [count(name, bad) for name, bad in checks.items()])


def event_store(events: DataFrame, files: DataFrame) -> list[DataFrame]:
    """Identities, byte ranges, intervals and counter states of saved events, computed again."""
    from sparktrace.plans.adapters import COUNTERS

    sha = F.sha2(F.concat(F.lit('["event/v1","'), "source_id", F.lit('",'), F.col("byte_start").cast("string"), F.lit(',"'), "raw_record_sha256", F.lit('"]')), 256)
    own = {
        "event_identity": F.col("event_sha256") != sha,
        "raw_record_hash": ~F.col("raw_record_sha256").rlike("^[0-9a-f]{64}$"),
        "byte_range": (F.col("byte_start") < 0) | (F.col("byte_start") >= F.col("byte_end")),
        "record_position": (F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")),
        "interval": F.col("end_us") - F.col("start_us") != F.col("duration_us"),
        "valid_counter_without_value": F.lit(False),
    }
    for name, minimum in COUNTERS.items():
        own["valid_counter_without_value"] = own["valid_counter_without_value"] | ((counters.state(f"{name}_raw", minimum) == "valid") != counters.value(f"{name}_raw", minimum).isNotNull())
    known = files.where("analyzed_bytes > 0").select("source_id", "analyzed_bytes")
    beyond = events.groupBy("source_id").agg(F.max("byte_end").alias("last")).join(known, "source_id", "left").where("analyzed_bytes is null or last > analyzed_bytes")
    version = files.where(F.col("source_version_id") != text.canonical_id("source-version/v1", F.col("source_id"), F.col("sha256")))
    return [conditions(events, own), count("events_beyond_their_source", beyond), count("source_version_identity", version)]


def error_store(failed: DataFrame, linked: DataFrame) -> list[DataFrame]:
    """Signatures, states and categories of saved errors, computed again, and that all errors are there."""
    state = text.message_state("message")
    named = {
        "error_signature": F.col("error_signature") != text.normalize_error("message"),
        "error_signature_id": F.col("signature_id") != text.canonical_id("error-signature/v2", text.ERROR_VERSION, state, text.normalize_error("message")),
        "error_category": F.col("category") != text.classify_error("message"), "message_state": F.col("message_state") != state,
        "incident_of_fallback_link": (F.col("incident_reason") == "same_call_exact_payload") & (F.col("status") != "linked_unique"),
    }
    ids = linked.where("event_type in ('EXCP', 'QERR')").select("event_id")
    return [conditions(failed, named), same("error_events", failed.select("event_id"), ids)]


def unique(rows: DataFrame, keys: list[str], name: str = "") -> DataFrame:
    return count(f"key_not_unique:{name + ':' if name else ''}{','.join(keys)}", rows.groupBy(*keys).count().where("count > 1"))


def same(name: str, saved: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows in one of the two and not in the other, repeats counted; rows are told apart by 128 bits and where they have nulls, so only those are shuffled."""

    def told(rows: DataFrame, sign: int) -> DataFrame:
        columns = [F.to_json(c) if t.startswith("map") else F.col(f"`{c}`") for c, t in saved.dtypes]
        nulls = F.concat(*[F.when(F.isnull(c), "0").otherwise("1") for c in columns])
        return rows.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), nulls, *columns).alias("b"), F.lit(sign).alias("n"))

    both = told(saved, 1).unionAll(told(rebuilt.select([F.col(f"`{c}`") for c in saved.columns]), -1))
    left = both.groupBy("a", "b").agg(F.abs(F.sum("n")).alias("n"))
    return left.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def reconciled(calls: DataFrame, operations: DataFrame, name: str = "operations") -> DataFrame:
    """Sums of an operations table against the calls."""
    sums = ["duration_us", "db_count", "db_duration_us", "sdbl_count", "lock_count", "error_count"]
    sums = [c for c in sums if c in operations.columns and c in calls.columns]
    a = calls.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    b = operations.agg(F.sum("count").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return same(f"{name}_reconcile", a, b)
