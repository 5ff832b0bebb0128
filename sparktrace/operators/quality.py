"""Data quality of each measurement: population, health of its sources, linkage and metric availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrace.functions import counters
from sparktrace.functions.text import percent
from sparktrace.operators.aggregates import joined
from sparktrace.operators.series import CLEAN, COVERED, measurements
from sparktrace.plans.adapters import COUNTERS

PARTIAL = ["partial_read_error", "partial_nul_salvaged"]
#: What every row of the table says of itself.
LINKAGE_METHOD = "same dataset, user, process and thread; CALL interval contains the end of the event; equal session preferred, then longest CALL"
UNAVAILABLE = ["role", "document", "parameters", "cold_warm", "session_id", "os_thread", "complete_call_sql_links", "per_call_db_linkage_confidence", "business_outcome"]
LIMITATIONS = [
    "retained_call_events_not_business_transactions", "call_and_db_duration_sums_are_not_exclusive_wall_time", "source_completeness_not_proven_by_file_integrity_or_linkage", "related_file_health_is_capture_scoped_not_day_or_operation_scoped",
    "db_linkage_quality_available_only_at_dataset_measurement_level", "db_linkage_percent_does_not_prove_correct_attribution", "no_raw_sources_reopened_or_verified",
]


def source_problem() -> Column:
    """Whether a source was read in part, or skipped though it had content."""
    return F.col("status").isin(*PARTIAL) | ((F.col("status") == "skipped") & ~F.col("reason").startswith("empty"))


def with_source_status(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Calls that say whether their source was read in part; as many files as sources."""
    bad = files.where(F.col("status").isin(*PARTIAL)).select(F.col("logical").alias("source")).distinct().withColumn("from_partial_source", F.lit(True))
    return calls.join(bad, "source", "left").withColumn("from_partial_source", F.coalesce("from_partial_source", F.lit(False)))


def linkage_sums(linked: DataFrame) -> DataFrame:
    """DB events and their duration, and the share that calls own, per measurement of the event."""
    on = F.col("parent_call_id").isNotNull()
    us = lambda c: F.coalesce(F.sum(F.when(c, F.col("duration_us"))), F.lit(0))
    out = linked.where("event_type = 'DBPOSTGRS'").groupBy("measurement_id").agg(
        F.count("*").alias("db_total_count"), F.count_if(on).alias("db_linked_count"), us(F.lit(True)).alias("db_total_duration_us"), us(on).alias("db_linked_duration_us"),
    )
    return out.withColumns({
        "db_linked_count_percent": F.round(percent(F.col("db_linked_count"), F.col("db_total_count")), 6),
        "db_linked_duration_percent": F.round(percent(F.col("db_linked_duration_us"), F.col("db_total_duration_us")), 6),
    })


def linkage_percents(linked: DataFrame) -> DataFrame:
    return linkage_sums(linked).select("measurement_id", "db_total_count", "db_linked_count", "db_linked_count_percent", "db_linked_duration_percent")


def captures(events: DataFrame, files: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """Health of the captures and data sets that a measurement takes part in; files count once per capture, so rows of one capture repeat them."""
    member = events.where(F.col("event_type").isin("CALL", "DBPOSTGRS", "SDBL", "TLOCK", "TTIMEOUT", "TDEADLOCK", "EXCP", "QERR")).select("measurement_id", "dataset_id", "capture_id").distinct()
    health = files.groupBy("capture_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("status").isin(*PARTIAL)).alias("partial"), F.count_if((F.col("status") == "skipped") & source_problem()).alias("skipped"), F.count_if(F.col("status") == "skipped_duplicate").alias("duplicate"),
    )
    by_capture = member.select("measurement_id", "capture_id").distinct().join(health, "capture_id", "left").groupBy("measurement_id").agg(
        joined("capture_id").alias("capture_ids"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("files", "related_capture_file_count"), ("partial", "related_capture_partial_files"), ("skipped", "related_capture_nonempty_skipped_files"), ("duplicate", "related_capture_duplicate_files"))],
    )
    by_dataset = member.select("measurement_id", "dataset_id").distinct().join(parse_errors, "dataset_id", "left").groupBy("measurement_id").agg(joined("dataset_id").alias("dataset_ids"), F.coalesce(F.sum("parse_errors"), F.lit(0)).alias("related_dataset_parse_errors"))
    return by_capture.join(by_dataset, "measurement_id")


def availability() -> Column:
    """Per field how many calls have a number, a zero, and each other state, as JSON."""
    told = []
    for c in COVERED:
        of = lambda s, c=c: F.count_if(counters.state(f"{c}_raw", COUNTERS[c]) == s)
        told.append(F.struct(F.count(c).alias("stored_numeric_count"), F.count_if(F.col(c) == 0).alias("stored_zero_count"), *[of(s).alias(f"raw_{s}_count") for s in ("missing", "empty", "invalid", "out_of_range")]).alias(c))
    for c in ("duration_us", "db_count", "db_duration_us", "sdbl_count", "lock_count", "lock_duration_us", "error_count"):
        told.append(F.struct(F.count(c).alias("stored_numeric_count"), F.count_if(F.col(c) == 0).alias("stored_zero_count")).alias(c))
    rows = F.struct(F.sum("db_rows_available_count").alias("stored_numeric_count"), (F.sum("db_count") - F.sum("db_rows_available_count")).alias("raw_not_valid_count")).alias("db_rows")
    return F.to_json(F.struct(*told, rows))


def data_quality(
    calls: DataFrame, linked: DataFrame, events: DataFrame, files: DataFrame, parse_errors: DataFrame,
    min_call_count: int = 10, warning_percent: float = 99.0, series: DataFrame | None = None, problems: tuple[str, ...] = (),
) -> DataFrame:
    """One row per measurement that any event is in; calls tell from_partial_source. problems are warnings of the analysis as a whole, such as archive_error."""
    out = calls.groupBy("measurement_id").agg(
        F.count("*").alias("call_count"), joined("user").alias("users"), F.count_distinct("user").alias("user_count"), F.count_distinct("signature").alias("operation_signature_count"), F.count_distinct("signature", "user").alias("operation_user_count"),
        F.min("start_us").alias("observed_call_start"), F.max("end_us").alias("observed_call_end"), F.count_if(F.col("end_us").isNull()).alias("calls_without_time"), F.count_if("from_partial_source").alias("calls_from_partial_sources"),
        F.count_if(F.col("db_count") == 0).alias("calls_with_zero_linked_db"), F.count_if(F.col("error_count") > 0).alias("calls_with_linked_errors"), availability().alias("metric_availability"),
        F.coalesce(F.least(*[F.count(c) for c in COVERED]) < F.count("*"), F.lit(False)).alias("some_counters"), (F.sum("db_rows_available_count") < F.sum("db_count")).alias("some_rows"),
    )
    times = events.groupBy("measurement_id").agg(F.min("end_us").alias("first_us"))
    series = measurements(calls, times) if series is None else series
    out = series.select("measurement_id", "measurement_order", "order_basis").join(out, "measurement_id", "left").join(linkage_sums(linked), "measurement_id", "left").join(captures(events, files, parse_errors), "measurement_id", "left")
    zero = ["call_count", "user_count", "operation_signature_count", "operation_user_count", "calls_without_time", "calls_from_partial_sources", "calls_with_zero_linked_db", "calls_with_linked_errors", "db_total_count", "db_linked_count", "db_total_duration_us", "db_linked_duration_us"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumns({c: F.coalesce(c, F.lit("")) for c in ("users", "dataset_ids", "capture_ids")})
    gaps = (F.col("related_capture_partial_files") > 0) | (F.col("related_capture_nonempty_skipped_files") > 0)
    low = (F.col("db_linked_count_percent") < warning_percent) | (F.col("db_linked_duration_percent") < warning_percent)
    less = (F.col("db_linked_count") < F.col("db_total_count")) | (F.col("db_linked_duration_us") < F.col("db_total_duration_us"))
    ladder = F.when(F.col("db_total_count") == 0, "no_db_events_denominator").when(low, "below_configured_coverage_threshold").when(less, "partial_coverage_above_configured_threshold")
    sample = F.when(F.col("call_count") == 0, "no_calls").when(F.col("call_count") < min_call_count, "below_configured_minimum").otherwise("meets_count_threshold_only")
    limits = {
        "related_capture_has_unread_or_partial_sources": gaps, "bundle_archive_error_scope_not_attributed_to_measurement": F.lit("archive_error" in problems), "input_bundle_reports_incomplete_source_analysis": F.lit(bool(problems)),
        "some_call_times_unavailable": F.col("calls_without_time") > 0, "sample_below_configured_minimum": F.col("call_count") < min_call_count, "no_retained_call_observations": F.col("call_count") == 0,
        "some_recorded_db_events_not_assigned_to_call": F.col("db_linked_count") < F.col("db_total_count"), "incomplete_numeric_counter_coverage": F.col("some_counters") | F.col("some_rows"),
    }
    known = F.array_sort(F.array_compact(F.array(*[F.lit(x) for x in LIMITATIONS], *[F.when(c, F.lit(n)) for n, c in limits.items()])))
    return out.withColumns({
        "sample_size_status": sample, "configured_min_call_count": F.lit(min_call_count), "bundle_analysis_complete": F.lit(not problems), "bundle_recorded_source_hashes_complete": F.lit(True),
        "source_completeness": F.lit("not_established_from_saved_results"), "recorded_source_health": F.when(gaps, "known_related_capture_gaps").otherwise(CLEAN), "related_file_scope": F.lit("capture_not_day_or_operation_nonadditive_between_measurements"),
        "db_unlinked_count": F.col("db_total_count") - F.col("db_linked_count"), "db_unlinked_duration_us": F.col("db_total_duration_us") - F.col("db_linked_duration_us"),
        "db_linkage_status": ladder.otherwise("all_recorded_db_events_linked_not_source_completeness"), "configured_db_linkage_warning_percent": F.lit(float(warning_percent)),
        "unavailable_dimensions": F.lit(" | ".join(UNAVAILABLE)), "linkage_method": F.lit(LINKAGE_METHOD), "known_limitations": F.array_join(known, " | "),
    }).drop("some_counters", "some_rows")
