"""Operation history over a series of measurements: the full grid of cohorts, references to compare with, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrace.functions import counters
from sparktrace.functions.text import UNKNOWN_USERS
from sparktrace.operators.aggregates import SECOND, joined, rank_percentile

COHORT = ["signature", "user"]
BASES = ["first_observation", "previous_observation", "previous_measurement", "series_baseline"]


def metrics() -> list[Column]:
    """The 33 metrics of an operation; thresholds are strict and nothing is rounded."""
    over = [F.count_if(F.col("duration_us") > s * SECOND).alias(f"duration_gt_{s}s_count") for s in (1, 5, 10, 30)]
    out = [
        F.sum("duration_us").alias("duration_us_sum"), F.avg("duration_us").alias("avg_us"), F.median("duration_us").alias("median_us"),
        rank_percentile("duration_us", 0.95).alias("p95_us"), rank_percentile("duration_us", 0.99).alias("p99_us"), F.max("duration_us").alias("max_us"), *over,
        F.sum("db_count").alias("db_count_sum"), (F.sum("db_count") / F.count("*")).alias("db_per_call"),
        F.sum("db_duration_us").alias("db_duration_us_sum"), (F.sum("db_duration_us") / F.count("*") / SECOND).alias("db_seconds_per_call"),
    ]
    for c, per in (("cpu_us", "cpu_us"), ("in_bytes", "in_bytes"), ("out_bytes", "out_bytes")):
        out += [F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{per}_per_call"), F.max(c).alias(f"{c}_max")]
    out += [
        F.avg("memory_peak").alias("memory_peak_avg"), F.median("memory_peak").alias("memory_peak_median"), rank_percentile("memory_peak", 0.95).alias("memory_peak_p95"),
        rank_percentile("memory_peak", 0.99).alias("memory_peak_p99"), F.max("memory_peak").alias("memory_peak_max"),
    ]
    return out + counters.cpu_population()[:-3]  # without what is left over


METRICS = (
    "duration_us_sum avg_us median_us p95_us p99_us max_us duration_gt_1s_count duration_gt_5s_count duration_gt_10s_count duration_gt_30s_count db_count_sum db_per_call "
    "db_duration_us_sum db_seconds_per_call cpu_us_sum cpu_us_per_call cpu_us_max in_bytes_sum in_bytes_per_call in_bytes_max out_bytes_sum out_bytes_per_call out_bytes_max "
    "memory_peak_avg memory_peak_median memory_peak_p95 memory_peak_p99 memory_peak_max cpu_available_count cpu_wall_us cpu_coverage_percent cpu_wall_coverage_percent cpu_percent_of_wall"
).split()


#: Counters whose coverage tells whether two cells compare, beside the rows that linked DB events report.
COVERED = ["cpu_us", "memory", "memory_peak", "in_bytes", "out_bytes", "rows_affected"]
LIMITATIONS = [
    "exact_signature_only_no_fuzzy_merging", "retained_call_events_not_business_transactions", "duration_sums_not_exclusive_wall_time", "db_metrics_depend_on_inherited_linkage",
    "coverage_fields_are_whole_measurement_not_this_operation_or_user", "numerical_change_does_not_prove_code_change_effect", "counter_means_use_available_observations_cpu_uses_paired_wall",
]
UNKNOWN_PARAMETERS = ["role", "document", "parameters", "data_volume", "cold_warm", "concurrent_load", "application_version", "platform_version", "logging_configuration", "business_outcome"]
CLEAN = "no_recorded_related_capture_problem"
#: Bytes of distinct values per column and row group of Parquet up to which each is written once, and rows refer to it.
DISTINCT_BYTES = 128 << 20


def measurements(calls: DataFrame, times: DataFrame | None = None, order: list[str] | None = None, baseline: str | None = None) -> DataFrame:
    """Measurements in order of their first call, with rank, whether the order is beyond doubt, on what it rests, and the baseline of the series.

    times (measurement_id, first_us) names measurements without calls too and dates those that have
    none with a time; a declared order is taken as it is. As many rows as measurements.
    """
    m = calls.groupBy("measurement_id").agg(F.min("start_us").alias("by_call"))
    other = times.groupBy("measurement_id").agg(F.min("first_us").alias("by_event")) if times is not None else m.select("measurement_id", F.lit(None).cast("long").alias("by_event"))
    m = m.join(other, "measurement_id", "full").withColumn("begins", F.coalesce("by_call", "by_event"))
    basis = F.when(F.col("by_call").isNotNull(), "saved_call_start_time").when(F.col("by_event").isNotNull(), "saved_event_summary_time").otherwise("identifier_tiebreak_no_saved_time")
    if order is not None:
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("measurement_id"))
        m = m.withColumn("measurement_order", place.cast("int")).withColumn("series_order_reliable", F.lit(True)).withColumn("order_basis", F.lit("explicit_configured_order"))
    else:
        whole = m.agg(F.count("*").alias("n"), F.count_distinct("begins").alias("different"))
        m = m.crossJoin(whole).withColumn("series_order_reliable", (F.col("n") <= 1) | (F.col("n") == F.col("different")))
        m = m.withColumn("measurement_order", F.row_number().over(Window.orderBy(F.col("begins").asc_nulls_last(), "measurement_id")))
        m = m.withColumn("order_basis", F.when(F.col("series_order_reliable"), basis).otherwise(F.concat(basis, F.lit(";series_order_not_fully_established"))))
    first = F.first("measurement_id").over(Window.orderBy("measurement_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = F.lit(baseline) if baseline is not None else F.when(F.col("series_order_reliable"), first)
    return m.select("measurement_id", "series_order_reliable", "measurement_order", "order_basis", own.cast("string").alias("series_baseline"))


def history(calls: DataFrame, pooled: bool = False, series: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """Every cohort in every measurement: metrics where it has calls, else a count of zero and nulls; with what is known of the measurement as a whole."""
    series = measurements(calls) if series is None else series
    if pooled:
        calls = calls.withColumn("user", F.lit(None).cast("string"))
    keys = [*COHORT, "measurement_id"]
    partial = F.count_if(F.col("from_partial_source")) if "from_partial_source" in calls.columns else F.lit(0)
    found = calls.groupBy(*keys).agg(
        F.count("*").alias("count"), *metrics(), F.min("start_us").alias("first_call_start"), F.max("end_us").alias("last_call_end"),
        joined("dataset_id").alias("dataset_ids"), joined("process").alias("processes"),
        F.count_if(F.col("end_us").isNull()).alias("calls_without_time"), partial.cast("long").alias("calls_from_partial_sources"),
        *[F.count(c).alias(f"{c}_known") for c in COVERED if c != "cpu_us"], F.sum("db_rows_available_count").alias("db_rows_known_count"),
    )
    grid = found.select(*COHORT).distinct().crossJoin(series)
    found = found.withColumnsRenamed({k: f"f_{k}" for k in keys})
    out = grid.join(found, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in keys]), "left").drop(*[f"f_{k}" for k in keys])
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("count", "calls_without_time", "calls_from_partial_sources")})
    if quality is None:
        out = out.withColumns({"measurement_source_health": F.lit(CLEAN), "measurement_db_linked_count_percent": F.lit(None).cast("double"), "measurement_db_linked_duration_percent": F.lit(None).cast("double")})
    else:
        told = quality.select("measurement_id", F.col("recorded_source_health").alias("measurement_source_health"), F.col("db_linked_count_percent").alias("measurement_db_linked_count_percent"), F.col("db_linked_duration_percent").alias("measurement_db_linked_duration_percent"))
        out = out.join(told, "measurement_id", "left")
    over = Window.partitionBy(*COHORT).orderBy("measurement_order")
    here = F.when(F.col("count") > 0, F.col("measurement_id"))
    some = (F.col("count") > 0) & ((F.least(*[F.col(f"{c}_known") for c in COVERED if c != "cpu_us"], F.col("cpu_available_count")) < F.col("count")) | (F.col("db_rows_known_count") < F.col("db_count_sum")))
    more = {
        "all_users_summary_overlaps_same_user_history_do_not_sum_views": F.lit(pooled), "incomplete_numeric_counter_coverage": F.coalesce(some, F.lit(False)),
        "related_capture_has_recorded_source_gaps_scope_not_operation": F.col("measurement_source_health") != CLEAN, "series_chronology_unresolved": ~F.col("series_order_reliable"),
    }
    return (
        out.withColumn("observation_status", F.when(F.col("count") > 0, "observed").otherwise("not_observed"))
        .withColumn("first_observation", F.first(here, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("previous_observation", F.last(here, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("previous_measurement", F.lag("measurement_id").over(over))
        .withColumn("known_limitations", F.array_join(F.array_sort(F.array_compact(F.array(*[F.lit(x) for x in LIMITATIONS], *[F.when(c, F.lit(n)) for n, c in more.items()]))), " | "))
    )


def referenced(rows: DataFrame, keys: list[str], bases: list[str] = BASES) -> DataFrame:
    """Rows beside the row of the same keys in their reference measurement, per basis; state and relation say whether they compare."""
    each = F.array(*[F.struct(F.lit(b).alias("comparison_basis"), (F.col(b) if b == "series_baseline" else F.when(F.col("series_order_reliable"), F.col(b))).alias("reference_measurement_id")) for b in bases])
    current = rows.select("*", F.inline(each))
    past = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    on = [F.col("reference_measurement_id") == F.col("r_measurement_id"), *[F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]]
    out = current.join(past, reduce(Column.__and__, on), "left")
    none = F.col("reference_measurement_id").isNull()
    state = (
        F.when(none & (~F.col("series_order_reliable") | (F.col("comparison_basis") == "series_baseline")), "series_chronology_unresolved")
        .when(none & (F.col("comparison_basis") == "previous_measurement"), "no_previous_measurement")
        .when(none, "no_previous_observation")
        .when((F.col("comparison_basis") == "first_observation") & (F.col("r_measurement_order") > F.col("measurement_order")), "before_first_observation")
        .when((F.col("r_count") == 0) & (F.col("count") == 0), "both_not_observed")
        .when(F.col("r_count") == 0, "reference_not_observed")
        .when(F.col("count") == 0, "current_not_observed")
        .otherwise("numerical_comparison")
    )
    relation = (
        F.when(none, "no_reference")
        .when(F.col("r_measurement_order") == F.col("measurement_order"), "same_measurement")
        .when(~F.col("series_order_reliable"), "unknown_order")
        .when(F.col("r_measurement_order") < F.col("measurement_order"), "earlier")
        .otherwise("later")
    )
    return out.withColumn("comparison_state", state).withColumn("reference_relation", relation)


def changes(metric: str) -> list[Column]:
    """Reference, current, difference and percent of one metric; the last two only where both sides are known and compare."""
    now, past = F.col(metric), F.col(f"r_{metric}")
    both = (F.col("comparison_state") == "numerical_comparison") & now.isNotNull() & past.isNotNull()
    delta = F.when(both, now.cast("double") - past.cast("double"))
    return [past.cast("double").alias(f"{metric}_reference"), now.cast("double").alias(f"{metric}_current"), delta.alias(f"{metric}_delta_absolute"), F.when(both & (past != 0), 100.0 * (now.cast("double") - past.cast("double")) / past).alias(f"{metric}_delta_percent")]


def listed(names: list[str], test) -> Column:
    """Names for which test holds, sorted and joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(test(n), F.lit(n)) for n in sorted(names)])), " | ")


def sample_size(min_count: int) -> Column:
    few = F.least("count", "r_count") < min_count
    return F.when(F.col("comparison_state") != "numerical_comparison", "missing_observations").when(few, "below_configured_minimum").otherwise("meets_count_threshold_only")


def comparisons(rows: DataFrame, min_count: int = 10) -> DataFrame:
    pairs = referenced(rows, COHORT)
    numeric = F.col("comparison_state") == "numerical_comparison"
    return pairs.select(
        *COHORT, "comparison_basis", "reference_measurement_id", F.col("measurement_id").alias("current_measurement_id"), F.col("r_count").alias("reference_count"), F.col("count").alias("current_count"),
        F.coalesce("r_observation_status", F.lit("no_reference")).alias("reference_observation_status"), F.col("observation_status").alias("current_observation_status"),
        "comparison_state", "reference_relation", (F.col("count") - F.col("r_count")).cast("double").alias("sample_count_delta_absolute"),
        F.when(F.col("r_count") > 0, 100.0 * (F.col("count") - F.col("r_count")) / F.col("r_count")).alias("sample_count_delta_percent"),
        F.when(F.col("r_count").isNull(), "no_reference").when(F.col("r_count") == 0, "undefined_zero_reference").otherwise("defined").alias("sample_count_percent_status"), sample_size(min_count).alias("sample_size_status"),
        listed(METRICS, lambda m: numeric & F.col(m).isNotNull() & (F.col(f"r_{m}") == 0)).alias("percent_undefined_zero_reference_metrics"),
        listed(METRICS, lambda m: F.col(m).isNull() | F.col(f"r_{m}").isNull()).alias("unavailable_metrics"),
        *[c for m in METRICS for c in changes(m)],
    )


def comparability(rows: DataFrame, min_count: int = 10) -> DataFrame:
    """What is known to differ between the two sides of each comparison, and what isn't known at all.

    Each row has two lists of all users of its operation. There are few different ones, but beyond Parquet's limit of 1 MB for a
    column's distinct values they would be written out in every row, so the session's limit is raised to DISTINCT_BYTES.
    """
    rows.sparkSession.conf.set("parquet.dictionary.page.size", str(DISTINCT_BYTES))
    seen = rows.where("count > 0").groupBy("signature", "measurement_id").agg(joined("user").alias("operation_users_all"))
    pairs = referenced(rows, COHORT)
    for side, measurement in (("", "measurement_id"), ("r_", "reference_measurement_id")):
        # a list is as long as an operation has users: it meets the rows last, and no exchange holds it once per row
        lists = F.broadcast(seen.toDF("listed_signature", "listed_measurement", f"{side}operation_users_all"))
        pairs = pairs.join(lists, (F.col("signature") == F.col("listed_signature")) & (F.col(measurement) == F.col("listed_measurement")), "left").drop("listed_signature", "listed_measurement")
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("operation_users_all", "r_operation_users_all")})
    known = ~F.coalesce("user", F.lit("")).isin(*UNKNOWN_USERS)
    both = F.coalesce((F.col("count") > 0) & (F.col("r_count") > 0), F.lit(False))
    differ = lambda *ns: reduce(Column.__or__, [~F.col(n).eqNullSafe(F.col(f"r_{n}")) for n in ns])
    reference = F.col("reference_measurement_id").isNotNull()
    found = {
        "sample_size_changed": reference & differ("count"),
        "reference_operation_observed_only_for_other_users": reference & (F.col("r_count") == 0) & (F.col("r_operation_users_all") != ""),
        "current_operation_observed_only_for_other_users": (F.col("count") == 0) & (F.col("operation_users_all") != ""),
        "cpu_us_numeric_coverage_changed": both & differ("count", "cpu_available_count"),
        "db_rows_numeric_coverage_changed": both & differ("db_count_sum", "db_rows_known_count"),
    } | {f"{c}_numeric_coverage_changed": both & differ("count", f"{c}_known") for c in COVERED if c != "cpu_us"}
    whole = ["dataset_ids", "processes", "measurement_source_health", "measurement_db_linked_count_percent", "measurement_db_linked_duration_percent", "calls_from_partial_sources"]
    found |= {f"{c}_changed": both & differ(c) for c in whole}
    unknown = F.array(*[F.lit(p) for p in UNKNOWN_PARAMETERS], F.when(~known, F.lit("user_identity")), F.when(~F.col("series_order_reliable"), F.lit("measurement_order")))
    sides = [x for c in whole if c != "measurement_source_health" for x in (F.col(f"r_{c}").alias(f"reference_{c}"), F.col(c).alias(f"current_{c}"))]
    limits = F.array_sort(F.array_distinct(F.flatten(F.array(F.split("known_limitations", r" \| "), F.coalesce(F.split("r_known_limitations", r" \| "), F.array().cast("array<string>"))))))
    return pairs.select(
        *COHORT, "comparison_basis", "reference_measurement_id", F.col("measurement_id").alias("current_measurement_id"), "comparison_state", sample_size(min_count).alias("sample_size_status"),
        F.when(both & known, "same_signature_same_user_uncontrolled").when(both, "user_identity_unknown").otherwise("insufficient_observations_for_comparison").alias("comparability_status"),
        F.when(both, True).alias("signature_match"), F.when(both & known, True).alias("user_match"), F.when(reference, True).alias("key_signature_match"), F.when(reference, True).alias("key_user_match"),
        F.col("r_operation_users_all").alias("reference_operation_users_all"), F.col("operation_users_all").alias("current_operation_users_all"), *sides,
        F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))), " | ").alias("known_differences"),
        F.array_join(F.array_compact(unknown), " | ").alias("unknown_parameters"), F.array_join(limits, " | ").alias("known_limitations"),
    )
