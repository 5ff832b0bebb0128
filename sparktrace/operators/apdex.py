"""APDEX: latency classes against targets, forced failures, coverage and composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrace.functions.text import UNKNOWN_USERS, percent
from sparktrace.operators.series import BASES, COHORT, changes, referenced

TARGET = ["target_id", "target_kind", "target_class_id", "overridden_class_id", "t_us", "target_status"]
SCORES = ["apdex", "satisfied_count", "tolerating_count", "frustrated_count", "confirmed_failure_count", "forced_frustrated_count"]
STATUSES = ["business_approved", "engineering_proposal"]


def targets(direct: DataFrame, classes: DataFrame) -> DataFrame:
    """One target per signature: a direct one beats that of its class, which is then noted as overridden.

    direct: signature, target_id, t_us, target_status; classes: the same with class_id.
    """
    d = direct.select("signature", F.col("target_id").alias("d_id"), F.col("t_us").alias("d_us"), F.col("target_status").alias("d_status"))
    c = classes.select("signature", "class_id", F.col("target_id").alias("c_id"), F.col("t_us").alias("c_us"), F.col("target_status").alias("c_status"))
    own = F.col("d_id").isNotNull()
    return d.join(c, "signature", "full").select(
        "signature", F.coalesce("d_id", "c_id").alias("target_id"), F.when(own, "operation").otherwise("explicit_class").alias("target_kind"), F.when(~own, F.col("class_id")).alias("target_class_id"),
        F.when(own, F.col("class_id")).alias("overridden_class_id"), F.when(own, F.col("d_us")).otherwise(F.col("c_us")).alias("t_us"), F.when(own, F.col("d_status")).otherwise(F.col("c_status")).alias("target_status"),
    )


def unobserved_targets(calls: DataFrame, goals: DataFrame) -> DataFrame:
    """Targets of signatures without any call: a configuration error."""
    return goals.join(calls.select("signature"), "signature", "left_anti")


def classified(calls: DataFrame, goals: DataFrame, failures: DataFrame) -> DataFrame:
    """Calls with target, latency class and final class; failures has the call_ids confirmed as failed."""
    own = failures.select("call_id").distinct().withColumn("confirmed_failure", F.lit(True))
    out = calls.join(goals, "signature", "left").join(own, "call_id", "left").withColumn("confirmed_failure", F.coalesce("confirmed_failure", F.lit(False)))
    latency = F.when(F.col("duration_us") <= F.col("t_us"), "satisfied").when(F.col("duration_us") <= 4 * F.col("t_us"), "tolerating").when(F.col("t_us").isNotNull(), "frustrated")
    out = out.withColumn("latency_category", latency)
    return out.withColumn("category", F.when(F.col("t_us").isNotNull() & F.col("confirmed_failure"), "frustrated").otherwise(F.col("latency_category")))


def score() -> list[Column]:
    """Counts and (2 S + T) / 2 N over calls with a target; null, never zero, without any."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    n, s, t = F.count("t_us"), of("category", "satisfied"), of("category", "tolerating")
    any_ = n > 0
    failed = F.col("confirmed_failure")
    return [
        n.alias("covered_call_count"), n.alias("apdex_denominator"), F.when(any_, s).alias("satisfied_count"), F.when(any_, t).alias("tolerating_count"), F.when(any_, of("category", "frustrated")).alias("frustrated_count"),
        F.when(any_, 2 * s + t).alias("apdex_numerator_twice"), F.when(any_, (2 * s + t) / (2 * n)).alias("apdex"), F.when(any_, of("latency_category", "frustrated")).alias("latency_frustrated_count"),
        F.when(any_, F.count_if(failed & F.col("t_us").isNotNull() & (F.col("latency_category") != "frustrated"))).alias("forced_frustrated_count"), F.count_if(failed).alias("confirmed_failure_count"),
        F.count_if(~failed).alias("business_outcome_unknown_count"), F.count_if(F.col("error_count") > 0).alias("calls_with_linked_error_events"),
    ]


def groups(calls: DataFrame, history: DataFrame, goals: DataFrame, min_count: int = 2) -> DataFrame:
    """Per cohort and measurement of the grid, with its target."""
    found = calls.groupBy(*COHORT, "measurement_id").agg(*score())
    grid = history.select(*COHORT, "measurement_id", "measurement_order", "series_order_reliable", "count", "first_observation", "previous_observation", "previous_measurement", "series_baseline")
    out = grid.join(goals, "signature", "left").join(found, [*COHORT, "measurement_id"], "left")
    out = out.withColumn("target_coverage_status", F.when(F.col("t_us").isNull(), "uncovered_no_target").otherwise("target_defined"))
    for c in ("covered_call_count", "apdex_denominator", "confirmed_failure_count"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    some = (F.col("count") > 0) & (F.col("count") < min_count)
    size = F.when(F.col("count") == 0, "no_calls").when(some, "below_configured_minimum").otherwise("meets_count_threshold_only")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("business_outcome_unknown_count", "calls_with_linked_error_events")})
    return out.withColumns({"small_sample_warning": some, "sample_size_status": size, "four_t_us": 4 * F.col("t_us")})


def uncovered(rows: DataFrame) -> DataFrame:
    return rows.where("t_us is null and count > 0")


def coverage(calls: DataFrame) -> DataFrame:
    """Per measurement and over all: share of calls and of operations with a target."""
    has = F.col("t_us").isNotNull()
    on = lambda c: F.when(c, F.col("signature"))
    n, ops, with_target = F.count("*"), F.count_distinct("signature"), F.count_distinct(on(has))
    status = [x for s in STATUSES for x in (F.count_if(F.col("target_status") == s).alias(f"{s}_call_count"), F.count_distinct(on(F.col("target_status") == s)).alias(f"{s}_operation_count"))]
    return calls.groupingSets([["measurement_id"], []], "measurement_id").agg(
        F.when(F.grouping("measurement_id") == 1, "selected_measurements_all_users").otherwise("measurement_all_users").alias("population_scope"), n.alias("total_call_count"),
        F.count("t_us").alias("covered_call_count"), F.count_if(~has).alias("uncovered_call_count"), percent(F.count("t_us"), n).alias("covered_call_percent"), ops.alias("observed_operation_count"),
        with_target.alias("covered_operation_count"), (ops - with_target).alias("uncovered_operation_count"), percent(with_target, ops).alias("covered_operation_percent"), *status,
        F.count_if("confirmed_failure").alias("confirmed_failure_count"), F.count_if(F.col("confirmed_failure") & ~has).alias("uncovered_confirmed_failure_count"),
    )


def overall(calls: DataFrame, min_count: int = 2) -> DataFrame:
    """Pooled counts per scope and target status; every scope has a row of each status."""
    scopes = calls.groupingSets([["measurement_id"], []], "measurement_id").agg(
        F.when(F.grouping("measurement_id") == 1, "selected_measurements_all_users").otherwise("measurement_all_users").alias("population_scope"), F.count("*").alias("total_calls_in_scope"), F.count_if(F.col("t_us").isNull()).alias("calls_without_target"),
    ).withColumn("target_status", F.explode(F.array(*[F.lit(s) for s in STATUSES])))
    found = calls.where("t_us is not null").groupingSets([["measurement_id", "target_status"], ["target_status"]], "measurement_id", "target_status").agg(
        F.when(F.grouping("measurement_id") == 1, "selected_measurements_all_users").otherwise("measurement_all_users").alias("population_scope"), F.count_distinct("signature").alias("operation_count"),
        F.count_distinct("user").alias("user_identifier_count"), F.array_join(F.array_sort(F.collect_set("target_id")), " | ").alias("target_ids"), *score(),
    )
    keys = ["population_scope", "measurement_id", "target_status"]
    found = found.withColumnsRenamed({k: f"f_{k}" for k in keys})
    out = scopes.join(found, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in keys]), "left").drop(*[f"f_{k}" for k in keys])
    for c in ("operation_count", "user_identifier_count", "covered_call_count", "apdex_denominator", "confirmed_failure_count", "business_outcome_unknown_count", "calls_with_linked_error_events"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    out = out.withColumn("target_ids", F.coalesce("target_ids", F.lit("")))
    out = out.withColumn("calls_with_other_target_status", F.col("total_calls_in_scope") - F.col("calls_without_target") - F.col("covered_call_count"))
    few = (F.col("covered_call_count") > 0) & (F.col("covered_call_count") < min_count)
    out = out.withColumn("small_sample_warning", few).withColumn("sample_size_status", F.when(F.col("covered_call_count") == 0, "no_scored_calls").when(few, "below_configured_minimum").otherwise("meets_count_threshold_only"))
    return out.withColumn("scored_call_percent", percent(F.col("covered_call_count"), F.col("total_calls_in_scope")))


def composition(calls: DataFrame, pooled: DataFrame) -> DataFrame:
    """Each group's weight in and contribution to the overall scores that it is part of."""
    group = calls.where("t_us is not null").groupBy(*COHORT, "measurement_id", "target_status").agg(F.count("*").alias("call_count"), *score())
    group = group.withColumn("population_scope", F.explode(F.array(F.lit("measurement_all_users"), F.lit("selected_measurements_all_users"))))
    group = group.withColumn("scope_measurement", F.when(F.col("population_scope") == "measurement_all_users", F.col("measurement_id")))
    whole = pooled.where("apdex_denominator > 0").select(
        F.col("population_scope").alias("o_scope"), F.col("measurement_id").alias("o_measurement"), F.col("target_status").alias("o_status"), F.col("apdex_denominator").alias("overall_apdex_denominator")
    )
    on = (F.col("population_scope") == F.col("o_scope")) & (F.col("target_status") == F.col("o_status")) & F.col("scope_measurement").eqNullSafe(F.col("o_measurement"))
    out = group.join(whole, on)
    return out.select(
        "population_scope", *COHORT, "measurement_id", "target_status", "call_count", "overall_apdex_denominator", percent(F.col("call_count"), F.col("overall_apdex_denominator")).alias("call_weight_percent"),
        "satisfied_count", "tolerating_count", "frustrated_count", F.col("apdex").alias("operation_user_measurement_apdex"), (F.col("apdex_numerator_twice") / (2 * F.col("overall_apdex_denominator"))).alias("contribution_to_overall_apdex"),
    )


def apdex_changes(rows: DataFrame) -> DataFrame:
    """Comparisons of scores; they need the same target on both sides and a known user."""
    pairs = referenced(rows, COHORT, BASES)
    known = ~F.coalesce("user", F.lit("")).isin(*UNKNOWN_USERS)
    same = F.col("target_id").isNotNull() & (F.col("target_id") == F.col("r_target_id"))
    numeric = F.col("comparison_state") == "numerical_comparison"
    state = F.when(numeric & ~F.coalesce(same, F.lit(False)), "missing_target").when(numeric & ~known, "user_identity_unknown").otherwise(F.col("comparison_state"))
    both = F.coalesce((F.col("count") > 0) & (F.col("r_count") > 0), F.lit(False))
    warned = F.coalesce(F.col("r_small_sample_warning"), F.lit(False)) | F.col("small_sample_warning")
    pairs = pairs.withColumn("operation_comparison_state", F.col("comparison_state")).withColumn("comparison_state", state)
    return pairs.select(
        *COHORT, "comparison_basis", "reference_measurement_id", F.col("measurement_id").alias("current_measurement_id"), "operation_comparison_state", "comparison_state", "reference_relation",
        F.when(both, F.coalesce(same, F.lit(False))).alias("target_match"), F.when(both & known, True).alias("user_match"), warned.alias("small_sample_warning"), *[c for m in SCORES for c in changes(m)],
    )
