"""Problem rules over the series: evaluation with gates, history from the first breach on, latest state, changes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrace.functions.text import UNKNOWN_USERS
from sparktrace.operators.chatty import PROFILE
from sparktrace.operators.series import CLEAN, COHORT
from sparktrace.operators.series import METRICS as OPERATION_METRICS

#: Statuses as reports show them.
EXCEEDED = "порог превышен"
BELOW = "ниже порога в наблюдениях"
INSUFFICIENT = "недостаточно данных"
ABSENT = "не наблюдалось"
DECREASED = "показатель снизился"
INCREASED = "показатель вырос"


#: What rules can be about: the fields of a history and of a chatty profile, and three of APDEX.
METRICS = {f"operation.{f}" for f in ("count", *OPERATION_METRICS)} | {f"db_chatty.{f}" for f in PROFILE} | {"apdex.deficit", "apdex.frustrated_count", "apdex.forced_frustrated_count"}


def unit(metric: str) -> str:
    """Unit of a metric, told by its name."""
    source, field = metric.split(".")
    if source == "apdex":
        return "1_minus_APDEX" if field == "deficit" else "CALL_count"
    for part, name in (("percent", "percent"), ("bytes", "bytes"), ("seconds", "seconds_per_CALL"), ("_us", "microseconds"), ("per_call", "DB_events_per_CALL")):
        if part in field or (name == "bytes" and field.startswith("memory_peak")):
            return name
    return "count"


@dataclass(frozen=True)
class Rule:
    """A bound on one of METRICS; signatures and users restrict it, the other settings say when its values can be relied on."""

    rule_id: str
    metric: str
    operator: str
    threshold: float
    min_call_count: int
    source: str = "configuration"
    scope: str = "same_user"
    signatures: tuple[str, ...] | None = None
    users: tuple[str, ...] | None = None
    db_events_threshold: int | None = None
    min_db_linked_count_percent: float | None = None
    min_db_linked_duration_percent: float | None = None
    require_clean_sources: bool = False

    def __post_init__(self) -> None:
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
        bad = [
            (not isinstance(self.rule_id, str) or not self.rule_id.strip(), "rule_id must be a name"),
            (self.metric not in METRICS, f"unknown metric {self.metric!r}"),
            (self.operator not in (">", ">="), "operator must be > or >="),
            (not number(self.threshold) or not 0 <= self.threshold <= 10**30 or (self.metric == "apdex.deficit" and self.threshold > 1), "threshold out of range"),
            (type(self.min_call_count) is not int or self.min_call_count < 1, "min_call_count must be a positive whole number"),
            (not isinstance(self.source, str) or not self.source.strip(), "source must name where the bound comes from"),
            (self.scope != "same_user", "scope must be same_user"),
            (type(self.require_clean_sources) is not bool, "require_clean_sources must be true or false"),
        ]
        chatty = str(self.metric).startswith("db_chatty.")
        bad.append((chatty and (type(self.db_events_threshold) is not int or self.db_events_threshold < 0), "a db_chatty rule needs db_events_threshold"))
        bad.append((not chatty and self.db_events_threshold is not None, "db_events_threshold is for db_chatty rules"))
        for gate in (self.min_db_linked_count_percent, self.min_db_linked_duration_percent):
            bad.append((gate is not None and (not number(gate) or not 0 <= gate <= 100), "coverage gates are from 0 to 100"))
            bad.append((gate is not None and not (chatty or str(self.metric).startswith("operation.db_")), "coverage gates are for DB metrics"))
        for names in (self.signatures, self.users):
            bad.append((names is not None and (not names or not all(isinstance(n, str) and n for n in names) or len(set(names)) < len(names)), "signatures and users are lists of different names"))
        if found := [message for wrong, message in bad if wrong]:
            raise ValueError(f"rule {self.rule_id!r}: {'; '.join(found)}")


def evaluate(rules: list[Rule], history: DataFrame, chatty: DataFrame, apdex: DataFrame) -> DataFrame:
    """Every rule on every cell of the grid, in one pass over it: raw breach, reasons against relying on it, status.

    history has the health and linkage of the measurements; chatty and apdex are joined only if a rule is about them.
    """
    cell = [*COHORT, "measurement_id"]
    fields = sorted({r.metric.split(".")[1] for r in rules if r.metric.startswith("operation.")} - {"count"})
    rows = history.select(*cell, "measurement_order", "count", "measurement_source_health", "calls_from_partial_sources", "measurement_db_linked_count_percent", "measurement_db_linked_duration_percent", *[F.col(f).cast("double").alias(f"operation_{f}") for f in fields])
    for k in sorted({r.db_events_threshold for r in rules if r.db_events_threshold is not None}):
        own = sorted({r.metric.split(".")[1] for r in rules if r.db_events_threshold == k})
        rows = rows.join(chatty.where(F.col("threshold_db_events") == k).select(*cell, *[F.col(f).cast("double").alias(f"chatty_{k}_{f}") for f in own]), cell, "left")
    if any(r.metric.startswith("apdex.") for r in rules):
        exact = (2 * F.col("apdex_denominator") - F.col("apdex_numerator_twice")) / (2 * F.col("apdex_denominator"))
        rows = rows.join(apdex.select(*cell, F.col("t_us").isNull().alias("no_target"), F.when(F.col("apdex_denominator") > 0, exact).alias("apdex_deficit"), *[F.col(f).cast("double").alias(f"apdex_{f}") for f in ("frustrated_count", "forced_frustrated_count")]), cell, "left")
    here = F.col("count") > 0

    def told(rule: Rule) -> Column:
        source, field = rule.metric.split(".")
        name = f"chatty_{rule.db_events_threshold}_{field}" if source == "db_chatty" else f"{source}_{field}"
        value = F.when(here, F.col("count").cast("double") if rule.metric == "operation.count" else F.col(name))
        below = lambda c, gate: F.lit(False) if gate is None else F.coalesce(F.col(c) < gate, F.lit(True))
        reasons = {
            "APDEX_T_not_defined": here & value.isNull() & (F.col("no_target") if source == "apdex" else F.lit(False)),
            "measurement_DB_count_coverage_unknown_or_below_gate": here & below("measurement_db_linked_count_percent", rule.min_db_linked_count_percent),
            "measurement_DB_duration_coverage_unknown_or_below_gate": here & below("measurement_db_linked_duration_percent", rule.min_db_linked_duration_percent),
            "metric_unavailable": here & value.isNull(),
            "operation_not_observed": ~here,
            "related_capture_has_recorded_source_gaps": here & F.lit(rule.require_clean_sources) & ((F.col("measurement_source_health") != CLEAN) | (F.col("calls_from_partial_sources") > 0)),
            "sample_below_rule_minimum": here & (F.col("count") < rule.min_call_count),
            "user_identity_unknown": here & F.col("user").isin(*UNKNOWN_USERS),
        }
        chosen = F.lit(True)
        for column, names in (("signature", rule.signatures), ("user", rule.users)):
            chosen = chosen & (F.col(column).isin(*names) if names is not None else F.lit(True))
        fixed = [F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.metric).alias("metric"), F.lit(float(rule.threshold)).alias("threshold"), F.lit(rule.source).alias("rule_source"), F.lit(unit(rule.metric)).alias("metric_unit")]
        breach = value > rule.threshold if rule.operator == ">" else value >= rule.threshold
        relation = F.when(value > rule.threshold, ">").when(value < rule.threshold, "<").when(value.isNotNull(), "=")
        return F.when(chosen, F.struct(*fixed, value.alias("value"), breach.alias("threshold_breached"), relation.alias("threshold_relation"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])).alias("reasons")))

    each = rows.select(*cell, "measurement_order", "count", F.inline(F.array_compact(F.array(*[told(r) for r in rules]))))
    ready = F.size("reasons") == 0
    status = F.when(~here, ABSENT).when(~ready, INSUFFICIENT).when(F.col("threshold_breached"), EXCEEDED).otherwise(BELOW)
    return each.select(
        "rule_id", "metric", "threshold", "rule_source", "metric_unit", *cell, "measurement_order", "count", "value", "threshold_breached", "threshold_relation", status.alias("threshold_status"), ready.alias("eligible"), "reasons",
    )


def change(prefix: str) -> list[Column]:
    """Against the value in the struct <prefix>: available only if both sides are relied on."""
    ref = F.col(prefix)
    available = F.coalesce(F.col("eligible") & ref["eligible"], F.lit(False))
    delta = F.when(available, F.col("value") - ref["value"])
    status = F.when(F.col("count") == 0, ABSENT).when(~available, INSUFFICIENT).when(delta < 0, DECREASED).when(delta > 0, INCREASED)
    return [
        ref["measurement_id"].alias(f"{prefix}_measurement_id"), ref["value"].alias(f"{prefix}_value"), delta.alias(f"{prefix}_delta"), F.when(available & (ref["value"] != 0), 100.0 * delta / ref["value"]).alias(f"{prefix}_delta_percent"),
        F.when(~available, "not_comparable").when(ref["value"] == 0, "undefined_zero_reference").otherwise("defined").alias(f"{prefix}_percent_status"),
        F.when(delta < 0, "decreased").when(delta > 0, "increased").when(available, "unchanged").alias(f"{prefix}_direction"), status.alias(f"{prefix}_change_status"),
    ]


def history(values: DataFrame) -> DataFrame:
    """From a cohort's first raw breach on: each measurement with its change to that breach and to the last value relied on before it."""
    whole = Window.partitionBy("rule_id", *COHORT)
    over = whole.orderBy("measurement_order")
    point = F.struct("measurement_id", "measurement_order", "value", "count", "eligible")
    out = values.withColumn("first_position", F.min(F.when(F.col("threshold_breached"), F.col("measurement_order"))).over(whole)).where("first_position is not null")
    out = out.withColumn("first", F.first(F.when(F.col("measurement_order") == F.col("first_position"), point), ignorenulls=True).over(whole))
    out = out.withColumn("previous", F.last(F.when(F.col("eligible"), point), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("latest_position", F.max("measurement_order").over(whole)).where("measurement_order >= first_position")
    return out.select(
        "rule_id", "metric", "threshold", "rule_source", "metric_unit", *COHORT, F.col("first")["measurement_id"].alias("first_problem_measurement_id"), F.col("first")["value"].alias("first_problem_value"), F.col("first")["count"].alias("first_problem_count"),
        F.col("first")["eligible"].alias("first_problem_evaluable"), "measurement_id", "measurement_order", "count", "value", "threshold_breached", "threshold_relation", "threshold_status", "eligible",
        F.array_join("reasons", " | ").alias("insufficient_reasons"), F.when(F.col("measurement_order") == F.col("first_position"), None).otherwise(F.col("first")).alias("since_first"), "previous", "latest_position", "first_position",
    ).select("*", *change("since_first"), *change("previous")).drop("since_first", "previous")


def registry(rows: DataFrame) -> DataFrame:
    """Latest snapshot of every problem, over the whole series."""
    last = rows.where("measurement_order = latest_position")
    return last.withColumn("historical_without_latest_check", (F.col("first_position") < F.col("latest_position")) & ~F.col("eligible"))


def new(rows: DataFrame) -> DataFrame:
    return rows.where("measurement_order = first_position")


def persisting(rows: DataFrame) -> DataFrame:
    return registry(rows).where(F.col("eligible") & F.col("threshold_breached"))


def unchecked(rows: DataFrame) -> DataFrame:
    return registry(rows).where("historical_without_latest_check")


def moved(rows: DataFrame, direction: str) -> DataFrame:
    """Rows of a history with a change in one direction, per basis."""
    each = F.array(*[F.struct(F.lit(b).alias("change_basis"), F.col(f"{p}_measurement_id").alias("reference_measurement_id"), F.col(f"{p}_delta").alias("delta"), F.col(f"{p}_direction").alias("direction")) for b, p in (("first_problem", "since_first"), ("previous_eligible", "previous"))])
    return rows.select("rule_id", *COHORT, "measurement_id", "value", F.inline(each)).where(F.col("direction") == direction)


def rule_coverage(values: DataFrame) -> DataFrame:
    """Per rule and measurement: how many cohorts were seen, measurable, relied on, in breach; and a count of each reason."""
    keys = ["rule_id", "measurement_id", "measurement_order"]
    counts = values.groupBy(*keys).agg(
        F.count("*").alias("selected_cohort_count"), F.count_if(F.col("count") > 0).alias("observed_cohort_count"), F.count("value").alias("metric_available_cohort_count"), F.count_if("eligible").alias("evaluable_cohort_count"),
        F.count_if("threshold_breached").alias("raw_breach_cohort_count"), F.count_if(F.col("eligible") & F.col("threshold_breached")).alias("evaluable_breach_cohort_count"),
        F.count_if(F.col("threshold_status") == INSUFFICIENT).alias("insufficient_cohort_count"), F.count_if(F.col("threshold_status") == ABSENT).alias("absent_cohort_count"), F.sum("count").alias("observed_call_count"),
    )
    reasons = values.select(*keys, F.explode("reasons").alias("reason")).groupBy(*keys, "reason").count().groupBy(*keys)
    told = reasons.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason", "count"))), lambda r: F.concat_ws("=", r["reason"], r["count"])), " | ").alias("insufficient_reasons"))
    return counts.join(told, keys, "left").withColumn("insufficient_reasons", F.coalesce("insufficient_reasons", F.lit("")))
