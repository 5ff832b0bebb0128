"""DuckDB SQL for the derived tables."""

from __future__ import annotations

from sparktrace.operators.apdex import SCORES
from sparktrace.operators.chatty import PROFILE
from sparktrace.operators.quality import LIMITATIONS as QUALITY_LIMITATIONS
from sparktrace.operators.quality import LINKAGE_METHOD, UNAVAILABLE
from sparktrace.operators.series import LIMITATIONS as HISTORY_LIMITATIONS
from sparktrace.operators.series import METRICS, UNKNOWN_PARAMETERS
from sparktrace.plans.oracle import BASE, CPU, FLAGS, LIST, OPS

PCT = "100.0::double * {0} / nullif({1}, 0)"
UNKNOWN = "('(not specified)', '(unknown)', '')"


def family(column: str) -> str:
    return f'cast(sum({column}) as bigint) {column}_sum, avg({column}) {column}_per_call, cast(max({column}) as bigint) {column}_max'


METRIC_SQL = f"""cast(sum(duration_us) as bigint) duration_us_sum, avg(duration_us) avg_us, median(duration_us) median_us, quantile_disc(duration_us, 0.95) p95_us, quantile_disc(duration_us, 0.99) p99_us, max(duration_us) max_us,
  count(*) filter (duration_us > 1000000) duration_gt_1s_count, count(*) filter (duration_us > 5000000) duration_gt_5s_count, count(*) filter (duration_us > 10000000) duration_gt_10s_count, count(*) filter (duration_us > 30000000) duration_gt_30s_count,
  cast(sum(db_count) as bigint) db_count_sum, sum(db_count)::double / count(*) db_per_call, cast(sum(db_duration_us) as bigint) db_duration_us_sum, sum(db_duration_us)::double / count(*) / 1000000 db_seconds_per_call,
  {family("cpu_us")}, {family("in_bytes")}, {family("out_bytes")}, avg(memory_peak) memory_peak_avg, median(memory_peak) memory_peak_median, cast(quantile_disc(memory_peak, 0.95) as bigint) memory_peak_p95,
  cast(quantile_disc(memory_peak, 0.99) as bigint) memory_peak_p99, cast(max(memory_peak) as bigint) memory_peak_max, {CPU}"""


COVERED = ["cpu_us", "memory", "memory_peak", "in_bytes", "out_bytes", "rows_affected"]
RAW = {
    "cpu_us": ("k % 10 = 0", "k % 10 = 1", "k % 10 = 2", "k % 10 = 3"), "memory": ("false", "k % 11 = 0", "false", "false"), "memory_peak": ("k % 6 = 0", "false", "false", "false"),
    "in_bytes": ("false", "false", "false", "k % 9 = 0"), "out_bytes": ("k % 8 = 0", "false", "false", "false"), "rows_affected": ("false", "false", "false", "false"),
}
AVAILABLE = "to_json({" + ", ".join(
    [f"'{c}': {{'stored_numeric_count': count({c}), 'stored_zero_count': count(*) filter ({c} = 0), 'raw_missing_count': count(*) filter ({m}), 'raw_empty_count': count(*) filter ({e}), 'raw_invalid_count': count(*) filter ({i}), 'raw_out_of_range_count': count(*) filter ({o})}}" for c, (m, e, i, o) in RAW.items()]
    + [f"'{c}': {{'stored_numeric_count': count(*), 'stored_zero_count': count(*) filter ({c} = 0)}}" for c in ("duration_us", "db_count", "db_duration_us", "sdbl_count", "lock_count", "lock_duration_us", "error_count")]
    + ["'db_rows': {'stored_numeric_count': cast(sum(db_rows_available_count) as bigint), 'raw_not_valid_count': cast(sum(db_count) - sum(db_rows_available_count) as bigint)}"]) + "})::varchar"
LIMITS = "array_to_string(list_sort(list_filter([{0}], lambda x: x is not null)), ' | ')"
SERIES = """, ser0 as (select measurement_id, min(start_us) filter (event_type = 'CALL') by_call, coalesce(min(start_us) filter (event_type = 'CALL'), min(end_us)) begins from e group by 1),
ser1 as (select *, (select count(*) <= 1 or count(*) = count(distinct begins) from ser0) series_order_reliable from ser0),
ser as (select measurement_id, series_order_reliable, cast(row_number() over (order by begins, measurement_id) as int) measurement_order, 'm1' series_baseline,
  case when by_call is not null then 'saved_call_start_time' when begins is not null then 'saved_event_summary_time' else 'identifier_tiebreak_no_saved_time' end || case when series_order_reliable then '' else ';series_order_not_fully_established' end order_basis from ser1)"""
QUALITY = SERIES + f""", lq as (select measurement_id, count(*) db_total_count, count(parent_call_id) db_linked_count, cast(sum(duration_us) as bigint) db_total_duration_us, cast(coalesce(sum(duration_us) filter (parent_call_id is not null), 0) as bigint) db_linked_duration_us,
  round({PCT.format("count(parent_call_id)", "count(*)")}, 6) db_linked_count_percent, round({PCT.format("coalesce(sum(duration_us) filter (parent_call_id is not null), 0)", "sum(duration_us)")}, 6) db_linked_duration_percent from dec where event_type = 'DBPOSTGRS' group by 1),
fl as (select 'cap' || substr(dataset_id, 2) capture_id, case process when 'rphost_1' then 'partial_nul_salvaged' when 'rphost_3' then 'valid_no_timestamp' else 'valid' end status, '' reason from (select distinct dataset_id, process from e)
  union all select 'cap0', case n_nationkey % 4 when 0 then 'skipped_duplicate' when 1 then 'skipped' else 'valid' end, case when n_nationkey % 8 = 1 then 'empty_or_bom_only' else 'no_record_head' end from nation),
hl as (select capture_id, count(*) files, count(*) filter (status = 'partial_nul_salvaged') partial, count(*) filter (status = 'skipped' and reason = 'no_record_head') skipped, count(*) filter (status = 'skipped_duplicate') dup from fl group by 1),
pe as (select dataset_id, count(*) filter (event_id % 101 = 0) n from e group by 1),
mem as (select measurement_id, {LIST.format("dataset_id")} dataset_ids, cast(sum(n) as bigint) related_dataset_parse_errors, {LIST.format("capture_id")} capture_ids, cast(sum(files) as bigint) related_capture_file_count, cast(sum(partial) as bigint) related_capture_partial_files,
  cast(sum(skipped) as bigint) related_capture_nonempty_skipped_files, cast(sum(dup) as bigint) related_capture_duplicate_files from (select distinct measurement_id, dataset_id, 'cap' || substr(dataset_id, 2) capture_id from e) join hl using (capture_id) join pe using (dataset_id) group by 1),
qc as (select measurement_id, count(*) call_count, {LIST.format('"user"')} users, count(distinct "user") user_count, count(distinct signature) operation_signature_count, count(distinct row(signature, "user")) operation_user_count, min(start_us) observed_call_start, max(end_us) observed_call_end,
  count(*) filter (end_us is null) calls_without_time, count(*) filter (process = 'rphost_1') calls_from_partial_sources, count(*) filter (db_count = 0) calls_with_zero_linked_db, count(*) filter (error_count > 0) calls_with_linked_errors, {AVAILABLE} metric_availability,
  least({", ".join(f"count({c})" for c in COVERED)}) < count(*) or sum(db_rows_available_count) < sum(db_count) some_unknown from obs group by 1),
qual as (select measurement_id, measurement_order, order_basis, dataset_ids, capture_ids, call_count, users, user_count, operation_signature_count, operation_user_count, observed_call_start, observed_call_end, calls_without_time, calls_from_partial_sources, calls_with_zero_linked_db, calls_with_linked_errors,
  case when call_count < 10 then 'below_configured_minimum' else 'meets_count_threshold_only' end sample_size_status, 10 configured_min_call_count, true bundle_analysis_complete, true bundle_recorded_source_hashes_complete, 'not_established_from_saved_results' source_completeness,
  case when related_capture_partial_files > 0 or related_capture_nonempty_skipped_files > 0 then 'known_related_capture_gaps' else 'no_recorded_related_capture_problem' end recorded_source_health, 'capture_not_day_or_operation_nonadditive_between_measurements' related_file_scope,
  related_capture_file_count, related_capture_partial_files, related_capture_nonempty_skipped_files, related_capture_duplicate_files, related_dataset_parse_errors, coalesce(db_total_count, 0) db_total_count, coalesce(db_linked_count, 0) db_linked_count, coalesce(db_total_count - db_linked_count, 0) db_unlinked_count,
  db_linked_count_percent, coalesce(db_total_duration_us, 0) db_total_duration_us, coalesce(db_linked_duration_us, 0) db_linked_duration_us, coalesce(db_total_duration_us - db_linked_duration_us, 0) db_unlinked_duration_us, db_linked_duration_percent,
  case when db_total_count is null then 'no_db_events_denominator' when db_linked_count_percent < 99 or db_linked_duration_percent < 99 then 'below_configured_coverage_threshold' when db_linked_count < db_total_count then 'partial_coverage_above_configured_threshold'
    else 'all_recorded_db_events_linked_not_source_completeness' end db_linkage_status, 99.0::double configured_db_linkage_warning_percent, metric_availability, '{" | ".join(UNAVAILABLE)}' unavailable_dimensions, '{LINKAGE_METHOD}' linkage_method,
  {LIMITS.format(", ".join(f"'{x}'" for x in QUALITY_LIMITATIONS) + ", case when related_capture_partial_files > 0 or related_capture_nonempty_skipped_files > 0 then 'related_capture_has_unread_or_partial_sources' end, case when calls_without_time > 0 then 'some_call_times_unavailable' end, case when call_count < 10 then 'sample_below_configured_minimum' end, case when db_linked_count < db_total_count then 'some_recorded_db_events_not_assigned_to_call' end, case when some_unknown then 'incomplete_numeric_counter_coverage' end")} known_limitations
  from ser join qc using (measurement_id) left join lq using (measurement_id) left join mem using (measurement_id))"""
KNOWN = ["memory", "memory_peak", "in_bytes", "out_bytes", "rows_affected"]


def hist(user: str = '"user"', pooled: bool = False) -> str:
    known = ", ".join(f"count({c}) {c}_known" for c in KNOWN)
    kept = "first_call_start, last_call_end, found.dataset_ids, processes, db_rows_known_count, " + ", ".join(f"{c}_known" for c in KNOWN)
    some = "found.count > 0 and (least(cpu_available_count, " + ", ".join(f"{c}_known" for c in KNOWN) + ") < found.count or db_rows_known_count < db_count_sum)"
    more = f"case when {'true' if pooled else 'false'} then 'all_users_summary_overlaps_same_user_history_do_not_sum_views' end, case when {some} then 'incomplete_numeric_counter_coverage' end, case when recorded_source_health <> 'no_recorded_related_capture_problem' then 'related_capture_has_recorded_source_gaps_scope_not_operation' end, case when not grid.series_order_reliable then 'series_chronology_unresolved' end"
    return QUALITY + f""",
found as (select signature, {user} "user", measurement_id, count(*) count, {METRIC_SQL}, min(start_us) first_call_start, max(end_us) last_call_end, {LIST.format("dataset_id")} dataset_ids, {LIST.format("process")} processes,
  count(*) filter (end_us is null) calls_without_time, count(*) filter (process = 'rphost_1') calls_from_partial_sources, {known}, cast(sum(db_rows_available_count) as bigint) db_rows_known_count from obs group by 1, 2, 3),
grid as (select * from (select distinct signature, "user" from found) cross join ser),
h0 as (select grid.*, coalesce(found.count, 0) count, {", ".join("found." + m for m in METRICS)}, {kept}, coalesce(found.calls_without_time, 0) calls_without_time, coalesce(found.calls_from_partial_sources, 0) calls_from_partial_sources,
    recorded_source_health measurement_source_health, db_linked_count_percent measurement_db_linked_count_percent, db_linked_duration_percent measurement_db_linked_duration_percent, {LIMITS.format(", ".join(f"'{x}'" for x in HISTORY_LIMITATIONS) + ", " + more)} known_limitations,
    case when found.count > 0 then 'observed' else 'not_observed' end observation_status, case when found.count > 0 then grid.measurement_id end here
  from grid left join found on grid.signature = found.signature and grid."user" is not distinct from found."user" and grid.measurement_id = found.measurement_id left join qual on grid.measurement_id = qual.measurement_id),
hist as (select * exclude (here), first_value(here ignore nulls) over (w rows between unbounded preceding and unbounded following) first_observation,
    last_value(here ignore nulls) over (w rows between unbounded preceding and 1 preceding) previous_observation, lag(measurement_id) over w previous_measurement
  from h0 window w as (partition by signature, "user" order by measurement_order))"""


HIST = hist()
STATE = """case when h.reference_measurement_id is null and (not h.series_order_reliable or h.comparison_basis = 'series_baseline') then 'series_chronology_unresolved'
  when h.reference_measurement_id is null then case h.comparison_basis when 'previous_measurement' then 'no_previous_measurement' else 'no_previous_observation' end
  when h.comparison_basis = 'first_observation' and r.measurement_order > h.measurement_order then 'before_first_observation' when r.count = 0 and h.count = 0 then 'both_not_observed'
  when r.count = 0 then 'reference_not_observed' when h.count = 0 then 'current_not_observed' else 'numerical_comparison' end"""
RELATION = """case when h.reference_measurement_id is null then 'no_reference' when r.measurement_order = h.measurement_order then 'same_measurement' when not h.series_order_reliable then 'unknown_order'
  when r.measurement_order < h.measurement_order then 'earlier' else 'later' end"""


def pairs(source: str, keys: str, bases: list[str], state: str = STATE) -> str:
    """CTE tmp of current rows h and reference rows r, with state."""
    refs = ", ".join(b if b == "series_baseline" else f"case when series_order_reliable then {b} end" for b in bases)
    on = " and ".join(f"h.{k} is not distinct from r.{k}" for k in keys.split(","))
    return f""", hb as (select *, unnest({bases!r}) comparison_basis, unnest([{refs}]) reference_measurement_id from {source}),
    tmp as (select h, r, {state} comparison_state, {RELATION} reference_relation from hb h left join {source} r on h.reference_measurement_id = r.measurement_id and {on})"""


def changes(names: list[str]) -> str:
    out = []
    for m in names:
        both = f"comparison_state = 'numerical_comparison' and h.{m} is not null and r.{m} is not null"
        out.append(f"r.{m}::double {m}_reference, h.{m}::double {m}_current, case when {both} then h.{m}::double - r.{m}::double end {m}_delta_absolute, case when {both} and r.{m} <> 0 then 100.0::double * (h.{m}::double - r.{m}::double) / r.{m} end {m}_delta_percent")
    return ", ".join(out)


def listed(names: list[str], test: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {test.format(n)} then '{n}' end" for n in sorted(names)) + "], lambda x: x is not null), ' | ')"


BASES = ["first_observation", "previous_observation", "previous_measurement", "series_baseline"]
SAMPLE = "case when comparison_state <> 'numerical_comparison' then 'missing_observations' when least(h.count, r.count) < 10 then 'below_configured_minimum' else 'meets_count_threshold_only' end"
SIDES = 'h.signature signature, h."user" "user", h.comparison_basis comparison_basis, h.reference_measurement_id reference_measurement_id, h.measurement_id current_measurement_id'
FAST = "duration_us <= 60000000000"
PROFILE_SQL = f"""cast(sum(db_count) as bigint) db_count_sum, avg(db_count) db_per_call_avg, median(db_count) db_per_call_median, quantile_disc(db_count, 0.95) db_per_call_p95, max(db_count) db_per_call_max,
  cast(sum(duration_us) as bigint) call_duration_us_sum, avg(duration_us) call_duration_us_avg, median(duration_us) call_duration_us_median, quantile_disc(duration_us, 0.95) call_duration_us_p95, max(duration_us) call_duration_us_max,
  cast(sum(db_duration_us) as bigint) linked_db_duration_us_sum, sum(db_duration_us)::double / count(*) / 1000000 linked_db_seconds_per_call, count(*) filter (db_count = 0) calls_with_zero_linked_db,
  count(*) filter (hit) calls_above_threshold_count, count(*) call_share_denominator, {PCT.format("count(*) filter (hit)", "count(*)")} calls_above_threshold_percent, count(*) filter ({FAST}) fast_call_count,
  count(*) filter (hit and {FAST}) fast_calls_above_threshold_count, count(*) filter ({FAST}) fast_call_share_denominator, {PCT.format(f"count(*) filter (hit and {FAST})", f"count(*) filter ({FAST})")} fast_calls_above_threshold_percent,
  cast(coalesce(sum(db_count) filter (hit), 0) as bigint) chatty_db_count_sum, cast(coalesce(sum(duration_us) filter (hit), 0) as bigint) chatty_call_duration_us_sum, avg(duration_us) filter (hit) chatty_call_duration_us_avg,
  median(duration_us) filter (hit) chatty_call_duration_us_median, quantile_disc(duration_us, 0.95) filter (hit) chatty_call_duration_us_p95, max(duration_us) filter (hit) chatty_call_duration_us_max,
  cast(coalesce(sum(db_duration_us) filter (hit), 0) as bigint) chatty_linked_db_duration_us_sum, sum(db_duration_us) filter (hit)::double / nullif(count(*) filter (hit), 0) / 1000000 chatty_linked_db_seconds_per_call"""
THR = """, thr as (select *, db_count > threshold_db_events hit from (select *, unnest([0, 1]) threshold_db_events from obs)),
  grp as (select signature, "user", measurement_id, threshold_db_events, count(*) count, sum(db_count) > threshold_db_events * count(*) group_mean_above_threshold, """ + PROFILE_SQL + """ from thr group by 1, 2, 3, 4)"""
CHATTY = HIST + THR + f""", chat as (select g.signature, g."user", g.measurement_id, g.threshold_db_events, g.measurement_order, g.series_order_reliable, g.first_observation, g.previous_observation,
    coalesce(grp.count, 0) count, group_mean_above_threshold, {", ".join("grp." + p for p in PROFILE)}
  from (select *, unnest([0, 1]) threshold_db_events from hist) g left join grp using (signature, "user", measurement_id, threshold_db_events))"""
BAND = "case when duration_us <= 30000000000 then 0 when duration_us <= 90000000000 then 1 when duration_us <= 180000000000 then 2 else 3 end"
EXCEEDED = """select call_id, signature, "user", measurement_id, duration_us, db_count, db_duration_us, case when db_count > 1 then '0,1' else '0' end thresholds_exceeded, """ + f"{FAST} is_fast_call, {BAND} duration_band_index from obs where db_count > 0"

GOALS = """, goals(signature, target_id, target_kind, target_class_id, overridden_class_id, t_us, target_status) as (values ('op0', 'fast', 'operation', null, null, 36000000000, 'business_approved'),
  ('op1', 'slow', 'explicit_class', 'c1', null, 60000000000, 'engineering_proposal'), ('op2', 'slow', 'explicit_class', 'c1', null, 60000000000, 'engineering_proposal'), ('op3', 'own', 'operation', null, 'c1', 72000000000, 'engineering_proposal')),
cl0 as (select obs.*, target_id, target_kind, target_class_id, overridden_class_id, t_us, target_status, k = 13 confirmed_failure,
  case when duration_us <= t_us then 'satisfied' when duration_us <= 4 * t_us then 'tolerating' when t_us is not null then 'frustrated' end latency_category from obs left join goals using (signature)),
cl as (select *, case when t_us is not null and confirmed_failure then 'frustrated' else latency_category end category from cl0)"""
SCORE_SQL = """count(t_us) covered_call_count, count(t_us) apdex_denominator, case when count(t_us) > 0 then count(*) filter (category = 'satisfied') end satisfied_count, case when count(t_us) > 0 then count(*) filter (category = 'tolerating') end tolerating_count,
  case when count(t_us) > 0 then count(*) filter (category = 'frustrated') end frustrated_count, case when count(t_us) > 0 then 2 * count(*) filter (category = 'satisfied') + count(*) filter (category = 'tolerating') end apdex_numerator_twice,
  case when count(t_us) > 0 then (2 * count(*) filter (category = 'satisfied') + count(*) filter (category = 'tolerating'))::double / (2 * count(t_us)) end apdex, case when count(t_us) > 0 then count(*) filter (latency_category = 'frustrated') end latency_frustrated_count,
  case when count(t_us) > 0 then count(*) filter (confirmed_failure and latency_category <> 'frustrated') end forced_frustrated_count, count(*) filter (confirmed_failure) confirmed_failure_count,
  count(*) filter (not confirmed_failure) business_outcome_unknown_count, count(*) filter (error_count > 0) calls_with_linked_error_events"""
SCORED = "covered_call_count apdex_denominator satisfied_count tolerating_count frustrated_count apdex_numerator_twice apdex latency_frustrated_count forced_frustrated_count confirmed_failure_count business_outcome_unknown_count calls_with_linked_error_events".split()
ZERO = ("covered_call_count", "apdex_denominator", "confirmed_failure_count", "business_outcome_unknown_count", "calls_with_linked_error_events")
APDEX = HIST + GOALS + f""", sc as (select signature, "user", measurement_id, {SCORE_SQL} from cl group by 1, 2, 3),
apd as (select hist.signature, hist."user", hist.measurement_id, series_baseline, measurement_order, series_order_reliable, count, first_observation, previous_observation, previous_measurement, target_id, target_kind, target_class_id, overridden_class_id, t_us, target_status,
  {", ".join(f"coalesce(sc.{s}, 0) {s}" if s in ZERO else f"sc.{s}" for s in SCORED)}, case when t_us is null then 'uncovered_no_target' else 'target_defined' end target_coverage_status, count = 1 small_sample_warning, case count when 0 then 'no_calls' when 1 then 'below_configured_minimum' else 'meets_count_threshold_only' end sample_size_status, 4 * t_us four_t_us
  from hist left join goals on hist.signature = goals.signature left join sc on hist.signature = sc.signature and hist."user" = sc."user" and hist.measurement_id = sc.measurement_id)"""
SCOPE = "case when grouping(measurement_id) = 1 then 'selected_measurements_all_users' else 'measurement_all_users' end population_scope"
OVERALL = GOALS + f""", scopes as (select *, unnest(['business_approved', 'engineering_proposal']) target_status from (select measurement_id, {SCOPE}, count(*) total_calls_in_scope, count(*) filter (t_us is null) calls_without_target from cl group by grouping sets ((measurement_id), ()))),
fo as (select measurement_id, target_status, {SCOPE}, count(distinct signature) operation_count, count(distinct "user") user_identifier_count, {LIST.format("target_id")} target_ids, {SCORE_SQL} from cl where t_us is not null group by grouping sets ((measurement_id, target_status), (target_status))),
ov as (select s.*, coalesce(operation_count, 0) operation_count, coalesce(user_identifier_count, 0) user_identifier_count, coalesce(target_ids, '') target_ids, {", ".join(f"coalesce(fo.{s}, 0) {s}" if s in ZERO else f"fo.{s}" for s in SCORED)},
  total_calls_in_scope - calls_without_target - coalesce(covered_call_count, 0) calls_with_other_target_status, coalesce(covered_call_count, 0) = 1 small_sample_warning,
  case coalesce(covered_call_count, 0) when 0 then 'no_scored_calls' when 1 then 'below_configured_minimum' else 'meets_count_threshold_only' end sample_size_status, {PCT.format("coalesce(covered_call_count, 0)", "total_calls_in_scope")} scored_call_percent
  from scopes s left join fo on s.population_scope = fo.population_scope and s.measurement_id is not distinct from fo.measurement_id and s.target_status = fo.target_status)"""


def rule(name: str, metric: str, threshold: float, op: str, minimum: int, source: str, value: str, no_target: str = "false", gate: str = "[]", unit: str = "count") -> str:
    return f"""select '{name}' rule_id, '{metric}' metric, {threshold}::double threshold, 'configuration' rule_source, '{unit}' metric_unit, signature, "user", measurement_id, measurement_order, count, case when count > 0 then {value} end as value, {no_target} no_target, '{op}' op, {minimum} minimum, {gate} gates from {source}"""


EVALUATED = BASE + CHATTY + APDEX.replace(HIST, "", 1) + ", ru as (" + " union all ".join([
    rule("clean", "operation.max_us", 250e9, ">", 1, """hist where "user" in ('user1', 'user2', 'user3', '(not specified)')""", "max_us::double", unit="microseconds"),
    rule("slow", "operation.avg_us", 150e9, ">", 2, "hist", "avg_us", unit="microseconds"),
    rule("chatty", "db_chatty.calls_above_threshold_percent", 50, ">=", 1, "chat where threshold_db_events = 0", "calls_above_threshold_percent", gate="['count', '20']", unit="percent"),
    rule("score", "apdex.deficit", 0.5, ">", 1, "apd where signature <> 'op3'", "case when apdex_denominator > 0 then (2 * apdex_denominator - apdex_numerator_twice)::double / (2 * apdex_denominator) end", "t_us is null", unit="1_minus_APDEX"),
    rule("linked", "operation.db_count_sum", 2, ">=", 1, "hist", "db_count_sum::double", gate="['duration', '24']"),
]) + f"""), ev1 as (select ru.*, case when op = '>' then value > threshold else value >= threshold end threshold_breached, case when value > threshold then '>' when value < threshold then '<' when value is not null then '=' end threshold_relation,
  list_filter([case when count > 0 and value is null and no_target then 'APDEX_T_not_defined' end,
    case when count > 0 and rule_id = 'chatty' and coalesce(db_linked_count_percent < 20, true) then 'measurement_DB_count_coverage_unknown_or_below_gate' end,
    case when count > 0 and rule_id = 'linked' and coalesce(db_linked_duration_percent < 24, true) then 'measurement_DB_duration_coverage_unknown_or_below_gate' end,
    case when count > 0 and value is null then 'metric_unavailable' end, case when count = 0 then 'operation_not_observed' end,
    case when count > 0 and rule_id = 'clean' and (recorded_source_health <> 'no_recorded_related_capture_problem' or partial_calls > 0) then 'related_capture_has_recorded_source_gaps' end, case when count > 0 and count < minimum then 'sample_below_rule_minimum' end,
    case when count > 0 and "user" in {UNKNOWN} then 'user_identity_unknown' end], lambda x: x is not null) reasons from ru left join lq using (measurement_id) join (select measurement_id, recorded_source_health from qual) using (measurement_id)
  left join (select signature, "user", measurement_id, calls_from_partial_sources partial_calls from hist) using (signature, "user", measurement_id)),
ev2 as (select *, len(reasons) = 0 eligible, case when count = 0 then 'не наблюдалось' when len(reasons) > 0 then 'недостаточно данных' when threshold_breached then 'порог превышен' else 'ниже порога в наблюдениях' end threshold_status from ev1)"""


def change(p: str) -> str:
    ok = f"(eligible and coalesce({p}.eligible, false))"
    delta = f"(value - {p}.value)"
    return f"""{p}.measurement_id {p}_measurement_id, {p}.value {p}_value, case when {ok} then {delta} end {p}_delta, case when {ok} and {p}.value <> 0 then 100.0::double * {delta} / {p}.value end {p}_delta_percent,
      case when not {ok} then 'not_comparable' when {p}.value = 0 then 'undefined_zero_reference' else 'defined' end {p}_percent_status, case when not {ok} then null when {delta} < 0 then 'decreased' when {delta} > 0 then 'increased' else 'unchanged' end {p}_direction,
      case when count = 0 then 'не наблюдалось' when not {ok} then 'недостаточно данных' when {delta} < 0 then 'показатель снизился' when {delta} > 0 then 'показатель вырос' end {p}_change_status"""


PROBLEMS = EVALUATED + f""", p1 as (select *, min(case when threshold_breached then measurement_order end) over (partition by rule_id, signature, "user") first_position, max(measurement_order) over (partition by rule_id, signature, "user") latest_position,
    {{'measurement_id': measurement_id, 'value': value, 'count': count, 'eligible': eligible}} pt from ev2),
  p2 as (select *, first_value(case when measurement_order = first_position then pt end ignore nulls) over (w rows between unbounded preceding and unbounded following) f,
    last_value(case when eligible then pt end ignore nulls) over (w rows between unbounded preceding and 1 preceding) previous from p1 window w as (partition by rule_id, signature, "user" order by measurement_order)),
  p3 as (select *, case when measurement_order <> first_position then f end since_first from p2 where first_position is not null and measurement_order >= first_position),
  ph as (select rule_id, metric, threshold, rule_source, metric_unit, signature, "user", f.measurement_id first_problem_measurement_id, f.value first_problem_value, f.count first_problem_count, f.eligible first_problem_evaluable, measurement_id, measurement_order, count, value,
    threshold_breached, threshold_relation, threshold_status, eligible, array_to_string(reasons, ' | ') insufficient_reasons, latest_position, first_position, {change("since_first")}, {change("previous")} from p3),
  pr as (select *, first_position < latest_position and not eligible historical_without_latest_check from ph where measurement_order = latest_position),
  mv as (select rule_id, signature, "user", measurement_id, value, unnest(['first_problem', 'previous_eligible']) change_basis, unnest([since_first_measurement_id, previous_measurement_id]) reference_measurement_id,
    unnest([since_first_delta, previous_delta]) delta, unnest([since_first_direction, previous_direction]) direction from ph)"""

ORDERS = """with li as (select l_orderkey, count(*) n, sum(cast(l_quantity * 1000 as bigint)) us from lineitem group by 1),
  thr as (select *, db_count > threshold_db_events hit from (select o_orderpriority signature, c_mktsegment "user", cast(year(o_orderdate) as varchar) measurement_id, cast(round(o_totalprice * 100) as bigint) duration_us,
    coalesce(n, 0) db_count, cast(coalesce(us, 0) as bigint) db_duration_us, unnest([3, 5, 8]) threshold_db_events from orders join customer on o_custkey = c_custkey left join li on o_orderkey = l_orderkey))"""
VERIFY = ["more_than_one_selected", "selected_is_not_the_parent", "parent_is_no_call", "selected_is_not_eligible", "unlinked_with_candidates", "evidence_without_decision"]

ORACLE = {
    "order_chatty": ORDERS + f"""select signature, "user", measurement_id, threshold_db_events, count(*) count, sum(db_count) > threshold_db_events * count(*) group_mean_above_threshold, {PROFILE_SQL.replace(FAST, "duration_us <= 10000000")} from thr group by 1, 2, 3, 4""",
    "sql_dictionary": BASE + f""", s as (select distinct sql_text, sql_pattern, array_to_string(sql_tables, ' | ') tables, k % 6 shape from e where sql_text is not null)
      select sql_text, sql_pattern normalized_sql, case when shape = 3 then 'raw_fallback' else 'normalized' end sql_normalization_status, tables, {FLAGS}, sha256('1c-tj-sql' || chr(0) || '2.0' || chr(0) || sql_pattern) sql_fingerprint_sha256, sha256(sql_pattern) legacy_fingerprint_sha256 from s""",
    "db_observations": BASE + """select event_id, dataset_id, measurement_id, "user", duration_us, status, reason_code, parent_call_id, sql_pattern normalized_sql, sha256('1c-tj-sql' || chr(0) || '2.0' || chr(0) || sql_pattern) sql_fingerprint_sha256 from dec where event_type = 'DBPOSTGRS'""",
    "report_overview": BASE + f""", {OPS} select measurement_id, "user", signature, cpu_percent_of_wall, duration_us, row_number() over (partition by measurement_id order by cpu_percent_of_wall desc nulls last, duration_us desc nulls last, signature, "user") rank
      from (select measurement_id, "user", signature, duration_us, cpu_percent_of_wall from ops) qualify rank <= 5""",
    "report_trajectories": BASE + HIST + """, b as (select signature, "user" from hist group by 1, 2 order by max(duration_us_sum) desc nulls last, 1, 2 limit 10) select signature, "user", measurement_id, count, duration_us_sum from hist semi join b using (signature, "user")""",
    "report_comparisons": BASE + HIST + pairs("hist", 'signature,"user"', BASES) + f""", t2 as (select *, coalesce(h.count > 0 and r.count > 0, false) both_, h."user" not in {UNKNOWN} known_user from tmp)
      select {SIDES}, r.count reference_count, h.count current_count, comparison_state, case when both_ and known_user then 'same_signature_same_user_uncontrolled' when both_ then 'user_identity_unknown' else 'insufficient_observations_for_comparison' end comparability_status,
      case when both_ and known_user then true end user_match from t2""",
    "report_states": BASE + HIST + """select signature, "user", measurement_id, case when count = 0 then 'no_observations' when measurement_source_health = 'known_related_capture_gaps' then 'partial' else 'ready' end row_state,
      case when count = 0 then 'нет наблюдений' end p95_reason, case when count = 0 then 'нет наблюдений' when cpu_percent_of_wall is null then 'показатель недоступен' end cpu_reason from hist""",
    "verify_links": f"""select unnest({VERIFY!r}) "check", 0 violations""",
    "data_quality": BASE + QUALITY + "select * from qual",
    "operation_history": BASE + HIST + "select * from hist",
    "operation_history_all_users": BASE + hist("cast(null as varchar)", True) + 'select * exclude ("user") from hist',
    "measurement_comparisons": BASE + HIST + pairs("hist", 'signature,"user"', BASES) + f"""select {SIDES}, r.count reference_count, h.count current_count, coalesce(r.observation_status, 'no_reference') reference_observation_status, h.observation_status current_observation_status, case when r.count is null then 'no_reference' when r.count = 0 then 'undefined_zero_reference' else 'defined' end sample_count_percent_status,
      {SAMPLE} sample_size_status, comparison_state, reference_relation, (h.count - r.count)::double sample_count_delta_absolute,
      case when r.count > 0 then 100.0::double * (h.count - r.count) / r.count end sample_count_delta_percent, {listed(METRICS, "comparison_state = 'numerical_comparison' and h.{0} is not null and r.{0} = 0")} percent_undefined_zero_reference_metrics,
      {listed(METRICS, "(h.{0} is null or r.{0} is null)")} unavailable_metrics, {changes(METRICS)} from tmp""",
    "comparability": BASE + HIST + """, seen as (select signature, measurement_id, string_agg(distinct "user", ' | ' order by "user") ous from obs group by 1, 2), hs as (select hist.*, coalesce(ous, '') ous from hist left join seen using (signature, measurement_id))""" + pairs("hs", 'signature,"user"', BASES) + f"""
      , t2 as (select *, coalesce(h.count > 0 and r.count > 0, false) both_, h."user" not in {UNKNOWN} known_user from tmp)
      select {SIDES}, comparison_state, {SAMPLE} sample_size_status, case when both_ and known_user then 'same_signature_same_user_uncontrolled' when both_ then 'user_identity_unknown' else 'insufficient_observations_for_comparison' end comparability_status,
      case when both_ then true end signature_match, case when both_ and known_user then true end user_match, case when h.reference_measurement_id is not null then true end key_signature_match, case when h.reference_measurement_id is not null then true end key_user_match,
      coalesce(r.ous, '') reference_operation_users_all, h.ous current_operation_users_all, {", ".join(f"r.{c} reference_{c}, h.{c} current_{c}" for c in ("dataset_ids", "processes", "measurement_db_linked_count_percent", "measurement_db_linked_duration_percent", "calls_from_partial_sources"))},
      {LIMITS.format(", ".join([
        "case when h.reference_measurement_id is not null and r.count <> h.count then 'sample_size_changed' end", "case when r.count = 0 and r.ous <> '' then 'reference_operation_observed_only_for_other_users' end", "case when h.count = 0 and h.ous <> '' then 'current_operation_observed_only_for_other_users' end",
        "case when both_ and (h.count <> r.count or h.cpu_available_count <> r.cpu_available_count) then 'cpu_us_numeric_coverage_changed' end", "case when both_ and (h.db_count_sum <> r.db_count_sum or h.db_rows_known_count <> r.db_rows_known_count) then 'db_rows_numeric_coverage_changed' end",
        *[f"case when both_ and (h.count <> r.count or h.{c}_known <> r.{c}_known) then '{c}_numeric_coverage_changed' end" for c in KNOWN],
        *[f"case when both_ and h.{c} is distinct from r.{c} then '{c}_changed' end" for c in ("dataset_ids", "processes", "measurement_source_health", "measurement_db_linked_count_percent", "measurement_db_linked_duration_percent", "calls_from_partial_sources")]]))} known_differences,
      '{" | ".join(UNKNOWN_PARAMETERS)}' || case when known_user then '' else ' | user_identity' end || case when h.series_order_reliable then '' else ' | measurement_order' end unknown_parameters,
      array_to_string(list_sort(list_distinct(list_concat(string_split(h.known_limitations, ' | '), coalesce(string_split(r.known_limitations, ' | '), cast([] as varchar[]))))), ' | ') known_limitations from t2""",
    "db_chatty": BASE + CHATTY + "select * exclude (first_observation, previous_observation) from chat",
    "db_chatty_calls": BASE + EXCEEDED,
    "db_chatty_fast_calls": BASE + f"select * from ({EXCEEDED}) where is_fast_call",
    "db_chatty_duration": BASE + THR + f""", b as (select signature, "user", measurement_id, threshold_db_events, {BAND} duration_band_index, count(*) n, count(*) filter (hit) hits, sum(duration_us) us, sum(db_duration_us) db_us, sum(duration_us) filter (hit) hit_us from thr group by 1, 2, 3, 4, 5),
      g as (select signature, "user", measurement_id, threshold_db_events, cast(sum(n) as bigint) group_call_count, cast(sum(hits) as bigint) group_chatty_call_denominator, unnest([0, 1, 2, 3]) duration_band_index from b group by 1, 2, 3, 4)
      select g.*, coalesce(n, 0) band_call_count, coalesce(hits, 0) band_calls_above_threshold_count, cast(coalesce(us, 0) as bigint) band_call_duration_us_sum, cast(coalesce(db_us, 0) as bigint) band_linked_db_duration_us_sum, cast(coalesce(hit_us, 0) as bigint) chatty_call_duration_us_sum,
      {PCT.format("hits", "n")} within_band_above_threshold_percent, {PCT.format("coalesce(hits, 0)", "group_chatty_call_denominator")} share_of_group_chatty_calls_percent from g left join b using (signature, "user", measurement_id, threshold_db_events, duration_band_index)""",
    "db_chatty_coverage": BASE + THR + f""", f as (select thr.*, group_mean_above_threshold flagged, case when thr."user" not in {UNKNOWN} then thr."user" end known from thr join grp using (signature, "user", measurement_id, threshold_db_events))
      select measurement_id, threshold_db_events, {SCOPE}, count(*) total_call_count, count(*) filter (hit) chatty_call_count, {PCT.format("count(*) filter (hit)", "count(*)")} chatty_call_percent, count(distinct signature) observed_operation_count,
      count(distinct signature) filter (hit) affected_operation_count, {PCT.format("count(distinct signature) filter (hit)", "count(distinct signature)")} affected_operation_percent, count(distinct known) observed_known_user_count, count(distinct known) filter (hit) affected_known_user_count,
      {PCT.format("count(distinct known) filter (hit)", "count(distinct known)")} affected_known_user_percent, count(*) filter (known is null) calls_with_unknown_user_count, count(*) filter (known is null and hit) chatty_calls_with_unknown_user_count,
      count(distinct row(signature, "user", measurement_id)) observed_group_count, count(distinct row(signature, "user", measurement_id)) filter (flagged) mean_flagged_group_count, count(*) filter (flagged) calls_in_mean_flagged_groups_count,
      count(distinct signature) filter (flagged) mean_flagged_operation_count, count(distinct known) filter (flagged) mean_flagged_known_user_count, {PCT.format("count(*) filter (flagged)", "count(*)")} calls_in_mean_flagged_groups_percent, count(*) filter ({FAST}) fast_call_count, count(*) filter (hit and {FAST}) fast_chatty_call_count,
      {PCT.format(f"count(*) filter (hit and {FAST})", f"count(*) filter ({FAST})")} fast_chatty_call_percent, count(*) filter (db_count = 0) calls_with_zero_linked_db, cast(sum(duration_us) as bigint) call_duration_us_sum, cast(sum(db_duration_us) as bigint) linked_db_duration_us_sum,
      cast(coalesce(sum(duration_us) filter (hit), 0) as bigint) chatty_call_duration_us_sum, cast(coalesce(sum(db_duration_us) filter (hit), 0) as bigint) chatty_linked_db_duration_us_sum
      from f group by grouping sets ((measurement_id, threshold_db_events), (threshold_db_events))""",
    "db_chatty_changes": BASE + CHATTY + pairs("chat", 'signature,"user",threshold_db_events', BASES[:2]) + f"""select {SIDES}, h.threshold_db_events threshold_db_events, comparison_state, reference_relation, r.group_mean_above_threshold reference_group_mean_above_threshold,
      h.group_mean_above_threshold current_group_mean_above_threshold, {changes(PROFILE)} from tmp""",
    "apdex": BASE + APDEX + "select * exclude (first_observation, previous_observation, previous_measurement, series_baseline) from apd",
    "apdex_uncovered": BASE + APDEX + "select * exclude (first_observation, previous_observation, previous_measurement, series_baseline) from apd where t_us is null and count > 0",
    "apdex_calls": BASE + GOALS + """select call_id, signature, "user", measurement_id, duration_us, target_id, target_kind, target_class_id, overridden_class_id, t_us, target_status, latency_category, category, confirmed_failure, case when confirmed_failure then 'confirmed_failure' else 'unknown' end business_outcome, error_count linked_error_count from cl where t_us is not null""",
    "apdex_coverage": BASE + GOALS + f"""select measurement_id, {SCOPE}, count(*) total_call_count, count(t_us) covered_call_count, count(*) - count(t_us) uncovered_call_count, {PCT.format("count(t_us)", "count(*)")} covered_call_percent, count(distinct signature) observed_operation_count,
      count(distinct signature) filter (t_us is not null) covered_operation_count, count(distinct signature) - count(distinct signature) filter (t_us is not null) uncovered_operation_count, {PCT.format("count(distinct signature) filter (t_us is not null)", "count(distinct signature)")} covered_operation_percent,
      count(*) filter (target_status = 'business_approved') business_approved_call_count, count(distinct signature) filter (target_status = 'business_approved') business_approved_operation_count, count(*) filter (target_status = 'engineering_proposal') engineering_proposal_call_count,
      count(distinct signature) filter (target_status = 'engineering_proposal') engineering_proposal_operation_count, count(*) filter (confirmed_failure) confirmed_failure_count, count(*) filter (confirmed_failure and t_us is null) uncovered_confirmed_failure_count
      from cl group by grouping sets ((measurement_id), ())""",
    "apdex_overall": BASE + OVERALL + "select * from ov",
    "apdex_composition": BASE + OVERALL + f""", g as (select signature, "user", measurement_id, target_status, count(*) call_count, {SCORE_SQL} from cl where t_us is not null group by 1, 2, 3, 4),
      x as (select *, unnest(['measurement_all_users', 'selected_measurements_all_users']) population_scope from g)
      select x.population_scope, signature, "user", x.measurement_id, x.target_status, call_count, ov.apdex_denominator overall_apdex_denominator, {PCT.format("call_count", "ov.apdex_denominator")} call_weight_percent, x.satisfied_count, x.tolerating_count, x.frustrated_count,
      x.apdex operation_user_measurement_apdex, x.apdex_numerator_twice::double / (2 * ov.apdex_denominator) contribution_to_overall_apdex
      from x join ov on x.population_scope = ov.population_scope and x.target_status = ov.target_status and (ov.measurement_id = x.measurement_id or x.population_scope <> 'measurement_all_users')""",
    "apdex_changes": BASE + APDEX + pairs("apd", 'signature,"user"', BASES) + f""", tmp2 as (select h, r, reference_relation, comparison_state operation_comparison_state, coalesce(h.count > 0 and r.count > 0, false) both_, case when comparison_state = 'numerical_comparison' and not coalesce(h.target_id = r.target_id, false) then 'missing_target'
        when comparison_state = 'numerical_comparison' and h."user" in {UNKNOWN} then 'user_identity_unknown' else comparison_state end comparison_state from tmp)
      select {SIDES}, operation_comparison_state, comparison_state, reference_relation, case when both_ then coalesce(h.target_id = r.target_id, false) end target_match, case when both_ and h."user" not in {UNKNOWN} then true end user_match, coalesce(r.small_sample_warning, false) or h.small_sample_warning small_sample_warning, {changes(SCORES)} from tmp2""",
    "problem_history": PROBLEMS + "select * from ph",
    "problem_registry": PROBLEMS + "select * from pr",
    "problem_new": PROBLEMS + "select * from ph where measurement_order = first_position",
    "problem_persisting": PROBLEMS + "select * from pr where eligible and threshold_breached",
    "problem_unchecked": PROBLEMS + "select * from pr where historical_without_latest_check",
    "problem_improved": PROBLEMS + "select * from mv where direction = 'decreased'",
    "problem_worsened": PROBLEMS + "select * from mv where direction = 'increased'",
    "problem_rule_coverage": EVALUATED + """, rs as (select rule_id, measurement_id, reason, count(*) n from (select rule_id, measurement_id, unnest(reasons) reason from ev2) group by all)
      select e.rule_id, e.measurement_id, e.measurement_order, count(*) selected_cohort_count, count(*) filter (count > 0) observed_cohort_count, count(value) metric_available_cohort_count, count(*) filter (eligible) evaluable_cohort_count,
      count(*) filter (threshold_breached) raw_breach_cohort_count, count(*) filter (eligible and threshold_breached) evaluable_breach_cohort_count, count(*) filter (threshold_status = 'недостаточно данных') insufficient_cohort_count,
      count(*) filter (threshold_status = 'не наблюдалось') absent_cohort_count, cast(sum(count) as bigint) observed_call_count,
      coalesce((select string_agg(reason || '=' || n, ' | ' order by reason) from rs where rs.rule_id = e.rule_id and rs.measurement_id = e.measurement_id), '') insufficient_reasons from ev2 e group by 1, 2, 3""",
}
