"""DuckDB SQL for the queries, written on its own rather than derived from the plans."""

from __future__ import annotations

from sparktrace.functions.text import CATEGORIES, OTHER

BASE = r"""
with ev as (
  select event_id, case event_type when 'click' then case when event_id % 5 = 0 then 'SDBL' else 'DBPOSTGRS' end when 'error' then case when event_id % 4 = 0 then 'QERR' else 'EXCP' end
      when 'signup' then case event_id % 3 when 0 then 'TLOCK' when 1 then 'TTIMEOUT' else 'TDEADLOCK' end else 'CALL' end event_type,
    ts, epoch_us(ts) us, cast(round(value * 600000000) as bigint) duration_us, user_id, cast(regexp_extract(props, '"k":\s*(\d+)', 1) as int) k
  from events),
e as (
  select event_id, event_type, ts, k, duration_us,
    case when event_type <> 'CALL' and event_id % 97 = 0 then null else us end end_us,
    case when event_type <> 'CALL' and event_id % 97 = 0 then null else us - duration_us end start_us,
    case when user_id % 25 <> 0 then 'user' || user_id end usr_raw,
    case when user_id % 25 = 0 then '(not specified)' else 'user' || user_id end "user",
    'd' || (user_id % 2) dataset_id, 'rphost_' || (user_id % 4) process,
    case when event_type <> 'CALL' and event_id % 50 = 7 then '' else cast(user_id % 8 as varchar) end thread,
    case when k % 3 <> 0 then cast(k % 3 as varchar) end session, case when k % 4 <> 0 then cast(k % 4 as varchar) end connect_id,
    case when k % 6 = 0 then null when k % 7 = 0 then ' ' || chr(10) || chr(9) else '  op' || (k % 5) || chr(10) || ' line ' || (k % 3) end context,
    case when k % 6 = 0 or k % 7 = 0 then '' else 'op' || (k % 5) end context_root, 'op' || (k % 5) signature, 'm' || (1 + (day(ts) - 1) // 7) measurement_id,
    case k % 10 when 0 then null when 1 then '' when 2 then 'bad' when 3 then '99999999999999999999' else cast(k * 100000 as varchar) end cpu_us_raw,
    case when k % 10 > 3 then k * 100000 end cpu_us, case when k % 11 <> 0 then (k - 20) * 512 end memory, case when k % 6 <> 0 then (k - 50) * 1024 end memory_peak,
    case when k % 9 <> 0 then k * 10 end in_bytes, case when k % 8 <> 0 then k * 131072 end out_bytes, k rows_affected,
    case when event_type <> 'DBPOSTGRS' then null else case k % 6 when 0 then 'SELECT a FROM t' || (k % 7) || ' WHERE id = ' || k
      when 1 then 'select x.b, count(*) from "T One" x left join t' || (k % 7) || ' y on x.id = y.id where y.n = ''v' || k || ''' group by 1 order by 2 desc limit 5'
      when 2 then 'WITH w AS (SELECT DISTINCT c FROM pg_temp.tt' || (k % 3) || ') SELECT CASE WHEN c > ' || k || '.5 THEN 1 ELSE 2 END FROM w UNION ALL SELECT cast(3 as numeric(10, 2))'
      when 3 then 'SELECT ''unterminated ' || (k % 4) when 5 then '/* c */ SELECT TOP 3 a FROM s.t' || (k % 7) || ', t_b -- note' end end sql_text,
    case when event_type <> 'DBPOSTGRS' then null else case k % 6 when 0 then 'select a from t' || (k % 7) || ' where id = <number>'
      when 1 then 'select x . b , count ( * ) from "T One" x left join t' || (k % 7) || ' y on x . id = y . id where y . n = <string> group by 1 order by 2 desc limit <number>'
      when 2 then 'with w as ( select distinct c from <temp:1> ) select case when c > <number> then <number> else <number> end from w union all select cast ( <number> as numeric ( 10 , 2 ) )'
      when 3 then '<raw-sql> "SELECT ''unterminated ' || (k % 4) || '"' when 5 then 'select top <number> a from s . t' || (k % 7) || ' , t_b' end end sql_pattern,
    case k % 6 when 0 then ['t' || (k % 7)] when 1 then ['"T One"', 't' || (k % 7)] when 2 then ['pg_temp.tt' || (k % 3)] when 5 then ['s.t' || (k % 7), 't_b'] else cast([] as varchar[]) end sql_tables,
    case when event_type not in ('EXCP', 'QERR') then null else case k % 8 when 0 then null when 1 then ' ' || chr(10) when 2 then 'Ошибка выполнения запроса:' || chr(13) || chr(10) || chr(10) || 'ERROR: canceling statement due to user request ' || k
      when 3 then 'HTTP request 3f2504e0-4f89-11d3-9a0c-0305e82c3301 failed with ' || k when 4 then 'permission denied for relation t' || (k % 5) else 'Lock 2024-01-0' || (1 + k % 9) || ' on ' || k || ' of table ' || (k % 5) end end message,
    case when event_type in ('EXCP', 'QERR') then case when k % 8 < 2 then '' when k % 8 = 2 then 'Ошибка выполнения запроса: ERROR: canceling statement due to user request ' || num when k % 8 = 3 then 'HTTP request <uuid> failed with ' || num
      when k % 8 = 4 then 'permission denied for relation t' || (k % 5) else 'Lock <date> on ' || num || ' of table ' || (k % 5) end end error_signature,
    case k % 8 when 0 then 'missing' when 1 then 'empty' else 'present' end message_state,
    case k % 8 when 2 then 'statement_cancelled' when 3 then 'external_resource' when 4 then 'permission_denied' else 'other_application_or_platform_error' end err_category
  from (select *, case when k > 9 then '#' else cast(k as varchar) end num from ev)),
c as (select * from e where event_type = 'CALL'),
o as (select * from e where event_type <> 'CALL'),
cand as (
  select o.event_id, c.event_id call_id, coalesce(o.session, '') <> '' and o.session is not distinct from c.session session_match, c.duration_us call_duration,
    o.start_us event_start, o.end_us event_end, c.start_us call_start, c.end_us call_end, o.session event_session, c.session call_session, o.connect_id event_connect, c.connect_id call_connect
  from o join c on o.dataset_id = c.dataset_id and o."user" = c."user" and o.process = c.process and o.thread = c.thread
    and o.thread <> '' and o.end_us between c.start_us and c.end_us),
best as (
  select event_id, count(*) candidate_count, count(*) filter (session_match) session_match_count,
    first(call_id order by (case when session_match then 0 else 1 end), call_duration desc, call_id) parent_call_id from cand group by event_id),
d0 as (
  select o.*, coalesce(candidate_count, 0) candidate_count, coalesce(session_match_count, 0) session_match_count, parent_call_id,
    case when coalesce(session_match_count, 0) > 0 then session_match_count else coalesce(candidate_count, 0) end eligible_count,
    coalesce(session_match_count, 0) = 0 or usr_raw is null fallback
  from o left join best using (event_id)),
dec as (
  select *, case when candidate_count = 0 then 'unlinked' when eligible_count > 1 then 'ambiguous' when fallback then 'linked_by_rule' else 'linked_unique' end status,
    case when end_us is null then 'missing_timestamp' when thread = '' then 'missing_thread' when candidate_count = 0 then 'no_containing_call'
      when eligible_count > 1 then 'multiple_candidates_legacy_longest' when fallback and session_match_count > 0 then 'missing_user_or_process'
      when fallback and session is null then 'missing_session' when fallback then 'session_no_match' else 'same_session_unique' end reason_code
  from d0),
roll as (
  select parent_call_id call_id, count(*) filter (event_type = 'DBPOSTGRS') db_count, coalesce(sum(duration_us) filter (event_type = 'DBPOSTGRS'), 0) db_duration_us, count(*) filter (event_type = 'SDBL') sdbl_count,
    count(*) filter (event_type like 'T%') lock_count, coalesce(sum(duration_us) filter (event_type like 'T%'), 0) lock_duration_us, count(*) filter (event_type in ('EXCP', 'QERR')) error_count,
    max(duration_us) filter (event_type = 'DBPOSTGRS') max_db_us, count(*) filter (event_type = 'DBPOSTGRS') db_rows_available_count, cast(sum(rows_affected) filter (event_type = 'DBPOSTGRS') as bigint) db_rows_known, cast(max(rows_affected) filter (event_type = 'DBPOSTGRS') as bigint) db_rows_max
  from dec where parent_call_id is not null group by 1),
obs as (
  select c.event_id call_id, c.* exclude (event_id), coalesce(db_count, 0) db_count, cast(coalesce(db_duration_us, 0) as bigint) db_duration_us, coalesce(lock_count, 0) lock_count, coalesce(sdbl_count, 0) sdbl_count,
    cast(coalesce(lock_duration_us, 0) as bigint) lock_duration_us, coalesce(error_count, 0) error_count, max_db_us, coalesce(db_rows_available_count, 0) db_rows_available_count, db_rows_known, db_rows_max
  from c left join roll on c.event_id = roll.call_id),
err as (
  select dec.*, case when dec.connect_id is null and c.connect_id is null then 'both_missing' when dec.connect_id is null then 'event_missing' when c.connect_id is null then 'call_missing'
      when dec.connect_id = c.connect_id then 'match' else 'conflict' end connect_relation
  from dec left join c on dec.parent_call_id = c.event_id where dec.event_type in ('EXCP', 'QERR')),
err2 as (
  select *, case when status <> 'linked_unique' then 'singleton_' || status when usr_raw is null or thread = '' or session is null or context_root = '' then 'singleton_missing_identity_or_context'
      when message_state <> 'present' then 'singleton_missing_payload'
      when connect_relation = 'conflict' then 'singleton_connect_conflict' else 'same_call_exact_payload' end incident_reason from err),
inc as (
  select *, sha256('["error-signature/v2","full_message/v2","' || message_state || '","' || error_signature || '"]') signature_id,
    sha256('["suspected-incident/v1","same_call_exact_payload/v1",' || case when incident_reason = 'same_call_exact_payload' then '{"call_event_id":"' || parent_call_id || '","connect_id":' || coalesce('"' || connect_id || '"', 'null') || ',"dataset_id":"' || dataset_id
      || '","exact_payload_sha256":"' || sha256('["error-payload/v1","' || payload || '"]') || '","full_context_sha256":"' || sha256('["error-context/v1","' || replace(context, chr(10), '\n') || '"]')
      || '","process":"' || process || '","session":"' || session || '","thread":"' || thread || '","user":"' || "user" || '"}' else '{"singleton_event_id":"' || event_id || '"}' end || ']') incident_id
  from (select *, case k % 8 when 0 then '' when 1 then '' when 2 then 'ERROR: canceling statement due to user request ' || k else message end payload from err2))
"""

GROUP = """count(*) count, cast(sum(duration_us) as bigint) duration_us, round(avg(duration_us), 3) avg_us, round(median(duration_us), 3) median_us,
  quantile_disc(duration_us, 0.95) p95_us, quantile_disc(duration_us, 0.99) p99_us, max(duration_us) max_us,
  count(*) filter (duration_us >= 1000000) over_1s, count(*) filter (duration_us >= 5000000) over_5s, count(*) filter (duration_us >= 10000000) over_10s, count(*) filter (duration_us >= 30000000) over_30s"""

CPU = """count(cpu_us) cpu_available_count, cast(coalesce(sum(duration_us) filter (cpu_us is not null), 0) as bigint) cpu_wall_us, 100.0::double * count(cpu_us) / count(*) cpu_coverage_percent,
  100.0::double * coalesce(sum(duration_us) filter (cpu_us is not null), 0) / nullif(sum(duration_us), 0) cpu_wall_coverage_percent, 100.0::double * sum(cpu_us) / nullif(sum(duration_us) filter (cpu_us is not null), 0) cpu_percent_of_wall,
  cast(greatest(sum(duration_us - cpu_us - db_duration_us), 0) as bigint) * case when count(cpu_us) > 0 then 1 end unattributed_us_floor,
  100.0::double * case when count(cpu_us) > 0 then greatest(sum(duration_us - cpu_us - db_duration_us), 0) end / nullif(sum(duration_us) filter (cpu_us is not null), 0) unattributed_percent_floor,
  cast(case when count(cpu_us) > 0 then greatest(sum(db_duration_us + cpu_us - duration_us), 0) end as bigint) attribution_overflow_us"""

KINDS = {"db": "event_type = 'DBPOSTGRS'", "sdbl": "event_type = 'SDBL'", "lock": "event_type like 'T%'", "error": "event_type in ('EXCP', 'QERR')"}
LIST = "coalesce(string_agg(distinct {0}, ' | ' order by {0}), '')"

STATES = """states as (
  select event_id, measurement_id, 'cpu_us' field, case k % 10 when 0 then 'missing' when 1 then 'empty' when 2 then 'invalid' when 3 then 'out_of_range' else 'valid' end state, cast(cpu_us as bigint) as value from c
  union all select event_id, measurement_id, 'memory', case when k % 11 = 0 then 'empty' else 'valid' end, memory from c
  union all select event_id, measurement_id, 'memory_peak', case when k % 6 = 0 then 'missing' else 'valid' end, memory_peak from c
  union all select event_id, measurement_id, 'in_bytes', case when k % 9 = 0 then 'out_of_range' else 'valid' end, in_bytes from c
  union all select event_id, measurement_id, 'out_bytes', case when k % 8 = 0 then 'missing' else 'valid' end, out_bytes from c
  union all select event_id, measurement_id, 'rows_affected', 'valid', rows_affected from c)"""

def ops(name: str = "ops", more: str = "") -> str:
    """CTE of operations, with further grouping columns on request."""
    return f"""{name} as (
  select * replace (round(cpu_percent_of_wall, 4) as cpu_percent_of_wall, round(unattributed_percent_floor, 6) as unattributed_percent_floor) from (
  select measurement_id, "user", signature, {more} {GROUP}, min(duration_us) min_us, min(end_us) first_us, max(end_us) last_us, coalesce(round(stddev_pop(duration_us) / nullif(avg(duration_us), 0), 6), 0.0) cv, {CPU},
    cast(sum(cpu_us) as bigint) cpu_us, cast(sum(memory) as bigint) memory, round(avg(memory), 3) memory_per_call, cast(max(memory) as bigint) memory_max, round(avg(memory_peak), 3) memory_peak_avg, median(memory_peak) memory_peak_median,
    cast(quantile_disc(memory_peak, 0.95) as bigint) memory_peak_p95, cast(quantile_disc(memory_peak, 0.99) as bigint) memory_peak_p99, cast(max(memory_peak) as bigint) memory_peak_max,
    cast(sum(out_bytes) as bigint) out_bytes, round(avg(out_bytes), 3) out_bytes_per_call, cast(max(out_bytes) as bigint) max_out_bytes, cast(sum(in_bytes) as bigint) in_bytes, round(avg(in_bytes), 3) in_bytes_per_call,
    cast(sum(rows_affected) as bigint) call_rows_affected, cast(sum(db_rows_known) as bigint) rows_affected,
    cast(sum(db_count) as bigint) db_count, cast(sum(db_duration_us) as bigint) db_duration_us, cast(max(db_count) as bigint) max_db_per_call, cast(sum(sdbl_count) as bigint) sdbl_count,
    cast(sum(lock_count) as bigint) lock_count, cast(sum(lock_duration_us) as bigint) lock_duration_us, cast(sum(error_count) as bigint) error_count,
    coalesce(trim(regexp_replace(arg_min(coalesce(context, ''), call_id), '\\s+', ' ', 'g')), '') context_sample, {LIST.format("dataset_id")} dataset_ids, round(sum(db_count)::double / count(*), 6) db_per_call, round(sum(db_duration_us)::double / count(*) / 1000000, 6) db_seconds_per_call
  from obs group by {more} measurement_id, "user", signature))"""


OPS = ops()

CHAIN = ("count", "avg_us", "median_us", "p95_us", "max_us", "db_per_call", "db_seconds_per_call", "cpu_percent_of_wall", "out_bytes_per_call")
FLAGS = ", ".join(f"case when shape = 3 then null else {on} end has_{name}" for name, on in {
    "join": "shape = 1", "case": "shape = 2", "distinct": "shape = 2", "order_by": "shape = 1", "group_by": "shape = 1", "union": "shape = 2", "temp_table": "shape = 2", "limit_or_top": "shape in (1, 5)"}.items())

ORACLE = {
    "counter_states": BASE + f", {STATES} select * from states",
    "counter_quality": BASE + f""", {STATES} select measurement_id, field, count(*) eligible_count, count(value) available_count, count(*) filter (state = 'missing') missing_count,
      count(*) filter (state = 'empty') empty_count, count(*) filter (state = 'invalid') invalid_count, count(*) filter (state = 'out_of_range') out_of_range_count, count(*) filter (value = 0) zero_count,
      cast(sum(value) as bigint) sum_known, case when count(value) = count(*) then cast(sum(value) as bigint) end sum_complete, sum(value)::double / nullif(count(value), 0) mean, max(value) max_known,
      100.0::double * count(value) / count(*) coverage_percent from states group by 1, 2""",
    "order_statistics": BASE + f"select measurement_id, signature, {GROUP}, min(duration_us) min_us, round(stddev_pop(duration_us) / nullif(avg(duration_us), 0), 6) cv from c group by 1, 2",
    "threshold_counts": BASE + f"select measurement_id, event_type, count, over_1s, over_5s, over_10s, over_30s from (select measurement_id, event_type, {GROUP} from e group by 1, 2)",
    "cpu_population": BASE + f"select measurement_id, {CPU} from obs group by 1",
    "interval_candidates": BASE + "select event_id, call_id, session_match from cand",
    "link_decision": BASE + "select event_id, parent_call_id, status, reason_code, candidate_count, eligible_count, session_match_count, candidate_count > 0 and fallback fallback_applied from dec",
    "candidate_evidence": BASE + """, rel as (select cand.*, b.parent_call_id, b.session_match_count from cand join best b using (event_id))
      select event_id, call_id, case when event_session is null and call_session is null then 'both_missing' when event_session is null then 'event_missing' when call_session is null then 'call_missing' when event_session = call_session then 'match' else 'conflict' end session_relation,
      case when event_connect is null and call_connect is null then 'both_missing' when event_connect is null then 'event_missing' when call_connect is null then 'call_missing' when event_connect = call_connect then 'match' else 'conflict' end connect_relation,
      call_start <= event_start and event_start <= event_end and event_end <= call_end full_interval_contained, session_match_count = 0 or session_match eligible, call_id = parent_call_id selected,
      case when call_id = parent_call_id then 'selected_legacy_rule' when session_match_count > 0 and not session_match then 'excluded_by_session_preference' else 'not_selected_duration_or_legacy_order' end reason_code from rel""",
    "linkage_summary": BASE + """, s as (select dataset_id, measurement_id, """ + ", ".join(
        f"""count(*) filter ({t}) {n}_total, count(*) filter ({t} and parent_call_id is not null) {n}_linked,
        round(100.0::double * count(*) filter ({t} and parent_call_id is not null) / nullif(count(*) filter ({t}), 0), 6) {n}_linked_percent""" for n, t in KINDS.items()) + """,
        cast(coalesce(sum(duration_us) filter (event_type = 'DBPOSTGRS'), 0) as bigint) db_duration_us, cast(coalesce(sum(duration_us) filter (event_type = 'DBPOSTGRS' and parent_call_id is not null), 0) as bigint) db_linked_duration_us,
        round(100.0::double * coalesce(sum(duration_us) filter (event_type = 'DBPOSTGRS' and parent_call_id is not null), 0) / nullif(sum(duration_us) filter (event_type = 'DBPOSTGRS'), 0), 6) db_linked_duration_percent,
        count(*) filter (reason_code = 'missing_timestamp') unlinked_missing_timestamp, count(*) filter (reason_code = 'missing_thread') unlinked_missing_thread, count(*) filter (reason_code = 'no_containing_call') unlinked_no_containing_call,
        count(*) filter (event_type = 'CALL') call_count, count(*) filter (event_type = 'CALL' and end_us is null) calls_without_absolute_time
      from (select event_type, dataset_id, measurement_id, parent_call_id, duration_us, reason_code, end_us from dec union all select event_type, dataset_id, measurement_id, null, duration_us, null, end_us from c) group by 1, 2)
      select * from s""",
    "call_rollup": BASE + """select call_id, measurement_id, "user", signature, duration_us, cast(cpu_us as bigint) cpu_us, cast(out_bytes as bigint) out_bytes, db_count, db_duration_us, sdbl_count, lock_count, lock_duration_us, error_count, db_rows_available_count, max_db_us, db_rows_known, db_rows_max from obs""",
    "operations": BASE + f", {OPS} select * from ops",
    "operations_by_dataset": BASE + f", {ops(more='dataset_id,')} select * from ops",
    "operation_counters": BASE + f""", {STATES} select measurement_id, "user", signature, field, count(*) eligible_count, count(value) available_count, count(*) filter (state = 'missing') missing_count,
      count(*) filter (state = 'empty') empty_count, count(*) filter (state = 'invalid') invalid_count, count(*) filter (state = 'out_of_range') out_of_range_count, count(*) filter (value = 0) zero_count,
      cast(sum(value) as bigint) sum_known, case when count(value) = count(*) then cast(sum(value) as bigint) end sum_complete, sum(value)::double / nullif(count(value), 0) mean, max(value) max_known,
      100.0::double * count(value) / count(*) coverage_percent from states join (select event_id, "user", signature from c) using (event_id) group by 1, 2, 3, 4""",
    "order_statistics_spread": f"select l_returnflag, l_linestatus, {GROUP} from (select l_returnflag, l_linestatus, cast(round(l_extendedprice * 100) as bigint) duration_us from lineitem) group by 1, 2",
    "operation_severity": BASE + f""", {OPS} select measurement_id, "user", signature, case when (count >= 2 and p95_us >= 30000000) or over_30s >= 2 or max_us >= 120000000 or (db_per_call >= 1000 and p95_us >= 10000000) then 'P0'
      when max_us >= 30000000 or p95_us >= 5000000 or duration_us >= 30000000 or db_per_call >= 500 or coalesce(max_out_bytes, 0) >= 10485760 then 'P1' else 'P2' end priority from ops""",
    "top_nested": BASE + """, g as (select obs.measurement_id, obs."user", obs.signature, dec.sql_pattern, count(*) count, cast(sum(dec.duration_us) as bigint) sum_us, max(dec.duration_us) max_us
      from dec join obs on dec.parent_call_id = obs.call_id where dec.event_type = 'DBPOSTGRS' and dec.sql_pattern is not null group by all)
      select * from (select *, row_number() over (partition by measurement_id, "user", signature order by sum_us desc, max_us desc, sql_pattern desc) rank from g) where rank <= 10""",
    "top_calls": BASE + """select call_id, measurement_id, "user", signature, duration_us, db_count, error_count from obs order by duration_us desc, call_id desc limit 200""",
    "dataset_stats": BASE + f"""select dataset_id, count(*) records, min(end_us) first_us, max(end_us) last_us, count(distinct "user") users, count(distinct session) sessions, count(distinct connect_id) connect_ids,
      count(distinct process) processes, {LIST.format("measurement_id")} measurements, {LIST.format("strftime(case when end_us is not null then ts end, '%Y-%m-%d')")} dates, count(*) filter (end_us is not null and hour(ts) between 8 and 19) day_events, count(*) filter (end_us is not null and hour(ts) not between 8 and 19) night_events,
      count(*) filter (end_us is null) events_without_time, count(*) filter ("user" = '(not specified)') background_events, count(distinct case when end_us is not null then end_us // 60000000 end) active_minutes,
      round(count(*) filter (event_type = 'DBPOSTGRS')::double / count(distinct case when end_us is not null then end_us // 60000000 end), 6) db_per_active_minute from e group by 1""",
    "busiest_minute": BASE + """, g as (select dataset_id, end_us // 60000000 m, count(*) n from e where event_type = 'DBPOSTGRS' and end_us is not null group by 1, 2)
      select dataset_id, m busiest_minute, n busiest_count from g qualify row_number() over (partition by dataset_id order by n desc, m) = 1""",
    "event_stats": BASE + f"select dataset_id, event_type, {GROUP} from e group by 1, 2",
    "top_signatures": BASE + "select dataset_id, signature, count(*) count, row_number() over (partition by dataset_id order by count(*) desc, signature desc) rank from c group by 1, 2 qualify rank <= 20",
    "sql_group_stats": BASE + f""", db as (select * from dec where event_type = 'DBPOSTGRS' and sql_pattern is not null), g as (select measurement_id, sql_pattern, {GROUP}, count(*) filter (duration_us between 500000 and 2000000) count_0_5_to_2s,
        count(parent_call_id) linked_count, {LIST.format('"user"')} users, arg_min(sql_text, event_id) sample_sql, min(end_us) first_us, max(end_us) last_us, cast(sum(rows_affected) as bigint) rows_affected, cast(max(rows_affected) as bigint) max_rows_affected, avg(rows_affected) rows_affected_per_event,
        any_value(k % 6) shape, case when any_value(k % 6) <> 3 then 'normalized' else 'raw_fallback' end sql_normalization_status, sha256('1c-tj-sql' || chr(0) || '2.0' || chr(0) || sql_pattern) sql_fingerprint_sha256 from db group by 1, 2),
      f as (select measurement_id, sql_pattern, context_root, min(event_id) met from db where context_root <> '' group by all), f2 as (select *, row_number() over (partition by measurement_id, sql_pattern order by met, context_root) n from f),
      x as (select measurement_id, sql_pattern, string_agg(context_root, ' | ' order by context_root) contexts from f2 where n <= 30 group by 1, 2),
      ut as (select distinct measurement_id, sql_pattern, unnest(sql_tables) t from db), y as (select measurement_id, sql_pattern, string_agg(t, ' | ' order by t) tables from ut group by 1, 2),
      s as (select sql_pattern, {LIST.format("measurement_id")} measurements_all, count(distinct measurement_id) measurement_count from db group by 1)
      select g.* exclude (shape), coalesce(contexts, '') contexts, coalesce(tables, '') tables, measurements_all, measurement_count, {FLAGS} from g left join x using (measurement_id, sql_pattern) left join y using (measurement_id, sql_pattern) join s using (sql_pattern)""",
    "lock_groups": BASE + f"""select measurement_id, event_type, case when context_root = '' then '(context unavailable)' else context_root end context, {GROUP}, {LIST.format('"user"')} users, count(parent_call_id) linked_call_count from dec where event_type like 'T%' group by 1, 2, 3""",
    "error_observations": BASE + """select event_id, status, error_signature, err_category category, message_state, payload, incident_reason, incident_id, signature_id, connect_relation from inc""",
    "error_groups": BASE + f""", g as (select measurement_id, event_type, signature_id, any_value(error_signature) error_signature, count(*) event_count, count(parent_call_id) linked_error_event_count, count(*) - count(parent_call_id) unlinked_error_event_count,
      count(distinct parent_call_id) affected_call_count, count(distinct incident_id) suspected_incident_count, min(event_id) representative, min(end_us) first_us, max(end_us) last_us, any_value(err_category) category,
      trim(regexp_replace(arg_min(coalesce(message, ''), event_id), '\\s+', ' ', 'g')) sample, {LIST.format('"user"')} users, array_to_string(list_sort(list_slice(list_sort(list(distinct context) filter (context is not null)), 1, 30)), ' | ') contexts from inc group by 1, 2, 3)
      select * replace (coalesce(contexts, '') as contexts) from g""",
    "error_summary": BASE + """select count(*) event_count, count(parent_call_id) linked_error_event_count, count(*) - count(parent_call_id) unlinked_error_event_count, count(distinct signature_id) signature_count, count(distinct incident_id) suspected_incident_count,
      count(distinct parent_call_id) affected_call_count, count(*) filter (incident_reason = 'same_call_exact_payload') grouped_count, count(*) filter (status = 'ambiguous') ambiguous_linked_error_event_count, count(*) filter (status = 'linked_by_rule') fallback_linked_error_event_count from inc""",
    "error_incidents": BASE + """select incident_id, min(event_id) representative, count(*) event_count, count(distinct parent_call_id) affected_call_count, min(end_us) first_us, max(end_us) last_us, min(incident_reason) reason_code from inc group by incident_id""",
    "error_normalize": r"""with a as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) x from documents),
      b as (select doc_id, regexp_replace(x, '\b[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b', '<uuid>', 'g') x from a),
      c as (select doc_id, regexp_replace(x, '\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\b', '<date>', 'g') x from b),
      d as (select doc_id, regexp_replace(x, '\b\d{2,}\b', '#', 'g') x from c) select doc_id, sha256(x) signature_sha256, length(x) n_chars from d""",
    "error_classify": """with t as (select lower(substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 6000)) x from documents)
      select case """ + " ".join("when " + " or ".join(f"contains(x, '{m}')" for m in markers) + f" then '{category}'" for category, markers in CATEGORIES.items()) + f""" else '{OTHER}' end category, count(*) documents from t group by 1""",
    "text_clean": r"""with t as (select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) x, trim(regexp_replace(regexp_extract(coalesce(text, ''), '([^\n]*\S[^\n]*)', 1), '\s+', ' ', 'g')) r from conversations)
      select conv_id, turn, case when length(x) > 80 then substr(x, 1, 77) || '...' else x end cleaned, case when length(r) > 900 then substr(r, 1, 897) || '...' else r end root from t""",
    "membership": BASE + "select distinct measurement_id, dataset_id from e where event_type in ('CALL', 'DBPOSTGRS', 'EXCP', 'QERR')",
    "identical_operations": BASE + f""", {OPS}, w as (select *, row_number() over a comparison_order, lag(measurement_id) over a previous_measurement_id, lag(first_us) over a previous_first_us, count(*) over (partition by signature, "user") own, """ + ", ".join(f"lag({c}) over a {c}_was" for c in CHAIN) + """
        from ops window a as (partition by signature, "user" order by coalesce(first_us, 9223372036854775807), measurement_id))
      select signature, "user", measurement_id, comparison_order, case when own >= 2 then 'same_signature_same_user' else 'same_signature_different_user_only' end comparison_scope, case when own >= 2 then 'B' else 'C' end comparability_level,
        dataset_ids, first_us, last_us, previous_measurement_id, previous_first_us, """ + ", ".join(
        f"{c}, ({c} - {c}_was)::double {c}_delta, round(100.0::double * ({c} - {c}_was) / nullif({c}_was, 0), 6) {c}_delta_percent" for c in CHAIN) + """
      from w where signature in (select signature from ops group by 1 having count(distinct measurement_id) >= 2)""",
    "call_sequence": BASE + "select event_id, dataset_id, process, row_number() over (order by dataset_id, process, event_id) legacy_call_id from c",
    "canonical_ids": """select o_orderkey, sha256('["event/v1","' || o_orderpriority || '","' || o_orderkey || '"]') event_id from orders""",
    "sql_fingerprints": BASE + "select sha256('1c-tj-sql' || chr(0) || '2.0' || chr(0) || sql_pattern) sql_fingerprint_sha256, count(*) count, min(sql_pattern) sql_pattern from dec where event_type = 'DBPOSTGRS' and sql_pattern is not null group by 1",
    "source_dedup": "select doc_id, source, case when row_number() over (partition by source, coalesce(text, '') order by doc_id) = 1 then 'valid' else 'skipped_duplicate' end status from documents",
}

#: The same events as logs tell them: the folder is the data set, and capture and day are the measurement.
_LOGS = {
    "'d' || (user_id % 2) dataset_id": "'cap' || (user_id % 2) || '/d' || (user_id % 2) || '/rphost_' || (user_id % 4) dataset_id, 'cap' || (user_id % 2) capture_id",
    "'m' || (1 + (day(ts) - 1) // 7) measurement_id": "'cap' || (user_id % 2) || '@' || coalesce(strftime(case when event_type = 'CALL' or event_id % 97 <> 0 then ts end, '%Y-%m-%d'), 'unknown-date') measurement_id",
}
LOG_BASE = BASE
for _old, _new in _LOGS.items():
    assert _old in LOG_BASE
    LOG_BASE = LOG_BASE.replace(_old, _new)


def on_logs(name: str, *without: str) -> str:
    sql = ORACLE[name].replace(BASE, LOG_BASE)
    return f"select * exclude ({', '.join(without)}) from ({sql})" if without else sql


_SOURCE = "dataset_id || '/' || case when end_us is null then 'undated' else strftime(ts, '%y%m%d%H') end || '.log'"
ORACLE |= {
    "log_files": LOG_BASE + f""", f as (select {_SOURCE} logical, dataset_id, capture_id, process, count(*) records, min(end_us) first from e group by all)
      select logical, 'file' kind, dataset_id, capture_id, process, case when first is null then 'valid_no_timestamp' else 'valid' end status, '' reason, 'inferred_relative_path' identity_status, records, 0 parse_errors, records last_ordinal from f
      union all select * from (values ('cap9/rphost_9/24010100.log', 'file', 'cap9/rphost_9', 'cap9', 'rphost_9', 'skipped', 'empty_or_bom_only', 'inferred_relative_path', 0, 0, null),
        ('cap9/rphost_9/24010101.log', 'file', 'cap9/rphost_9', 'cap9', 'rphost_9', 'skipped', 'no_record_head', 'inferred_relative_path', 0, 0, null),
        ('cap9/rphost_9/24010102.log', 'file', 'cap9/rphost_9', 'cap9', 'rphost_9', 'partial_nul_salvaged', 'nul_bytes', 'inferred_relative_path', 1, 0, 1))""",
    "log_events": LOG_BASE + f"""select event_id, {_SOURCE} source, event_type, end_us, duration_us, start_us, usr_raw, "user", dataset_id, capture_id, process, thread, session, connect_id, measurement_id, context, cpu_us_raw,
      case when k % 11 = 0 then ' ' else cast((k - 20) * 512 as varchar) end memory_raw, cast(memory_peak as varchar) memory_peak_raw, case when k % 9 = 0 then '-5' else cast(k * 10 as varchar) end in_bytes_raw,
      cast(out_bytes as varchar) out_bytes_raw, '+' || k rows_affected_raw, sql_text, message from e""",
    "log_links": on_logs("link_decision"),
    "log_operations": LOG_BASE + f""", {ops()}, pr as (select *, case when (count >= 2 and p95_us >= 30000000) or over_30s >= 2 or max_us >= 120000000 or (db_per_call >= 1000 and p95_us >= 10000000) then 'P0'
      when max_us >= 30000000 or p95_us >= 5000000 or duration_us >= 30000000 or db_per_call >= 500 or coalesce(max_out_bytes, 0) >= 10485760 then 'P1' else 'P2' end priority from ops) select * exclude (context_sample) from pr""",
    "log_linkage": on_logs("linkage_summary"),
    "log_locks": on_logs("lock_groups"),
    "log_sql_groups": on_logs("sql_group_stats", "sample_sql"),
    "log_errors": on_logs("error_groups", "representative", "sample"),
}
