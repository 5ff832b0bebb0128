"""Grouped tables over calls and the events that they own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrace.functions import counters, text
from sparktrace.plans.adapters import COUNTERS

SECOND = 1_000_000
DB, SDBL, LOCKS, ERRORS = ("DBPOSTGRS",), ("SDBL",), ("TLOCK", "TTIMEOUT", "TDEADLOCK"), ("EXCP", "QERR")
OPERATION = ["measurement_id", "user", "signature"]


def rank_percentile(column: str, p: float) -> Column:
    """Nearest-rank percentile, exact."""
    return F.expr(f"cast(percentile_disc({p}) within group (order by {column}) as bigint)")


def metric_group(column: str = "duration_us") -> list[Column]:
    """Count, sum, mean, order statistics and counts at or over 1, 5, 10 and 30 seconds."""
    return [
        F.count("*").alias("count"), F.sum(column).alias("duration_us"), F.round(F.avg(column), 3).alias("avg_us"), F.round(F.median(column), 3).alias("median_us"),
        rank_percentile(column, 0.95).alias("p95_us"), rank_percentile(column, 0.99).alias("p99_us"), F.max(column).alias("max_us"), *over(column),
    ]


def over(column: str = "duration_us") -> list[Column]:
    return [F.count_if(F.col(column) >= s * SECOND).alias(f"over_{s}s") for s in (1, 5, 10, 30)]


def spread_group(rows: DataFrame, keys: list[str], column: str = "duration_us") -> DataFrame:
    """metric_group for few groups of very many rows: no task holds a group's values.

    Rows of equal value are counted first, counts are summed per band of values (64 a power of
    two), and only the bands that hold the ranks asked for are looked into value by value.
    """
    counts = rows.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    band = F.when(F.col("v") > 0, F.floor(F.log2(F.col("v").cast("double")) * 64)).otherwise(F.when(F.col("v") <= 0, -1 - F.floor(F.log2(1 - F.col("v").cast("double")) * 64)))
    counts = counts.withColumn("band", band.cast("bigint"))
    known = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    bands = counts.groupBy(*keys, "band").agg(F.sum(known).alias("band_n"))
    order = Window.partitionBy(*keys).orderBy("band")  # as many rows as bands, 10,000 at most
    total = F.sum("band_n").over(Window.partitionBy(*keys))
    bands = bands.withColumns({"upto": F.sum("band_n").over(order), "all": total}).withColumn("below", F.col("upto") - F.col("band_n"))
    ranks = {"low": "(all + 1) div 2", "high": "all div 2 + 1", "p95_us": "(95 * all + 99) div 100", "p99_us": "(99 * all + 99) div 100"}
    asked = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(r).alias("at")) for n, r in ranks.items()])
    here = bands.select(*keys, "band", "below", "upto", F.inline(asked)).where("at > below and at <= upto")
    inside = counts.where("v is not null").join(here.select(*keys, "band", "below").distinct(), [*keys, "band"])
    run = Window.partitionBy(*keys, "band").orderBy("v")
    inside = inside.withColumn("v_upto", F.col("below") + F.sum("n").over(run)).withColumn("v_below", F.col("v_upto") - F.col("n"))
    found = inside.join(here.select(*keys, "band", "name", "at"), [*keys, "band"]).where("at > v_below and at <= v_upto")
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ranks])
    sums = [F.sum("n").alias("count"), F.sum(F.col("v") * F.col("n")).alias("duration_us"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum(known), 3).alias("avg_us"), F.max("v").alias("max_us")]
    sums += [F.sum(F.when(F.col("v") >= s * SECOND, F.col("n")).otherwise(0)).alias(f"over_{s}s") for s in (1, 5, 10, 30)]
    whole = counts.groupBy(*keys).agg(*sums).join(found, keys, "left")
    names = ["count", "duration_us", "avg_us", F.round((F.col("low") + F.col("high")) / 2, 3).alias("median_us"), "p95_us", "p99_us", "max_us", *[f"over_{s}s" for s in (1, 5, 10, 30)]]
    return whole.select(*keys, *names)


def joined(column: str) -> Column:
    """Distinct values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), " | ")


def first_met(rows: DataFrame, keys: list[str], column: str, order: Column, limit: int) -> DataFrame:
    """The limit values of a column that come first in each group, sorted and joined: no set of all values is ever held."""
    met = rows.where(F.coalesce(column, F.lit("")) != "").groupBy(*keys, column).agg(F.min(order).alias("met"))
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("met", column))).where(F.col("nth") <= limit)
    return first.groupBy(*keys).agg(joined(column).alias(f"{column}_list"))


def rollup(linked: DataFrame) -> DataFrame:
    """Per owning call: what it owns of each family."""
    of = lambda kinds: F.col("event_type").isin(*kinds)
    us = lambda kinds: F.sum(F.when(of(kinds), F.col("duration_us")).otherwise(0))
    rows = F.when(of(DB), counters.value("rows_affected_raw", 0))
    return linked.where("parent_call_id is not null").groupBy(F.col("parent_call_id").alias("call_id")).agg(
        F.count_if(of(DB)).alias("db_count"), us(DB).alias("db_duration_us"), F.count_if(of(SDBL)).alias("sdbl_count"),
        F.count_if(of(LOCKS)).alias("lock_count"), us(LOCKS).alias("lock_duration_us"), F.count_if(of(ERRORS)).alias("error_count"),
        F.max(F.when(of(DB), F.col("duration_us"))).alias("max_db_us"), F.count(rows).alias("db_rows_available_count"), F.sum(rows).alias("db_rows_known"), F.max(rows).alias("db_rows_max"),
    )


OWNED = ["db_count", "db_duration_us", "sdbl_count", "lock_count", "lock_duration_us", "error_count", "db_rows_available_count"]


def observations(events: DataFrame, linked: DataFrame) -> DataFrame:
    """Calls with valid counter values and what they own; a call that owns nothing has zeros."""
    calls = events.where("event_type = 'CALL'").withColumnRenamed("event_id", "call_id")
    for name, minimum in COUNTERS.items():
        calls = calls.withColumn(name, counters.value(f"{name}_raw", minimum))
    calls = calls.join(rollup(linked), "call_id", "left")
    return calls.withColumns({c: F.coalesce(c, F.lit(0)) for c in OWNED})


def counter_states(calls: DataFrame, *more: str) -> DataFrame:
    """Long form of all counters: one row per call and field."""
    each = [F.struct(F.lit(n).alias("field"), counters.state(f"{n}_raw", m).alias("state"), counters.value(f"{n}_raw", m).alias("value")) for n, m in COUNTERS.items()]
    return calls.select("event_id", "measurement_id", *more, F.inline(F.array(*each)))


def counter_quality(calls: DataFrame, keys: tuple[str, ...] = ("measurement_id",)) -> DataFrame:
    more = [k for k in keys if k != "measurement_id"]
    return counter_states(calls, *more).groupBy(*keys, "field").agg(*counters.summary("state", "value"))


def severity(p95: str = "p95_us") -> Column:
    """P0, P1 or P2 by fixed thresholds."""
    p0 = f"(count >= 2 and {p95} >= 30000000) or over_30s >= 2 or max_us >= 120000000 or (db_per_call >= 1000 and {p95} >= 10000000)"
    p1 = f"max_us >= 30000000 or {p95} >= 5000000 or duration_us >= 30000000 or db_per_call >= 500 or coalesce(max_out_bytes, 0) >= 10485760"
    return F.when(F.expr(p0), "P0").when(F.expr(p1), "P1").otherwise("P2")


def operations(calls: DataFrame, by_dataset: bool = False) -> DataFrame:
    """Per measurement, user and exact signature, and per data set on request."""
    keys = [*OPERATION, "dataset_id"] if by_dataset else OPERATION
    mean = lambda c: F.round(F.avg(c), 3)
    out = calls.groupBy(*keys).agg(
        *metric_group(), F.min("duration_us").alias("min_us"), F.min("end_us").alias("first_us"), F.max("end_us").alias("last_us"),
        F.coalesce(F.round(F.try_divide(F.stddev_pop("duration_us"), F.avg("duration_us")), 6), F.lit(0.0)).alias("cv"),
        *counters.cpu_population(), F.sum("cpu_us").alias("cpu_us"),
        F.sum("memory").alias("memory"), mean("memory").alias("memory_per_call"), F.max("memory").alias("memory_max"),
        mean("memory_peak").alias("memory_peak_avg"), F.median("memory_peak").alias("memory_peak_median"), rank_percentile("memory_peak", 0.95).alias("memory_peak_p95"),
        rank_percentile("memory_peak", 0.99).alias("memory_peak_p99"), F.max("memory_peak").alias("memory_peak_max"),
        F.sum("out_bytes").alias("out_bytes"), mean("out_bytes").alias("out_bytes_per_call"), F.max("out_bytes").alias("max_out_bytes"), F.sum("in_bytes").alias("in_bytes"), mean("in_bytes").alias("in_bytes_per_call"),
        F.sum("rows_affected").alias("call_rows_affected"), F.sum("db_rows_known").alias("rows_affected"),
        F.sum("db_count").alias("db_count"), F.sum("db_duration_us").alias("db_duration_us"), F.max("db_count").alias("max_db_per_call"),
        F.sum("sdbl_count").alias("sdbl_count"), F.sum("lock_count").alias("lock_count"), F.sum("lock_duration_us").alias("lock_duration_us"), F.sum("error_count").alias("error_count"),
        F.min_by(F.coalesce("context", F.lit("")), "call_id").alias("first_context"), joined("dataset_id").alias("dataset_ids"),
    )
    out = out.withColumn("context_sample", text.clean("first_context", 2400)).drop("first_context")
    out = out.withColumn("db_per_call", F.round(F.col("db_count") / F.col("count"), 6)).withColumn("db_seconds_per_call", F.round(F.col("db_duration_us") / F.col("count") / SECOND, 6))
    out = out.withColumn("cpu_percent_of_wall", F.round("cpu_percent_of_wall", 4)).withColumn("unattributed_percent_floor", F.round("unattributed_percent_floor", 6))
    return out.withColumn("priority", severity())


def top_nested(linked: DataFrame, calls: DataFrame, n: int = 10) -> DataFrame:
    """Heaviest owned SQL patterns of each operation."""
    db = linked.where("event_type = 'DBPOSTGRS' and parent_call_id is not null and sql_pattern is not null").select(F.col("parent_call_id").alias("call_id"), "sql_pattern", F.col("duration_us").alias("us"))
    each = db.join(calls.select("call_id", *OPERATION), "call_id").groupBy(*OPERATION, "sql_pattern")
    each = each.agg(F.count("*").alias("count"), F.sum("us").alias("sum_us"), F.max("us").alias("max_us"))
    order = Window.partitionBy(*OPERATION).orderBy(F.desc("sum_us"), F.desc("max_us"), F.desc("sql_pattern"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_calls(calls: DataFrame, n: int = 200) -> DataFrame:
    return calls.orderBy(F.desc("duration_us"), F.desc("call_id")).limit(n).select("call_id", *OPERATION, "duration_us", "db_count", "error_count")


def dataset_stats(events: DataFrame, files: DataFrame | None = None, parse_errors: DataFrame | None = None) -> DataFrame:
    """Per dataset: population, identities, day and night, minutes with events; with files and records that failed where they are known."""
    hour, kind = F.hour("ts"), F.col("event_type")
    known = F.col("end_us").isNotNull()
    out = events.groupBy("dataset_id").agg(
        F.count("*").alias("records"), F.min("end_us").alias("first_us"), F.max("end_us").alias("last_us"),
        F.count_distinct("user").alias("users"), F.count_distinct("session").alias("sessions"), F.count_distinct("connect_id").alias("connect_ids"),
        F.count_distinct("process").alias("processes"), joined("measurement_id").alias("measurements"), joined(F.when(known, F.date_format("ts", "yyyy-MM-dd"))).alias("dates"),
        F.count_if(known & hour.between(8, 19)).alias("day_events"), F.count_if(known & ~hour.between(8, 19)).alias("night_events"),
        F.count_if(~known).alias("events_without_time"),
        F.count_if((F.col("user") == "(not specified)") | F.coalesce("context", F.lit("")).rlike(text.BACKGROUND)).alias("background_events"),
        F.count_distinct(F.when(known, F.date_trunc("minute", "ts"))).alias("active_minutes"),
        F.round(F.try_divide(F.count_if(kind == "DBPOSTGRS"), F.count_distinct(F.when(known, F.date_trunc("minute", "ts")))), 6).alias("db_per_active_minute"),
    )
    if files is not None:
        read = F.col("status").isin("valid", "valid_no_timestamp", "partial_nul_salvaged")
        out = out.join(files.groupBy("dataset_id").agg(F.count_if(read).alias("files"), F.sum(F.when(read, F.col("analyzed_bytes")).otherwise(0)).alias("bytes")), "dataset_id", "left")
    if parse_errors is not None:
        out = out.join(parse_errors, "dataset_id", "left").withColumn("parse_errors", F.coalesce("parse_errors", F.lit(0)))
    return out


def busiest_minute(events: DataFrame) -> DataFrame:
    """Minute with most DB events per dataset, the earliest of equals."""
    minutes = events.where("event_type = 'DBPOSTGRS' and end_us is not null").groupBy("dataset_id", F.floor(F.col("end_us") / 60_000_000).alias("minute")).count()
    return minutes.groupBy("dataset_id").agg(F.max_by("minute", F.struct("count", -F.col("minute"))).alias("busiest_minute"), F.max("count").alias("busiest_count"))


def event_stats(events: DataFrame) -> DataFrame:
    return spread_group(events, ["dataset_id", "event_type"])


def top_signatures(calls: DataFrame, n: int = 20) -> DataFrame:
    order = Window.partitionBy("dataset_id").orderBy(F.desc("count"), F.desc("signature"))
    return calls.groupBy("dataset_id", "signature").count().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


FEATURES = ["has_join", "has_case", "has_distinct", "has_order_by", "has_group_by", "has_union", "has_temp_table", "has_limit_or_top"]


def sql_groups(linked: DataFrame, texts: DataFrame, n_contexts: int = 30, n_tables: int = 80) -> DataFrame:
    """DB events with SQL by normal form and measurement, linked or not: users, first contexts and tables, features, the measurements that share it.

    texts is the dictionary of statements; a normal form has the features of any of its statements.
    """
    db = linked.where("event_type = 'DBPOSTGRS' and sql_pattern is not null")
    keys = ["measurement_id", "sql_pattern"]
    rows = counters.value("rows_affected_raw", 0)
    out = spread_group(db, keys).join(db.groupBy(*keys).agg(
        F.count_if(F.col("duration_us").between(500_000, 2_000_000)).alias("count_0_5_to_2s"),
        F.count_if(F.col("parent_call_id").isNotNull()).alias("linked_count"), joined("user").alias("users"),
        F.min_by("sql_text", F.when(text.clean("sql_text") != "", F.col("event_id"))).alias("sample_sql"), F.min("end_us").alias("first_us"), F.max("end_us").alias("last_us"),
        F.sum(rows).alias("rows_affected"), F.max(rows).alias("max_rows_affected"), F.avg(rows).alias("rows_affected_per_event"),
    ), keys).withColumn("sample_sql", text.clean("sample_sql", 2400))
    contexts = first_met(db.withColumn("context_root", text.context_root("context")), keys, "context_root", F.col("event_id"), n_contexts).withColumnRenamed("context_root_list", "contexts")
    used = db.groupBy(*keys, "sql_text").agg(F.min("event_id").alias("first_event")).join(texts.select("sql_text", "tables"), "sql_text")
    used = used.select(*keys, "first_event", F.posexplode("tables").alias("at", "table_name"))
    tables = first_met(used, keys, "table_name", F.struct("first_event", "at"), n_tables).withColumnRenamed("table_name_list", "tables")
    shared = db.groupBy("sql_pattern").agg(joined("measurement_id").alias("measurements_all"), F.count_distinct("measurement_id").alias("measurement_count"))
    told = texts.groupBy(F.col("normalized_sql").alias("sql_pattern")).agg(F.first("sql_fingerprint_sha256").alias("sql_fingerprint_sha256"), F.first("sql_normalization_status").alias("sql_normalization_status"), *[F.bool_or(f).alias(f) for f in FEATURES])
    out = out.join(contexts, keys, "left").join(tables, keys, "left").join(shared, "sql_pattern").join(told, "sql_pattern")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("contexts", "tables")})


def lock_groups(linked: DataFrame) -> DataFrame:
    """Lock events by the first line of their context."""
    root = text.context_root("context")
    locks = linked.where(F.col("event_type").isin(*LOCKS)).withColumn("context", F.when(root == "", "(context unavailable)").otherwise(root))
    keys = ["measurement_id", "event_type", "context"]
    return locks.groupBy(*keys).agg(*metric_group(), joined("user").alias("users"), F.count("parent_call_id").alias("linked_call_count"))


def errors(linked: DataFrame) -> DataFrame:
    """Error events with signature, category, payload and suspected incident."""
    e = linked.where(F.col("event_type").isin(*ERRORS))
    e = e.withColumn("error_signature", text.normalize_error("message")).withColumn("category", text.classify_error("message"))
    e = e.withColumn("message_state", text.message_state("message")).withColumn("payload", text.strip_wrappers("message"))
    e = e.withColumn("signature_id", text.canonical_id("error-signature/v2", text.ERROR_VERSION, F.col("message_state"), F.col("error_signature")))
    blank = F.lit(False)
    for c in ("usr_raw", "process", "thread", "session", "context"):
        blank = blank | text.blank(F.col(c))
    reason = (
        F.when(F.col("status") != "linked_unique", F.concat(F.lit("singleton_"), "status"))
        .when(blank, "singleton_missing_identity_or_context")
        .when((F.col("message_state") != "present") | (F.col("payload") == ""), "singleton_missing_payload")
        .when(F.col("connect_relation") == "conflict", "singleton_connect_conflict")
        .otherwise("same_call_exact_payload")
    )
    e = e.withColumn("incident_reason", reason)
    digest = lambda kind, c: text.canonical_id(kind, F.coalesce(c, F.lit("")))
    scope = [*(F.col(c) for c in ("connect_id", "dataset_id")), digest("error-payload/v1", "payload").alias("exact_payload_sha256"), digest("error-context/v1", "context").alias("full_context_sha256"), *(F.col(c) for c in ("process", "session", "thread", "user"))]
    keyed = lambda *cs: F.to_json(F.struct(*cs), {"ignoreNullFields": "false"})
    key = F.when(F.col("incident_reason") == "same_call_exact_payload", keyed(F.col("parent_call_id").cast("string").alias("call_event_id"), *scope)).otherwise(keyed(F.col("event_id").cast("string").alias("singleton_event_id")))
    return e.withColumn("incident_id", F.sha2(F.concat(F.lit(f'["suspected-incident/v1","{text.INCIDENT_VERSION}",'), key, F.lit("]")), 256))


def error_groups(found: DataFrame, n_contexts: int = 30) -> DataFrame:
    keys = ["measurement_id", "event_type", "signature_id"]
    out = found.groupBy(*keys).agg(
        F.first("error_signature").alias("error_signature"), F.count("*").alias("event_count"), F.count("parent_call_id").alias("linked_error_event_count"), F.count_if(F.col("parent_call_id").isNull()).alias("unlinked_error_event_count"),
        F.count_distinct("parent_call_id").alias("affected_call_count"), F.count_distinct("incident_id").alias("suspected_incident_count"),
        F.min("event_id").alias("representative"), F.min("end_us").alias("first_us"), F.max("end_us").alias("last_us"), F.min_by("category", "event_id").alias("category"),
        F.substring(text.clean(F.min_by(F.coalesce("message", F.lit("")), "event_id")), 1, 2400).alias("sample"), joined(F.nullif("user", F.lit(""))).alias("users"),
    )
    contexts = first_met(found, keys, "context", F.lit(0), n_contexts).withColumnRenamed("context_list", "contexts")
    return out.join(contexts, keys, "left").withColumn("contexts", F.coalesce("contexts", F.lit("")))


def error_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("event_count"), F.count("parent_call_id").alias("linked_error_event_count"), F.count_if(F.col("parent_call_id").isNull()).alias("unlinked_error_event_count"),
        F.count_distinct("signature_id").alias("signature_count"), F.count_distinct("incident_id").alias("suspected_incident_count"), F.count_distinct("parent_call_id").alias("affected_call_count"),
        F.count_if(F.col("incident_reason") == "same_call_exact_payload").alias("grouped_count"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous_linked_error_event_count"),
        F.count_if(F.col("status") == "linked_by_rule").alias("fallback_linked_error_event_count"),
    )


def incidents(found: DataFrame) -> DataFrame:
    return found.groupBy("incident_id").agg(
        F.min("event_id").alias("representative"), F.count("*").alias("event_count"), F.count_distinct("parent_call_id").alias("affected_call_count"),
        F.min("end_us").alias("first_us"), F.max("end_us").alias("last_us"), F.min("incident_reason").alias("reason_code"),
    )


FAMILIES = (("db", DB), ("sdbl", SDBL), ("lock", LOCKS), ("error", ERRORS))


def linkage(events: DataFrame, linked: DataFrame) -> DataFrame:
    """Totals, linked parts and reasons per dataset and measurement, of calls or of any event of the families."""
    keys = ["dataset_id", "measurement_id"]
    calls = events.where("event_type = 'CALL'").groupBy(*keys).agg(F.count("*").alias("call_count"), F.count_if(F.col("end_us").isNull()).alias("calls_without_absolute_time"))
    on, out = F.col("parent_call_id").isNotNull(), []
    for name, kinds in FAMILIES:
        of = F.col("event_type").isin(*kinds)
        out += [F.count_if(of).alias(f"{name}_total"), F.count_if(of & on).alias(f"{name}_linked")]
    db = F.col("event_type").isin(*DB)
    us = lambda c: F.coalesce(F.sum(F.when(c, F.col("duration_us"))), F.lit(0))
    out += [us(db).alias("db_duration_us"), us(db & on).alias("db_linked_duration_us")]
    out += [F.count_if(F.col("reason_code") == r).alias(f"unlinked_{r}") for r in ("missing_timestamp", "missing_thread", "no_containing_call")]
    some = linked.where(F.col("event_type").isin(*[k for _, kinds in FAMILIES for k in kinds]))
    found = some.groupBy(*keys).agg(*out).join(calls, keys, "full")
    found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in found.columns if c not in keys})
    rounded = {f"{n}_linked_percent": F.round(text.percent(F.col(f"{n}_linked"), F.col(f"{n}_total")), 6) for n, _ in FAMILIES}
    return found.withColumns(rounded | {"db_linked_duration_percent": F.round(text.percent(F.col("db_linked_duration_us"), F.col("db_duration_us")), 6)})


def membership(events: DataFrame) -> DataFrame:
    """Which datasets are in which measurement, from calls, DB events and errors."""
    return events.where(F.col("event_type").isin("CALL", *DB, *ERRORS)).select("measurement_id", "dataset_id").distinct()


CHAIN = ("count", "avg_us", "median_us", "p95_us", "max_us", "db_per_call", "db_seconds_per_call", "cpu_percent_of_wall", "out_bytes_per_call")


def identical_operations(ops: DataFrame) -> DataFrame:
    """Measurements of each signature that has two at least, in one chain per user by first call, each with its change to the one before.

    Level B: the user has calls in two measurements at least; C: only different users can be compared.
    """
    at = Window.partitionBy("signature", "user").orderBy(F.col("first_us").asc_nulls_last(), "measurement_id")
    out = ops.withColumns({"comparison_order": F.row_number().over(at), "previous_measurement_id": F.lag("measurement_id").over(at), "previous_first_us": F.lag("first_us").over(at)})
    out = out.withColumn("own", F.count("*").over(Window.partitionBy("signature", "user")))  # a row of ops is a measurement
    for c in CHAIN:
        before = F.lag(c).over(at)
        out = out.withColumn(f"{c}_delta", (F.col(c) - before).cast("double")).withColumn(f"{c}_delta_percent", F.round(F.when(before != 0, 100.0 * (F.col(c) - before) / before), 6))
    many = ops.groupBy("signature").agg(F.count_distinct("measurement_id").alias("measurement_count")).where("measurement_count >= 2").select("signature")
    out = out.join(many, "signature", "left_semi").withColumn("comparability_level", F.when(F.col("own") >= 2, "B").otherwise("C"))
    out = out.withColumn("comparison_scope", F.when(F.col("own") >= 2, "same_signature_same_user").otherwise("same_signature_different_user_only"))
    return out.select("signature", "user", "measurement_id", "comparison_order", "comparison_scope", "comparability_level", "dataset_ids", "first_us", "last_us", "previous_measurement_id", "previous_first_us", *CHAIN, *[x for c in CHAIN for x in (f"{c}_delta", f"{c}_delta_percent")])


def call_sequence(calls: DataFrame) -> DataFrame:
    """Sequential call numbers by source order, then record order: counts per source give each its offset, so no window sees all rows."""
    own = Window.partitionBy("dataset_id", "process").orderBy("event_id")
    counts = calls.groupBy("dataset_id", "process").count()
    offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(Window.orderBy("dataset_id", "process").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return calls.withColumn("n", F.row_number().over(own)).join(offsets, ["dataset_id", "process"]).select("event_id", "dataset_id", "process", (F.col("offset") + F.col("n")).alias("legacy_call_id"))
