"""Database chattiness: how many DB events calls own, against thresholds and duration bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrace.functions.text import UNKNOWN_USERS, percent
from sparktrace.operators.aggregates import SECOND, rank_percentile
from sparktrace.operators.series import COHORT, changes, referenced

PROFILE = (
    "db_count_sum db_per_call_avg db_per_call_median db_per_call_p95 db_per_call_max call_duration_us_sum call_duration_us_avg call_duration_us_median call_duration_us_p95 call_duration_us_max "
    "linked_db_duration_us_sum linked_db_seconds_per_call calls_with_zero_linked_db calls_above_threshold_count call_share_denominator calls_above_threshold_percent fast_call_count "
    "fast_calls_above_threshold_count fast_call_share_denominator fast_calls_above_threshold_percent chatty_db_count_sum chatty_call_duration_us_sum chatty_call_duration_us_avg "
    "chatty_call_duration_us_median chatty_call_duration_us_p95 chatty_call_duration_us_max chatty_linked_db_duration_us_sum chatty_linked_db_seconds_per_call"
).split()


def thresholded(calls: DataFrame, thresholds: list[int]) -> DataFrame:
    """Each call once per threshold of the configuration, a short list."""
    return calls.withColumn("threshold_db_events", F.explode(F.array(*[F.lit(t) for t in thresholds])))


def profile(threshold: int, fast_us: int) -> dict[str, Column]:
    """The 28 fields by name; hits are strictly above the threshold, fast calls at most fast_us; sums are 0 and means null without hits."""
    hit, fast, n = F.col("db_count") > threshold, F.col("duration_us") <= fast_us, F.count("*")
    on = lambda c: F.when(hit, F.col(c))
    zero = lambda c: F.coalesce(F.sum(on(c)), F.lit(0))
    hits, fasts, both = F.count_if(hit), F.count_if(fast), F.count_if(hit & fast)
    columns = [
        F.sum("db_count"), F.avg("db_count"), F.median("db_count"), rank_percentile("db_count", 0.95), F.max("db_count"), F.sum("duration_us"), F.avg("duration_us"), F.median("duration_us"), rank_percentile("duration_us", 0.95), F.max("duration_us"),
        F.sum("db_duration_us"), F.sum("db_duration_us") / n / SECOND, F.count_if(F.col("db_count") == 0), hits, n, percent(hits, n), fasts, both, fasts, percent(both, fasts),
        zero("db_count"), zero("duration_us"), F.avg(on("duration_us")), F.median(on("duration_us")), F.expr(f"cast(percentile_disc(0.95) within group (order by if(db_count > {threshold}, duration_us, null)) as bigint)"), F.max(on("duration_us")),
        zero("db_duration_us"), F.when(hits > 0, zero("db_duration_us") / hits / SECOND),
    ]
    return dict(zip(PROFILE, columns, strict=True))


#: Fields that are the same for every threshold.
SAME = [p for p in PROFILE if "chatty" not in p and "above" not in p]


def groups(calls: DataFrame, thresholds: list[int], fast_us: int) -> DataFrame:
    """Profile per cohort, measurement and threshold, of the cohorts that have calls there; each call is read once for all thresholds."""
    first = profile(thresholds[0], fast_us)
    aggregates = [F.count("*").alias("count"), *[first[p].alias(p) for p in SAME]]
    each = []
    for t in thresholds:
        mean = (F.sum("db_count") > t * F.count("*")).alias(f"group_mean_above_threshold_{t}")
        aggregates += [mean, *[c.alias(f"{p}_{t}") for p, c in profile(t, fast_us).items() if p not in SAME]]
        each.append(F.struct(F.lit(t).alias("threshold_db_events"), *[F.col(f"{p}_{t}").alias(p) for p in ["group_mean_above_threshold", *PROFILE] if p not in SAME]))
    out = calls.groupBy(*COHORT, "measurement_id").agg(*aggregates)
    return out.select(*COHORT, "measurement_id", "count", *SAME, F.inline(F.array(*each))).select(*COHORT, "measurement_id", "threshold_db_events", "count", "group_mean_above_threshold", *PROFILE)


def full(calls: DataFrame, history: DataFrame, thresholds: list[int], fast_us: int) -> DataFrame:
    """groups over the whole grid of a history."""
    grid = thresholded(history.select(*COHORT, "measurement_id", "measurement_order", "series_order_reliable", "first_observation", "previous_observation", "series_baseline"), thresholds)
    out = grid.join(groups(calls, thresholds, fast_us), [*COHORT, "measurement_id", "threshold_db_events"], "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0)))


def band(column: str, bounds: list[int]) -> Column:
    """Number of the duration band: above its lower bound, up to its upper one; the last is open."""
    out = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(bounds))):
        out = F.when(F.col(column) <= bound, i).otherwise(out)
    return out


def chatty_calls(calls: DataFrame, thresholds: list[int], fast_us: int, bounds: list[int]) -> DataFrame:
    over = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("db_count") > t)
    return calls.where(F.size(over) > 0).select(
        "call_id", *COHORT, "measurement_id", "duration_us", "db_count", "db_duration_us", F.array_join(F.transform(over, lambda t: t.cast("string")), ",").alias("thresholds_exceeded"),
        (F.col("duration_us") <= fast_us).alias("is_fast_call"), band("duration_us", bounds).alias("duration_band_index"),
    )


def durations(calls: DataFrame, thresholds: list[int], bounds: list[int]) -> DataFrame:
    """Per group, threshold and band: share of the band's calls and of the group's hits; empty bands have zeros."""
    keys = [*COHORT, "measurement_id"]
    hit = lambda t: F.col("db_count") > t
    by_threshold = lambda make: F.inline(F.array(*[F.struct(F.lit(t).alias("threshold_db_events"), *make(t)) for t in thresholds]))
    group = calls.groupBy(*keys).agg(F.count("*").alias("group_call_count"), *[F.count_if(hit(t)).alias(f"hits_{t}") for t in thresholds])
    group = group.select(*keys, "group_call_count", by_threshold(lambda t: [F.col(f"hits_{t}").alias("group_chatty_call_denominator")])).withColumn("duration_band_index", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
    found = calls.groupBy(*keys, band("duration_us", bounds).alias("duration_band_index")).agg(
        F.count("*").alias("band_call_count"), F.sum("duration_us").alias("band_call_duration_us_sum"), F.sum("db_duration_us").alias("band_linked_db_duration_us_sum"),
        *[x for t in thresholds for x in (F.count_if(hit(t)).alias(f"hits_{t}"), F.coalesce(F.sum(F.when(hit(t), F.col("duration_us"))), F.lit(0)).alias(f"us_{t}"))],
    )
    found = found.select(*keys, "duration_band_index", "band_call_count", "band_call_duration_us_sum", "band_linked_db_duration_us_sum", by_threshold(lambda t: [F.col(f"hits_{t}").alias("band_calls_above_threshold_count"), F.col(f"us_{t}").alias("chatty_call_duration_us_sum")]))
    out = group.join(found, [*keys, "threshold_db_events", "duration_band_index"], "left")
    for c in ("band_call_count", "band_calls_above_threshold_count", "band_call_duration_us_sum", "band_linked_db_duration_us_sum", "chatty_call_duration_us_sum"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    out = out.withColumn("within_band_above_threshold_percent", percent(F.col("band_calls_above_threshold_count"), F.col("band_call_count")))
    return out.withColumn("share_of_group_chatty_calls_percent", percent(F.col("band_calls_above_threshold_count"), F.col("group_chatty_call_denominator")))


def coverage(calls: DataFrame, thresholds: list[int], fast_us: int) -> DataFrame:
    """Per measurement and over all: calls, operations and known users concerned, each against its own whole; distinct counts aren't summed."""
    each = thresholded(calls, thresholds).withColumn("hit", F.col("db_count") > F.col("threshold_db_events"))
    known = F.when(~F.col("user").isin(*UNKNOWN_USERS), F.col("user"))
    keys = [*COHORT, "measurement_id", "threshold_db_events"]
    flagged = each.groupBy(*keys).agg((F.sum("db_count") > F.first("threshold_db_events") * F.count("*")).alias("flag"))
    each = each.join(flagged.where("flag").drop("flag").withColumn("flagged", F.lit(True)), keys, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    group = F.struct(*COHORT, "measurement_id")
    total, hits = F.count("*"), F.count_if("hit")
    ops, users = F.count_distinct("signature"), F.count_distinct(known)
    some = lambda c: F.when(F.col("hit"), c)
    zero = lambda c: F.coalesce(F.sum(some(F.col(c))), F.lit(0))
    fast = F.col("duration_us") <= fast_us
    fasts, both = F.count_if(fast), F.count_if(fast & F.col("hit"))
    out = each.groupingSets([["measurement_id", "threshold_db_events"], ["threshold_db_events"]], "measurement_id", "threshold_db_events").agg(
        F.when(F.grouping("measurement_id") == 1, "selected_measurements_all_users").otherwise("measurement_all_users").alias("population_scope"),
        total.alias("total_call_count"), hits.alias("chatty_call_count"), percent(hits, total).alias("chatty_call_percent"),
        ops.alias("observed_operation_count"), F.count_distinct(some(F.col("signature"))).alias("affected_operation_count"), percent(F.count_distinct(some(F.col("signature"))), ops).alias("affected_operation_percent"),
        users.alias("observed_known_user_count"), F.count_distinct(some(known)).alias("affected_known_user_count"), percent(F.count_distinct(some(known)), users).alias("affected_known_user_percent"),
        F.count_if(known.isNull()).alias("calls_with_unknown_user_count"), F.count_if(known.isNull() & F.col("hit")).alias("chatty_calls_with_unknown_user_count"),
        F.count_distinct(group).alias("observed_group_count"), F.count_distinct(F.when(F.col("flagged"), group)).alias("mean_flagged_group_count"), F.count_if("flagged").alias("calls_in_mean_flagged_groups_count"),
        F.count_distinct(F.when(F.col("flagged"), F.col("signature"))).alias("mean_flagged_operation_count"), F.count_distinct(F.when(F.col("flagged"), known)).alias("mean_flagged_known_user_count"), percent(F.count_if("flagged"), total).alias("calls_in_mean_flagged_groups_percent"),
        fasts.alias("fast_call_count"), both.alias("fast_chatty_call_count"), percent(both, fasts).alias("fast_chatty_call_percent"), F.count_if(F.col("db_count") == 0).alias("calls_with_zero_linked_db"),
        F.sum("duration_us").alias("call_duration_us_sum"), F.sum("db_duration_us").alias("linked_db_duration_us_sum"), zero("duration_us").alias("chatty_call_duration_us_sum"), zero("db_duration_us").alias("chatty_linked_db_duration_us_sum"),
    )
    return out


def chatty_changes(rows: DataFrame) -> DataFrame:
    pairs = referenced(rows, [*COHORT, "threshold_db_events"], ["first_observation", "previous_observation"])
    return pairs.select(
        *COHORT, "threshold_db_events", "comparison_basis", "reference_measurement_id", F.col("measurement_id").alias("current_measurement_id"), "comparison_state", "reference_relation",
        F.col("r_group_mean_above_threshold").alias("reference_group_mean_above_threshold"), F.col("group_mean_above_threshold").alias("current_group_mean_above_threshold"), *[c for m in PROFILE for c in changes(m)],
    )
