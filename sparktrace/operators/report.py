"""Tables that reports show: sections, selections, states of rows, units and reasons of what is missing. Nothing is computed anew."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections with the tables that each shows, default sections by kind of report, and snapshots that no window restricts.
SECTIONS = {
    "provenance": (), "sources": ("files", "datasets"), "quality": ("data_quality",), "operations": ("operations",), "operations_all_users": ("operation_history_all_users",), "comparisons": ("measurement_comparisons", "comparability"),
    "db_chatty": ("db_chatty", "db_chatty_calls", "db_chatty_fast_calls", "db_chatty_duration", "db_chatty_coverage", "db_chatty_changes"), "db_chatty_summary": ("db_chatty", "db_chatty_coverage"), "db_chatty_comparison": ("db_chatty_changes",),
    "apdex": ("apdex", "apdex_coverage", "apdex_uncovered"), "apdex_overall": ("apdex_overall", "apdex_composition", "apdex_coverage"), "apdex_changes": ("apdex_changes",),
    "problems": ("problem_registry", "problem_rule_coverage"), "problem_history": ("problem_history", "problem_rule_coverage"), "problem_views": ("problem_improved", "problem_persisting", "problem_worsened", "problem_new", "problem_unchecked"),
    "sql": ("heavy_sql",), "errors": ("errors",), "locks": ("locks",),
}
DEFAULTS = {
    "overview": ["provenance", "sources", "quality", "operations", "sql", "errors", "locks"],
    "comparison": ["provenance", "quality", "comparisons"],
    "history": ["provenance", "quality", "operations", "problem_history"],
}
SNAPSHOTS = ("problem_registry", "problem_persisting", "problem_unchecked")
KEYS = {"report_config_version", "report_kind", "title", "document_notice", "locale", "report_date", "labels", "sections", "tables", "display_measurement_ids", "focus_measurement_id", "format", "fonts"}
TRAJECTORIES = {"operation_history": ["signature", "user"], "operation_history_all_users": ["signature"], "problem_history": ["rule_id", "signature", "user"]}


def load(text: str) -> dict:
    """Checked presentation settings: they choose and sort rows and never change them."""
    from sparktrace.plans.config import names, need, strict_json, text_of, whole

    c = strict_json(text)
    need(isinstance(c, dict) and not set(c) - KEYS and c.get("report_config_version") == "1.0", "report_config_version 1.0 and known settings only")
    need(c.get("report_kind") in DEFAULTS, f"report_kind: one of {sorted(DEFAULTS)}")
    need(c.get("locale", "ru-RU") == "ru-RU", "locale: ru-RU")
    text_of(c.get("title"), "title")
    c.setdefault("sections", DEFAULTS[c["report_kind"]])
    need(not set(names(c["sections"], "sections")) - set(SECTIONS), f"sections: of {sorted(SECTIONS)}")
    if c.get("display_measurement_ids") is not None:
        names(c["display_measurement_ids"], "display_measurement_ids")
    need(isinstance(c.setdefault("tables", {}), dict), "tables: settings by table")
    for name, options in c["tables"].items():
        need(name in {t for ts in SECTIONS.values() for t in ts} and isinstance(options, dict) and not set(options) - {"sort", "top_n"}, f"tables: {name}")
        if options.get("top_n") is not None:
            whole(options["top_n"], f"tables.{name}.top_n")
        for s in options.get("sort", []):
            need(isinstance(s, dict) and set(s) == {"field", "direction"} and s["direction"] in ("asc", "desc"), f"tables.{name}.sort: field and direction")
    return c


def ordering(keys: list[tuple[str, bool]]) -> list[Column]:
    """Several keys, each ascending or not, unknown values always last."""
    return [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in keys]


def top_per_measurement(rows: DataFrame, keys: list[tuple[str, bool]], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("measurement_id").orderBy(*ordering(keys)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def top_trajectories(history: DataFrame, cohort: list[str], metric: str, n: int) -> DataFrame:
    """All measurements of the n cohorts whose largest value is highest, never single rows of others."""
    best = history.groupBy(*cohort).agg(F.max(metric).alias("best")).orderBy(F.col("best").desc_nulls_last(), *cohort).limit(n)
    return history.join(best.drop("best"), cohort, "left_semi")


def in_scope(rows: DataFrame, measurements: list[str]) -> DataFrame:
    """Rows of the measurements shown: by the current one of a comparison, else by the row's own; pooled rows have none and go."""
    for c in ("current_measurement_id", "measurement_id"):
        if c in rows.columns:
            return rows.where(F.col(c).isin(measurements))
    return rows


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal keys; a key that the right side has twice or not at all is an error when the rows are read."""
    own = [c for c in right.columns if c not in keys]
    times = F.count("*").over(Window.partitionBy(*keys))
    other = right.select(*[F.col(k).alias(f"right_{k}") for k in keys], *[F.col(c).alias(f"right_{c}") for c in own], times.alias("right_times"))
    on = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    out = left.join(other, on, "left")
    checked = F.when(F.col("right_times") == 1, True).otherwise(F.raise_error(F.concat(F.lit("join key is there so many times: "), F.coalesce(F.col("right_times"), F.lit(0)).cast("string"))).cast("boolean"))
    return out.where(checked).drop("right_times", *[f"right_{k}" for k in keys])


def unit(field: str) -> str:
    for part, name in (("percent", "%"), ("bytes", "bytes"), ("memory", "bytes"), ("seconds", "s"), ("_us", "us"), ("apdex", ""), ("count", "")):
        if part in field:
            return name
    return ""


def missing_reason(rows: DataFrame, field: str) -> Column:
    """Why a cell is empty, as reports say it."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    out = F.lit("показатель недоступен")
    if "reference" in field or "delta" in field:
        out = F.when(has("reference_relation") == "no_reference", "база сравнения отсутствует").otherwise(out)
    if "percent" in field:
        zero = has("sample_count_percent_status") == "undefined_zero_reference" if field.startswith("sample_count") else has(f"{field.removesuffix('delta_percent')}percent_status") == "undefined_zero_reference"
        listed = F.array_contains(F.split(has("percent_undefined_zero_reference_metrics"), r" \| "), field.removesuffix("_delta_percent"))
        out = F.when(zero | listed, "процент не определён: нулевая база").otherwise(out)
    if field.endswith("change_status"):
        out = F.when(has(f"{field.removesuffix('change_status')}direction") == "unchanged", "направление: unchanged; числовой статус не задан расчётчиком").otherwise(out)
    goal = (has("target_coverage_status") == "uncovered_no_target") | F.contains(has("insufficient_reasons"), F.lit("APDEX_T_not_defined"))
    out = F.when(goal, "цель APDEX не задана").otherwise(out)
    return F.when((has("observation_status") == "not_observed") | (has("threshold_status") == "не наблюдалось"), "нет наблюдений").otherwise(out)


def presented(rows: DataFrame, partial: bool = False) -> DataFrame:
    """rows with the state of each and a map of the empty fields to the reasons."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    part = has("status").isin("partial_read_error", "partial_nul_salvaged") | (has("measurement_source_health") == "known_related_capture_gaps") | F.lit(partial)
    none = (has("observation_status") == "not_observed") | (has("threshold_status") == "не наблюдалось")
    state = F.when(none, "no_observations").when(part, "partial").otherwise("ready")
    reasons = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.struct(F.lit(c).alias("k"), missing_reason(rows, c).alias("v"))) for c in rows.columns])))
    return rows.withColumns({"row_state": state, "missing_reasons": reasons})


def selected(name: str, rows: DataFrame, settings: dict, membership: DataFrame | None = None) -> DataFrame:
    """Rows of a table that a report shows: its measurements, sorted, the first ones; of histories whole trajectories."""
    shown = settings.get("display_measurement_ids")
    if settings["report_kind"] == "overview" and (focus := settings.get("focus_measurement_id")):
        shown = [focus] if shown is None or focus in shown else []
    if shown is not None and name not in SNAPSHOTS:
        if name in ("files", "datasets") and membership is not None:
            near = membership.where(F.col("measurement_id").isin(shown))
            by = "capture_id" if name == "files" else "dataset_id"
            rows = rows.join(near.select(by).distinct(), by, "left_semi")
        else:
            rows = in_scope(rows, shown)
    options = settings["tables"].get(name, {})
    keys = [(s["field"], s["direction"] == "asc") for s in options.get("sort", [])]
    plain = [c for c, t in rows.dtypes if not t.startswith("map") and c not in {k for k, _ in keys}]
    order = ordering([*keys, *((c, True) for c in plain)])
    n = options.get("top_n")
    if name in TRAJECTORIES:
        cohort = TRAJECTORIES[name]
        if n is not None:
            best = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*cohort).orderBy(*order))).where("nth = 1").orderBy(*order).limit(n).select(*[F.col(c).alias(f"best_{c}") for c in cohort])
            rows = rows.join(best, [F.col(c).eqNullSafe(F.col(f"best_{c}")) for c in cohort], "left_semi")
        return rows.orderBy(*cohort, "measurement_order")
    if n is not None and settings["report_kind"] == "overview" and "measurement_id" in rows.columns:
        rank = F.row_number().over(Window.partitionBy("measurement_id").orderBy(*order))
        return rows.withColumn("nth", rank).where(F.col("nth") <= n).orderBy("measurement_id", "nth").drop("nth")
    return rows.orderBy(*order) if n is None else rows.orderBy(*order).limit(n)


def build(settings: dict, saved: dict[str, DataFrame], slices: dict[str, DataFrame], told: dict[str, Any]) -> dict[str, DataFrame]:
    """Tables of the sections by name section__table, and the units of all their fields."""
    spark = next(iter(saved.values())).sparkSession
    everything, partial = saved | slices, not told["about"].get("analysis_complete", True)
    membership = saved["events"].select("measurement_id", "dataset_id", "capture_id").distinct()
    out: dict[str, DataFrame] = {}
    for section in settings["sections"]:
        if section == "provenance":
            facts = {"bundle_id": told["bundle_id"], "title": settings["title"], "document_notice": settings.get("document_notice")} | told["about"]
            out["provenance__facts"] = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted(facts.items())], "fact string, value string")
        for name in SECTIONS[section]:
            if name not in everything:
                raise ValueError(f"section {section} needs the table {name}, which wasn't derived")
            out[f"{section}__{name}"] = presented(selected(name, everything[name], settings, membership), partial)
        if section == "comparisons":
            keys = ["signature", "user", "comparison_basis", "reference_measurement_id", "current_measurement_id"]
            out["comparisons__joined"] = one_to_one(selected("measurement_comparisons", everything["measurement_comparisons"], settings), everything["comparability"], keys)
    fields = [(t, c, unit(c)) for t, rows in out.items() for c in rows.columns]
    return out | {"units": spark.createDataFrame(fields, "table_name string, field string, unit string")}
