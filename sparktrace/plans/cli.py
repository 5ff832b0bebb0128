"""Commands: analyze logs into a bundle, derive tables from one, verify one, lay out report tables.

python -m sparktrace.plans.cli analyze LOGS -o BUNDLE [--archive-mode auto|always|never] [--exclude-dir NAME] [--salvage-nul-prefix] [--source-map FILE] [--capture-id ID] [--top-calls N] [--csv] [--progress] [--overwrite]
python -m sparktrace.plans.cli derive --analysis-dir BUNDLE --config FILE --output-dir DIR [--slices NAME ...] [--csv] [--progress] [--overwrite]
python -m sparktrace.plans.cli verify --analysis-dir BUNDLE [--slices-dir DIR] [--level basic|full]
python -m sparktrace.plans.cli report --analysis-dir BUNDLE --slices-dir DIR --config FILE --output-dir DIR [--overwrite]
python -m sparktrace.plans.cli slices

Ends with 0, or 2 for bad input, 4 without any valid log, 5 where the output folder is taken.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.functions import sqlnorm, text
from sparktrace.operators import aggregates as A
from sparktrace.operators import apdex, chatty, linking, problems, quality, report, series, verify
from sparktrace.plans import bundle, config
from sparktrace.plans.shared import kept
from sparktrace.sources import tj

NO_LOGS, BAD_INPUT, NOT_EMPTY = 4, 2, 5


class NoLogs(ValueError):
    pass


def analyze(
    spark: SparkSession, logs: str, writer: bundle.Writer, archive_mode: str = "auto", salvage: bool = False, excluded: tuple[str, ...] = (),
    capture: str | None = None, source_map: str | None = None, top_calls: int = 200,
) -> dict:
    """Write all tables of an analysis; each table that others need is written before them and read from there. Returns what the manifest says about it."""
    mapped: list[tuple[str, str, str, str]] = []
    if source_map is not None:
        named, mapped = tj.source_map(source_map)
        config.need(capture in (None, named), "the capture id isn't that of the source map")
        capture = named
    put = writer.put
    listed = tj.listed(spark, logs, archive_mode, excluded)
    put("archive_inventory", tj.inventory(listed))
    found = tj.opened(listed)
    health = put("files", tj.files(found, salvage, logs, capture, mapped))
    if not health.where("status = 'conflicting_version'").isEmpty():
        raise ValueError("versions of one logical source differ; select one explicitly")
    records = put("records", tj.records(tj.accepted(found, health), salvage))
    events = put("events", tj.events(records).withColumn("signature", text.signature("context", ["Func", "IName", "MName", "Form", "FormItem"])), ("event_type",))
    if events.where("event_type = 'CALL'").isEmpty():
        raise NoLogs(logs)
    put("parse_issues", records.where("parse_error").select("source_id", "logical", "dataset_id", "byte_start", "byte_end", "line_start", "raw_record_sha256"))
    errors_by = records.groupBy("dataset_id").agg(F.count_if("parse_error").alias("parse_errors"))
    texts = put("sql_texts", sqlnorm.dictionary(events.where("event_type = 'DBPOSTGRS'")))
    own, others = events.where("event_type = 'CALL'"), events.where("event_type <> 'CALL'")
    decided = put("link_decisions", linking.decide(others, linking.candidates(others, own)))
    put("link_candidates", linking.evidence(linking.candidates(others.where("event_type in ('DBPOSTGRS', 'EXCP', 'QERR')"), own), decided))
    linked = put("event_links", others.join(decided, "event_id").join(texts.select("sql_text", F.col("normalized_sql").alias("sql_pattern")), "sql_text", "left"), ("event_type",))
    calls = put("call_observations", quality.with_source_status(A.observations(events, linked), health))
    connects = own.select(F.col("event_id").alias("parent_call_id"), F.col("connect_id").alias("call_connect"))
    related = linked.where("event_type in ('EXCP', 'QERR')").join(connects, "parent_call_id", "left").withColumn("connect_relation", text.key_relation("connect_id", "call_connect"))
    failed = put("error_events", A.errors(related))
    operations = put("operations", A.operations(calls))
    put("operations_by_dataset", A.operations(calls, by_dataset=True))
    put("operation_counters", A.counter_quality(own, tuple(A.OPERATION)))
    put("top_nested_sql", A.top_nested(linked, calls))
    put("top_calls", A.top_calls(calls, top_calls))
    put("heavy_sql", A.sql_groups(linked, texts))
    put("locks", A.lock_groups(linked))
    put("errors", A.error_groups(failed))
    put("error_summary", A.error_summary(failed))
    put("error_incidents", A.incidents(failed))
    put("linkage", A.linkage(events, linked))
    put("datasets", A.dataset_stats(events, health, errors_by).join(A.busiest_minute(events), "dataset_id", "left"))
    put("event_stats", A.event_stats(events))
    put("top_signatures", A.top_signatures(own))
    put("identical_operations", A.identical_operations(operations))
    warnings = sorted({r.reason.split(":")[0] for r in health.where("status = 'partial_read_error' or reason like 'archive_error%'").select("reason").distinct().collect()})
    return {"input": logs, "capture_id": capture, "archive_mode": archive_mode, "salvage_nul_prefix": salvage, "excluded": sorted({*tj.EXCLUDED, *excluded}), "warnings": warnings, "analysis_complete": not warnings, "sql_normalization_version": text.SQL_VERSION, "error_signature_version": text.ERROR_VERSION, "incident_rules_version": text.INCIDENT_VERSION}


def goals(spark: SparkSession, settings: dict, calls: DataFrame) -> DataFrame:
    """Targets of the configuration; one for a signature without any call is an error."""
    told = settings["apdex"]
    rows = lambda entries: [(sig, text_id, us, status) for sig, text_id, us, status in entries]
    name = lambda kind, key, e: json.dumps(["apdex_target", kind, key, e["t_us"], e["status"], e["source"]], ensure_ascii=False, separators=(",", ":"))
    direct = rows([(e["signature"], name("operation", e["signature"], e), e["t_us"], e["status"]) for e in told["targets"]])
    of_class = [(s, e["class_id"], name("explicit_class", e["class_id"], e), e["t_us"], e["status"]) for e in told["classes"] for s in e["signatures"]]
    d = spark.createDataFrame(direct, "signature string, target_id string, t_us long, target_status string")
    c = spark.createDataFrame(of_class, "signature string, class_id string, target_id string, t_us long, target_status string")
    out = apdex.targets(*(x.withColumn("target_id", F.sha2("target_id", 256)) for x in (d, c)))
    if unknown := [r.signature for r in apdex.unobserved_targets(calls, out).select("signature").orderBy("signature").collect()]:
        raise config.ConfigError(f"APDEX targets of signatures without calls: {unknown}")
    return out


def derive(spark: SparkSession, saved: dict[str, DataFrame], settings: dict, bundle_id: str = "", about: dict | None = None) -> dict[str, Callable[[], DataFrame]]:
    """What builds each of the derived tables, by name. Selected measurements restrict the rows given out; series and references are those of the whole bundle."""
    about, c, q, ops = about or {}, settings["db_chatty"], settings["data_quality"], settings["operations"]
    calls, events, linked = saved["call_observations"], saved["events"], saved["event_links"]
    all_ids = sorted(r.measurement_id for r in events.select("measurement_id").distinct().collect())  # one row per measurement
    chosen = settings["measurement_ids"]
    config.need(not set(chosen or []) - set(all_ids), f"unknown measurement_ids: {sorted(set(chosen or []) - set(all_ids))}")
    config.need(ops["measurement_order"] is None or sorted(ops["measurement_order"]) == all_ids, "operations.measurement_order must list every measurement of the bundle once")
    baseline = ops["series_baseline_measurement_id"]
    config.need(baseline is None or baseline in all_ids, "operations.series_baseline_measurement_id isn't in the bundle")
    for rule in settings["problems"]["rules"]:
        for column, names in (("signature", rule.signatures), ("user", rule.users)):
            missing = set(names or ()) - {r[0] for r in calls.where(F.col(column).isin(*(names or [""]))).select(column).distinct().collect()}
            config.need(not missing, f"rule {rule.rule_id}: unknown {column} {sorted(missing)}")
    times = events.groupBy("measurement_id").agg(F.min("end_us").alias("first_us"))
    order = kept(series.measurements(calls, times, ops["measurement_order"], baseline))
    issues = saved["parse_issues"].groupBy("dataset_id").agg(F.count("*").alias("parse_errors"))
    health = kept(quality.data_quality(calls, linked, events, saved["files"], issues, q["min_call_count"], q["db_linkage_warning_percent"], order, tuple(about.get("warnings", ()))))
    history = kept(series.history(calls, False, order, health))
    thresholds = sorted({*c["thresholds"], *(r.db_events_threshold for r in settings["problems"]["rules"] if r.db_events_threshold)})
    profiles = kept(chatty.full(calls, history, thresholds, c["fast_us"]))
    asked = F.col("threshold_db_events").isin(*c["thresholds"])
    within = (lambda rows, column="measurement_id": rows.where(F.col(column).isin(*chosen))) if chosen is not None else (lambda rows, column="measurement_id": rows)
    targets = goals(spark, settings, calls)
    failures = settings["apdex"]["confirmed_failures"]
    config.need(failures["bundle_id"] in (None, bundle_id), "apdex.confirmed_failures.bundle_id isn't this bundle")
    failed = spark.createDataFrame([(i,) for i in failures["calls"]], "call_id long")
    if unknown := [r.call_id for r in failed.join(calls.select("call_id"), "call_id", "left_anti").collect()]:
        raise config.ConfigError(f"confirmed failures of unknown calls: {sorted(unknown)}")
    least = settings["apdex"]["min_call_count"]
    classified = apdex.classified(calls, targets, failed)
    scored = kept(apdex.groups(classified, history, targets, least))
    rules = settings["problems"]["rules"] or [problems.Rule("none", "operation.count", ">", 0, 1, users=("no user of that name \0",))]
    values = kept(problems.evaluate(rules, history, profiles, scored))
    story = kept(problems.history(values).withColumn("series_id", F.lit(settings["problems"]["series_id"]).cast("string")))
    changed = series.comparisons(history, ops["min_comparison_count"])
    return {
        "data_quality": lambda: within(health), "operation_history": lambda: within(history), "operation_history_all_users": lambda: within(series.history(calls, True, order, health)),
        "measurement_comparisons": lambda: within(changed, "current_measurement_id"), "comparability": lambda: within(series.comparability(history, ops["min_comparison_count"]), "current_measurement_id"),
        "db_chatty": lambda: within(profiles.where(asked)), "db_chatty_calls": lambda: chatty.chatty_calls(within(calls), c["thresholds"], c["fast_us"], c["bounds_us"]),
        "db_chatty_fast_calls": lambda: chatty.chatty_calls(within(calls), c["thresholds"], c["fast_us"], c["bounds_us"]).where("is_fast_call"),
        "db_chatty_duration": lambda: chatty.durations(within(calls), c["thresholds"], c["bounds_us"]), "db_chatty_coverage": lambda: chatty.coverage(within(calls), c["thresholds"], c["fast_us"]),
        "db_chatty_changes": lambda: within(chatty.chatty_changes(profiles.where(asked)), "current_measurement_id"),
        "apdex": lambda: within(scored), "apdex_uncovered": lambda: within(apdex.uncovered(scored)), "apdex_coverage": lambda: apdex.coverage(within(classified)), "apdex_overall": lambda: apdex.overall(within(classified), least),
        "apdex_calls": lambda: within(classified).where("t_us is not null").select("call_id", "signature", "user", "measurement_id", "duration_us", *apdex.TARGET, "latency_category", "category", "confirmed_failure", F.col("error_count").alias("linked_error_count")),
        "apdex_composition": lambda: apdex.composition(within(classified), apdex.overall(within(classified), least)), "apdex_changes": lambda: within(apdex.apdex_changes(scored), "current_measurement_id"),
        "problem_history": lambda: within(story), "problem_registry": lambda: problems.registry(story), "problem_new": lambda: within(problems.new(story)), "problem_persisting": lambda: problems.persisting(story), "problem_unchecked": lambda: problems.unchecked(story),
        "problem_improved": lambda: within(problems.moved(story, "decreased")), "problem_worsened": lambda: within(problems.moved(story, "increased")), "problem_rule_coverage": lambda: within(problems.rule_coverage(values)),
    }


def natural(rows: DataFrame) -> list[Column]:
    """Order of a table in a CSV file: by its keys, as far as it has them, then by all that can be compared."""
    keys = ["measurement_id", "current_measurement_id", "measurement_order", "rule_id", "signature", "user", "dataset_id", "threshold_db_events", "duration_band_index", "comparison_basis", "call_id", "event_id"]
    plain = [n for n, t in rows.dtypes if not t.startswith(("map", "array", "struct"))]
    return [F.col(c).asc_nulls_last() for c in [*(k for k in keys if k in plain), *(c for c in plain if c not in keys)]]


def basic_checks(saved: dict[str, DataFrame]) -> list[DataFrame]:
    calls, links = saved["call_observations"], saved["event_links"]
    keys = {
        "call_observations": ["call_id"], "events": ["event_id"], "files": ["locator", "path"], "operations": A.OPERATION, "operations_by_dataset": [*A.OPERATION, "dataset_id"], "heavy_sql": ["measurement_id", "sql_pattern"], "sql_texts": ["sql_text"],
        "locks": ["measurement_id", "event_type", "context"], "errors": ["measurement_id", "event_type", "signature_id"], "error_incidents": ["incident_id"], "linkage": ["dataset_id", "measurement_id"], "datasets": ["dataset_id"], "link_decisions": ["event_id"],
    }
    out = [verify.unique(saved[name], columns, name) for name, columns in keys.items()]
    out += [verify.reconciled(calls, saved[name], name) for name in ("operations", "operations_by_dataset")]
    out.append(verify.count("owner_is_no_call", links.where("parent_call_id is not null").join(calls.select(F.col("call_id").alias("parent_call_id")), "parent_call_id", "left_anti")))
    return out


def full_checks(saved: dict[str, DataFrame]) -> list[DataFrame]:
    """Everything that can be computed from the saved events again, against what was saved."""
    events, calls, linked, failed = (saved[n] for n in ("events", "call_observations", "event_links", "error_events"))
    own, others = events.where("event_type = 'CALL'"), events.where("event_type <> 'CALL'")
    decided = linking.decide(others, linking.candidates(others, own))
    texts = sqlnorm.dictionary(events.where("event_type = 'DBPOSTGRS'"))
    return [
        *verify.event_store(events, saved["files"]), verify.links(saved["link_decisions"], saved["link_candidates"], own, True), verify.same("link_decisions", saved["link_decisions"], decided),
        verify.same("sql_texts", saved["sql_texts"], texts), verify.same("call_observations", saved["call_observations"].drop("from_partial_source"), A.observations(events, linked)),
        verify.same("operations", saved["operations"], A.operations(calls)), verify.same("heavy_sql", saved["heavy_sql"], A.sql_groups(linked, texts)), verify.same("locks", saved["locks"], A.lock_groups(linked)),
        verify.same("linkage", saved["linkage"], A.linkage(events, linked)), verify.same("event_stats", saved["event_stats"], A.event_stats(events)),
        verify.same("errors", saved["errors"], A.error_groups(failed)), verify.same("error_incidents", saved["error_incidents"], A.incidents(failed)), verify.same("error_summary", saved["error_summary"], A.error_summary(failed)),
        *verify.error_store(failed, linked),
    ]


def checks(saved: dict[str, DataFrame], level: str = "full") -> list[DataFrame]:
    """Checks to be run one after another: one plan of all would be larger than the driver can hold."""
    return basic_checks(saved) + (full_checks(saved) if level == "full" else [])


def settings_of(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze")
    a.add_argument("input_dir")
    a.add_argument("-o", "--output-dir", required=True)
    a.add_argument("--archive-mode", choices=["auto", "always", "never"], default="auto")
    a.add_argument("--exclude-dir", action="append", default=[])
    a.add_argument("--salvage-nul-prefix", action="store_true")
    a.add_argument("--source-map")
    a.add_argument("--capture-id")
    a.add_argument("--top-calls", type=int, default=200)
    d = commands.add_parser("derive")
    d.add_argument("--analysis-dir", required=True)
    d.add_argument("--config", required=True)
    d.add_argument("--output-dir", required=True)
    d.add_argument("--slices", nargs="*")
    v = commands.add_parser("verify")
    v.add_argument("--analysis-dir", required=True)
    v.add_argument("--slices-dir")
    v.add_argument("--level", choices=["basic", "full"], default="full")
    r = commands.add_parser("report")
    r.add_argument("--analysis-dir", required=True)
    r.add_argument("--slices-dir", required=True)
    r.add_argument("--config", required=True)
    r.add_argument("--output-dir", required=True)
    for p in (a, d, r):
        p.add_argument("--csv", action="store_true")
        p.add_argument("--progress", action="store_true")
        p.add_argument("--overwrite", action="store_true")
    commands.add_parser("slices")
    return top


def run(args: argparse.Namespace) -> int:
    if args.command == "slices":
        print("\n".join(config.SLICES))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "analyze":
        writer = bundle.Writer(spark, args.output_dir, args.overwrite, args.progress)
        mapped = settings_of(spark, args.source_map) if args.source_map else None
        about = analyze(spark, args.input_dir, writer, args.archive_mode, args.salvage_nul_prefix, tuple(args.exclude_dir), args.capture_id, mapped, args.top_calls)
        if args.csv:
            for name in ("operations", "heavy_sql", "locks", "errors", "linkage", "datasets", "files", "identical_operations", "top_calls", "error_incidents", "call_observations"):
                rows = spark.read.parquet(f"{writer.stage}/{name}")
                writer.csv(name, rows, natural(rows))
        print(writer.commit(about))
        return 0
    told = bundle.manifest(spark, args.analysis_dir)
    if args.command == "derive":
        raw = settings_of(spark, args.config)
        settings = config.load(raw if not args.slices else json.dumps(config.strict_json(raw) | {"slices": args.slices}))
        saved = bundle.load(spark, args.analysis_dir, settings["expected_bundle_id"])
        writer = bundle.Writer(spark, args.output_dir, args.overwrite, args.progress)
        built = derive(spark, saved, settings, told["bundle_id"], told["about"])
        for name in settings["slices"]:
            rows = writer.put(name, built[name]())
            if args.csv:
                writer.csv(name, rows, natural(rows))
        bundle.load(spark, args.analysis_dir, told["bundle_id"])  # the input is still what it was
        print(writer.commit({"bundle_id": told["bundle_id"], "slices": settings["slices"], "configuration": raw}))
        return 0
    saved = bundle.load(spark, args.analysis_dir)
    if args.command == "report":
        about = bundle.manifest(spark, args.slices_dir)["about"]
        config.need(about.get("bundle_id") == told["bundle_id"], "the slices are of another bundle")
        settings = report.load(settings_of(spark, args.config))
        writer = bundle.Writer(spark, args.output_dir, args.overwrite, args.progress)
        for name, rows in report.build(settings, saved, bundle.load(spark, args.slices_dir), told).items():
            writer.put(name, rows)
            if args.csv:
                writer.csv(name, rows, [])
        print(writer.commit({"bundle_id": told["bundle_id"], "sections": settings["sections"], "title": settings["title"]}))
        return 0
    found, wrong = checks(saved, args.level), []
    if args.slices_dir:
        bundle.load(spark, args.slices_dir)
        about = bundle.manifest(spark, args.slices_dir)["about"]
        config.need(about.get("bundle_id") == told["bundle_id"], "the slices are of another bundle")
        settings = config.load(about["configuration"])
        built = derive(spark, saved, settings, told["bundle_id"], told["about"])
        again = bundle.Writer(spark, f"{args.slices_dir.rstrip('/')}.again", True)
        for name, was in bundle.manifest(spark, args.slices_dir)["tables"].items():
            again.put(name, built[name]())
            wrong += [(f"slice_{name}", 1)] * (again.told[name] != was)
        again.discard()
    bad = wrong + [(row.check, row.violations) for check in found for row in check.where("violations > 0").collect()]
    for name, violations in bad:
        print(name, violations)
    return BAD_INPUT if bad else 0


def main(argv: list[str]) -> int:
    try:
        return run(parser().parse_args(argv))
    except NoLogs as error:
        print(f"{error}: no valid log", file=sys.stderr)
        return NO_LOGS
    except FileExistsError as error:
        print(f"{error} exists", file=sys.stderr)
        return NOT_EMPTY
    except (config.ConfigError, ValueError) as error:
        print(error, file=sys.stderr)
        return BAD_INPUT


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
