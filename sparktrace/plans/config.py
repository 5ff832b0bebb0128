"""Configuration of the derived tables: strict JSON, closed schema, exact microseconds."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from typing import Any

from sparktrace.operators.problems import Rule

#: Sections, keys and defaults of the configuration, the tables that can be asked for, target statuses and failure policies.
SECTIONS = {
    "config_version": "1.0", "slices": ["data_quality"], "measurement_ids": None, "expected_bundle_id": None,
    "data_quality": {"min_call_count": 10, "db_linkage_warning_percent": 99},
    "operations": {"series_baseline_measurement_id": None, "measurement_order": None, "min_comparison_count": 10},
    "db_chatty": {"thresholds": [100, 500, 1000, 5000], "duration_bounds_seconds": [1, 5, 10, 30], "fast_call_max_seconds": 1},
    "apdex": {"targets": [], "classes": [], "min_call_count": 10, "failure_policy": "latency_only", "confirmed_failures": {}},
    "problems": {"series_id": None, "rules": []},
}
SLICES = (
    "data_quality", "operation_history", "operation_history_all_users", "measurement_comparisons", "comparability", "db_chatty", "db_chatty_calls", "db_chatty_fast_calls", "db_chatty_duration", "db_chatty_coverage", "db_chatty_changes",
    "apdex", "apdex_calls", "apdex_uncovered", "apdex_coverage", "apdex_overall", "apdex_composition", "apdex_changes",
    "problem_registry", "problem_history", "problem_improved", "problem_persisting", "problem_worsened", "problem_new", "problem_unchecked", "problem_rule_coverage",
)
STATUSES = ("business_approved", "engineering_proposal")
POLICIES = ("latency_only", "confirmed_failures_frustrated")
MOST_SECONDS = 9_007_199_254


class ConfigError(ValueError):
    pass


def need(good: bool, message: str) -> None:
    if not good:
        raise ConfigError(message)


def microseconds(seconds: Any, label: str = "seconds") -> int:
    """Seconds to microseconds, exactly and back again."""
    need(type(seconds) in (int, float) and math.isfinite(seconds) and 0 <= seconds <= MOST_SECONDS, f"{label}: {seconds!r} isn't a number of seconds")
    us = Decimal(str(seconds)) * 1_000_000
    need(us == us.to_integral_value() and Decimal(str(int(us) / 1_000_000)) * 1_000_000 == us, f"{label}: {seconds!r} isn't a whole number of microseconds")
    return int(us)


def _pairs(pairs: list[tuple[str, Any]]) -> dict:
    need(len({k for k, _ in pairs}) == len(pairs), "a key is there twice")
    return dict(pairs)


def _constant(name: str) -> None:
    raise ConfigError(f"{name} isn't a number")


def _finite(text: str) -> float:
    need(math.isfinite(float(text)), f"{text} isn't a finite number")
    return float(text)


def strict_json(text: str) -> Any:
    """JSON without repeated keys, NaN and infinity; a byte order mark is passed over."""
    try:
        return json.loads(text.removeprefix("\ufeff"), object_pairs_hook=_pairs, parse_constant=_constant, parse_float=_finite)
    except json.JSONDecodeError as error:
        raise ConfigError(str(error)) from None


def names(value: Any, label: str) -> list[str]:
    need(isinstance(value, list) and bool(value) and all(isinstance(x, str) and x for x in value) and len(set(value)) == len(value), f"{label}: a list of different names is needed")
    return value


def whole(value: Any, label: str) -> int:
    need(type(value) is int and value >= 1, f"{label}: a positive whole number is needed")
    return value


def text_of(value: Any, label: str) -> str:
    need(isinstance(value, str) and bool(value.strip()), f"{label}: a text is needed")
    return value


def digest_or_none(value: Any, label: str) -> str | None:
    need(value is None or (isinstance(value, str) and bool(re.fullmatch("[0-9a-f]{64}", value))), f"{label}: a lower-case SHA-256 or null is needed")
    return value


def apdex_of(given: dict) -> dict:
    """Targets and classes with exact microseconds; a signature may be in one class only."""
    whole(given["min_call_count"], "apdex.min_call_count")
    need(given["failure_policy"] in POLICIES, f"apdex.failure_policy: one of {POLICIES}")
    out = {"min_call_count": given["min_call_count"], "failure_policy": given["failure_policy"]}
    for kind, name in (("targets", "signature"), ("classes", "class_id")):
        keys = {name, "t_seconds", "status", "source"} | ({"signatures"} if kind == "classes" else set())
        need(isinstance(given[kind], list) and all(isinstance(x, dict) and set(x) == keys for x in given[kind]), f"apdex.{kind}: entries have exactly {sorted(keys)}")
        rows = []
        for entry in given[kind]:
            need(entry["status"] in STATUSES, f"apdex.{kind}: status is one of {STATUSES}")
            us = microseconds(entry["t_seconds"], f"apdex.{kind}.t_seconds")
            need(us > 0, f"apdex.{kind}: t_seconds must be positive")
            row = {name: text_of(entry[name], f"apdex.{kind}.{name}"), "t_us": us, "status": entry["status"], "source": text_of(entry["source"], f"apdex.{kind}.source")}
            rows.append(row | ({"signatures": [text_of(s, "apdex class signature") for s in names(entry["signatures"], "apdex.classes.signatures")]} if kind == "classes" else {}))
        need(len({r[name] for r in rows}) == len(rows), f"apdex.{kind}: {name} is there twice")
        out[kind] = rows
    members = [s for c in out["classes"] for s in c["signatures"]]
    need(len(set(members)) == len(members), "apdex.classes: a signature is in two classes")
    failures = given["confirmed_failures"]
    need(isinstance(failures, dict) and not set(failures) - {"bundle_id", "calls"} and isinstance(failures.get("calls", []), list), "apdex.confirmed_failures: bundle_id and calls")
    calls = failures.get("calls", [])
    need(all(isinstance(c, dict) and set(c) == {"call_id", "evidence"} and type(c["call_id"]) is int and c["call_id"] >= 1 for c in calls), "apdex.confirmed_failures.calls: call_id and evidence")
    need(len({c["call_id"] for c in calls}) == len(calls) and all(text_of(c["evidence"], "evidence") for c in calls), "apdex.confirmed_failures.calls: a call is there twice")
    bundle = digest_or_none(failures.get("bundle_id"), "apdex.confirmed_failures.bundle_id")
    need(not calls or (bundle is not None and out["failure_policy"] == POLICIES[1]), f"confirmed failures need bundle_id and failure_policy {POLICIES[1]}")
    return out | {"confirmed_failures": {"bundle_id": bundle, "calls": [c["call_id"] for c in calls]}}


def rules_of(given: dict) -> dict:
    need(given["series_id"] is None or bool(text_of(given["series_id"], "problems.series_id")), "problems.series_id")
    need(isinstance(given["rules"], list) and all(isinstance(r, dict) for r in given["rules"]), "problems.rules: a list of rules is needed")
    need(not given["rules"] or given["series_id"] is not None, "problems.series_id names the problems of a series")
    rules = []
    for r in given["rules"]:
        missing = {"rule_id", "metric", "operator", "threshold", "min_call_count", "source"} - set(r)
        need(not missing, f"problem rule: {sorted(missing)} are missing")
        need(not str(r["metric"]).startswith("db_chatty.") or r.get("db_events_threshold") != 0, "db_events_threshold must be positive")
        for k in ("signatures", "users"):
            if r.get(k) is not None:
                names(r[k], f"problem rule {k}")
        try:
            rules.append(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}))
        except (TypeError, ValueError) as error:
            raise ConfigError(f"problems: {error}") from None
    need(len({r.rule_id for r in rules}) == len(rules), "problems.rules: a rule_id is there twice")
    return {"series_id": given["series_id"], "rules": sorted(rules, key=lambda r: r.rule_id)}


def load(text: str) -> dict:
    """Checked configuration with defaults filled in; unknown keys, repeated keys, NaN and infinity are errors."""
    raw = strict_json(text)
    need(isinstance(raw, dict) and raw.get("config_version") == "1.0", "config_version must be 1.0")
    need(not set(raw) - set(SECTIONS), f"unknown keys {sorted(set(raw) - set(SECTIONS))}")
    out = {}
    for section, default in SECTIONS.items():
        given = raw.get(section, default)
        if isinstance(default, dict):
            need(isinstance(given, dict) and not set(given) - set(default), f"{section}: unknown keys or no object")
            given = default | given
        out[section] = given
    out["slices"] = sorted(names(out["slices"], "slices"))
    need(not set(out["slices"]) - set(SLICES), f"unknown tables {sorted(set(out['slices']) - set(SLICES))}")
    if "apdex_overall" in out["slices"]:
        out["slices"] = sorted({*out["slices"], "apdex_composition"})
    if out["measurement_ids"] is not None:
        names(out["measurement_ids"], "measurement_ids")
    digest_or_none(out["expected_bundle_id"], "expected_bundle_id")
    whole(out["data_quality"]["min_call_count"], "data_quality.min_call_count")
    percent = out["data_quality"]["db_linkage_warning_percent"]
    need(type(percent) in (int, float) and 0 <= percent <= 100, "data_quality.db_linkage_warning_percent: from 0 to 100")
    ops = out["operations"]
    whole(ops["min_comparison_count"], "operations.min_comparison_count")
    need(ops["series_baseline_measurement_id"] is None or bool(text_of(ops["series_baseline_measurement_id"], "operations.series_baseline_measurement_id")), "operations")
    if ops["measurement_order"] is not None:
        names(ops["measurement_order"], "operations.measurement_order")
    chatty = out["db_chatty"]
    for key in ("thresholds", "duration_bounds_seconds"):
        need(isinstance(chatty[key], list) and bool(chatty[key]) and len(set(chatty[key])) == len(chatty[key]), f"db_chatty.{key}: a list of different numbers is needed")
    need(all(type(t) is int and t > 0 for t in chatty["thresholds"]), "db_chatty.thresholds: positive whole numbers are needed")
    chatty["thresholds"] = sorted(chatty["thresholds"])
    chatty["bounds_us"] = sorted(microseconds(s, "db_chatty.duration_bounds_seconds") for s in chatty["duration_bounds_seconds"])
    need(all(chatty["bounds_us"]), "db_chatty.duration_bounds_seconds: positive bounds are needed")
    chatty["fast_us"] = microseconds(chatty["fast_call_max_seconds"], "db_chatty.fast_call_max_seconds")
    out["apdex"], out["problems"] = apdex_of(out["apdex"]), rules_of(out["problems"])
    return out
