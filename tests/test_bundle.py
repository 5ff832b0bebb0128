import json

import pytest
from pyspark.sql import functions as F

from sparktrace.operators import problems, report
from sparktrace.plans import bundle, cli, config

RULE = {"rule_id": "r", "metric": "operation.avg_us", "operator": ">", "threshold": 1, "min_call_count": 1, "source": "team"}
TARGET = {"signature": "Op 1", "t_seconds": 1.5, "status": "business_approved", "source": "team"}
CLASS = {"class_id": "c", "signatures": ["Op 1", "Op 2"], "t_seconds": 2, "status": "engineering_proposal", "source": "team"}


def made(**more):
    return json.dumps({"config_version": "1.0"} | more)


def test_config():
    got = config.load(made(slices=["operation_history", "data_quality"], db_chatty={"fast_call_max_seconds": 0.000001, "thresholds": [5, 2]}))
    assert got["db_chatty"]["fast_us"] == 1 and got["db_chatty"]["bounds_us"][0] == 1_000_000 and got["slices"] == ["data_quality", "operation_history"] and got["db_chatty"]["thresholds"] == [2, 5]
    got = config.load(made(problems={"series_id": "s", "rules": [RULE]}, apdex={"targets": [TARGET], "classes": [CLASS]}, slices=["apdex_overall"]))
    assert got["problems"]["rules"][0].metric == "operation.avg_us" and got["apdex"]["targets"][0]["t_us"] == 1_500_000 and got["slices"] == ["apdex_composition", "apdex_overall"]


BAD = [
    made(x=1), '{"config_version": "1.0", "config_version": "1.0"}', '{"config_version": "1.0", "db_chatty": {"thresholds": [NaN]}}', '{"config_version": "1.0", "data_quality": {"db_linkage_warning_percent": 1e999}}', '{"config_version": "2"}', "[", made(apdex={"other": 1}),
    made(db_chatty={"fast_call_max_seconds": 0.0000001}), made(db_chatty={"thresholds": [3, 3]}), made(db_chatty={"thresholds": [0]}), made(db_chatty={"duration_bounds_seconds": []}), made(slices=["none"]), made(slices=[]), made(measurement_ids=["a", "a"]), made(measurement_ids=[]),
    made(expected_bundle_id="A"), made(data_quality={"min_call_count": 0}), made(data_quality={"min_call_count": True}), made(operations={"measurement_order": []}), made(operations={"min_comparison_count": 1.5}),
    made(problems={"rules": [RULE]}), made(problems={"series_id": " ", "rules": []}), *[made(problems={"series_id": "s", "rules": rules}) for rules in (
        [RULE | {"operator": "<"}], [RULE, RULE], [RULE | {"metric": "operation.nothing"}], [RULE | {"metric": "apdex.deficit", "threshold": 2}], [RULE | {"metric": "db_chatty.db_count_sum"}], [RULE | {"db_events_threshold": 3}], [RULE | {"threshold": -1}],
        [RULE | {"min_db_linked_count_percent": 3}], [RULE | {"scope": "all"}], [RULE | {"users": []}], [RULE | {"source": ""}], [{k: v for k, v in RULE.items() if k != "source"}], [RULE | {"more": 1}], [RULE | {"require_clean_sources": 1}], [RULE | {"min_call_count": 0}])],
    *[made(apdex=a) for a in (
        {"targets": [TARGET, TARGET]}, {"targets": [TARGET | {"t_seconds": 0}]}, {"targets": [TARGET | {"status": "x"}]}, {"targets": [TARGET | {"more": 1}]}, {"classes": [CLASS, CLASS | {"class_id": "d"}]}, {"classes": [CLASS | {"signatures": []}]}, {"min_call_count": 0},
        {"failure_policy": "x"}, {"confirmed_failures": {"calls": [{"call_id": 1, "evidence": "e"}]}}, {"confirmed_failures": {"bundle_id": "x"}}, {"failure_policy": "confirmed_failures_frustrated", "confirmed_failures": {"bundle_id": "0" * 64, "calls": [{"call_id": 1, "evidence": ""}]}})],
]


@pytest.mark.parametrize("text", BAD)
def test_what_configurations_may_not_say(text):
    with pytest.raises(config.ConfigError):
        config.load(text)


def test_units():
    assert [problems.unit(m) for m in ("operation.avg_us", "operation.cpu_percent_of_wall", "operation.out_bytes_sum", "operation.memory_peak_max", "operation.db_seconds_per_call", "operation.db_per_call", "operation.count", "apdex.deficit", "apdex.frustrated_count")] == [
        "microseconds", "percent", "bytes", "bytes", "seconds_per_CALL", "DB_events_per_CALL", "count", "1_minus_APDEX", "CALL_count"]


def logs(folder):
    own = folder / "cap" / "rphost_1"
    own.mkdir(parents=True)
    lines = []
    for i in range(40):
        lines.append(f"{i:02}:10.000000-{(1 + i % 3) * 1000000},CALL,1,Usr=U{i % 2},OSThread=7,SessionID=A,CpuTime={i * 1000},Context=Op {i % 4}")
        lines += [f"{i:02}:09.9{j}0000-500,DBPOSTGRS,3,Usr=U{i % 2},OSThread=7,SessionID=A,RowsAffected={j},Sql='SELECT a FROM t{j} WHERE x = {i}'" for j in range(i % 3)]
        lines += [f"{i:02}:09.800000-5,SDBL,3,Usr=U{i % 2},OSThread=7,SessionID=A"] * (i % 2)
    errors = [f"41:0{i}.000000-0,EXCP,2,Usr=U0,OSThread=7,SessionID=A,Context=Op 9,Descr='Ошибка выполнения запроса:\nbad {100 + i // 2}'" for i in range(4)]
    errors += [f"42:0{i}.000000-0,EXCP,2,Usr=U0,OSThread=7,SessionID=A,Func=f,Descr='no context'" for i in range(2)]
    errors += ["41:10.000000-20000000,CALL,1,Usr=U0,OSThread=7,SessionID=A,Context=Op 9", "42:10.000000-20000000,CALL,1,Usr=U0,OSThread=7,SessionID=A,Context=Op 9", "42:11.000000-3,TLOCK,1,Usr=U0,OSThread=7,SessionID=A,Func=g", "42:11.000000-abc,CALL,1,Usr=U0"]
    for day in ("01", "02", "03"):
        (own / f"2609{day}10.log").write_text("\n".join(lines + errors * (day == "01")) + "\n")


@pytest.fixture(scope="module")
def analysed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("analysed")
    logs(folder / "logs")
    out = str(folder / "bundle")
    assert cli.main(["analyze", str(folder / "logs"), "-o", out, "--csv", "--progress"]) == 0
    assert cli.main(["analyze", str(folder / "logs"), "-o", out]) == cli.NOT_EMPTY
    return out


def test_analysis(spark, analysed, capsys):
    saved = bundle.load(spark, analysed)
    assert cli.main(["verify", "--analysis-dir", analysed]) == 0, capsys.readouterr().out
    assert saved["call_observations"].count() == 122 and saved["operations"].count() == 13
    assert saved["heavy_sql"].count() == 6 and saved["call_observations"].agg({"db_count": "sum"}).first()[0] == 117 and saved["call_observations"].agg({"sdbl_count": "sum"}).first()[0] == 60
    assert {(r.error_signature, r.event_count, r.suspected_incident_count) for r in saved["errors"].collect()} == {("Ошибка выполнения запроса: bad #", 4, 2), ("no context", 2, 2)}
    assert [r.context for r in saved["locks"].collect()] == ["(context unavailable)"]
    nine = saved["operations"].where("signature = 'Op 9'").first()
    assert (nine["count"], nine.error_count, nine.context_sample) == (2, 6, "Op 9") and nine.sdbl_count == 0
    assert saved["datasets"].select("files", "records").first() == (3, 427) or saved["datasets"].first().files == 3
    text = open(f"{analysed}/csv/operations.csv", encoding="utf-8").read()
    assert text.startswith('\ufeff"measurement_id","user"') and text.count("\n") == 14 and "\r" not in text
    told = bundle.manifest(spark, analysed)["about"]
    assert told["analysis_complete"] and told["warnings"] == []


def test_derived_tables(spark, analysed, tmp_path, capsys):
    conf, out = tmp_path / "c.json", str(tmp_path / "slices")
    calls = bundle.load(spark, analysed)["call_observations"]
    failed = calls.orderBy("call_id").first().call_id
    told = bundle.manifest(spark, analysed)["bundle_id"]
    days = [f"cap@2026-09-0{d}" for d in (3, 1, 2)]
    settings = {
        "slices": list(config.SLICES), "measurement_ids": days[:2], "operations": {"measurement_order": days, "min_comparison_count": 1}, "db_chatty": {"thresholds": [1]}, "expected_bundle_id": told,
        "apdex": {"targets": [TARGET], "classes": [CLASS], "min_call_count": 1, "failure_policy": "confirmed_failures_frustrated", "confirmed_failures": {"bundle_id": told, "calls": [{"call_id": failed, "evidence": "seen"}]}},
        "problems": {"series_id": "s", "rules": [RULE | {"threshold": 1_900_000}, RULE | {"rule_id": "d", "metric": "db_chatty.calls_above_threshold_percent", "db_events_threshold": 1, "users": ["U0"]}]},
    }
    conf.write_text(made(**settings))
    assert cli.main(["derive", "--analysis-dir", analysed, "--config", str(conf), "--output-dir", out, "--csv"]) == 0, capsys.readouterr().err
    got = bundle.load(spark, out)
    assert set(got) == set(config.SLICES)
    history = got["operation_history"]
    assert {r.measurement_id for r in history.collect()} == set(days[:2])
    assert {(r.measurement_id, r.measurement_order, r.order_basis) for r in history.collect()} == {(days[0], 1, "explicit_configured_order"), (days[1], 2, "explicit_configured_order")}
    assert got["apdex_coverage"].where("measurement_id is null").first().total_call_count == 82
    assert {r.target_kind for r in got["apdex"].collect()} == {"operation", "explicit_class", None}
    assert got["apdex_calls"].where("confirmed_failure").count() == (1 if calls.where(F.col("call_id") == failed).first().signature in ("Op 1", "Op 2") else 0)
    assert {r.rule_id for r in got["problem_rule_coverage"].collect()} == {"d", "r"} and got["problem_history"].where("rule_id = 'd' and user <> 'U0'").count() == 0
    assert cli.main(["verify", "--analysis-dir", analysed, "--slices-dir", out, "--level", "basic"]) == 0, capsys.readouterr().out
    back = bundle.read_csv(spark, f"{out}/csv/db_chatty_coverage.csv", ", ".join(f"`{n}` {t}" for n, t in got["db_chatty_coverage"].dtypes))
    assert back.exceptAll(got["db_chatty_coverage"]).count() == 0 and back.count() == got["db_chatty_coverage"].count()
    with pytest.raises(ValueError, match="columns"):
        bundle.read_csv(spark, f"{out}/csv/db_chatty_coverage.csv", "a string")
    for wrong in ({"measurement_ids": ["no@day"]}, {"operations": {"measurement_order": days[:2]}}, {"operations": {"series_baseline_measurement_id": "no@day"}}, {"apdex": {"targets": [TARGET | {"signature": "never seen"}]}},
                  {"problems": {"series_id": "s", "rules": [RULE | {"users": ["nobody"]}]}}, {"expected_bundle_id": "0" * 64},
                  {"apdex": {"failure_policy": "confirmed_failures_frustrated", "confirmed_failures": {"bundle_id": told, "calls": [{"call_id": 1, "evidence": "e"}]}}}):
        conf.write_text(made(**wrong))
        assert cli.main(["derive", "--analysis-dir", analysed, "--config", str(conf), "--output-dir", str(tmp_path / "no")]) == cli.BAD_INPUT
    show = {"report_config_version": "1.0", "report_kind": "overview", "title": "T", "locale": "ru-RU", "sections": list(report.SECTIONS), "display_measurement_ids": days[:1], "tables": {"operations": {"top_n": 2, "sort": [{"field": "max_us", "direction": "desc"}]}, "operation_history_all_users": {"top_n": 1}}}
    conf.write_text(json.dumps(show))
    assert cli.main(["report", "--analysis-dir", analysed, "--slices-dir", out, "--config", str(conf), "--output-dir", str(tmp_path / "report")]) == 0, capsys.readouterr().err
    shown = bundle.load(spark, str(tmp_path / "report"))
    assert {n.split("__")[0] for n in shown} == {*report.SECTIONS, "units"}
    assert [r.measurement_id for r in shown["operations__operations"].collect()] == days[:1] * 2 and shown["operations_all_users__operation_history_all_users"].count() == 1
    assert shown["comparisons__joined"].count() == shown["comparisons__measurement_comparisons"].count() > 0
    assert {r.unit for r in shown["units"].where("field = 'max_us'").collect()} == {"us"}


def test_tampered_events_are_seen(spark, analysed, tmp_path, capsys):
    saved = bundle.load(spark, analysed)
    events = saved["events"].withColumn("raw_record_sha256", F.when(F.col("byte_start") == 0, F.lit("0" * 64)).otherwise(F.col("raw_record_sha256")))
    calls = saved["call_observations"].withColumn("db_count", F.col("db_count") + (F.col("signature") == "Op 9").cast("long"))
    bundle.save(spark, saved | {"events": events, "call_observations": calls}, str(tmp_path / "b"), about={"analysis_complete": True})
    assert cli.main(["verify", "--analysis-dir", str(tmp_path / "b")]) == cli.BAD_INPUT
    told = capsys.readouterr().out
    assert "event_identity 3" in told and "operations_reconcile" in told and "call_observations" in told


def test_no_logs(tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.log").write_text("no head")
    assert cli.main(["analyze", str(tmp_path / "none"), "-o", str(tmp_path / "x")]) == cli.NO_LOGS


@pytest.mark.parametrize("bad", [{"report_kind": "x"}, {"locale": "en"}, {"title": ""}, {"sections": ["none"]}, {"tables": {"none": {}}}, {"tables": {"errors": {"top_n": 0}}}, {"tables": {"errors": {"sort": [{"field": "a"}]}}}, {"more": 1}, {"display_measurement_ids": []}])
def test_report_settings(bad):
    good = {"report_config_version": "1.0", "report_kind": "overview", "title": "T", "locale": "ru-RU"}
    assert report.load(json.dumps(good))["sections"] == report.DEFAULTS["overview"]
    with pytest.raises(config.ConfigError):
        report.load(json.dumps(good | bad))


def test_one_to_one_refuses_repeats(spark):
    left, right = spark.range(3).withColumn("a", F.lit(1)), spark.range(3).withColumn("b", F.lit(2))
    assert report.one_to_one(left, right, ["id"]).count() == 3
    for wrong in (right.union(right.limit(1)), right.where("id > 0")):
        with pytest.raises(Exception, match="join key"):
            report.one_to_one(left, wrong, ["id"]).collect()


def test_missing_reasons(spark):
    rows = spark.createDataFrame([("not_observed", "", None, None), ("observed", "no_reference", None, None), ("observed", "earlier", None, 1.0)], "observation_status string, reference_relation string, x_delta_absolute double, y double")
    got = [r.missing_reasons for r in report.presented(rows).collect()]
    assert got[0] == {"x_delta_absolute": "нет наблюдений", "y": "нет наблюдений"} and got[1] == {"x_delta_absolute": "база сравнения отсутствует", "y": "показатель недоступен"} and got[2] == {"x_delta_absolute": "показатель недоступен"}


def test_tampering_is_seen(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "map('k', id) m", "array(id) a")
    made = bundle.save(spark, {"t": rows}, str(tmp_path / "b"))
    assert bundle.save(spark, {"t": rows.orderBy("id", ascending=False)}, str(tmp_path / "b"), overwrite=True) == made
    bundle.load(spark, str(tmp_path / "b"), made)
    bundle.export_csv(bundle.load(spark, str(tmp_path / "b"))["t"], str(tmp_path / "csv"))
    spark.range(9).selectExpr("id", "map('k', id) m", "array(id) a").write.mode("overwrite").parquet(str(tmp_path / "b" / "t"))
    with pytest.raises(ValueError):
        bundle.load(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        bundle.load(spark, str(tmp_path / "b"), "other", verify=False)
