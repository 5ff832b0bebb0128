import gzip
import hashlib
import json
import tarfile
import zipfile

from sparktrace.functions import sqlnorm
from sparktrace.operators import aggregates, linking
from sparktrace.sources import tj

LOG = (
    "junk\r\n00:00.100000-100000,CALL,1,Usr=User,OSThread=7,SessionID=A,CpuTime=500,OutBytes='2048',Context='Op one\r\nsecond, line'\r\n"
    "00:00.050000-50,DBPOSTGRS,3,Usr=User,OSThread=7,SessionID=A,RowsAffected=12,Sql=\"SELECT \"\"a\"\" FROM t1 WHERE t1.id = 123\"\r\n"
    "00:00.060000-100,EXCP,3,Usr=User,OSThread=7,SessionID=A,Descr='It''s bad'\r\n"
)


def write(folder):
    own = folder / "capture" / "rphost_1"
    own.mkdir(parents=True)
    (own / "26090310.log").write_bytes(b"\xef\xbb\xbf" + LOG.encode())
    (own / "26090311.log").write_bytes(b"\xef\xbb\xbf")
    (own / "26090312.log").write_bytes(LOG.encode()[6:] + b"\0\0")
    with zipfile.ZipFile(folder / "more.zip", "w") as z:
        z.writestr("x/rphost_2/26090410.log", LOG)
        z.writestr("x/readme.txt", "no")
    with zipfile.ZipFile(folder / "capture.zip", "w") as z:
        z.writestr("rphost_1/26090310.log", LOG)
    (folder / "one.log.gz").write_bytes(gzip.compress(LOG.encode()))
    with tarfile.open(folder / "some.tar.gz", "w:gz") as t:
        t.add(own / "26090310.log", "r/rphost_3/26090510.log")
    (folder / "node_modules").mkdir()
    (folder / "node_modules" / "26090310.log").write_text(LOG)


def test_fields():
    assert tj.split_fields("a=1,b='x,''y',c=\"q") == ["a=1", "b='x,''y'", 'c="q']
    assert tj.parse_attributes("a=1,b='x,''y',a=2,junk, c = \"q\"\"r\"") == {"a": "2", "b": "x,'y", "c": 'q"r'}
    assert tj.classify_path("cap/x/rphost_12/26010203.log") == ("cap/x/rphost_12", "cap", "rphost_12")


def test_records_positions():
    data = LOG.encode()
    found = list(tj.split_records(data))
    assert [r["record_ordinal"] for r in found] == [1, 2, 3]
    assert found[0]["byte_start"] == 6 and found[-1]["byte_end"] == len(data)
    assert [(r["line_start"], r["line_end"]) for r in found] == [(2, 3), (4, 4), (5, 5)]
    assert all(a["byte_end"] == b["byte_start"] for a, b in zip(found, found[1:], strict=False))


def test_logs_to_tables(spark, tmp_path):
    write(tmp_path)
    found = tj.sources(spark, str(tmp_path))
    assert {(r.logical, r.selected, r.reason) for r in tj.inventory(tj.listed(spark, str(tmp_path))).collect()} == {("capture.zip", False, "extracted_folder_has_logs"), ("more.zip", True, "read"), ("one.log.gz", True, "read"), ("some.tar.gz", True, "read")}
    assert tj.sources(spark, str(tmp_path), excluded=("capture",)).count() < found.count()
    health = {(r.logical, r.status) for r in tj.files(found).collect()}
    assert ("capture/rphost_1/26090310.log", "valid") in health
    assert ("capture/rphost_1/26090311.log", "skipped") in health and ("capture/rphost_1/26090312.log", "skipped") in health
    assert {name for name, _ in health} >= {"more.zip/x/rphost_2/26090410.log", "some.tar.gz/r/rphost_3/26090510.log", "one.log.gz/one.log"}
    assert not any("node_modules" in n or n.startswith("capture.zip") for n, _ in health)
    assert any(n.startswith("capture.zip") for n in [r.logical for r in tj.sources(spark, str(tmp_path), "always").collect()])
    assert ("capture/rphost_1/26090312.log", "partial_nul_salvaged") in {(r.logical, r.status) for r in tj.files(found, True).collect()}

    events = tj.events(tj.records(found)).where("logical like 'capture/%10.log'")
    linked = linking.link(events)
    assert {r.event_type: r.status for r in linked.collect()} == {"DBPOSTGRS": "linked_unique", "EXCP": "linked_unique"}
    call = events.where("event_type = 'CALL'").first()
    assert call.measurement_id == "capture@2026-09-03" and call.context == "Op one\r\nsecond, line"
    assert aggregates.rollup(linked).first().db_count == 1
    assert "where t1 . id = <number>" in sqlnorm.dictionary(events).first().normalized_sql
    assert {r.message for r in linked.where("event_type = 'EXCP'").collect()} == {"It's bad"}


def test_too_many_members_are_told(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(4):
            z.writestr(f"rphost_1/2609031{i}.log", LOG)
    monkeypatch.setattr(tj, "MAX_MEMBERS", 3)
    got = list(tj.members("many.zip", (tmp_path / "many.zip").read_bytes()))
    assert len(got) == 1 and got[0][3].startswith("archive_error")
    monkeypatch.setattr(tj, "MAX_MEMBERS", 4)
    assert len(list(tj.members("many.zip", (tmp_path / "many.zip").read_bytes()))) == 4


def test_repeated_members_are_sources_of_their_own(spark, tmp_path):
    """Names may repeat in an archive, so ordinals tell members apart, unless a source map makes them one source."""
    with zipfile.ZipFile(tmp_path / "twice.zip", "w") as z:
        z.writestr("rphost_1/26090310.log", LOG)
        z.writestr("rphost_1/26090310.log", LOG)
        z.writestr("rphost_1/26090310.log", LOG + LOG)
    found = tj.sources(spark, str(tmp_path))
    health = tj.files(found)
    assert [r.status for r in health.collect()] == ["valid"] * 3
    events = tj.events(tj.records(tj.accepted(found, health)))
    assert events.count() == events.select("event_id").distinct().count() == events.select("event_sha256").distinct().count() == 12
    locators = [r.locator for r in health.orderBy("member_ordinal").collect()]
    one = [(x, "box", "rphost_1", "the log") for x in locators[:2]]
    health = tj.files(found, capture="c", mapped=one)
    assert sorted(r.status for r in health.collect()) == ["skipped_duplicate", "valid", "valid"]
    assert tj.records(tj.accepted(found, health)).count() == 9
    health = tj.files(found, capture="c", mapped=[(x, "box", "rphost_1", "the log") for x in locators[1:]])
    assert sorted(r.status for r in health.collect()) == ["conflicting_version", "valid", "valid"]
    read = tj.source_map(json.dumps({"source_identity_version": "1.0", "capture_id": "c", "sources": [{"locator": json.loads(x), "origin_id": "box", "process_scope": "rphost_1", "logical_log_key": "the log"} for x in locators[:2]]}))
    assert read == ("c", one)


def test_ids_follow_the_records(spark, tmp_path):
    write(tmp_path)
    found = tj.sources(spark, str(tmp_path))
    events = tj.events(tj.records(tj.accepted(found, tj.files(found, root="r"))))
    rows = events.select("event_id", "source_id", "byte_start", "event_sha256", "raw_record_sha256").collect()
    assert len({r.event_id for r in rows}) == len(rows)
    by_source = sorted(rows, key=lambda r: r.event_id)
    assert [(r.source_id, r.byte_start) for r in by_source] == sorted((r.source_id, r.byte_start) for r in rows)
    digest = lambda *x: hashlib.sha256(json.dumps(list(x), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert all(r.event_sha256 == digest("event/v1", r.source_id, r.byte_start, r.raw_record_sha256) for r in rows)


def test_what_breaks_off_is_read_in_part(spark, tmp_path, monkeypatch):
    whole = gzip.compress((LOG * 3000).encode())
    (tmp_path / "cut.log.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "rphost_1").mkdir()
    (tmp_path / "rphost_1" / "26090310.log").write_text(LOG)
    found = tj.sources(spark, str(tmp_path))
    health = {r.logical: r for r in tj.files(found).collect()}
    cut = health["cut.log.gz/cut.log"]
    assert cut.status == "partial_read_error" and 0 < cut.analyzed_bytes < cut.size_bytes
    some = tj.records(tj.accepted(found, tj.files(found))).where("logical like 'cut%'")
    assert 0 < some.count() < 9000 and some.where("parse_error").count() == 0
    assert tj.inspect(b"x" * 50, "partial_read_error: no", "a.log", False)[0] == "skipped"
    monkeypatch.setattr(tj, "MAX_RECORD", 200)
    long = LOG.encode() + b"00:01.000000-1,CALL,1,Context='" + b"y" * 300 + b"'\r\n"
    assert tj.inspect(long, "", "26090310.log", False) == ("partial_read_error", f"record at byte {len(LOG)} is over 200 bytes", len(LOG))
