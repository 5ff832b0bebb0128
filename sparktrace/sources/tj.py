"""Trace logs, loose or in archives, read through Spark's own file reader: any store that Spark reads will do."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktrace.functions.text import canonical_id

#: Format of record heads, log names and process folders; folders never read; limits.
HEAD = re.compile(rb"(?:\A|(?<=[\r\n]))\d{2}:\d{2}\.\d{6}-\d+,[^,\r\n]+,\d+,")
RECORD = re.compile(r"(?P<minute>\d{2}):(?P<second>\d{2})\.(?P<micros>\d{6})-(?P<duration>\d+),(?P<event>[^,\r\n]+),(?P<level>\d+),(?P<rest>.*)", re.S)
LOG_NAME = re.compile(r"(\d{2})(\d{2})(\d{2})(\d{2})\.log$", re.I)
PROCESS_DIR = re.compile(r"(?:rphost|ragent|rmngr|ras|1cv8c|web|ws)_\d+", re.I)
EXCLUDED = ("analysis_output", "analysis_data", ".git", "node_modules", "__pycache__")
ARCHIVES = r"(?i)\.(zip|tar|tar\.gz|tgz|log\.gz)$"
MAX_MEMBERS, MAX_SOURCE, MAX_ARCHIVE, MAX_RECORD = 10_000, 2 << 30, 16 << 30, 16 << 20
PROBE = 256 << 10


def split_fields(text: str) -> list[str]:
    """Parts between commas; a quote opens a run in which its double stands for itself, without end it goes on to the last character."""
    out, start, at, quote = [], 0, 0, ""
    for m in re.finditer(r"[,'\"]", text):
        at = m.start()
        if quote:
            quote = "" if m[0] == quote else quote  # a doubled quote closes and opens again
        elif m[0] == ",":
            out.append(text[start:at])
            start = at + 1
        else:
            quote = m[0]
    return [*out, text[start:]]


def parse_attributes(rest: str) -> dict[str, str]:
    """key=value parts, values unquoted; the last of equal keys counts and parts without = don't."""
    out = {}
    for part in split_fields(rest):
        key, eq, value = part.partition("=")
        if not eq:
            continue
        value = value.strip()
        if value[:1] in ("'", '"') and value[:1]:
            quote = value[0]
            value = value[1 : -1 if len(value) > 1 and value.endswith(quote) else None].replace(quote * 2, quote)
        out[key.strip()] = value
    return out


def split_records(data: bytes) -> Iterator[dict]:
    """Records with byte and line positions; bytes before the first head belong to none."""
    heads = [m.start() for m in HEAD.finditer(data, 3 if data[:3] == b"\xef\xbb\xbf" else 0)]
    if data[:3] == b"\xef\xbb\xbf" and (m := HEAD.match(data[3 : 3 + PROBE])) and (not heads or heads[0] != 3):
        heads.insert(0, 3)
    line = len(re.findall(rb"\r\n|\r|\n", data[: heads[0]])) + 1 if heads else 1
    for n, (a, b) in enumerate(zip(heads, [*heads[1:], len(data)], strict=True), 1):
        raw = data[a:b]
        if len(raw) > MAX_RECORD:
            raise ValueError(f"record at byte {a} is over {MAX_RECORD} bytes")
        lines = len(re.findall(rb"\r\n|\r|\n", raw))
        text = raw.decode("utf-8", "replace")
        yield {
            "text": text, "byte_start": a, "byte_end": b, "record_ordinal": n, "line_start": line, "line_end": line + max(lines - (raw[-1:] in (b"\r", b"\n")), 0),
            "raw_record_sha256": hashlib.sha256(raw).hexdigest(), "decoding_replaced": "�" in text and b"\xef\xbf\xbd" not in raw,
        }
        line += lines


def classify_path(logical: str) -> tuple[str, str, str]:
    """(dataset, capture, process) of a path below the root."""
    parts = [p for p in logical.split("/") if p]
    at = next((i for i, p in enumerate(parts[:-1]) if PROCESS_DIR.fullmatch(p)), None)
    folder = parts[: at + 1] if at is not None else parts[:-1]
    return "/".join(folder) or ".", parts[0] if len(parts) > 1 else ".", parts[at] if at is not None else ""


def event_end(log: str, m: re.Match) -> datetime | None:
    """Local time of a record from the name of its log and its head; none if that isn't a date."""
    name = LOG_NAME.search(log)
    try:
        return datetime(2000 + int(name[1]), int(name[2]), int(name[3]), int(name[4]), int(m["minute"]), int(m["second"]), int(m["micros"])) if name else None
    except ValueError:
        return None


def chunks(read: Callable[[int], bytes], size: int = 1 << 16) -> Iterator[bytes]:
    while part := read(size):
        yield part


def as_far_as(parts: Iterator[bytes]) -> tuple[bytes, str]:
    """Bytes up to the first error, and what it was."""
    out = []
    try:
        for part in parts:
            out.append(part)
    except (OSError, EOFError, zlib.error, tarfile.TarError, zipfile.BadZipFile) as error:
        return b"".join(out), f"partial_read_error: {error}"
    return b"".join(out), ""


def members(path: str, content: bytes) -> Iterator[tuple[int, str, bytes, str]]:
    """(ordinal, name, bytes, problem) of the logs in an archive; names may repeat, so ordinals count. A member that breaks off gives what was read of it."""
    total = 0
    try:
        if path.lower().endswith(".zip"):
            z = zipfile.ZipFile(io.BytesIO(content))
            listed = [(i, x.filename, x.file_size, lambda x=x: chunks(z.open(x).read1)) for i, x in enumerate(z.infolist()) if not x.is_dir() and x.external_attr >> 28 != 0xA]
        elif path.lower().endswith(".log.gz"):
            listed = [(0, path.rsplit("/", 1)[-1][:-3], 0, lambda: chunks(gzip.GzipFile(fileobj=io.BytesIO(content)).read1))]
        else:
            t = tarfile.open(fileobj=io.BytesIO(content), mode="r:*")
            listed = [(i, x.name, x.size, lambda x=x: chunks(t.extractfile(x).read1)) for i, x in enumerate(t.getmembers()) if x.isfile()]
        if len(listed) > MAX_MEMBERS:
            yield -1, "", b"", f"archive_error: {len(listed)} files, more than {MAX_MEMBERS}"
            return
        for ordinal, name, size, read in listed:
            if not name.lower().endswith(".log"):
                continue
            total += size
            if size > MAX_SOURCE or total > MAX_ARCHIVE:
                yield ordinal, name, b"", "too_large"
            else:
                yield ordinal, name, *as_far_as(read())
    except (OSError, EOFError, zlib.error, tarfile.TarError, zipfile.BadZipFile) as error:
        yield -1, "", b"", f"archive_error: {error}"


def kind_of(path: str) -> str:
    name = path.lower()
    return "file" if name.endswith(".log") else "zip" if name.endswith(".zip") else "gzip" if name.endswith(".log.gz") else "tar"


def listed(spark: SparkSession, root: str, archive_mode: str = "auto", excluded: tuple[str, ...] = ()) -> DataFrame:
    """Logs and archives below root: path, logical path, content, and for archives whether and why they are read.

    archive_mode: always, never, or auto, which leaves out an archive beside a folder of its name that holds loose logs.
    Folders of the names EXCLUDED and excluded aren't entered. A file of no bytes holds no record, and Spark's reader doesn't report it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    files = files.withColumn("logical", F.regexp_replace("path", "^.*?" + re.escape(base) + "/", ""))
    files = files.where(~F.arrays_overlap(F.split("logical", "/"), F.array(*[F.lit(e) for e in (*EXCLUDED, *excluded)])))
    loose = files.where(F.lower("logical").endswith(".log"))
    archives = files.where(F.col("logical").rlike(ARCHIVES)).withColumn("stem", F.regexp_replace("logical", ARCHIVES, ""))
    folders = loose.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("logical", "/"))), lambda i: F.array_join(F.slice(F.split("logical", "/"), 1, i), "/"))).alias("stem")).distinct().withColumn("extracted", F.lit(True))
    reason = {"never": F.lit("archive_mode_never"), "always": F.lit("read")}.get(archive_mode, F.when(F.col("extracted"), "extracted_folder_has_logs").otherwise("read"))
    told = archives.join(folders, "stem", "left").withColumn("inventory", reason)
    return loose.withColumn("inventory", F.lit("read")).select("path", "logical", "length", "content", "inventory").unionByName(told.select("path", "logical", "length", "content", "inventory"))


def inventory(found: DataFrame) -> DataFrame:
    """What was done with each archive."""
    return found.where(F.col("logical").rlike(ARCHIVES)).select("path", "logical", F.col("length").alias("size_bytes"), (F.col("inventory") == "read").alias("selected"), F.col("inventory").alias("reason"))


SOURCES = "path string, member_ordinal long, logical string, kind string, locator string, content binary, problem string"


def opened(found: DataFrame) -> DataFrame:
    """Log files and archive members with their bytes, problem, and a locator: where they lie, as canonical JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, logical, content in zip(batch["path"], batch["logical"], batch["content"], strict=True):
                kind = kind_of(logical)
                for ordinal, name, data, problem in [(None, None, content, "")] if kind == "file" else members(path, content):
                    locator = {"path": logical, "kind": kind, "member": name, "member_ordinal": ordinal}
                    told = json.dumps(locator, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
                    row = (path, ordinal, logical if ordinal is None else f"{logical}/{name}", kind, told, data, problem)
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in SOURCES.split(", ")])

    return found.where("inventory = 'read'").select("path", "logical", "content").mapInPandas(run, SOURCES)


def sources(spark: SparkSession, root: str, archive_mode: str = "auto", excluded: tuple[str, ...] = ()) -> DataFrame:
    return opened(listed(spark, root, archive_mode, excluded))


def inspect(data: bytes, problem: str, log: str, salvage: bool) -> tuple[str, str, int]:
    """(status, reason, bytes to analyse) of one source."""
    body = data[3:] if data[:3] == b"\xef\xbb\xbf" else data
    broken = problem.startswith("partial_read_error")
    if problem and not broken:
        return "skipped", problem, 0
    if not body:
        return "skipped", problem or "empty_or_bom_only", 0
    if len(data) > MAX_SOURCE:
        return "skipped", "too_large", 0
    nul = data.find(b"\0")
    if nul >= 0:
        if not salvage:
            return "skipped", "nul_bytes", 0
        prefix = data[:nul]
        try:
            prefix.decode("utf-8")
        except UnicodeDecodeError as error:
            prefix = prefix[: error.start]
        heads = [m.start() for m in HEAD.finditer(prefix)]
        return ("partial_nul_salvaged", "nul_bytes", heads[-1]) if len(heads) >= 2 else ("skipped", "nul_bytes_without_two_records", 0)
    if not HEAD.search(body[:PROBE]):
        return "skipped", "no_record_head", 0
    if broken or len(data) > MAX_RECORD:
        heads = [m.start() for m in HEAD.finditer(data)]
        if long := next((a for a, b in zip(heads, [*heads[1:], len(data)], strict=True) if b - a > MAX_RECORD), None):
            return "partial_read_error", f"record at byte {long} is over {MAX_RECORD} bytes", long
        if broken:  # the last record may be cut
            return "partial_read_error", problem, heads[-1]
    return ("valid" if LOG_NAME.search(log) else "valid_no_timestamp"), "", len(data)


ACCEPTED = ("valid", "valid_no_timestamp", "partial_nul_salvaged", "partial_read_error")
HEALTH = "path string, member_ordinal string, logical string, kind string, locator string, dataset_id string, capture_id string, process string, size_bytes long, analyzed_bytes long, status string, reason string, nul_offset string, sha256 string"


def source_map(text: str) -> tuple[str, list[tuple[str, str, str, str]]]:
    """(capture, rows (locator, origin, process scope, log key)) of a map that gives physical copies one logical source."""
    from sparktrace.plans.config import need, strict_json, text_of

    told = strict_json(text)
    need(isinstance(told, dict) and told.get("source_identity_version") == "1.0" and isinstance(told.get("sources"), list), "source map: source_identity_version 1.0 and sources")
    rows = []
    for entry in told["sources"]:
        need(isinstance(entry, dict) and isinstance(entry.get("locator"), dict), "source map: every source has a locator")
        key = json.dumps(entry["locator"], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        rows.append((key, *(text_of(entry.get(k), f"source map {k}") for k in ("origin_id", "process_scope", "logical_log_key"))))
    need(len({r[0] for r in rows}) == len(rows), "source map: a locator is there twice")
    return text_of(told.get("capture_id"), "source map capture_id"), rows


def files(found: DataFrame, salvage_nul_prefix: bool = False, root: str = "", capture: str | None = None, mapped: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Health and identity of each source.

    A source is what its locator names, or what the map makes of it. Of accepted copies of one source the first counts and
    the others are skipped_duplicate; if their bytes differ, all but the first are conflicting_version, an error to check for.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ordinal, logical, kind, locator, content, problem in batch[["path", "member_ordinal", "logical", "kind", "locator", "content", "problem"]].itertuples(index=False):
                status, reason, size = inspect(content, problem, logical, salvage_nul_prefix)
                nul = content.find(b"\0")
                rows.append((path, ordinal, logical, kind, locator, *classify_path(logical), len(content), size, status, reason, str(nul) if nul >= 0 else None, hashlib.sha256(content).hexdigest()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEALTH.split(", ")])

    plain = found.withColumn("member_ordinal", F.col("member_ordinal").cast("string"))
    out = plain.mapInPandas(run, HEALTH).withColumns({"member_ordinal": F.col("member_ordinal").cast("long"), "nul_offset": F.col("nul_offset").cast("long")})
    names = found.sparkSession.createDataFrame(list(mapped), "locator string, origin_id string, process_scope string, logical_log_key string")
    out = out.join(names, "locator", "left")
    own = F.lit(capture) if capture else F.concat(F.lit("inferred:"), canonical_id("capture-root/v1", F.lit(root)))
    scope = F.when(F.col("process") == "", "(unknown-process)").otherwise(F.col("process"))
    out = out.withColumn("identity_status", F.when(F.col("origin_id").isNotNull(), "explicit_map").otherwise("inferred_relative_path"))
    out = out.withColumns({"origin_id": F.coalesce("origin_id", F.lit("(unknown-origin)")), "process_scope": F.coalesce("process_scope", scope), "logical_log_key": F.coalesce("logical_log_key", "locator")})
    out = out.withColumn("source_id", canonical_id("source/v1", own, F.col("origin_id"), F.col("process_scope"), F.col("logical_log_key")))
    out = out.withColumn("source_version_id", canonical_id("source-version/v1", F.col("source_id"), F.col("sha256")))
    read = F.col("status").isin(*ACCEPTED)
    over = Window.partitionBy("source_id", read).orderBy("path", "member_ordinal")
    out = out.withColumns({"nth": F.row_number().over(over), "first_sha": F.first("sha256").over(over)})
    again = read & (F.col("nth") > 1)
    return out.withColumns({
        "status": F.when(again & (F.col("sha256") != F.col("first_sha")), "conflicting_version").when(again, "skipped_duplicate").otherwise(F.col("status")),
        "analyzed_bytes": F.when(again, 0).otherwise(F.col("analyzed_bytes")),
    }).drop("nth", "first_sha")


def accepted(found: DataFrame, health: DataFrame) -> DataFrame:
    """The sources to analyse, with their identity and a number in the order of it; as many rows as files."""
    number = F.row_number().over(Window.orderBy("source_id"))
    good = health.where(F.col("status").isin(*ACCEPTED)).select("locator", "path", "source_id", number.alias("source_no"))
    return found.join(good, ["locator", "path"])


KNOWN = ["Usr", "OSThread", "SessionID", "t:connectID", "Dbpid", "Context", "CpuTime", "Memory", "MemoryPeak", "InBytes", "OutBytes", "RowsAffected", "Sql", "Func", "IName", "MName", "Form", "FormItem", "Descr", "Description", "DBMS"]
RECORDS = "source_id string, source_no long, logical string, dataset_id string, capture_id string, process string, byte_start long, byte_end long, record_ordinal long, line_start long, line_end long, raw_record_sha256 string, decoding_replaced boolean, parse_error boolean, event_type string, level int, duration_us long, end_ts timestamp_ntz, attributes map<string,string>"


def records(found: DataFrame, salvage_nul_prefix: bool = False) -> DataFrame:
    """One row per record of the sources (those of accepted, or any) that can be analysed; a head that doesn't parse is kept as parse_error."""
    if "source_id" not in found.columns:
        found = found.withColumn("source_id", canonical_id("source/v1", F.col("logical"))).withColumn("source_no", F.pmod(F.xxhash64("logical"), F.lit(1 << 30)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORDS.replace("map<string,string>", "map").split(", ")]
        for batch in batches:
            for source, number, logical, content, problem in zip(batch["source_id"], batch["source_no"], batch["logical"], batch["content"], batch["problem"], strict=True):
                status, _, size = inspect(content, problem, logical, salvage_nul_prefix)
                if status == "skipped":
                    continue
                rows = []
                for r in split_records(content[:size]):
                    m = RECORD.match(r.pop("text").rstrip("\r\n"))
                    own = (m["event"], int(m["level"]), int(m["duration"]), event_end(logical, m), parse_attributes(m["rest"])) if m and int(m["duration"]) < 2**63 else (None, None, None, None, {})
                    rows.append((source, number, logical, *classify_path(logical), *r.values(), own[0] is None, *own))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return found.select("source_id", "source_no", "logical", "content", "problem").mapInPandas(run, RECORDS)


def events(parsed: DataFrame) -> DataFrame:
    """Records as trace events, in the form that linking and the tables take.

    event_id counts by source and byte, so it has the order of the records; event_sha256 is the same wherever the source lies.
    """
    at = lambda key: F.col("attributes")[key]
    end = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', end_ts)")
    user = F.when(F.trim(F.coalesce(at("Usr"), F.lit(""))) == "", "(not specified)").otherwise(at("Usr"))
    day = F.coalesce(F.date_format("end_ts", "yyyy-MM-dd"), F.lit("unknown-date"))
    ids = parsed.where("not parse_error").withColumn("event_id", F.shiftleft("source_no", 32) + F.col("byte_start"))  # a source has under 2^32 bytes
    sha = F.sha2(F.concat(F.lit('["event/v1","'), "source_id", F.lit('",'), F.col("byte_start").cast("string"), F.lit(',"'), "raw_record_sha256", F.lit('"]')), 256)
    return ids.select(
        "event_id", sha.alias("event_sha256"), "source_id", F.col("logical").alias("source"), "byte_start", "byte_end", "line_start", "line_end", "raw_record_sha256", "event_type", "duration_us", end.alias("end_us"), (end - F.col("duration_us")).alias("start_us"), F.col("end_ts").alias("ts"), at("Usr").alias("usr_raw"), user.alias("user"),
        "dataset_id", "capture_id", "process", at("OSThread").alias("thread"), at("SessionID").alias("session"), at("t:connectID").alias("connect_id"), F.concat_ws("@", "capture_id", day).alias("measurement_id"), at("Context").alias("context"),
        at("CpuTime").alias("cpu_us_raw"), at("Memory").alias("memory_raw"), at("MemoryPeak").alias("memory_peak_raw"), at("InBytes").alias("in_bytes_raw"), at("OutBytes").alias("out_bytes_raw"), at("RowsAffected").alias("rows_affected_raw"),
        at("Sql").alias("sql_text"), F.coalesce(F.nullif(at("Descr"), F.lit("")), F.nullif(at("Description"), F.lit("")), F.nullif(at("DBMS"), F.lit("")), at("Descr"), at("Description"), at("DBMS")).alias("message"),
        F.to_json(F.map_filter("attributes", lambda k, v: ~k.isin("Sql", "Context", "CpuTime", "Memory", "MemoryPeak", "InBytes", "OutBytes", "RowsAffected"))).alias("attributes_json"), F.map_values("attributes").alias("values"),
        *[at(p).alias(p) for p in ("Func", "IName", "MName", "Form", "FormItem")],
    )
