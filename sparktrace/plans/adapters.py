"""Tables of a star schema seen as trace events, so that every operator runs on plain parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw counter column, and the least value that counts as valid.
COUNTERS = {"cpu_us": 0, "memory": -(2**63), "memory_peak": -(2**63), "in_bytes": 0, "out_bytes": 0, "rows_affected": 0}


#: Statements and messages by the number in props.
STATEMENTS = """when k % 6 = 0 then concat('SELECT a FROM t', k % 7, ' WHERE id = ', k)
    when k % 6 = 1 then concat('select x.b, count(*) from "T One" x left join t', k % 7, ' y on x.id = y.id where y.n = ''v', k, ''' group by 1 order by 2 desc limit 5')
    when k % 6 = 2 then concat('WITH w AS (SELECT DISTINCT c FROM pg_temp.tt', k % 3, ') SELECT CASE WHEN c > ', k, '.5 THEN 1 ELSE 2 END FROM w UNION ALL SELECT cast(3 as numeric(10, 2))')
    when k % 6 = 3 then concat('SELECT ''unterminated ', k % 4) when k % 6 = 5 then concat('/* c */ SELECT TOP 3 a FROM s.t', k % 7, ', t_b -- note')"""
MESSAGES = """when k % 8 = 0 then null when k % 8 = 1 then ' \\n' when k % 8 = 2 then concat('Ошибка выполнения запроса:\\r\\n\\nERROR: canceling statement due to user request ', k)
    when k % 8 = 3 then concat('HTTP request 3f2504e0-4f89-11d3-9a0c-0305e82c3301 failed with ', k) when k % 8 = 4 then concat('permission denied for relation t', k % 5)
    else concat('Lock 2024-01-0', 1 + k % 9, ' on ', k, ' of table ', k % 5)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trace records: views and purchases are calls, clicks DB events and DBMS-layer ones, errors errors of both kinds, signups locks of all three.

    A value counts ten minutes, a user is a scope, weeks are measurements; the number in props
    decides session, connection, operation, context, statement, message and counters, with all counter
    states, wrapped, missing and empty messages, blank contexts and a statement that can't be lexed among them.
    """
    e = table(spark, sf_dir, "events")
    e = e.withColumn("k", F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int"))
    kind = """case event_type when 'click' then if(event_id % 5 = 0, 'SDBL', 'DBPOSTGRS') when 'error' then if(event_id % 4 = 0, 'QERR', 'EXCP')
        when 'signup' then element_at(array('TLOCK', 'TTIMEOUT', 'TDEADLOCK'), cast(1 + event_id % 3 as int)) else 'CALL' end"""
    e = e.withColumn("event_type", F.expr(kind))
    e = e.withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    return e.selectExpr(
        "event_id",
        "event_type",
        "if(event_type <> 'CALL' and event_id % 97 = 0, null, us) end_us",
        "cast(round(value * 600000000) as bigint) duration_us",
        "if(event_type <> 'CALL' and event_id % 97 = 0, null, us - cast(round(value * 600000000) as bigint)) start_us",
        "ts",
        "if(user_id % 25 = 0, null, concat('user', user_id)) usr_raw",
        "if(user_id % 25 = 0, '(not specified)', concat('user', user_id)) user",
        "concat('d', user_id % 2) dataset_id",
        "concat('rphost_', user_id % 4) process",
        "concat('cap', user_id % 2) capture_id",
        "concat('cap', user_id % 2, '/d', user_id % 2, '/rphost_', user_id % 4) source",
        "if(event_type <> 'CALL' and event_id % 50 = 7, '', cast(user_id % 8 as string)) thread",
        "if(k % 3 = 0, null, cast(k % 3 as string)) session",
        "if(k % 4 = 0, null, cast(k % 4 as string)) connect_id",
        "if(k % 6 = 0, null, if(k % 7 = 0, ' \\n\\t', concat('  op', k % 5, '\\n line ', k % 3))) context",
        "concat('op', k % 5) signature",
        "concat('m', 1 + (day(ts) - 1) div 7) measurement_id",
        "k",
        "case k % 10 when 0 then null when 1 then '' when 2 then 'bad' when 3 then '99999999999999999999' else cast(k * 100000 as string) end cpu_us_raw",
        "if(k % 11 = 0, ' ', cast((k - 20) * 512 as string)) memory_raw",
        "if(k % 6 = 0, null, cast((k - 50) * 1024 as string)) memory_peak_raw",
        "if(k % 9 = 0, '-5', cast(k * 10 as string)) in_bytes_raw",
        "if(k % 8 = 0, null, cast(k * 131072 as string)) out_bytes_raw",
        "concat('+', k) rows_affected_raw",
        f"case when event_type <> 'DBPOSTGRS' then null {STATEMENTS} end sql_text",
        f"case when event_type not in ('EXCP', 'QERR') then null {MESSAGES} end message",
    )


def trace_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_events written out as logs, one per process and hour, in the form that the reader lists files in; events without time are in logs without a date.

    No event is left out: one without a moment lies at the start of an undated log, a call without a signature names no function, and a
    duration that a head can't tell, as it is missing or below zero, stands in the attribute Took.

    Beside them lie files that can't be read as they are: a byte order mark alone, text without a record, and records before a NUL byte.
    """
    quoted = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f",{name}='"), F.replace(F.col(column), F.lit("'"), F.lit("''")), F.lit("'"))).otherwise("")
    fields = {
        "Usr": "usr_raw", "OSThread": "thread", "SessionID": "session", "t:connectID": "connect_id", "Context": "context", "CpuTime": "cpu_us_raw", "Memory": "memory_raw", "MemoryPeak": "memory_peak_raw",
        "InBytes": "in_bytes_raw", "OutBytes": "out_bytes_raw", "RowsAffected": "rows_affected_raw", "Sql": "sql_text", "Descr": "message",
    }
    e = trace_events(spark, sf_dir)
    tail = [quoted(n, c) for n, c in fields.items()]
    own = F.when((F.col("event_type") == "CALL") & F.col("signature").isNotNull(), F.concat(F.lit(",Func="), "signature")).otherwise("")
    took = F.when(F.col("duration_us") >= 0, "").otherwise(F.concat(F.lit(",Took="), F.coalesce(F.col("duration_us").cast("string"), F.lit(""))))
    moment, length = F.coalesce(F.date_format("ts", "mm:ss.SSSSSS"), F.lit("00:00.000000")), F.when(F.col("duration_us") >= 0, F.col("duration_us")).otherwise(0)
    e = e.withColumn("line", F.concat(moment, F.lit("-"), length.cast("string"), F.lit(","), "event_type", F.lit(",1,EventId="), F.col("event_id").cast("string"), *tail, own, took, F.lit("\r\n")))
    name = F.when(F.col("end_us").isNull(), "undated").otherwise(F.date_format("ts", "yyMMddHH"))
    logs = e.groupBy(F.concat_ws("/", "capture_id", "dataset_id", "process", F.concat(name, F.lit(".log"))).alias("logical")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "line"))).alias("lines"))
    logs = logs.select("logical", F.encode(F.array_join(F.transform("lines", lambda x: x["line"]), ""), "UTF-8").alias("content"))
    odd = "values ('cap9/rphost_9/24010100.log', unhex('EFBBBF')), ('cap9/rphost_9/24010101.log', encode('no record here', 'UTF-8')), ('cap9/rphost_9/24010102.log', encode(concat('00:01.000000-5,CALL,1,Usr=a\\n00:02.000000-5,CALL,1,Usr=b\\n00:03.0', char(0)), 'UTF-8')) t(logical, content)"
    every = logs.unionByName(spark.sql(f"select * from {odd}"))
    return every.select(F.col("logical").alias("path"), "logical", F.octet_length("content").cast("long").alias("length"), "content", F.lit("read").alias("inventory"))


def trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of the sources of trace_events: one of each process and capture, and nations as further files of the first capture."""
    own = trace_events(spark, sf_dir).select(F.col("source").alias("logical"), "dataset_id", "capture_id", "process").distinct()
    status = "case process when 'rphost_1' then 'partial_nul_salvaged' when 'rphost_3' then 'valid_no_timestamp' else 'valid' end"
    more = "case n_nationkey % 4 when 0 then 'skipped_duplicate' when 1 then 'skipped' else 'valid' end"
    nations = table(spark, sf_dir, "nation").selectExpr("n_name logical", "'d0' dataset_id", "'cap0' capture_id", "'' process", f"{more} status", "if(n_nationkey % 8 = 1, 'empty_or_bom_only', if(n_nationkey % 4 = 1, 'no_record_head', '')) reason", "cast(n_nationkey as bigint) analyzed_bytes")
    return own.selectExpr("*", f"{status} status", "if(process = 'rphost_1', 'nul_bytes', '') reason", "1000L analyzed_bytes").unionByName(nations)


def trace_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that failed per data set: one in 101 events."""
    return trace_events(spark, sf_dir).groupBy("dataset_id").agg(F.count_if(F.col("event_id") % 101 == 0).alias("parse_errors"))


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls with their line items as linked DB events: the chatty measures at the size of lineitem."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("db_count"), F.expr("sum(cast(l_quantity * 1000 as bigint))").alias("db_duration_us"))
    calls = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    calls = calls.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return calls.selectExpr(
        "o_orderkey call_id", "o_orderpriority signature", "c_mktsegment user", "cast(year(o_orderdate) as string) measurement_id",
        "cast(round(o_totalprice * 100) as bigint) duration_us", "coalesce(db_count, 0) db_count", "coalesce(db_duration_us, 0) db_duration_us",
    )
