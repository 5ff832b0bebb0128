from pyspark.sql import functions as F

from sparktrace.functions import counters, sqlnorm, text


def test_counter_states(spark):
    rows = [(None, "missing", None), ("", "empty", None), (" ", "empty", None), ("bad", "invalid", None), ("1.2", "invalid", None), ("1_000", "invalid", None), ("9223372036854775808", "out_of_range", None), ("0", "valid", 0), ("+5", "valid", 5), ("-0", "valid", 0), ("-1", "out_of_range", None), ("00000000000000000000007", "valid", 7)]
    df = spark.createDataFrame(rows, "raw string, state string, value long")
    for r in df.select("*", counters.state("raw", 0).alias("s"), counters.value("raw", 0).alias("v")).collect():
        assert (r.s, r.v) == (r.state, r.value), r.raw
    kept = spark.createDataFrame([("valid", 0), ("valid", 20), ("missing", None), ("invalid", None)], "s string, v long").agg(*counters.summary("s", "v")).first()
    assert (kept.available_count, kept.eligible_count, kept.sum_known, kept.sum_complete, kept["mean"], kept.coverage_percent) == (2, 4, 20, None, 10.0, 50.0)


def test_error_text(spark):
    uuid = "12345678-1234-1234-1234-1234567890ab"
    df = spark.createDataFrame([(f"  Failed\n {uuid} on 2024-01-02 10:11:12.5 after 17 of 3 ",), ("Error executing query:\n  Ошибка выполнения запроса:\n Canceling statement due to user request",), (None,)], "t string")
    rows = df.select(text.normalize_error("t").alias("n"), text.classify_error("t").alias("c"), text.strip_wrappers("t").alias("w")).collect()
    assert rows[0].n == "Failed <uuid> on <date> after # of 3"
    assert rows[1].c == "statement_cancelled"
    assert rows[1].w == "Canceling statement due to user request"
    assert (rows[2].n, rows[2].c, rows[2].w) == ("", text.OTHER, "")


def test_context(spark):
    df = spark.createDataFrame([("\n  First   line \nsecond", "F", None), (" ", "F", " M "), (None, "", None)], "c string, f string, m string")
    assert [r[0] for r in df.select(text.signature("c", ["f", "m"])).collect()] == ["First line", "F | M", "(signature unavailable)"]
    assert df.select(text.clean(F.lit("abcdefgh"), 6)).first()[0] == "abc..."


def normal(sql):
    return sqlnorm.analyze(sql)["normalized"]


def test_sql_same():
    assert normal("SELECT a FROM tt1 WHERE x = 5 -- c") == normal("select  a /* /* n */ */ from tt900 where x = 77")
    assert normal("SELECT T1.A FROM pg_temp.tt12 T1") == normal("SELECT T1.A FROM tt7 T1")
    assert normal("SELECT 'a'\n'b'") == normal("SELECT 'ab'")
    assert normal("select $a$x$a$, E'q\\'', B'01'") == "select <string> , <string> , <bits>"
    assert normal("select a from t3 where id = 17") == "select a from t3 where id = <number>"
    assert normal("CREATE TEMP TABLE w AS SELECT 1") == normal("CREATE TEMP TABLE v AS SELECT 2")


def test_sql_different():
    pairs = [("select 1 from public.tt1", "select 1 from public.tt2"), ("select a in (1)", "select a in (1, 2)"), ("select a order by 1", "select a order by 2"), ("select x::numeric(10,2)", "select x::numeric(12,4)"), ("select x-1", "select x+1"),
             ("select $1+$1", "select $1+$2"), ("select 1 union select 2", "select 1 union all select 2"), ("select 1 from tt1 a join tt1 b on a.x = b.x", "select 1 from tt1 a join tt2 b on a.x = b.x")]
    for a, b in pairs:
        assert normal(a) != normal(b), a


def test_sql_raw_and_tables(spark):
    for bad in ("select 'x", "select /* a", "select U&\"x\"", "select 'a\\b'", "select $q$ x"):
        assert normal(bad).startswith(sqlnorm.RAW)
    told = sqlnorm.analyze("WITH c AS (SELECT 1 FROM Big) SELECT CASE WHEN 1=1 THEN 2 END FROM c JOIN public.Two t ON t.x = c.y, Three GROUP BY 1 LIMIT 5")
    assert told["tables"] == ["Big", "public.Two", "Three"]
    assert (told["has_join"], told["has_case"], told["has_group_by"], told["has_limit_or_top"], told["has_union"]) == (True, True, True, True, False)
    df = spark.createDataFrame([("select 1",), ("select 2",), ("select 1",), (None,)], "sql_text string")
    rows = sqlnorm.dictionary(df).collect()
    assert len(rows) == 2 and len({r.sql_fingerprint_sha256 for r in rows}) == 1
