from sparktrace.streaming import live


def test_minutes_of_arriving_logs(spark, tmp_path):
    own = tmp_path / "logs" / "cap" / "rphost_1"
    own.mkdir(parents=True)

    def counts():
        query = live.minute_counts(live.live_events(spark, str(tmp_path / "logs"))).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return {(r.event_type, r.minute.start.minute): r["count"] for r in spark.read.schema("minute struct<start:timestamp,end:timestamp>, dataset_id string, event_type string, count long").parquet(str(tmp_path / "out")).collect()}

    (own / "26090310.log").write_text("00:01.000000-5,CALL,1,Usr=U\n00:02.000000-5,CALL,1,Usr=U\n01:02.000000-5,EXCP,1,Usr=U\n")
    counts()
    (own / "26090312.log").write_text("00:01.000000-5,CALL,1,Usr=U\n")
    got = counts()
    assert got[("CALL", 0)] == 2 and got[("EXCP", 1)] == 1
