"""Streams over finite input: late pings are left out, repeated runs come once, results equal those of the batch."""

import datetime as dt

from evidencia.streaming import telemetry

DAY = dt.datetime(2024, 1, 1)


def written(rows, folder, n):
    rows.coalesce(1).write.parquet(f"{folder}/{n}")
    return f"{folder}/{n}"


def test_pings_later_than_the_watermark_are_left_out(spark, tmp_path):
    schema = "id long, lang string, file_bucket string, has_byok long, ts timestamp"
    at = lambda h, m=0: DAY + dt.timedelta(hours=h, minutes=m)
    batches = [[(1, "go", "1-49", 1, at(1)), (2, "go", "50-199", 0, at(1, 30))], [(3, "py", "1-49", 0, at(6))], [(4, "go", "200-499", 1, at(1, 45)), (5, "py", "1-49", 1, at(5, 30)), (6, "go", "1-49", 0, at(9))], [(7, "go", "1-49", 0, at(20))]]
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = telemetry.hourly_stream(stream).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for n, rows in enumerate(batches):
            written(spark.createDataFrame(rows, schema), folder, n)
            query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.hour.hour, r.lang): (r.runs, r.max_bucket, r.byok) for r in spark.table("late").collect()}
    # ping 4 came after its hour was closed; ping 5 within the hour of grace
    assert got == {(1, "go"): (2, "50-199", 1), (5, "py"): (1, "1-49", 1), (6, "py"): (1, "1-49", 0), (9, "go"): (1, "1-49", 0)}


def test_runs_that_were_sent_twice_come_once(spark, tmp_path):
    schema = "run_id string, ts timestamp"
    rows = [("a", DAY), ("a", DAY + dt.timedelta(minutes=5)), ("b", DAY)]
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(2):  # the second file repeats the first
        written(spark.createDataFrame(rows, schema), folder, n)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
    query = telemetry.distinct_runs(stream).writeStream.outputMode("append").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.run_id for r in spark.table("runs").collect()) == ["a", "b"]
