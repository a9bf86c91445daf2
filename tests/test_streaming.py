import datetime as dt

from parsloom.streaming import counts


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def finished(spark, df, tmp_path, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_running_counts(spark, tmp_path):
    df = stream(spark, tmp_path, [("الف ب. الف",), (None,), ("",)], "text string")
    out = finished(spark, counts.running_counts(df), tmp_path, "complete", "running")
    assert {r["token"]: r["c"] for r in out.collect()} == {"الف": 2, "ب": 1, ".": 1}


def test_running_bigrams(spark, tmp_path):
    df = stream(spark, tmp_path, [("الف ب الف ب",)], "text string")
    out = finished(spark, counts.running_bigrams(df), tmp_path, "complete", "pairs")
    assert {(r["prev"], r["w"]): r["c"] for r in out.collect()} == {("الف", "ب"): 2, ("ب", "الف"): 1}


def test_windows(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10, 5)
    df = stream(spark, tmp_path, [(at, "الف"), (at + dt.timedelta(minutes=10), "الف"), (at + dt.timedelta(hours=2), "الف")], "at timestamp, text string")
    out = finished(spark, counts.windowed_counts(df, "at"), tmp_path, "complete", "windows")
    assert sorted(r["c"] for r in out.collect()) == [1, 2]
