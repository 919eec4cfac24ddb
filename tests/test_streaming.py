from datetime import datetime, timedelta

from fieldqueue.streaming import events

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    """The rows as files that a stream reads one by one."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_fresh_drops_repeats(spark, tmp_path):
    rows = [[(1, T0), (2, T0)], [(1, T0), (3, T0)]]
    got = collected(spark, events.fresh(stream(spark, tmp_path, rows, "k long, ts timestamp"), "k", "ts", "1 hour"), tmp_path, "fresh")
    assert sorted(r[0] for r in got) == [1, 2, 3]


def test_sessions_split_at_gaps(spark, tmp_path):
    rows = [[("a", T0 + timedelta(minutes=m)) for m in (0, 5, 40)], [("a", T0 + timedelta(days=2))]]
    got = collected(spark, events.sessions(stream(spark, tmp_path, rows, "u string, ts timestamp"), "ts", "1 minute", "10 minutes", "u"), tmp_path, "sessions")
    assert sorted(r[3] for r in got) == [1, 2]


def test_counts_by_window(spark, tmp_path):
    rows = [[("x", T0), ("x", T0 + timedelta(minutes=20)), ("y", T0)], [("x", T0 + timedelta(days=1))]]
    got = collected(spark, events.counts(stream(spark, tmp_path, rows, "k string, ts timestamp"), "ts", "1 minute", "1 hour", "k"), tmp_path, "counts")
    assert sorted((r[1], r[2]) for r in got) == [("x", 2), ("y", 1)]


def test_upsert_keeps_newest(spark, tmp_path):
    rows = [[(1, T0, "a"), (2, T0, "a")], [(1, T0 + timedelta(hours=1), "b"), (2, T0 - timedelta(hours=1), "old")]]
    q = events.upsert_stream(stream(spark, tmp_path, rows, "id long, updated_at timestamp, v string"), str(tmp_path / "t"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "t/v1")).collect()
    assert {r["id"]: r["v"] for r in got} == {1: "b", 2: "a"}


def test_grade_is_reached_once(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [[(1, at(0), "a"), (2, at(0), "a")], [(1, at(1), "b"), (2, at(1), "a")], [(1, at(2), "a"), (1, at(3), "a"), (1, at(4), "a"), (2, at(5), "a")]]
    got = collected(spark, events.grades(stream(spark, tmp_path, rows, "id long, ts timestamp, answer string")), tmp_path, "grades")
    assert sorted((r[0], r[2], r[3]) for r in got) == [(1, 4, 3), (2, 2, 2)]


def test_grades_forget_records_without_votes(spark, tmp_path):
    at = lambda d: T0 + timedelta(days=d)
    rows = [[(1, at(0), "a")], [(2, at(50), "b")], [(2, at(51), "b")], [(1, at(52), "a")]]
    got = collected(spark, events.grades(stream(spark, tmp_path, rows, "id long, ts timestamp, answer string"), "1 hour", 5 * 86_400_000), tmp_path, "forgotten")
    assert [r[0] for r in got] == [2]
