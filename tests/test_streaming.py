"""Message-log operators on static rows and on a file stream."""

import datetime as dt

from sievework.streaming import messages as M

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def test_frames(spark):
    rows = M.framed(spark.createDataFrame([("c", bytearray(b"one\0two\0\0par"))], "ch string, data binary"), "data", cap=10).collect()
    assert [(r["seq"], r["frame"], r["problem"]) for r in rows] == [(0, "one", None), (1, "two", None), (2, "", None), (3, "par", "unfinished")]


def test_channels_and_replies(spark):
    m = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(100)), (3, "a", at(5900)), (4, "b", at(0))], "seq long, tag string, at timestamp")
    c = spark.createDataFrame([("a", at(500))], "tag string, at timestamp")
    assert {r["seq"]: r["channel"] for r in M.correlated(m, c).collect()} == {1: "trailing", 2: "trailing", 3: "out-of-band", 4: "out-of-band"}
    assert sorted((r["tag"], r["parts"]) for r in M.replies(m).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_equals_batch(spark, tmp_path):
    m = spark.createDataFrame([(i, "a" if i % 3 else "b", at(90 * i * (1 + i % 4))) for i in range(40)], "seq long, tag string, at timestamp")
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = M.replies(stream, watermark="1 hour").writeStream.format("memory").queryName("replies_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["tag"], r["start"], r["parts"]) for r in df.collect())
    assert key(spark.table("replies_out")) == key(M.replies(m))


def test_journal_keeps_the_newest(spark):
    rows = spark.createDataFrame([("c", i, 10) for i in range(5)], "channel string, seq long, bytes long")
    assert [r["seq"] for r in M.journal(rows, max_messages=3, max_bytes=25).filter("live").orderBy("seq").collect()] == [3, 4]
