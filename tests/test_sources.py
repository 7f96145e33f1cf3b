"""Byte-preserving text, splittable headed files, keyed tables with deletes, and replies with deadlines on a stream and off it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sievework.sources import tables
from sievework.streaming import messages as M


def test_every_byte_comes_back(spark):
    r = random.Random(1)
    cases = [bytes(range(256)), b"", "é\r\n日本 \U0010ff80\U0010ffff\U0010ff7f".encode(), b"\xf4\x8f\xbf", b"\xed\xa0\x80", b"\xc3", b"a\x00b\r"] + [bytes(r.choices(range(256), k=40)) for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)] + [(len(cases), None)], "i int, c binary")
    got = [x[0] for x in df.orderBy("i").select(tables.bytes_of(tables.text_of("c"))).collect()]
    assert [None if g is None else bytes(g) for g in got] == [*cases, None]
    edited = df.filter(f"i = {len(cases) - 201 - 0}").union(spark.createDataFrame([(-1, bytearray(b"old\xff\r\nold\xc3"))], "i int, c binary"))
    out = {x["i"]: bytes(x["o"]) for x in edited.select("i", tables.bytes_of(F.replace(tables.text_of("c"), F.lit("old"), F.lit("newé"))).alias("o")).collect()}
    assert out[-1] == b"new\xc3\xa9\xff\r\nnew\xc3\xa9\xc3"


def test_headed_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    big = "b\ta\n" + "".join(f"{i}\tx{i}\n" for i in range(20_000)) + "b\ta\n"
    (tmp_path / "one.tsv").write_text(big)
    (tmp_path / "two.tsv").write_text("a\tc\tb\r\ny\tz\t1\r\nshort\r\n")
    (tmp_path / "three.tsv").write_text("a\tb\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = tables.headed_tsv(spark, str(tmp_path), ["a", "b"])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        want = sorted([(f"x{i}", str(i)) for i in range(20_000)] + [("a", "b"), ("y", "1"), ("short", "")])
        assert sorted(map(tuple, df.collect())) == want
        monkeypatch.setattr(tables, "FILES_SENT", 0)
        assert sorted(map(tuple, tables.headed_tsv(spark, str(tmp_path), ["a", "b"]).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lacking = tables.headed_tsv(spark, str(tmp_path), ["a", "c"])  # no error before rows are read
    with pytest.raises(Exception, match="lacks c"):
        lacking.collect()


def test_keyed_lines(spark):
    lines = ["k1\ta\t1", "k2\tb", "", "\tc\t3", "k1\td\t4", "k3\t\t"]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")
    rows, refused = tables.keyed_lines(df, "line", ["key", "a", "b"], "key")
    assert sorted(map(tuple, rows.collect())) == [("k1", "d", "4"), ("k3", "", "")]
    assert sorted((x["line_no"], x["reason"]) for x in refused.collect()) == [(2, "2 cells"), (4, "no key")]


def test_replay_and_save(spark, tmp_path):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    log = spark.createDataFrame([(1, "set", "b", 3), (2, "remove", "b", None), (3, "remove", "a", None), (4, "set", "a", 9), (5, "remove", "x", None), (6, "set", "d", None), (7, "set", "c", None)], "n int, op string, k string, v int")
    after = tables.replayed(base, log, ["k"], "n")
    assert sorted(map(tuple, after.collect())) == [("a", 9), ("c", None), ("d", None)]
    assert sorted(map(tuple, tables.differing(base, after, ["k"]).collect())) == [("a", "changed"), ("b", "removed"), ("d", "added")]
    assert tables.saved(base, after, ["k"], str(tmp_path / "out")) and not tables.saved(after, after, ["k"], str(tmp_path / "again"))
    assert not (tmp_path / "again").exists()
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "a\t9\nc\t\nd\t\n"


def test_stale_needs_a_build_that_made_something(spark):
    listing = spark.createDataFrame([("A.md",), ("b.md",)], "path string")
    made = spark.createDataFrame([("a.MD",)], "path string")
    assert [x[0] for x in tables.stale(listing, made, "path", True).collect()] == ["b.md"]
    assert tables.stale(listing, made.limit(0), "path", True).count() == 0 and tables.stale(listing, made, "path", False).count() == 0


T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


LOG = [
    (1, "done", 0, "part"), (2, "done", 100, "part"), (3, "done", 150, "STOP"),  # by its sentinel
    (4, "quiet", 0, "part"), (5, "quiet", 240, None), (6, "quiet", 490, "part"),  # a pause of just the quiet period
    (7, "slow", 0, "part"), (8, "slow", 200, "part"), (9, "slow", 400, "part"), (10, "slow", 600, "part"), (11, "slow", 800, "part"), (12, "slow", 1000, "part"), (13, "slow", 1100, "STOP"),  # beyond the deadline
    (14, "lone", 5000, "STOP"),
]
ENDED = [("done", 0, 150, 3, "sentinel"), ("lone", 5000, 5000, 1, "sentinel"), ("quiet", 0, 240, 2, "quiet"), ("quiet", 490, 490, 1, "quiet"), ("slow", 0, 800, 5, "deadline"), ("slow", 1000, 1100, 2, "sentinel")]


def shown(rows):
    ms = lambda t: round((t.replace(tzinfo=None) - T0).total_seconds() * 1000)
    return sorted((r["tag"], ms(r["start"]), ms(r["end"]), r["parts"], r["ended"]) for r in rows)


def test_replies_end(spark):
    df = spark.createDataFrame([(n, tag, at(ms), x) for n, tag, ms, x in LOG], "seq long, tag string, at timestamp, response string").repartition(5)
    assert shown(M.ended_replies(df, "STOP", 250, 1000).collect()) == ENDED
    assert M.ended_replies(df.limit(0), "STOP").count() == 0


def test_replies_end_on_a_stream(spark, tmp_path):
    """Messages arrive over several batches; late and missing sentinels are ended by timers, and no state is left."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "seq long, tag string, at timestamp, response string"
    batches = [[m for m in LOG if m[2] <= 240], [m for m in LOG if 240 < m[2] <= 800], [m for m in LOG if m[2] > 800], [(90, "last", 60_000, "STOP")], [(91, "done", 10, "part"), (92, "last", 120_000, "STOP")]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = M.ended_replies(stream, "STOP", 250, 1000, watermark="1 second").writeStream.format("memory").queryName("ended_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(batches):
            lines = "".join(f'{{"seq": {n}, "tag": "{tag}", "at": "{at(ms).isoformat()}", "response": "{x or ""}"}}\n' for n, tag, ms, x in rows)
            (tmp_path / "tmp").write_text(lines)
            (tmp_path / "tmp").rename(tmp_path / "in" / f"{i}.json")
            q.processAllAvailable()
        got = shown(spark.table("ended_out").collect())
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    assert [g for g in got if g[0] != "last"] == ENDED  # the part at 10 ms came after the watermark and is dropped
    assert state == 0
