"""Message logs: framing, correlation of messages with claims, quiet periods and bounded journals.

Each function takes a static or a streaming DataFrame unless it says otherwise; on a stream, event-time state is
bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def framed(log: DataFrame, data: str, cap: int = 16 << 20) -> DataFrame:
    """One row per NUL-terminated frame of a recorded byte log: the log's other columns, seq, frame, problem.

    The bytes after the last NUL are an unfinished frame; a frame over the cap is reported, not returned.
    """
    rest = [c for c in log.columns if c != data]
    parts = F.split(F.col(data).cast("string"), "\\x00", -1)
    rows = log.select(*rest, F.size(parts).alias("_n"), F.posexplode(parts).alias("seq", "frame"))
    last = F.col("seq") == F.col("_n") - 1
    problem = F.when(last, "unfinished").when(F.octet_length("frame") > cap, "too-long")
    return rows.filter(~last | (F.col("frame") != "")).withColumn("problem", problem).withColumn("frame", F.when(F.col("problem").eqNullSafe(F.lit("too-long")), None).otherwise(F.col("frame"))).drop("_n")


def correlated(messages: DataFrame, claims: DataFrame, seconds: int = 2, watermark: str = "10 seconds") -> DataFrame:
    """messages(seq, tag, at) left joined with claims(tag, at) of the same tag within `seconds`: the stream-stream interval join."""
    m = messages.withWatermark("at", watermark).alias("m")
    c = claims.select("tag", F.col("at").alias("claimed_at")).withWatermark("claimed_at", watermark).alias("c")
    near = F.expr(f"m.tag = c.tag and m.at between c.claimed_at - interval {seconds} seconds and c.claimed_at + interval {seconds} seconds")
    joined = m.join(c, near, "leftOuter")
    return joined.select("m.*", "claimed_at", F.when(F.col("claimed_at").isNotNull(), "trailing").otherwise("out-of-band").alias("channel"))


def replies(messages: DataFrame, quiet: str = "250 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """(tag, start, end, parts): the parts of split replies, a reply ending when its tag has been quiet for that long."""
    s = messages.withWatermark("at", watermark).groupBy("tag", F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("parts"))
    return s.select("tag", "w.start", "w.end", "parts")


def completed(messages: DataFrame, sentinel: str) -> DataFrame:
    """(tag, complete): whether a tag's sentinel has been seen."""
    return messages.groupBy("tag").agg(F.max(F.col("response") == sentinel).alias("complete"))


def journal(messages: DataFrame, max_messages: int = 1024, max_bytes: int = 64 << 20) -> DataFrame:
    """Static log(channel, seq, bytes) with `live`: whether a journal of that bound still holds it at the channel's end; the newest always is held."""
    newer = Window.partitionBy("channel").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    n, size = F.count("*").over(newer), F.sum("bytes").over(newer)
    return messages.withColumn("live", (n == 1) | ((n <= max_messages) & (size <= max_bytes)))


REPLY = "tag string, start timestamp, end timestamp, parts long, ended string"
_OPEN = T.StructType([T.StructField("start", T.LongType()), T.StructField("last", T.LongType()), T.StructField("parts", T.LongType())])


def _step(open_: tuple[int, int, int] | None, at: int, sentinel: bool, quiet: int, deadline: int) -> tuple[list[tuple], tuple[int, int, int] | None]:
    """A message at a time (microseconds): the replies that it ends, as (start, last, parts, ended), and the reply that is open after it."""
    done = []
    if open_ and at >= _ends(open_, quiet, deadline):
        done.append((*open_, _reason(open_, quiet, deadline)))
        open_ = None
    start, _, parts = open_ or (at, at, 0)
    open_ = (start, at, parts + 1)
    if sentinel:
        return [*done, (*open_, "sentinel")], None
    return done, open_


def _ends(open_: tuple[int, int, int], quiet: int, deadline: int) -> int:
    return min(open_[0] + deadline, open_[1] + quiet)


def _reason(open_: tuple[int, int, int], quiet: int, deadline: int) -> str:
    return "quiet" if open_[1] + quiet <= open_[0] + deadline else "deadline"


class _Replies(StatefulProcessor):
    """The open reply of a tag, and a timer for when it ends by itself; state goes with the reply."""

    def __init__(self, sentinel: str, quiet: int, deadline: int):
        self.sentinel, self.quiet, self.deadline = sentinel, quiet, deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _settle(self, open_: tuple[int, int, int] | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_ is None:
            self.open.clear()
        else:
            self.open.update(open_)
            self.handle.registerTimer(-(-_ends(open_, self.quiet, self.deadline) // 1000))

    def _rows(self, key, done: list[tuple]) -> pd.DataFrame:
        time = lambda i: pd.to_datetime(pd.Series([d[i] for d in done], dtype="int64"), unit="us")
        return pd.DataFrame({"tag": [key[0]] * len(done), "start": time(0), "end": time(1), "parts": [d[2] for d in done], "ended": [d[3] for d in done]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new.assign(us=new["at"].astype("datetime64[us]").astype("int64")).sort_values(["us", "seq"])
        open_, done = tuple(self.open.get()) if self.open.exists() else None, []
        for at, response in zip(new["us"].tolist(), new["response"].tolist(), strict=True):
            ended, open_ = _step(open_, at, response == self.sentinel, self.quiet, self.deadline)
            done += ended
        self._settle(open_)
        if done:
            yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            open_ = tuple(self.open.get())
            self.open.clear()
            yield self._rows(key, [(*open_, _reason(open_, self.quiet, self.deadline))])

    def close(self) -> None:
        pass


def ended_replies(messages: DataFrame, sentinel: str, quiet_ms: int = 250, deadline_ms: int = 10_000, watermark: str = "10 seconds") -> DataFrame:
    """(tag, start, end, parts, ended) of replies in messages(seq, tag, at, response): each ends at its sentinel, when its tag has been
    quiet for so long, or at its deadline after the first part, whichever comes first; `ended` says which. `end` is its last part's time.

    On a stream state is one open reply a tag, and a timer ends it when the watermark passes its end, so that it goes without a further
    message. Messages later than the watermark are dropped. A static log gives the same replies: it is cut at quiet
    periods by a window and each piece is walked in order, so that a busy tag is the work of many tasks.
    """
    quiet, deadline = quiet_ms * 1000, deadline_ms * 1000
    if messages.isStreaming:
        rows = messages.select("seq", "tag", "at", "response").withWatermark("at", watermark).groupBy("tag")
        return rows.transformWithStateInPandas(statefulProcessor=_Replies(sentinel, quiet, deadline), outputStructType=REPLY, outputMode="Append", timeMode="EventTime")

    w = Window.partitionBy("tag").orderBy("us", "seq")
    rows = messages.select("seq", "tag", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.coalesce(F.col("response") == sentinel, F.lit(False)).alias("stop"))
    fresh = F.coalesce(F.col("us") - F.lag("us").over(w) >= quiet, F.lit(False)).cast("int")
    rows = rows.withColumn("_fresh", fresh).withColumn("piece", F.sum("_fresh").over(w)).drop("_fresh")
    rows = rows.repartition("tag", "piece").sortWithinPartitions("tag", "piece", "us", "seq").select("tag", "piece", "us", "stop")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[]] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["tag", "start", "end", "parts", "ended"])

        for b in it:
            done = []
            for tag, piece, us, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (tag, piece) != at:
                    if open_:
                        done.append((at[0], *open_, _reason(open_, quiet, deadline)))
                    at, open_ = (tag, piece), None
                ended, open_ = _step(open_, us, stop, quiet, deadline)
                done += [(tag, *e) for e in ended]
            yield out(done)
        if open_:
            yield out([(at[0], *open_, _reason(open_, quiet, deadline))])

    found = rows.mapInArrow(run, "tag string, start long, end long, parts long, ended string")
    return found.select("tag", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "parts", "ended")
