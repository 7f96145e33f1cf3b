"""Differences of two texts of a row: line by line, as hunks with context, and counted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.arrow import cut
from sievework.functions.differences import aligned

#: Unchanged lines that a hunk shows before and after its changes.
CONTEXT = 3


def line_changes(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """keys, seq, op, before_no, after_no, line: all lines of both texts in one order, along a longest common subsequence.

    op is ' ' for a line of both, '-' for one of `before` alone and '+' for one of `after`. The numbers count the lines of each
    text so far. A null text has no lines, and a last break ends the last line.
    """
    fields = df.select(*keys).schema.fields
    lines = lambda c: F.split(F.regexp_replace(c, r"(?:\r\n|\n|\r)\z", ""), r"\r\n|\n|\r", -1)
    listed = lambda c: F.when(F.length(c) > 0, lines(c)).otherwise(F.array().cast("array<string>"))
    source = df.select(*keys, listed(F.col(before)).alias("_a"), listed(F.col(after)).alias("_b"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "seq int, op string, before_no int, after_no int, line string"])
    names = [*(f.name for f in fields), "seq", "op", "before_no", "after_no", "line"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(it):
            for i, (x, y) in enumerate(zip(b.column(len(fields)).to_pylist(), b.column(len(fields) + 1).to_pylist(), strict=True)):
                rows = aligned(x or [], y or [])
                if rows:
                    op, left, right, line = zip(*rows, strict=True)
                    at = pa.array([i] * len(rows))
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(fields))), pa.array(range(len(rows)), pa.int32()), pa.array(op), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(line)], names)

    return source.mapInArrow(run, schema)


def hunks(changes: DataFrame, keys: list[str], context: int = CONTEXT) -> DataFrame:
    """keys, hunk, header, body: the changes of line_changes() with their context, by windows over a text's lines; hunks whose contexts touch are one.

    The header and the body are those of the unified format.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    shown = changes.withColumn("_near", F.max(F.col("op") != " ").over(w.rowsBetween(-context, context))).filter("_near")
    fresh = F.coalesce(F.col("seq") - F.lag("seq").over(w) > 1, F.lit(True)).cast("int")
    shown = shown.withColumn("_fresh", fresh).withColumn("hunk", F.sum("_fresh").over(w))
    g = shown.groupBy(*keys, "hunk").agg(
        F.min(F.struct("seq", "op", "before_no", "after_no")).alias("_f"), F.count_if(F.col("op") != "+").alias("_a"), F.count_if(F.col("op") != "-").alias("_b"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat("op", "line").alias("line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    # The numbers of the first line count itself where it is of that text; a side without lines names the line before.
    start = lambda no, other, n: F.col(f"_f.{no}") + F.when((F.col("_f.op") == other) & (F.col(n) > 0), 1).otherwise(0)
    span = lambda at, n: F.concat(at.cast("string"), F.when(F.col(n) != 1, F.concat(F.lit(","), F.col(n).cast("string"))).otherwise(""))
    header = F.concat(F.lit("@@ -"), span(start("before_no", "+", "_a"), "_a"), F.lit(" +"), span(start("after_no", "-", "_b"), "_b"), F.lit(" @@"))
    return g.select(*keys, "hunk", header.alias("header"), "body")


def change_counts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, added, removed: how many lines line_changes() adds and removes."""
    return changes.groupBy(*keys).agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))
