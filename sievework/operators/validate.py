"""Validation rules as predicates that produce rows (key, code, severity, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.symbols import hex_id
from sievework.sources.tables import line_rows


def text_problems(df: DataFrame, key: str, text: str) -> DataFrame:
    """NUL, byte-order mark, merge markers and a missing final newline, in one pass over the lines."""
    whole = F.array_compact(
        F.array(
            F.when(F.contains(text, F.lit("\x00")), F.struct(F.lit("nul").alias("code"), F.lit("error").alias("severity"), F.lit(0).alias("line_no"))),
            F.when(F.startswith(text, F.lit("﻿")), F.struct(F.lit("bom").alias("code"), F.lit("warning").alias("severity"), F.lit(1).alias("line_no"))),
            F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), F.struct(F.lit("no-final-newline").alias("code"), F.lit("notice").alias("severity"), F.lit(0).alias("line_no"))),
        )
    )
    once = df.select(key, F.inline(whole))
    marked = line_rows(df.select(key, text), text).filter(F.col("line").rlike(r"^(<{7}|={7}|>{7})( |$)"))
    return once.unionByName(marked.select(key, F.lit("merge-marker").alias("code"), F.lit("error").alias("severity"), "line_no"))


def manifest_rows(df: DataFrame, text: str) -> DataFrame:
    """name;path;&hID;&hParent;bool[;extra] rows with status: ok, blank, malformed; ids as decimals."""
    cells = F.split(text, ";", -1)
    cell = lambda i: F.get(cells, F.lit(i))
    ok = (F.size(cells) >= 5) & cell(2).rlike("^&h[0-9A-Fa-f]{1,16}$") & cell(3).rlike("^&h[0-9A-Fa-f]{1,16}$") & cell(4).isin("true", "false")
    status = F.when(F.trim(text) == "", "blank").when(~F.coalesce(ok, F.lit(False)), "malformed").otherwise("ok")
    return df.select("*", cell(0).alias("name"), cell(1).alias("path"), hex_id(cell(2)).alias("id"), hex_id(cell(3)).alias("parent"), status.alias("status"))


def manifest_problems(df: DataFrame, project: str, line_no: str, text: str) -> DataFrame:
    """(project, line, code, note) of a manifest's rows: blank, malformed, duplicate-id (note: the first line), dangling-parent."""
    rows = manifest_rows(df, text)
    bad = rows.filter("status != 'ok'").select(project, line_no, F.col("status").alias("code"), F.lit(None).cast("string").alias("note"))
    good = rows.filter("status = 'ok'")
    w = Window.partitionBy(project, "id").orderBy(line_no)
    again = good.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first(line_no).over(w)).filter("_n > 1")
    ids = good.select(project, F.col("id").alias("parent")).distinct()
    lost = good.filter("parent != 0").join(ids, [project, "parent"], "left_anti")
    duplicate = again.select(project, line_no, F.lit("duplicate-id").alias("code"), F.col("_first").cast("string").alias("note"))
    return bad.unionByName(duplicate).unionByName(lost.select(project, line_no, F.lit("dangling-parent").alias("code"), F.col("parent").cast("string").alias("note")))
