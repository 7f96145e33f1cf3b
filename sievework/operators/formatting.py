"""Formatting of source files: tag lines, manifest keys, line endings; and which files it would change."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"[ \t]*#tag\s+(.*?)[ \t]*", re.I)
_END = re.compile(r"End([A-Za-z][A-Za-z0-9]*)")
_KIND = re.compile(r"([A-Za-z][A-Za-z0-9]*)(?:\s+.*|\s*,.*|\s*=.*)?")


def line_policy(text: Column, ending: str = "preserve", final: str = "add") -> Column:
    """Line endings lf, crlf or preserve; a final one to add where it is missing, to strip, or to preserve. Empty text stays empty."""
    x = text if ending == "preserve" else F.regexp_replace(text, r"\r\n|\r|\n", {"lf": "\n", "crlf": "\r\n"}[ending])
    if final == "preserve":
        return x
    if final == "strip":
        return F.regexp_replace(x, r"[\r\n]+$", "")
    own = F.when(F.contains(x, F.lit("\r\n")), "\r\n").when(F.contains(x, F.lit("\r")), "\r").otherwise("\n")
    return F.when((x != "") & ~x.rlike(r"[\r\n]\z"), F.concat(x, own)).otherwise(x)


def manifest_keys(text: Column) -> Column:
    """White space around the keys of key=value lines dropped; values keep theirs."""
    return F.regexp_replace(text, r"(?m)^[ \t]*([A-Za-z][A-Za-z0-9_]*)[ \t]*=", "$1=")


def indented_tags(text: str, outdented: frozenset[str] = frozenset()) -> str:
    """Tag lines indented by a tab for each open tag, closings named by what they close; other lines stay.

    A tag of a kind that nothing in the text closes opens nothing. Outdented kinds stand at the margin.
    """
    lines = re.split(r"(\r\n|\n|\r)", text)
    tags = {i: m[1] for i in range(0, len(lines), 2) if (m := _TAG.fullmatch(lines[i]))}
    closed = {m[1].lower() for t in tags.values() if (m := _END.fullmatch(t))}
    opened: list[str] = []
    for i, tag in tags.items():
        if m := _END.fullmatch(tag):
            kind = opened.pop() if opened else m[1]
            lines[i] = "\t" * (0 if kind in outdented else len(opened)) + f"#tag End{kind}"
        elif m := _KIND.fullmatch(tag):
            lines[i] = "\t" * (0 if m[1] in outdented else len(opened)) + f"#{'Tag' if m[1] == 'Instance' else 'tag'} {tag}"
            opened += [m[1]] * (m[1].lower() in closed)
    return "".join(lines)


@F.pandas_udf(T.StringType())
def tags_indented(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else indented_tags(t))


def would_change(df: DataFrame, text: str, formatted: Column) -> DataFrame:
    """Rows whose text its formatted form differs from."""
    return df.withColumn("formatted", formatted).filter(~F.col("formatted").eqNullSafe(F.col(text)))
