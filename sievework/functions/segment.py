"""Masks over source text: what is code, what is literal, what stands under a condition. Lengths are preserved."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.sources.tables import line_rows

_LITERAL_OR_COMMENT = re.compile(r'"[^"\n]*(?:"|(?=\n)|\Z)|(?:\'|//)[^\n]*')
_REMARK = re.compile(r"\s*rem\b", re.I)
_TAG = re.compile(r"\s*#tag\s+(?:(end)(?=[a-z])|(?!end))([a-z]+)", re.I)
_BLOCK = re.compile(r"\s*begin\s+[a-z_]", re.I)
_BLOCK_END = re.compile(r"\s*end\s*", re.I)
_DIRECTIVE = re.compile(r"\s*#(if|elseif|endif)\b(.*)", re.I)
_ONE_LINE = re.compile(r".*?\bthen\b\s*\S", re.I)

# Tags whose content is no code, compared with case; tags that never open a region.
NO_CODE_TAGS = frozenset(["ViewBehavior", "ViewProperty", "Note", "Constant", "EnumValues"])
LONE_TAGS = frozenset(["instance", "compatibilityflags"])
# Blocks of prose or literals in the second, simpler segmentation.
PROSE = r"(?i)^\s*#tag\s+(note|constant|enum)\b"
PROSE_END = r"(?i)^\s*#tag\s+end(note|constant|enum)\b"


def _blank(m: re.Match) -> str:
    s = m[0]
    if not s.startswith('"'):
        return " " * len(s)
    closed = len(s) > 1 and s.endswith('"')
    return '"' + " " * (len(s) - 1 - closed) + '"' * closed


def masked_line(line: str) -> str:
    """Contents of literals and comments blanked; a line that starts with Rem is blank as a whole."""
    return " " * len(line) if _REMARK.match(line) else _LITERAL_OR_COMMENT.sub(_blank, line)


def _kept_lines(text: str, keep) -> str:
    """text with the lines blanked for which keep(line) gives None, and else what it gives."""
    out = []
    for raw in text.splitlines(keepends=True):
        line = raw.rstrip("\r\n")
        kept = keep(line)
        out.append((" " * len(line) if kept is None else kept) + raw[len(line) :])
    return "".join(out)


def masked_text(text: str) -> str:
    """Code alone: tag lines, the content of tags that hold none, and layout blocks are blanked; the rest is masked line by line.

    A closing tag counts only if it closes the innermost open one. What a tag suppresses opens no layout block.
    """
    tags: list[str] = []
    layout = 0

    def keep(line: str) -> str | None:
        nonlocal layout
        if m := _TAG.match(line):
            if not m[1]:
                tags.extend([m[2]] * (m[2].lower() not in LONE_TAGS))
            elif tags and tags[-1].lower() == m[2].lower():
                tags.pop()
        elif not any(t in NO_CODE_TAGS or t.rstrip("s") in NO_CODE_TAGS for t in tags):
            if _BLOCK.match(line):
                layout += 1
            elif not layout:
                return masked_line(line)
            elif _BLOCK_END.fullmatch(line):
                layout -= 1
        return None

    return _kept_lines(text, keep)


def conditional_text(code: str) -> str:
    """Of masked code, the conditional constructs that name a target, their other branches and directives included; all else blanked.

    A directive with its statement on one line opens nothing.
    """
    opened: list[bool] = []

    def keep(line: str) -> str | None:
        inside = any(opened)
        if m := _DIRECTIVE.match(line):
            word, names = m[1].lower(), "target" in m[2].lower()
            if word != "endif" and _ONE_LINE.match(m[2]):
                return line if inside or names else None
            if word == "if":
                opened.append(names)
            elif word == "elseif":
                opened[-1:] = [opened[-1] or names] if opened else []
            else:
                del opened[-1:]
        return line if inside or any(opened) else None

    return _kept_lines(code, keep)


def _mapped(f):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else f(t))

    return run


#: Literal contents and comments blanked; quotes stay, and so does every offset.
code_only = _mapped(lambda t: "".join(masked_line(x) for x in re.split(r"(\n)", t)))
#: The same with everything blanked that is no code: tags, notes, constants, layout.
code_text = _mapped(masked_text)


@F.pandas_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("target", T.StringType())]))
def code_and_target(text: pd.Series) -> pd.DataFrame:
    """Both of the next, each text masked once."""
    code = text.map(lambda t: None if t is None else masked_text(t))
    return pd.DataFrame({"code": code, "target": code.map(lambda t: None if t is None else conditional_text(t))})


#: What of the code stands in constructs that depend on the target.
target_text = _mapped(lambda t: conditional_text(masked_text(t)))


def sections(df: DataFrame, text: str, opening: str, closing: str) -> DataFrame:
    """Lines with `inside`: whether a line lies in a section between lines matching opening and closing.

    The last such line before decides, by a window over the lines of each row's text; native, without a fold. Sections
    do not nest.
    """
    rows = line_rows(df.withColumn("_row", F.monotonically_increasing_id()), text)
    w = Window.partitionBy("_row").orderBy("line_no")
    state = F.when(F.col("line").rlike(opening), True).when(F.col("line").rlike(closing), False)
    return rows.withColumn("inside", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(False))).drop("_row")


def code_lines(df: DataFrame, text: str) -> DataFrame:
    """Lines outside prose blocks and tags, with literals as "" and without comments; those left blank go."""
    rows = sections(df, text, PROSE, PROSE_END).filter(~F.col("inside") & ~F.col("line").rlike(r"^\s*#tag") & ~F.col("line").rlike(PROSE_END))
    line = F.regexp_replace(F.regexp_replace("line", r'"[^"]*+(?:""[^"]*+)*+"', '""'), r"(?i)(?://|'|\brem\b).*$", "")
    return rows.withColumn("line", line).filter(F.trim(F.regexp_replace("line", r"\s", "")) != "").drop("inside")


def literal_chars(text: Column) -> Column:
    """Characters inside double-quoted literals."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(r'"([^"\n]*)"'), 1), F.lit(0), lambda n, s: n + F.length(s))
