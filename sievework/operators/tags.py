"""Balance of nested tags: a stack per text, with recovery at mismatched closings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.functions.arrow import cut

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^>]*?(/?)>")
# Elements whose content is raw, and those without content, after the HTML standard.
RAW = frozenset(["script", "style"])
STANDALONE = frozenset("area base br col embed hr img input link meta source track wbr".split())


def walk(text: str, standalone: frozenset[str]) -> list[tuple[int, str, str]]:
    """(offset, problem, tag): `unexpected` close while nothing is open, `mismatched` close of another than the innermost, `unclosed` at the end.

    A mismatched close closes all up to its opener, or the innermost alone if it has none. What stands in scripts and
    styles is no tag.
    """
    found, stack, at = [], [], 0
    while m := _TAG.search(text, at):
        tag, at = m[2].lower(), m.end()
        if m[3] or tag in standalone:
            continue
        if not m[1]:
            stack.append((m.start(), tag))
            if tag in RAW:
                end = text.lower().find(f"</{tag}", at)
                at = end if end >= 0 else len(text)
            continue
        if not stack or stack[-1][1] != tag:
            found.append((m.start(), "mismatched" if stack else "unexpected", tag))
        depth = max((i for i, x in enumerate(stack) if x[1] == tag), default=len(stack) - 1)
        del stack[max(depth, 0) :]
    return found + [(at, "unclosed", t) for at, t in stack]


def problems(df: DataFrame, key: str, text: str, standalone: frozenset[str] = STANDALONE) -> DataFrame:
    """(key, problem, tag, n, first_offset) of each text."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(it):
            rows = [(k, *p) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in walk(t or "", standalone)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], [key, "at", "problem", "tag"])

    from pyspark.sql import functions as F

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, at long, problem string, tag string").groupBy(key, "problem", "tag").agg(F.count("*").alias("n"), F.min("at").alias("first_offset"))
