"""Column functions on symbols, messages, releases and replacement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that Unicode case folding takes for ASCII letters, and those letters.
FOLD_FROM, FOLD_TO = "İıſK", "iisk"


def folded(text: Column) -> Column:
    """Lower case, with the four characters that case-insensitive matching takes for ASCII letters as those letters."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def release(text: Column) -> Column:
    """'2021r2.1' as struct(year, number, minor), which compares in release order; null if it is none."""
    part = lambda i: F.regexp_extract(text, r"^(\d{4})r(\d+)(?:\.(\d+))?$", i)
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("year"), part(2).cast("int").alias("number"), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)).alias("minor")))


def deprecation(message: Column) -> Column:
    """struct(old, new) of '<old> is deprecated. You should use <new> instead.', without case, old being a dotted name; null if the message is no such one."""
    m = collapsed(message)
    part = lambda i: F.regexp_extract(m, r"(?i)^([A-Z_][\w.]*) is deprecated ?\.? ?(?:You should use (.+?) instead ?\.?)?$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("old"), F.nullif(part(2), F.lit("")).alias("new")))


def name_tokens(text: Column) -> Column:
    """Lower-cased identifiers of a replacement text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1), F.lower))


def leaf(name: Column) -> Column:
    """Last component of a dotted name."""
    return F.regexp_extract(name, r"([^.]*)$", 1)


def quoted(text: Column) -> Column:
    r"""Java pattern that matches the text itself; a \E in it ends no quotation."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def symbol_pattern(name: Column, member: Column) -> Column:
    r"""Java pattern of a symbol: a member as `\.X\b`, a global as `(?<![\w.])X\b`, Unicode-aware and without case."""
    whole = F.concat(quoted(name), F.lit(r"\b"))
    return F.when(member, F.concat(F.lit(r"(?iU)\."), whole)).otherwise(F.concat(F.lit(r"(?iU)(?<![\w.])"), whole))


def decremented(expr: Column) -> Column:
    """An index expression less one: literals folded, a final +1 dropped, names minus 1, anything else in brackets."""
    e = F.trim(expr)
    return (
        F.when(e.rlike(r"^\d+$"), (e.try_cast("long") - 1).cast("string"))
        .when(e.rlike(r"(?s)^.+\+\s*1$"), F.trim(F.regexp_replace(e, r"\s*\+\s*1$", "")))
        .when(e.rlike(r"^[A-Za-z_]\w*$"), F.concat(e, F.lit(" - 1")))
        .otherwise(F.concat(F.lit("("), e, F.lit(") - 1")))
    )


def terminal_safe(text: Column) -> Column:
    """Text without the control sequences and two-character escapes of ECMA-48; CRLF as LF.

    A lone carriage return, other control characters and the bidirectional embeddings and overrides become U+FFFD.
    Isolates and direction marks stay: right-to-left text needs them.
    """
    x = F.regexp_replace(text, r"\x1B\[[0-9;?]*[ -/]*[@-~]|\x1B[@-Z\\-_]", "")
    x = F.replace(x, F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(x, r"[\x00-\x08\x0B-\x1F\x7F-\x9F\u202A-\u202E]", "\ufffd")


def tier(conf: Column) -> Column:
    return F.when(conf == "manual-only", "manual").otherwise(conf)


def hex_id(text: Column) -> Column:
    """'&h1F' as decimal(20,0): ids may exceed a signed long."""
    return F.when(text.rlike(r"^&h[0-9A-Fa-f]{1,16}$"), F.conv(F.substring(text, 3, 16), 16, 10).cast("decimal(20,0)"))
