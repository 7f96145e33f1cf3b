"""Pages of marked-up text: section trees, members under their anchors, and comma-separated tables.

A page's lines are rows (keys, line_no, line) numbered without gaps, or one row (keys, lines) with all of them, as page_arrays()
makes it; section trees and members take both and collect the rows. Everything is windows and array functions within a page,
so a page is the unit that one task holds; no page is seen by the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The characters of heading rules and the level of each; the others are of the lowest level.
RULE_CHARACTERS = "-=~^\"#*+`'_:."
LEVELS = {"=": 1, "-": 2, "~": 3, "^": 4, '"': 5}
LOWEST = 6
# Sections that describe members, and the kind of these.
DESCRIPTIONS = {
    "property descriptions": "property",
    "shared property descriptions": "property",
    "method descriptions": "method",
    "shared method descriptions": "method",
    "event descriptions": "event",
    "constant descriptions": "constant",
    "enumeration descriptions": "enumeration",
}

_RULE = r"^([\Q" + RULE_CHARACTERS + r"\E])\1\1+\s*$"
_COMMENT = r"^\s*\.\.(?:\s|$)"
_ANCHOR = r"^\s*\.\.\s+_([^:]+):\s*$"
_OPTION = r"^\s*:([A-Za-z][\w-]*):\s*(.*)$"
# One class first, so that most characters are passed by one look; a line feed behind a carriage return is part of its break.
_BREAK = r"[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029](?:(?<=\r)\n)?"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: what a lambda inside `use` refers to would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def page_arrays(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, lines: the lines of each text with tabs as spaces, four columns a stop, and nothing after the last character."""

    def spaced(x: Column) -> Column:
        parts = F.split(x, "\t", -1)
        return F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), lambda done, y: F.concat(done, F.repeat(F.lit(" "), 4 - F.length(done) % 4), y))

    # Breaks are all white space but blanks and tabs, so no other ends a line.
    ended = _let(F.split(text, _BREAK, -1), lambda xs: F.slice(xs, 1, F.size(xs) - F.when(F.get(xs, F.size(xs) - 1) == "", 1).otherwise(0)))
    clean = F.transform(ended, lambda x: F.rtrim(F.when(F.contains(x, F.lit("\t")), spaced(x)).otherwise(x)))
    return df.filter(F.length(text) > 0).select(*keys, clean.alias("lines"))


def page_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no, line: the lines of page_arrays()."""
    return page_arrays(df, keys, text).select(*keys, F.posexplode("lines").alias("_at", "line")).select(*keys, (F.col("_at") + 1).alias("line_no"), "line")


def _window(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("line_no")


def section_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines with title and level on the line of a title, and role: title, rule (the lines of punctuation about a title) or text.

    A title stands above a rule of any length of at least three. A rule of the same character above it belongs to it, unless
    it ends the title before. A comment is a title only between two such rules. Of comments that share rules
    every other one is a title: a rule serves one title.
    """
    w = _window(keys)
    before, after = F.lag("line").over(w), F.lead("line").over(w)
    first = lambda c: F.substring(F.trim(c), 1, 1)
    could = (F.trim("line") != "") & ~F.col("line").rlike(_RULE) & F.coalesce(after.rlike(_RULE), F.lit(False))
    ruled = F.coalesce(before.rlike(_RULE) & (first(before) == first(after)), F.lit(False))
    comment = F.col("line").rlike(_COMMENT)
    rows = lines.withColumns({"_plain": could & ~comment, "_noted": could & comment & ruled, "_ruled": ruled, "_mark": first(after)})

    # What ends two lines above decides whether the rule between is free; runs of comments at every other line alternate.
    every_other = Window.partitionBy(*keys, F.col("line_no") % 2).orderBy("line_no")
    start = F.last(F.when(~F.col("_noted"), F.struct("line_no", "_plain")), ignorenulls=True).over(every_other)
    odd = ((F.col("line_no") - F.coalesce(start["line_no"], -(F.col("line_no") % 2))) / 2).cast("long") % 2 == 1
    rows = rows.withColumn("_title", F.col("_plain") | (F.col("_noted") & (odd != F.coalesce(start["_plain"], F.lit(False)))))

    taken = F.coalesce(F.lag("_title", 2).over(w), F.lit(False))
    rows = rows.withColumn("_over", F.col("_title") & F.col("_ruled") & ~taken)
    rule = F.coalesce(F.lag("_title").over(w), F.lit(False)) | F.coalesce(F.lead("_over").over(w), F.lit(False))
    level = F.coalesce(*[F.when(F.col("_mark") == c, F.lit(n)) for c, n in LEVELS.items()], F.lit(LOWEST))
    rows = rows.withColumns({"title": F.when(F.col("_title"), F.trim("line")), "level": F.when(F.col("_title"), level), "role": F.when(F.col("_title"), "title").when(rule, "rule").otherwise("text")})
    return rows.select(*lines.columns, "title", "level", "role")


def _paged(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lines, first: a page's lines in one array, and the number of the first."""
    if "lines" in lines.columns:
        return lines.select(*keys, "lines", F.lit(1).alias("first"))
    rows = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_rows"))
    return rows.select(*keys, F.transform("_rows", lambda x: x["line"]).alias("lines"), F.get("_rows", F.lit(0))["line_no"].alias("first"))


def section_roles(lines: Column) -> Column:
    """A character for each of a page's lines: the level of a title, o or u for the rule over or under one, t for others.

    Titles are those of section_lines(). A first string has the rules' characters, c for comments, t for other text; one pass over it from
    the left finds the titles with their rules, as each rule serves one.
    """
    rules = "[" + "".join("\\" + c for c in RULE_CHARACTERS) + "]"
    kind = lambda x: F.when(F.trim(x) == "", " ").when(~x.rlike(rf"^\s*+{rules}"), "t").when(x.rlike(_RULE), F.substring(x, 1, 1)).when(x.rlike(_COMMENT), "c").otherwise("t")
    heads = F.regexp_replace(F.array_join(F.transform(lines, kind), ""), rf"({rules})([tc])(\1)|(t)({rules})", "\n$1$2$3$4$5")
    # The rule's character moves to the title's place; what is left of rules is text.
    marked = F.regexp_replace(F.regexp_replace(heads, rf"\n({rules})[tc]{rules}", "o$1u"), rf"\n[tc]({rules})", "$1u")
    return F.translate(F.regexp_replace(marked, rf"{rules}(?!u)| |c", "t"), RULE_CHARACTERS, "".join(str(LEVELS.get(c, LOWEST)) for c in RULE_CHARACTERS))


def section_tree(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each section: keys, section_no, path, title, level, first_line, last_line, own_lines.

    A section is inside the nearest one before it of a smaller level; path names those around it and itself. first_line
    is its title's, last_line that before the next section that is not inside it. own_lines counts its text before the next title.
    Lines before the first title are section 0, of level 0 with an empty path.
    """
    rows = _paged(lines, keys).withColumns({"_roles": section_roles(F.col("lines")), "_end": (F.col("first") + F.size("lines") - 1).cast("int")})
    each = lambda c: F.split(c, "")
    zipped = F.arrays_zip(F.col("lines").alias("line"), each("_roles").alias("role"), each(F.concat(F.lit("."), "_roles")).alias("before"))
    rows = rows.select(*keys, "first", "_end", F.posexplode(zipped).alias("_at", "_x"))
    level = F.coalesce(F.col("_x.role").try_cast("int"), F.lit(0))
    heads = rows.filter("_x.role between '1' and '9' or _at = 0").select(*keys, "_end", (F.col("first") + F.col("_at")).alias("line_no"), level.alias("level"), F.when(level > 0, F.trim("_x.line")).alias("title"), F.col("_x.before").alias("_before"))
    # A rule above a title is outside the section before, also if it is the one under that section's title.
    heads = heads.withColumn("_start", F.col("line_no") - F.when((F.col("level") > 0) & F.col("_before").isin("o", "u"), 1).otherwise(0))

    w, levels = _window(keys), range(1, LOWEST + 1)
    back = Window.partitionBy(*keys).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumns({f"_f{k}": F.last(F.when(F.col("level").between(1, k), F.col("_start")), ignorenulls=True).over(back) for k in levels})
    # The last title of at most a level is around the row if it has that level: no title of a smaller one came after it.
    on = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = {f"_l{k}": F.last(F.when(F.col("level").between(1, k), F.struct("level", "title")), ignorenulls=True).over(on) for k in levels[:-1]}
    heads = heads.withColumns(latest | {"section_no": F.count("title").over(on)})
    around = [F.when((F.col("level") > k) & (F.col(f"_l{k}.level") == k), F.col(f"_l{k}.title")) for k in levels[:-1]]
    nxt = F.coalesce(*[F.when(F.col("level") == k, F.col(f"_f{k}")) for k in levels], F.when(F.col("level") == 0, F.col(f"_f{LOWEST}")))
    own = F.greatest(F.coalesce(F.col(f"_f{LOWEST}"), F.col("_end") + 1) - F.col("line_no") - F.when(F.col("level") > 0, 2).otherwise(0), F.lit(0))
    return heads.select(
        *keys, "section_no", F.array_compact(F.array(*around, F.col("title"))).alias("path"), "title", "level", F.col("line_no").alias("first_line"),
        F.coalesce(nxt - 1, "_end").cast("int").alias("last_line"), own.cast("long").alias("own_lines"),
    )


def page_heads(lines: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, title, kind: the first section's title, else what follows the last slash of `name`; the last line of the preamble that is no comment, substitution, rule or option."""
    rows = section_lines(lines, keys).withColumn("section_no", F.count("title").over(_window(keys)))
    said = (F.col("section_no") == 0) & (F.col("role") == "text") & (F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("|")) & ~F.col("line").rlike(f"{_COMMENT}|{_RULE}|{_OPTION}")
    heads = rows.groupBy(*keys).agg(F.min(F.when(F.col("title").isNotNull(), F.struct("line_no", "title"))).alias("_t"), F.max(F.when(said, F.struct("line_no", F.trim("line").alias("kind")))).alias("_k"))
    return heads.select(*keys, F.coalesce("_t.title", F.regexp_extract(name, r"([^/]*)$", 1)).alias("title"), F.coalesce("_k.kind", F.lit("")).alias("kind"))


def dedented(lines: Column) -> Column:
    """Lines without the indent that all of them have; blank ones are empty."""
    indent = lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(" \t\n\x0b\f\r")))
    least = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), indent))
    return _let(F.coalesce(least, F.lit(0)), lambda n: F.transform(lines, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substring(x, n + 1, F.length(x)))))


def _until_next(starts: str, items: str) -> Column:
    """The entries of an array of structs with a place `at` among the items, each with the next one's place, or that behind the last item: entry, next."""
    following = F.concat(F.transform(F.slice(starts, 2, F.size(starts)), lambda x: x["at"]), F.array(F.size(items) + 1))
    return F.filter(F.arrays_zip(F.col(starts).alias("entry"), following.alias("next")), lambda x: x["entry"].isNotNull())


def members(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, anchor, qualified, name, signature, kind, body, deprecated: what the sections of descriptions list under their anchors.

    A member reaches from its anchor to the next anchor or title. The first line in bold is its signature; the last plain line
    before that is its qualified name. Without a signature an anchor is no member. A page's lines are cut into those of its
    sections, and these into those of their members; places count from 1.
    """
    rows = _paged(lines, keys).withColumn("_roles", F.split(section_roles(F.col("lines")), ""))
    # A section begins at the rule over its title or at the title; its own lines come behind the rule under that.
    head = lambda i, title: F.struct((i + 1).alias("at"), title.alias("title"))
    bare = lambda r, i: r.between("1", "9") & (F.coalesce(F.get("_roles", i - 1), F.lit("")) != "o")
    heads = F.transform("_roles", lambda r, i: F.when(r == "o", head(i, i + 2)).when(bare(r, i), head(i, i + 1)))
    rows = rows.withColumn("_heads", F.filter(heads, lambda x: x.isNotNull()))
    kind = lambda x: _let(F.lower(F.trim(F.get("lines", x["entry"]["title"] - 1))), lambda t: F.coalesce(*[F.when(t == d, F.lit(k)) for d, k in DESCRIPTIONS.items()]))
    own = lambda x: F.slice("lines", x["entry"]["title"] + 2, F.greatest(x["next"] - x["entry"]["title"] - 2, F.lit(0)))
    described = F.filter(_until_next("_heads", "lines"), lambda x: kind(x).isNotNull())
    rows = rows.select(*keys, "first", F.inline(F.transform(described, lambda x: F.struct(kind(x).alias("kind"), (x["entry"]["title"] + 2).alias("_at"), own(x).alias("_own")))))

    anchors = F.transform("_own", lambda x, i: F.when(x.rlike(_ANCHOR), F.struct((i + 1).alias("at"), F.trim(F.regexp_extract(x, _ANCHOR, 1)).alias("anchor"))))
    rows = rows.withColumn("_anchors", F.filter(anchors, lambda x: x["anchor"] != ""))
    block = lambda x: F.struct(x["entry"]["at"].alias("_in"), x["entry"]["anchor"].alias("anchor"), F.slice("_own", x["entry"]["at"], x["next"] - x["entry"]["at"]).alias("_block"))
    bold = lambda x: x.withField("_sig", F.array_position(F.transform(x["_block"], lambda y: F.startswith(F.ltrim(y), F.lit("**"))), True).cast("int"))
    rows = rows.select(*keys, "kind", "first", "_at", F.inline(F.transform(F.transform(_until_next("_anchors", "_own"), block), bold))).filter("_sig > 0")

    plain = F.filter(F.slice("_block", 1, F.col("_sig") - 1), lambda x: (F.trim(x) != "") & ~x.rlike(f"{_COMMENT}|{_RULE}"))
    rows = rows.withColumns({"_s": F.trim(F.get("_block", F.col("_sig") - 1)), "_plain": plain, "_body": F.slice("_block", F.col("_sig") + 1, F.size("_block"))})
    part = lambda i: F.regexp_extract("_s", r"^\*\*(.+?)\*\*(.*)$", i)
    rows = rows.filter(part(1) != "").withColumns({"name": F.trim(part(1)), "signature": F.trim(F.regexp_replace(part(2), r"^\\+", "")), "body": dedented(F.col("_body"))})
    told = F.array_join("body", "\n").rlike(r"(?i)\b(?:was|is|has been) deprecated")
    qualified = F.trim(F.get("_plain", F.size("_plain") - 1))
    return rows.select(*keys, (F.col("first") + F.col("_at") + F.col("_in") - 2).alias("line_no"), "anchor", F.coalesce(qualified, "name").alias("qualified"), "name", "signature", "kind", "body", told.alias("deprecated"))


def _records(data: Column) -> Column:
    """The records of comma-separated text as arrays of cells; a cell in quotes may hold commas, line breaks and doubled quotes.

    Each cell is matched once with the separator after it, so the work grows with the text. A quote inside a plain cell, or
    one that never closes, is a character like others.
    """
    quoted, plain = r'"[^"]*+(?:""[^"]*+)*+"[^",\n]*+', r"[^,\n]*+"
    cells = F.regexp_extract_all(F.concat(data, F.lit("\n")), F.lit(rf" *+(?:{quoted}|{plain})[,\n]"), 0)
    ends = F.filter(F.transform(cells, lambda c, i: F.when(F.endswith(c, F.lit("\n")), i + 1)), lambda i: i.isNotNull())
    cut = lambda c: F.regexp_replace(c, r"(?s)^ *+(.*)[,\n]$", "$1")
    bare = lambda c: F.when(F.startswith(c, F.lit('"')) & (F.length(F.regexp_replace(c, '[^"]', "")) % 2 == 0), F.replace(F.regexp_replace(c, r'(?s)^"(.*)"([^"]*)$', "$1$2"), F.lit('""'), F.lit('"'))).otherwise(c)
    record = lambda end, i: F.slice(cells, F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, end - F.coalesce(F.get(ends, i - 1), F.lit(0)))
    return F.transform(F.transform(ends, record), lambda r: F.transform(r, lambda c: bare(cut(c))))


def table_rows(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, row_no, header, cells: the rows of a table's body: options (`:name: value`), a blank line, comma-separated text.

    The header is the option header, or the first of the header-rows. Rows of blank cells go; rows are numbered from 1 without
    the header's. A header without rows is no row.
    """
    options = r"^((?:[ \t]*:[A-Za-z][\w-]*:[^\n]*(?:\n|\z))*)"
    x = df.select(*keys, F.regexp_replace(body, r"\r\n?", "\n").alias("_body"))
    x = x.select(*keys, F.regexp_extract("_body", options, 1).alias("_o"), F.regexp_replace("_body", options, "").alias("_d"))
    option = lambda name: F.trim(F.regexp_extract("_o", rf"(?im)^[ \t]*:{name}:[ \t]*(.*)$", 1))
    data = F.regexp_replace("_d", r"^\s+|\s+$", "")
    full = F.filter(_records(data), lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    x = x.select(*keys, full.alias("_rows"), option("header").alias("_h"), F.coalesce(F.regexp_extract(option("header-rows"), r"^\d+$", 0).try_cast("int"), F.lit(0)).alias("_n"))
    trimmed = lambda cells: F.transform(cells, lambda c: F.trim(c))
    header = F.when(F.col("_h") != "", trimmed(F.get(_records(F.col("_h")), F.lit(0)))).when(F.col("_n") > 0, trimmed(F.get("_rows", F.lit(0))))
    rest = F.when((F.col("_h") == "") & (F.col("_n") > 0), F.slice("_rows", F.col("_n") + 1, F.size("_rows"))).otherwise(F.col("_rows"))
    return x.select(*keys, header.alias("header"), F.posexplode(rest).alias("_at", "cells")).select(*keys, (F.col("_at") + 1).alias("row_no"), "header", "cells")
