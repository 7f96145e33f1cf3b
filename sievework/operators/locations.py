"""From a diagnostic's location to a line of source: an index of what a file declares, and ranked keys into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_]\w*"
#: Lines from the start of a file on which a layout block names the container.
HEAD_LINES = 3


def _named(column: str, pattern: str) -> Column:
    """The name that the line gives by the pattern, or null."""
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def _states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows of what lines say with the container _c and owner _o of each, the name _m of a method outside the blocks of computed properties, and on the Get and Set lines of these their accessor and property.

    The name stands behind both bodies, so each block is numbered by its opening tag, its end is the first closing tag
    behind that, and the name is the first declaration inside it and outside the bodies, filled back over the block. The first
    Get line of a getter and the first Set line of a setter count. An opening tag in an open block opens none; a block that is
    not closed reaches to the file's end.
    """
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Opening and closing tags alternate once those inside an open block are passed over.
    mark = F.when(F.col("_tag") == "computedproperty", 1).when(F.col("_tag") == "endcomputedproperty", 0)
    rows = rows.withColumn("_mark", mark).withColumn("_was", F.coalesce(F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opened = F.coalesce((F.col("_mark") == 1) & (F.col("_was") == 0), F.lit(False))
    inside = F.coalesce(F.col("_mark"), F.col("_was")) == 1
    rows = rows.withColumns({"_opened": opened, "in_block": inside | (F.coalesce(F.col("_mark") == 0, F.lit(False)) & (F.col("_was") == 1))})
    # What the last tag about bodies says holds until the next one, or until a block opens.
    body = F.when(F.col("_opened") | F.col("_tag").isin("endgetter", "endsetter"), "").when(F.col("_tag") == "getter", "get").when(F.col("_tag") == "setter", "set")
    # Owner and container, like names, count outside the blocks alone; here they share the windows' order.
    free = ~F.col("in_block")
    owner = F.last(F.when(free, F.coalesce("_events", F.when(F.col("_tag") == "endevents", ""))), ignorenulls=True).over(w)
    container = F.coalesce(F.last(F.when(free, F.coalesce("_layout", "_class")), ignorenulls=True).over(w), F.col("_stem"))
    rows = rows.withColumns({"_block": F.count_if("_opened").over(w), "_body": F.coalesce(F.last(body, ignorenulls=True).over(w), F.lit("")), "_o": F.nullif(owner, F.lit("")), "_c": container, "_m": F.when(free, F.col("_m"))})
    declared = F.when(F.col("in_block") & (F.col("_body") == ""), F.col("_declares"))
    starts = F.when(F.col("in_block") & (F.col("_body") != "") & (F.col("_word") == F.col("_body")), F.col("_body"))
    rows = rows.withColumns({"_d": declared, "_starts": starts})
    whole = Window.partitionBy(*keys, "_block", "in_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda word: F.min(F.when(F.col("_starts") == word, F.col("line_no"))).over(whole)
    rows = rows.withColumns({"_name": F.first("_d", ignorenulls=True).over(whole), "_get": first("get"), "_set": first("set")})
    at = F.when(F.col("_starts") == "get", F.col("_get")).when(F.col("_starts") == "set", F.col("_set"))
    return rows.withColumn("accessor", F.when(F.col("line_no") == at, F.col("_starts"))).withColumn("property", F.when(F.col("accessor").isNotNull(), F.col("_name")))


def location_index(lines: DataFrame, keys: list[str], stem: str) -> DataFrame:
    """(keys, line_no, container, member), lower-cased, of lines(keys, stem, line_no, line, code).

    The container is the class, module or interface last declared in code, or what the layout block on the file's first lines
    names, or the file's stem. A method's signature is indexed under it; between event tags also under the control that
    owns them, as a member of that and as owner.member of the container. A computed property is indexed under name.Get and
    name.Set, and under its name alone once for each of the two. Nothing else inside its block counts.
    """
    # What each line says is read once and goes on without its text.
    tagged = lambda c: F.when(F.contains("line", F.lit("#")), c)
    said = {
        "_tag": tagged(F.lower(F.regexp_extract("line", r"(?i)^\s*#tag\s+(\w+)\b", 1))),
        "_declares": _named("line", rf"(?i)^\s*({_NAME})\s+As\s"),
        "_word": F.lower(F.regexp_extract("line", r"(?i)^\s*(get|set)\s*$", 1)),
        "_events": tagged(_named("line", r"(?i)^\s*#tag\s+events\s+(\S+)")),
        "_class": _named("code", rf"(?i)^\s*(?:(?:protected|private)\s+)?(?:class|module|interface)\s+({_NAME})"),
        "_layout": F.when(F.col("line_no") <= HEAD_LINES, _named("line", rf"^\s*Begin\s+[A-Za-z_][\w.]*\s+({_NAME})")),
        "_m": _named("code", rf"(?i)^\s*(?:(?:private|protected|public|shared)\s+)*(?:sub|function)\s+({_NAME})"),
    }
    rows = lines.select(*keys, "line_no", F.col(stem).alias("_stem"), *[c.alias(n) for n, c in said.items()])
    rows = _states(rows, keys)
    entry = lambda c, m: F.struct(F.lower(c).alias("container"), F.lower(m).alias("member"))
    dot = F.lit(".")
    signature = F.when(F.col("_m").isNotNull(), F.concat(F.array(entry(F.col("_c"), F.col("_m"))), F.when(F.col("_o").isNotNull(), F.array(entry(F.col("_c"), F.concat("_o", dot, "_m")), entry(F.col("_o"), F.col("_m")))).otherwise(F.array())))
    accessor = F.when(F.col("property").isNotNull(), F.array(entry(F.col("_c"), F.concat("property", dot, "accessor")), entry(F.col("_c"), F.col("property"))))
    return rows.select(*keys, "line_no", F.inline(F.coalesce(signature, accessor)))


def location_keys(location: Column) -> Column:
    """The keys (container, member) of a dotted location, lower-cased, the most specific first and each once.

    For every split, from the right: what stands left and right of it; the first part and what stands right; what stands
    left and the last part. A location without a dot has none.
    """
    joined = lambda parts, start, count: F.array_join(F.slice(parts, start, count), ".")
    key = lambda c, m: F.struct(c.alias("container"), m.alias("member"))

    def keys(parts: Column) -> Column:
        n = F.size(parts)

        def shapes(i: Column) -> Column:
            left, right = joined(parts, F.lit(1), i), joined(parts, i + 1, n - i)
            return F.array(key(left, right), key(F.get(parts, F.lit(0)), right), key(left, F.get(parts, n - 1)))

        splits = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1)))
        return F.array_distinct(F.coalesce(F.flatten(F.transform(splits, shapes)), F.array().cast("array<struct<container:string,member:string>>")))

    # Over an array of one, so that the parts are found once and not for each split and shape.
    parts = F.filter(F.split(F.lower(location), r"\."), lambda p: p != "")
    return F.get(F.transform(F.array(parts), keys), F.lit(0))


def located(diagnostics: DataFrame, diag_id: str, location: str, line: str, index: DataFrame, place: list[str]) -> DataFrame:
    """(diag_id, resolution, the columns of place, file_line, candidates) of diagnostics with a location.

    The first key with one entry in the index is where the diagnostic stands (`located`); if no key has just one, the first
    with several gives the candidates (`ambiguous`); else it is `unresolved`. A line counts from the entry's line; without
    one the entry's line stands. The index is grouped by key first; candidates are as many as entries share a key.
    """
    at = F.struct(*place, F.col("line_no").alias("file_line"))
    by_key = index.groupBy("container", "member").agg(F.sort_array(F.collect_list(at)).alias("_at"))
    asked = diagnostics.filter(F.coalesce(F.col(location), F.lit("")) != "").select(diag_id, F.coalesce(F.col(line), F.lit(0)).alias("_line"), F.posexplode_outer(location_keys(F.col(location))).alias("_rank", "_key"))
    met = asked.select(diag_id, "_line", "_rank", "_key.*").join(by_key, ["container", "member"], "left")
    n = F.size("_at")
    best = met.groupBy(diag_id, "_line").agg(F.min_by("_at", F.when(n == 1, F.col("_rank"))).alias("_one"), F.min_by("_at", F.when(n > 1, F.col("_rank"))).alias("_many"))
    moved = lambda x: F.struct(*[x[c].alias(c) for c in place], (x["file_line"] + F.col("_line")).alias("file_line"))
    state = F.when(F.col("_one").isNotNull(), "located").when(F.col("_many").isNotNull(), "ambiguous").otherwise("unresolved")
    one = F.get("_one", F.lit(0))
    return best.select(diag_id, state.alias("resolution"), *[one[c].alias(c) for c in place], (one["file_line"] + F.col("_line")).alias("file_line"), F.when(F.col("_one").isNull(), F.transform("_many", moved)).alias("candidates"))
