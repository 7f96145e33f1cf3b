"""Problems of tagged source files: regions of tags, blocks of the designer inside some of them, and project manifests.

Lines are classified by column functions; what is no tag and no block goes. The few that are left of a file are
folded in order over two coupled stacks in an Arrow helper. A file is the unit that one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.symbols import hex_id
from sievework.sources.tables import line_rows

# Kinds of tags; those that nothing closes; those in which Begin opens a block; the outermost tags of a file by what stands
# behind the underscore of its extension, as .x_window.
KNOWN = set(
    "BuildAutomation Class Color ColorGroup CompatibilityFlags ComputedProperty Constant DatabaseConnection DelegateDeclaration DesktopToolbar DesktopWindow Enum EnumValues "
    "Event Events ExternalMethod FileType FileTypeSet Getter Hook IOSContainerControl IOSLaunchScreen IOSLayout IOSScreen IOSView ImageRepresentation ImageSpecification Instance "
    "Interface Menu MenuHandler Method MobileContainer MobileScreen Module MultiImage Note Property Report ReportCode ScreenCode Session Setter Structure Toolbar Using ViewBehavior "
    "ViewProperty WebContainerControl WebPage WebStyle WebStyleStateGroup Window WindowCode Worker iOSLaunchScreen iOSLayout".split()
)
STANDALONE = {"CompatibilityFlags", "Instance"}
DESIGNER = set(
    "BuildAutomation DatabaseConnection DesktopToolbar DesktopWindow IOSContainerControl IOSLaunchScreen IOSLayout IOSScreen IOSView Menu MobileContainer MobileScreen MultiImage "
    "Report Toolbar WebContainerControl WebPage Window iOSLaunchScreen iOSLayout".split()
)
OUTER = {
    "code": "BuildAutomation Class Interface IOSContainerControl IOSLaunchScreen IOSLayout IOSScreen IOSView MobileContainer MobileScreen Module WebContainerControl WebPage WebStyle iOSLaunchScreen iOSLayout",
    "color": "ColorGroup",
    "database_connection": "DatabaseConnection",
    "filetypeset": "FileTypeSet",
    "image": "MultiImage",
    "menu": "Menu",
    "report": "Report",
    "toolbar": "DesktopToolbar Toolbar",
    "window": "DesktopWindow Window",
}
NEWEST_VERSION = "2026.021"
PROJECT_TYPES = ["Console", "Desktop", "Mobile", "Web", "Web2", "iOS"]

PROBLEM = "line_no int, column int, code string, severity string, detail string"
_FIELDS = [f.split()[0] for f in PROBLEM.split(", ")]


def structure(line: Column) -> Column:
    """struct(what, name, column) of a line: open, close or bad (a tag without a kind), begin, image, end or end-of; null for any other line."""
    body = F.regexp_extract(line, r"(?i)^[ \t]*#tag\s+(.*?)[ \t\r]*$", 1)
    column = F.length(F.regexp_extract(line, r"^[ \t]*", 0)) + 1
    closed = F.regexp_extract(body, r"^End([A-Za-z][A-Za-z0-9]*)$", 1)
    opened = F.regexp_extract(body, r"^([A-Za-z][A-Za-z0-9]*)(?:$|\s|\s*[,=])", 1)
    spaced, joined = F.regexp_extract(line, r"^[ \t]*Begin[ \t]+(\S+)(?:[ \t].*)?$", 1), F.regexp_extract(line, r"^[ \t]*Begin([A-Z][A-Za-z0-9_.]*)[ \t]+.+$", 1)
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    of = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"), column.alias("column"))
    tag = F.when(closed != "", of("close", closed)).when(opened != "", of("open", opened)).otherwise(of("bad", F.lit("")))
    return (
        F.when(line.rlike(r"(?i)^[ \t]*#tag\s"), tag)
        .when(spaced != "", of("begin", spaced))
        .when(joined != "", of("begin", joined))
        .when(line.rlike(r"^[ \t]*Image(?:\s.*)?$"), of("image", F.lit("Image")))
        .when(bare == "End", of("end", F.lit("")))
        .when(bare.isin("End Image", "End ScreenContent"), of("end-of", F.substring(bare, 5, 99)))
    )


def fold(lines: list[tuple[int, str, str, int]], kind: str, warn_unknown: bool) -> list[tuple]:
    """Problems of (line_no, what, name, column) in order.

    `regions` holds the open tags; a closing tag that is not the innermost's closes all up to its own, or the innermost alone. Blocks
    count only inside designer tags, and for those each closing tag ends the innermost whatever it names: `inside` holds them.
    """
    found: list[tuple] = []
    regions: list[tuple[str, int]] = []
    inside: list[str] = []
    blocks: list[tuple[str, int]] = []
    outer = None
    ended = {name.casefold() for _, what, name, _ in lines if what == "close"}

    def tell(line: int, column: int | None, code: str, detail: str = "", severity: str = "error") -> None:
        found.append((line, column, code, severity, detail))

    def close(line: int, name: str, column: int) -> None:
        inside[-1:] = []
        if not regions:
            return tell(line, column, "XJT001", name)
        at = next((i for i in reversed(range(len(regions))) if regions[i][0].casefold() == name.casefold()), len(regions) - 1)
        if regions[-1][0].casefold() != name.casefold():
            tell(line, column, "XJT002", f"{name} for {regions[-1][0]}")
        del regions[at:]

    for line, what, name, column in lines:
        if what == "close":
            close(line, name, column)
        elif what == "bad":
            tell(line, column, "XJT003")
        elif what == "open":
            if outer is None and not regions:
                outer = (line, name)
            if warn_unknown and name not in KNOWN:
                tell(line, column, "XJT101", name, "warning")
            if name not in STANDALONE and (name in KNOWN or name.casefold() in ended):
                regions.append((name, line))
                inside.append(name)
        elif what == "begin":
            if not DESIGNER.isdisjoint(inside):
                blocks.append((name, line))
        elif what == "image":
            if "MultiImage" in inside:
                blocks.append((name, line))
        elif what == "end":
            blocks[-1:] = []
        elif not blocks:
            tell(line, None, "XJB002", name)
        else:
            if blocks[-1][0] != name:
                tell(line, None, "XJB003", f"{name} for {blocks[-1][0]}")
            blocks.pop()
    for name, line in regions:
        tell(line, None, "XJT004", name)
    for name, line in blocks:
        tell(line, None, "XJB004", name)
    usual = OUTER.get(kind)
    if outer is None:
        tell(0, None, "XJT005")
    elif usual and outer[1] not in usual.split():
        tell(outer[0], None, "XJT102", outer[1], "warning")
    return found


def designer_problems(files: DataFrame, key: str, path: str, text: str, warn_unknown: bool = True) -> DataFrame:
    """(key, line_no, column, code, severity, detail) of files(key, path, text); an empty or null text has no problems."""
    full = files.filter(F.length(text) > 0)
    extension = F.lower(F.regexp_extract(path, r"\.[^./_]+_([^./]+)$", 1))
    lines = line_rows(full.select(key, F.col(text).alias("_text")), "_text").select(key, "line_no", structure(F.col("line")).alias("_s")).filter("_s is not null")
    events = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "_s.what", "_s.name", "_s.column"))).alias("_events"))
    jobs = full.select(key, extension.alias("_ext")).join(events, key, "left").select(key, "_ext", "_events")
    kind = jobs.schema[key]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for i, (ext, events) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                rows += [(i, *p) for p in fold([(e["line_no"], e["what"], e["name"], e["column"]) for e in events or []], ext, warn_unknown)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], [key, *_FIELDS])

    return jobs.mapInArrow(run, f"`{key}` {kind.dataType.simpleString()}, {PROBLEM}")


def manifest_problems(lines: DataFrame, project: str, line_no: str, line: str) -> DataFrame:
    """(project, line_no, code, severity, detail) of the lines of project manifests, by filters, one aggregation and two joins.

    XJP001 no equals sign, XJP002 no key before it, XJP003 an id used before (detail: the first line), XJP004 a malformed item, XJP005 a
    missing header (line 0), XJP006 no version, XJP007 an unknown parent; warnings: XJP101 blank, XJP102 a newer version,
    XJP104 an unknown type. Of a header that stands twice the first counts. Projects without any line are not seen.
    """
    x = F.col(line)
    key, value = F.regexp_extract(x, r"(?s)^([^=]*)=", 1), F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)
    rows = lines.select(project, F.col(line_no).alias("line_no"), x.alias("_line"), key.alias("_key"), value.alias("_value"))
    keyed = rows.filter(F.contains("_line", F.lit("=")) & F.col("_key").rlike(r"^[A-Za-z][A-Za-z0-9_]*$"))
    part = lambda i: F.regexp_extract("_value", r"(?i)^[^;\n]*;[^;\n]*;(&h[0-9a-f]+);(&h[0-9a-f]+);(?:true|false)(?:;[^;\n]*)*$", i)
    items = keyed.filter(part(1) != "").select(project, "line_no", hex_id(part(1)).alias("_id"), hex_id(part(2)).alias("_parent"), part(2).alias("_said"))
    of = lambda code, severity, detail: [F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail")]
    none = F.lit(None).cast("string")
    shape = (
        F.when(F.col("_line") == "", F.struct(*of("XJP101", "warning", none)))
        .when(~F.contains("_line", F.lit("=")), F.struct(*of("XJP001", "error", none)))
        .when(~F.col("_key").rlike(r"^[A-Za-z][A-Za-z0-9_]*$"), F.struct(*of("XJP002", "error", F.col("_key"))))
        .when((part(1) == "") & F.contains("_value", F.lit(";&h")) & (F.length(F.regexp_replace("_value", "[^;]", "")) >= 3), F.struct(*of("XJP004", "error", none)))
    )
    found = rows.select(project, "line_no", shape.alias("_p")).filter("_p is not null").select(project, "line_no", "_p.*")

    first = items.groupBy(project, "_id").agg(F.min("line_no").alias("_first"))
    again = items.join(first, [project, "_id"]).filter("line_no > _first").select(project, "line_no", *of("XJP003", "error", F.col("_first").cast("string")))
    orphans = items.filter("_parent != 0").join(first.select(project, F.col("_id").alias("_parent")), [project, "_parent"], "left_anti").select(project, "line_no", *of("XJP007", "error", F.col("_said")))

    own = F.col("_key").isNotNull() & F.contains("_line", F.lit("="))
    header = lambda name: F.min(F.when(own & (F.col("_key") == name), F.struct("line_no", "_value")))
    heads = rows.groupBy(project).agg(header("Type").alias("_type"), header("RBProjectVersion").alias("_version"))
    version = F.col("_version._value").try_cast("decimal(38,18)")
    at = lambda c, cond, code, severity, detail: F.when(cond, F.struct(F.coalesce(F.col(f"{c}.line_no"), F.lit(0)).alias("line_no"), *of(code, severity, detail)))
    checks = F.array(
        at("_type", F.col("_type").isNull(), "XJP005", "error", F.lit("Type")),
        at("_version", F.col("_version").isNull(), "XJP005", "error", F.lit("RBProjectVersion")),
        at("_type", ~F.col("_type._value").isin(PROJECT_TYPES), "XJP104", "warning", F.col("_type._value")),
        at("_version", F.col("_version").isNotNull() & version.isNull(), "XJP006", "error", F.col("_version._value")),
        at("_version", version > F.lit(NEWEST_VERSION).cast("decimal(38,18)"), "XJP102", "warning", F.col("_version._value")),
    )
    headed = heads.select(project, F.inline(F.array_compact(checks)))
    return found.unionByName(again).unionByName(orphans).unionByName(headed)
