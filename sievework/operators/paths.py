"""Paths and the folders above them: nearest listed ancestors, with folders at which the walk ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.relational import bounded


def folder_of(path: Column) -> Column:
    """The folder of a file's path, without a closing slash; '' for a name alone, '/' for a file in the root."""
    cut = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when((cut == "") & F.startswith(path, F.lit("/")), "/").otherwise(cut)


def folders_above(folder: Column) -> Column:
    """The folder and those above it as structs (depth, folder); the root of a path from / is /, the outermost of any other its first part."""
    rooted = F.startswith(folder, F.lit("/"))
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    at = lambda n: F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.slice(parts, 1, n), "/"))
    depths = F.when(rooted, F.sequence(F.lit(0), F.size(parts))).when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(depths, lambda n: F.struct(n.alias("depth"), at(n).alias("folder")))


def relative_path(page: Column, target: Column) -> Column:
    """The target's path as seen from the page's folder: `..` for each folder that the two do not share, then the rest; `.` for the folder itself.

    Empty and `.` parts go. A page in no folder sees the target as it is.
    """
    parts = lambda x: F.filter(F.split(x, "/"), lambda p: ~p.isin("", "."))
    base, to = parts(folder_of(page)), parts(target)
    n = F.least(F.size(base), F.size(to))
    apart = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(base, i) != F.get(to, i))
    shared = F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(apart, F.lit(0)), n))
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(base) - shared), F.slice(to, shared + 1, F.size(to)))
    return F.when(folder_of(page) == "", target).otherwise(F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/")))


def link_destination(path: Column) -> Column:
    """A path with what would end a link's destination early escaped: brackets and blanks."""
    for c, to in (("(", "%28"), (")", "%29"), (" ", "%20")):
        path = F.replace(path, F.lit(c), F.lit(to))
    return path


def nearest_ancestors(folders: DataFrame, folder: str, listed: DataFrame, stops: DataFrame) -> DataFrame:
    """(folder, ancestor, the columns of listed): for each folder the nearest of itself and those above that listed(folder, ...) has.

    The walk ends at the first folder of stops(folder), which is still looked at. Of several rows of a folder the least by its
    columns counts. Each folder is walked once, however many rows have it, and only folders that are listed or stops are
    joined. Folders without such an ancestor have none in the result.
    """
    value = [c for c in listed.columns if c != "folder"]
    one = listed.groupBy("folder").agg(F.min(F.struct(*value)).alias("_v")).select("folder", "_v", F.lit(False).alias("_stop"))
    marks = one.unionByName(stops.select("folder", F.lit(None).cast(one.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_stop")))
    marks = marks.groupBy("folder").agg(F.first("_v", ignorenulls=True).alias("_v"), F.max("_stop").alias("_stop"))
    walk = folders.select(F.col(folder).alias("_from")).distinct().select("_from", F.inline(folders_above(F.col("_from"))))
    met = walk.join(bounded(marks), "folder")
    found = met.groupBy("_from").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("depth", "folder", "_v"))).alias("_n"), F.max(F.when(F.col("_stop"), F.col("depth"))).alias("_s"))
    found = found.filter(F.col("_n").isNotNull() & (F.col("_n.depth") >= F.coalesce("_s", F.lit(0))))
    return found.select(F.col("_from").alias(folder), F.col("_n.folder").alias("ancestor"), "_n._v.*")


def saved_release(manifest: Column) -> Column:
    """struct(year, number) of the release that last saved a project, from a line OrigIDEVersion=yyyynnpp; null without one."""
    part = lambda i: F.regexp_extract(manifest, r"(?m)^OrigIDEVersion=(\d{4})(\d{2})\d{2}", i)
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("year"), part(2).cast("int").alias("number")))


def enclosing_releases(folders: DataFrame, folder: str, manifests: DataFrame, stops: DataFrame) -> DataFrame:
    """(folder, ancestor, path, release): the release of the project around each folder, by manifests(path, text).

    A manifest without a release is passed over, as is one that is no project file, whose extension ends with _project.
    """
    read = manifests.filter(F.col("path").rlike(r"\.[^./]+_project$")).select(folder_of(F.col("path")).alias("folder"), "path", saved_release(F.col("text")).alias("release"))
    return nearest_ancestors(folders, folder, read.filter("release is not null"), stops)
