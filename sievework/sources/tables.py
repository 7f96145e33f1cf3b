"""Reading and writing: trees of files, headed TSV, JSON documents, keyed tables and change detection."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files(spark: SparkSession, root: str, kinds: dict[str, list[str]]) -> DataFrame:
    """(path, length, content, kind): files below root by lower-cased extension; each resolved path once.

    kinds maps a kind to its extensions. Files of no kind, and those in a .git folder, are left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = found.filter(~F.col("path").contains("/.git/"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(*[F.when(ext.isin(exts), F.lit(name)) for name, exts in kinds.items()], F.lit(None).cast("string"))
    return found.withColumn("kind", kind).filter("kind is not null").select("path", "length", "content", "kind")


def decoded(df: DataFrame) -> DataFrame:
    """df(content) with text, and problem: nul, utf8 or null. A byte-order mark is dropped and flagged in has_bom."""
    text = F.col("content").cast("string")
    has_bom = F.expr("startswith(content, X'EFBBBF')")
    problem = F.when(F.expr("contains(content, X'00')"), "nul").when(~F.is_valid_utf8(text), "utf8")
    return df.withColumn("has_bom", has_bom).withColumn("problem", problem).withColumn("text", F.when(problem.isNull(), F.when(has_bom, F.substring(text, 2, 1 << 30)).otherwise(text)))


def line_rows(df: DataFrame, text: str = "text", line_break: str = r"\r\n|\n|\r") -> DataFrame:
    """One row per line with line_no from 1; the empty piece after a last break is no line."""
    lines = F.split(F.col(text), line_break, -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return df.select("*", F.posexplode(lines).alias("_pos", "line")).withColumn("line_no", F.col("_pos") + 1).drop("_pos")


def ended_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines with line_no from 1 and `ending`, the break that ends each, empty for what stands behind the last: line and ending in order give the text."""
    whole = F.regexp_extract_all(F.col(text), F.lit(r"[^\n\r]*(?:\r\n|\n|\r)|[^\n\r]+\z"), 0)
    rows = df.select("*", F.posexplode(whole).alias("_pos", "_whole"))
    ending = F.regexp_extract("_whole", r"(\r\n|\n|\r)?\z", 1)
    return rows.select(*df.columns, (F.col("_pos") + 1).alias("line_no"), F.regexp_replace("_whole", r"[\n\r]+\z", "").alias("line"), ending.alias("ending"))


def line_pairs(df: DataFrame, real: str, masked: str) -> DataFrame:
    """Lines of two parallel texts side by side."""
    pairs = F.arrays_zip(F.split(real, "\n", -1).alias("real"), F.split(masked, "\n", -1).alias("masked"))
    return df.select("*", F.posexplode(pairs).alias("_pos", "_pair")).select(*df.columns, (F.col("_pos") + 1).alias("line_no"), "_pair.*")


#: Files whose headers are sent to all tasks; with more, the rows are shuffled by file.
FILES_SENT = 20_000


def headed_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of unquoted TSV files, each by its own header's names; short rows are padded with empty text; a missing column is an error.

    Files are read in splits like any text, so one large file is the work of many tasks. The header is the first row of the split that
    begins at byte 0, told by the order in which a task reads; the headers, one a file, are joined to the rows by file, and sent to
    the tasks if the files are at most FILES_SENT, which keeps the rows in order. An error shows when rows are read, and planning
    runs no job.
    """
    text = spark.read.text(path)
    lines = text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), F.regexp_replace("value", r"\r$", "").alias("_line"))
    heads = lines.filter("_start = 0").groupBy("_file").agg(F.min(F.struct("_row", "_line")).alias("_h"))
    heads = heads.select("_file", F.col("_h._row").alias("_head_row"), F.split("_h._line", "\t", -1).alias("_head"))
    lacking = F.array_except(F.array(*map(F.lit, columns)), F.col("_head"))
    said = F.concat(F.col("_file"), F.lit(" lacks "), F.array_join(lacking, ", "))
    heads = heads.withColumn("_head", F.when(F.size(lacking) == 0, F.col("_head")).otherwise(F.raise_error(said).cast("array<string>")))
    few = len(text.inputFiles()) <= FILES_SENT  # a listing, no job
    rows = lines.join(F.broadcast(heads) if few else heads, "_file").filter((F.col("_start") != 0) | (F.col("_row") != F.col("_head_row")))
    cell = lambda c: F.get(F.split("_line", "\t", -1), (F.array_position("_head", F.lit(c)) - 1).cast("int"))
    return rows.select(*[F.coalesce(cell(c), F.lit("")).alias(c) for c in columns])


def tsv_lines(df: DataFrame) -> DataFrame:
    """One text column, value: cells with white space collapsed, joined by tabs. Write with .write.text()."""
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "))
    return df.select(F.concat_ws("\t", *[cell(c) for c in df.columns]).alias("value"))


def documents(raw: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """JSON documents under a declared schema, with the raw text beside, so that unknown fields survive."""
    return raw.withColumn("doc", F.from_json(column, schema)).withColumnRenamed(column, "raw")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with their keys."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def keyed_lines(lines: DataFrame, line: str, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of tab-separated lines(line_no, line) of a keyed table: refused(line_no, line, reason) have another number of cells, or no key.

    Empty lines are neither. Of rows with one key the last counts.
    """
    cells = F.split(line, "\t", -1)
    reason = F.when(F.size(cells) != len(columns), F.concat(F.size(cells).cast("string"), F.lit(" cells"))).when(F.trim(F.get(cells, F.lit(columns.index(key)))) == "", "no key")
    read = lines.filter(F.col(line) != "").select("line_no", line, cells.alias("_c"), reason.alias("reason"))
    good = read.filter("reason is null").select("line_no", *[F.get("_c", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    last = good.groupBy(key).agg(F.max(F.struct("line_no", *[c for c in columns if c != key])).alias("_r"))
    return last.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in columns]), read.filter("reason is not null").select("line_no", line, "reason")


def replayed(base: DataFrame, log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base after a log(op, order, the columns of base) of `set` and `remove`: of each key the last entry counts.

    The log is brought down to an entry a key before it meets the base, so a hot key costs one row.
    """
    rest = [c for c in base.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max(F.struct(order, "op", *rest)).alias("_e"))
    put = last.filter("_e.op = 'set'").select(*[F.col(c) if c in keys else F.col(f"_e.{c}").alias(c) for c in base.columns])
    return base.join(last.select(*keys), keys, "left_anti").unionByName(put)


def differing(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of the keys that a save must write: added, removed or changed; none if nothing has to be saved."""
    rest = [c for c in before.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(F.lit(1).alias("_"), *rest).alias(name))
    met = side(before, "_a").join(side(after, "_b"), keys, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return met.select(*keys, change.alias("change")).filter("change is not null")


def saved(before: DataFrame, after: DataFrame, keys: list[str], path: str) -> bool:
    """Write `after` as tab-separated files in order of the keys, only if it differs from `before`; whether it was written."""
    if differing(before, after, keys).isEmpty():
        return False
    tsv_lines(after.orderBy(*keys)).write.text(path)
    return True


def changed(new: DataFrame, old: DataFrame, key: str, content: Column | str) -> DataFrame:
    """Rows of new whose content differs from old's under the key, or that old lacks: all that a writer must write."""
    content = F.col(content) if isinstance(content, str) else content
    digest = lambda df: df.select(key, F.sha2(content.cast("binary"), 256).alias("_digest"))
    return new.withColumn("_digest", F.sha2(content.cast("binary"), 256)).join(digest(old), [key, "_digest"], "left_anti").drop("_digest")


def stale(listing: DataFrame, expected: DataFrame, path: str, complete: bool) -> DataFrame:
    """Listed paths that a build no longer makes, compared without case; none unless the build was complete and made something."""
    if not complete:
        return listing.limit(0)
    low = lambda df: df.withColumn("_low", F.lower(path))
    made = expected.agg((F.count(F.lit(1)) > 0).alias("_some")).filter("_some").drop("_some")  # one row, or none
    return low(listing).join(low(expected).select("_low").distinct(), "_low", "left_anti").drop("_low").crossJoin(F.broadcast(made))


def safe_paths(df: DataFrame, path: str) -> DataFrame:
    """Rows whose path is relative, has no backslash and no parent step."""
    return df.filter(~F.col(path).rlike(r"^/|\\|(^|/)\.\.(/|$)"))


#: Stand for the bytes 0x80 to 0xFF where they are no UTF-8: the last 128 code points, for private use.
_BYTES = 0x10FF00
_KEPT = re.compile("[\U0010ff80-\U0010ffff]")
_LOOSE = re.compile("[\udc80-\udcff]")


@F.pandas_udf(T.StringType())
def text_of(content: pd.Series) -> pd.Series:
    """Bytes as text that bytes_of() turns into the same bytes again: line breaks stay, and bytes that are no UTF-8 become characters of their own.

    So do the bytes of such characters where a text has them, which keeps the mapping one to one.
    """

    def read(b: bytes | None) -> str | None:
        if b is None:
            return None
        t = bytes(b).decode("utf-8", "surrogateescape")
        t = _KEPT.sub(lambda m: m[0].encode().decode("ascii", "surrogateescape"), t)
        return _LOOSE.sub(lambda m: chr(_BYTES + ord(m[0]) - 0xDC00), t)

    return content.map(read)


@F.pandas_udf(T.BinaryType())
def bytes_of(text: pd.Series) -> pd.Series:
    """The bytes of a text from text_of(), edited or not."""
    return text.map(lambda t: None if t is None else _KEPT.sub(lambda m: chr(ord(m[0]) - _BYTES + 0xDC00), t).encode("utf-8", "surrogateescape"))


@F.pandas_udf(T.StringType())
def _inflated(content: pd.Series) -> pd.Series:
    """What is compressed below four lines of text."""
    return content.map(lambda c: None if c is None else zlib.decompress(bytes(c).split(b"\n", 4)[4]).decode())


def inventory_records(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, name, role, page, title) of compressed inventories of a documentation; a $ at an address's end stands for the name, a title of - for none."""
    rows = df.select(*keys, F.explode(F.split(_inflated(content), "\n")).alias("_r"))
    part = lambda i: F.regexp_extract("_r", r"^(.+?)\s+(\S+)\s+(-?\d+)\s+?(\S*)\s+(.*)$", i)
    rows = rows.filter(part(2) != "").select(*keys, part(1).alias("name"), part(2).alias("role"), part(4).alias("_uri"), F.trim(part(5)).alias("title"))
    uri = F.when(F.endswith("_uri", F.lit("$")), F.concat(F.expr("left(_uri, length(_uri) - 1)"), "name")).otherwise(F.col("_uri"))
    page = F.regexp_replace(F.split_part(uri, F.lit("#"), F.lit(1)), r"\.html$", "")
    return rows.select(*keys, "name", "role", page.alias("page"), F.when(F.col("title") == "-", "").otherwise(F.col("title")).alias("title"))


def json_report(df: DataFrame) -> DataFrame:
    """One text column, value: each row as a JSON object. Write with .write.text()."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
