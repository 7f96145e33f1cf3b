"""Replies as JSON and their verdicts, links between pages, location indexes, ranks and differences."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Keys of a diagnostics payload, in the order in which they are looked for.
PAYLOADS = ["scriptError", "buildError", "openErrors", "loadError", "missingFiles"]


def json_kind(text: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID and so on; null if the text is no JSON."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(text)), r"^[A-Z]+", 0)


def classified(replies: DataFrame, envelope: str) -> DataFrame:
    """replies with key and verdict: ok, warnings, empty, unknown, open_errors, missing_files, script_error or errors; fatal for open errors that stop a load.

    A payload inside "response" goes before one beside it. Script diagnostics are an error unless all are warnings.
    """
    e = F.col(envelope)
    at = lambda path: F.get_json_object(e, path)
    key = F.coalesce(*[F.when(at(f"$.{where}{k}").isNotNull(), k) for where in ("response.", "") for k in PAYLOADS], F.lit(None).cast("string"))
    payload = F.coalesce(*[at(f"$.{where}{k}") for where in ("response.", "") for k in PAYLOADS])
    typed = replies.withColumn("key", F.when(json_kind(e) == "OBJECT", key)).withColumn("_p", payload)
    items = F.when(json_kind(F.col("_p")) == "ARRAY", F.from_json("_p", T.ArrayType(T.StringType()))).otherwise(F.array("_p"))
    kinds = F.transform(items, lambda x: F.lower(F.trim(F.coalesce(F.get_json_object(x, "$.type"), F.lit("")))))
    listed = lambda name: F.coalesce(F.get_json_object("_p", f"$.{name}"), F.lit("[]"))
    arrays = (json_kind(listed("errors")) == "ARRAY") & (json_kind(listed("warnings")) == "ARRAY")
    build = F.when(json_kind(F.col("_p")) != "OBJECT", "unknown").when(~arrays, "unknown").when(listed("errors") != "[]", "errors").when(listed("warnings") != "[]", "warnings").otherwise("ok")
    response, kind = at("$.response"), json_kind(at("$.response"))
    plain = F.when(json_kind(e).isNull() | (json_kind(e) != "OBJECT"), "unknown").when(response == "{}", "empty").when(response.isNotNull() & (kind.isNull() | (kind != "OBJECT")), "ok").when(e.rlike(r'"response"\s*:\s*null'), "empty").otherwise("unknown")
    verdict = (
        F.when(F.col("key") == "scriptError", F.when(F.forall(kinds, lambda x: F.endswith(x, F.lit("warning"))), "warnings").otherwise("script_error"))
        .when(F.col("key") == "buildError", build)
        .when(F.col("key") == "openErrors", "open_errors")
        .when(F.col("key") == "missingFiles", "missing_files")
        .when(F.col("key") == "loadError", "unknown")
        .otherwise(plain)
    )
    fatal = (F.col("key") == "openErrors") & F.col("_p").rlike(r'"isFatal"\s*:\s*true')
    return typed.withColumn("verdict", verdict).withColumn("fatal", F.coalesce(fatal, F.lit(False))).drop("_p")


# Exit codes of verdicts that have one of their own; of the others a run that is well exits 0, else 1.
EXIT_CODES = {"script_error": 5, "unknown": 4}


def outcome(verdict: str, fatal: str, key: str, warnings_as_errors: bool = False) -> Column:
    """struct(ok, outcome, exit_code): what a verdict means for the run."""
    v = F.col(verdict)
    ok = (v == "ok") | ((v == "open_errors") & ~F.col(fatal)) | ((v == "warnings") & F.lit(not warnings_as_errors))
    name = (
        F.when(v == "errors", "project_errors")
        .when(v == "warnings", F.when(F.col(key) == "scriptError", "script_warnings").otherwise("project_warnings"))
        .when(v == "empty", "empty_response")
        .when(v == "unknown", "unknown_response")
        .when(v == "ok", "success")
        .otherwise(v)
    )
    code = F.coalesce(*[F.when(v == name_, F.lit(n)) for name_, n in EXIT_CODES.items()], F.when(ok, 0).otherwise(1))
    return F.struct(ok.alias("ok"), name.alias("outcome"), code.alias("exit_code"))


def method_spec(rules: DataFrame, order: str) -> DataFrame:
    """(function, method, drop_empty) of rules(forms, applies, old, new) that turn a global call into a method, the first of each function."""
    function = F.regexp_extract("old", r"^([A-Za-z_]\w*)\s*\(", 1)
    method, brackets = F.regexp_extract("new", r"^\s*[A-Za-z_]\w*\.([A-Za-z_]\w*)(\s*\()?", 1), F.regexp_extract("new", r"^\s*[A-Za-z_]\w*\.([A-Za-z_]\w*)(\s*\()?", 2)
    able = rules.filter(F.col("forms").rlike("^(global|both)") & F.col("applies") & (function != "") & (method != ""))
    first = able.groupBy(F.lower(function).alias("_low")).agg(F.min(F.struct(order, function.alias("function"), method.alias("method"), (brackets == "").alias("drop_empty"))).alias("_f"))
    return first.select("_f.function", "_f.method", "_f.drop_empty")


def resolved_links(links: DataFrame, pages: DataFrame, labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """links(link_id, current, target, kind) with page: of a doc link the page of that name, or of that name without case; of a ref link the member's page, else the label's.

    state: linked, self (a link to the page it stands on says nothing, but a member's does), or unresolved. pages(page),
    labels(label, page), anchors(anchor, page).
    """
    exact = pages.select(F.col("page").alias("_t"), F.col("page").alias("_exact")).distinct()
    low = pages.groupBy(F.lower("page").alias("_l")).agg(F.min("page").alias("_low"))
    one = lambda df, key, to: df.groupBy(F.col(key).alias("_t")).agg(F.max("page").alias(to))
    met = links.withColumn("_t", F.regexp_replace(F.trim("target"), "^/+", "")).withColumn("_l", F.lower("_t"))
    met = met.join(exact, "_t", "left").join(low, "_l", "left").join(one(anchors, "anchor", "_member"), "_t", "left").join(one(labels, "label", "_label"), "_t", "left")
    doc = F.col("kind") == "doc"
    page = F.when(doc, F.coalesce("_exact", "_low")).otherwise(F.coalesce("_member", "_label"))
    own = (page == F.col("current")) & (doc | F.col("_member").isNull())
    return met.withColumn("state", F.when(page.isNull(), "unresolved").when(own, "self").otherwise("linked")).withColumn("page", page).drop("_t", "_l", "_exact", "_low", "_member", "_label")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row within its keys; the order must end in a column that tells rows apart."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def concatenated(*tables: DataFrame) -> DataFrame:
    """All rows of tables of different columns; what a table lacks is null."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def quoted(text: Column) -> Column:
    """A path quoted for a URL: slashes and unreserved characters stay."""
    x = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unquoted(text: Column) -> Column:
    """A quoted path; a plus is a plus."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


@F.pandas_udf(T.StringType())
def same_title_key(title: pd.Series) -> pd.Series:
    """Canonically composed and case-folded, so that equal titles are equal strings."""
    return title.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


def listed_titles(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """keys, place, title: the entries of a tab-separated list, with their places from 0."""
    return df.select(*keys, F.posexplode(F.split(raw, "\t", -1)).alias("place", "title"))


def gates(difference: DataFrame, least: int = 1000, present: float = 0.99, apart: float = 0.02) -> DataFrame:
    """set_difference() with gates: enough names, nearly all present, few that differ."""
    left = F.col("left_only") + F.col("in_both")
    return difference.withColumns({"enough": left >= least, "mostly_present": F.col("in_both") >= left * present, "close": F.col("share") <= apart})


def live_on(rows: DataFrame, keys: list[str], receivers: str) -> DataFrame:
    """Per key the sorted union of the receivers, comma-separated."""
    each = rows.select(*keys, F.explode_outer(receivers).alias("_r")).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("_r")), ",").alias("live_on"))
    return each


def rewritten_notes(rows: DataFrame, documented: DataFrame, note: str, target: str) -> DataFrame:
    """rows whose confirmation sentence is rewritten to what documented(name, kind) lists; others stay. rewritten says which."""
    known = documented.select(F.lower("name").alias("_t"), F.when(F.col("kind") == "event", "event").otherwise("member").alias("_what")).dropDuplicates(["_t"])
    met = rows.withColumn("_t", F.lower(target)).join(known, "_t", "left")
    old = r"checked against the documentation index, which lists .*? as a documented (?:member|event)\.(?= Imported because)"
    new = F.regexp_replace(F.col(note), F.lit(old), F.concat(F.lit("checked against the documentation index, which lists "), F.col(target), F.lit(" as a documented "), "_what", F.lit(".")))
    return met.withColumn("rewritten", F.coalesce(new != F.col(note), F.lit(False))).withColumn(note, F.coalesce(new, F.col(note))).drop("_t", "_what")


# Fields of an open error that are fields of their own and not part of its message.
_OWN_FIELDS = ["type", "message", "severity", "isfatal", "location", "position", "source"]


def diagnostic_rows(items: DataFrame, raw: str, severity: str, kind: str) -> DataFrame:
    """items with one schema for the three shapes of a diagnostic: type, message, severity, location, position, line, line_raw, column_no.

    An open error may hide in an object under one key, which names its type; without a message it gets one of its plain
    fields, and its own severity counts. A script's location is an object whose line is one too high; a project's is text,
    and its line stands in the position.
    """
    x = items.withColumn("_keys", F.json_object_keys(raw)).withColumn("_at", F.get_json_object(raw, "$.message"))
    x = x.withColumn("_inner", F.expr(f"get_json_object({raw}, concat('$.', _keys[0]))"))
    wrapped = (F.col(kind) == "open") & F.col("_at").isNull() & (F.size("_keys") == 1) & F.startswith(F.trim("_inner"), F.lit("{"))
    x = x.withColumn("_wrapper", F.when(wrapped, F.get("_keys", F.lit(0)))).withColumn("_body", F.when(wrapped, F.col("_inner")).otherwise(F.col(raw)))
    at = lambda path: F.get_json_object("_body", f"$.{path}")
    plain = F.map_filter(F.from_json("_body", T.MapType(T.StringType(), T.StringType())), lambda k, v: v.isNotNull() & ~F.lower(k).isin(_OWN_FIELDS) & ~v.rlike(r"^[\[{]"))
    extra = F.array_join(F.transform(F.array_sort(F.map_entries(plain)), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ", ")
    name = F.coalesce(at("type"), "_wrapper")
    told = F.when(F.col(kind) == "open", F.concat(name, F.when(extra != "", F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise("")))
    script, own = F.col(kind) == "script", F.lower(F.trim(at("severity")))
    sent = F.coalesce(at("location.line"), at("line")).try_cast("int")
    column = at("location.column").try_cast("int")
    place = F.regexp_extract(F.coalesce(at("position"), F.lit("")), r"(?i)line (\d+)", 1).try_cast("int")
    return x.select(
        *items.columns,
        name.alias("type"),
        F.coalesce(at("message"), told).alias("message"),
        F.when((F.col(kind) == "open") & own.isin("error", "warning"), own).otherwise(F.col(severity)).alias("said"),
        F.when(~script & ~F.startswith(F.coalesce(at("location"), F.lit("{")), F.lit("{")), at("location")).alias("location"),
        F.when(~script, at("position")).alias("position"),
        F.when(script, F.when(sent > 1, sent - 1).when(sent == 1, sent)).otherwise(place).alias("line"),
        F.when(script, sent).alias("line_raw"),
        F.when(script & (column >= 0), column).alias("column_no"),
    )
