"""Queries of the catalogue and the worklist in depth: sites in order, warnings on arguments, lookups, pages of rows, rows on one side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import catalog, differences, paths, relational, replies, source_code, worklist
from sievework.plans.carriers import _t
from sievework.plans.source_queries import _ENVELOPES, _EXPECTED, _GROUPED, _ROWS, _diagnostics, _matrix, _source
from sievework.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _q(sql: str | None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@_q(f"""WITH d AS ({_GROUPED}) SELECT 'sym' || k AS symbol, p_partkey AS diag_id, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS place FROM d WHERE NOT err AND k < 7""")
def worklist_sites(spark, sf_dir):
    return worklist.worklist_sites(_diagnostics(spark, sf_dir), _matrix(spark)).select("symbol", "diag_id", "place")


# Every word of a document's code lines that is followed by an opening bracket and an argument; the documents' lines get calls from their own words.
@_q(f"""{_ROWS}, c AS (SELECT DISTINCT doc_id, line_no, lower(unnest(regexp_extract_all(regexp_replace(code, ' ([a-z]+) ', ' \\1(x) ', 'g'), '([A-Za-z_][A-Za-z0-9_]*)\\(', 1))) AS w FROM r), y(name, replacement) AS (VALUES ('The', 'T(a)'), ('and', 'A'), ('en', 'E(b As C)'))
SELECT name, count(*) AS uses FROM c JOIN y ON lower(name) = w WHERE contains(replacement, '(') GROUP BY name""")
def argument_warnings(spark, sf_dir):
    lines = source_code.masked_lines(_source(spark, sf_dir), ["doc_id"], "text")
    symbols = spark.createDataFrame([("The", "T(a)"), ("and", "A"), ("en", "E(b As C)")], "name string, replacement string")
    return source_code.argument_warnings(lines.withColumn("code", F.regexp_replace("code", " ([a-z]+) ", " $1(x) ")), symbols)


@_q("""SELECT p_partkey::VARCHAR AS rule_id, CASE WHEN p_size % 4 = 0 THEN 'tier' ELSE 'symbol' END AS found_by FROM part WHERE (p_size % 4 = 0 AND p_brand = 'Brand#1') OR (p_size % 4 != 0 AND split_part(p_name, ' ', 1) = 'red')
UNION ALL SELECT p_partkey::VARCHAR, 'id' FROM part WHERE p_partkey = 7""")
def rule_lookups(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    rules = p.select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_brand").alias("category"), F.when(F.col("p_size") % 4 == 0, "manual-only").otherwise("high").alias("conf"),
        F.concat(word, F.lit(" → Blue")).alias("name"), F.concat(F.lit("Box."), word, F.lit("(red As Colour)")).alias("old"),
    )
    by = lambda df, how: df.select("rule_id", F.lit(how).alias("found_by"))
    tier = by(catalog.rules_where(rules, category="BRAND#1", tier="Manual"), "tier")
    symbol = by(catalog.rules_by_symbol(catalog.rules_where(rules, tier="high"), ".RED"), "symbol")
    return tier.unionByName(symbol).unionByName(by(catalog.rules_where(rules, rule_id="7"), "id"))


@_q("""WITH k AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Event' WHEN 1 THEN 'Method' ELSE 'Property' END AS kind, lower(p_type) || p_size AS name FROM part),
i AS (SELECT lower(p_type) || p_size AS name, p_partkey % 3 = 0 AS method, min(p_partkey) AS page FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL)
SELECT p_partkey, CASE kind WHEN 'Event' THEN NULL WHEN 'Method' THEN coalesce(m.page, o.page) ELSE coalesce(o.page, m.page) END AS page FROM k LEFT JOIN i m ON m.name = k.name AND m.method LEFT JOIN i o ON o.name = k.name AND NOT o.method""")
def documented_pages(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    name = F.concat("p_type", F.col("p_size").cast("string"))
    matrix = p.select("p_partkey", F.concat(name, F.lit("(a As T)")).alias("old"), F.when(F.col("p_size") % 3 == 0, "Event").when(F.col("p_size") % 3 == 1, "Method").otherwise("Property").alias("kind"))
    title = F.concat(F.upper(name), F.when(F.col("p_partkey") % 3 == 0, " Method").otherwise(""), F.lit(" (deprecated)"))
    index = p.select(title.alias("name"), F.when(F.col("p_partkey") % 2 == 0, "deprecated,x").otherwise("").alias("flags"), F.col("p_partkey").alias("page"))
    return catalog.documented_rows(matrix, index).select("p_partkey", "page")


@_q("""WITH p AS (SELECT DISTINCT '.m' || p_size AS key FROM part WHERE p_type = 'ECONOMY'), r AS (SELECT '.m' || p_size AS key, min(p_partkey)::VARCHAR AS origin FROM part GROUP BY 1)
SELECT key, 'x' AS pattern, 'matrix' AS origin FROM p UNION ALL SELECT key, '(?i)\\.' || substr(key, 2) || '\\b', origin FROM r WHERE key NOT IN (SELECT key FROM p)""")
def synthesized_patterns(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    rules = p.select(F.col("p_partkey").alias("rule_id"), F.concat(F.lit(r"(?<=\.)M"), F.col("p_size").cast("string"), F.lit(r"\s")).alias("find"))
    have = p.filter("p_type = 'ECONOMY'").select(F.concat(F.lit(".m"), F.col("p_size").cast("string")).alias("key"), F.lit("x").alias("pattern")).distinct()
    return catalog.with_rule_members(have, rules)


@_q("""SELECT lower(p_brand || p_size) AS old, split_part(arg_max(p_name, p_partkey), ' ', 1) AS new FROM part WHERE p_size % 2 = 0 AND p_type != 'SMALL' GROUP BY 1""")
def renamed_classes(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    old = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "").otherwise(".x"), F.col("p_size").cast("string"))
    cat = F.when(F.col("p_type") == "SMALL", "Out of scope").when(F.col("p_partkey") % 2 == 0, "IDE handles").otherwise("Source — type")
    return catalog.renamed_classes(p.select(F.col("p_partkey").alias("row_id"), old.alias("old"), F.concat("p_name", F.lit("(x)")).alias("new"), cat.alias("cat")))


@_q("""SELECT o_orderkey AS key, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def rows_on_one_side(spark, sf_dir):
    return relational.different_rows(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@_q(f"""WITH e(i, verdict, outcome, ok) AS (VALUES {_EXPECTED}) SELECT event_id, promoted, CASE verdict WHEN 'script_error' THEN 5 WHEN 'unknown' THEN 4 WHEN 'warnings' THEN promoted::INT ELSE (NOT ok)::INT END AS exit_code
FROM events JOIN e ON i = event_id % {len(_ENVELOPES)}, (VALUES (true), (false)) p(promoted)""")
def reply_exit_codes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    envelope = F.get(F.array(*[F.lit(x[0]) for x in _ENVELOPES]), (F.col("event_id") % len(_ENVELOPES)).cast("int"))
    found = replies.classified(e.select("event_id", envelope.alias("envelope")), "envelope")
    code = lambda promoted: F.struct(F.lit(promoted).alias("promoted"), replies.outcome("verdict", "fatal", "key", promoted)["exit_code"].alias("exit_code"))
    return found.select("event_id", F.inline(F.array(code(True), code(False))))


# From each page to the page with the next id, both under their hosts.
@_q("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path, lead(regexp_extract(url, '://([^?#]*)', 1)) OVER (ORDER BY page_id) AS target FROM pages),
a AS (SELECT page_id, list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda x: x != '') AS base, list_filter(string_split(target, '/'), lambda x: x != '') AS goal FROM p WHERE target IS NOT NULL),
s AS (SELECT *, len(list_filter(range(1, least(len(base), len(goal)) + 1), lambda i: base[1:i] = goal[1:i])) AS n FROM a)
SELECT page_id, array_to_string(list_concat(list_transform(range(len(base) - n), lambda i: '..'), goal[n + 1:]), '/') AS link FROM s""")
def relative_links(spark, sf_dir):
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    p = _t(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("path").alias("target"))
    return p.join(nxt, "page_id").select("page_id", paths.link_destination(paths.relative_path(F.col("path"), F.col("target"))).alias("link"))


@_q(r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, '. ', '.' || chr(13) || chr(10)), '[^\n\r]*(?:\r\n|\n|\r)|[^\n\r]+$')) AS x FROM documents WHERE text != '')
SELECT doc_id, count(*) AS lines, sum(ends_with(x, chr(13) || chr(10))::INT)::BIGINT AS windows_endings, sum((NOT ends_with(x, chr(10)))::INT)::BIGINT AS without_ending, sum(length(regexp_replace(x, '[\n\r]+$', '')))::BIGINT AS chars FROM l GROUP BY doc_id""")
def ended_lines(spark, sf_dir):
    text = F.replace("text", F.lit(". "), F.lit(".\r\n"))
    rows = tables.ended_lines(_t(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("ending") == "\r\n").alias("windows_endings"), F.count_if(F.col("ending") == "").alias("without_ending"), F.sum(F.length("line")).alias("chars"))


# What the urls themselves hold decides: an anchor gives backslashes, a query a leading slash, a closing slash a step up.
@_q("""SELECT page_id, path FROM (SELECT page_id, CASE WHEN contains(url, '#') THEN replace(p, '/', chr(92)) WHEN contains(url, '?') THEN '/' || p WHEN ends_with(p, '/') THEN p || '../x' ELSE p END AS path
FROM (SELECT page_id, url, regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages)) WHERE NOT starts_with(path, '/') AND NOT contains(path, chr(92)) AND NOT list_contains(string_split(path, '/'), '..')""")
def safe_url_paths(spark, sf_dir):
    p, url = F.regexp_extract("url", r"://([^?#]*)", 1), F.col("url")
    path = F.when(F.contains(url, F.lit("#")), F.replace(p, F.lit("/"), F.lit("\\"))).when(F.contains(url, F.lit("?")), F.concat(F.lit("/"), p)).when(F.endswith(p, F.lit("/")), F.concat(p, F.lit("../x"))).otherwise(p)
    return tables.safe_paths(_t(spark, sf_dir, "pages").select("page_id", path.alias("path")), "path")


@_q("""WITH m AS (SELECT p_partkey, lower(p_brand || '.' || replace(p_name, ' ', '.')) AS old FROM part)
SELECT p_partkey, CASE WHEN old = 'ring' THEN 'exact' WHEN regexp_extract(old, '([^.]*)$', 1) = 'ring' THEN 'leaf' ELSE 'part' END AS how FROM m WHERE contains(old, 'ring')""")
def part_lookups(spark, sf_dir):
    old = F.concat("p_brand", F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("(size As Integer)"))
    return catalog.lookup(_t(spark, sf_dir, "part").select("p_partkey", old.alias("old")), ".Ring").select("p_partkey", "how")


# A part's name and its suppliers' orders' priorities as two wordings of a replacement.
@_q("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(p_type || '.' || split_part(p_name, ' ', 1)) AS a, lower(CASE WHEN l_quantity > 25 THEN split_part(p_name, ' ', 2) WHEN l_quantity > 12 THEN p_type ELSE p_type || '.' || split_part(p_name, ' ', 1 + l_linenumber % 2) END) AS b
    FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT a AS ours, b AS theirs, count(*) AS n FROM w WHERE NOT (a = b OR starts_with(a, b || '.') OR starts_with(b, a || '.') OR split_part(a, '.', 2) = b OR regexp_extract(b, '([^.]*)$', 1) = a) GROUP BY ALL""")
def wording_disagreements(spark, sf_dir):
    i = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    word = lambda n: F.split_part("p_name", F.lit(" "), n)
    ours = F.concat(F.lit("the `"), "p_type", F.lit("."), word(F.lit(1)), F.lit("` or others"))
    theirs = F.when(F.col("l_quantity") > 25, word(F.lit(2))).when(F.col("l_quantity") > 12, F.col("p_type")).otherwise(F.concat("p_type", F.lit("."), word(F.col("l_linenumber") % 2 + 1)))
    found = catalog.disagreements(i.select("id", ours.alias("replacement")), i.select("id", theirs.alias("replacement")), "id")
    head = lambda c: catalog.first_head(F.col(c))
    return found.groupBy(head("ours").alias("ours"), head("theirs").alias("theirs")).agg(F.count("*").alias("n"))


# A loop for each item, counting up or down between its numbers, with a call whose start adds the line number or takes it away.
@_q("""WITH i AS (SELECT l_quantity::INT % 5 AS low, l_partkey % 9 AS high, l_linenumber AS n, l_returnflag AS f, l_suppkey % 2 = 0 AS plus FROM lineitem),
v AS (SELECT *, CASE f WHEN 'A' THEN low WHEN 'R' THEN high END AS least FROM i)
SELECT CASE f WHEN 'N' THEN 'LITERAL' ELSE 'i=' || least END AS label, CASE WHEN f = 'N' THEN CASE WHEN low >= 1 THEN 'safe' ELSE 'risky' END WHEN least + CASE WHEN plus THEN n ELSE -n END >= 1 THEN 'safe' ELSE 'risky' END AS verdict, count(*) AS calls FROM v GROUP BY ALL""")
def item_loops(spark, sf_dir):
    s = lambda x: x.cast("string")
    low, high, n = F.col("l_quantity").cast("int") % 5, F.col("l_partkey") % 9, F.col("l_linenumber")
    span = F.when(F.col("l_returnflag") == "A", F.concat(s(low), F.lit(" To "), s(high))).otherwise(F.concat(s(low), F.when(F.col("l_tax") > 0.04, " DownTo "), s(high)))
    span = F.coalesce(span, F.concat(s(low), F.lit(" To "), s(high), F.lit(" Step -1")))
    start = F.when(F.col("l_returnflag") == "N", s(low)).otherwise(F.concat(F.lit("i"), F.when(F.col("l_suppkey") % 2 == 0, " + ").otherwise(" - "), s(n)))
    text = F.concat(F.lit("Sub Go()\nFor i As Integer = "), span, F.lit("\n  x = Mid(s, "), start, F.lit(", 1) ' Mid(s, 0)\nNext\nEnd Sub"))
    found = source_code.loop_audit(_t(spark, sf_dir, "lineitem").select("l_orderkey", text.alias("text")), ["l_orderkey"], "text", "Mid")
    return found.groupBy("label", "verdict").agg(F.count("*").alias("calls"))


# Documents and a revision of each: a hash of a line decides whether it stays, goes or is marked.
_REVISED = """l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text || chr(10) || 'end', chr(10)) AS ls FROM documents)),
k AS (SELECT *, CASE WHEN line = 'end' THEN ' ' WHEN md5(line) < '2' THEN '-' WHEN md5(line) < '4' THEN '~' ELSE ' ' END AS what, count(*) FILTER (WHERE what = ' ') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM l),
o AS (SELECT doc_id, block, n, 2 AS turn, ' ' AS op, line FROM k WHERE what = ' ' UNION ALL SELECT doc_id, block, n, 0, '-', line FROM k WHERE what != ' ' UNION ALL SELECT doc_id, block, n, 1, '+', '~' || line FROM k WHERE what = '~')"""


def _revised(spark, sf_dir) -> DataFrame:
    lines, digest = F.split("text", "\n", -1), F.md5
    keep = F.transform(F.filter(lines, lambda x: (digest(x) >= "2") | (x == "end")), lambda x: F.when((digest(x) < "4") & (x != "end"), F.concat(F.lit("~"), x)).otherwise(x))
    end = F.lit("\nend")
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat("text", end).alias("before"), F.array_join(F.array_append(keep, F.lit("end")), "\n").alias("after"))
    return differences.line_changes(d, ["doc_id"], "before", "after")


@_q(f"""WITH {_REVISED} SELECT doc_id, count(*) FILTER (WHERE op = '+') AS added, count(*) FILTER (WHERE op = '-') AS removed FROM o GROUP BY doc_id""")
def revised_lines(spark, sf_dir):
    return differences.change_counts(_revised(spark, sf_dir), ["doc_id"])


@_q(f"""WITH {_REVISED}, s AS (SELECT *, row_number() OVER w AS seq, count(*) FILTER (WHERE op != '+') OVER w AS a, count(*) FILTER (WHERE op != '-') OVER w AS b FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY block, turn, n)),
c AS (SELECT *, max((op != ' ')::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM s),
h AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM c WHERE near = 1),
g AS (SELECT doc_id, min(seq) AS first_seq, max(a) - min(a - (op != '+')::INT) AS na, min(a - (op != '+')::INT) AS a0, max(b) - min(b - (op != '-')::INT) AS nb, min(b - (op != '-')::INT) AS b0, string_agg(op || line, chr(10) ORDER BY seq) AS body FROM h GROUP BY doc_id, island)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_seq)::BIGINT AS hunk, '@@ -' || CASE na WHEN 1 THEN (a0 + 1)::VARCHAR ELSE CASE na WHEN 0 THEN a0 ELSE a0 + 1 END || ',' || na END || ' +' || CASE nb WHEN 1 THEN (b0 + 1)::VARCHAR ELSE CASE nb WHEN 0 THEN b0 ELSE b0 + 1 END || ',' || nb END || ' @@' AS header, md5(body) AS body_md5 FROM g""")
def revision_hunks(spark, sf_dir):
    return differences.hunks(_revised(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("hunk").cast("long").alias("hunk"), "header", F.md5("body").alias("body_md5"))
