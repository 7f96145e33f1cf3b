"""Queries over pages, paths and source files that Spark renders from the given tables, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import designer, locations, pages, paths
from sievework.plans.carriers import _t
from sievework.sources import tables
from sievework.streaming import messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _q(sql: str | None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _items(spark: SparkSession, sf_dir: str, render: Callable[[Column], Column]) -> DataFrame:
    """(order, items): what render() makes of an order's items, in order."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), render), "").alias("items"))


def _s(x: Column) -> Column:
    return x.cast("string")


# A page for each customer: its name between rules, its orders under a rule, their items under rules of three other
# characters, some with a rule above too.
_UNITS = """u AS (SELECT c_custkey AS c, -1 AS o, 0 AS l, 0 AS p, 0 AS s, 0.0::DOUBLE AS q, '' AS f, c_name AS title, 1 AS level, 1 AS ruled, 1 AS own FROM customer
    UNION ALL SELECT o_custkey, o_orderkey, 0, 0, 0, 0.0::DOUBLE, '', 'Order ' || o_orderkey, 2, 0, 2 FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, 'Item ' || l_linenumber, 3 + l_linenumber % 3, (l_quantity > 25)::INT, 2 + (l_returnflag = 'R')::INT FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
n AS (SELECT *, row_number() OVER w AS no, 3 + coalesce(sum(ruled + 2 + own) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, 3 + sum(ruled + 2 + own) OVER (PARTITION BY c) AS total FROM u WINDOW w AS (PARTITION BY c ORDER BY o, l, p, s, q, f))"""


@_q(f"""WITH RECURSIVE {_UNITS},
k AS (SELECT n.*, (SELECT max(m.no) FROM n m WHERE m.c = n.c AND m.no < n.no AND m.level < n.level) AS up, (SELECT min(m.above) FROM n m WHERE m.c = n.c AND m.no > n.no AND m.level <= n.level) AS nxt FROM n),
t AS (SELECT c, no, [title] AS path FROM k WHERE up IS NULL UNION ALL SELECT k.c, k.no, list_append(t.path, k.title) FROM t JOIN k ON k.c = t.c AND k.up = t.no)
SELECT c AS page, no AS section_no, array_to_string(path, ' > ') AS path, level::INT AS level, (above + ruled + 1)::INT AS first_line, coalesce(nxt, total)::INT AS last_line, own AS own_lines FROM k JOIN t USING (c, no)
UNION ALL SELECT c_custkey, 0, '', 0, 1, 3, 3 FROM customer""")
def section_tree(spark, sf_dir):
    rule = lambda x, c: F.concat(F.repeat(F.lit(c), 12), F.lit("\n"))  # noqa: E731, ARG005

    def item(x):
        under = F.element_at(F.array(F.lit("~~~~~~~\n"), F.lit("^^^^^^^\n"), F.lit('"""""""\n')), x["l_linenumber"] % 3 + 1)
        text = F.when(x["l_returnflag"] == "R", "returned\n\tlate\n\n").otherwise("kept\n\n")
        return F.concat(F.when(x["l_quantity"] > 25, under).otherwise(""), F.lit("Item "), _s(x["l_linenumber"]), F.lit("\n"), under, text)

    own = F.concat(F.lit("Order "), _s(F.col("o_orderkey")), F.lit("\n---\n"), "o_orderpriority", F.lit("\n.. a comment\n"), F.coalesce("items", F.lit("")))
    orders = _t(spark, sf_dir, "orders").join(_items(spark, sf_dir, item), "o_orderkey", "left")
    orders = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", own.alias("text")))), lambda x: x["text"]), "").alias("orders"))
    head = F.concat(F.lit(".. label:\nClass\n\n=====\n"), "c_name", F.lit("\n=====\n\n"), F.coalesce("orders", F.lit("")))
    text = _t(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select(F.col("c_custkey").alias("page"), head.alias("text"))
    tree = pages.section_tree(pages.page_arrays(text, ["page"], "text"), ["page"])
    return tree.select("page", "section_no", F.array_join("path", " > ").alias("path"), "level", "first_line", "last_line", "own_lines")


@_q("""SELECT l_orderkey AS page, 'm.' || l_linenumber AS anchor, CASE WHEN l_linenumber % 2 = 0 THEN 'Order' || l_orderkey || '.Fn' || l_linenumber ELSE 'Fn' || l_linenumber END AS qualified, 'Fn' || l_linenumber AS name, '(x As T' || l_partkey || ')' AS signature, 'method' AS kind,
md5(chr(10) || 'body ' || l_quantity::INT || chr(10) || '  deeper' || CASE WHEN l_returnflag = 'R' THEN chr(10) || 'It was deprecated.' ELSE '' END) AS body_md5, l_returnflag = 'R' AS deprecated FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag != 'N'""")
def page_members(spark, sf_dir):
    def item(x):
        n = _s(x["l_linenumber"])
        qualified = F.when(x["l_linenumber"] % 2 == 0, F.concat(F.lit("OrderKEY.Fn"), n, F.lit("\n\n"))).otherwise("")
        signature = F.when(x["l_returnflag"] != "N", F.concat(F.lit("**Fn"), n, F.lit("** \\(x As T"), _s(x["l_partkey"]), F.lit(")\n\n    body "))).otherwise("    no signature ")
        return F.concat(F.lit(".. _m."), n, F.lit(":\n\n"), qualified, F.lit(".. note\n"), signature, _s(x["l_quantity"].cast("int")), F.lit("\n      deeper\n"), F.when(x["l_returnflag"] == "R", "    It was deprecated.\n").otherwise(""))

    orders = _t(spark, sf_dir, "orders").select("o_orderkey").join(_items(spark, sf_dir, item), "o_orderkey")
    body = F.replace("items", F.lit("KEY"), _s(F.col("o_orderkey")))
    text = F.concat(F.lit("Class\n=====\nOrder\n=====\n.. _not:\n\n**Not a member**\n\nMethod descriptions\n---\n"), body, F.lit("Notes\n-----\n.. _other:\n\n**Other**\n"))
    found = pages.members(pages.page_arrays(orders.select(F.col("o_orderkey").alias("page"), text.alias("text")), ["page"], "text"), ["page"])
    signature = F.regexp_replace("signature", r"^\\", "")
    return found.select("page", "anchor", "qualified", "name", signature.alias("signature"), "kind", F.md5(F.array_join("body", "\n")).alias("body_md5"), "deprecated")


@_q("""WITH t AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, lang, source FROM documents)
SELECT doc_id, r::INT AS row_no, CASE doc_id % 3 WHEN 0 THEN 'number|the text, whole' WHEN 1 THEN 'a|b' END AS header, md5(CASE r WHEN 1 THEN doc_id || '|' || text ELSE lang || '|' || 'say "' || source || '"' END) AS cells_md5 FROM t, (VALUES (1), (2)) v(r)""")
def quoted_tables(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    cell = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    top = F.element_at(F.array(F.lit(':header: number, "the text, whole"\n:widths: 1 2\n\n'), F.lit(":header-rows: 1\n\n a , b\n"), F.lit(":class: plain\n\n")), (F.col("doc_id") % 3 + 1).cast("int"))
    body = F.concat(top, _s(F.col("doc_id")), F.lit(",  "), cell(F.col("text")), F.lit("\n,  ,\n"), "lang", F.lit(', "say ""'), "source", F.lit('"""\n'))
    rows = pages.table_rows(d.select("doc_id", body.alias("body")), ["doc_id"], "body")
    return rows.select("doc_id", "row_no", F.array_join("header", "|").alias("header"), F.md5(F.array_join("cells", "|")).alias("cells_md5"))


# Every page stands in a folder: the parts of its host from the right, then those of its path. Some folders hold a
# manifest, some are where a walk upward ends.
_FOLDERS = """h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages),
f AS (SELECT page_id, list_filter(list_concat(list_reverse(string_split(host, '.')), string_split(p, '/')), lambda x: x != '') AS parts FROM h),
w AS (SELECT DISTINCT parts, unnest(generate_series(0, len(parts) - 1)) AS depth FROM f),
a AS (SELECT parts, depth, '/' || array_to_string(parts[1:depth], '/') AS folder FROM w), m AS (SELECT DISTINCT folder, md5(folder) AS k FROM a),
l AS (SELECT folder, 2010 + (k < '1')::INT + (k < '2')::INT AS year, 1 + (substr(k, 3, 1) < '8')::INT AS number FROM m WHERE k < '4'), st AS (SELECT folder FROM m WHERE substr(k, 2, 1) < '3')"""


@_q(f"""WITH {_FOLDERS}, b AS (SELECT parts, max(depth) FILTER (l.folder IS NOT NULL) AS near, max(depth) FILTER (st.folder IS NOT NULL) AS stop FROM a LEFT JOIN l USING (folder) LEFT JOIN st USING (folder) GROUP BY parts)
SELECT page_id, l.folder AS ancestor, year, number FROM f JOIN b USING (parts) JOIN l ON l.folder = '/' || array_to_string(parts[1:near], '/') WHERE near >= coalesce(stop, 0)""")
def enclosing_releases(spark, sf_dir):
    url = F.col("url")
    parts = F.concat(F.reverse(F.split(F.regexp_extract(url, r"://([^/?#]*)", 1), r"\.")), F.split(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), "/"))
    path = F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda x: x != ""), "/"))
    p = _t(spark, sf_dir, "pages").select("page_id", paths.folder_of(path).alias("folder"))
    every = p.select(F.inline(paths.folders_above(F.col("folder")))).select("folder").distinct().withColumn("k", F.md5("folder"))
    year = F.lit(2010) + (F.col("k") < "1").cast("int") + (F.col("k") < "2").cast("int")
    text = F.concat(F.lit("Type=Web\nOrigIDEVersion="), _s(year), F.lit("0"), _s(F.when(F.substring("k", 3, 1) < "8", 2).otherwise(1)), F.lit("10\n"))
    in_folder = lambda name: F.concat(F.when(F.col("folder") == "/", "").otherwise(F.col("folder")), F.lit(f"/{name}"))
    manifests = every.filter("k < '4'").select(in_folder("app.src_project").alias("path"), text.alias("text"))
    others = every.select(in_folder("read.me").alias("path"), F.lit("OrigIDEVersion=20990100").alias("text"))
    unsaved = every.select(in_folder("aaa.src_project").alias("path"), F.lit("Type=Web").alias("text"))
    found = paths.enclosing_releases(p, "folder", manifests.unionByName(others).unionByName(unsaved), every.filter(F.substring("k", 2, 1) < "3").select("folder"))
    return p.join(found, "folder").select("page_id", "ancestor", F.col("release.year").alias("year"), F.col("release.number").alias("number"))


# A file for each order: a class, a layout block or neither names its container; its items are methods, event handlers and
# computed properties, with a diagnostic for each.
_FILES = """i AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_returnflag AS f, o_custkey % 3 AS k, row_number() OVER w AS n,
        1 + coalesce(sum(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 4 ELSE 7 + 4 * (l_quantity > 25)::INT END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)),
c AS (SELECT *, CASE k WHEN 0 THEN 'cls' WHEN 1 THEN 'win' ELSE 'file' END || o AS container FROM i),
x AS (SELECT o, container, 'run' || l AS member, above + 1 AS line_no FROM c WHERE f = 'A' UNION ALL SELECT o, container, 'pressed', above + 2 FROM c WHERE f = 'R' UNION ALL SELECT o, container, 'box' || l || '.pressed', above + 2 FROM c WHERE f = 'R' UNION ALL SELECT o, 'box' || l, 'pressed', above + 2 FROM c WHERE f = 'R'
    UNION ALL SELECT o, container, 'prop' || l || m, above + 3 FROM c, (VALUES ('.get'), ('')) v(m) WHERE f = 'N' UNION ALL SELECT o, container, 'prop' || l || m, above + 7 FROM c, (VALUES ('.set'), ('')) v(m) WHERE f = 'N' AND q > 25)"""


@_q(f"""WITH {_FILES} SELECT o, container, member, line_no::INT AS line_no FROM x""")
def accessor_index(spark, sf_dir):
    return locations.location_index(_files(spark, sf_dir), ["o"], "stem").select("o", "container", "member", "line_no")


@_q(f"""WITH {_FILES}, d AS (SELECT o, n, p % 7 AS line, container || CASE WHEN f = 'A' THEN '.run' || l WHEN f = 'R' THEN CASE p % 3 WHEN 0 THEN '.box' || l ELSE '' END || '.pressed' WHEN p % 4 = 3 THEN '.prop' || l ELSE '.prop' || l || CASE p % 2 WHEN 0 THEN '.get' ELSE '.set' END END AS loc FROM c),
s AS (SELECT *, string_split(loc, '.') AS ps FROM d), v AS (SELECT *, unnest(generate_series(len(ps) - 1, 1, -1)) AS i FROM s),
k AS (SELECT o, n, line, i, j, CASE j WHEN 2 THEN ps[1] ELSE array_to_string(ps[1:i], '.') END AS container, CASE j WHEN 3 THEN ps[len(ps)] ELSE array_to_string(ps[i + 1:], '.') END AS member FROM v, (VALUES (1), (2), (3)) w(j)),
g AS (SELECT container, member, count(*) AS hits, min(o) AS o2, min(line_no) AS at_line FROM x GROUP BY ALL),
b AS (SELECT o, n, line, arg_min(at_line, -3 * i + j) FILTER (hits = 1) AS at_line, arg_min(hits, -3 * i + j) FILTER (hits > 1) AS many FROM k LEFT JOIN g USING (container, member) GROUP BY ALL)
SELECT o, n, CASE WHEN at_line IS NOT NULL THEN 'located' WHEN many IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS resolution, (at_line + line)::INT AS file_line, CASE WHEN at_line IS NULL THEN many END::INT AS candidates FROM b""")
def located_diagnostics(spark, sf_dir):
    index = locations.location_index(_files(spark, sf_dir), ["o"], "stem")
    i = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))
    p, own = F.col("l_partkey"), _s(F.col("l_linenumber"))
    event = F.concat(F.when(p % 3 == 0, F.concat(F.lit(".Box"), own)).otherwise(""), F.lit(".PRESSED"))
    accessor = F.concat(F.lit(".Prop"), own, F.when(p % 4 == 3, "").when(p % 2 == 0, ".Get").otherwise(".Set"))
    what = F.when(F.col("l_returnflag") == "A", F.concat(F.lit(".run"), own)).when(F.col("l_returnflag") == "R", event).otherwise(accessor)
    d = i.select(F.struct(F.col("l_orderkey").alias("o"), n.alias("n")).alias("id"), F.concat(_container("l_orderkey"), what).alias("location"), (p % 7).cast("int").alias("line"))
    found = locations.located(d, "id", "location", "line", index, ["o"])
    return found.select("id.o", "id.n", "resolution", "file_line", F.when(F.col("candidates").isNotNull(), F.size("candidates")).alias("candidates"))


def _container(order: str) -> Column:
    return F.concat(F.when(F.col("o_custkey") % 3 == 0, "CLS").when(F.col("o_custkey") % 3 == 1, "Win").otherwise("File"), _s(F.col(order)))


def _files(spark, sf_dir) -> DataFrame:
    """(o, stem, line_no, line, code): the lines of the file of each order."""

    def item(x):
        n = _s(x["l_linenumber"])
        method = F.concat(F.lit("\n  Private Sub Run"), n, F.lit("()\n  End Sub"))
        event = F.concat(F.lit("\n#tag Events Box"), n, F.lit("\nSub Pressed()\nEnd Sub\n#tag EndEvents"))
        setter = F.when(x["l_quantity"] > 25, "\n#tag Setter\n  Set\nEnd Set\n#tag EndSetter").otherwise("")
        accessors = F.concat(F.lit("\n#tag ComputedProperty, Flags = &h0\n#tag Getter\n\tGet\nEnd Get\n#tag EndGetter"), setter, F.lit("\n  Prop"), n, F.lit(" As Integer\n#tag EndComputedProperty"))
        return F.when(x["l_returnflag"] == "A", method).when(x["l_returnflag"] == "R", event).otherwise(accessors)

    o = _t(spark, sf_dir, "orders").join(_items(spark, sf_dir, item), "o_orderkey")
    head = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Protected Class Cls"), _s(F.col("o_orderkey")))).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("Begin DesktopWindow Win"), _s(F.col("o_orderkey")))).otherwise("// no class")
    text = o.select(F.col("o_orderkey").alias("o"), F.concat(F.lit("File"), _s(F.col("o_orderkey"))).alias("stem"), F.concat(head, "items").alias("text"))
    lines = text.select("o", "stem", F.posexplode(F.split("text", "\n")).alias("_at", "line"))
    code = F.when(F.startswith(F.trim("line"), F.lit("#")) | F.startswith("line", F.lit("//")), "").otherwise(F.col("line"))
    return lines.select("o", "stem", (F.col("_at") + 1).alias("line_no"), "line", code.alias("code"))


# A manifest for each customer: headers that vary with the customer, and a line for each order.
@_q("""WITH o AS (SELECT o_custkey AS c, 2 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, o_orderkey AS k, 1 + o_orderkey % 40 AS id, o_orderkey % 7 AS r, (o_orderkey // 7) % 50 AS parent FROM orders JOIN customer ON c_custkey = o_custkey),
i AS (SELECT * FROM o WHERE r > 2), f AS (SELECT c, id, min(line_no) AS first FROM i GROUP BY ALL)
SELECT c AS customer, line_no::INT AS line_no, CASE r WHEN 0 THEN 'XJP001' WHEN 1 THEN 'XJP002' ELSE 'XJP004' END AS code, 'error' AS severity, CASE r WHEN 1 THEN 'Ord-' || k END AS detail FROM o WHERE r < 3
UNION ALL SELECT c, line_no::INT, 'XJP003', 'error', first::VARCHAR FROM i JOIN f USING (c, id) WHERE line_no > first
UNION ALL SELECT c, line_no::INT, 'XJP007', 'error', '&h' || printf('%X', parent) FROM i WHERE parent != 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.c = i.c AND f.id = i.parent)
UNION ALL SELECT c_custkey, 1, 'XJP104', 'warning', c_mktsegment FROM customer WHERE c_nationkey % 5 = 1 UNION ALL SELECT c_custkey, 0, 'XJP005', 'error', 'Type' FROM customer WHERE c_nationkey % 5 = 2
UNION ALL SELECT c_custkey, 2, 'XJP006', 'error', c_name FROM customer WHERE c_nationkey % 4 = 1 UNION ALL SELECT c_custkey, 2, 'XJP102', 'warning', '2026.' || (22 + c_nationkey) FROM customer WHERE c_nationkey % 4 = 2 UNION ALL SELECT c_custkey, 0, 'XJP005', 'error', 'RBProjectVersion' FROM customer WHERE c_nationkey % 4 = 3
UNION ALL SELECT c_custkey, 1, 'XJP101', 'warning', NULL FROM customer WHERE c_nationkey % 5 = 2 UNION ALL SELECT c_custkey, 2, 'XJP101', 'warning', NULL FROM customer WHERE c_nationkey % 4 = 3""")
def manifest_codes(spark, sf_dir):
    from pyspark.sql import Window

    c, k = _t(spark, sf_dir, "customer"), F.col("o_orderkey")
    nation = F.col("c_nationkey")
    kind = F.when(nation % 5 == 1, F.concat(F.lit("Type="), "c_mktsegment")).when(nation % 5 == 2, "").otherwise("Type=Desktop")
    version = F.when(nation % 4 == 1, F.concat(F.lit("RBProjectVersion="), "c_name")).when(nation % 4 == 2, F.concat(F.lit("RBProjectVersion=2026."), _s(22 + nation))).when(nation % 4 == 3, "").otherwise("RBProjectVersion=2026.021")
    heads = c.select(F.col("c_custkey").alias("customer"), F.posexplode(F.array(kind, version)).alias("_at", "line")).select("customer", (F.col("_at") + 1).alias("line_no"), "line")
    parent = F.concat(F.lit("&h"), F.hex(F.floor(k / 7) % 50))
    item = F.concat(F.lit("Class=Name;Path.x;&h"), F.hex(k % 40 + 1), F.lit(";"), parent, F.when(k % 2 == 0, ";true").otherwise(";False;more;"))
    line = F.when(k % 7 == 0, "no equals sign").when(k % 7 == 1, F.concat(F.lit("Ord-"), _s(k), F.lit("=1"))).when(k % 7 == 2, "Class=a;b;&hXY;&h1;true").otherwise(item)
    place = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 2).alias("line_no")
    own = _t(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(F.col("o_custkey").alias("customer"), place, line.alias("line"))
    return designer.manifest_problems(heads.unionByName(own), "customer", "line_no", "line")


@_q(None)
def designer_codes(spark, sf_dir):
    """A file for each order, its items lines of tags and blocks that a hash of the item picks; tested against brute force."""
    choices = ["#tag Window", "#tag EndWindow", "Begin Label One", "End", "#tag Method, Flags = &h0", "#tag EndMethod", "\t#tag Events Box", "#tag EndEvents", "End Image", "#tag MultiImage", "Image", "BeginPage Two", "#tag EndMultiImage", "End ScreenContent", "#tag ", "#tag Novel", "#tag Instance, Name = a"]
    pick = lambda x: F.get(F.array(*map(F.lit, choices)), (F.pmod(F.xxhash64(x["l_partkey"], x["l_suppkey"], x["l_linenumber"]), F.lit(len(choices)))).cast("int"))
    items = _items(spark, sf_dir, lambda x: F.concat(pick(x), F.lit("\n"), F.get(F.array(*map(F.lit, choices)), (x["l_partkey"] % len(choices)).cast("int")), F.lit("\n")))
    path = F.concat(F.lit("a/File"), _s(F.col("o_orderkey")), F.when(F.col("o_orderkey") % 2 == 0, ".src_window").otherwise(".src_code"))
    return designer.designer_problems(items.withColumn("path", path), "o_orderkey", "path", "items")


@_q(r"""SELECT doc_id, md5(encode(replace(replace(text, 'the ', 'THE '), 'src', 'from')) || '\xFF\x0D\x0A\xC3'::BLOB || encode(replace(source, 'src', 'from') || chr(1114111)) || '\x80'::BLOB) AS edited_md5 FROM documents""")
def byte_edits(spark, sf_dir):
    raw = lambda hexed: F.unhex(F.lit(hexed))
    content = F.concat(F.encode("text", "UTF-8"), raw("FF0D0AC3"), F.encode("source", "UTF-8"), raw("F48FBFBF80"))
    text = tables.text_of(content)
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(tables.bytes_of(F.regexp_replace(F.regexp_replace(text, "the ", "THE "), "src", "from"))).alias("edited_md5"))


@_q("""WITH e AS (SELECT user_id % 997 AS k, arg_max(event_type, event_id) AS op, max(event_id) AS at, arg_max(value, event_id) AS v FROM events GROUP BY 1)
SELECT c_custkey AS key, c_acctbal AS value, NULL AS change FROM customer WHERE c_custkey NOT IN (SELECT k FROM e)
UNION ALL SELECT k, v, CASE WHEN c_custkey IS NULL THEN 'added' WHEN c_acctbal != v THEN 'changed' END FROM e LEFT JOIN customer ON c_custkey = k WHERE op != 'error'
UNION ALL SELECT k, NULL, 'removed' FROM e JOIN customer ON c_custkey = k WHERE op = 'error'""")
def replayed_changes(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    log = _t(spark, sf_dir, "events").select((F.col("user_id") % 997).alias("key"), "value", "event_id", F.when(F.col("event_type") == "error", "remove").otherwise("set").alias("op"))
    after = tables.replayed(base, log, ["key"], "event_id")
    return after.join(tables.differing(base, after, ["key"]), "key", "full").select("key", "value", "change")


@_q("""WITH m AS (SELECT user_id AS tag, ts, event_id, event_type = 'purchase' AS stop FROM events), p AS (SELECT *, lag(ts) OVER w AS before, lag(stop) OVER w AS stopped FROM m WINDOW w AS (PARTITION BY tag ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR stopped OR ts - before >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY tag ORDER BY ts, event_id) AS g FROM p)
SELECT tag::VARCHAR AS tag, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS parts, CASE WHEN bool_or(stop) THEN 'sentinel' ELSE 'quiet' END AS ended FROM g GROUP BY tag, g""")
def ended_replies(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("tag"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("response"))
    # A deadline beyond the data: SQL can say the quiet period and the sentinel; deadlines are tested against the stream.
    found = messages.ended_replies(e, "purchase", quiet_ms=7_200_000, deadline_ms=10**12)
    return found.select("tag", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "parts", "ended")
