"""Queries over the given tables that apply the library's operators, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import segment, symbols
from sievework.operators import relational as R
from sievework.operators import tags, validate
from sievework.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parameters of the queries.
SYMBOLS = ["the", "and", "with", "thing", "est", "der", "que", "una", "les", "mail", "license", "nothere"]
SEVERITY = ["view", "click", "signup", "purchase", "error"]
REWRITES = [("licence", r"(?i)\blicensed under\b", "available under"), ("space", r" {2,}", " "), ("the", r"\bthe ([a-z]+)\b", "$1"), ("dots", r"\.\.+", ".")]


def _q(sql: str | None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = ", ".join(f"('{s}')" for s in SYMBOLS)
_RANK = "list_position(['" + "','".join(SEVERITY) + "'], event_type)"


@_q(f"""WITH s(symbol) AS (VALUES {_WORDS}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS symbol FROM documents)
SELECT symbol, count(*) AS hits, count(DISTINCT doc_id) AS texts FROM t JOIN s USING (symbol) GROUP BY symbol""")
def symbol_counts(spark, sf_dir):
    wanted = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    return R.symbol_counts(_t(spark, sf_dir, "documents"), wanted, "text", "doc_id")


@_q("""WITH p(pattern_id, token, pattern) AS (VALUES (1, 'the', '(?i)the [a-z]+'), (2, 'mail', '(?i)mail[0-9]'), (3, 'under', '(?i)licensed under'), (4, 'der', '(?i)der die')),
h AS (SELECT doc_id, pattern_id, len(regexp_extract_all(text, pattern)) AS raw FROM documents, p WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), token))
SELECT pattern_id, count(*) AS texts, sum(raw)::BIGINT AS hits FROM h WHERE raw > 0 GROUP BY pattern_id""")
def pattern_candidates(spark, sf_dir):
    patterns = spark.createDataFrame([(1, "the", "(?i)the [a-z]+"), (2, "mail", "(?i)mail[0-9]"), (3, "under", "(?i)licensed under"), (4, "der", "(?i)der die")], "pattern_id int, token string, pattern string")
    hits = R.candidate_patterns(_t(spark, sf_dir, "documents"), patterns, "doc_id", "text")
    return hits.groupBy("pattern_id").agg(F.count("*").alias("texts"), F.sum("raw").cast("long").alias("hits"))


@_q(f"""SELECT user_id, list_extract(['{"','".join(SEVERITY[::-1])}'], min(6 - {_RANK})::INT) AS bucket, count(DISTINCT event_type) > 1 AS mixed, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS buckets FROM events GROUP BY user_id""")
def bucket_pick(spark, sf_dir):
    return R.first_bucket(_t(spark, sf_dir, "events"), ["user_id"], "event_type", SEVERITY[::-1])


@_q("""SELECT token, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token ORDER BY hits DESC, token LIMIT 10""")
def noisy_tokens_topk(spark, sf_dir):
    return R.top_tokens(_t(spark, sf_dir, "documents"), "text", 10)


@_q("""SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def first_wins_dedupe(spark, sf_dir):
    return R.first_wins(_t(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["value"])


@_q("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def last_listing(spark, sf_dir):
    return R.last_wins(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type"])


@_q("""SELECT l_orderkey, l_linenumber, f AS first_l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS n, first_value(l_linenumber) OVER w AS f FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber)) WHERE n > 1""")
def duplicate_ids(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return R.repeated_ids(items, ["l_orderkey", "l_partkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "first_l_linenumber")


@_q("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey != 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def dangling_parent(spark, sf_dir):
    owners = _t(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return R.dangling(_t(spark, sf_dir, "orders"), "o_custkey", owners, "c_custkey").select("o_orderkey", "o_custkey")


@_q("""SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)""")
def orphan_files(spark, sf_dir):
    refs = _t(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    return R.orphans(_t(spark, sf_dir, "part"), "p_partkey", refs, "l_partkey").select("p_partkey", "p_name")


def _runs(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("place", F.floor(F.col("value") / 10))
    return e.filter("ts < timestamp_ntz'2024-01-16'"), e.filter("ts >= timestamp_ntz'2024-01-16'")


_SPLIT = "e AS (SELECT *, floor(value / 10)::BIGINT AS place FROM events), b AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-16'), n AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-16')"


@_q(f"""WITH {_SPLIT} SELECT event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = n.user_id AND b.event_type = n.event_type) THEN 'introduced'
WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = n.user_id AND b.event_type = n.event_type AND b.place = n.place) THEN 'moved' ELSE 'kept' END AS verdict FROM n WHERE event_type = 'error'""")
def regression_diff(spark, sf_dir):
    base, new = _runs(spark, sf_dir)
    return R.regressions(new.filter("event_type = 'error'"), base.filter("event_type = 'error'"), ["user_id", "event_type"], ["place"]).select("event_id", "verdict")


@_q(f"""WITH {_SPLIT}, x AS (SELECT user_id, count(*) AS c FROM b WHERE event_type = 'error' GROUP BY 1), y AS (SELECT user_id, count(*) AS c FROM n WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, coalesce(x.c, 0) AS before, coalesce(y.c, 0) AS after, CASE WHEN coalesce(y.c, 0) = 0 THEN 'cleared' WHEN coalesce(x.c, 0) = 0 THEN 'introduced' ELSE 'remaining' END AS state FROM x FULL JOIN y USING (user_id)""")
def warning_changes(spark, sf_dir):
    base, new = _runs(spark, sf_dir)
    return R.count_changes(new.filter("event_type = 'error'"), base.filter("event_type = 'error'"), "user_id")


@_q(f"""WITH {_SPLIT}, x AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS before FROM b GROUP BY 1),
y AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS after, count(*) FILTER (event_type = 'error' AND value > 60) AS fresh FROM n GROUP BY 1)
SELECT user_id, CASE WHEN fresh > 0 THEN 'STOP' WHEN before = after THEN 'SUSPECT' WHEN after = 0 THEN 'clean' ELSE 'no-new-errors' END AS verdict FROM x JOIN y USING (user_id)""")
def checkpoint_verdict(spark, sf_dir):
    base, new = _runs(spark, sf_dir)
    x = base.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("before"))
    y = new.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("after"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 60)).alias("fresh"))
    return x.join(y, "user_id").select("user_id", R.verdict("after", "fresh", "before", "after").alias("verdict"))


@_q("""WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 100000), l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40),
c AS (SELECT count(*) FILTER (l.k IS NULL) AS left_only, count(*) FILTER (o.k IS NULL) AS right_only, count(*) FILTER (o.k IS NOT NULL AND l.k IS NOT NULL) AS in_both FROM o FULL JOIN l ON o.k = l.k)
SELECT left_only, right_only, in_both, (left_only + right_only)::DOUBLE / greatest(left_only + right_only + in_both, 1) AS share FROM c""")
def symmetric_difference(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"))
    return R.set_difference(o, _t(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("k")), "k")


@_q("""WITH m AS (SELECT DISTINCT p_brand, p_type, p_name AS offered FROM part WHERE p_size <= 2), d AS (SELECT p_partkey, p_brand, p_name FROM part WHERE p_size > 48),
j AS (SELECT p_partkey, p_type, offered, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(offered), ' '))) > 0 AS hit FROM d JOIN m USING (p_brand)),
k AS (SELECT *, bool_or(hit) OVER (PARTITION BY p_partkey) AS confirmed FROM j)
SELECT p_partkey, p_type, offered, confirmed FROM k WHERE hit OR NOT confirmed""")
def keep_all_narrowing(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    matrix = part.filter("p_size <= 2").select("p_brand", "p_type", F.col("p_name").alias("offered")).distinct().withColumn("o", symbols.name_tokens(F.col("offered")))
    diag = part.filter("p_size > 48").select("p_partkey", "p_brand", symbols.name_tokens(F.col("p_name")).alias("w"))
    return R.narrowed(diag, matrix, "p_brand", "p_partkey", "w", "o").select("p_partkey", "p_type", "offered", "confirmed")


@_q("""WITH i AS (SELECT s_suppkey AS target, unnest([substr(s_name, 10) || '@' || s_nationkey, substr(s_name, 10), '@' || s_nationkey]) AS key FROM supplier),
g AS (SELECT key, count(*) AS n, min(target) AS target FROM i GROUP BY key),
r AS (SELECT c_custkey, unnest([0, 1, 2]) AS rank, unnest([substr(c_name, 10) || '@' || c_nationkey, substr(c_name, 10), '@' || c_nationkey]) AS key FROM customer),
b AS (SELECT c_custkey, arg_min(target, rank) FILTER (n = 1) AS target, count(*) FILTER (n = 1) AS one, arg_min(n, rank) FILTER (n > 1) AS many FROM r LEFT JOIN g USING (key) GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN one > 0 THEN 'located' WHEN many IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS resolution, target, CASE WHEN one = 0 THEN many END AS candidates FROM b""")
def priority_key_resolve(spark, sf_dir):
    def keys(name, nation):
        at = F.concat(F.lit("@"), F.col(nation).cast("string"))
        return F.array(F.concat(F.substring(name, 10, 99), at), F.substring(name, 10, 99), at)

    index = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), F.explode(keys("s_name", "s_nationkey")).alias("key"))
    requests = _t(spark, sf_dir, "customer").select("c_custkey", F.posexplode(keys("c_name", "c_nationkey")).alias("rank", "key"))
    return R.resolved(requests, index, "c_custkey")


@_q("""SELECT m.event_id, count(c.ts) AS n_claims, CASE WHEN count(c.ts) > 0 THEN 'trailing' ELSE 'out-of-band' END AS channel
FROM events m LEFT JOIN events c ON c.event_type = 'purchase' AND c.user_id = m.user_id AND m.ts BETWEEN c.ts - INTERVAL 7200 SECOND AND c.ts + INTERVAL 7200 SECOND WHERE m.event_type = 'click' GROUP BY m.event_id""")
def interval_channels(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    pairs = R.interval_pairs(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), "user_id", "ts", 7200)
    return pairs.select("event_id", "n_claims", F.when(F.col("n_claims") > 0, "trailing").otherwise("out-of-band").alias("channel"))


@_q("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3 HOUR THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, k""")
def quiet_sessions(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "3 hours")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return s.drop("session_window")


@_q("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations""")
def forward_fill(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return R.forward_filled(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.length("text")), "asked").select("conv_id", "turn", "asked")


@_q("""SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS "end" FROM conversations WHERE role = 'user'""")
def anchor_slices(spark, sf_dir):
    return R.spans(_t(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn"), ["conv_id"], "turn").select("conv_id", "turn", F.col("end"))


@_q("""WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM m)
SELECT user_id, event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS length FROM r GROUP BY user_id, k, event_type HAVING count(*) > 1""")
def failure_runs(spark, sf_dir):
    return R.runs(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type").filter("length > 1")


@_q(f"""SELECT user_id, arg_max(event_type, ({_RANK}, -event_id)) AS worst, arg_max(event_id, ({_RANK}, -event_id)) AS at FROM events GROUP BY user_id""")
def worst_verdict(spark, sf_dir):
    return R.worst(_t(spark, sf_dir, "events"), ["user_id"], "event_type", SEVERITY, "event_id")


@_q("""SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS warnings, count(*) FILTER (event_type = 'signup') AS script_errors, count(*) FILTER (event_type = 'purchase') AS open_errors,
count(*) FILTER (event_type NOT IN ('click', 'signup', 'purchase')) AS errors FROM events GROUP BY 1""")
def severity_counts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "w").when(F.col("event_type") == "signup", "s").when(F.col("event_type") == "purchase", "o").otherwise("e")
    e = _t(spark, sf_dir, "events").withColumn("kind", kind)
    n = lambda k: F.count_if(F.col("kind") == k)
    return e.groupBy(F.to_date("ts").alias("day")).agg(n("w").alias("warnings"), n("s").alias("script_errors"), n("o").alias("open_errors"), n("e").alias("errors"))


@_q("""WITH r AS (SELECT event_id, trim(regexp_replace(props, '[{}]', '', 'g')) AS row FROM events), k AS (SELECT event_id, row, trim(split_part(row, ':', 1)) AS key, trim(split_part(row, ':', 2)) AS value FROM r)
SELECT event_id, key, TRY_CAST(value AS BIGINT) AS number, CASE WHEN row = '' THEN 'blank' WHEN NOT contains(row, ':') THEN 'malformed' WHEN NOT regexp_matches(key, '^"[a-z]+"$') THEN 'bad-key' WHEN TRY_CAST(value AS BIGINT) IS NULL THEN 'bad-value' ELSE 'ok' END AS status FROM k""")
def manifest_kv_split(spark, sf_dir):
    row = F.trim(F.regexp_replace("props", "[{}]", ""))
    key, value = F.trim(F.split_part(row, F.lit(":"), F.lit(1))), F.trim(F.split_part(row, F.lit(":"), F.lit(2)))
    status = F.when(row == "", "blank").when(~F.contains(row, F.lit(":")), "malformed").when(~key.rlike('^"[a-z]+"$'), "bad-key").when(value.try_cast("long").isNull(), "bad-value").otherwise("ok")
    return _t(spark, sf_dir, "events").select("event_id", key.alias("key"), value.try_cast("long").alias("number"), status.alias("status"))


@_q("""WITH r AS (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m FROM orders) SELECT o_orderkey, (y, q, m) > (1997, 2, 5) AS after_target FROM r""")
def release_compare(spark, sf_dir):
    text = F.concat_ws("", F.year("o_orderdate"), F.lit("r"), F.quarter("o_orderdate"), F.lit("."), F.month("o_orderdate"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", (symbols.release(text) > symbols.release(F.lit("1997r2.5"))).alias("after_target"))


@_q("""SELECT page_id, length(html) AS n_chars, coalesce(list_sum(list_transform(regexp_extract_all(html, '"([^"\\n]*)"', 1), lambda s: length(s))), 0)::INT AS literal_chars FROM pages""")
def literal_share(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n_chars"), segment.literal_chars(F.col("html")).alias("literal_chars"))


@_q("""SELECT p_partkey, md5('a = "' || repeat(' ', length(p_name)::INT) || '" + f("", "' || repeat(' ', 5) || '") ' || repeat(' ', length(p_type)::INT + 3) || chr(10) || repeat(' ', length(p_name)::INT + 6) || chr(10) || p_brand || ' "' || repeat(' ', length(p_name)::INT)) AS masked_md5 FROM part""")
def mask_literals(spark, sf_dir):
    text = F.concat(F.lit('a = "'), "p_name", F.lit('" + f("", "it\'s/") // '), "p_type", F.lit('\n  Rem '), "p_name", F.lit("\n"), "p_brand", F.lit(' "'), "p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", F.md5(segment.code_only(text)).alias("masked_md5"))


@_q(None)
def tag_stack_check(spark, sf_dir):
    return tags.problems(_t(spark, sf_dir, "pages"), "page_id", "html")


def _sql_rewrite() -> str:
    cte, prev = [], "(SELECT doc_id, text FROM documents)"
    keep: list[str] = []
    for i, (rule, pattern, to) in enumerate(REWRITES):
        cols = ", ".join(["doc_id", *keep])
        cte.append(f"""s{i} AS (SELECT {cols}, len(regexp_extract_all(text, '{pattern}'))::INT AS n_{rule}, regexp_replace(text, '{pattern}', '{to.replace("$1", chr(92) + "1")}', 'g') AS text FROM {prev})""")
        keep.append(f"n_{rule}")
        prev = f"s{i}"
    return f"WITH {', '.join(cte)} SELECT doc_id, {', '.join(keep)}, md5(text) AS text_md5 FROM {prev}"


@_q(_sql_rewrite())
def rewrite_rules(spark, sf_dir):
    out = R.rewritten(_t(spark, sf_dir, "documents"), "text", REWRITES)
    return out.select("doc_id", *[f"n_{r}" for r, _, _ in REWRITES], F.md5("text").alias("text_md5"))


@_q("""WITH t AS (SELECT n_name, n_comment FROM (SELECT n_name, r_name AS n_comment FROM nation JOIN region ON n_regionkey = r_regionkey)), o AS (SELECT DISTINCT 'NATION_' || (c_nationkey * 3) AS k, CASE WHEN c_nationkey % 2 = 0 THEN 'override' ELSE '' END AS v FROM customer)
SELECT coalesce(n_name, k) AS n_name, CASE WHEN (v IS NOT NULL AND v != '') OR n_name IS NULL THEN v ELSE n_comment END AS note, CASE WHEN n_name IS NULL THEN 'appended' WHEN v IS NOT NULL AND v != '' THEN 'override' ELSE 'base' END AS origin FROM t FULL JOIN o ON n_name = k""")
def override_merge(spark, sf_dir):
    base = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("note"))
    overrides = _t(spark, sf_dir, "customer").select(F.concat(F.lit("NATION_"), (F.col("c_nationkey") * 3).cast("string")).alias("n_name"), F.when(F.col("c_nationkey") % 2 == 0, "override").otherwise("").alias("note")).distinct()
    return R.overridden(base, overrides, "n_name", "note")


@_q("""SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) THEN EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 8000 AND s_nationkey = c_nationkey AND s_suppkey % 100 = c_custkey % 100) END AS listed FROM customer""")
def three_valued_membership(spark, sf_dir):
    known = _t(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") % 100).alias("m"))
    return R.membership(_t(spark, sf_dir, "customer").withColumn("m", F.col("c_custkey") % 100), "c_nationkey", "m", known).select("c_custkey", "c_nationkey", "listed")


@_q("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS note FROM orders), s AS (SELECT l_orderkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
SELECT o_orderkey, coalesce(note, v) AS note, CASE WHEN note IS NOT NULL THEN 'kept' WHEN v IS NOT NULL THEN 'filled' ELSE 'rejected' END AS action FROM r LEFT JOIN s ON k = o_orderkey""")
def fill_or_reject(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("note"))
    source = _t(spark, sf_dir, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("note"))
    return R.filled(rows, source, ["o_orderkey"], "note")


@_q("""SELECT p_brand, p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_type = 'ECONOMY') DESC, p_size DESC, p_partkey) AS n FROM part) WHERE n = 1""")
def preference_pick(spark, sf_dir):
    order = [(F.col("p_type") == "ECONOMY").desc(), F.desc("p_size"), F.col("p_partkey")]
    return R.preferred(_t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_type", "p_size"), ["p_brand"], order).drop("p_size")


@_q("""WITH c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), s AS (SELECT s_suppkey * 7 AS k, s_acctbal AS v FROM supplier) SELECT * FROM s UNION ALL SELECT * FROM c WHERE k NOT IN (SELECT k FROM s)""")
def keyed_upsert(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return tables.upsert(base, _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("k"), F.col("s_acctbal").alias("v")), ["k"])


@_q("""SELECT p_type, count(*) FILTER (p_size <= 10) AS high, count(*) FILTER (p_size > 10 AND p_size <= 30) AS medium, count(*) FILTER (p_size > 30) AS low FROM part GROUP BY p_type""")
def tier_pivot(spark, sf_dir):
    tier = F.when(F.col("p_size") <= 10, "high").when(F.col("p_size") <= 30, "medium").otherwise("low")
    return _t(spark, sf_dir, "part").groupBy("p_type").agg(*[F.count_if(tier == t).alias(t) for t in ("high", "medium", "low")])


@_q("""SELECT 'error' AS kind, event_id AS id, event_type AS name FROM events WHERE event_type = 'error' UNION ALL SELECT 'turn', conv_id * 1000 + turn, role FROM conversations""")
def tagged_union(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit("error").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    c = _t(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("name"))
    return e.unionByName(c)


@_q("""SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE contains(lower(line), 'licen')""")
def logical_lines(spark, sf_dir):
    rows = tables.line_rows(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.filter(F.contains(F.lower("line"), F.lit("licen"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@_q("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE NOT starts_with(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1), '/fr/')""")
def page_index(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"://[^/?#]*(/[^?#]*)", 1)
    return p.filter(~F.startswith(path, F.lit("/fr/"))).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


@_q("""SELECT doc_id, md5(regexp_replace(regexp_replace('a' || chr(27) || '[1;31m' || text || chr(8238) || chr(8295) || chr(13), '\\x1B\\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\x{202A}-\\x{202E}]', chr(65533), 'g')) AS safe_md5, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS collapsed_md5 FROM documents""")
def safe_and_collapsed(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(symbols.terminal_safe(F.concat(F.lit("a\x1b[1;31m"), "text", F.lit("\u202e\u2067\r")))).alias("safe_md5"), F.md5(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "))).alias("collapsed_md5"))


@_q("""SELECT doc_id, 'no-final-newline' AS code, 'notice' AS severity, 0 AS line_no FROM documents WHERE length(text) > 0 AND NOT ends_with(text, chr(10))
UNION ALL SELECT doc_id, 'merge-marker', 'error', i::INT FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '^(<{7}|={7}|>{7})( |$)')""")
def text_checks(spark, sf_dir):
    return validate.text_problems(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@_q("""WITH p AS (SELECT p_brand, p_partkey, p_partkey // 3 AS id, p_size * 4 AS parent, p_partkey % 17 = 0 AS bad FROM part), g AS (SELECT * FROM p WHERE NOT bad),
d AS (SELECT *, row_number() OVER w AS n, first_value(p_partkey) OVER w AS f FROM g WINDOW w AS (PARTITION BY p_brand, id ORDER BY p_partkey))
SELECT p_brand, p_partkey, 'malformed' AS code, NULL::VARCHAR AS note FROM p WHERE bad UNION ALL SELECT p_brand, p_partkey, 'duplicate-id', f::VARCHAR FROM d WHERE n > 1
UNION ALL SELECT p_brand, p_partkey, 'dangling-parent', parent::VARCHAR FROM g WHERE parent != 0 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.p_brand = g.p_brand AND h.id = g.parent)""")
def manifest_checks(spark, sf_dir):
    line = F.concat_ws(";", F.col("p_name"), F.col("p_type"), F.concat(F.lit("&h"), F.hex(F.floor(F.col("p_partkey") / 3))), F.when(F.col("p_partkey") % 17 == 0, "none").otherwise(F.concat(F.lit("&h"), F.hex(F.col("p_size") * 4))), F.lit("true"))
    return validate.manifest_problems(_t(spark, sf_dir, "part").select("p_brand", "p_partkey", line.alias("line")), "p_brand", "p_partkey", "line")


@_q("""WITH u AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+\\.[a-z]+')) AS x FROM documents), s AS (SELECT doc_id, split_part(x, '.', 1) AS receiver, split_part(x, '.', 2) AS member FROM u)
SELECT doc_id, receiver, member, CASE WHEN receiver = 'mail8' AND member = 'example' THEN 'qualified' ELSE 'leaf' END AS matched FROM s WHERE (receiver = 'mail8' AND member = 'example') OR member = 'com'""")
def deprecated_uses(spark, sf_dir):
    index = spark.createDataFrame([("mail8", "example"), (None, "com")], "receiver string, member string")
    return R.dotted_uses(_t(spark, sf_dir, "documents"), index, "doc_id", "text")


@_q("""WITH d AS (SELECT DISTINCT p_brand AS name, p_type AS place FROM part WHERE p_size <= 3), u AS (SELECT p_partkey, p_brand AS name, p_type AS place FROM part WHERE p_size > 45)
SELECT p_partkey, name, place FROM u WHERE name IN (SELECT name FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.name = u.name AND d.place = u.place)""")
def declared_elsewhere(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("name"), F.col("p_type").alias("place"))
    return R.used_elsewhere(part.filter("p_size > 45").drop("p_size"), part.filter("p_size <= 3"), "name", "place").select("p_partkey", "name", "place")
