"""Joins, groupings and order-dependent operators behind inventories, worklists, checkpoints and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only after a count has shown that it has at most this many rows.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if len(df.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS else df


def symbol_counts(texts: DataFrame, symbols: DataFrame, text: str, key: str) -> DataFrame:
    """(symbol, hits, texts) of the symbols that occur as tokens. Tokens are counted within each text first."""
    tokens = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)).alias("symbol"))
    found = tokens.join(bounded(symbols.select("symbol").distinct()), "symbol").groupBy(key, "symbol").agg(F.count("*").alias("n"))
    return found.groupBy("symbol").agg(F.sum("n").alias("hits"), F.count("*").alias("texts"))


def candidate_patterns(texts: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern_id, raw): matches of each pattern, tried only where its token occurs in the text."""
    tokens = texts.select(key, text, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0))).alias("token"))
    met = tokens.join(bounded(patterns), "token")
    return met.select(key, "pattern_id", F.regexp_count(F.col(text), F.col("pattern")).alias("raw")).filter("raw > 0")


def first_bucket(df: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Per key the first bucket of `order` that is present ('?' if none), whether several are, and which."""
    rank = F.coalesce(*[F.when(F.col(bucket) == b, F.lit(i)) for i, b in enumerate(order)], F.lit(len(order)))
    g = df.groupBy(*keys).agg(F.min(rank).alias("_r"), F.sort_array(F.collect_set(bucket)).alias("_all"))
    pick = F.coalesce(F.get(F.array(*map(F.lit, order)), F.col("_r")), F.lit("?"))
    return g.select(*keys, pick.alias("bucket"), (F.size("_all") > 1).alias("mixed"), F.array_join("_all", ",").alias("buckets"))


def top_tokens(texts: DataFrame, text: str, n: int) -> DataFrame:
    tokens = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "token").limit(n)


def first_wins(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The first row by `order` of each key, by a minimum, so that partial results combine before the shuffle."""
    return df.groupBy(*keys).agg(F.min(F.struct(order, *values)).alias("_f")).select(*keys, "_f.*")


def last_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_f")).select(*keys, "_f.*")


def repeated_ids(df: DataFrame, ids: list[str], order: str) -> DataFrame:
    """Each second or later row of an id, with the first one's place in first_<order>."""
    w = Window.partitionBy(*ids).orderBy(order)
    seen = df.withColumn("_n", F.row_number().over(w)).withColumn(f"first_{order}", F.first(order).over(w))
    return seen.filter("_n > 1").drop("_n")


def dangling(df: DataFrame, parent: str, owners: DataFrame, owner: str, none: int = 0) -> DataFrame:
    """Rows whose parent is not `none` and is not among the owners."""
    known = owners.select(F.col(owner).alias(parent)).distinct()
    return df.filter(F.col(parent) != none).join(known, parent, "left_anti").select(df.columns)


def orphans(items: DataFrame, key: str, references: DataFrame, reference: str) -> DataFrame:
    """Items that nothing refers to; none if there is no reference at all."""
    some = references.agg((F.count(F.lit(1)) > 0).alias("_some")).filter("_some").select()  # one row, or none
    return items.join(references.select(F.col(reference).alias(key)).distinct(), key, "left_anti").select(items.columns).crossJoin(F.broadcast(some))


def regressions(new: DataFrame, base: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """New rows by verdict: `introduced` if the baseline lacks the key, `moved` if it has the key but not at that place."""
    named = lambda columns: F.to_json(F.struct(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(columns)]))  # noqa: E731  nulls equal nulls
    keys = base.select(named(key).alias("_k")).distinct().withColumn("_key", F.lit(True))
    places = base.select(named(key + place).alias("_p")).distinct().withColumn("_place", F.lit(True))
    seen = new.withColumn("_k", named(key)).withColumn("_p", named(key + place)).join(keys, "_k", "left").join(places, "_p", "left")
    return seen.withColumn("verdict", F.when(F.col("_key").isNull(), "introduced").when(F.col("_place").isNull(), "moved").otherwise("kept")).drop("_key", "_place", "_k", "_p")


def count_changes(new: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Per key the counts before and after, and cleared, introduced or remaining."""
    a = base.groupBy(key).agg(F.count("*").alias("before"))
    b = new.groupBy(key).agg(F.count("*").alias("after"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("state", F.when(F.col("after") == 0, "cleared").when(F.col("before") == 0, "introduced").otherwise("remaining"))


def verdict(errors: str, new_errors: str, before: str, after: str) -> Column:
    """STOP if there are new errors; SUSPECT if the run counts what the last one counted; clean without errors; else no-new-errors."""
    return F.when(F.col(new_errors) > 0, "STOP").when(F.col(before) == F.col(after), "SUSPECT").when(F.col(errors) == 0, "clean").otherwise("no-new-errors")


def narrowed(diagnostics: DataFrame, matrix: DataFrame, key: str, diag_id: str, wanted: str, offered: str) -> DataFrame:
    """Rows of the matrix under a diagnostic's key, narrowed to those whose tokens overlap the wanted ones.

    If that leaves none, all rows stay. `confirmed` says which it was.
    """
    met = diagnostics.join(matrix, key).withColumn("_hit", F.arrays_overlap(wanted, offered))
    any_hit = F.max("_hit").over(Window.partitionBy(diag_id))
    return met.withColumn("confirmed", any_hit).filter(F.col("_hit") | ~F.col("confirmed")).drop("_hit")


def resolved(requests: DataFrame, index: DataFrame, request_id: str) -> DataFrame:
    """requests(request_id, rank, key) against index(key, target): the first rank with one target is `located`, else the first with several is `ambiguous`, else `unresolved`.

    The index is counted by key first, so a key with many targets costs each request one row.
    """
    by_key = index.groupBy("key").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    met = requests.join(by_key, "key", "left")
    best = met.groupBy(request_id).agg(F.min(F.when(F.col("n") == 1, F.struct("rank", "target"))).alias("one"), F.min(F.when(F.col("n") > 1, F.struct("rank", "n"))).alias("many"))
    state = F.when(F.col("one").isNotNull(), "located").when(F.col("many").isNotNull(), "ambiguous").otherwise("unresolved")
    return best.select(request_id, state.alias("resolution"), F.col("one.target").alias("target"), F.when(F.col("one").isNull(), F.col("many.n")).alias("candidates"))


def interval_pairs(claims: DataFrame, messages: DataFrame, tag: str, at: str, seconds: int) -> DataFrame:
    """Messages with n_claims, the claims of the same tag within `seconds` of them.

    Time is cut into buckets of that width and claims are copied to the buckets beside their own, so that the join is
    an equality on tag and bucket with a range condition left over.
    """
    unix = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    c = claims.select(tag, F.col(at).alias("claimed_at"), F.explode(F.array(*[F.floor(unix(at) / seconds) + i for i in (-1, 0, 1)])).alias("_bucket"))
    m = messages.withColumn("_bucket", F.floor(unix(at) / seconds)).withColumn("_row", F.monotonically_increasing_id())
    joined = m.join(c.withColumnRenamed(tag, "_tag").select("_tag", "claimed_at", F.col("_bucket").alias("_b")), (F.col("_tag") == F.col(tag)) & (F.col("_b") == F.col("_bucket")) & F.expr(f"{at} between claimed_at - interval {seconds} seconds and claimed_at + interval {seconds} seconds"), "left")
    return joined.groupBy("_row", *messages.columns).agg(F.count("claimed_at").alias("n_claims")).drop("_row")


def forward_filled(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order)))


def spans(df: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Each anchor's slice: from its start up to the next anchor's, null for the last."""
    return df.withColumn("end", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def runs(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Runs of equal state: keys, state, first and last place, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    start = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_start", start).withColumn("_run", F.sum("_start").over(w))
    return marked.groupBy(*keys, "_run", state).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count("*").alias("length")).drop("_run")


def worst(df: DataFrame, keys: list[str], state: str, ranks: list[str], order: str) -> DataFrame:
    """The worst state by rank (later is worse), the earliest of equals."""
    rank = F.coalesce(*[F.when(F.col(state) == s, F.lit(i)) for i, s in enumerate(ranks)], F.lit(-1))
    return df.groupBy(*keys).agg(F.max(F.struct(rank.alias("_r"), (-F.col(order)).alias("_o"), F.col(state).alias("worst"))).alias("_w")).select(*keys, "_w.worst", (-F.col("_w._o")).alias("at"))


def preferred(df: DataFrame, keys: list[str], preference: list[Column]) -> DataFrame:
    """One row of each key: the first by the preference order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*preference))).filter("_n = 1").drop("_n")


def membership(df: DataFrame, owner: str, member: str, known: DataFrame) -> DataFrame:
    """df with listed: null if known(owner, member) has no such owner, else whether it has the pair."""
    owners = known.select(owner).distinct().withColumn("_owner", F.lit(True))
    pairs = known.select(owner, member).distinct().withColumn("_pair", F.lit(True))
    return df.join(owners, owner, "left").join(pairs, [owner, member], "left").withColumn("listed", F.when(F.col("_owner").isNotNull(), F.col("_pair").isNotNull())).drop("_owner", "_pair")


def filled(rows: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows against a source of values: `filled` where rows had none, `kept` where they had one, `rejected` where the source does not know the key."""
    met = rows.join(source.select(*keys, F.col(value).alias("_new")), keys, "left")
    action = F.when(F.col(value).isNotNull(), "kept").when(F.col("_new").isNotNull(), "filled").otherwise("rejected")
    return met.withColumn("action", action).withColumn(value, F.coalesce(value, "_new")).drop("_new")


def overridden(base: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """base with a non-empty override in place of its value; overrides that match nothing are appended. origin says which."""
    o = overrides.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    joined = base.select(key, value).join(o, F.col(key) == F.col("_k"), "full_outer")
    use = F.col("_v").isNotNull() & (F.col("_v") != "")
    origin = F.when(F.col(key).isNull(), "appended").when(use, "override").otherwise("base")
    return joined.select(F.coalesce(key, "_k").alias(key), F.when(use | F.col(key).isNull(), F.col("_v")).otherwise(F.col(value)).alias(value), origin.alias("origin"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are on the left only, on the right only and on both, and the share of the difference."""
    mark = lambda df, c: df.select(key).distinct().withColumn(c, F.lit(1))
    j = mark(left, "l").join(mark(right, "r"), key, "full_outer")
    n = j.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"))
    return n.withColumn("share", (F.col("left_only") + F.col("right_only")) / F.greatest(F.col("left_only") + F.col("right_only") + F.col("in_both"), F.lit(1)))


def different_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): the keys that only one of the two has."""
    mark = lambda df, c: df.select(key).distinct().withColumn(c, F.lit(1))
    met = mark(left, "_l").join(mark(right, "_r"), key, "full_outer").filter(F.col("_l").isNull() | F.col("_r").isNull())
    return met.select(key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def numbered(df: DataFrame, coarse: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in one order over all rows, from 1, without a window over all rows.

    coarse is a prefix of the order whose values are far fewer than the rows: these are counted, and a place is how many rows have smaller
    ones and the row's place among its equals, within which `order` decides.
    """
    keys = [f"_c{i}" for i in range(len(coarse))]
    rows = df.withColumns(dict(zip(keys, coarse, strict=True)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row for each value of the prefix
    base = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [placed[k].eqNullSafe(base[k]) for k in keys]
    joined = placed.join(bounded(base), same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_place")).cast("int").alias(name))


def rewritten(df: DataFrame, text: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """text after rules (id, Java pattern, replacement) in order, each on the result of the one before, with a count of each rule's matches in n_<id>."""
    for rule, pattern, replacement in rules:
        df = df.withColumn(f"n_{rule}", F.regexp_count(F.col(text), F.lit(pattern))).withColumn(text, F.regexp_replace(text, pattern, replacement))
    return df


def dotted_uses(texts: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(key, receiver, member, matched): dotted tokens whose receiver.member is in index(receiver, member), else whose member alone is there without a receiver."""
    tokens = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+\.[a-z]+"), 0))).alias("_use"))
    uses = tokens.select(key, F.split_part("_use", F.lit("."), F.lit(1)).alias("receiver"), F.split_part("_use", F.lit("."), F.lit(2)).alias("member"))
    full = index.filter("receiver is not null").select("receiver", "member").distinct().withColumn("_full", F.lit(True))
    leaf = index.filter("receiver is null").select("member").distinct().withColumn("_leaf", F.lit(True))
    met = uses.join(bounded(full), ["receiver", "member"], "left").join(bounded(leaf), "member", "left")
    return met.withColumn("matched", F.when(F.col("_full"), "qualified").when(F.col("_leaf"), "leaf")).filter("matched is not null").select(key, "receiver", "member", "matched")


def used_elsewhere(uses: DataFrame, declared: DataFrame, name: str, place: str) -> DataFrame:
    """Uses of declared names in places that do not declare them."""
    names = declared.select(name).distinct()
    return uses.join(names, name, "left_semi").join(declared.select(name, place).distinct(), [name, place], "left_anti")
