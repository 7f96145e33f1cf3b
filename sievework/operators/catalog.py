"""Joins between a matrix of replacements, an index of documented names, rules and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.relational import bounded
from sievework.operators.worklist import bare, symbol_tokens

# Names so common that a hit says little, by form.
NOISY_MEMBERS = "append insert remove count value close open text name type reset lookup column".split()
NOISY_GLOBALS = "line text mid left right split join volume date format str val screen rectangle oval separator control window application".split()
# What begins a pattern that looks for a member: an escaped dot, or one looked behind for.
MEMBER_STARTS = (r"\.", r"(?<=\.)")
# Words between a notice and its release, and what ends a replacement's name in prose.
LINKING = ["in", "version"]
LEFTOVERS = ["]]", "}", "<ShowIf", "(above)", "(below)", "/api/", "/doc/"]
#: Characters between a notice and the word that names its replacement, at most.
NEAR = 120


def joinable(name: Column) -> Column:
    """A symbol without signature and page-title decoration."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?s)\(.*", "")), r" \(deprecated\)$", ""))


def first_head(text: Column) -> Column:
    """The first symbol-shaped token of a replacement, emphasis, article and alternatives left out."""
    x = F.regexp_replace(F.trim(F.regexp_replace(text, r"[*`]", "")), r"^the\s+", "")
    x = F.regexp_extract(x, r"(?s)^(.*?)(?:\s+(?:or|and)\s+|\s*/\s*|$)", 1)
    return F.trim(F.regexp_extract(x, r"^[^(\s]*", 0), F.lit("."))


def same_replacement(ours: Column, theirs: Column) -> Column:
    """Whether two replacements differ in wording only: equal heads, one an owner of the other, or one the member of the other."""
    a, b = first_head(ours), first_head(theirs)
    tail = lambda x: F.regexp_extract(x, r"([^.]*)$", 1)
    return (a == b) | F.startswith(a, F.concat(b, F.lit("."))) | F.startswith(b, F.concat(a, F.lit("."))) | (tail(a) == b) | (tail(b) == a)


def flagged_members(members: DataFrame, summary: DataFrame) -> DataFrame:
    """members(page, anchor, kind, flags) with kind and flags of the page's summary table where it lists the anchor."""
    s = summary.select("page", "anchor", F.nullif("kind", F.lit("")).alias("_k"), F.col("flags").alias("_f"))
    met = members.join(s, ["page", "anchor"], "left")
    return met.withColumn("kind", F.coalesce("_k", "kind")).withColumn("flags", F.coalesce("_f", "flags")).drop("_k", "_f")


def with_replacements(members: DataFrame, pages: DataFrame, own: DataFrame) -> DataFrame:
    """members(qualified, page, replacement, since) with the most precise notice: of their own page in own(qualified, ...), else their own text, else that of their class page."""
    o = own.select("qualified", F.col("replacement").alias("_or"), F.col("since").alias("_os")).filter("_or != ''")
    p = pages.select("page", F.col("replacement").alias("_pr"), F.col("since").alias("_ps"))
    met = members.join(o, "qualified", "left").join(bounded(p), "page", "left")
    blank = F.coalesce("replacement", F.lit("")) == ""
    source = F.when(F.col("_or").isNotNull(), "page").when(~blank, "text").when(F.coalesce("_pr", F.lit("")) != "", "class").otherwise("none")
    since = F.when(F.col("_or").isNotNull(), F.col("_os")).when(~blank, F.col("since")).otherwise(F.coalesce(F.nullif("since", F.lit("")), "_ps"))
    return met.withColumns({"source": source, "since": since, "replacement": F.when(F.col("_or").isNotNull(), F.col("_or")).when(~blank, F.col("replacement")).otherwise(F.col("_pr"))}).drop("_or", "_os", "_pr", "_ps")


def backfilled(rows: DataFrame, banners: DataFrame, tables: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value from the banner, or else the table, of their key where they have none; filled says whether."""
    clean = lambda c: F.nullif(F.rtrim(F.trim(c), F.lit(".")), F.lit(""))
    b = banners.select(key, clean(F.col(value)).alias("_b"))
    t = tables.select(key, clean(F.col(value)).alias("_t"))
    met = rows.withColumn(value, clean(F.col(value))).join(b, key, "left").join(t, key, "left")
    return met.withColumn("filled", F.col(value).isNull() & F.coalesce("_b", "_t").isNotNull()).withColumn(value, F.coalesce(value, "_b", "_t")).drop("_b", "_t")


def disagreements(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, ours, theirs) where both record a replacement and they differ in more than wording."""
    clean = lambda c: F.replace(F.lower(joinable(F.col(c))), F.lit("—"), F.lit(""))
    met = ours.select(key, clean("replacement").alias("ours")).join(theirs.select(key, clean("replacement").alias("theirs")), key)
    return met.filter((F.col("ours") != "") & (F.col("theirs") != "") & ~same_replacement(F.col("ours"), F.col("theirs")))


def candidates(index: DataFrame, matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """Deprecated members in index(name, flags, path) that matrix(old) lacks: qualified, of no other platform, and of no deprecated class in classes(name)."""
    low = F.lower(joinable(F.col("name")))
    named = index.filter(F.contains("flags", F.lit("deprecated"))).withColumn("_low", low)
    named = named.filter(F.contains("_low", F.lit(".")) & ~F.contains("_low", F.lit(" ")) & ~F.col("path").rlike("/(ios|mobile|web|android)/"))
    known = matrix.select(F.lower(joinable(F.col("old"))).alias("_low")).distinct()
    owners = classes.select(F.lower(joinable(F.col("name"))).alias("_owner")).distinct()
    return named.join(known, "_low", "left_anti").withColumn("_owner", F.split_part("_low", F.lit("."), F.lit(1))).join(owners, "_owner", "left_anti").select(index.columns)


def missing_companions(references: DataFrame, listing: DataFrame, folder: str, name: str) -> DataFrame:
    """References (folder, name) that the listing, beside the manifest, does not have, without case."""
    have = listing.select(folder, F.lower(name).alias("_low")).distinct()
    return references.withColumn("_low", F.lower(name)).join(have, [folder, "_low"], "left_anti").drop("_low")


def documented(rows: DataFrame, replacement: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose replacement names a documented member first."""
    head = F.lower(F.split_part(joinable(F.col(replacement)), F.lit(" "), F.lit(1)))
    return rows.withColumn("_low", head).join(members.select(F.lower(joinable(F.col(member))).alias("_low")).distinct(), "_low", "left_semi").select(rows.columns)


def rule_only_members(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, rule_id): members that rules(rule_id, find) search for and patterns(key) lacks; the first rule of each stands for it."""
    find = F.regexp_replace("find", r"^\(\?i\)", "")
    rest = F.coalesce(*[F.when(F.startswith(find, F.lit(x)), F.substring(find, len(x) + 1, 1 << 20)) for x in MEMBER_STARTS], F.lit(""))
    member = F.regexp_extract(rest, r"^[A-Za-z_]\w*", 0)
    named = rules.withColumn("_m", member).filter("_m != ''").withColumn("key", F.concat(F.lit("."), F.lower("_m")))
    return named.groupBy("key").agg(F.min("rule_id").alias("rule_id")).join(patterns.select("key").distinct(), "key", "left_anti")


def rules_of_symbols(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """(symbol, rule_id, by): rules of a symbol under its whole name, or under its last component if none is under the whole."""
    tokens = rules.select("rule_id", F.explode(symbol_tokens(F.col("name"), F.col("old"))).alias("_t"))
    whole = symbols.select("symbol", F.lower("symbol").alias("_t")).join(bounded(tokens), "_t").select("symbol", "rule_id", F.lit("whole").alias("by")).distinct()
    rest = symbols.join(whole.select("symbol").distinct(), "symbol", "left_anti")
    part = rest.select("symbol", bare(F.col("symbol")).alias("_t")).join(bounded(tokens), "_t").select("symbol", "rule_id", F.lit("leaf").alias("by")).distinct()
    return whole.unionByName(part)


def noisy(name: Column, member: Column) -> Column:
    """Whether a symbol's name is too common for its hits to mean much."""
    return F.when(member, F.lower(name).isin(NOISY_MEMBERS)).otherwise(F.lower(name).isin(NOISY_GLOBALS))


def suspect(value: Column) -> Column:
    """Whether a replacement holds markup, or a second sentence."""
    return value.rlike(r"[\[\]{}<>]|\. ")


def under(df: DataFrame, path: str, prefixes: list[str]) -> DataFrame:
    """Rows whose path is one of the prefixes or lies below it; all rows if there is no prefix."""
    keep = F.lit(not prefixes)
    for p in prefixes:
        keep |= F.startswith(F.col(path), F.lit(p))
    return df.filter(keep)


def only(df: DataFrame, name: str, names: list[str]) -> DataFrame:
    """Rows with one of the names, without case."""
    return df.filter(F.lower(name).isin([n.lower() for n in names]))


def by_severity(df: DataFrame, severity: str, wanted: str, notices: bool = True) -> DataFrame:
    """errors, warnings or all; notices only where asked for."""
    kept = df if wanted == "all" else df.filter(F.col(severity) == wanted.removesuffix("s"))
    return kept if notices else kept.filter(F.col(severity) != "notice")


def in_scope(matrix: DataFrame, excluded: list[str], keywords: list[str], namespace: str) -> DataFrame:
    """Rows of no excluded category, not in the old namespace and not named by a keyword."""
    return matrix.filter(~F.col("cat").isin(excluded) & ~F.startswith("old", F.lit(f"{namespace}.")) & ~bare(F.col("old")).isin(keywords))


def grouped_members(members: DataFrame, page: str, kind: str, name: str, kinds: list[str]) -> DataFrame:
    """Members with the place of their kind in a fixed order, unknown kinds last, and their place within it."""
    place = F.coalesce(*[F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(len(kinds)))
    return members.withColumn("kind_place", place).withColumn("place", F.row_number().over(Window.partitionBy(page, "kind_place", kind).orderBy(F.lower(name), name)))


def shape_problems(matrix: DataFrame, buckets: list[str]) -> DataFrame:
    """(old, code): rows of the matrix without a name, of no known bucket, with a malformed release or markup, or repeating a name and kind."""
    since = F.coalesce("since", F.lit(""))
    codes = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("old"), F.lit("")) == "", "no-name"),
            F.when(~F.coalesce(F.col("cat").isin(buckets), F.lit(False)), "bucket"),
            F.when((since != "") & ~since.rlike(r"^\d{4}r\d+(\.\d+)?$"), "release"),
            F.when(suspect(F.coalesce("new", F.lit(""))), "markup"),
        )
    )
    own = matrix.select("old", F.explode(codes).alias("code"))
    keys = [F.lower("old").alias("_k"), F.col("kind").alias("_kind")]
    again = matrix.groupBy(*keys).agg(F.min("old").alias("old"), F.count("*").alias("_n")).filter("_n > 1")
    return own.unionByName(again.select("old", F.lit("repeated").alias("code")))


def selected_rules(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(place, rule_id) with status: run, locate-only (its empty replacement would delete the text) or unknown."""
    met = wanted.join(rules.select("rule_id", "applies"), "rule_id", "left")
    return met.select("place", "rule_id", F.when(F.col("applies").isNull(), "unknown").when(~F.col("applies"), "locate-only").otherwise("run").alias("status"))


def lookup(matrix: DataFrame, query: str) -> DataFrame:
    """Rows of the matrix whose symbol holds the query; how says exact, leaf or part."""
    q = query.lower().lstrip(".")
    whole = F.lower(F.regexp_replace("old", r"(?s)\(.*", ""))
    how = F.when(whole == q, "exact").when(F.regexp_extract(whole, r"([^.]*)$", 1) == q, "leaf").when(F.contains(whole, F.lit(q)), "part")
    return matrix.withColumn("how", how).filter("how is not null")


def rules_by_symbol(rules: DataFrame, query: str) -> DataFrame:
    """Rules(name, old) that convert the symbol: it is a name on their deprecated side, whole or as last component."""
    return rules.filter(F.array_contains(symbol_tokens(F.col("name"), F.col("old")), query.lower().lstrip(".")))


def rules_where(rules: DataFrame, rule_id: str | None = None, category: str | None = None, tier: str | None = None) -> DataFrame:
    """Rules of an id, a category and a tier, each without case and only where asked for; manual-only is the tier manual."""
    low = lambda c: F.lower(F.col(c))
    found = rules
    for column, wanted in (("rule_id", rule_id), ("category", category)):
        found = found if wanted is None else found.filter(low(column) == wanted.lower())
    name = F.regexp_replace(low("conf"), "^manual-only$", "manual")
    return found if tier is None else found.filter(name == tier.lower().replace("manual-only", "manual"))


def with_rule_members(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """patterns(key, pattern) with origin `matrix`, and a row made for each member that only rules search for, with origin the rule's id."""
    only = rule_only_members(rules, patterns)
    made = only.select("key", F.concat(F.lit(r"(?i)\."), F.regexp_replace("key", r"^\.", ""), F.lit(r"\b")).alias("pattern"), F.col("rule_id").cast("string").alias("origin"))
    return patterns.select("key", "pattern", F.lit("matrix").alias("origin")).unionByName(made)


def documented_rows(matrix: DataFrame, index: DataFrame) -> DataFrame:
    """matrix(old, kind) with page: the deprecated row of index(name, flags, page) that has its facts, or null.

    Names meet without case, signature and title decoration. An event never joins: methods have the same names. A method prefers
    the page "<name> Method"; other rows find such a page under the bare name too, after a page of their own name. Of equals the
    least page counts.
    """
    clean = lambda c: F.lower(joinable(F.col(c)))
    named = index.filter(F.contains("flags", F.lit("deprecated"))).select(clean("name").alias("_n"), "page").filter("_n != ''")
    method = F.endswith("_n", F.lit(" method"))
    own = named.select(F.col("_n").alias("_key"), method.alias("_method"), F.lit(0).alias("_rank"), "page")
    bare_ = named.filter(method).select(F.trim(F.regexp_replace("_n", " method$", "")).alias("_key"), F.lit(True).alias("_method"), F.lit(1).alias("_rank"), "page")
    best = own.unionByName(bare_).groupBy("_key").agg(F.min(F.when(F.col("_method"), F.struct("_rank", "page"))).alias("_m"), F.min(F.struct("_rank", "page")).alias("_any"))
    met = matrix.withColumn("_key", clean("old")).join(best, "_key", "left")
    page = F.when(F.col("kind") == "Event", None).when(F.col("kind") == "Method", F.coalesce("_m.page", "_any.page")).otherwise(F.col("_any.page"))
    return met.select(*matrix.columns, page.alias("page"))


def renamed_classes(matrix: DataFrame) -> DataFrame:
    """(old, new) of the classes that a matrix renames, old lower-cased: undotted rows of the two categories of types; of several the last by row_id counts."""
    new = F.trim(F.coalesce("new", F.lit("")))
    able = matrix.filter(~F.contains("old", F.lit(".")) & F.col("cat").isin("IDE handles", "Source — type") & ~new.isin("", "—"))
    return able.groupBy(F.lower("old").alias("old")).agg(F.max_by(F.split_part(F.split_part(new, F.lit("("), F.lit(1)), F.lit(" "), F.lit(1)), "row_id").alias("new"))


def tier_counts(rules: DataFrame, category: str, conf: str) -> DataFrame:
    """(category, tier, n); manual-only counts as manual."""
    return rules.groupBy(category, F.regexp_replace(conf, "^manual-only$", "manual").alias("tier")).agg(F.count("*").alias("n"))


def deprecated_symbol(stem: Column, title: Column, casing: Column) -> Column:
    """The symbol that a page describes: class from its file's stem, in the casing of the class page, if the title confirms the member; else the title."""
    symbol = F.trim(F.regexp_replace(title, r" \(deprecated\)$", ""))
    cut = F.split_part(stem, F.lit("("), F.lit(1))
    owner, member_low = F.regexp_extract(cut, r"^(.*)\.[^.]*$", 1), F.regexp_extract(cut, r"([^.]*)$", 1)
    member = F.regexp_extract(F.regexp_extract(symbol, r"^[A-Za-z_][A-Za-z0-9_.]*", 0), r"([^.]*)$", 1)
    keep = (owner == "") | (F.lower(symbol) == cut) | (F.lower(member) != member_low) | casing.isNull()
    return F.when(keep, symbol).otherwise(F.concat(casing, F.lit("."), member))


def prose_deprecation(text: Column, product: str = "") -> Column:
    """struct(since, replacement) of a notice in prose; blanks where it has none.

    The paragraph with the notice is found first, and what stands behind the notice in it. The release is the first
    word there that is none of the linking words and not the product's name. The replacement follows a "use" that is near, up to the end of its sentence or
    a turn like "instead"; of a link its text counts, and markup behind the name goes.
    """
    notice = r"\b(?:was|is|has been) (?:deprecated|removed)\b"
    paragraph = F.get(F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: p.rlike(notice)), F.lit(0))
    behind = F.get(F.split(paragraph, notice, 2), F.lit(1))
    word = F.get(F.filter(F.split(behind, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin([*LINKING, product.lower()])), F.lit(0))
    since = F.rtrim(F.regexp_extract(F.coalesce(word, F.lit("")), r"^[0-9][0-9r.]*", 0), F.lit("."))
    asked = F.split(behind, r"\b(?:Please use|Use)\s+", 2)
    said = F.when(F.length(F.get(asked, F.lit(0))) <= NEAR, F.get(asked, F.lit(1)))
    named = F.get(F.split(said, r"\s+(?:as a replacement|in place of|instead)\b|\.(?:\s|$)", 2), F.lit(0))
    named = F.regexp_replace(named, r":[a-z-]+:`([^`<]+)[^`]*`?", "$1")
    for mark in LEFTOVERS:
        named = F.split_part(named, F.lit(mark), F.lit(1))
    named = F.trim(F.regexp_replace(F.coalesce(named, F.lit("")), r"\s+", " "), F.lit("`*> "))
    return F.struct(since.alias("since"), named.alias("replacement"))


def newest_version(path: Column) -> Column:
    """The highest version in a path, as struct(year, release, minor); null if it names none."""
    found = F.regexp_extract_all(path, F.lit(r"(20\d{2}[.rR]\d+(?:\.\d+)?)"), 1)
    part = lambda v, i: F.regexp_extract(v, r"^(\d{4})[.rR](\d+)(?:\.(\d+))?$", i)
    return F.array_max(F.transform(found, lambda v: F.struct(part(v, 1).cast("int").alias("year"), part(v, 2).cast("int").alias("release"), F.coalesce(F.nullif(part(v, 3), F.lit("")).cast("int"), F.lit(0)).alias("minor"))))


def newest_usable(found: DataFrame, path: str, modified: str, usable: str) -> DataFrame:
    """The usable row of the highest version in its path, the latest of equals."""
    return found.filter(F.col(usable)).orderBy(newest_version(F.col(path)).desc_nulls_last(), F.desc(modified), path).limit(1)


def owner_and_member(name: Column) -> Column:
    """struct(owner, member) of a dotted symbol, lower-cased; null if it has no dot."""
    head = F.lower(F.trim(F.regexp_replace(name, r"(?s)\(.*", "")))
    return F.when(F.contains(head, F.lit(".")), F.struct(F.split_part(head, F.lit("."), F.lit(1)).alias("owner"), F.regexp_extract(head, r"([^.]*)$", 1).alias("member")))


def imported_row(owner: str, old: str, target: str, new: str, kind: str) -> list[Column]:
    """Columns of a matrix row made from an imported rename: events and web classes have categories of their own."""
    web = F.startswith(F.lower(owner), F.lit("web")) | F.startswith(F.lower(target), F.lit("web"))
    event = F.col(kind) == "event"
    cat = F.when(web, "Out of scope").when(event, "IDE handles").otherwise("Source — member")
    return [F.concat(owner, F.lit("."), old).alias("old"), F.concat(target, F.lit("."), new).alias("new"), F.when(event, "Event").otherwise("Property").alias("kind"), cat.alias("cat")]


def first_sentence(text: Column) -> Column:
    """Up to the first full stop that ends a sentence; the whole text if there is none."""
    return F.when(F.contains(text, F.lit(". ")), F.concat(F.split_part(text, F.lit(". "), F.lit(1)), F.lit("."))).otherwise(text)


def message_symbol(severity: Column, message: Column) -> Column:
    """The member that a warning calls deprecated or an error calls missing."""
    missing = F.regexp_extract(message, r'(?i)has no member named\s+"?([A-Za-z_]\w*)', 1)
    return F.when((severity == "warning") & F.contains(message, F.lit(" is deprecated")), F.trim(F.split_part(message, F.lit(" is deprecated"), F.lit(1)))).when((severity == "error") & (missing != ""), missing)


def final_newline(text: Column) -> Column:
    """Line endings as LF and one at the end; empty text stays empty."""
    x = F.rtrim(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\n"))
    return F.when(text == "", text).otherwise(F.concat(x, F.lit("\n")))
