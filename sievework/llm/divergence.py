"""Source divergence audit over frequent terms, found by iceberg prefix refinement (operator 12).

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z in lower case. A language keeps the terms that at least
`least` of its documents have. They are found from their first bytes on: level by level, a term stands for its prefix
of so many bytes, the documents of each language that have a term with the prefix are counted, and prefixes in fewer
than `least` documents go, with all terms that begin with them, as a longer prefix is in no more documents than a
shorter one. A term shorter than the level's width carries a closing byte, so a surviving prefix that ends with it is
a complete term and is kept. Levels end when no prefix is left open.

Each level is one pass over the texts. Prefixes of up to eight bytes are 64-bit integers, taken from all terms of a batch
at once; longer ones are only made of terms whose eight bytes are still open. A task counts into tables that it hands on
when they are full, so its memory does not depend on the vocabulary. If the prefixes left open by the level before are few
(`shipped`), every task gets them and leaves the rest out; else the counts of all prefixes are joined with them.

Kept terms are counted by language and source in a last pass; a task's counts leave it as arrays over `CHUNK` terms each, which
are added up by language, source and chunk. With V kept terms in a language and N occurrences of
them in a group, a term's share is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), by long division in 64 bits, exact up to
2^53 occurrences. Every term of a language is one row of counts by source, and the distances between all sources of a
language add up over those rows in tasks, a block of `block` sources against all.

A row is a document, so repeated rows and rows with a null doc_id count each. Null text, lang and source are ''. Texts without a
term add none, but their group occurs. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, bounded_broadcast, stored, table

#: Documents of a language that have a kept term; ranks of terms in the result.
LEAST, TOP = 30, 50
#: Bytes of a prefix at each level; after the last, twice as many each time.
WIDTHS = (4, 8, 16)
#: Open prefixes or kept terms that are sent to every task; rows of a task's table of counts.
SHIPPED, TABLE_ROWS = 200_000, 300_000
#: Kept terms of a language whose counts travel in one row.
CHUNK = 4096
#: Closes a complete term; no term has this byte.
CLOSE = b"\0"

_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_TO_TERMS).split() if text else []


def prefix_keys(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of `width` bytes, at most eight, of all terms in order as big-endian integers, closed by zeros; and where each text's begin, and the end."""
    plain = [t.translate(_TO_TERMS) if t else b"" for t in texts]
    # A blank in front of each text and as many behind as a prefix is wide.
    all_ = np.frombuffer(b" " + b" ".join(plain) + b" " * (width + 1), np.uint8)
    blank = all_ == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    keys, inside = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    for j in range(width):
        byte = all_[starts + j]
        inside &= byte != 32
        keys = (keys << np.uint64(8)) | np.where(inside, byte, 0).astype(np.uint64)
    begins = np.cumsum([1] + [len(t) + 1 for t in plain])
    return keys, np.searchsorted(starts, begins)


def _sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class _Sums:
    """Counts by sorted 64-bit keys, added up in runs."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.rows = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.rows += len(keys)
        if self.rows > TABLE_ROWS:
            k, n = self.merged()
            self.keys, self.counts, self.rows = [k], [n], len(k)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty("lang").alias("lang"), empty("source").alias("source"), F.col("text").cast("binary").alias("text"))


def _shipped(rows: DataFrame, name: str, most: int) -> dict[str, set[bytes]] | None:
    """The values of column `name` by language, if there are at most `most`; else None."""
    found = rows.select("lang", name).take(most + 1)
    if len(found) > most:
        return None
    by_lang: dict[str, set[bytes]] = {}
    for lang, value in found:
        by_lang.setdefault(lang, set()).add(bytes(value))
    return by_lang


def _short_prefixes(texts: DataFrame, width: int, before: int, sent: dict[str, set[bytes]] | None) -> DataFrame:
    """(lang, prefix, n): how many of a task's texts have a term with each prefix of at most eight bytes."""
    opened = None if sent is None else {lang: np.sort(np.array([int.from_bytes(p, "big") for p in ps], np.uint64)) for lang, ps in sent.items()}

    def rows(lang: str, sums: _Sums) -> pa.RecordBatch:
        keys, n = sums.merged()
        return pa.record_batch([pa.repeat(lang, len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, _Sums] = {}
        for b in batches(it):
            keys, begins = prefix_keys(b.column(1).to_pylist(), width)
            by_lang: dict[str, list[np.ndarray]] = {}
            for i, lang in enumerate(b.column(0).to_pylist()):
                if opened is None or lang in opened:
                    by_lang.setdefault(lang, []).append(_sorted_distinct(keys[begins[i] : begins[i + 1]]))
            for lang, parts in by_lang.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                if before:
                    wanted = (k >> np.uint64(8 * (width - before)) & np.uint64(0xFF)) != 0  # else complete before
                    if opened is not None:
                        wanted &= np.isin(k >> np.uint64(8 * (width - before)), opened[lang])
                    k, n = k[wanted], n[wanted]
                sums.setdefault(lang, _Sums()).add(k, n.astype(np.int64))
            if sum(x.rows for x in sums.values()) > 2 * TABLE_ROWS:
                yield from (rows(lang, x) for lang, x in sums.items())
                sums.clear()
        yield from (rows(lang, x) for lang, x in sums.items())

    found = texts.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return found.select("lang", F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("prefix"), "n").withColumn("prefix", F.substring("prefix", 9 - width, width))


def _long_prefixes(texts: DataFrame, width: int, before: int, sent: dict[str, set[bytes]] | None) -> DataFrame:
    """The same for any width; of terms that the level before left open only."""

    def rows(lang: str, counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.repeat(lang, len(counts)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "prefix", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches(it):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if sent is None:
                    counts.setdefault(lang, Counter()).update({(t + CLOSE)[:width] for t in terms_of(text) if len(t) >= before})
                elif lang in sent:
                    opened = sent[lang]
                    counts.setdefault(lang, Counter()).update({(t + CLOSE)[:width] for t in terms_of(text) if len(t) >= before and t[:before] in opened})
            if sum(map(len, counts.values())) > TABLE_ROWS:
                yield from (rows(lang, x) for lang, x in counts.items())
                counts.clear()
        yield from (rows(lang, x) for lang, x in counts.items())

    return texts.select("lang", "text").mapInArrow(run, "lang string, prefix binary, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def level(texts: DataFrame, width: int, before: int, opened: DataFrame | None, least: int, shipped: int) -> DataFrame:
    """(lang, prefix): the prefixes of `width` bytes, or complete terms closed by zero bytes, in at least `least` documents of the language.

    opened: the open prefixes of `before` bytes, all of them if None.
    """
    sent = None if opened is None else _shipped(opened, "prefix", shipped)
    counted = (_short_prefixes if width <= 8 else _long_prefixes)(texts, width, before, sent)
    found = counted.filter(F.col("n") >= least)
    if opened is not None and sent is None:
        parents = opened.select("lang", F.col("prefix").alias("parent"))
        found = found.withColumn("parent", F.substring("prefix", 1, before)).join(parents, ["lang", "parent"], "left_semi")
    return found.select("lang", "prefix")


def frequent_terms(docs: DataFrame, least: int = LEAST, widths: tuple[int, ...] = WIDTHS, shipped: int = SHIPPED) -> DataFrame:
    """(lang, term as bytes) of the terms in at least `least` documents of a language."""
    texts, kept = _texts(docs), []
    opened, before, width, more = None, 0, widths[0], list(widths[1:])
    while True:
        found = stored(level(texts, width, before, opened, least, shipped), "prefixes")
        closed = F.substring("prefix", -1, 1) == F.lit(CLOSE)
        kept.append(found.filter(closed).select("lang", F.rtrim(F.col("prefix").cast("string"), F.lit("\0")).cast("binary").alias("term")))
        opened = found.filter(~closed)
        if opened.isEmpty():
            break
        before, width = width, more.pop(0) if more else 2 * width
    terms = kept[0]
    for k in kept[1:]:
        terms = terms.unionByName(k)
    return stored(terms, "kept_terms")


def _counts_by_name(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term_counts() for any number of kept terms: all terms are counted and joined with the kept ones."""
    names = ["lang", "source", "term", "n"]

    def rows(group: tuple[str, str], counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.repeat(group[0], len(counts)), pa.repeat(group[1], len(counts)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        for b in batches(it):
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                counts.setdefault((lang, source), Counter()).update(terms_of(text))
            if sum(map(len, counts.values())) > TABLE_ROWS:
                yield from (rows(g, x) for g, x in counts.items())
                counts.clear()
        yield from (rows(g, x) for g, x in counts.items())

    found = texts.mapInArrow(run, "lang string, source string, term binary, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(terms, ["lang", "term"], "left_semi")


def _counts_by_place(texts: DataFrame, sent: dict[str, set[bytes]], chunk: int) -> DataFrame:
    """term_counts() for kept terms that every task has, told by their place among the sorted terms of their language."""
    listed = {lang: sorted(ts) for lang, ts in sent.items()}
    schema = "lang string, source string, chunk int, at array<int>, n array<long>"

    def arrays(group: tuple[str, str], at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(at, np.arange(0, int(at[-1]) + 1 + chunk, chunk)) if len(at) else np.zeros(1, np.int64)
        for c in range(len(edges) - 1):
            some = slice(edges[c], edges[c + 1])
            if len(at[some]):
                yield pa.record_batch([pa.array([group[0]]), pa.array([group[1]]), pa.array([c], pa.int32()), pa.array([at[some].astype(np.int32)]), pa.array([n[some]])], ["lang", "source", "chunk", "at", "n"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {lang: {t: i for i, t in enumerate(ts)} for lang, ts in listed.items()}
        sums: dict[tuple[str, str], np.ndarray] = {}

        def settle(counts: dict[tuple[str, str], Counter]) -> None:
            for g, table_ in counts.items():
                place = places[g[0]]
                kept = [(place[t], n) for t, n in table_.items() if t in place]
                if g not in sums:
                    sums[g] = np.zeros(len(place), np.int64)
                if kept:
                    at, n = np.array(kept, np.int64).T
                    sums[g][at] += n
            counts.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for g, dense in sums.items():
                at = np.flatnonzero(dense)
                yield from arrays(g, at, dense[at])
            sums.clear()

        counts: dict[tuple[str, str], Counter] = {}
        for b in batches(it):
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if lang in places:
                    counts.setdefault((lang, source), Counter()).update(terms_of(text))
            if sum(map(len, counts.values())) > TABLE_ROWS:
                settle(counts)
                if sum(map(len, sums.values())) > 20 * TABLE_ROWS:  # sources may be many
                    yield from out()
        settle(counts)
        yield from out()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, int], np.ndarray] = {}
        for b in it:
            cols = [b.column(i).to_pylist() for i in range(3)]
            at, n = b.column(3), b.column(4)
            for i, key in enumerate(zip(*cols, strict=True)):
                acc = sums.setdefault(key, np.zeros(chunk, np.int64))
                acc[at[i].values.to_numpy() - key[2] * chunk] += n[i].values.to_numpy()
        for (lang, source, c), acc in sums.items():
            at = np.flatnonzero(acc)
            term = [listed[lang][c * chunk + j] for j in at.tolist()]
            yield pa.record_batch([pa.repeat(lang, len(at)), pa.repeat(source, len(at)), pa.array(term, pa.binary()), pa.array(acc[at])], ["lang", "source", "term", "n"])

    return texts.mapInArrow(count, schema).repartition("lang", "source", "chunk").mapInArrow(add, "lang string, source string, term binary, n long")


def term_counts(docs: DataFrame, terms: DataFrame, shipped: int = SHIPPED, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms in each group."""
    sent = _shipped(terms, "term", shipped)
    return _counts_by_name(_texts(docs), terms) if sent is None else _counts_by_place(_texts(docs), sent, chunk)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) by long division, three digits at a time."""
    # A fold, as an expression would write out the part before it twice at every step.
    div = lambda a, b: F.call_function("div", a, b)
    state = lambda q, r: F.named_struct(F.lit("q"), q, F.lit("r"), r)
    step = lambda s, d: state(s["q"] * 1000 + div(s["r"] * 1000, d), (s["r"] * 1000) % d)
    begin = state(div(count, total), count % total)
    return F.aggregate(F.array(total, total, total), begin, step, lambda s: s["q"] + 1)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for arrays: counts by row and source, totals by source."""
    q, r = np.divmod(counts, totals)
    for _ in range(3):
        q2, r = np.divmod(r * 1000, totals)
        q = q * 1000 + q2
    return q + 1


def distances(rows: DataFrame, block: int = 256, cells: int = 1 << 20) -> DataFrame:
    """(lang, a, b, value): summed distances of the shares of sources a and b, by position, over the rows of (lang, items, sizes, v).

    items: (position, count) of the sources that have the term; sizes: occurrences of kept terms in each source.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches(it):
            langs, firsts = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False)
            items, sizes, vs = b.column(2), b.column(3), b.column(4).to_pylist()
            flat, ends = items.flatten(), np.asarray(items.offsets)
            at, n = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            ends = ends - ends[0]
            for lang, first in {(x, int(y)) for x, y in zip(langs, firsts, strict=True)}:
                mine = np.flatnonzero((langs == lang) & (firsts == first))
                size = np.array(sizes[int(mine[0])].as_py(), np.int64)
                totals, s = size + 5 * vs[mine[0]], len(size)
                acc = sums.setdefault((lang, first), np.zeros((min(block, s - first), s), np.int64))
                step = max(1, cells // s)
                for i in range(0, len(mine), step):
                    some = mine[i : i + step]
                    counts = np.zeros((len(some), s), np.int64)
                    for k, row in enumerate(some):
                        counts[k, at[ends[row] : ends[row + 1]]] = n[ends[row] : ends[row + 1]]
                    p = shares(counts + 5, totals)
                    for a in range(len(acc)):
                        acc[a] += np.abs(p - p[:, first + a : first + a + 1]).sum(0)
        for (lang, first), acc in sums.items():
            a, b_ = np.indices(acc.shape)
            yield pa.record_batch([pa.array([lang] * acc.size), pa.array((a + first).ravel()), pa.array(b_.ravel()), pa.array(acc.ravel())], ["lang", "a", "b", "value"])

    blocks = F.explode(F.sequence(F.lit(0), F.size("sizes") - 1, F.lit(block))).alias("first")
    found = rows.select("lang", blocks, "items", "sizes", "v").mapInArrow(run, "lang string, a long, b long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, widths: tuple[int, ...] = WIDTHS, shipped: int = SHIPPED, block: int = 256) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): `pair`, the distance to each other source of the language; `term`, the
    `top` terms whose share exceeds the language's most."""
    terms = frequent_terms(docs, least, widths, shipped)
    counts = stored(term_counts(docs, terms, shipped), "term_counts")
    occurring = _texts(docs).select("lang", "source", F.lit(0).cast("long").alias("n")).unionByName(counts.select("lang", "source", "n"))
    groups = occurring.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = stored(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    # One row for each language, with an entry for each of its sources.
    v = terms.groupBy("lang").agg(F.count("*").alias("v"))
    by_lang = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "size"))), lambda x: x["size"]).alias("sizes"), F.sum("size").alias("lang_size"))
    langs = bounded_broadcast(by_lang.join(bounded_broadcast(v), "lang"))

    placed = counts.join(bounded_broadcast(groups), ["lang", "source"])
    by_term = placed.groupBy("lang", "term").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "n")).alias("items"), F.sum("n").alias("m"))
    by_term = stored(by_term, "by_term").join(langs, "lang")

    named = lambda c, name: bounded_broadcast(groups.select("lang", F.col("at").cast("long").alias(c), F.col("source").alias(name)))
    apart = named("a", "source").join(named("b", "item"), "lang").filter("a != b")
    pairs = apart.join(distances(by_term, block), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    five_v = F.col("v") * 5
    each = by_term.select("lang", "term", "v", "sizes", share(F.col("m") + 5, F.col("lang_size") + five_v).alias("q"), F.explode("items").alias("i"))
    each = each.withColumn("size", F.element_at("sizes", (F.col("i.at") + 1).cast("int")))
    each = each.select("lang", "term", "q", F.col("i.at").alias("a"), share(F.col("i.n") + 5, F.col("size") + five_v).alias("p"))
    over = each.filter("p > q").select("lang", "a", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    best = over.withColumn("rank", place("lang", "a")).filter(F.col("rank") <= top).join(named("a", "source"), ["lang", "a"])
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", place("lang", "source")).unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same result in DuckDB SQL."""
    p = lambda n, total: f"1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST}),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = x.lang AND c.source = x.source) AS size FROM (SELECT DISTINCT lang, source FROM d) x),
cells AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "size")} AS p FROM g JOIN kept USING (lang) JOIN vs USING (lang) LEFT JOIN c USING (lang, source, term)),
whole AS (SELECT lang, term, {p("m", "lang_size")} AS q FROM (SELECT lang, term, sum(n) AS m FROM c GROUP BY ALL) JOIN (SELECT lang, sum(size) AS lang_size FROM g GROUP BY lang) USING (lang) JOIN vs USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
rows_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
        LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows_) WHERE part = 'pair' OR rank <= {TOP}"""
