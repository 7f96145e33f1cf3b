"""Benchmark decontamination by SimHash windows (operator 2, DataFrame functions only).

A document leaks a benchmark item if some window of it, of as many words as the item, has a weighted Jaccard
similarity of at least 0.8 with the item over five-word shingles, each shingle weighing as often as it occurs.

1. A window that reaches any similarity can be moved right until its first shingle is one of the item's: what it
   drops is not shared. So windows start only where a document's shingle is a shingle of some item, and have that
   item's size. Documents are read once, however many items there are; item shingles are broadcast if they are few
   and else joined by a shuffle of hashes.
2. Windows and items get a 64-bit SimHash of their shingles.
3. Multi-index search: fingerprints are cut into 8 blocks of 8 bits. Two fingerprints within Hamming distance 23
   differ by at most 2 bits in some block (8 * 3 = 24), so an item is stored under each of the 37 values within 2
   bits of each block, and all pairs within the radius meet. At similarity 0.8 a bit differs with probability 0.15;
   more than 23 of 64 differ with a probability of about 1e-6.
4. Pairs within the radius are compared exactly, on the words themselves, which join the pairs only then.

Words are runs of letters and digits of the lower-cased text. Items and texts of fewer than five words are one
shingle. Null, empty or wordless texts and items match nothing; rows with a null doc_id are reported under null; rows
that repeat an id count as one document in `leaks` and each by its own text in `without_leaks`; tied windows give the first; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored, table

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Up to so many words, items and their shingles are broadcast; beyond, they are shuffled.
BROADCAST_WORDS = 200_000
_MASKS = [0] + [1 << i for i in range(8)] + [(1 << i) | (1 << j) for i in range(8) for j in range(i)]


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _shingles(ws: str, width: int, of: str) -> Column:
    """One value for each run of `width` words; `of` is SQL with {0} for the run's first index."""
    return F.expr(f"transform(if(size({ws}) >= {width}, sequence(0, size({ws}) - {width}), cast(array() as array<int>)), i -> {of})")


def hashed(ws: str, width: int) -> Column:
    return _shingles(ws, width, "xxhash64(" + ", ".join(f"{ws}[i + {j}]" for j in range(width)) + ")")


def spelled(ws: str, width: int) -> Column:
    return _shingles(ws, width, f"array_join(slice({ws}, i + 1, {width}), ' ')")


def simhash(sh: str) -> Column:
    """Bit b is set if more than half of the shingle hashes have it."""
    return F.expr(f"coalesce(aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(if(2 * size(filter({sh}, x -> getbit(x, b) = 1)) > size({sh}), 1L, 0L), b)), 0L)")


def _with_items(docs: DataFrame, items: DataFrame, width: int, words_in_items: int) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, word_start, n_words) of window and item pairs within the radius, for items of this shingle width.

    Filters on the results of lambda functions would be pushed below the projections that hold their inputs, and these
    computed anew for each element; so arrays are exploded in outer form, fingerprints are never null, and the
    threshold is applied after the best window has been chosen.
    """
    items = items.withColumn("ih", hashed("iw", width)).withColumn("ifp", simhash("ih"))
    starts = items.select("m", F.explode_outer("ih").alias("h")).distinct()
    blocks = items.select("item_key", "m", "ifp", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block"))
    blocks = blocks.select("*", F.explode(F.array(*map(F.lit, _MASKS))).alias("mask"))
    blocks = blocks.select("item_key", "m", "ifp", "block", F.expr("(shiftright(ifp, 8 * block) & 255L) ^ mask").alias("value"))
    texts = items.select("item_key", "item_id", "iw")
    if words_in_items <= BROADCAST_WORDS:
        starts, blocks, texts = F.broadcast(starts), bounded_broadcast(blocks), F.broadcast(texts)
        placed = docs.withColumn("dh", hashed("dw", width)).select("doc_id", "text_key", "dw", F.posexplode_outer("dh").alias("word_start", "h"))
        windows = placed.join(starts, "h")
    else:  # the shingles of all documents are shuffled, without their texts, and what is found goes back to these
        placed = docs.withColumn("dh", hashed("dw", width)).select("doc_id", "text_key", F.posexplode_outer("dh").alias("word_start", "h"))
        found = placed.join(starts, "h").select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "word_start", "m").distinct()
        one = docs.groupBy("doc_id", "text_key").agg(F.first("dw").alias("dw"))
        windows = one.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")))
    windows = windows.select("doc_id", "text_key", "word_start", "m", F.expr("slice(dw, word_start + 1, m)").alias("ww"))
    windows = windows.withColumn("wh", hashed("ww", width)).withColumn("fp", simhash("wh"))
    probes = windows.select("doc_id", "text_key", "word_start", "m", "ww", "fp", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block")).withColumn("value", F.expr("shiftright(fp, 8 * block) & 255L"))
    met = probes.join(blocks, ["m", "block", "value"]).filter(f"bit_count(fp ^ ifp) <= {RADIUS}")
    met = met.filter("block = array_position(transform(sequence(0, 7), j -> bit_count(shiftright(fp ^ ifp, 8 * j) & 255L) <= 2), true) - 1").drop("block", "value", "fp", "ifp", "m")
    spelt = met.join(texts, "item_key").withColumn("a", spelled("ww", width)).withColumn("b", spelled("iw", width))
    # Shared shingles, once each, and what more they repeat on both sides: second and later places in sorted order.
    more = lambda c: f"filter({c}, (x, i) -> i > 0 and x = {c}[i - 1])"
    spelt = spelt.withColumn("a", F.sort_array("a")).withColumn("b", F.sort_array("b")).withColumn("c", F.expr(more("a"))).withColumn("d", F.expr(more("b")))
    both = spelt.withColumn("both", F.expr("size(array_intersect(a, b)) + if(size(d) > 0, aggregate(array_distinct(c), 0, (acc, x) -> acc + least(size(filter(c, y -> y = x)), size(filter(d, y -> y = x)))), 0)"))
    return both.select("doc_id", "text_key", "item_id", F.expr("both / (size(a) + size(b) - both)").alias("similarity"), "word_start", F.size("ww").alias("n_words"))


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best window of each document, text and item; a text is told by its hash, text_key."""
    items = benchmark.select("item_id", words("text").alias("iw")).withColumn("m", F.size("iw")).filter("m > 0").dropDuplicates(["item_id", "iw"])
    items = items.withColumn("item_key", F.xxhash64("item_id", "iw"))
    shape = items.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("words"), F.sort_array(F.collect_set(F.least("m", F.lit(SHINGLE)))).alias("widths")).first()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words("text").alias("dw"))
    found = None
    for width in shape["widths"] or [SHINGLE]:  # five at most; all items of five words or more have one width
        rows = _with_items(texts, items.filter(F.least("m", F.lit(SHINGLE)) == width), width, shape["words"])
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("word_start")).alias("back"), "n_words")).alias("w"))
    return best.filter(F.col("w.similarity") >= SIMILARITY)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaking document and item: the most similar window, its first word (from 0) and its length."""
    best = _leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("w").alias("w"))
    return best.select("doc_id", "item_id", F.round("w.similarity", 9).alias("similarity"), (-F.col("w.back")).alias("word_start"), "w.n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text leaks an item; rows that share an id with one, or have none, are judged by their own text."""
    bad = _leaks(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    bad = stored(bad, "leaks")  # else counted once and computed again for the join
    boxed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    return boxed.join(bounded_broadcast(bad), F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("doc.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle_sql(documents: str = "documents") -> str:
    """Every window that starts at an item's shingle, compared exactly (items of five words or more)."""
    ws = lambda t: f"list_filter(string_split(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x != '')"
    grams = lambda src, key: f"SELECT {key}, i - 1 AS pos, list_aggregate(ws[i:i + {SHINGLE - 1}], 'string_agg', ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM {src})"
    return f"""
WITH it AS (SELECT item_id, {ws("text")} AS ws FROM benchmark), dt AS (SELECT doc_id, {ws("text")} AS ws FROM {documents}),
ig AS (SELECT item_id, g, count(*) AS c FROM ({grams("it", "item_id")}) GROUP BY ALL), isz AS (SELECT item_id, len(ws) AS m, len(ws) - {SHINGLE - 1} AS n FROM it),
dg AS (SELECT DISTINCT * FROM ({grams("dt", "doc_id")})),
st AS (SELECT DISTINCT d.doc_id, d.pos, i.item_id, s.n, s.m FROM dg d JOIN ig i ON d.g = i.g JOIN isz s ON s.item_id = i.item_id),
wg AS (SELECT st.doc_id, st.item_id, st.pos, st.n, st.m, d.g, count(*) AS c FROM st JOIN dg d ON d.doc_id = st.doc_id AND d.pos BETWEEN st.pos AND st.pos + st.n - 1 GROUP BY ALL),
o AS (SELECT w.doc_id, w.item_id, w.pos, w.n, w.m, sum(w.c) AS nw, sum(least(w.c, coalesce(i.c, 0))) AS o FROM wg w LEFT JOIN ig i ON i.item_id = w.item_id AND i.g = w.g GROUP BY ALL),
ok AS (SELECT *, o / (nw + n - o) AS similarity FROM o WHERE o / (nw + n - o) >= {SIMILARITY})
SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, arg_max(pos, (similarity, -pos))::INT AS word_start, arg_max(nw + {SHINGLE - 1}, (similarity, -pos))::INT AS n_words FROM ok GROUP BY doc_id, item_id"""
