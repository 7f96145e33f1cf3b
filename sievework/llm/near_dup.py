"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification (operator 10).

Circulant MinHash (Li and Li, 2021) needs two permutations of the universe: sigma shuffles a shingle once, and
coordinate k of the signature is the least pi(sigma(x) - k), the second permutation circularly shifted by k. Both
are bijections of the 32-bit integers, so no table is stored.

Documents with the same shingle set form a class and only one of each is compared. A band of `ROWS` coordinates is a
bucket. The work in a bucket never is all its pairs:

1. every class is compared with the smallest class of each of its buckets (one link per class and bucket), and
   connected components of the confirmed links are found;
2. in buckets that still hold several components, every class is described by what it lacks of a pivot, a class that
   most of the bucket's neighbourhood has met, and by what it has beyond it. If x lacks a(x) shingles of the pivot p and
   has e(x) more, then J(x, y) >= t / 100 if and only if the two descriptions share s elements with
   (100 + t) s >= W(x) + W(y) - (100 - t) |p|, where W = 100 a + t e. Edited copies of one text share few edits, so
   their descriptions meet in few of their rarest elements (prefix filter), though the texts share nearly everything;
3. classes far from the pivot are described by their whole sets, as if the pivot were empty: t/100 + J(x, p) - 1 bounds
   J(y, p) from below, so that a pair either meets around the pivot or has both sides here. Shingles of a passage that
   many texts share are the least rare and bring no pairs together;
4. the pairs that meet, across components, are verified: first those of each class with one class of the largest
   component that has the element, which grow with the rows and join most of a group; then all that are still across
   components, none of them within that largest one. So a group's pairs are not made where its links already are.

With 32 bands of 4 rows a pair at the threshold of 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
Pairs whose signatures agree in fewer than 77 of 128 coordinates are dropped (at the threshold, 1e-8 of pairs); the
others are compared on their full sets of 64-bit shingle hashes.

Nulls and edge cases: null or wordless text has no shingles and links with nothing; a text of fewer than k words is
one shingle; rows whose id is null get a null component and are kept; rows that repeat an id are judged each by its own
text; an empty table gives an empty result; other columns are ignored unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, batches, drop_stored, mix64, shingle_hashes, stored, table, words_of
from .components import components

BANDS, ROWS, LEAST_AGREE = 32, 4, 77
#: Percent of similarity with the pivot from which a class is described by its differences.
NEAR = 50


def _mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(13)
    return x


def circulant_signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k: the least pi(sigma(x) - k) over the set."""
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    start = _mix32((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    for i in range(0, len(start), 1024):
        part = _mix32(start[None, i : i + 1024] - shifts, 0x9E3779B1, 0x7FEB352D)
        np.minimum(low, part.min(axis=1), out=low)
    return low


def _set_of(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    words = words_of(text)
    if words:
        words = text.encode().lower().split()
    return np.unique(shingle_hashes(hashes.array(words), k))


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m = signature.astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = mix64(key + m[:, j])
    return key.view(np.int64)


SIGNATURE = "n_shingles long, node binary, bands array<long>, sketch binary"


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the columns `keep`, size and 128-bit digest of its shingle set, its band keys and the low byte of each signature coordinate (null if the set is empty)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").alias("_text"))
    fields = source.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SIGNATURE])
    names = [*(f.name for f in fields), "n_shingles", "node", "bands", "sketch"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches(it):
            size, node, keys, sketch = [], [], [], []
            for text in b.column(len(fields)).to_pylist():
                s = _set_of(text, k, hashes)
                size.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                m = circulant_signature(s, bands * rows) if len(s) else None
                keys.append(_band_keys(m, bands, rows) if len(s) else None)
                sketch.append((m & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            made = [pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.record_batch([*b.columns[: len(fields)], *made], names)

    return source.mapInArrow(run, schema)


def _candidate_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of each wanted (doc_id, node), the sorted 64-bit hashes; a row with another text under that id is passed over."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches(it):
            sets = [_set_of(t, k, hashes).tobytes() for t in b.column(1).to_pylist()]
            keep = pa.array([xxhash.xxh3_128_digest(s) == n for n, s in zip(b.column(0).to_pylist(), sets, strict=True)], pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), pa.array(sets, pa.binary()).filter(keep)], ["node", "shingles"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("node", "text")
    return found.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def _held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of sorted a are in sorted b."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with the sets sa and sb."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "sa", "sb")


def _in_both(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, sets of a, sets of b)."""
    for b in batches(it):
        yield b, [np.frombuffer(s, np.uint64) for s in b.column(2).to_pylist()], [np.frombuffer(s, np.uint64) for s in b.column(3).to_pylist()]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs (a, b) of nodes for which 100 * intersection >= percent * union, on full sets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, left, right in _in_both(it):
            both = np.array([_held(x, y).sum() if len(x) < len(y) else _held(y, x).sum() for x, y in zip(left, right, strict=True)], np.int64)
            sizes = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64)
            keep = pa.array(100 * both >= percent * (sizes - both), pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    return _with_sets(pairs, sets).mapInArrow(run, "u binary, v binary")


def _close(a: str, b: str, percent: int):
    """Sizes that allow the threshold."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in LEAST_AGREE coordinates or more, by the low byte of each coordinate."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= LEAST_AGREE)
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    left = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


DESCRIBED = "pivot binary, node binary, weight long, bound long, elements array<long>"


def _described(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Descriptions of the nodes b in met(a, b), a being their pivot: by differences from it, by their whole set under a null pivot, or both."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left, right in _in_both(it):
            pivot, node, weight, bound, elements = [], [], [], [], []
            for p, x, sp, sx in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), left, right, strict=True):
                held = _held(sx, sp)
                both = int(held.sum())
                union = len(sp) + len(sx) - both
                if 100 * both >= (NEAR + percent - 100) * union:
                    lacks, more = sp[~_held(sp, sx)], sx[~held]
                    pivot.append(p)
                    node.append(x)
                    weight.append(100 * len(lacks) + percent * len(more))
                    bound.append((100 - percent) * len(sp))
                    elements.append(np.concatenate([~lacks, more]).view(np.int64))
                if 100 * both < NEAR * union:
                    pivot.append(None)
                    node.append(x)
                    weight.append(percent * len(sx))
                    bound.append(0)
                    elements.append(None)
            yield pa.record_batch([pa.array(pivot, pa.binary()), pa.array(node, pa.binary()), pa.array(weight, pa.int64()), pa.array(bound, pa.int64()), pa.array(elements, pa.list_(pa.int64()))], [c.split()[0] for c in DESCRIBED.split(", ")])

    return _with_sets(met, sets).mapInArrow(run, DESCRIBED)


def _whole_sets(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Descriptions by whole sets, under an empty pivot."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [np.frombuffer(s, np.int64) for s in b.column(1).to_pylist()]
            n = len(found)
            yield pa.record_batch([pa.array([b""] * n, pa.binary()), b.column(0), pa.array([percent * len(s) for s in found], pa.int64()), pa.array([0] * n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], [c.split()[0] for c in DESCRIBED.split(", ")])

    return nodes.join(sets, "node").select("node", "shingles").mapInArrow(run, DESCRIBED)


def _prefixes(described: DataFrame, percent: int) -> DataFrame:
    """The rarest elements of each description, by which pairs are found: pivot, element, node, weight, bound, after, far, near.

    Of a pair, let W(x) be the larger weight. The shared elements number s >= (W(x) - bound) / 100, as y can share no
    more than W(y) / percent, and s >= max(2 W(y) - bound, W(y)) / (100 + percent), as the larger weight is over the
    bound: a class within the bound is linked with the pivot. So it is enough that x has one of its `far` rarest
    elements among the `near` rarest of y, and, as that holds for the rarest shared element, that the elements from there
    on, `after`, are enough.
    """
    rows = described.select("pivot", "node", "weight", "bound", F.size("elements").alias("size"), F.explode("elements").alias("element"))
    many = rows.groupBy("pivot", "element").agg(F.count("*").alias("df")).filter("df > 1")
    of = Window.partitionBy("pivot", "node")
    ranked = rows.join(many, ["pivot", "element"]).withColumn("seen", F.count("*").over(of)).withColumn("rank", F.row_number().over(of.orderBy("df", "element")) + F.col("size") - F.col("seen"))
    ceil = lambda x, d: F.ceil(x / F.lit(d))
    w, bound = F.col("weight"), F.col("bound")
    far = (w > bound) & (F.col("rank") <= F.col("size") + 1 - F.greatest(F.lit(1), ceil(w - bound, 100)))
    near = F.col("rank") <= F.col("size") + 1 - F.greatest(F.lit(1), ceil(F.greatest(w * 2 - bound, w), 100 + percent))
    return ranked.select("pivot", "element", "node", "weight", "bound", (F.col("size") + 1 - F.col("rank")).alias("after"), far.alias("far"), near.alias("near")).filter("far or near")


def _of_components(rows: DataFrame) -> DataFrame:
    """Rows of pivots and elements whose nodes have several components, with `main`, the component of most of them."""
    sizes = rows.groupBy("pivot", "element", "component").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("pivot", "element").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components")).filter("components > 1")
    return rows.join(mains.select("pivot", "element", F.col("most.component").alias("main")), ["pivot", "element"])


def _linked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with each component renamed to the least within two steps of links(u, v): nodes of one name are connected, but not all that are have one name."""
    of = rows.select("node", "component").distinct()
    ends = links.join(of.toDF("u", "c"), "u").join(of.toDF("v", "d"), "v").select("c", "d")
    steps = ends.unionByName(ends.select(F.col("d").alias("c"), F.col("c").alias("d"))).filter("c != d").distinct()
    least = steps.groupBy("c").agg(F.min("d").alias("d")).select(F.col("c").alias("d"), F.least("c", "d").alias("name"))
    names = steps.join(least, "d").groupBy(F.col("c").alias("component")).agg(F.min("name").alias("name"))
    return rows.join(names, "component", "left").withColumn("component", F.coalesce("name", "component")).drop("name")


def _that_may_link(others: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components of `others` and `rows`, parts of _of_components(), that share an element of their prefixes and may share enough."""
    side = lambda df, end: df.select("pivot", "element", *(F.col(c).alias(c + end) for c in ("node", "weight", "bound", "after", "far", "near", "component")))
    met = side(others, "_x").join(side(rows, "_y"), ["pivot", "element"])
    heavier = F.struct("weight_x", "node_x") > F.struct("weight_y", "node_y")
    fits = (heavier & F.col("far_x") & F.col("near_y")) | (~heavier & F.col("far_y") & F.col("near_x"))
    enough = F.least("after_x", "after_y") * (100 + percent) >= F.col("weight_x") + F.col("weight_y") - F.col("bound_x")
    met = met.filter((F.col("component_x") != F.col("component_y")) & fits & enough)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _pairs_with_one(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of the classes outside the main component of an element with one class of it: a pair for each row at most."""
    one = rows.filter("component = main and near").groupBy("pivot", "element").agg(F.min_by(F.struct(*rows.columns), F.xxhash64("node")).alias("one")).select("one.*")
    return _that_may_link(rows.filter("component != main"), one, percent)


def _pairs_described(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs across components; of each, one class is outside the main component of the element in which they meet."""
    return _that_may_link(rows.filter("component != main"), rows, percent)


def _around_pivots(shared: DataFrame, part: DataFrame) -> DataFrame:
    """(a, b): the classes b of each bucket with several components, and that bucket's pivot a.

    The home of a class is the leader of its largest bucket; the pivot of a bucket is the home with the largest bucket
    among its members, so that a group of copies has few pivots.
    """
    homes = shared.groupBy("node").agg(F.max(F.struct("m", "leader")).alias("home"))
    rows = shared.select("key", "node", "leader").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A bucket in which all but the leader's component is one class has been compared already.
    mixed = rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m")).filter("c0 != c1 and m > 2")
    members = rows.select("key", "node").join(mixed.select("key"), "key").join(homes, "node")
    pivots = members.groupBy("key").agg(F.max("home").alias("home"))
    return members.select("key", "node").join(pivots, "key").select(F.col("home.leader").alias("a"), F.col("node").alias("b")).distinct()


def _merged(links: DataFrame, part: DataFrame) -> DataFrame:
    """Components with further links."""
    return stored(components(links.unionByName(part.filter("node != component").select(F.col("node").alias("u"), F.col("component").alias("v")))), "parts")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the columns `keep`, n_shingles, group (a digest, null if alone by definition), component_id (smallest id reachable over links), kept."""
    sig = stored(signatures(docs, k, keep=keep), "signatures")
    usable = sig.filter("node is not null and doc_id is not null")
    one = usable.groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("s"))
    classes = stored(one.select("node", "s.doc_id", F.col("s.n_shingles").alias("n"), "s.bands", "s.sketch"), "classes")

    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("node", "n")).alias("first")).filter("m > 1").select("key", "m", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"))
    shared = stored(banded.join(buckets, "key"), "buckets")
    sets = stored(_candidate_sets(docs, classes.join(shared.select("node").distinct(), "node").select("doc_id", "node"), k), "sets")

    star = shared.filter((F.col("node") != F.col("leader")) & _close("n", "leader_n", percent)).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(confirmed(_likely(star, classes), sets, percent), "links")
    part = stored(components(links), "parts")
    described = stored(_described(_around_pivots(shared, part), sets, percent), "described")
    whole = _whole_sets(described.filter("pivot is null").select("node").distinct(), sets, percent)
    able = _prefixes(described.filter("pivot is not null").unionByName(whole), percent)
    named = able.join(part.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = stored(_of_components(stored(named, "prefixes")), "mixed")
    meets = stored(_pairs_with_one(mixed, percent), "meets")
    first = stored(confirmed(_likely(meets, classes), sets, percent), "links")
    rest = stored(_of_components(_linked(mixed.drop("main"), first)), "mixed")
    others = stored(_pairs_described(rest, percent), "meets")
    more = stored(confirmed(_likely(others, classes), sets, percent).unionByName(first), "links")
    if not more.isEmpty():
        part = _merged(more, part)
    drop_stored(sets, shared, described, mixed, meets, first, rest, others, links, more)

    grouped = classes.join(part, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(least, "group").select("node", "group", "component_id")
    own = sig.join(named, "node", "left").select("doc_id", *keep, "n_shingles", "group", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
