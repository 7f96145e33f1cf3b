"""Best-fit packing of tokenised documents into fixed-length sequences (operator 5).

Planning works on the histogram of piece lengths, at most one count per possible length, so it costs the same for
any number of documents. Lengths are taken from long to short; the pieces of a length go to the open sequences with
the least space that fits them, whole groups of equal sequences at a time, and new sequences are opened for the rest.
That is the packing of best-fit decreasing over single pieces. Each placement is a slot: a range of ranks within
one length and the range of sequences that takes it. Every piece then finds its slot by joining on its rank within
its length.

Ranks do not depend on partitions: pieces of a length are ranked within buckets of a hash of the row, as many as keep
about `bucket_rows` in each, and buckets are offset by the counts before them, so that a very common length is spread
over tasks. A bucket is a range of ranks, so the slots it can meet are known beforehand; pieces and slots are joined on
length and bucket, by which the pieces lie already, and nothing is broadcast but the counts, at most one for each length.

A document's tokens are its subword ids and one end id. Documents of more than `size` tokens are cut into pieces of
`size`, the first piece being the shorter one. Null or empty text is the end id alone. Rows with a null doc_id and
repeated rows are packed like any other row. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, stored, table
from .subwords import Subwords, tokenizer_path

PIECE = "doc_id long, row_hash long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, remember: int = 800_000) -> DataFrame:
    """One row per piece of a document: place, length and CRC-32 of its ids. A task remembers the ids of so many pre-tokens."""
    end = end_id.to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(path, remember)
        for b in batches(it):
            out: list[tuple] = []
            for doc_id, salt, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids = subwords.ids(text) + end
                n = len(ids) // 4
                start, length = 0, n % size or size
                for piece in range(-(-n // size)):
                    out.append((doc_id, salt, piece, start, min(length, n), zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length = start + length, size
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "row_hash", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_hash"), "text").mapInArrow(run, PIECE)


def plan(histogram: dict[int, int], size: int = 2048) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, ranks, first sequence, pieces of this length per sequence, offset) and the number of sequences.

    Open sequences are groups (first sequence, how many) by the space left.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, count: int, space: int, length: int = length) -> int:
            """Put pieces into up to `count` equal sequences with this space, each filled before the next; returns how many pieces."""
            nonlocal left, rank
            per = space // length
            full = min(count, left // per)
            done = 0
            if full:
                slots.append((length, rank, full * per, first, per, size - space))
                room.setdefault(space - per * length, []).append((first, full))
                done = full * per
            rest = min(left - done, per) if full < count else 0
            if rest:
                slots.append((length, rank + done, rest, first + full, rest, size - space))
                room.setdefault(space - rest * length, []).append((first + full, 1))
                done += rest
            used = full + bool(rest)
            if used < count:
                room.setdefault(space, []).append((first + used, count - used))
            left, rank = left - done, rank + done
            return used

        for space in sorted(s for s in room if s >= length):
            if not left:
                break
            for first, count in room.pop(space):
                if left:
                    place(first, count, space)
                else:
                    room.setdefault(space, []).append((first, count))
        if left:
            count = -(-left // (size // length))
            first, opened = opened, opened + count
            place(first, count, size)
    return slots, opened


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0, bucket_rows: int = 20_000, remember: int = 800_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path or tokenizer_path(), size, end_id, remember), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    many = spark.createDataFrame([(n, -(-c // bucket_rows)) for n, c in histogram.items()], "length long, buckets long")
    cut = cut.join(F.broadcast(many), "length").withColumn("bucket", F.pmod("row_hash", "buckets")).drop("buckets")
    counts = cut.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    slots, _ = plan(histogram, size)
    slot_rows = spark.createDataFrame(slots, "length long, first_rank long, ranks long, first_sequence long, per long, slot_offset long")
    met = (F.col("first_rank") < F.col("base") + F.col("count")) & (F.col("base") < F.col("first_rank") + F.col("ranks"))
    places = offsets.join(slot_rows, "length").filter(met).drop("count")

    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "row_hash", "piece")
    ranked = cut.withColumn("in_bucket", F.row_number().over(within))
    j = F.col("base") + F.col("in_bucket") - 1 - F.col("first_rank")
    taken = ranked.join(places, ["length", "bucket"]).filter((j >= 0) & (j < F.col("ranks")))
    return taken.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.floor(j / F.col("per"))).alias("sequence_id"), (F.col("slot_offset") + F.pmod(j, F.col("per")) * F.col("length")).alias("offset"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
