"""Packing by power-of-two decomposition (operator 11).

A document's tokens are its subword ids and one end id. The document is cut into pieces of `size` tokens while it has
that many and then into the powers of two of the rest, from large to small, the binary digits of its length. Every
piece is a sequence of its own: no sequence crosses documents, and none is padded, as its length is a power of two.
Sequences of one length form a bucket, from which a training step takes equal sequences.

Sequences are numbered by bucket, long ones first. Pieces of one length are ranked within parts of it, a hash of
the row deals them, as many as keep about `part_rows` in each, so that a very common length is spread over tasks;
parts are offset by the counts before them. The counts have a row for each length and part.

Null or empty text is the end id alone. Rows with a null doc_id and repeated rows are packed like any other row. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, bounded_broadcast, stored, table
from .subwords import Subwords, tokenizer_path

PIECE = "doc_id long, row_hash long, start long, length long, ids_crc32 long, doc_tokens long"


def binary_cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; every length is a power of two of at most `size`, itself one."""
    whole, rest = divmod(n, size)
    cuts = [(i * size, size) for i in range(whole)]
    start = whole * size
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            cuts.append((start, 1 << bit))
            start += 1 << bit
    return cuts


def binary_pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a document: place, length, CRC-32 of its ids, tokens of the document."""
    if size < 1 or size & (size - 1):
        raise ValueError("size is a power of two")
    end = end_id.to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(path)
        for b in batches(it):
            out: list[tuple] = []
            for doc_id, salt, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids = memoryview(subwords.ids(text) + end)
                n = len(ids) // 4
                out += [(doc_id, salt, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n) for at, length in binary_cuts(n, size)]
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "row_hash", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_hash"), "text").mapInArrow(run, PIECE)


def bucketed(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 0, part_rows: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stored(binary_pieces(docs, path or tokenizer_path(), size, end_id), "binary_pieces")
    sizes = cut.groupBy("length").agg(F.ceil(F.count("*") / part_rows).alias("parts"))  # a row for each power of two
    cut = cut.join(F.broadcast(sizes), "length").withColumn("part", F.pmod("row_hash", "parts")).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("length", "part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    parts = stored(parts, "binary_parts")
    longer = parts.groupBy(F.col("length").alias("_longer")).agg(F.sum("count").alias("_n"))
    first = sizes.join(F.broadcast(longer), F.col("_longer") > F.col("length"), "left").groupBy("length").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_first"))
    base = parts.join(F.broadcast(first), "length").select("length", "part", (F.col("_first") + F.col("_before")).alias("_base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "row_hash", "start")
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1).join(bounded_broadcast(base), ["length", "part"])
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(table(spark, sf_dir, "documents"))
