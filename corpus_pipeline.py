"""The corpus pipeline: language ID, quality rules, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents, and more columns where docs has more. Decisions are taken on rows: two rows that repeat an id
are judged each by its own text. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, lang_id, near_dup, packing, quality
from sievework.llm.common import bound_batches, bounded_broadcast, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, those that no learned language fits better than all others together, and those that
    cost twice as much a byte under their language as nine in ten of the texts it was learned from: noise, program code,
    languages and scripts that were not learned.

    Null texts have no letter and go. If no row of docs has a language and an id to learn from, only the letters decide.
    Repeated rows and rows with a null id are judged each.
    """
    bound_batches(spark)
    learned = ~lang_id.held_out() & lang_id.learnable()
    model = lang_id.train(docs.filter(learned))
    found = lang_id.identify(docs.select(F.struct(*docs.columns).alias("doc"), learned.alias("learned"), "text"), model, keep=("doc", "learned"))
    if not model.languages:
        return found.filter("lettered").select("doc.*")
    found = stored(found, "judged")
    limits = [F.when(F.col("lang_pred") == lang, F.lit(most)) for lang, most in lang_id.cost_limits(found.filter("learned")).items()]
    usual = F.col("bits") <= F.coalesce(*limits, F.lit(float("inf")))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5) & usual).select("doc.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or lies outside the fences of its language and source.

    Null, empty and wordless texts fail the base rules and go. A null language or source is a group of its own.
    Repeated rows count each and get the same verdict.
    """
    bound_batches(spark)
    return quality.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; shingles of five words, similarity 0.8.

    Rows that repeat an id are told apart by their text: of a group the smallest (doc_id, hash of the text) stays. Of
    rows equal in id and text one stays, the least by its JSON form. Rows with a null id, and null, empty and wordless
    texts, are no one's copies and stay.
    """
    bound_batches(spark)
    boxed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"))
    found = near_dup.near_duplicates(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), k=5, percent=80, keep=("text_key",))
    rows = found.filter("doc_id is not null and n_shingles > 0").groupBy("group", F.col("doc_id").alias("id"), "text_key").agg(F.count("*").alias("rows"))
    rows = stored(rows, "rows")
    first = rows.groupBy("group").agg(F.min(F.struct("id", "text_key")).alias("first"))
    gone = rows.join(first, "group").filter(F.struct("id", "text_key") != F.col("first")).select("id", "text_key")
    rest = boxed.join(bounded_broadcast(gone), ["id", "text_key"], "left_anti")
    repeated = bounded_broadcast(rows.filter("rows > 1").select("id", "text_key"))
    once = rest.join(repeated, ["id", "text_key"], "left_semi").groupBy("id", "text_key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return rest.join(repeated, ["id", "text_key"], "left_anti").select("doc.*").unionByName(once.select("doc.*"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a window that is 0.8 or more like an item of benchmark.

    Null, empty and wordless texts and items match nothing. Rows that repeat an id, or have none, go or stay by their
    own text. Without items all documents stay.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, place and sequence. Null and empty texts are one token; repeated rows and rows with a null id are packed each."""
    bound_batches(spark)
    return packing.pack(docs, remember=250_000)  # beside what the stages before have left in a worker


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: Language ID and packing cannot be said in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written and read again, so that no later stage computes them anew."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
