"""Licence scan by canonical digests (operator 7, DataFrame functions only).

A text is put into canonical form: lower case; equivalent spellings unified ("licence" and "license", "v2" and
"version 2", "version 2.0" and "version 2", "gpl" and "gnu general public license", ...); punctuation and white space
turned into single spaces. The SHA-256 of the canonical form is the digest of the entire text. Known licence texts go
through the same expressions, and texts are joined with them on the digest. Looked up as entire texts are the document, each
of its lines, and each run of its words, whatever the lines, that begins with the first ANCHOR words of a known text and
has as many words. A known text of fewer words, or an SPDX tag, whose meaning depends on the rest of its line, is looked
up as document and line only.

Copyright notices differ from work to work and are dropped before: lines that begin with the sign or word and name a
year, a placeholder or "(c)". Terms that only speak of copyright stay. As a notice may share its line with other words
where a text has been wrapped anew, a document with notices is looked up without them and as it is, and a known text is known
in both forms, and, if its notice stands near its beginning, also from behind that, as the holder is not known elsewhere.

The known texts are a parameter: (licence id, text). The default is the standard notices by which works name their
licence, and the full texts of the folder license_texts. The table of known digests is broadcast after its size has been checked.

One row per document and licence found: doc_id, license_id, whole_text (the document as a whole is the licence),
n_lines (lines that are; 0 if only runs of words are). Null, empty or blank texts match nothing. A document that appears in several rows of the
table counts its lines together. Rows with null doc_id form one group. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, table

# Standard notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

ANCHOR = 3


def full_texts() -> list[tuple[str, str]]:
    """(licence id, text) of the files ID.txt and ID.variant.txt of license_texts."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f.name.removesuffix(".txt").removesuffix(".titled").removesuffix(".holder"), f.read_text()) for f in files]


# Spellings taken as equal, in this order, on lower-cased text with single spaces for punctuation.
SPELLINGS = [
    (r"\blicence(s|d)?\b", "license$1"),
    (r"\bcreative commons attribution\b", "cc by"),
    (r"\bnon ?commercial\b", "nc"),
    (r"\bshare ?alike\b", "sa"),
    (r"\bgnu gpl\b|\bgpl\b", "gnu general public license"),
    (r"\bgnu lgpl\b|\blgpl\b", "gnu lesser general public license"),
    (r"\bv(er(sion)?)? ?(?=[0-9])", "version "),
    (r"(\b[0-9]+)((?: 0)+)(?= |$)", "$1"),
]
#: A text without a digit that holds none of these has none of the spellings.
SPELLING_WORDS = ("licence", "creative commons", "commercial", "share", "gpl")
COPYRIGHT_WORDS = ("copyright", "(c)", "©")
NOTICE = r"(?im)^[^\p{L}\p{N}\n(©]*(?:copyright\s*(?:\(c\)|©|[\[<{])|(?:copyright|\(c\)|©)[^\n]*\b(?:19|20)[0-9][0-9]\b)[^\n]*$"
#: Lines within which a notice stands near a text's beginning.
HEAD_LINES = 12


def forms(text: str) -> list[str]:
    """A known text without notices and as it is, each also from behind a notice near the beginning."""
    import regex

    found = [text, *(text[m.end() :] for m in list(regex.finditer(NOTICE, text))[-1::-1] if text.count("\n", 0, m.start()) < HEAD_LINES)][:2]
    return list(dict.fromkeys(x for t in found for x in (regex.sub(NOTICE, "", t), t)))


def with_canonical(df: DataFrame, text: str) -> DataFrame:
    """df with its column text in canonical form: empty if null or only blanks or punctuation.

    Searches for plain substrings, which are cheap, spare most texts the patterns. The result is never null, so that
    no filter on it is pushed below, where it would be computed again.
    """
    x = F.col(text)
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))
    unified: Column = x
    for pattern, to in SPELLINGS:
        unified = F.regexp_replace(unified, pattern, to)
    df = df.withColumn(text, F.lower(F.coalesce(x, F.lit(""))))
    df = df.withColumn(text, F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))
    return df.withColumn(text, F.when(has(SPELLING_WORDS) | x.rlike("[0-9]"), F.trim(F.regexp_replace(unified, " +", " "))).otherwise(x))


def known_digests(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """(digest, license_id, n_words, anchor) of each known text; the anchor is null if it has no runs to look up."""
    every = [(i, x) for i, t in notices for x in forms(t)]
    known = with_canonical(spark.createDataFrame(every, "license_id string, known string"), "known")
    words = F.split("known", " ")
    tag = F.startswith(F.col("known"), F.lit("spdx "))
    anchor = F.when((F.size(words) >= ANCHOR) & ~tag, F.concat_ws(" ", F.slice(words, 1, ANCHOR)))
    found = known.filter("known != ''").select("license_id", F.sha2("known", 256).alias("digest"), F.size(words).alias("n_words"), anchor.alias("anchor"))
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("n_words").alias("n_words"), F.min("anchor").alias("anchor"))


def without_notices(text: str) -> Column:
    """An array of the text without its notices, empty if it has none."""
    x = F.col(text)
    word = reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(w)) for w in COPYRIGHT_WORDS))
    bare = F.when(word, F.regexp_replace(x, NOTICE, "")).otherwise(x)
    return F.when(bare != x, F.array(bare)).otherwise(F.array().cast("array<string>"))


def runs_of_words(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, license_id) of each run of words of a document that is a known text."""
    anchors = [r["anchor"] for r in known.filter("anchor is not null").select("anchor").distinct().collect()]  # as many as known texts at most
    if not anchors:
        return docs.select("doc_id", F.lit("").alias("license_id")).limit(0)
    body = with_canonical(docs.select("doc_id", F.explode_outer(F.array_append(without_notices("text"), F.col("text"))).alias("unit")), "unit")
    listed = F.array(*map(F.lit, anchors))
    begins = lambda i: F.concat_ws(" ", F.slice("words", i, ANCHOR))
    places = F.filter(F.sequence(F.lit(1), F.size("words") - (ANCHOR - 1)), lambda i: F.array_contains(listed, begins(i)))
    some = reduce(lambda a, b: a | b, (F.contains(F.col("unit"), F.lit(a)) for a in anchors))
    # explode_outer, as explode would have a filter inferred and pushed below, where the form is computed again.
    words = body.select("doc_id", F.when(some, F.split("unit", " ")).alias("words"))
    at = words.select("doc_id", "words", F.explode_outer(F.when(F.size("words") >= ANCHOR, places)).alias("at"))
    near = at.withColumn("anchor", begins(F.col("at"))).join(bounded_broadcast(known), "anchor")
    return near.filter(F.sha2(F.array_join(F.slice("words", F.col("at"), F.col("n_words")), " "), 256) == F.col("digest")).select("doc_id", "license_id")


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    digests = known_digests(docs.sparkSession, NOTICES + full_texts() if notices is None else notices)
    known = bounded_broadcast(digests.select("digest", "license_id"))
    unit = lambda whole: lambda x: F.struct(F.lit(whole).alias("whole"), x.alias("unit"))
    own = F.transform(F.array_append(without_notices("text"), F.col("text")), unit(True))
    units = docs.select("doc_id", F.explode(F.concat(own, F.transform(F.split("text", "\n"), unit(False)))).alias("u"))
    texts = with_canonical(units.select("doc_id", "u.whole", "u.unit"), "unit")
    found = texts.select("doc_id", "whole", F.coalesce(F.sha2("unit", 256), F.lit("")).alias("digest")).join(known, "digest")
    found = found.select("doc_id", "license_id", "whole", (~F.col("whole")).alias("line"))
    runs = runs_of_words(docs, digests).select("doc_id", "license_id", F.lit(False).alias("whole"), F.lit(False).alias("line"))
    return found.unionByName(runs).groupBy("doc_id", "license_id").agg(F.max("whole").alias("whole_text"), F.count_if("line").alias("n_lines"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The canonical form in DuckDB's own expressions."""

    def form(x: str) -> str:
        e = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        for pattern, to in SPELLINGS:
            pattern = pattern.replace(r" ?(?=[0-9])", r" ?([0-9])") if "(?=[0-9])" in pattern else pattern.replace("(?= |$)", "( |$)")
            to = {"version ": r"version \3", "$1": r"\1\3"}.get(to, to.replace("$1", r"\1"))
            e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
        return f"trim(regexp_replace({e}, ' +', ' ', 'g'))"

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(i)}, {quoted(x)})" for i, t in NOTICES + full_texts() for x in forms(t))
    bare = f"regexp_replace(text, '{NOTICE}', '', 'g')"
    return f"""
WITH known AS MATERIALIZED (SELECT min(id) AS license_id, c FROM (SELECT id, {form("t")} AS c FROM (VALUES {values}) v(id, t)) WHERE c != '' GROUP BY c),
bodies AS MATERIALIZED (SELECT doc_id, {form("t")} AS c FROM (SELECT doc_id, text AS t FROM documents UNION ALL SELECT doc_id, {bare} FROM documents WHERE {bare} != text)),
lines AS (SELECT doc_id, {form("t")} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)),
found AS (SELECT doc_id, license_id, true AS whole, 0 AS line FROM bodies JOIN known USING (c) UNION ALL SELECT doc_id, license_id, false, 1 FROM lines JOIN known USING (c)
    UNION ALL SELECT doc_id, license_id, false, 0 FROM bodies b JOIN known k ON contains(' ' || b.c || ' ', ' ' || k.c || ' ') WHERE len(string_split(k.c, ' ')) >= {ANCHOR} AND NOT starts_with(k.c, 'spdx '))
SELECT doc_id, license_id, bool_or(whole) AS whole_text, sum(line)::BIGINT AS n_lines FROM found GROUP BY doc_id, license_id"""
