"""Quality rules with adaptive thresholds (operator 1).

Each document gets a few measures in one pass over its text. For every language and source, a quantile sketch of
each measure is built: values fall into logarithmic bins, so that a bin's bound is within `ALPHA` of every value in
it (the DDSketch of Masson, Rim and Lee, 2019). A sketch is a set of bin counts. Merging adds counts, so the result is
the same for any partitioning. A group's sketch is merged with that of its language, scaled to `PRIOR` documents, and a
language's with that of all documents likewise, so that small groups lean on larger ones and large ones on themselves.
From the merged sketch come the quartiles, and from these the fences, REACH times the group's spread beyond them. A
document outside a fence is rejected by joining it with the thresholds of its language and source. No number but REACH
is fixed, and it has no unit.

The spread of a measure is the group's interquartile range, but at least the median of those of its language's groups, so
that a source that is mostly copies of one text still takes others; ranges of 0 are left out of the median. Where a language
has no other, the median over all groups counts, and where nothing varies there is no fence. Symbols a word are 0 in most documents of prose and so are their quartiles: how far they may
vary is told by all marks a word (characters that are no letters), of which symbols are some. A source of program code or
tables, with many marks that vary much, has wide fences; one of prose has narrow ones.

The sketches leave out documents that fail the base rules (too short, or mostly repeated windows): these go anyway.

Null or wordless text has all counts 0 and fails the base rules. A null language or source is a group of its own.
Repeated rows count and are returned each; an empty table gives an empty result; other columns are ignored by
`judge` and kept by `filter_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, bounded_broadcast, stored, table

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Documents that the sketch of the language weighs in a group's, and that of all documents in a language's.
PRIOR = 100
REACH = 5.0
MIN_WORDS = 50
#: Symbols a word, marks a word and characters a word.
MEASURES = ("symbol_rate", "mark_rate", "word_length")
#: The measures that have fences, and the measure whose spread sets them.
FENCED = {"symbol_rate": "mark_rate", "word_length": "word_length"}

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_MARKS = bytes(c for c in range(128) if not chr(c).isalpha() and c not in _SPACE)
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) < 2_000_000:
        code = (x[:-2] * len(ids) + x[1:-1]) * len(ids) + x[2:]
    else:
        pair = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)[1]
        code = pair[:-1] * len(ids) + x[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[j : n - 2 + j] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * 7
    b = text.encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    chars = len(text) - (len(b) - len(b.translate(None, _SPACE)))
    marks = len(b) - len(b.translate(None, _MARKS))
    return len(words), chars, len(b) - len(b.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words), len(lines), marks


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` of docs and the counts of the text."""
    fields = docs.select(*keep).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [COUNTS])
    names = [f.name for f in fields] + [c.split()[0] for c in COUNTS.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            counts = np.array([text_counts(t) for t in b.column(len(fields)).to_pylist()], np.int64).reshape(-1, 7)
            yield pa.record_batch([*b.columns[: len(fields)], *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(7))], names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def with_measures(counted: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_rate": ratio("n_symbols", "n_words"),
            "mark_rate": ratio("n_marks", "n_words"),
            "word_length": ratio("word_chars", "n_words"),
            "_lang": F.coalesce("lang", F.lit("")),
            "_source": F.coalesce("source", F.lit("")),
        }
    )


def sketches(measures: DataFrame) -> DataFrame:
    """(_lang, _source, measure, bin, n): the quantile sketch of each measure in each group."""
    stack = f"stack({len(MEASURES)}, " + ", ".join(f"'{m}', {m}" for m in MEASURES) + ") as (measure, value)"
    x = F.col("value")
    long = measures.filter("not base_failed").select("_lang", "_source", F.expr(stack))
    binned = long.withColumn("bin", F.when(x > 1e-6, F.ceil(F.log(x) / math.log(GAMMA))).otherwise(F.lit(-1000)).cast("int"))
    return binned.groupBy("_lang", "_source", "measure", "bin").agg(F.count("*").alias("n"))


def _blended(sketch: DataFrame, keys: list[str], prior: DataFrame, prior_keys: list[str]) -> DataFrame:
    """(keys, measure, bin, n): the sketch in millionths of a document, with the prior's shares as PRIOR documents more."""
    shares = prior.withColumn("_total", F.sum("n").over(Window.partitionBy(*prior_keys, "measure"))).select(*prior_keys, "measure", "bin", F.round(F.col("n").cast("double") / F.col("_total") * (PRIOR * 1_000_000)).cast("long").alias("n"))
    groups = sketch.select(*keys, "measure").distinct()
    rows = sketch.select(*keys, "measure", "bin", (F.col("n") * 1_000_000).alias("n")).unionByName(groups.join(bounded_broadcast(shares), [*prior_keys, "measure"]))
    return rows.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The quartiles of each group and measure: the bounds of the bins that reach those shares."""
    w = Window.partitionBy(*keys, "measure")
    run = sketch.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("total") * q, F.col("bin")))
    bound = lambda c: F.when(F.col(c) == -1000, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col(c)))
    q = run.groupBy(*keys, "measure").agg(at(1).alias("b25"), at(3).alias("b75"))
    return q.select(*keys, "measure", bound("b25").alias("q25"), bound("b75").alias("q75"))


def thresholds(measures: DataFrame) -> DataFrame:
    """(_lang, _source, a low and a high fence per fenced measure) of each group with a document that passes the base rules."""
    own = stored(sketches(measures), "sketch")
    everything = own.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    lang = stored(_blended(own.groupBy("_lang", "measure", "bin").agg(F.sum("n").alias("n")), ["_lang"], everything, []), "sketch")
    q = _quartiles(_blended(own, ["_lang", "_source"], lang, ["_lang"]), ["_lang", "_source"]).withColumn("range", F.col("q75") - F.col("q25"))
    q = stored(q, "quartiles")
    median = F.expr("percentile_disc(0.5) within group (order by nullif(range, 0))")
    q = q.join(F.broadcast(q.groupBy("measure").agg(median.alias("_of_all"))), "measure")  # a row for each measure
    q = q.join(bounded_broadcast(q.groupBy("_lang", "measure").agg(median.alias("_of_lang"))), ["_lang", "measure"])
    q = q.withColumn("spread", F.greatest("range", F.coalesce("_of_lang", "_of_all")))
    of = lambda m, x: F.max(F.when(F.col("measure") == m, x))
    reach = lambda s: F.nullif(of(s, F.col("spread")), F.lit(0.0)) * REACH
    fences = [f.alias(name) for m, s in FENCED.items() for name, f in ((f"min_{m}", of(m, F.col("q25")) - reach(s)), (f"max_{m}", of(m, F.col("q75")) + reach(s)))]
    return stored(q.groupBy("_lang", "_source").agg(*fences), "fences")


def judged(measures: DataFrame, fences: DataFrame) -> DataFrame:
    """measures joined with their group's fences, with the measures outside them, and kept."""
    outside = F.array_compact(F.array(*[F.when(~F.col(m).between(F.col(f"min_{m}"), F.col(f"max_{m}")), F.lit(m)) for m in FENCED]))
    met = measures.join(bounded_broadcast(fences), ["_lang", "_source"], "left").withColumn("outside", outside)
    return met.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and verdict."""
    counted = stored(measured(docs, ("doc_id", "lang", "source")), "counts")
    measures = with_measures(counted)
    return judged(measures, thresholds(measures)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs without the rejected ones, with the columns of docs. The texts are measured again rather than shuffled."""
    counted = stored(measured(docs, ("lang", "source")), "counts")
    fences = thresholds(with_measures(counted))
    boxed = docs.select(F.struct(*docs.columns).alias("doc"), "lang", "source", "text")
    return judged(with_measures(measured(boxed, ("doc", "lang", "source"))), fences).filter("kept").select("doc.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same result in DuckDB SQL."""
    blend = lambda keys, src, prior, on: f"""SELECT {keys}, measure, bin, sum(n)::BIGINT AS n FROM (SELECT {keys}, measure, bin, n * 1000000 AS n FROM {src} UNION ALL
        SELECT {keys}, measure, bin, round(n::DOUBLE / total * {PRIOR * 1_000_000})::BIGINT FROM (SELECT DISTINCT {keys}, measure FROM {src}) g
        JOIN (SELECT *, sum(n) OVER (PARTITION BY {on}) AS total FROM {prior}) p USING ({on})) GROUP BY ALL"""  # noqa: E731
    bound = lambda b: f"CASE WHEN {b} = -1000 THEN 0 ELSE pow({GAMMA!r}, {b}) END"
    of = lambda m, x: f"max(CASE WHEN measure = '{m}' THEN {x} END)"
    fences = ", ".join(f"{of(m, q)} {sign} nullif({of(s, 'spread')}, 0) * {REACH} AS {name}_{m}" for m, s in FENCED.items() for name, q, sign in (("lo", "q25", "-"), ("hi", "q75", "+")))
    quartiles = lambda keys, src: f"""SELECT {keys}measure, {bound("min(CASE WHEN below * 4 >= total THEN bin END)")} AS q25, {bound("min(CASE WHEN below * 4 >= total * 3 THEN bin END)")} AS q75
        FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bin) AS below, sum(n) OVER (PARTITION BY {keys}measure) AS total FROM {src}) GROUP BY ALL"""  # noqa: E731
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0E-\\x1F!-@\\[-`{{-\\x7F]', '', 'g')) AS marks FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_rate,
        CASE WHEN n_words > 0 THEN marks::DOUBLE / n_words ELSE 0 END AS mark_rate, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length FROM c),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{x}' AS measure, {x} AS value FROM m WHERE NOT base_failed" for x in MEASURES)}),
own AS (SELECT lang, source, measure, CASE WHEN value > 1e-6 THEN ceil(ln(value) / {math.log(GAMMA)!r})::INT ELSE -1000 END AS bin, count(*) AS n FROM long GROUP BY ALL),
everything AS (SELECT measure, bin, sum(n)::BIGINT AS n FROM own GROUP BY ALL), bylang AS (SELECT lang, measure, bin, sum(n)::BIGINT AS n FROM own GROUP BY ALL),
lang2 AS ({blend("lang", "bylang", "everything", "measure")}), merged AS ({blend("lang, source", "own", "lang2", "lang, measure")}),
val AS ({quartiles("lang, source, ", "merged")}), ranges AS (SELECT *, q75 - q25 AS r FROM val),
of_lang AS (SELECT lang, measure, quantile_disc(nullif(r, 0), 0.5) AS r FROM ranges GROUP BY ALL), of_all AS (SELECT measure, quantile_disc(nullif(r, 0), 0.5) AS r FROM ranges GROUP BY ALL),
wide AS (SELECT ranges.*, greatest(ranges.r, coalesce(l.r, a.r)) AS spread FROM ranges JOIN of_lang l ON l.lang = ranges.lang AND l.measure = ranges.measure JOIN of_all a ON a.measure = ranges.measure),
fence AS (SELECT lang, source, {fences} FROM wide GROUP BY lang, source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND {" AND ".join(f"coalesce({x} BETWEEN lo_{x} AND hi_{x}, true)" for x in FENCED)} AS kept
FROM m LEFT JOIN fence ON m.lang = fence.lang AND m.source = fence.source"""
