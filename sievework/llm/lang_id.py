"""Language ID by prediction by partial matching over bytes (operator 9).

For each language a context tree holds the symbols seen after each context of 0 to 3 bytes. In a context with T
symbols seen, q of them different, a symbol seen c times has probability c / (T + q); else the escape q / (T + q) is
taken and the next shorter context asked; below the empty context all 256 bytes are equally likely. With the
statistics frozen after learning, the code length of a symbol depends on its context alone, so every code length is
computed once into a table over the union of the trees, and a text is scored by two gathers a byte. Symbols that no
language has seen after a context of three bytes are few and cost their escape and the code length after two bytes.

Learning reads every labelled document. All contexts are kept: the model has a row for each different window of four
bytes that the learned texts have, and only these windows' counts, a Spark aggregation, reach the driver. Every
document is scored whole.

A text is lower-cased and its runs of letters (Unicode categories L) are joined by single spaces. Null text, or text without a letter, is
`und` with score 0. Rows with a null doc_id are scored but never learned from. Ties go to the first language in
alphabetical order. Without any labelled row every text is `und`. Other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, table

_LETTERS = re.compile(r"[^\W\d_]+")
#: Word characters that are numbers, as of fractions and Roman numerals, and no letters: few texts have one.
_NUMBERS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
_NUMBER = re.compile("[" + "".join(_NUMBERS) + "]")
_MAYBE_NUMBER = re.compile("[" + "".join(c for c in _NUMBERS if c < "\U00010000") + "]|[\U00010000-\U0010ffff]")
ORDER = 3
#: Languages beyond this number are an error: the model table grows with them.
MAX_LANGUAGES = 200


def normalise(text: str | None) -> bytes:
    words = " ".join(_LETTERS.findall(text.lower())) if text else ""
    return (" ".join(_NUMBER.sub(" ", words).split()) if not words.isascii() and _MAYBE_NUMBER.search(words) else words).encode()


def held_out(remainders: int = 4, held: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(remainders)) == held, F.lit(False))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): windows of four bytes, as big-endian numbers; a text begins after three spaces."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4 << 20):
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t := normalise(text):
                    of.setdefault(lang, []).append(b"   " + t + b" ")
            for lang, texts in of.items():
                x = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
                inside = np.ones(len(x) - 3, bool)
                ends = np.cumsum([len(t) for t in texts[:-1]], dtype=np.int64)
                inside[(ends[:, None] - np.arange(1, 4)).ravel()] = False  # no window reaches into the next text
                gram, n = np.unique(((x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:])[inside], return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # byte -> class; 0 for bytes never seen
    context: np.ndarray  # three classes, oldest first -> context, the longest that was seen
    shorter: np.ndarray  # context -> the same less its oldest byte
    cell: np.ndarray  # context, class -> row of bits; -1 if no language has seen it there
    bits: np.ndarray  # row, language -> code length
    escape: np.ndarray  # context, language -> code length of the escape; 0 where the language has not seen the context

    @staticmethod
    def of(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
        """From counts n of windows of four bytes (big-endian) by place of the language."""
        n = n.astype(np.float64)
        seen = np.unique(np.concatenate([(gram >> s) & 255 for s in (0, 8, 16, 24)]))
        classes = np.zeros(256, np.int64)
        classes[seen] = np.arange(1, len(seen) + 1)
        a, many = len(seen) + 1, max(1, len(languages))
        last, b1, b2, b3 = (classes[(gram >> s) & 255] for s in (0, 8, 16, 24))

        def tree(context: np.ndarray, contexts: int, shorter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Rows context * a + class that were seen, their probabilities, and the escape of each context; shorter gives the probabilities of rows in the next shorter contexts."""
            rows, row_of = np.unique(context * a + last, return_inverse=True)
            count = np.bincount(row_of * many + lang, n, len(rows) * many).reshape(-1, many)
            at = rows // a
            sums = lambda x: np.bincount((at[:, None] * many + np.arange(many)).ravel(), x.ravel(), contexts * many).reshape(-1, many)
            total, kinds = sums(count), sums((count > 0).astype(np.float64))
            escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            p = np.where(count > 0, count / np.maximum(total + kinds, 1)[at], escape[at] * shorter(rows))
            return rows, p.astype(np.float32), escape.astype(np.float32)

        def lookup(rows: np.ndarray, p: np.ndarray, escape: np.ndarray, shorter):
            """Probabilities of any rows of a tree, seen or not; shorter as in tree()."""

            def of(wanted: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(rows, wanted), max(0, len(rows) - 1))
                hit = rows[at] == wanted if len(rows) else np.zeros(len(wanted), bool)
                found = escape[wanted // a] * shorter(wanted)
                found[hit] = p[at[hit]]
                return found

            return of

        flat = lambda rows: np.full((len(rows), many), 1 / 256, np.float32)
        none = lambda rows: rows % a  # noqa: E731  the empty context
        t0 = tree(np.zeros(len(gram), np.int64), 1, flat)
        p0 = lookup(*t0, flat)
        t1 = tree(b1, a, lambda rows: p0(none(rows)))
        p1 = lookup(*t1, lambda rows: p0(none(rows)))
        pairs, pair_of = np.unique(b2 * a + b1, return_inverse=True)
        down2 = lambda rows: p1(pairs[rows // a] % a * a + rows % a)
        t2 = tree(pair_of, len(pairs), down2)
        p2 = lookup(*t2, down2)
        triples, triple_of = np.unique((b3 * a + b2) * a + b1, return_inverse=True)
        pair_at = np.full(a * a, -1)
        pair_at[pairs] = np.arange(len(pairs))
        down3 = lambda rows: p2(pair_at[triples[rows // a] % (a * a)] * a + rows % a)
        t3 = tree(triple_of, len(triples), down3)

        # Contexts of one byte have every row, so that an escape from a longer one ends there at the latest.
        all1 = np.arange(a * a)
        base = np.array([0, a, a + len(pairs)])
        rows = np.concatenate([all1, t2[0] + base[1] * a, t3[0] + base[2] * a])
        bits = -np.log2(np.concatenate([p1(all1), t2[1], t3[1]]))
        cell = np.full((base[2] + len(triples)) * a, -1, np.int32)
        cell[rows] = np.arange(len(rows))
        shorter = np.concatenate([np.arange(a), pairs % a, base[1] + pair_at[triples % (a * a)]])
        escape = np.concatenate([np.ones((a, many)), t2[2], t3[2]])
        context = np.broadcast_to(np.arange(a), (a, a, a)).copy()
        two = np.where(pair_at >= 0, pair_at + base[1], -1).reshape(a, a)
        context = np.where(two[None] >= 0, two[None], context).reshape(-1)
        context[triples] = base[2] + np.arange(len(triples))
        return Model(languages, classes, context.astype(np.int32), shorter.astype(np.int32), cell, bits.astype(np.float32), -np.log2(escape).astype(np.float32))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (none empty) under each language."""
        a = len(self.cell) // len(self.shorter)
        x = self.classes[np.frombuffer(b"".join(b"   " + t for t in texts), np.uint8)]
        at = self.context[(x[:-3] * a + x[1:-2]) * a + x[2:-1]].astype(np.int64)
        row = self.cell[at * a + x[3:]]
        cost = self.bits.take(row, axis=0)
        left = np.flatnonzero(row < 0)
        cost[left] = 0
        where, symbol = at[left], x[3:][left]
        while len(left):
            cost[left] += self.escape[where]
            where = self.shorter[where].astype(np.int64)
            row = self.cell[where * a + symbol]
            cost[left[row >= 0]] += self.bits[row[row >= 0]]
            left, where, symbol = left[row < 0], where[row < 0], symbol[row < 0]
        ends = np.cumsum([len(t) + 3 for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        if len(texts) > 1:  # the windows that end in the next text's padding code no byte of a text
            cost[(starts[1:, None] - 3 + np.arange(3)).ravel()] = 0
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)


def learnable():
    """Rows of (doc_id, text, lang) that have what is learned from."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()


def train(labelled: DataFrame) -> Model:
    """Learn from all of labelled (doc_id, text, lang)."""
    usable = labelled.filter(learnable())
    if len(usable.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = gram_counts(usable).toArrow()  # a row for each language and different window of four bytes
    languages, lang = np.unique(rows["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    return Model.of(languages.tolist(), lang, rows["gram"].to_numpy(), rows["n"].to_numpy())


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score, the posterior of that language under equal priors, and lettered, whether the text has a letter, and bits, the code length a byte under that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double", "lettered boolean", "bits double"])
    names = [f.name for f in fields] + ["lang_pred", "score", "lettered", "bits"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(it, 1 << 20):
            texts = [normalise(t) for t in b.column(len(fields)).to_pylist()]
            lang, score, cost = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            where = [i for i, t in enumerate(texts) if t]
            if where and m.languages:
                bits = m.code_lengths([texts[i] for i in where])
                best = bits.argmin(axis=1)
                p = 1 / np.exp2(bits[np.arange(len(best)), best][:, None] - bits).sum(axis=1)
                for j, (i, k) in enumerate(zip(where, best, strict=True)):
                    lang[i], score[i], cost[i] = m.languages[k], float(p[j]), float(bits[j, k]) / len(texts[i])
            yield pa.record_batch([*b.columns[: len(fields)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([bool(t) for t in texts], pa.bool_()), pa.array(cost, pa.float64())], names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def cost_limits(judged: DataFrame, share: float = 0.9, times: float = 2.0) -> dict[str, float]:
    """By language, the most bits a byte that a text of it may cost: `times` what `share` of the learned texts cost at most.

    judged (lang_pred, bits) has a row for each of them. Costs are counted in steps of 1/1024 bit, rounded up, so that
    the limits are exact counts over all rows and do not depend on the split. Noise, program code and scripts that were
    not learned cost several times as much as a learned language, and the posterior, which only compares languages,
    cannot tell.
    """
    steps = judged.filter("bits is not null").groupBy("lang_pred", F.ceil(F.col("bits") * 1024).alias("step")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("lang_pred")
    reached = steps.withColumns({"below": F.sum("n").over(of.orderBy("step")), "all": F.sum("n").over(of)}).filter(F.col("below") >= F.col("all") * share)
    return {r["lang_pred"]: r["step"] / 1024 * times for r in reached.groupBy("lang_pred").agg(F.min("step").alias("step")).collect()}  # a row for each language


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
