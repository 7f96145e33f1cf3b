"""Language-model scores of documents by a small causal self-attention model (operator 3).

First, all words of the learning documents are counted in Spark, and from these the subword ids and their pairs within
words. Then the model is fitted on all text of the learning documents, in ROUNDS rounds over shares of them. Documents are
dealt to parts of about PART_WORDS words and to rounds by a hash of their id and text. In a round, Adam steps in numpy run over all
windows of a part's documents, in order of the hash, from the common parameters; then the parts' parameters are
averaged, weighted by tokens, an embedding by how often the part read its id. Parts and their order are a function
of the rows alone, so the scores do not depend on how the input is split or on the number of tasks. Last, every document is
scored whole.

A subword id is predicted as its class, by the model, times its share of the class, from the counts after the class
before it in its word, smoothed by the counts as a whole. The most frequent ids are classes of their own; the others fill classes
of about equal weight, apart for ids that start a word and ids that go on with one. Ids never seen are in the last
class of their kind. The model has one layer: subword and position embeddings, one causal attention head over CONTEXT positions, a residual and
a softmax over classes. A document is cut into overlapping windows, each predicting its last STRIDE tokens, so that
each token is scored once, with CONTEXT - STRIDE tokens or more before it.

The base score is that of a unigram model with add-one smoothing over words. It gives every unseen word, and there are
many, the same share, and so is no distribution over texts, as the model is, which must spell them. Counts of the most frequent words, at
most VOCABULARY, go to the tasks; the other words of each document are joined with the counts.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; each is tokenised with a space before it. Null, empty or wordless
text is the end token alone. Rows with a null doc_id are learned from. Repeated rows count and are returned each. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, bound_batches, drop_stored, stored, table
from .subwords import Subwords, ranked_encoding, tokenizer_path

END_ID, IDS = 50_256, 50_257
SINGLES, BINS, WIDTH = 96, 16, 16
CONTEXT, STRIDE = 32, 24
ROUNDS, BATCH, RATE = 4, 32, 0.02
#: Words of a part, and parts at most; beyond that parts grow.
PART_WORDS, PARTS = 2_000_000, 16_384
#: Input that stands before a text; it has an embedding after those of the ids.
BEFORE = IDS
#: Weight, in tokens, of the share over all contexts in the share after a class.
SMOOTH = 4.0
VOCABULARY = 400_000


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


@cache
def _encoding(path: str):
    return ranked_encoding(path)


class WordIds(dict):
    """Subword ids of a lower-cased word after a space, as bytes, remembered up to a bound."""

    def __init__(self, path: str, bound: int = 400_000):
        super().__init__()
        self.path, self.encode, self.bound = path, _encoding(path).encode_ordinary, bound

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        ids = self[word] = array("I", self.encode(" " + word.decode())).tobytes()
        return ids

    def all(self, words: list[bytes]) -> list[bytes]:
        """Those of different words."""
        if len(self) + len(words) > self.bound:
            self.clear()
        new = [w for w in words if w not in self]
        self.update(zip(new, encode_words(self.path, new), strict=True))
        return list(map(self.__getitem__, words))


#: White space of the tokenizer's pattern that words may hold; next to it a word is not split as it is alone.
_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@cache
def _begins(path: str) -> np.ndarray:
    return np.array([_encoding(path).decode_single_token_bytes(i)[:1] == b" " for i in range(END_ID)])


def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """Subword ids of each lower-cased word after a space, as bytes, from one call for all: only an id that starts a word begins with a space."""
    if not words:
        return []
    encode, texts = _encoding(path).encode_ordinary, [w.decode() for w in words]
    text = " ".join(["", *texts])
    if b"" in words or _SPACE.search(text):
        plain = [w for w, t in zip(words, texts, strict=True) if t and not _SPACE.search(t)]
        known = dict(zip(plain, encode_words(path, plain), strict=True))
        return [known[w] if w in known else array("I", encode(" " + t)).tobytes() for w, t in zip(words, texts, strict=True)]
    ids = np.array(encode(text), "<u4")
    starts = np.append(np.flatnonzero(_begins(path)[ids]) * 4, len(ids) * 4).tolist()
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip(starts, starts[1:], strict=False)]


@cache
def _word_ids(path: str) -> WordIds:
    """Kept by a worker for all its tasks."""
    return WordIds(path)


def _keys(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class Words:
    """The different words of several texts, and which of them stands where; what is known of a word is looked up once."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        own = split.flatten().dictionary_encode()
        codes = own.indices.to_numpy()
        lengths = split.value_lengths().to_numpy().astype(np.int64)
        # White space before or after a text leaves an empty word there, the same that stands for the end of a text below.
        empty = own.dictionary.index("").as_py()
        if empty >= 0:
            filled = codes != empty
            lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[filled], minlength=len(lengths))
            codes = codes[filled]
        self.different, self.end = own.dictionary, empty
        if empty < 0:
            self.different, self.end = pa.concat_arrays([own.dictionary, pa.array([""], own.dictionary.type)]), len(own.dictionary)
        self.lengths = lengths + 1
        self.text = np.repeat(np.arange(len(lengths)), self.lengths)
        self.codes = np.full(len(self.text), self.end, np.int64)
        if len(codes):
            self.codes[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes

    @cached_property
    def keys(self) -> list[bytes]:
        return _keys(self.different)

    def counts(self) -> pa.Table:
        """(word, c); the empty word is the end of a text."""
        c = np.bincount(self.codes, minlength=len(self.different))
        return pa.table({"word": self.different.cast(pa.string()), "c": c}).filter(pa.array(c > 0))

    def ids(self, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of all texts, each ended, and how many each text has."""
        raw = known.all(self.keys[: self.end] + self.keys[self.end + 1 :])
        raw.insert(self.end, _END)
        many = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        table = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
        each = many[self.codes]
        before = np.cumsum(each) - each
        place = np.repeat((np.cumsum(many) - many)[self.codes] - before, each)
        place += np.arange(len(place))
        return table[place], np.bincount(self.text, each, len(self.lengths)).astype(np.int64)


_END = END_ID.to_bytes(4, "little")


def _added(found: Iterator[pa.Table], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Tables of (key, count), with the counts of equal keys added; a task holds about `most` keys, or twice what one table has."""
    held, rows = [], 0

    def added() -> pa.Table:
        name, n = held[0].column_names
        return pa.concat_tables(held).group_by(name, use_threads=False).aggregate([(n, "sum")]).rename_columns([name, n])

    for t in found:
        held.append(t)
        rows += len(t)
        if rows > 2 * most:
            held = [added()]
            rows = len(held[0])
            if rows > most:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from added().to_batches()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts; the empty word is the end of a text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added(Words(b.column(0)).counts() for b in batches(it))

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pairs(words: DataFrame, path: str) -> DataFrame:
    """(pair, n): how often each subword id follows each within a word; pair is before * IDS + id, END_ID before a word's first."""

    def counts(b: pa.RecordBatch) -> pa.Table:
        own = b.filter(pc.not_equal(b.column(0), ""))
        raw = encode_words(path, _keys(own.column(0)))
        many = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
        pairs = np.append(END_ID, ids[:-1])[: len(ids)] * IDS + ids
        starts = np.cumsum(many) - many
        pairs[starts] = END_ID * IDS + ids[starts]
        ends = b.filter(pc.equal(b.column(0), "")).column(1)
        n = np.repeat(own.column(1).to_numpy(), many)
        return pa.table({"pair": np.append(pairs, np.full(len(ends), END_ID * IDS + END_ID)), "n": np.append(n, ends.to_numpy())})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added(map(counts, batches(it, 1 << 20)))

    return words.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Classes:
    """Class of each subword id, and the log10 share of an id in its class after another of its word. Class 0 stands before a text, and before a word in the shares."""

    def __init__(self, counts: np.ndarray, starts_word: np.ndarray):
        self.begins = starts_word.astype(bool)
        self.begins[END_ID] = True
        order = np.lexsort((np.arange(IDS), -counts))
        self.of = np.zeros(IDS, np.int16)
        self.of[order[:SINGLES]] = np.arange(1, SINGLES + 1)
        for kind in (0, 1):
            rest = order[SINGLES:]
            rest = rest[starts_word[rest] == kind]
            below = np.cumsum(counts[rest]) - counts[rest]
            self.of[rest] = 1 + SINGLES + kind * BINS + np.where(counts[rest] > 0, below * BINS // max(1, counts[rest].sum()), BINS - 1)
        self.n = SINGLES + 2 * BINS + 1
        self.of_input = np.append(self.of, np.int16(0))
        weight = np.where(counts > 0, counts, 0.5)
        total = np.bincount(self.of, weight, self.n)
        self.share = weight / total[self.of]

    def shares_after(self, before: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 share of each id after each class; the arguments are the columns of count_cells()."""
        cells, n = before.astype(np.int64) * IDS + ids, n.astype(np.float64)
        pair = np.bincount(before.astype(np.int64) * self.n + self.of[ids], n, self.n * self.n).reshape(self.n, self.n)
        table = np.tile(SMOOTH * self.share, (self.n, 1))
        table.ravel()[cells] += n
        for c in range(self.n):
            table[c] /= pair[c][self.of] + SMOOTH
        return np.log10(table).astype(np.float32)


    def prior_after(self, last: np.ndarray, of: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log of each class's probability after each input; the first three arguments are the columns of count_followers().

        What follows a word's last id are the classes that start words.
        """
        table = np.zeros((IDS + 1, self.n))
        table[last, of] = n
        total = np.bincount(self.of, np.where(counts > 0, counts, 0.5), self.n)
        starts = np.bincount(self.of[self.begins], np.where(counts > 0, counts, 0.5)[self.begins], self.n)
        ends = np.append(np.maximum(counts - table[:IDS].sum(axis=1), 0), 1.0)
        table += ends[:, None] * (starts / starts.sum())
        table += SMOOTH * (total / total.sum())
        np.maximum(table, 1e-9, out=table)
        return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def count_followers(pairs: DataFrame, classes: Classes) -> DataFrame:
    """(last, of, n): counts of count_pairs() by the class of an id, within words; IDS * classes.n rows at most."""
    of = pa.table({"id": np.arange(IDS, dtype=np.int64), "of": classes.of.astype(np.int32)})
    split = pairs.select(F.expr(f"pair div {IDS}").alias("last"), (F.col("pair") % IDS).alias("id"), "n").filter(F.col("last") != END_ID)
    joined = split.join(F.broadcast(pairs.sparkSession.createDataFrame(of)), "id")  # one row for each id of the tokenizer
    return joined.groupBy("last", "of").agg(F.sum("n").alias("n"))


def count_cells(pairs: DataFrame, classes: Classes) -> DataFrame:
    """(before, id, n): counts of count_pairs() by the class before an id, 0 before a word's first; classes.n * IDS rows at most."""
    of = pa.table({"last": np.arange(IDS, dtype=np.int64), "before": np.where(np.arange(IDS) == END_ID, 0, classes.of).astype(np.int32)})
    split = pairs.select(F.expr(f"pair div {IDS}").alias("last"), (F.col("pair") % IDS).cast("int").alias("id"), "n")
    joined = split.join(F.broadcast(pairs.sparkSession.createDataFrame(of)), "last")
    return joined.groupBy("before", "id").agg(F.sum("n").alias("n"))


class Model:
    """One causal attention head over subword and position embeddings, in float32 numpy."""

    SHAPES = (("emb", None, WIDTH), ("pos", CONTEXT, WIDTH), ("wq", WIDTH, WIDTH), ("wk", WIDTH, WIDTH), ("wv", WIDTH, WIDTH), ("out", WIDTH, None), ("bias", 1, None))

    def __init__(self, n: int, flat: np.ndarray | None = None, prior: np.ndarray | None = None, inputs: int = IDS + 1, odds: np.ndarray | None = None):
        """prior, a row for each input, or its exponential odds."""
        self.n, self.prior = n, prior
        shapes = [(name, inputs if name == "emb" else a or n, b or n) for name, a, b in self.SHAPES]
        size = sum(a * b for _, a, b in shapes)
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.2, size).astype(np.float32)
            flat[-n * (WIDTH + 1) :] *= 0.1  # the model begins close to the prior
        self.flat, at = flat.astype(np.float32, copy=True), 0
        for name, a, b in shapes:
            setattr(self, name, self.flat[at : at + a * b].reshape(a, b))
            at += a * b
        self.dense = self.flat[inputs * WIDTH :]
        self.head = self.flat[-n * (WIDTH + 1) :].reshape(WIDTH + 1, n)  # out and, below it, bias
        late = np.arange(CONTEXT)[None, :] > np.arange(CONTEXT - STRIDE, CONTEXT)[:, None]
        self.mask = np.where(late, np.float32(0), np.float32(1))
        self.odds = odds if prior is None else np.exp(prior)
        self.slope: Model | None = None
        self.kept = np.empty((2, 0, n), np.float32)
        self.ones = np.ones(max(n, 2 * BATCH, CONTEXT), np.float32)

    def forward(self, x: np.ndarray):
        """Of the last STRIDE positions of windows x of subword ids: attention before it is divided by its sums, what it reads, and the hidden state with a 1 behind it."""
        h = self.emb.take(x, axis=0)
        h += self.pos
        turned = np.concatenate([self.wq * np.float32(WIDTH**-0.5), self.wk, self.wv], axis=1)
        qkv = (h.reshape(-1, WIDTH) @ turned).reshape(len(x), CONTEXT, -1)
        q, k, v = qkv[:, CONTEXT - STRIDE :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
        a = np.matmul(q, k.transpose(0, 2, 1))
        np.minimum(a, np.float32(60), out=a)
        np.exp(a, out=a)
        a *= self.mask
        part = np.reciprocal(a.reshape(-1, CONTEXT) @ self.ones[:CONTEXT])[:, None]
        read = np.matmul(a, v).reshape(-1, WIDTH)
        read *= part
        hidden = np.empty((len(read), WIDTH + 1), np.float32)
        hidden[:, WIDTH] = 1
        np.add(h[:, CONTEXT - STRIDE :], read.reshape(len(x), STRIDE, WIDTH), out=hidden[:, :WIDTH].reshape(len(x), STRIDE, WIDTH))
        return h, q, k, v, a, part, read, hidden

    def logits(self, x: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """What the counts after the last input say, moved by the hidden state."""
        z = hidden @ self.head
        if self.odds is not None:
            z += np.log(self.odds.take(x[:, CONTEXT - STRIDE :].ravel(), axis=0))
        return z

    def weights(self, x: np.ndarray, y: np.ndarray, hidden: np.ndarray, each: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A weight for each class, unless each is False, their sum, and the log of the weight of y, by target; the first is overwritten by the next call.

        The counts come in as factors of exponentials; where these leave the range of float32, all is taken from the largest logit.
        """
        rows, at = len(hidden), y.ravel() + np.arange(0, len(hidden) * self.n, self.n)
        if self.kept.shape[1] < rows:
            self.kept = np.empty((2, rows, self.n), np.float32)  # new pages for each batch would cost as much as the sums
        z, odds = self.kept[:, :rows]
        np.matmul(hidden, self.head, out=z)
        log = z.ravel().take(at)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(z, out=z)
            if self.odds is None:
                total = z @ self.ones[: self.n]
            else:
                self.odds.take(x[:, CONTEXT - STRIDE :].ravel(), axis=0, out=odds, mode="clip")
                log += np.log(odds.ravel().take(at))
                if each:
                    z *= odds
                    total = z @ self.ones[: self.n]
                else:
                    total = np.vecdot(z, odds)
        if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30):
            z[:] = self.logits(x, hidden)
            z -= z.max(axis=1, keepdims=True)
            log = z.ravel().take(at)
            np.exp(z, out=z)
            total = z.sum(axis=1)
        return z, total, log

    def log_probabilities(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability, (windows, STRIDE)."""
        _, total, log = self.weights(x, y, self.forward(x)[-1], each=False)
        return (log - np.log(total)).reshape(y.shape)

    def gradient(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Gradient of the mean loss over the real targets."""
        dense, ids, rows = self.gradients(x, y, real)
        flat = np.zeros_like(self.flat)
        flat[-len(dense) :] = dense
        flat[: -len(dense)].reshape(-1, WIDTH)[ids] = rows
        return flat

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """That gradient of `dense`, overwritten by the next call, and the ids in x with that of each one's embedding."""
        h, q, k, v, a, part, read, hidden = self.forward(x)
        z, total, _ = self.weights(x, y, hidden)
        g = self.slope = self.slope or Model(self.n, np.zeros_like(self.dense), inputs=0)
        z.ravel()[y.ravel() + np.arange(0, z.size, self.n)] -= total
        share = (real.ravel() / (np.float32(max(1, real.sum())) * total))[:, None]  # z is scaled where it is narrow
        hidden *= share
        np.matmul(hidden.T, z, out=g.head)
        d_hidden = z @ self.out.T
        d_hidden *= share
        d_part = d_hidden * part
        inner = (d_part * read) @ self.ones[:WIDTH]
        shape = (len(x), STRIDE, -1)
        late, d_part = slice(CONTEXT - STRIDE, CONTEXT), d_part.reshape(shape)
        d_s = np.matmul(d_part, v.transpose(0, 2, 1))
        d_s -= inner.reshape(shape)
        d_s *= a
        d_qkv = np.zeros((len(x), CONTEXT, 3 * WIDTH), np.float32)
        np.matmul(d_s, k, out=d_qkv[:, late, :WIDTH])
        np.matmul(d_s.transpose(0, 2, 1), q, out=d_qkv[:, :, WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), d_part, out=d_qkv[:, :, 2 * WIDTH :])
        rows, scale = d_qkv.reshape(-1, 3 * WIDTH), np.float32(WIDTH**-0.5)
        d_w = h.reshape(-1, WIDTH).T @ rows
        g.wq[:], g.wk[:], g.wv[:] = d_w[:, :WIDTH] * scale, d_w[:, WIDTH : 2 * WIDTH], d_w[:, 2 * WIDTH :]
        d_h = rows @ np.concatenate([self.wq.T * scale, self.wk.T, self.wv.T])
        d_h = d_h.reshape(h.shape)
        d_h[:, late] += d_hidden.reshape(shape)
        g.pos[:] = (self.ones[: len(x)] @ d_h.reshape(len(x), -1)).reshape(CONTEXT, WIDTH)
        bits = x.size.bit_length()
        flat = np.sort((x.ravel().astype(np.int64) << bits) | np.arange(x.size))  # by id, then place
        order = flat & ((1 << bits) - 1)
        flat >>= bits
        ends = np.append(np.flatnonzero(flat[1:] != flat[:-1]), len(flat) - 1)
        return g.flat, flat[ends], sums(d_h.reshape(-1, WIDTH).take(order, axis=0), ends)


def sums(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, each up to one of the ends."""
    starts = np.append(0, ends[:-1] + 1)
    return np.add.reduceat(rows.view(np.complex64), starts).view(np.float32)  # two at a time


def windows(ids: list[bytes], of: np.ndarray):
    """Windows of several texts, each given by the bytes of its ids."""
    return windows_of(np.frombuffer(b"".join(ids), "<u4").astype(np.int32), np.array([len(t) // 4 for t in ids]), of)


def windows_of(own: np.ndarray, lengths: np.ndarray, of: np.ndarray):
    """Windows of several texts, given by all ids and the lengths: input ids, target classes, targets that are tokens, target ids, text of each window.

    Before a text stand CONTEXT - STRIDE + 1 places of BEFORE; its last window is filled up.
    """
    blocks = -(-lengths // STRIDE)
    lead = CONTEXT - STRIDE + 1
    size = lead + blocks * STRIDE
    starts = np.cumsum(size) - size
    flat = np.full(int(size.sum()), -1, np.int32)
    flat[np.repeat(starts + lead - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(own))] = own
    text = np.repeat(np.arange(len(lengths)), blocks)
    first = np.repeat(starts - (np.cumsum(blocks) - blocks) * STRIDE, blocks) + np.arange(len(text)) * STRIDE
    classes = np.where(flat >= 0, of[flat], 0).astype(np.int16)
    inputs = np.where(flat >= 0, flat, BEFORE)
    view = np.lib.stride_tricks.sliding_window_view
    target = view(flat, STRIDE)[first + lead]
    return view(inputs, CONTEXT)[first], view(classes, STRIDE)[first + lead], target >= 0, target, text


def packed(table: np.ndarray) -> tuple[tuple[int, ...], bytes]:
    """A float32 table for a broadcast: each copy lies on a disk, of the driver and of every executor, and most rows of a table over all ids are alike."""
    return table.shape, zlib.compress(np.ascontiguousarray(table, np.float32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(shape: tuple[int, ...], raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(np.float32).reshape(shape)


class Packed:
    """A packed table; a worker unpacks it once for all its tasks."""

    def __init__(self, table: np.ndarray):
        self.parts = packed(table)

    @cached_property
    def table(self) -> np.ndarray:
        return unpacked(*self.parts)


FITTED = "part int, dense binary, tokens long, ids binary, rows binary, uses binary"


def fit(docs: DataFrame, path: str, classes: Classes, prior: np.ndarray, words: int) -> np.ndarray:
    """Parameters learned from docs(doc_id, text) of so many words, averaged over parts after each round."""
    params = Model(classes.n).flat
    names = [c.split()[0] for c in FITTED.split(", ")]
    parts = int(min(max(1, -(-words // PART_WORDS)), PARTS))
    groups = int(np.ceil(np.sqrt(parts)))
    key = F.xxhash64("doc_id", "text")
    dealt = docs.select("doc_id", "text", key.alias("key"), F.pmod(key, F.lit(parts)).cast("int").alias("part"), F.pmod(F.shiftright(key, 40), F.lit(ROUNDS)).alias("round"))

    def row(part: int, dense: np.ndarray, tokens: int, emb: np.ndarray, uses: np.ndarray) -> pa.RecordBatch:
        ids = np.flatnonzero(uses)
        raw = [pa.array([x.tobytes()]) for x in (dense.astype(np.float32), ids, emb[ids].astype(np.float32), uses[ids])]
        return pa.record_batch([pa.array([part], pa.int32()), raw[0], pa.array([tokens], pa.int64()), *raw[1:]], names)

    def average(rows: Iterable[tuple]) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """Weighted averages of the dense parameters and the embeddings, and the sums of the weights."""
        dense, tokens, emb, uses = 0.0, 0, np.zeros((IDS + 1, WIDTH)), np.zeros(IDS + 1, np.int64)
        for _, raw, n, ids, own, many in rows:
            ids, many = np.frombuffer(ids, np.int64), np.frombuffer(many, np.int64)
            dense, tokens = dense + np.frombuffer(raw, np.float32) * np.float64(n), tokens + n
            emb[ids] += np.frombuffer(own, np.float32).reshape(-1, WIDTH) * many[:, None]
            uses[ids] += many
        return dense / tokens, tokens, emb / np.maximum(uses, 1)[:, None], uses

    def by_part(it: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[int, list[str | None]]]:
        """The texts of each part in order, cut by their own sizes only, so that batches do not depend on what shares the task."""
        part, texts, size = None, [], 0
        for b in batches(it, 4 << 20):
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if texts and (p != part or size >= most):
                    yield part, texts
                    texts, size = [], 0
                part = p
                texts.append(t)
                size += len(t or "")
        if texts:
            yield part, texts

    spark = docs.sparkSession
    counted = spark.sparkContext.broadcast((classes, Packed(np.exp(prior))))
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(params)
        pace = RATE * (1 - r / (2 * ROUNDS))

        def run(it: Iterator[pa.RecordBatch], shared=shared, pace=pace) -> Iterator[pa.RecordBatch]:
            (kinds, odds), start = counted.value, shared.value
            known, at = _word_ids(path), None
            for part, texts in by_part(it):
                if part != at:
                    if at is not None:
                        yield row(at, model.dense, tokens, model.emb, uses)
                    at, model = part, Model(kinds.n, start, odds=odds.table)
                    m, s, m_emb, s_emb = (np.zeros_like(x) for x in (model.dense, model.dense, model.emb, model.emb))
                    step, tokens, uses = 0, 0, np.zeros(IDS + 1, np.int64)
                x, y, real, _, _ = windows_of(*Words(pa.array(texts, pa.string())).ids(known), kinds.of)
                uses += np.bincount(x.ravel(), minlength=IDS + 1)
                tokens += int(real.sum())
                order = np.random.default_rng(step).permutation(len(x))
                x, y, real = x[order], y[order], real[order]
                for i in range(0, len(x), BATCH):
                    g, ids, rows = model.gradients(x[i : i + BATCH], y[i : i + BATCH], real[i : i + BATCH])
                    step += 1
                    rate, fade = np.float32(pace / (1 - 0.9**step)), np.float32(1 / (1 - 0.99**step))
                    m += (g - m) * np.float32(0.1)
                    s += (g * g - s) * np.float32(0.01)
                    model.dense -= rate * m / (np.sqrt(s * fade) + np.float32(1e-8))
                    m_rows, s_rows = m_emb.take(ids, axis=0), s_emb.take(ids, axis=0)  # only embeddings that were read move
                    m_rows += (rows - m_rows) * np.float32(0.1)
                    rows *= rows
                    s_rows += (rows - s_rows) * np.float32(0.01)
                    m_emb[ids], s_emb[ids] = m_rows, s_rows
                    model.emb[ids] -= rate * m_rows / (np.sqrt(s_rows * fade) + np.float32(1e-8))
            if at is not None:
                yield row(at, model.dense, tokens, model.emb, uses)

        def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each group of parts, added in order of the parts."""
            rows = (x for b in it for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
            for group, own in groupby(rows, lambda x: x[0] % groups):
                yield row(group, *average(own))

        own = dealt.filter(F.col("round") == r).repartition(parts, "part").sortWithinPartitions("part", "key", "doc_id")
        fitted = own.select("part", "text").mapInArrow(run, FITTED)
        group = F.col("part") % groups
        merged = fitted.repartition(groups, group).sortWithinPartitions(group, "part").mapInArrow(merge, FITTED).collect()  # a row for each group
        shared.destroy()
        if merged:
            dense, _, emb, uses = average(sorted(map(tuple, merged)))
            kept = params[: -len(dense)].reshape(-1, WIDTH)
            params = np.concatenate([np.where(uses[:, None] > 0, emb, kept).ravel(), dense]).astype(np.float32)
    counted.destroy()
    return params


def _least(counts: DataFrame, column: str, rows: int) -> int:
    """The least count, 2 or more, that no more than `rows` rows reach."""
    least = 1 << 62
    for c, many in sorted(((r[column], r["count"]) for r in counts.filter(F.col(column) > 1).groupBy(column).count().collect()), reverse=True):
        if many > rows:
            break
        least, rows = c, rows - many
    return least


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, frequent_sum double, score double, rare array<string>"


def score(docs: DataFrame, learn: DataFrame, path: str | None = None) -> DataFrame:
    """Scores of all documents in docs(doc_id, text, held_out) by models of `learn`."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    bound_batches(spark)
    words = stored(count_words(learn), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, scale = total["n"], total["n"] + total["v"] + 1

    pairs = stored(count_pairs(words, path), "pairs")
    subword = np.zeros(IDS, np.int64)
    for r in pairs.groupBy((F.col("pair") % IDS).alias("id")).agg(F.sum("n").alias("n")).collect():  # at most one row for each id of the tokenizer
        subword[r["id"]] = r["n"]
    classes = Classes(subword, Subwords(tokenizer_path()).starts_word(IDS))
    cells = count_cells(pairs, classes).toArrow()
    shares = Packed(classes.shares_after(*(cells[c].to_numpy() for c in ("before", "id", "n"))))
    del cells
    followers = count_followers(pairs, classes).toArrow()
    prior = classes.prior_after(*(followers[c].to_numpy() for c in ("last", "of", "n")), subword)
    del followers
    params = fit(learn, path, classes, prior, n)
    drop_stored(pairs)

    least = _least(words, "c", VOCABULARY)
    often = words.filter(F.col("c") >= least).toArrow()
    frequent = dict(zip((w.encode() for w in often["word"].to_pylist()), np.log10((often["c"].to_numpy() + 1) / scale).tolist(), strict=True))
    del often
    shared = spark.sparkContext.broadcast((classes, params, Packed(np.exp(prior)), shares, frequent))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, flat, odds, share, known = shared.value
        model, word_ids = Model(kinds.n, flat, odds=odds.table), _word_ids(path)
        share, before = share.table.ravel(), kinds.of_input.astype(np.int64) * IDS
        for b in batches(it, 1 << 20):
            words = Words(b.column(3))
            log = np.fromiter((known.get(w, np.nan) for w in words.keys), np.float64, len(words.keys))
            rare = np.isnan(log)[words.codes]
            n_tokens, n_rare = words.lengths, np.bincount(words.text[rare], minlength=b.num_rows)
            sums = np.bincount(words.text, np.nan_to_num(log)[words.codes], b.num_rows)
            others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)), pa.int32()), words.different.take(pa.array(words.codes[rare])).cast(pa.string()))
            x, y, real, target, of_text = windows_of(*words.ids(word_ids), kinds.of)
            logs = np.empty(y.shape, np.float32)
            for i in range(0, len(x), 32):  # so few that a batch stays in cache
                logs[i : i + 32] = model.log_probabilities(x[i : i + 32], y[i : i + 32])
            cell = np.where(kinds.begins[target], 0, before[x[:, CONTEXT - STRIDE :]])
            cell += target
            logs = np.where(real, logs / np.log(10) + share.take(cell, mode="clip"), 0).sum(axis=1)
            scores = np.bincount(of_text, logs, b.num_rows)
            yield pa.record_batch([*b.columns[:3], pa.array(n_tokens, pa.int64()), pa.array(n_tokens - n_rare, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores), others], [c.split()[0] for c in SCORED.split(", ")])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    scored = stored(source.mapInArrow(run, SCORED), "scored")
    shared.destroy()
    others = scored.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
    others = others.groupBy("row").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(scale)))).alias("rare_sum"), F.count("c").alias("n_rare"))
    full = scored.drop("rare").join(others, "row", "left")
    return full.select("doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("frequent_sum") + F.coalesce("rare_sum", F.lit(0.0))).alias("base_score"), "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    return score(docs, docs.filter(~F.col("held_out")))
