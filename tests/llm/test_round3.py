"""Operators 11 to 13 against brute force, and on nulls, blanks, long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import pickle
import random
import re
import time
import types
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import binary_packing, centroids, divergence, html_text, lm_score
from sievework.llm.common import table
from sievework.llm.subwords import Subwords, tokenizer_path

from .test_operators import DATA, DOCS, odd_documents


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, "k", "d") for r in odd_documents()], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# Operator 11


def test_binary_cuts():
    for size in (1, 8, 1024):
        for n in range(1, 3 * size + 5):
            cuts = binary_packing.binary_cuts(n, size)
            assert sum(length for _, length in cuts) == n and [s for s, _ in cuts] == [sum(x for _, x in cuts[:i]) for i in range(len(cuts))]
            assert all(x & (x - 1) == 0 and x <= size for _, x in cuts) and len(cuts) == n // size + bin(n % size).count("1")


@pytest.mark.parametrize("part_rows", [3, 20_000])
def test_binary_packing_round_trip(odd, part_rows):
    ids_of = Subwords(tokenizer_path()).ids
    want = collections.Counter()
    for doc_id, text, *_ in odd_documents():
        ids = ids_of(text) + b"\0\0\0\0"
        want.update((doc_id, s, x, zlib.crc32(ids[4 * s : 4 * (s + x)]), len(ids) // 4) for s, x in binary_packing.binary_cuts(len(ids) // 4, 16))
    got = binary_packing.bucketed(odd, size=16, part_rows=part_rows).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    # Numbers are 0, 1, ... by bucket, long sequences first; a piece is a sequence.
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and {r["offset"] for r in got} == {0}
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)


def test_binary_packing_defaults(spark, none):
    got = binary_packing.op11_binary_packing(spark, DATA).collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    ids_of = Subwords(tokenizer_path()).ids
    tokens = collections.Counter()
    for r in got:
        tokens[r["doc_id"]] += r["length"]
        assert r["length"] <= 1024 and r["length"] & (r["length"] - 1) == 0
    assert tokens == {i: len(ids_of(t)) // 4 + 1 for i, t in docs.items()}
    assert binary_packing.bucketed(none).count() == 0
    with pytest.raises(ValueError):
        binary_packing.binary_pieces(none, tokenizer_path(), 1000)


# Operator 12


def brute_audit(docs, least, top):
    """docs: (text, lang, source); the result's rows by plain counting and exact integers."""
    docs = [tuple(x or "" for x in d) for d in docs]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(lower)), lang, source) for t, lang, source in docs]
    in_docs, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for ts, lang, source in found:
        in_docs.update((lang, t) for t in set(ts))
        counts[lang, source].update(ts)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for (x, t), n in in_docs.items() if x == lang and n >= least]
        sources = [s for x, s in counts if x == lang]
        size = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (size[s] + 5 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found_ in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found_, key=lambda x: (x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, -value, rank))
    return sorted(out, key=repr)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("how", [{}, {"shipped": 0}, {"widths": (1,), "block": 2}, {"widths": (1, 2, 3), "shipped": 5, "block": 1}])
def test_audit_equals_brute_force(spark, how):
    r = random.Random(5)
    words = ["a", "ab", "abc", "abcd", "Abcde", "été", "ÉTÉ", "日本", "日本語", "b", "ba", "x" * 70, "x" * 71, "don't", "nul\0byte", "tab\tend"]
    docs = [(" ".join(r.choices(words, k=r.randrange(0, 30))), r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "é", None])) for _ in range(300)]
    docs += [(None, "en", "only nulls"), ("", "de", "one"), ("99 --", "de", "two"), ("abc", None, "")]
    df = spark.createDataFrame([(i % 7, *d, "x", 1, "k") for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n int, items string")
    assert rows(divergence.audit(df.repartition(5), least=12, top=3, **how), *AUDIT) == brute_audit(docs, 12, 3)


def test_prefixes_are_counted_by_document(spark):
    # The prefix is in three documents, no term is; and six documents share a term whose sisters are rare.
    texts = ["abcdef abcxyz abcdef", "abcq", "abcr", *[f"stem stem{chr(97 + i)}" for i in range(6)]]
    df = spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string")
    found = divergence.level(divergence._texts(df), 3, 0, None, 3, 10)
    assert {bytes(r["prefix"]) for r in found.collect()} == {b"abc", b"ste"}
    keys, begins = divergence.prefix_keys([b"abcd  Ab", None, b"", b" x-\xc3\xa9"], 3)
    assert [int(k).to_bytes(3, "big") for k in keys] == [b"abc", b"ab\0", b"x\0\0", b"\xc3\xa9\0"] and begins.tolist() == [0, 2, 2, 2, 4]
    assert {bytes(r["term"]) for r in divergence.frequent_terms(df, 3).collect()} == {b"stem"}


def test_audit_of_nothing_and_odd(spark, odd, none):
    assert divergence.audit(none).count() == 0
    docs = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert rows(divergence.audit(odd, least=2), *AUDIT) == brute_audit(docs, 2, 50)
    assert rows(divergence.audit(odd), *AUDIT) == brute_audit(docs, 30, 50)  # no kept term: pairs of value 0


def test_shares_are_exact(spark):
    r = random.Random(1)
    cases = [(c, t) for t in (1, 7, 10**6, 2**53, 9 * 10**15) for c in (0, 1, t // 3, t - 1, t, r.randrange(t))]
    want = [1 + 10**9 * c // t for c, t in cases]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c long, t long")
    assert [x[0] for x in df.orderBy("i").select(divergence.share(F.col("c"), F.col("t"))).collect()] == want
    assert divergence.shares(np.array([c for c, _ in cases]), np.array([t for _, t in cases])).tolist() == want


# Operator 13


def brute_clusters(vectors, k, n_rounds, scale=256):
    """vectors: (id, components); plain Lloyd's with Python integers."""
    pts = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in vectors]
    key = lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1])
    cents = [p[1] for p in sorted(pts, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(n_rounds + 1):
        near = [min((far(p, c), j) for j, c in enumerate(cents)) for _, p in pts]
        if step == n_rounds:
            break
        for j in range(len(cents)):
            own = [p for (_, p), (_, a) in zip(pts, near, strict=True) if a == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    by = collections.Counter()
    for d, a in near:
        by[a] += d
    return sorted(((i, a, d, by[a], sum(by.values()), hashlib.sha256(",".join(map(str, cents[a])).encode()).hexdigest()) for (i, _), (d, a) in zip(pts, near, strict=True)), key=repr)


CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
VECTORS = "vec_id long, embedding array<float>, cluster string, point string"


@pytest.mark.parametrize("spread,k,rounds", [(0.05, 6, 5), (0.5, 12, 4), (3000.0, 5, 3), (0.0, 3, 2)])
def test_clusters_equal_brute_force(spark, spread, k, rounds):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(6, 64))
    vs = [(i, (middle[i % 6] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(200)]
    vs += [(i, vs[3][1]) for i in range(200, 240)] + [(3, vs[3][1]), (None, vs[5][1]), (None, vs[1][1])]  # copies, ties, repeats, nulls
    df = spark.createDataFrame([(*v, "c", "p") for v in vs], VECTORS).repartition(4)
    assert rows(centroids.clustered(df, clusters=k, rounds=rounds), *CLUSTERED) == brute_clusters(vs, k, rounds)


def test_unusable_vectors_are_left_out(spark):
    good = [0.5] * 64
    bad = [None, [], [0.5] * 63, [0.5] * 65, [None, *good[1:]], [float("nan"), *good[1:]], [float("inf"), *good[1:]], [*good[1:], float("-inf")]]
    df = spark.createDataFrame([(1, good, "c", "p"), *((i + 2, b, "c", "p") for i, b in enumerate(bad))], VECTORS)
    assert rows(centroids.clustered(df), *CLUSTERED) == brute_clusters([(1, good)], 40, 5)
    assert centroids.clustered(df.filter("vec_id > 1")).count() == 0
    huge = spark.createDataFrame([(1, [1e6] * 64, "c", "p")], VECTORS)
    with pytest.raises(Exception, match="component too large"):
        centroids.clustered(huge).collect()


def test_wide_integers_stay_exact():
    rng = np.random.default_rng(3)
    for high in (300, 1 << 22, (1 << 26) - 1):
        x, c = (rng.integers(-high, high, (n, 64), endpoint=True) for n in (5, 3))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
        assert centroids.squared_distances(x, c).tolist() == want


def test_tightened_bound_holds_and_is_tighter():
    rng = np.random.default_rng(11)
    below = 0
    for dim in (2, 3, 64):
        for _ in range(60):
            old = rng.integers(-200, 200, (5, dim))
            new = old + rng.integers(-60, 60, (5, dim)) * (rng.random((5, 1)) < 0.8)
            radius = rng.random(5) * 150
            most = centroids.tightened(old, new, radius)
            drift = np.sqrt(((new - old) ** 2).sum(1))
            for a in range(5):
                x = rng.normal(size=(400, dim))
                x = old[a] + x / np.linalg.norm(x, axis=1)[:, None] * radius[a] * rng.random((400, 1)) ** (1 / dim)
                nearer = [np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1) for j in range(5) if j != a]
                assert np.max(nearer) <= most[a] + 1e-9
                others = np.delete(drift, a).max()
                assert most[a] <= others * (1 + 1e-8)
                below += most[a] < 0.99 * others
    assert below > 300


def test_bounds_spare_most_comparisons(spark):
    state, _, _ = centroids.cluster(table(spark, "/root/testdata/sf0.01", "embeddings"))
    assert state.filter("not scanned").count() > 0.3 * state.count()


def test_sql_of_the_operators(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    for query, sql, columns in ((divergence.op12_source_divergence, divergence.oracle_sql(), AUDIT), (centroids.op13_centroid_clustering, centroids.oracle_sql(), CLUSTERED)):
        assert rows(query(spark, DATA), *columns) == sorted(con.execute(f"select {', '.join(columns)} from ({sql})").fetchall(), key=repr)


def test_counts_by_place_and_by_name_agree(spark, odd):
    docs = odd.unionByName(odd.withColumn("source", F.lit("other"))).repartition(3)
    terms = divergence.frequent_terms(docs, 2)
    by_name = rows(divergence.term_counts(docs, terms, shipped=0), "lang", "source", "term", "n")
    assert rows(divergence.term_counts(docs, terms, chunk=3), "lang", "source", "term", "n") == by_name and len(by_name) > 20


# Lines that repeat, and neighbours across partitions (operator 4)


def test_common_lines_of_repeated_lines():
    r = random.Random(8)

    def longest(a, b):
        d = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(d[j] + 1 if x == y else max(d[j + 1], new[j]))
            d = new
        return d[-1]

    for _ in range(300):
        k = r.choice([1, 2, 3, 9])
        a, b = ([r.choice("abcdefghi"[:k]) for _ in range(r.randrange(0, 150))] for _ in range(2))
        found = sorted(html_text.common_lines(a, b))
        left = iter(b)
        assert all(any(a[i] == y for y in left) for i in found) and len(found) == longest(a, b)
    began = time.process_time()
    assert len(html_text.common_lines(["x"] * 40_000, ["x"] * 39_999)) == 39_999
    assert len(html_text.common_lines(["x", "y"] * 10_000, ["y", "x", "x"] * 7_000)) > 15_000
    assert time.process_time() - began < 20


def test_neighbours_across_partitions(spark):
    rows = [(f"h{i // 7}", f"/p{i:03d}", i, i, [f"line {i}"]) for i in range(60)]
    df = spark.createDataFrame(rows, "host string, path string, page_id long, row long, own array<string>").repartition(9)
    got = {x["row"]: (x["before"], x["after"]) for x in html_text.with_neighbours(df).collect()}
    own = lambda i, j: [f"line {j}"] if 0 <= j < 60 and i // 7 == j // 7 else None
    assert got == {i: (own(i, i - 1), own(i, i + 1)) for i in range(60)}


def test_lm_probabilities_of_large_and_small_logits():
    """Weights beyond the range of float32 are taken from the largest logit, for the scores and for the gradient."""
    r, n = np.random.default_rng(0), 20
    x, y, real = r.integers(0, n, (3, lm_score.CONTEXT)), r.integers(0, n, (3, lm_score.STRIDE)), np.ones((3, lm_score.STRIDE), bool)
    prior = np.log(r.dirichlet(np.ones(n), lm_score.IDS + 1)).astype(np.float32)
    for shift in (-200.0, 0.0, 84.0, 200.0):
        m = lm_score.Model(n, prior=prior)
        m.bias[:] = shift + r.normal(0, 3, n)
        hidden = m.forward(x)[-1][:, : lm_score.WIDTH].astype(float)
        z = hidden @ m.out + m.bias[0] + prior[x[:, -lm_score.STRIDE :].ravel()]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        at = np.arange(len(z)), y.ravel()
        assert np.allclose(m.log_probabilities(x, y).ravel(), np.log(p)[at], atol=1e-3)
        p[at] -= 1
        assert np.allclose(m.gradient(x, y, real)[-n:], p.mean(axis=0), atol=1e-4)


def test_lm_workers_unpack_a_table_once():
    table = np.random.default_rng(1).normal(size=(7, 5)).astype(np.float32)
    sent = pickle.loads(pickle.dumps(lm_score.Packed(table)))
    assert np.array_equal(sent.table, table) and sent.table is sent.table
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    assert lm_score.WordIds(path).encode.__self__ is lm_score.WordIds(path, 1).encode.__self__


def test_lm_model_by_odds_equals_by_prior():
    r = np.random.default_rng(2)
    x, y = r.integers(0, 20, (3, lm_score.CONTEXT)), r.integers(0, 20, (3, lm_score.STRIDE))
    prior = np.log(r.dirichlet(np.ones(20), lm_score.IDS + 1)).astype(np.float32)
    one, other = lm_score.Model(20, prior=prior), lm_score.Model(20, odds=np.exp(prior))
    assert other.prior is None and np.array_equal(one.log_probabilities(x, y), other.log_probabilities(x, y))


def test_lm_words_of_a_batch_are_encoded_at_once(monkeypatch):
    """Ids, lengths and counts equal those of one word at a time, and no word of a batch is encoded by a call of its own, but for those with white space in them."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    texts = ["", None, " \t", " a  B\tc\n", "x", "É\x85y z \x1c q 　", "A" * 50 + " a", "end  ", "\x00 z", "<|endoftext|> it's 'tis", "Étude 12,5 你好"]
    split = [t.encode().lower().split() if t else [] for t in texts]
    single, end = lm_score.WordIds(path), lm_score.END_ID.to_bytes(4, "little")
    want = [b"".join(single[w] for w in ws) + end for ws in split]
    calls, known, encoding = [], lm_score.WordIds(path), lm_score._encoding(path)
    monkeypatch.setattr(lm_score, "_encoding", lambda _: types.SimpleNamespace(encode_ordinary=lambda t: (calls.append(t), encoding.encode_ordinary(t))[-1], decode_single_token_bytes=encoding.decode_single_token_bytes))
    for part in (slice(None), slice(3, 6), slice(0, 3), slice(0, 0)):
        found = lm_score.Words(pa.array(texts, pa.string())[part])
        ids, lengths = found.ids(known)
        assert ids.astype("<u4").tobytes() == b"".join(want[part]) and lengths.tolist() == [len(x) // 4 for x in want[part]]
        counted = collections.Counter(w for ws in split[part] for w in [*ws, b""])
        assert {r["word"].encode(): r["c"] for r in found.counts().to_pylist()} == counted
    assert len(calls) == 1 + sum(any(c in w.decode() for c in "\x85\xa0\x1c　") for w in set(sum(split, [])))
    assert len(known.all([b"one", b"two"])) == 2 and lm_score.encode_words(path, []) == []
