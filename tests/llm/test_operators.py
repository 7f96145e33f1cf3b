"""The ten operators against brute force, and on nulls, blanks, long texts, repeats, empty tables and clashing columns."""

import collections
import math
import pickle
import random
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import components, decontaminate, html_text, lang_id, licenses, lm_score, near_dup, packing, quality, sharding, url_filter
from sievework.llm import queries as llm_queries
from sievework.llm.common import fresh_path, table
from sievework.llm.subwords import Subwords, tokenizer_path

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, node string, bands int, key string, doc string"
VOCAB = "river stone amber field quiet garden copper winter lantern marble forest harbour meadow silver orchard timber valley willow canyon ember".split()


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + str(r.randrange(40)) for _ in range(n))


def odd_documents():
    base, long = sentence(1, 120), sentence(2, 30_000)
    words = base.split()
    return [
        (1, base, "en", "a"),
        (2, base.upper(), "en", None),
        (3, " ".join([*words[:60], "other", *words[61:]]), None, "a"),
        (4, None, "en", "a"),
        (5, "", "en", "a"),
        (6, " \n\t ", "en", "a"),
        (7, long, "en", "b"),
        (8, long + " tail", "en", "b"),
        (9, "one two", "en", "b"),
        (10, "ONE  two", "en", "b"),
        (None, base, "en", "a"),
        (11, sentence(3, 80), "fr", "a"),
        (11, sentence(3, 80), "fr", "a"),
        (12, "été     naïve 日本語 <|endoftext|> 12½ 'll", None, None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, "k", "d") for r in odd_documents()], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return text.encode().lower().split() if text else []


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if i is not None and j is not None and s and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = llm_queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    cur = con.execute(llm_queries.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_near_duplicates_equal_brute_force(spark, odd, none):
    docs = table(spark, DATA, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    extra = [(10_000 + i, (" ".join(words[:-k]) if k else t)) for i, (_, t) in enumerate(rows[:40]) for k in [i % 7] for words in [t.split()]]
    both = spark.createDataFrame(rows + extra, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(both, 4, 80).collect()}
    assert got == brute_components(rows + extra, 4, 80)
    got = near_dup.near_duplicates(odd, 4, 80).collect()
    want = brute_components([(r[0], r[1]) for r in odd_documents()], 4, 80)
    assert len(got) == len(odd_documents())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert near_dup.near_duplicates(none).count() == 0


def test_near_duplicates_around_a_common_passage(spark):
    """Texts around one passage, and copies with many edits of one text, lose no link."""
    passage = sentence(99, 60)
    rows = [(i, passage + " " + sentence(1000 + i // 2, 90) + (" x" if i % 2 else "")) for i in range(60)]
    rows += [(100 + i, passage + " " + sentence(5000 + i, 8)) for i in range(30)]
    base, r = sentence(77, 150).split(), random.Random(5)
    for i in range(120):
        copy = list(base)
        for at in r.sample(range(150), r.randrange(1, 14)):
            copy[at] = r.choice(VOCAB)
        rows.append((200 + i, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute_components(rows, 4, 80)


def test_pairs_of_a_group_grow_with_its_size(spark):
    """n classes that share edits of a pivot, each with one of its own: n - 1 pairs come first, and none is left once these are linked."""
    for n in (20, 40):
        rows = [(b"p", bytes([i]), 80 * 31, 20 * 100, [*range(30), 1000 + i]) for i in range(n)]
        able = near_dup._prefixes(spark.createDataFrame(rows, near_dup.DESCRIBED), 80).withColumn("component", F.col("node"))
        apart = near_dup._of_components(able)
        links = near_dup._pairs_with_one(apart, 80).toDF("u", "v")
        assert links.count() == n - 1 and near_dup._pairs_described(apart, 80).count() == n * (n - 1) // 2
        together = able.withColumn("component", F.lit(b"c"))
        assert near_dup._of_components(together).count() == 0
        one_left = able.withColumn("component", F.when(F.col("node") == bytes([7]), F.col("node")).otherwise(F.lit(b"c")))
        assert near_dup._pairs_described(near_dup._of_components(one_left), 80).count() == n - 1
        left = near_dup._linked(apart.drop("main"), links)
        names = {bytes(r["node"]): bytes(r["component"]) for r in left.select("node", "component").distinct().collect()}
        assert len(set(names.values())) <= 3 and near_dup._pairs_described(near_dup._of_components(left), 80).count() <= 2 * n


def test_circulant_signature_estimates_jaccard():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    agree = [(near_dup.circulant_signature(a, 1024) == near_dup.circulant_signature(b, 1024)).mean()]
    assert abs(np.mean(agree) - 1500 / 2500) < 0.06


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def brute_counts(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd, none):
    texts = [r[1] for r in odd_documents()] + ["a b c a b c d", "x y\nx y\n\nx y", "# * a b | <z>", "a a a a"]
    assert [quality.text_counts(t)[:5] for t in texts] == [brute_counts(t) for t in texts]
    got = quality.judge(odd).collect()
    assert len(got) == len(odd_documents()) and all(not r["kept"] for r in got if r["base_failed"])
    assert {r["doc_id"] for r in got if r["kept"]} >= {1, 3, 7, 8, 11}
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.judge(none).count() == 0 and quality.filter_documents(none).count() == 0


def test_fences_follow_their_source(spark):
    """Sources have fences of their own, and moving one source's texts moves its verdicts alone."""

    def verdicts(symbols):
        rows = []
        for source in ("plain", "shop"):
            for i in range(300):
                ws = sentence(9000 + i, 100).split()
                some = symbols if source == "shop" else 0
                ws[: some + i % 3] = [w + "$" for w in ws[: some + i % 3]]
                rows.append((i, " ".join(ws), "en", source))
            rows.append((900, " ".join(w + "$$" * (j % 10 < 3) for j, w in enumerate(sentence(9900, 100).split())), "en", source))
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        measures = quality.with_measures(quality.measured(docs, ("doc_id", "lang", "source")))
        fences = {r["_source"]: r for r in quality.thresholds(measures).collect()}
        kept = {(r["source"], r["doc_id"]): r["kept"] for r in quality.judged(measures, quality.thresholds(measures)).collect()}
        return fences, kept

    (_, before), (fences, after) = verdicts(0), verdicts(60)
    assert fences["shop"]["max_symbol_rate"] > fences["plain"]["max_symbol_rate"] + 0.1
    assert not before[("shop", 900)] and not before[("plain", 900)]
    assert after[("shop", 900)] and not after[("plain", 900)]
    assert all(v for k, v in after.items() if k[1] < 300)


def test_a_source_of_copies_takes_other_texts(spark):
    """Where most texts of a source are one, its own quartiles have no spread; its language's is used, and with none at all there is no fence."""
    rows = [(i, sentence(1, 100) if i < 400 else sentence(i, 100), "en", "copies") for i in range(500)] + [(i, sentence(i, 100), "en", "other") for i in range(500, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert all(r["kept"] for r in quality.judge(docs).collect())
    same = docs.filter("doc_id < 400").unionByName(docs.filter("doc_id = 600"))
    assert all(r["kept"] for r in quality.judge(same).collect())


@pytest.mark.parametrize("broadcast_words", [200_000, 0])
def test_leaks(spark, odd, none, monkeypatch, broadcast_words):
    """The same by broadcast and by shuffle."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", broadcast_words)
    item = sentence(50, 30)
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (5, sentence(51, 40))], "item_id long, text string")
    w = item.split()
    texts = [
        (1, sentence(60, 50) + "\n" + item.upper() + ". " + sentence(61, 50)),
        (2, sentence(62, 70)),
        (3, " ".join([*w[:27], "changed", *w[28:]])),
        (4, "a tiny, item here"),
        (5, " ".join(w[:12] + ["gap"] + w[12:])),
        (6, item + " " + item),
        (7, None),
        (8, ""),
        (9, "again and again and again and again and again and again so it goes on and on and on"),
    ]
    bench = bench.unionByName(spark.createDataFrame([(6, "and again and again and again and again and again and again so it goes on and on")], "item_id long, text string"))
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 6), r["word_start"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1): (1.0, 50), (4, 2): (1.0, 1), (6, 1): (1.0, 0), (9, 6): (round(13 / 15, 6), 0)}
    mixed = spark.createDataFrame([(1, item, "x"), (1, sentence(70, 60), "x"), (None, item, "x"), (None, sentence(71, 60), "x")], "doc_id long, text string, item_id string")
    assert sorted(r["text"] for r in decontaminate.without_leaks(mixed, bench).collect()) == sorted([sentence(70, 60), sentence(71, 60)])
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()) == sorted({t[0] for t in texts} - {k[0] for k in got})
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_lm_scores(spark, odd, none):
    docs = odd.withColumn("held_out", lm_score.held_out())
    got = lm_score.score(docs, docs.filter("not held_out")).collect()
    count = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t, *_ in odd_documents():
        if not held(i):
            count.update(words(t))
            count[b""] += 1
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t, *_ in odd_documents():
        ws = [*words(t), b""]
        want[(i, held(i), len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 4))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    empty = none.withColumn("held_out", lm_score.held_out())
    assert lm_score.score(empty, empty).count() == 0


def test_lm_gradient_and_windows():
    r = np.random.default_rng(0)
    n = 20
    m = lm_score.Model(n)
    m.flat[-n * (lm_score.WIDTH + 1) :] = np.random.default_rng(3).normal(0, 0.2, n * (lm_score.WIDTH + 1))
    x, y, real = r.integers(0, n, (3, lm_score.CONTEXT)), r.integers(0, n, (3, lm_score.STRIDE)), r.random((3, lm_score.STRIDE)) > 0.3
    loss = lambda f: -(lm_score.Model(n, f).log_probabilities(x, y) * real).sum() / real.sum()
    g = m.gradient(x, y, real)
    for i in r.integers(0, len(m.flat), 20):
        e = np.zeros_like(m.flat)
        e[i] = 1e-2
        assert abs((loss(m.flat + e) - loss(m.flat - e)) / 2e-2 - g[i]) < 2e-3
    later = x.copy()
    later[:, -1] = (later[:, -1] + 1) % n
    assert np.allclose(m.log_probabilities(x, y)[:, :-1], m.log_probabilities(later, y)[:, :-1])
    ids = [np.arange(k, dtype="<u4").tobytes() for k in (1, 15, 16, 17, 100)]
    _, _, real, target, text = lm_score.windows(ids, np.zeros(lm_score.IDS, np.int64))
    assert [target[text == i][real[text == i]].tolist() for i in range(5)] == [list(range(k)) for k in (1, 15, 16, 17, 100)]


def brute_log10(m, ids, shares, classes):
    """log10 probability of a text's ids, one token at a time, by plain loops over its window."""
    C, S, W, total = lm_score.CONTEXT, lm_score.STRIDE, lm_score.WIDTH, 0.0
    before = [lm_score.BEFORE] * (C - S + 1) + list(ids)
    for j, target in enumerate(ids):
        window = before[j // S * S :][:C]
        p = C - S + j % S
        h = [m.emb[x].astype(float) + m.pos[i] for i, x in enumerate(window[: p + 1])]
        q = h[p] @ m.wq
        weight = np.exp([q @ (x @ m.wk) / math.sqrt(W) for x in h])
        hidden = h[p] + sum(w * (x @ m.wv) for w, x in zip(weight / weight.sum(), h, strict=True))
        z = hidden @ m.out + m.bias[0] + m.prior[window[p]]
        total += (z[classes.of[target]] - math.log(np.exp(z).sum())) / math.log(10)
        last = 0 if classes.begins[target] else classes.of_input[window[p]]
        total += shares[last, target]
    return total


def test_lm_score_equals_brute_force(spark, monkeypatch):
    """Whole texts scored by windows and batches against one token at a time."""
    seen, fit, shares_after = {}, lm_score.fit, lm_score.Classes.shares_after

    def fitted(docs, path, classes, prior, n):
        seen["model"] = lm_score.Model(classes.n, fit(docs, path, classes, prior, n), prior)
        seen["classes"] = classes
        return seen["model"].flat

    def kept(self, *columns):
        seen["shares"] = shares_after(self, *columns)
        return seen["shares"]

    monkeypatch.setattr(lm_score, "fit", fitted)
    monkeypatch.setattr(lm_score.Classes, "shares_after", kept)
    texts = {1: sentence(1, 60), 2: "river stone", 3: "", 4: None, 5: sentence(2, 11), 6: "unseen zzyqx words"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("held_out", F.lit(False))
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, docs.filter("doc_id < 6")).collect()}
    ids_of = lm_score.WordIds(tokenizer_path("byte_bpe_50k.tiktoken"))
    for i, t in texts.items():
        ids = np.frombuffer(b"".join(ids_of[w] for w in words(t)) + lm_score.END_ID.to_bytes(4, "little"), "<u4").tolist()
        assert abs(got[i] - brute_log10(seen["model"], ids, seen["shares"], seen["classes"])) < 1e-3 * len(ids)


def test_lm_learns_from_all_text_by_subword_ids(spark):
    """One short text is enough to learn from, and ids of one class are told apart as inputs."""
    docs = spark.createDataFrame([(1, sentence(7, 30))], "doc_id long, text string")
    counts = np.zeros(lm_score.IDS, np.int64)
    classes = lm_score.Classes(counts, np.zeros(lm_score.IDS, np.int64))
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    prior = classes.prior_after(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), counts)
    start = lm_score.Model(classes.n, prior=prior)
    fitted = lm_score.Model(classes.n, lm_score.fit(docs, path, classes, prior, 30), prior)
    ids = np.frombuffer(b"".join(lm_score.WordIds(path)[w] for w in words(sentence(7, 30))), "<u4")
    moved = np.flatnonzero((fitted.emb != start.emb).any(axis=1))
    assert set(moved) >= set(ids.tolist())
    x, y, real, _, _ = lm_score.windows([ids.tobytes()], classes.of)
    assert x.max() > classes.n and fitted.log_probabilities(x, y)[real].mean() > start.log_probabilities(x, y)[real].mean()


def test_lm_scores_do_not_depend_on_the_split(spark, monkeypatch):
    """The same rows read as 1, 4 and 16 tasks, with parts of their own size and of many."""
    docs = spark.createDataFrame([(i, sentence(i, 150)) for i in range(60)] + [(3, sentence(3, 150)), (None, "one two"), (61, None)], "doc_id long, text string").withColumn("held_out", lm_score.held_out())
    for part_words in (lm_score.PART_WORDS, 1000):
        monkeypatch.setattr(lm_score, "PART_WORDS", part_words)
        runs = []
        for tasks in (1, 4, 16):
            split = docs.repartition(tasks)
            runs.append(sorted((r["doc_id"] or 0, r["score"]) for r in lm_score.score(split, split.filter("not held_out")).collect()))
        assert np.allclose(runs[0], runs[1], atol=1e-6) and np.allclose(runs[0], runs[2], atol=1e-6)


def test_lm_broadcasts_stay_small_and_go(spark, monkeypatch):
    """Every executor keeps a copy of each broadcast on its disk: few are sent, packed, and all are destroyed."""
    from pyspark import Broadcast, SparkContext

    sizes, gone, make, destroy = [], [], SparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sizes.append(len(pickle.dumps(value))), make(self, value))[-1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: (gone.append(1), destroy(self, blocking))[1])
    docs = table(spark, DATA, "documents").select("doc_id", "text").withColumn("held_out", lm_score.held_out())
    scored = lm_score.score(docs, docs.filter(~F.col("held_out")))
    assert scored.filter("score < 0").count() == docs.count()
    assert sum(sizes) < 50_000_000 and len(gone) == len(sizes) == lm_score.ROUNDS + 2
    a = np.random.default_rng(1).normal(size=(7, 5)).astype(np.float32)
    assert np.array_equal(lm_score.unpacked(*lm_score.packed(a)), a)


def test_lm_counts_more_words_than_a_task_holds(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(300_500)),)], "text string").repartition(1)
    assert lm_score.count_words(docs).count() == 300_501


def test_lm_shares_use_every_pair(spark):
    """Pairs seen once count as much as any, and END_ID before a word is class 0."""
    counts = np.arange(lm_score.IDS)[::-1].copy()
    classes = lm_score.Classes(counts, np.zeros(lm_score.IDS, np.int64))
    last = classes.of[40_000]
    before = np.flatnonzero(classes.of == last)[:300]
    rows = [(int(b) * lm_score.IDS + 30_000, 1) for b in before] + [(lm_score.END_ID * lm_score.IDS + 30_000, 7)]
    cells = lm_score.count_cells(spark.createDataFrame(rows, "pair long, n long"), classes)
    assert sorted(map(tuple, cells.select("before", "id", "n").collect())) == [(0, 30_000, 7), (last, 30_000, len(before))]
    got = classes.shares_after(*(cells.toArrow()[c].to_numpy() for c in ("before", "id", "n")))
    want = (len(before) + lm_score.SMOOTH * classes.share[30_000]) / (len(before) + lm_score.SMOOTH)
    assert abs(got[last, 30_000] - math.log10(want)) < 1e-5


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><header>top</header><div class='cookie-notice'>c</div><article><h1>Head &amp; line</h1><p>One\n  two<br>three<aside>no</aside><p>Four &lt;b&gt;<script>x='</p>'</script><form>f</form></article><section id=comments>say</section><footer>end</footer></body></html>"
    loose = "<body><div>site name</div><div>own {0}</div><div>site foot</div></body>"
    rows = [(1, "http://h/a", page), (2, "http://h/b", None), (3, None, ""), (4, "http://k/1", loose.format(1)), (5, "http://k/2", loose.format(2)), (6, "http://k/3", loose.format(3)), (6, "http://k/3", "<p>cut &am"), (7, "http://lone/", loose.format(4))]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()]
    text = "Head & line\n\nOne two three\n\nFour <b>"
    assert sorted(got) == sorted([(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "own 1", 5), (5, "own 2", 5), (6, "own 3", 5), (6, "cut &am", 7), (7, "site name\n\nown 4\n\nsite foot", 27)])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loose_lines_beside_an_article(spark):
    """Text around an article element is differenced like that of a page without one, and stays in page order."""
    page = "<body><div>site name</div><p>lead {0}</p><article>card {0}</article><div>body {0}</div><div>site foot</div></body>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(3)] + [(9, "http://h/9", "<div>site name</div><div>own</div><div>site foot</div>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"lead {i}\n\ncard {i}\n\nbody {i}" for i in range(3)} | {9: "own"}


def test_copies_of_a_page_and_class_names(spark):
    loose = "<body><div>site name</div><div>own {0}</div><div>site foot</div></body>"
    rows = [(1, "http://k/1", loose.format(1)), (2, "http://k/2", loose.format(1)), (2, "http://k/2", loose.format(1)), (3, "http://k/3", "<article>a</article>"), (4, "http://k/4", loose.format(4)), (5, "http://m/1", loose.format(5)), (6, "http://m/2", loose.format(5))]
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    alone = "site name\n\nown 5\n\nsite foot"
    assert got == [(1, "own 1"), (2, "own 1"), (2, "own 1"), (3, "a"), (4, "own 4"), (5, alone), (6, alone)]
    for name in ("content no-sidebar", "layout has-sidebar", "post share-enabled", "widget"):
        assert html_text.text_lines(f"<div class='{name}'>lead<article>text<p class='social'>no</article></div>") == [(html_text.LOOSE, "lead"), (html_text.INSIDE, "text"), (html_text.LOOSE, "no")]
    for name in ("cookie-notice", "site-footer", "x sidebar"):
        assert html_text.text_lines(f"<div class='{name}'>no<div>no</div></div><p>text</p>") == [(html_text.LOOSE, "text")]
    assert html_text.text_lines("<div class='comments'><article class='comment'>no</article></div><main class='widget'>text</main>") == [(html_text.INSIDE, "text")]


def test_names_that_may_be_text_are_differenced(spark):
    """Shares and bylines of an article go where a neighbour has them too, and stay where they are the page's own."""
    page = "<article><h1>t {0}</h1><p class='byline'>by {0}</p><p>text {0}</p><div class='share-links'>share this</div></article>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(3)] + [(9, "http://lone/", page.format(9))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"t {i}\n\nby {i}\n\ntext {i}" for i in range(3)} | {9: "t 9\n\nby 9\n\ntext 9\n\nshare this"}


class Blocks(HTMLParser):
    """Lines of a page by the standard library's parser: those in dropped elements left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.text = [], [], ""

    def cut(self):
        if line := " ".join(self.text.split()):
            self.lines.append(line)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK:
            self.cut()
            if "p" in self.open[-1:]:
                self.open.pop()
        if tag == "br":
            self.text += " "
        elif tag not in html_text.VOID:
            self.open.append("drop" if ("class", "ad") in attrs else tag)
            if self.open[-1] == "drop":
                self.cut()

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.cut()
        while self.open and tag in [t if t != "drop" else "div" for t in self.open]:
            if self.open.pop() in (tag, "drop"):
                break

    def handle_data(self, data):
        if not {"head", "script", "style", "title", "nav", "footer", "drop"} & set(self.open):
            self.text += data


@pytest.mark.parametrize("tag", ["article", "section"])
def test_extraction_equals_brute_force(spark, tag):
    """All given pages, as they are, and with their articles in an element that says nothing, so that all is differenced."""
    pages = table(spark, DATA, "pages").withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit(f"<{tag}><p>of this site</p>" if tag == "section" else "<article>")), F.lit("</article>"), F.lit(f"</{tag}>")))
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    lines = {}
    for i, _, page in rows:
        b = Blocks()
        b.feed(page)
        b.close()
        b.cut()
        lines[i] = b.lines
    want = {i: "\n\n".join(x) for i, x in lines.items()}
    if tag == "section":
        order = sorted((*url_filter.split_url(u), i) for i, u, _ in rows)
        first = {}
        for host, path, i in order:
            first.setdefault((host, tuple(lines[i])), (host, path, i))
        once = sorted(first.values())
        for at, (host, _, i) in enumerate(once):
            near = [lines[once[j][2]] for j in (at - 1, at + 1) if 0 <= j < len(once) and once[j][0] == host]
            gone = set().union(*(html_text.common_lines(lines[i], x) for x in near))
            for copy in (c for h, _, c in order if h == host and lines[c] == lines[i]):
                want[copy] = "\n\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
        assert sum("of this site" not in t for t in want.values()) > 10
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == want


def test_common_lines_is_longest():
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        found = sorted(html_text.common_lines(a, b))
        assert len(found) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in found)


def test_packing_round_trip(odd, none):
    got = packing.pack(odd).collect()
    s = Subwords(tokenizer_path())
    want = collections.Counter()
    for i, t, *_ in odd_documents():
        ids = np.array([*(s.tokenizer.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert packing.pack(none).count() == 0


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(60):
        size = r.choice([10, 37, 64])
        lengths = sorted((r.randint(1, size) for _ in range(r.randrange(80))), reverse=True)
        room = []
        for n in lengths:
            fit = [i for i, x in enumerate(room) if x >= n]
            if fit:
                room[min(fit, key=lambda i: room[i])] -= n
            else:
                room.append(size - n)
        slots, opened = packing.plan(dict(collections.Counter(lengths)), size)
        assert opened == len(room) and sum(s[2] for s in slots) == len(lengths)


def test_subwords_equal_the_tokenizer():
    s, r = Subwords(tokenizer_path(), bound=50), random.Random(2)
    alphabet = "ab'sdtmlvre \t\n\r\x85\xa0\x1c.,!²½ªé×ß09_<|endoftext|>日"
    for _ in range(500):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(14)))
        assert np.frombuffer(s.ids(t), "<u4").tolist() == s.tokenizer.encode(t, add_special_tokens=False).ids


def test_url_rules(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "a.b/"), ("allow", "b/x")]
    urls = {"http://x.example.COM/en/77?q": ("allow", "example.com/en/7"), "https://example.com/en/8": ("block", "com/en/"), "https://ncom/en/": ("allow", None), "http://z.a.b/x/y": ("block", "a.b/"), "http://q.b/x": ("allow", "b/x"), "http://sub.bad.org/": ("block", None), "no url": ("allow", None), "http://a.b": ("allow", None)}
    rows = [(i, u) for i, u in enumerate([*urls, None, "http://q.b/x"])]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, ["bad.org"]).collect()}
    for i, u in rows:
        assert (got[i]["verdict"], got[i]["rule"]) == urls.get(u, ("allow", None))
    assert (got[0]["host"], got[0]["path"]) == ("x.example.com", "/en/77") and (got[8]["host"], got[8]["path"]) == ("", "")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), [], []).count() == 0


def test_url_rules_of_the_contract(spark, tmp_path):
    assert url_filter.RULES == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    urls = {"http://a.net/de/1": ("allow", "net/de/"), "https://spam-farm.example.net/de/9": ("allow", "net/de/"), "https://spam-farm.example.net/fr/9": ("block", None), "http://x.example.net/de/81": ("block", "example.net/de/8"), "http://a.com/en/": ("block", "com/en/"), "http://www.example.com/en/70": ("allow", "example.com/en/7"), "http://a.org/es/x": ("block", "org/es/")}
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in llm_queries.QUERIES["op6_url_filter"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(urls.values()))
    sql = duckdb.connect().execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'").execute(url_filter.oracle_sql()).df()
    assert {r.page_id: r.verdict for r in sql.itertuples()} == {i: v for i, (v, _) in got.items()}


def test_digest_collisions_are_told_apart(tmp_path):
    data = url_filter.digest_file([b"one", b"two", b"three"], [1, 2, 3], [1])
    (tmp_path / "f").write_bytes(data)
    a = url_filter.DigestArray(str(tmp_path / "f"))
    assert a.find([b"two", b"none", b"one"]).tolist() == [2, -1, 1]
    forged = bytearray(data)
    forged[24 : 24 + 24] = np.full(3, url_filter.xxhash.xxh64_intdigest(b"two"), np.uint64).tobytes()
    (tmp_path / "g").write_bytes(bytes(forged))
    g = url_filter.DigestArray(str(tmp_path / "g"))
    assert g.find([b"two"]).tolist() == [2]


def test_a_million_keys(tmp_path):
    """The mapped array finds every key of a long list, no other, and tells a forged collision in it apart."""
    keys = [b"h%d.example" % i for i in range(1_000_000)]
    (tmp_path / "f").write_bytes(url_filter.digest_file([*keys, b"h5.example.twin"], [*range(1_000_000), 7], [1]))
    a = url_filter.DigestArray(str(tmp_path / "f"))
    assert isinstance(a.digest.base, np.memmap) or isinstance(a.digest, np.memmap)
    ask = np.random.default_rng(1).integers(0, 1_000_000, 5000).tolist()
    assert a.find([keys[i] for i in ask]).tolist() == ask and (a.find([b"x%d.example" % i for i in ask]) == -1).all()
    raw = np.memmap(tmp_path / "f", np.uint8, "r+")
    at = 16 + 8 * 1 + 8 * int(np.searchsorted(a.digest, url_filter.xxhash.xxh64_intdigest(keys[5])))
    raw[at + 8 : at + 16] = raw[at : at + 8]  # the next key now has the digest of keys[5]
    raw.flush()
    assert url_filter.DigestArray(str(tmp_path / "f")).find([keys[5]]).tolist() == [5]


def test_licences(spark, odd, none):
    rows = [(1, "Copyright 2020 A. Nobody\nLICENSED under the Apache Licence, v2.0"), (2, "text\nReleased under the MIT License!\nReleased under the MIT license\nmore"), (3, "MIT"), (4, None), (5, ""), (6, "This work is licensed under the GNU GPL, version 3.0.")]
    got = {(r["doc_id"], r["license_id"]): (r["whole_text"], r["n_lines"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"): (True, 1), (2, "MIT"): (False, 2), (6, "GPL-3.0"): (True, 1)}
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_licence_texts_inside_documents(spark):
    known = dict(licenses.full_texts())
    assert {"MIT", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-3.0"} <= set(known)
    rows = [(i, t) for i, (_, t) in enumerate(licenses.full_texts())]
    rows += [(100 + i, "some words\n" + t + "\nmore words") for i, (_, t) in enumerate(licenses.full_texts())]
    rows += [(200, "We say: licensed under\nthe MIT\nLicense. And more."), (201, "SPDX-License-Identifier: MIT-0"), (202, " ".join(known["ISC"].split()[:20]))]
    got = {(r["doc_id"], r["license_id"]): r["whole_text"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(licenses.full_texts()):
        assert got[(i, name)] and got[(100 + i, name)] is False, name
    assert {k for k in got if k[0] >= 200} == {(200, "MIT")}


@pytest.mark.parametrize("holder", [None, "Copyright (c) 2021, 2023 Somebody & Daughters, Inc. All rights reserved."])
def test_licence_texts_wrapped_anew(spark, holder):
    """Each text by paragraphs and as one run, at three widths, alone and inside a document; with the notice of a holder of its own."""
    import textwrap

    rows, names = [], {}
    for name, text in licenses.full_texts():
        paragraphs = [p for p in text.split("\n\n") if p.strip()]
        if holder and name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"):
            paragraphs = [holder if p.strip().lower().startswith("copyright") else p for p in paragraphs]
        for width in (60, 100, 10**9):
            for whole in ("\n\n".join(textwrap.fill(p, width) for p in paragraphs), textwrap.fill(" ".join(paragraphs), width)):
                for inside in (whole, f"An article about nothing.\n{whole}\nThe end of it."):
                    rows.append((len(rows), inside))
                    names[len(rows) - 1] = (name, width, inside is whole)
    got = {(r["doc_id"], r["license_id"]): r["whole_text"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    lost = [n for i, n in names.items() if (i, n[0]) not in got]
    assert not lost, lost
    if not holder:
        assert not [n for i, n in names.items() if got[(i, n[0])] != n[2]]


def test_licence_sql(spark):
    texts = licenses.full_texts()
    rows = [(1, texts[0][1]), (2, "before\n" + dict(texts)["MIT"] + "\nafter"), (3, "Licensed under the MIT\nLicence."), (4, None), (5, "COPYRIGHT HOLDERS BE LIABLE"), (6, "Released under CC0 1.0.\nSPDX-License-Identifier: MIT")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(f"select doc_id, license_id, whole_text, n_lines from ({licenses.oracle_sql()})").fetchall()
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license_id", "whole_text", "n_lines").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 5


def test_shard_store(spark, odd, none):
    store = sharding.ShardStore(spark, fresh_path(spark, "shards"), odd.schema, target_bytes=1 << 20, fanout=2, shard_rows=3)
    assert store.read().count() == 0
    store.append(none)
    for i in range(3):
        store.append(odd.filter(f"coalesce(doc_id, 0) % 3 = {i}"))
    before = store.manifest()
    assert before["version"] == 4 and len(before["shards"]) > 4
    with pytest.raises(Exception):
        store.commit({"version": 2, "shards": []}, [])
    after = store.compact()
    assert after["version"] > 4 and len(after["shards"]) < len(before["shards"])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.read()) == key(odd)
    assert store.versions() == [after["version"] - 1, after["version"]] and key(store.read(after["version"] - 1)) == key(odd)
    lost = store._write(odd.limit(2))  # a writer that never commits
    store.vacuum()
    assert spark.read.parquet(lost[0]["path"]).count() > 0
    store.grace_hours = -1
    store.vacuum()
    with pytest.raises(Exception):
        spark.read.parquet(lost[0]["path"])
    assert key(store.read()) == key(odd)


def test_language_id(spark, odd, none):
    docs = table(spark, DATA, "documents")
    model = lang_id.train(docs.filter(~lang_id.held_out()))
    got = lang_id.identify(docs.withColumn("held", lang_id.held_out()), model, ("doc_id", "lang", "held")).filter("held").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    rows = lang_id.identify(odd, model).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {4, 5, 6} and all(0 <= r["score"] <= 1 for r in rows)
    assert lang_id.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(odd, lang_id.train(none)).collect()} == {"und"}
    numbers = spark.createDataFrame([(1, "½ ² Ⅷ 12 _ ٣"), (2, "½ é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in lang_id.identify(numbers, model).orderBy("doc_id").collect()] == [True, False]


def test_languages_are_learned_from_every_document(spark):
    """Every row's windows are counted, and limits are those of all rows' costs, also beyond 3,000 documents of a language."""
    rows = [(i, f"word number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x", "en") for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = collections.Counter()
    for _, t, _ in rows:
        s = b"   " + lang_id.normalise(t) + b" "
        want.update(int.from_bytes(s[j : j + 4], "big") for j in range(len(s) - 3))
    model = lang_id.train(docs)
    made = lang_id.Model.of(["en"], np.zeros(len(want), np.int64), np.array(list(want), np.int64), np.array(list(want.values()), np.int64))
    assert np.array_equal(model.bits, made.bits) and np.array_equal(model.cell, made.cell)
    judged = lang_id.identify(docs, model)
    costs = sorted(math.ceil(r["bits"] * 1024) for r in judged.collect())
    limit = lang_id.cost_limits(judged)
    assert limit == {"en": 2 * costs[math.ceil(0.9 * len(costs)) - 1] / 1024} == lang_id.cost_limits(judged.repartition(2))


def test_code_lengths_equal_brute_force():
    texts = {"x": [b"abracadabra", b"banana band"], "y": [b"zebra zoo", b"abba"]}
    grams, seen = collections.Counter(), {}
    for lang, ts in texts.items():
        stream = b"".join(b"   " + t + b" " for t in ts)
        for i in range(len(stream) - 3):
            g = stream[i : i + 4]
            grams[(lang, int.from_bytes(g, "big"))] += 1
            for k in range(4):
                seen.setdefault((lang, g[3 - k : 3]), collections.Counter())[g[3]] += 1
    langs = sorted(texts)
    model = lang_id.Model.of(langs, *(np.array(c, np.int64) for c in zip(*((langs.index(lang), g, n) for (lang, g), n in grams.items()), strict=True)))

    def p(lang, context, s):
        c = seen.get((lang, context), {})
        total = sum(c.values())
        if s in c:
            return c[s] / (total + len(c))
        shorter = p(lang, context[1:], s) if context else 1 / 256
        return len(c) / (total + len(c)) * shorter if total else shorter

    ask = [b"banana", b"z", b"abra zoo", b"zzqa ob", b"nd zeb", b"aboooz"]
    for row, t in zip(model.code_lengths(ask), ask, strict=True):
        padded = b"   " + t
        for lang, bits in zip(model.languages, row, strict=True):
            assert abs(bits + sum(math.log2(p(lang, padded[i : i + 3], padded[i + 3])) for i in range(len(t)))) < 1e-3
