"""The pipeline against a run of the same decisions in DuckDB and plain Python."""

import collections
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from sievework.llm import decontaminate, quality
from sievework.llm.subwords import Subwords, tokenizer_path

from .test_operators import DATA, brute_components, sentence


def test_run_equals_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "decontamination", "packing"]
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    docs = docs[docs.text.map(lambda t: any(c.isalpha() for c in t))]
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert sorted(first.columns) == sorted(docs.columns)
    lang_ok = {r["doc_id"] for r in first.select("doc_id").collect()}
    assert lang_ok <= set(docs.doc_id) and len(lang_ok) >= 0.98 * len(docs)

    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{DATA}/benchmark.parquet'")
    kept = docs[docs.doc_id.isin(lang_ok)]
    con.register("documents", kept)
    verdict = {r[0] for r in con.execute(f"select doc_id from ({quality.oracle_sql()}) where kept").fetchall()}
    kept = kept[kept.doc_id.isin(verdict)]
    comp = brute_components(list(zip(kept.doc_id.tolist(), kept.text, strict=True)), 5, 80)
    kept = kept[kept.doc_id.map(lambda i: comp[i][1] == i)]
    con.unregister("documents")
    con.register("documents", kept)
    leaks = {r[0] for r in con.execute(f"select distinct doc_id from ({decontaminate.oracle_sql()})").fetchall()}
    kept = kept[~kept.doc_id.isin(leaks)]

    s = Subwords(tokenizer_path())
    want = collections.Counter()
    for i, t in zip(kept.doc_id.tolist(), kept.text, strict=True):
        ids = np.array([*s.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = corpus_pipeline.run(spark, DATA).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(5, text, "en", "a", 1), (5, text, "en", "a", 1), (6, text + " more", "en", "a", 1), (None, text, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()) == ["5", "None"]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=90):
    return sentence(seed, n)


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    a, b = text(1), text(2)
    docs = spark.createDataFrame([(3, a, "en", "s", 1), (5, a + " more", "en", "s", 1), (5, b, "en", "s", 1), (5, b.upper(), "en", "s", 1), (7, "", "en", "s", 1), (7, "", "en", "s", 1), (8, None, "en", "s", 1)], DOCUMENTS)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert got.columns == docs.columns
    rows = sorted((r["doc_id"], r["text"] or "") for r in got.collect())
    assert [i for i, _ in rows] == [3, 5, 7, 7, 8] and rows[0][1] == a and rows[1][1].lower() == b


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    """Nulls, blanks, long texts, repeats, an empty table and columns whose names the stages use themselves."""
    schema = DOCUMENTS + ", doc string, id int, key long, group string, rows int, text_key int, kept boolean, lang_pred string"
    extra = ("d", 1, 2, "g", 3, 4, False, "xx")
    rows = [(1, text(1), "en", "s", 1), (1, text(1), "en", "s", 1), (None, text(1), None, None, None), (2, None, "en", "s", 1), (3, "", None, "s", 1), (4, " \n", "en", None, 1), (5, text(5, 20_000), "en", "s", 1), (6, "½ 12", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    got = stage(spark, docs, DATA)
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert last or got.columns == docs.columns
    n = got.count()
    assert {"identify_language": n == 4, "apply_quality_rules": n == 4, "drop_near_duplicates": n == 7, "decontaminate_benchmark": n == 8, "pack_sequences": n >= 8}[stage.__name__]
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_language_stage_rejects_what_no_language_fits(spark):
    """Noise, program code and scripts that were not learned go; documents stay, also short ones and those of mixed languages."""
    import inspect
    import random

    r = random.Random(2)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randrange(3, 10)))
    junk = [" ".join(word("bcdfghjklmnpqrstvwxz") for _ in range(80)), " ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range(80)), inspect.getsource(corpus_pipeline), "\u0397 \u03b3\u03c1\u03ae\u03b3\u03bf\u03c1\u03b7 \u03b1\u03bb\u03b5\u03c0\u03bf\u03cd " * 20, "\u0421\u044a\u0435\u0448\u044c \u0436\u0435 \u0435\u0449\u0451 " * 20, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 " * 20, "QmFzZTY0IGVuY29kZWQgc3RyaW5n" * 20]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    added = spark.createDataFrame([(10_000_000 + i, t, None, "src1", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(added), DATA)
    assert kept.filter("doc_id >= 10000000").count() == 0
    lettered = sum(any(c.isalpha() for c in x["text"]) for x in docs.collect())
    assert kept.count() == lettered


@pytest.mark.parametrize("stage", ["identify_language", "apply_quality_rules", "drop_near_duplicates", "pack_sequences"])
def test_batches_to_python_are_bounded(spark, stage):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 1000) as text", "'en' as lang", "'a' as source", "0L as n_chars")
    try:
        getattr(corpus_pipeline, stage)(spark, docs.limit(20), DATA)
        sizes = lambda it: (pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "rows"]) for b in it)
        got = docs.mapInArrow(sizes, "size long, rows long").collect()
        assert sum(r["rows"] for r in got) == 3000 and max(r["size"] for r in got) < 5 << 20
        spark.conf.set(key, "900k")
        getattr(corpus_pipeline, stage)(spark, docs.limit(20), DATA)
        assert spark.conf.get(key) == "900k"
    finally:
        spark.conf.unset(key)
