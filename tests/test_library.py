"""Operators on small inputs."""

import re

from pyspark.sql import functions as F

from sievework.functions import segment, symbols
from sievework.operators import relational as R
from sievework.operators import tags
from sievework.sources import tables


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_decrement_table(spark):
    cases = {"5": "4", "1": "0", "i + 1": "i", "i+1": "i", "x": "x - 1", "x+10": "(x+10) - 1", "f(x)": "(f(x)) - 1"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", symbols.decremented(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_mask_keeps_offsets_and_quotes(spark):
    text = 'a = "he // said" \' note\nb = "x""y" // c\nRem whole line\nc = 1'
    got = spark.createDataFrame([(text,), (None,)], "t string").select(segment.code_only("t").alias("m")).collect()
    masked = got[0]["m"]
    assert len(masked) == len(text) and [i for i, c in enumerate(masked) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert re.sub(" +", " ", masked).strip() == 'a = " " \nb = " "" " \n \nc = 1'
    assert got[1]["m"] is None


def test_releases_compare_by_number(spark):
    assert one(spark, "2021r10", lambda c: symbols.release(c) > symbols.release(F.lit("2021r2.1")))
    assert one(spark, "next", symbols.release) is None


def test_deprecation_message(spark):
    assert tuple(one(spark, "Left is  deprecated.\nYou should use String.Left instead.", symbols.deprecation)) == ("Left", "String.Left")
    assert one(spark, "no such thing", symbols.deprecation) is None


def test_pattern_is_unicode_aware_and_matches_brute_force(spark):
    texts = ["foo.Mid(1)", "foo.Midé", "éMid(2)", "x.mıd", "Mid(3) .MID", "amid"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = symbols.symbol_pattern(F.lit("Mid"), F.lit(True))
    got = [r["n"] for r in rows.select(F.regexp_count(F.col("t"), pattern).alias("n")).collect()]
    assert got == [len(re.findall(r"(?i)\.Mid\b", t)) for t in texts]


def test_narrowing_to_nothing_keeps_all(spark):
    d = spark.createDataFrame([(1, "k", ["zz"]), (2, "k", ["b"])], "id int, key string, w array<string>")
    m = spark.createDataFrame([("k", ["a"]), ("k", ["b"])], "key string, o array<string>")
    got = sorted((r["id"], r["o"][0], r["confirmed"]) for r in R.narrowed(d, m, "key", "id", "w", "o").collect())
    assert got == [(1, "a", False), (1, "b", False), (2, "b", True)]


def test_orphans_need_a_reference(spark):
    items, none = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([], "k string")
    assert R.orphans(items, "k", none, "k").count() == 0


def test_stale_needs_a_complete_build(spark):
    listing = spark.createDataFrame([("A.md",), ("b.md",)], "p string")
    assert tables.stale(listing, spark.createDataFrame([("a.MD",)], "p string"), "p", True).collect()[0]["p"] == "b.md"
    assert tables.stale(listing, listing.limit(0), "p", True).count() == 0
    assert tables.stale(listing, listing, "p", False).count() == 0


def test_tag_recovery():
    assert tags.walk("<a><b></a></c><d>", frozenset()) == [(6, "mismatched", "a"), (10, "unexpected", "c"), (14, "unclosed", "d")]


def test_files_and_tsv(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "One.SRC").write_bytes(b"\xef\xbb\xbfhello\n")
    (tmp_path / "s" / "bad.src").write_bytes(b"a\xff")
    (tmp_path / "s" / "nul.src").write_bytes(b"a\x00b")
    (tmp_path / "s" / "other.bin").write_bytes(b"x")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in tables.decoded(tables.files(spark, str(tmp_path / "s"), {"source": ["src"]})).collect()}
    assert rows["One.SRC"]["text"] == "hello\n" and rows["One.SRC"]["has_bom"]
    assert rows["bad.src"]["problem"] == "utf8" and rows["nul.src"]["problem"] == "nul" and len(rows) == 3
    (tmp_path / "t.tsv").write_text('name\tnote\nx\t"a\ny\n')
    got = [tuple(r) for r in tables.headed_tsv(spark, str(tmp_path / "t.tsv"), ["note", "name"]).collect()]
    assert got == [('"a', "x"), ("", "y")]


def test_write_only_what_changed(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string")
    old = spark.createDataFrame([("a", "1"), ("b", "x")], "k string, v string")
    assert sorted(r["k"] for r in tables.changed(new, old, "k", "v").collect()) == ["b", "c"]
