"""Weak spots mended: quoting, notices, declarations, numbering, lookups and line endings, by the cases that define them."""

from pyspark.sql import functions as F

from sievework.functions import calls, symbols
from sievework.operators import catalog, differences, paths, relational, source_code, worklist
from sievework.sources import tables


def one(spark, column, *rows, name="x"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, {name} string").orderBy("i").select(column).collect()]


def test_a_name_ends_no_quotation(spark):
    got = spark.createDataFrame([(r"a\Eb", r"x a\Eb y"), (r"\Q.", r"\Q."), ("a.c", "abc")], "n string, t string")
    assert [r[0] for r in got.select(F.rlike(F.col("t"), symbols.quoted(F.col("n")))).collect()] == [True, True, False]


def test_deprecation_messages(spark):
    rows = ["Left is deprecated.  You should use String.Left instead", "ListBox.Cell IS\n Deprecated. you should use ListBox.CellTextAt(row As Integer, column As Integer) instead.", "A b is deprecated", "x is deprecated", "x is deprecated by y", "9x is deprecated."]
    got = [d and tuple(d) for d in one(spark, symbols.deprecation(F.col("x")), *rows)]
    assert got == [("Left", "String.Left"), ("ListBox.Cell", "ListBox.CellTextAt(row As Integer, column As Integer)"), None, ("x", None), None, None]


def test_notices_in_prose(spark):
    rows = [
        "It does this.\n\nThis was deprecated in 2021r3.1. Please use :doc:`DesktopList</api/list>` as a replacement.\n\nUse it often.",
        "The item has been removed in version 2019r2.\nUse Box.Name(x) instead of this.",
        "Is deprecated words. Use That.",
        "Use this event to react.\n\nNothing else.",
        "It is deprecated.\n\nUse Another.",
        "was deprecated. Use `Old.Thing`]] (above).",
        None,
    ]
    got = [tuple(x) for x in one(spark, catalog.prose_deprecation(F.col("x")), *rows)]
    assert got == [("2021r3.1", "DesktopList"), ("2019r2", "Box.Name(x)"), ("", ""), ("", ""), ("", ""), ("", "Old.Thing"), ("", "")]


def test_rule_names(spark):
    df = spark.createDataFrame([("Thing(a, b(c)) As T [1] → New", "see notes/x.md lines 3-4 Box.Item 'a quoted excerpt of some length'"), (None, None)], "name string, old string")
    got = [set(r[0]) for r in df.select(worklist.symbol_tokens(F.col("name"), F.col("old"))).collect()]
    assert got == [{"thing", "box.item", "item"}, set()]


def test_declared_names(spark):
    lines = {
        "Private Shared Sub Go(ByRef first As Integer, second() As Text, Optional third As Double = 3)": {"go", "first", "second", "third"},
        "Function Plain() As Integer": {"plain"},
        "  mCount As Integer = 2": {"mcount"},
        "  mList() As Text": {"mlist"},
        "#tag Constant, Name = kLimit, Type = Integer": {"klimit"},
        "Begin Button OkButton": {"okbutton"},
        "Var a, b As Integer, c As Text = d": {"a", "b", "c"},
        "Sub Pressed() Handles Ok.Pressed": {"pressed", "ok"},
        "x = y + z": set(),
        "If a As b": set(),
        "": set(),
    }
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)], "place string, line string")
    got = {}
    for r in source_code.declared_names(df, "place", "line").collect():
        got.setdefault(int(r["place"]), set()).add(r["name"])
    for i, want in enumerate(lines.values()):
        assert got.get(i, set()) == want, list(lines)[i]


def test_loop_bounds_and_indexes():
    assert [calls.less_one(e) for e in ("3", " i + 1", "i", "f(x)", "a + b + 1", "+ 1", "i-1", "1 + 10")] == ["2", "i", "i - 1", "(f(x)) - 1", "a + b", "(+ 1) - 1", "(i-1) - 1", "(1 + 10) - 1"]
    bounds = {" = 0 To 9": "0", " As Integer = 1 to n - 1 Step 2": "1", "=10 DownTo 2": "2", " = 9 To 0 Step -1": "0", " = a To": None, " = 1 To 2 Step x": None, " In list": None, " = 1 To 3 Step": None, " As A B = 1 To 2": None}
    assert {k: calls._bound(k) for k in bounds} == bounds
    loops = [(False, "i", "0"), (False, "j", "1"), (True, "e", None), (False, "k", None), (False, "n", "low")]
    want = {"1": ("LITERAL", "safe"), "0": ("LITERAL", "risky"), "i": ("i=0", "risky"), "i + 1": ("i=0", "safe"), "j-1": ("j=1", "risky"), "J": ("J=1", "safe"), "e": ("e (For Each)", "review"), "k": ("k=?", "review"), "n": ("n=low", "review"), "z": ("z (no loop)", "review"), "f(i)": ("COMPLEX", "review")}
    assert {k: calls.start_verdict(k, loops) for k in want} == want


def test_numbering_without_one_window(spark):
    df = spark.createDataFrame([(i % 7, f"n{(i * 37) % 50:02d}", i) for i in range(200)] + [(None, None, 200)], "a int, b string, i int")
    rows = relational.numbered(df.repartition(6), [F.col("a"), F.substring("b", 1, 2)], [F.col("b"), F.col("i")]).collect()
    order = sorted(rows, key=lambda r: (r["a"] is not None, r["a"] or 0, r["b"] or "", r["i"]))
    assert [r["rank"] for r in order] == list(range(1, 202))


def test_places_across_ranges(spark):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(0, 90, 3)], "k string, n long")
    got = worklist.placed(df.repartition(5), ["k"], "n", width=10).orderBy("k", "n").collect()
    assert [r["place"] for r in got] == [*range(1, 31), *range(1, 31)]


def test_endings(spark):
    texts = ["a\r\nb\n\nc", "\r", "", "end\n", "no", None, "x\n\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for r in tables.ended_lines(df).orderBy("i", "line_no").collect():
        got.setdefault(r["i"], []).append((r["line"], r["ending"]))
    assert got == {0: [("a", "\r\n"), ("b", "\n"), ("", "\n"), ("c", "")], 1: [("", "\r")], 3: [("end", "\n")], 4: [("no", "")], 6: [("x", "\n"), ("", "\r\n")]}
    assert all("".join(a + b for a, b in v) == texts[k] for k, v in got.items())


def test_relative_paths(spark):
    import posixpath

    pairs = [("a/b/c", "a/b/d"), ("a/b/c", "a/x/y"), ("c", "a/b"), ("a/b", "a"), ("a/b/c", "q"), ("a/b/c", "a/b")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, t string")
    got = [r[0] for r in df.orderBy("i").select(paths.relative_path(F.col("p"), F.col("t"))).collect()]
    assert got == [posixpath.relpath(t, posixpath.dirname(p)) if posixpath.dirname(p) else t for p, t in pairs]


def test_documented_rows(spark):
    index = spark.createDataFrame([("Window (deprecated)", "deprecated", 1), ("Window Method (deprecated)", "deprecated", 2), ("Screen Method", "deprecated,old", 3), ("Current", "", 4)], "name string, flags string, page int")
    matrix = spark.createDataFrame([("Window", "Class"), ("window(i As Integer)", "Method"), ("Screen", "Method"), ("Screen", "Class"), ("Window", "Event"), ("Current", "Class"), ("", "Class")], "old string, kind string")
    assert sorted(map(str, ((r["old"], r["kind"], r["page"]) for r in catalog.documented_rows(matrix, index).collect()))) == sorted(map(str, [("Window", "Class", 1), ("window(i As Integer)", "Method", 2), ("Screen", "Method", 3), ("Screen", "Class", 3), ("Window", "Event", None), ("Current", "Class", None), ("", "Class", None)]))



def test_differences_turn_one_text_into_the_other(spark):
    import difflib
    import random

    r = random.Random(6)
    many = lambda ns: "".join(f"line {n}\n" for n in ns)
    line = lambda: r.choice(["a", "b", "c", "", "dd"])
    pairs = [("\n".join(line() for _ in range(r.randrange(0, 40))), "\n".join(line() for _ in range(r.randrange(0, 40)))) for _ in range(60)]
    pairs += [("a\nb\n", "a\nb"), (None, "x"), ("x", None), ("", ""), (many(range(30)), many([*range(14), 99, *range(14, 30)])), (many([99, *range(30)]), many([*range(20), *range(22, 30), 98]))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    changes = differences.line_changes(df, ["i"], "a", "b")
    got = {}
    for x in changes.orderBy("i", "seq").collect():
        got.setdefault(x["i"], []).append((x["op"], x["line"]))
    for i, (a, b) in enumerate(pairs):
        split = lambda t: (t[:-1] if t.endswith("\n") else t).split("\n") if t else []
        rows = got.get(i, [])
        assert [t for op, t in rows if op != "+"] == split(a) and [t for op, t in rows if op != "-"] == split(b)
    # On texts with one way to say it the hunks are those of the standard library.
    want = {}
    for i in (64, 65):
        a, b = (p[:-1].split("\n") for p in pairs[i])
        want[i] = [t for t in difflib.unified_diff(a, b, lineterm="")][2:]
    shown = differences.hunks(changes.filter("i >= 64"), ["i"]).orderBy("i", "hunk").collect()
    assert {i: [t for x in shown if x["i"] == i for t in (x["header"], *x["body"].split("\n"))] for i in want} == want
