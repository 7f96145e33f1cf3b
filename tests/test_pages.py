"""Section trees, members, tables, folders and locations against brute force and the cases that define them."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import locations, pages, paths

RULES = ["===", "---", "~~~~", "^^^", '"""', "###", "..."]


def brute_sections(lines):
    """Titles by one walk over the lines: (line of the title, title, level); and the lines of rules."""
    rule = lambda x: len(x) >= 3 and x[0] in pages.RULE_CHARACTERS and set(x) == {x[0]}
    found, rules, i = [], set(), 0
    while i < len(lines):
        nxt = lines[i + 1 : i + 3]
        if rule(lines[i]) and len(nxt) == 2 and nxt[0].strip() and not rule(nxt[0]) and rule(nxt[1]) and nxt[1][0] == lines[i][0]:
            found.append((i + 2, nxt[0].strip(), pages.LEVELS.get(lines[i][0], 6)))
            rules |= {i + 1, i + 3}
            i += 3
        elif lines[i].strip() and not rule(lines[i]) and not (lines[i].strip() + " ").startswith(".. ") and nxt and rule(nxt[0]):
            found.append((i + 1, lines[i].strip(), pages.LEVELS.get(nxt[0][0], 6)))
            rules.add(i + 2)
            i += 2
        else:
            i += 1
    return found, rules


def brute_tree(lines):
    found, rules = brute_sections(lines)
    heads = [(0, 1, None, 0)] * (not found or min([f[0] for f in found] + [r for r in rules]) > 1) + [(k + 1, *f) for k, f in enumerate(found)]
    out = []
    for j, (no, at, title, level) in enumerate(heads):
        stack = []
        for _, _, t, lv in heads[: j + 1]:
            if lv:
                stack = [s for s in stack if s[0] < lv] + [(lv, t)]
        nxt = next((h for h in heads[j + 1 :] if h[3] <= level or not level), None)
        last = len(lines) if nxt is None else nxt[1] - 1 - (nxt[1] - 1 in rules)
        following = heads[j + 1][1] if j + 1 < len(heads) else len(lines) + 1
        out.append((no, tuple(t for _, t in stack) if level else (), level, at, last))
        assert following > at
    return out


def test_section_trees_equal_brute_force(spark):
    r = random.Random(3)
    texts = []
    for _ in range(120):
        lines = [r.choice(["Alpha", "Beta  gamma", "", "", ".. a comment", "..", *RULES]) for _ in range(r.randrange(1, 30))]
        texts.append(lines if any(lines) else ["Alpha"])
    texts += [["===", ".. one", "===", ".. two", "===", ".. three", "==="], [".. one", "===", ".. two", "==="], ["Alpha", "===", ".. one", "===", ".. two", "==="]]
    df = spark.createDataFrame([(i, n, x) for i, t in enumerate(texts) for n, x in enumerate(t, 1)], "page int, line_no int, line string")
    got = {}
    for x in pages.section_tree(df, ["page"]).collect():
        got.setdefault(x["page"], []).append((x["section_no"], tuple(x["path"]), x["level"], x["first_line"], x["last_line"]))
    for i, t in enumerate(texts):
        want = [w for w in brute_tree(t) if w[0]]
        assert sorted(g for g in got.get(i, []) if g[0]) == want, t


def test_page_lines_and_heads(spark):
    df = spark.createDataFrame([(1, "a\tb\r\n  \t c  \x0bend\n"), (2, ""), (3, None), (4, "|sub|\nClass\n.. x\n:opt: 1\n\nTitle\n=====\nbody")], "page int, text string")
    lines = pages.page_lines(df, ["page"], "text")
    assert [x["line"] for x in lines.filter("page = 1").orderBy("line_no").collect()] == ["a   b", "     c", "end"]
    assert {x["page"] for x in lines.select("page").distinct().collect()} == {1, 4}
    heads = pages.page_heads(lines.selectExpr("*", "concat('api/p', page) as name"), ["page", "name"], "name")
    assert {(x["page"], x["title"], x["kind"]) for x in heads.collect()} == {(1, "p1", "end"), (4, "Title", "Class")}


def test_members(spark):
    text = """Method descriptions
-------------------
.. _a.b:

A.B

**B** \\(x As Integer) As String

   Does a thing.

     Deeper.
   It has been deprecated.
.. _a.c:

no bold line here
.. _a.d:
**D**
Notes
-----
.. _a.e:
**E**
"""
    df = spark.createDataFrame([(1, text)], "page int, text string")
    got = pages.members(pages.page_lines(df, ["page"], "text"), ["page"]).orderBy("line_no").collect()
    assert [(x["line_no"], x["anchor"], x["qualified"], x["name"], x["signature"], x["kind"], x["deprecated"]) for x in got] == [(3, "a.b", "A.B", "B", "\\(x As Integer) As String", "method", True), (16, "a.d", "D", "D", "", "method", False)]
    assert got[0]["body"] == ["", "Does a thing.", "", "  Deeper.", "It has been deprecated."] and got[1]["body"] == []


def test_tables_equal_the_standard_reader(spark):
    r = random.Random(9)
    cells = ["plain", " spaced ", '"a,b"', '"two\nlines"', '"say ""hi"""', "", '""', '"",x', "1", '"end"tail', '5" pipe']
    bodies = ["\n".join(", ".join(r.choice(cells) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(0, 6))) for _ in range(150)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(":widths: 1 2\n\n" + b for b in bodies)], "t int, body string")
    got = {}
    for x in pages.table_rows(df, ["t"], "body").orderBy("t", "row_no").collect():
        got.setdefault(x["t"], []).append(list(x["cells"]))
    for i, b in enumerate(bodies):
        assert got.get(i, []) == [row for row in csv.reader(io.StringIO(b.strip()), skipinitialspace=True) if any(c.strip() for c in row)], b


def test_table_headers(spark):
    bodies = [':header: x, "y, z"\n\n1, 2', ":header-rows: 1\n\n h , i\n1, 2\n3, 4", "1, 2", ":header-rows: 0\n\n1", ":header-rows: 2\n:stub:\n\na\nb\nc", "", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "t int, body string")
    got = [(x["t"], x["row_no"], x["header"], x["cells"]) for x in pages.table_rows(df, ["t"], "body").orderBy("t", "row_no").collect()]
    assert got == [(0, 1, ["x", "y, z"], ["1", "2"]), (1, 1, ["h", "i"], ["1", "2"]), (1, 2, ["h", "i"], ["3", "4"]), (2, 1, None, ["1", "2"]), (3, 1, None, ["1"]), (4, 1, ["a"], ["c"])]


def test_nearest_ancestors(spark):
    folders = spark.createDataFrame([("/a/b/c",), ("/a/b/c",), ("/a/x",), ("/r/s/t",), ("rel/one/two",), ("/",), ("",), (None,)], "f string")
    listed = spark.createDataFrame([("/a", 1), ("/a/b", 3), ("/a/b", 2), ("/", 9), ("rel", 5), ("/r", 7)], "folder string, v int")
    stops = spark.createDataFrame([("/r/s",), ("/a/b",), ("rel",)], "folder string")
    got = {(x["f"], x["ancestor"], x["v"]) for x in paths.nearest_ancestors(folders, "f", listed, stops).collect()}
    assert got == {("/a/b/c", "/a/b", 2), ("/a/x", "/a", 1), ("rel/one/two", "rel", 5), ("/", "/", 9)}
    got = {(x["f"], x["ancestor"]) for x in paths.nearest_ancestors(folders, "f", listed, stops.limit(0)).collect()}
    assert ("/r/s/t", "/r") in got and ("/a/b/c", "/a/b") in got


def test_releases(spark):
    texts = ["Type=Web\nOrigIDEVersion=20260201\n", "OrigIDEVersion=2026", "x OrigIDEVersion=20260201", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x[0] and tuple(x[0]) for x in df.select(paths.saved_release(df.t)).collect()] == [(2026, 2), None, None, None]


FILES = {
    "Helpers": ["Module Helpers", "#tag Method", "", "Function Convert(a As Text) As Text", "End Function", "", "", "Function Convert(a As Integer) As Text", "End Function"],
    "Front": ["Begin DesktopWindow MainWindow", "   Left = 1", "   Top = 2", "#tag Events SaveButton", "Sub Pressed()", "End Sub", "#tag EndEvents", "#tag Events CancelButton", "Sub Pressed()", "End Sub", "#tag EndEvents", "Sub Later()"],
    "Person": ["Protected Class Person", "#tag ComputedProperty, Flags = &h0", "#tag Getter", "Get", "Sub NotOne()", "End Get", "Set", "#tag EndGetter", "#tag Setter", "Set", "mTitle As Wrong", "#tag EndSetter", "Title As String", "Other As String", "#tag EndComputedProperty", "Sub After()"],
    "Open": ["#tag ComputedProperty", "#tag Getter", "Get", "#tag EndGetter", "#tag ComputedProperty", "Last As Text", "Sub Never()"],
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(stem, n, x, "" if x.startswith(("#", "Begin")) else x) for stem, lines in FILES.items() for n, x in enumerate(lines, 1)]
    return locations.location_index(spark.createDataFrame(rows, "stem string, line_no int, line string, code string"), ["stem"], "stem")


def test_location_index(index):
    got = {}
    for x in index.orderBy("line_no").collect():
        got.setdefault((x["container"], x["member"]), []).append(x["line_no"])
    assert got == {
        ("helpers", "convert"): [4, 8],
        ("mainwindow", "pressed"): [5, 9],
        ("mainwindow", "savebutton.pressed"): [5],
        ("mainwindow", "cancelbutton.pressed"): [9],
        ("savebutton", "pressed"): [5],
        ("cancelbutton", "pressed"): [9],
        ("mainwindow", "later"): [12],
        ("person", "title"): [4, 10],
        ("person", "title.get"): [4],
        ("person", "title.set"): [10],
        ("person", "after"): [16],
        ("open", "last"): [3],
        ("open", "last.get"): [3],
    }


def test_located(spark, index):
    asked = [(1, "Helpers.Convert", 2), (2, "MAINWINDOW.SaveButton.PRESSED", 1), (3, "Person.Title", None), (4, "Person.Title.Get", 1), (5, "Nowhere.Nothing", 1), (6, "MainWindow.Pressed", 1), (7, "alone", 1), (8, "", 1), (9, None, 1), (10, "..Person..After.", None)]
    got = locations.located(spark.createDataFrame(asked, "id int, at string, line int"), "id", "at", "line", index, ["stem"]).orderBy("id").collect()
    assert [(x["id"], x["resolution"], x["stem"], x["file_line"]) for x in got] == [(1, "ambiguous", None, None), (2, "located", "Front", 6), (3, "ambiguous", None, None), (4, "located", "Person", 5), (5, "unresolved", None, None), (6, "ambiguous", None, None), (7, "unresolved", None, None), (10, "located", "Person", 16)]
    assert [[y["file_line"] for y in x["candidates"]] for x in got if x["candidates"]] == [[6, 10], [4, 10], [6, 10]]


def test_location_keys(spark):
    df = spark.createDataFrame([("A.b.C",), ("a",), ("a.b",), (None,)], "l string")
    got = [[(k["container"], k["member"]) for k in x[0]] for x in df.select(locations.location_keys(df.l)).collect()]
    assert got == [[("a.b", "c"), ("a", "c"), ("a", "b.c")], [], [("a", "b")], []]


def random_pages(spark, seed):
    r = random.Random(seed)
    lines = ["Alpha", "Method descriptions", "Constant Descriptions", "", "", ".. a comment", "..", ".. _m.x:", "**Fn** (x)", "   body\t", "\tdeeper ", "It was deprecated.", *RULES]
    texts = ["".join(r.choice(lines) + r.choice(["\n", "\n", "\r\n", "\r", "\x0b"]) for _ in range(r.randrange(1, 40))) for _ in range(200)]
    texts += ["Method descriptions\n---\n" + "\n".join(r.choice([*lines[3:12] * 3, *RULES]) for _ in range(r.randrange(1, 40))) for _ in range(100)]
    texts += ["=====\nAlpha\n=====\nMethod descriptions\n---\n.. _m.x:\n**Fn** (x)\n", "Method descriptions\n---\n.. _a:\n.. _b:\n**Fn**", "Alpha\n===\nBeta\n===\n.. c\n===", "\n", "===\n===", "x\u2028===\x85y\n\n"]
    return spark.createDataFrame(list(enumerate(texts)), "page int, text string")


def test_members_of_pages_and_of_their_rows(spark):
    df = random_pages(spark, 5)
    whole = pages.page_arrays(df, ["page"], "text")
    rows = pages.page_lines(df, ["page"], "text")
    # The titles and rules that the pass over a page finds are those that windows over its rows find.
    roles = whole.select("page", F.posexplode(F.split(pages.section_roles(F.col("lines")), "")).alias("at", "c"))
    got = {(x["page"], x["at"] + 1): {"o": "rule", "u": "rule", "t": "text"}.get(x["c"], x["c"]) for x in roles.collect()}
    assert got == {(x["page"], x["line_no"]): str(x["level"]) if x["role"] == "title" else x["role"] for x in pages.section_lines(rows, ["page"]).collect()}
    found = pages.members(whole, ["page"])
    assert sorted(map(str, found.collect())) == sorted(map(str, pages.members(rows, ["page"]).collect())) and found.count() > 20
    # A page is cut in place: its lines are neither sorted nor put into windows.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan


def test_section_trees_of_pages_and_of_their_rows(spark):
    df = random_pages(spark, 6)
    tree = pages.section_tree(pages.page_arrays(df, ["page"], "text"), ["page"])
    # Only titles reach the windows, and none of these looks at all that follows for each of its rows.
    plan = tree._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "hashjoin" not in plan and "mergejoin" not in plan and plan.count("- window") == 2
    assert sorted(map(str, tree.collect())) == sorted(map(str, pages.section_tree(pages.page_lines(df, ["page"], "text"), ["page"]).collect()))


def test_a_page_of_many_sections(spark):
    n = 30000
    df = spark.createDataFrame([(1, "Top\n===\n" + "Part\n---\ntext\n" * n)], "page int, text string")
    tree = pages.section_tree(pages.page_arrays(df, ["page"], "text"), ["page"])
    x = tree.selectExpr("count(*) n", "max(last_line) last", "count_if(last_line = first_line + 2) flat", "count_if(own_lines = 1) own", "count_if(path = array('Top', 'Part')) inside").collect()[0]
    assert tuple(x) == (n + 1, 3 * n + 2, n, n, n)


def test_keys_and_entries_cost_what_they_need(spark):
    # The parts of a location are found once, so that one of many parts does not take the square of that for each shape.
    n = 300
    df = spark.createDataFrame([(".".join(f"P{i}" for i in range(n)),)], "l string")
    keys = df.select(locations.location_keys(df.l).alias("k"))
    got = [tuple(k) for k in keys.collect()[0]["k"]]
    parts = [f"p{i}" for i in range(n)]
    shapes = [(".".join(a), ".".join(b)) for i in range(n - 1, 0, -1) for a, b in ((parts[:i], parts[i:]), (parts[:1], parts[i:]), (parts[:i], parts[-1:]))]
    assert got == list(dict.fromkeys(shapes))
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    # The states of a file's lines share their order: sorted by line once, and by block once.
    lines = spark.createDataFrame([("s", 1, "Class A", "Class A")], "stem string, line_no int, line string, code string")
    plan = locations.location_index(lines, ["stem"], "stem")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [") == 2 and plan.count("- Window [") <= 3
