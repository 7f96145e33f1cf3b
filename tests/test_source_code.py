"""Masks, calls, loops and formatting on small texts."""

import collections
import random
from html.parser import HTMLParser

from sievework.functions import calls, segment
from sievework.operators import formatting, tags


def code(text):
    return [x.strip() for x in segment.masked_text(text).split("\n")]


def test_masks_keep_lengths_and_places():
    r = random.Random(4)
    parts = ['"a""b"', "x", " ", "'", "//", "\n", "\r\n", "#tag Note\n", "#tag EndNote\n", "Begin A b\n", "End\n", "rem", "é", '"', "#if TargetX\n", "#endif\n"]
    for _ in range(400):
        t = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        m = segment.masked_text(t)
        c = segment.conditional_text(m)
        assert len(m) == len(t) == len(c) and all(a == b for a, b in zip(t, m, strict=True) if a in "\r\n") and all(a in (b, " ") for a, b in zip(m, t, strict=True))


def test_what_is_code():
    assert code('a = "b // c" \' d\n  REM x\nremark = 1') == ['a = "      "', "", "remark = 1"]
    assert code('s = "say ""hi""" + t') == ['s = "    ""  """ + t']
    assert code("#tag Note\nBegin Window w\nold = 1\n#tag EndNote\nnew = 1") == ["", "", "", "", "new = 1"]
    assert code("#tag Constant, Name = k\n#Tag Instance, a\nx\n#tag EndConstant\ny") == ["", "", "", "", "y"]
    assert code("#tag Note\nx\n#tag EndMethod\ny\n#tag endnote\nz") == ["", "", "", "", "", "z"]
    assert code("#tag note\nx\n#tag endnote") == ["", "x", ""]
    assert code("Begin A b\nBegin C d\nx\nEnd\ny\nEnd\nz\nEnd If") == ["", "", "", "", "", "", "z", "End If"]


def test_what_depends_on_the_target():
    of = lambda t: [i for i, x in enumerate(segment.conditional_text(t).split("\n")) if x.strip()]
    assert of("a\n#If TargetX Then\nb\n#Else\nc\n#EndIf\nd") == [1, 2, 3, 4, 5]
    assert of("#If Debug Then\na\n#ElseIf TargetX Then\nb\n#EndIf\nc") == [2, 3, 4]
    assert of("#If Debug Then Break\na\n#If TargetX Then b\nc") == [2]
    assert of("#If TargetX Then\n#If Debug Then\na\n#EndIf\nb\n#EndIf\nc") == [0, 1, 2, 3, 4, 5]
    assert of("#EndIf\na") == []


def test_calls_and_arguments():
    assert calls.call_span('f("(", g(1)) + (2)', 0) == (1, 11) and calls.call_span("f(1", 0) is None and calls.call_span("f", 0) is None
    assert calls.arguments('s, "a,b", f(x, y), "q""u,o"') == ["s", ' "a,b"', " f(x, y)", ' "q""u,o"'] and calls.arguments("") == [""]
    good, bad = ("s", "a.b", 'f.Child("x").Name', "s.Trim.Uppercase", 'NthField(s, "(", 1)', "a(b(c)).d"), ('"x"', "(a)", "", "a + b", 'x + "y"')
    assert all(map(calls.can_receive, good)) and not any(map(calls.can_receive, bad))
    assert calls.to_methods('x = Left(Left(s, 2), 1) + Left("a", 1) + t.Left(3)', "left", "Left", True) == ('x = s.Left(2).Left(1) + Left("a", 1) + t.Left(3)', 2, 1, 0)
    assert calls.to_methods("x = Len(s)", "Len", "Length", True)[0] == "x = s.Length" and calls.to_methods("Len(s", "Len", "L", True) == ("Len(s", 0, 0, 1)


def test_index_expressions_and_loops():
    for given, want in {"5": "4", "1": "0", "i + 1": "i", "i+1": "i", "x": "x - 1", "x+10": "(x+10) - 1", "f(x)": "(f(x)) - 1"}.items():
        assert calls.less_one(given) == want
    assert calls.to_zero_based("a = Mid(s, Mid(t, 2), n) + u.Mid(i + 1) + Mid(x)", "mid", "Middle")[:2] == ("a = s.Middle((t.Middle(1)) - 1, n) + u.Middle(i) + Mid(x)", 3)
    text = "For i = 0 To 5\nMid(s, i)\nFor Each j In k\nMid(s, j)\nNext\nMid(s, i + 1)\nNext\nMid(s, i)\nFor q = 9 To 1 Step -1\nMid(s, q)\nNext\nFor w = 1 To 9 Step z\nMid(s, w - 1)"
    assert [(n, v) for n, _, _, v in calls.loop_starts(text, "Mid")] == [(2, "risky"), (4, "review"), (6, "safe"), (8, "review"), (10, "safe"), (13, "review")]


def test_formatting_settles():
    r = random.Random(8)
    kinds = ["Module", "Method", "Note", "Instance"]
    for _ in range(200):
        lines, opened = [], []
        for _ in range(r.randrange(12)):
            if opened and r.random() < 0.4:
                lines.append(" " * r.randrange(3) + "#tag End" + opened.pop())
            elif r.random() < 0.5:
                kind = r.choice(kinds)
                lines.append("#TAG " + kind)
                opened += [kind] * (kind != "Instance")
            else:
                lines.append("  x")
        lines += ["#tag End" + k for k in reversed(opened)]
        once = formatting.indented_tags("\n".join(lines))
        assert formatting.indented_tags(once) == once and once.count("\n") == max(len(lines) - 1, 0)


class Stack(HTMLParser):
    """Problems of a page by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in tags.STANDALONE:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in tags.STANDALONE:
            return
        if not self.open:
            self.found.append(("unexpected", tag))
        elif self.open[-1] != tag:
            self.found.append(("mismatched", tag))
        while self.open and tag in self.open and self.open[-1] != tag:
            self.open.pop()
        self.open[-1:] = []


def test_tag_problems_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = collections.Counter()
    for r in pages.collect():
        s = Stack()
        s.feed(r["html"])
        s.close()
        want.update((r["page_id"], *p) for p in s.found + [("unclosed", t) for t in s.open])
    got = {(r["page_id"], r["problem"], r["tag"]): r["n"] for r in tags.problems(pages, "page_id", "html").collect()}
    assert got == dict(want) and len(got) > 50
