"""Tag regions, designer blocks and manifests: one case for each code, and random files against two separate walks."""

import random

from sievework.operators import designer


def codes(spark, *files):
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "id int, path string, text string")
    out = [[] for _ in files]
    for x in designer.designer_problems(df, "id", "path", "text").collect():
        out[x["id"]].append((x["line_no"], x["code"], x["detail"]))
    return [sorted(o) for o in out]


def test_each_code(spark):
    w = "a/b.src_window"
    files = [
        (w, "#tag Window\nBegin Label A\n   Text = x\nEnd\n#tag EndWindow\n"),
        (w, "#tag EndWindow\n"),
        (w, "#tag Window\n  #tag Method\n#tag EndWindow\n"),
        (w, "#tag Window\n #tag 9\n#tag EndWindow"),
        (w, "#tag Window\n"),
        (w, "nothing\n"),
        (w, "#tag Window\n#tag Future, x=1\n#tag EndWindow\n"),
        ("x.src_menu", "#tag Class\n#tag EndClass\n"),
        (w, "End Image\n#tag Window\nBegin Canvas C\nEnd Image\n#tag EndWindow\n"),
        (w, "#tag Window\nBeginDesignBlock Name\n#tag EndWindow\n"),
        (w, "#tag Window\n#tag EndWindow\nBegin Label outside\n"),
        (w, ""),
        (w, None),
        ("i.src_image", "#tag MultiImage\nImage\nEnd Image\nImage one\nEnd\n#tag EndMultiImage\n"),
        (w, "#tag Window\n#tag Extra\n#tag EndExtra\n#tag EndMenu\n#tag EndWindow\n"),
    ]
    assert codes(spark, *files) == [
        [],
        [(0, "XJT005", ""), (1, "XJT001", "Window")],
        [(3, "XJT002", "Window for Method")],
        [(2, "XJT003", "")],
        [(1, "XJT004", "Window")],
        [(0, "XJT005", "")],
        [(2, "XJT101", "Future")],
        [(1, "XJT102", "Class")],
        [(1, "XJB002", "Image"), (4, "XJB003", "Image for Canvas")],
        [(2, "XJB004", "DesignBlock")],
        [],
        [],
        [],
        [],
        [(2, "XJT101", "Extra"), (4, "XJT002", "Menu for Window"), (5, "XJT001", "Window")],
    ]


def brute(lines, extension):
    """Tags in one walk, blocks in another, each with a stack of its own."""
    ends = {x[8:].lower() for x in lines if x.startswith("#tag End")}
    alone = lambda k: k in designer.STANDALONE or (k not in designer.KNOWN and k.lower() not in ends)
    out, stack, first = [], [], None
    for n, x in enumerate(lines, 1):
        if x.startswith("#tag End"):
            k = x[8:]
            if not stack:
                out.append((n, "XJT001"))
                continue
            if stack[-1][0].lower() != k.lower():
                out.append((n, "XJT002"))
                while len(stack) > 1 and k.lower() in [s[0].lower() for s in stack[:-1]] and stack[-1][0].lower() != k.lower():
                    stack.pop()
            stack.pop()
        elif x.startswith("#tag "):
            k = x[5:]
            if not stack and first is None:
                first = (n, k)
            if k not in designer.KNOWN:
                out.append((n, "XJT101"))
            if not alone(k):
                stack.append((k, n))
    out += [(n, "XJT004") for _, n in stack]
    if first is None:
        out.append((0, "XJT005"))
    elif first[1] not in designer.OUTER[extension].split():
        out.append((first[0], "XJT102"))
    tags, blocks = [], []
    for n, x in enumerate(lines, 1):
        if x.startswith("#tag End"):
            tags = tags[:-1]
        elif x.startswith("#tag "):
            tags += [] if alone(x[5:]) else [x[5:]]
        elif x.startswith("Begin "):
            blocks += [(x.split()[1], n)] if any(t in designer.DESIGNER for t in tags) else []
        elif x == "Image":
            blocks += [("Image", n)] if "MultiImage" in tags else []
        elif x == "End":
            blocks = blocks[:-1]
        elif x.startswith("End "):
            if not blocks:
                out.append((n, "XJB002"))
            elif blocks[-1][0] != x[4:]:
                out.append((n, "XJB003"))
            blocks = blocks[:-1]
    return sorted(out + [(n, "XJB004") for _, n in blocks])


def test_random_files(spark):
    r = random.Random(4)
    kinds = ["Window", "Method", "MultiImage", "Instance", "Novel", "WINDOW", "Events"]
    choice = lambda: r.choice([f"#tag {r.choice(kinds)}", f"#tag End{r.choice(kinds)}", "Begin Label a", "Image", "End", "End Image", "End ScreenContent", "text"])
    texts = [[choice() for _ in range(r.randrange(1, 40))] for _ in range(200)]
    got = codes(spark, *[("f.src_window", "\n".join(t)) for t in texts])
    for g, t in zip(got, texts, strict=True):
        assert sorted((n, c) for n, c, _ in g) == brute(t, "window"), t


def test_manifest(spark):
    lines = ["Type=Tablet", "RBProjectVersion=2026.03", "", "plain", "1x=2", "Class=A;A.x;&h1;&h0;false", "Class=B;B.x;&hA;&h1;true;extra", "Module=C;;&h0a;&h99;False", "Bad=x;y;&hZZ;&h1;true", "Other=a;&h", "Type=Web"]
    df = spark.createDataFrame([(1, n, x) for n, x in enumerate(lines, 1)] + [(2, 1, "RBProjectVersion=new"), (3, 1, "Type=iOS"), (3, 2, "RBProjectVersion=2026.021")], "p int, n int, line string")
    got = {(x["p"], x["line_no"], x["code"], x["detail"]) for x in designer.manifest_problems(df, "p", "n", "line").collect()}
    assert got == {(1, 1, "XJP104", "Tablet"), (1, 2, "XJP102", "2026.03"), (1, 3, "XJP101", None), (1, 4, "XJP001", None), (1, 5, "XJP002", "1x"), (1, 8, "XJP003", "7"), (1, 8, "XJP007", "&h99"), (1, 9, "XJP004", None), (2, 0, "XJP005", "Type"), (2, 1, "XJP006", "new")}
