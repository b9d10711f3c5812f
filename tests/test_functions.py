import pytest
from pyspark.sql import functions as F

from histlake.functions import comments, objects, regexes
from histlake.operators import duplicates, scan, trees


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["a // b", "c # d", "e -- f", "g ; h", "i % j"], ["a ", "c ", "e ", "g ", "i "]),
        (["a /* b */ c", "d <!-- e --> f", "g {- h -} i"], ["a  c", "d  f", "g  i"]),
        (["a /* b", "c", "d */ e"], ["a ", "", " e"]),
        (["x --[[ y", "z ]]"], ["x ", "z ]]"]),
        (["#include <x>", "for (i=0; i<3; i++)"], ["", "for (i=0"]),
        (['s = """doc', "more", '""" + 1'], ["s = ", "", " + 1"]),
        (["a '''b''' c", "", "plain"], ["a  c", "", "plain"]),
        (["/*a*//b", "x /*a*/ // y", "/* a */ b /* c */ d"], ["/b", "x  ", " b  d"]),
        (["//*x*/ y"], [""]),
        (["a/" + "/**/" + "/b"], ["a"]),
    ],
)
def test_comment_stripping(lines, want):
    assert comments.strip_comments(lines) == want


def test_comments_join_to_a_marker():
    assert comments.strip_comments(["a /" + "/*x*/"]) == ["a "]
    assert comments.strip_comments(["a -/*x*/- b"]) == ["a "]


def test_regexes(spark):
    df = spark.createDataFrame([("abc\n",), ("abc",), ("écafé",), ("café x",), ("a\rb",)], "s string")
    match = lambda p, **k: [r["s"] for r in df.where(F.col("s").rlike(regexes.compile(spark, p, **k))).collect()]
    assert match("abc$") == ["abc"]
    assert match("(?m)^abc$") == ["abc\n", "abc"]
    assert match("café", whole_word=True) == ["café x"]
    assert match("a.b") == ["a\rb", ] or match("a.b") == ["a\rb"]
    assert match(r"[$]") == [] and match(r"\$") == []
    for bad in ("[unclosed", "(?=x)", "(?<!x)a", r"(a)\1", "a++"):
        with pytest.raises(ValueError, match="invalid regex"):
            regexes.compile(spark, bad)


COMMIT = "tree {t}\nparent {a}\nparent {b}\nauthor Ann B <a@b> 1700000000 +0100\ncommitter C <c@d> 1 +0000\n\n  Subject line \n\nbody\nparent {a}\n".format(t="1" * 40, a="a" * 40, b="b" * 40)


def test_commit_expressions(spark):
    rows = [(COMMIT,), ("tree x\n\nauthor fake <> 5 +0000",), ("no header at all",), ("author Bad <b> notanumber\n\nm",), ("tree {0}\nauthor <x@y> -5 +0000\n\n".format("2" * 40),)]
    df = spark.createDataFrame(rows, "s string")
    out = df.select(objects.commit_tree(F.col("s")).alias("tree"), objects.commit_parents(F.col("s")).alias("p"), objects.author_ts(F.col("s")).alias("ts"), objects.commit_summary(F.col("s")).alias("sum")).collect()
    assert out[0]["tree"] == "1" * 40 and out[0]["p"] == ["a" * 40, "b" * 40] and out[0]["ts"] == 1700000000 and out[0]["sum"] == "Ann B: Subject line"
    assert [r["ts"] for r in out[1:]] == [5, 0, 0, -5]
    assert out[1]["tree"] is None and out[2]["sum"] == "?: " and out[4]["sum"] == ": "


def test_other_expressions(spark):
    one = spark.range(1)
    assert one.select(objects.object_id(F.lit("blob"), F.lit("hello\n").cast("binary"))).first()[0] == "ce013625030ba8dba906f756967f9e9ca394464a"
    body = F.lit("first\n  second " + "é" * 120 + " hit\nthird hit")
    assert one.select(objects.first_match_line(body, regexes.compile(spark, "hit"))).first()[0] == ("second " + "é" * 120 + " hit")[:100] + "…"
    assert one.select(objects.first_match_line(F.lit("a\n b\t\nc"), regexes.compile(spark, "b"))).first()[0] == "b"
    assert one.select(objects.first_match_line(F.lit("abc"), regexes.compile(spark, "z"))).first()[0] == ""
    tree = b"40000 dir\0" + b"\1" * 20 + b"100644 a b\0" + b"\2" * 20
    assert objects.parse_tree(tree + b"100644 cut\0\1") == [{"mode": "40000", "name": "dir", "sha": "01" * 20, "is_tree": True}, {"mode": "100644", "name": "a b", "sha": "02" * 20, "is_tree": False}]
    df = spark.createDataFrame([(bytearray(b"x\0y"),), (bytearray(b"x" * 9000 + b"\0"),), (bytearray(b"\xff\xfe"),)], "c binary")
    assert [r[0] for r in df.select(objects.is_binary(F.col("c"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(objects.is_id(F.lit("g" * 40))).collect()] == [False] * 3
    assert one.select(objects.kind_name(F.lit(3))).first()[0] == "blob"


def test_file_rules(spark):
    names = ["a.py", "b.exe", "Makefile", "LICENSE", "LICENSE.md", "x.tar.gz", ".hidden", "CHANGELOG.txt", "notes.MD", "a.b.rs", ".bash"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.where(trees.code_file(F.col("n"))).collect()] == ["a.py", "Makefile", "a.b.rs", ".bash"]


def test_windows_and_filters(spark):
    text = "int alpha = compute();\n\nint beta = other();\n}\n}\n}\nshort\n"
    files = spark.createDataFrame([("one", text), ("two", text), ("tiny", "a")], "path string, text string")
    cut = duplicates.windows(files, 3)
    assert sorted((r["path"], r["start_line"]) for r in cut.collect()) == [("one", 1), ("two", 1)]
    found = duplicates.groups(cut, 3).collect()
    assert [(r["occurrences"], r["wasted"], r["first_path"]) for r in found] == [(2, 3, "one")]
    everything = duplicates.windows(files, 3, strip=False, filters=False)
    assert everything.where("path = 'one'").count() == 6 and everything.where("path = 'tiny'").count() == 0


def test_scan_rules(spark):
    assert scan.kinds("blobs") == ["blob"] and len(scan.kinds("all")) == 4
    with pytest.raises(ValueError):
        scan.kinds("thing")


def test_author_lines_found_without_patterns_equal_those_of_patterns(spark):
    ends = ["1700 +0100", "-5 +0000", "+7 +0000", "1" * 18 + " +1", "1" * 19 + " +1", "12  +0000", "12 +0000 ", "12 +0000\t", "12\t+0000", "x 12", "12", "", "12 +0\u00e9", "\x0b12 +0", "12 a\tb", "\u0663 +0", "1 2 3"]
    heads = ["author A <a> ", "author ", "tree x\nauthor B <b> ", "xauthor <c> ", "t\rauthor D <d> ", "t\u2028author E <e> ", " author <f>\nauthor <g> ", "author"]
    bodies = [h + e + tail for h in heads for e in ends for tail in ("", "\nauthor Z <z> 9 +0", "\r\nx", "\u0085y", "\n\n \t\x0b\f\n subject \nrest")] + ["", None]
    body, line = F.col("s"), F.regexp_extract("s", r"(?m)^author .*$", 0)
    stamp = F.try_element_at(F.split(F.trim(line), r"\s+"), F.lit(-2))
    ts = F.coalesce(F.when(stamp.rlike(r"^[+-]?\d{1,18}$"), stamp).try_cast("long"), F.lit(0).cast("long"))
    at = F.instr(body, "\n\n")
    message = F.when(at > 0, F.regexp_replace(F.substring(body, at + F.lit(2), F.length(body)), r"^\s+", ""))
    subject = F.coalesce(F.btrim(F.substring_index(message, "\n", 1), F.lit(objects.LINE_SPACE)), F.lit(""))
    tree = F.regexp_extract(objects.header(body), r"(?m)^tree ([0-9a-f]{40})$", 1)
    trees_ = ["tree " + "a1" * 20 + x for x in ("", "\nq", "\n\nz", "b\n", "\r\nq", " \n")] + ["p\ntree " + "c" * 40 + "\nq", "tree " + "g" * 40 + "\nq"]
    df = spark.createDataFrame([(b,) for b in bodies + trees_], "s string")
    pairs = [(objects.author_line(body), line), (objects.author_ts(body), ts), (objects.subject(body), subject), (objects.commit_tree(body), F.when(tree != "", tree))]
    for now, before in pairs:
        assert df.where(~now.eqNullSafe(before)).collect() == []
