"""Registered queries of the engine against their SQL, at the smallest size."""

import hashlib
import random

import duckdb
import pytest
from histlake.operators import duplicates
from histlake.plans import star

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(star.ORACLE_SQL))
def test_equals_sql(spark, sql, name):
    df = star.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = sql.sql(star.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


MARKS = {"//": None, "#": None, "--": None, ";": None, "%": None, "/*": "*/", "<!--": "-->", "--[[": "]]", "{-": "-}", '"""': '"""', "'''": "'''"}


def without_comments(lines):
    """Character by character: the leftmost marker counts, a line marker before a block marker at one place."""
    out, inside = [], None
    for line in lines:
        kept, at = "", 0
        rest = line
        while True:
            if inside:
                end = rest.find(inside)
                if end < 0:
                    rest = ""
                    break
                rest, inside = kept + rest[end + len(inside) :], None
                kept = ""
            places = [(rest.find(m), MARKS[m] is not None, m) for m in MARKS if m in rest]
            if not places:
                break
            at, block, mark = min(places)
            if not block:
                rest = rest[:at]
                break
            kept, rest, inside = rest[:at], rest[at + len(mark) :], MARKS[mark]
            if inside not in rest:
                rest = kept
                break
        out.append(rest if not inside or rest == kept else kept)
        if inside:
            out[-1] = kept
    return out


def brute_groups(files, n, strip=True):
    """window -> (occurrences, first path, first line), with the filters of real searches."""
    found = {}
    for path, text in sorted(files):
        lines = text.split("\n")
        lines = [x.strip(" \t\n\f\r") for x in (without_comments(lines) if strip else lines)]
        for i in range(len(lines) - n + 1):
            part = lines[i : i + n]
            chars = sum(c not in " \t\n\f\r" for x in part for c in x)
            if part[0] and 10 * sum(x != "" for x in part) >= 6 * n and chars >= 25:
                found.setdefault("\n".join(part), []).append((path, i + 1))
    return {w: (len(p), *min(p)) for w, p in found.items() if len(p) > 1}


def test_stripped_groups_equal_brute_force(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    want = brute_groups([(r["page_id"], (r["html"] or "").replace(">", ">\n")) for r in pages], 3)
    got = {(r["window_md5"], r["occurrences"], r["wasted"], r["first_path"], r["first_line"]) for r in star.dup_groups_stripped(spark, FOLDER).collect()}
    assert want and got == {(hashlib.md5(w.encode()).hexdigest(), n, 3 * (n - 1), path, line) for w, (n, path, line) in want.items()}


def test_stripped_groups_of_made_files(spark):
    rng = random.Random(5)
    bits = ["value = compute(left, right)", "  return first + second * third", "", "   ", "// a note", "x = 1 # why", "/* begin", "end */ tail_of_the_block()", "<!-- gone --> kept_part_of_line", "--[[ lua", "]] after_lua_comment_here", "{- hs -} haskell_like_line_text", '"""doc', 'string""" more_python_code_here', "100 % 7", "a; b", "call(/* inline */ argument_list)", "/* one */ /* two */ both_gone"]
    files = [(i, "\n".join(rng.choice(bits) for _ in range(rng.randrange(2, 40)))) for i in range(60)]
    frame = spark.createDataFrame(files, "path long, text string")
    for n, strip in ((3, True), (2, True), (4, False)):
        found = duplicates.groups(duplicates.windows(frame, n, strip=strip), n).collect()
        want = brute_groups(files, n, strip)
        assert want and {r["window"]: (r["occurrences"], r["first_path"], r["first_line"]) for r in found} == want
        assert all(r["wasted"] == n * (r["occurrences"] - 1) and len(r["places"]) == r["occurrences"] for r in found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(star.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_groups_keep_their_first_places(spark):
    """Occurrences count all, places are the first few; hashes decide nothing."""
    rng = random.Random(7)
    block = ["alpha = compute(beta)", "gamma = alpha + delta", "return gamma * epsilon"]
    files = [(f"f{i:03d}.py", "\n".join([f"line {rng.random()} of its own, long enough"] * 2 + (block * 3 if i % 2 else []))) for i in range(80)]
    cut = duplicates.windows(spark.createDataFrame(files, "path string, text string").repartition(9), 3)
    every = {r["window"]: r for r in duplicates.groups(cut, 3, 10**6).collect()}
    few = {r["window"]: r for r in duplicates.groups(cut, 3, 5).collect()}
    assert every.keys() == few.keys() and max(r["occurrences"] for r in few.values()) == 120
    for window, r in few.items():
        full = every[window]
        assert r["places"] == full["places"][:5] and len(full["places"]) == full["occurrences"] == r["occurrences"]
        assert (r["first_path"], r["first_line"]) == tuple(r["places"][0])


def test_tree_entries_shuffle_lineitems_once(spark):
    """Files and directories are grouped after one shuffle by directory, and directories are made one by their ids alone."""
    plan = star.tree_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in plan and "hashpartitioning(l_orderkey" in plan
    assert not any("hashpartitioning(l_orderkey" in x and "l_partkey" in x.split("hashpartitioning")[1] for x in plan.splitlines())
    assert "first(files" not in plan
