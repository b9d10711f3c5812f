"""URL filters against plain Python, SQL and held-out labels."""

import random
import re
from itertools import combinations

import duckdb
import pytest

from histlake.llm import urls
from histlake.llm.common import work_dir

ODD = [None, "", "no scheme", "://", "http://", "HTTP://Example.ORG/es/1?x#y", "http://example.org/en/19", "http://a.example.org/en/2", "http://org?q", "http://org/", "http://xorg/", "x://b.com/de/?a=1&b&a=2#frag#2", "http://u@a.com:80/de/", "http://É.com/fr/é/99.html", "a://b://c.org/d", "http://com/de/\nx", "http://h.org/" + "s/" * 3000, "http://" + "x." * 2000 + "org/"]


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?", url or "")
    low = lambda t: re.sub("[A-Z]", lambda x: x[0].lower(), t)
    return (low(m[1]), m[2], (m[3] or "")[1:], (m[4] or "")[1:]) if m else ("", "", "", "")


def plain_tokens(url):
    host, path, query, fragment = split(url)
    found = ["h:" + x for x in re.split("[.:@]", host) if x] + ["p:" + x for x in path.split("/") if x] + ["q:" + x.split("=")[0] for x in query.split("&") if x.split("=")[0]] + (["f:" + fragment] if fragment else [])
    return {re.sub("[0-9]+", "#", t) for t in found}


def plain_listed(url):
    host, path, *_ = split(url)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_tokens_and_lists_equal_plain_python(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    for r in df.select("url", urls.tokens(df.url).alias("t"), urls.host(df.url).alias("h"), urls.path(df.url).alias("p")).collect():
        assert (set(r["t"]), len(r["t"])) == (plain_tokens(r["url"]), len(plain_tokens(r["url"]))), r["url"]
        assert (r["h"], r["p"]) == split(r["url"])[:2]
    none = spark.createDataFrame([], "rule array<string>, n_bad long, n long, key string")
    judged = urls.judge(df.withColumn("rule", df.page_id).withColumn("__x", df.url), urls.listed_rules(spark), none)
    assert judged.columns == ["page_id", "url", "rule", "__x", "host", "path", "verdict", "n_rules", "mined"]
    for r in judged.collect():
        rule, verdict = plain_listed(r["url"])
        assert (r["rule"], r["verdict"], r["n_rules"]) == (rule, verdict or "allow", 0)


def made(rng, n, spam=0.9):
    """Labelled URLs; those of shops that sell pills and have a feed key are bad, so are single hosts; the rest seldom."""
    out = []
    for _ in range(n):
        sub, name, top = rng.choice(["www", "m", "shop"]), rng.choice([f"n{i}x" for i in "abcdefgh"] + ["farm"]), rng.choice(["com", "net"])
        p, q = rng.choice(["pills", "news", "en"]), rng.choice(["", "?feed=1", "?page=2&ref=x", "#top"])
        bad = name == "farm" or sub == "shop" and p == "pills" and q == "?feed=1"
        out.append((f"https://{sub}.{name}.{top}/{p}/{rng.randrange(9999)}{q}", rng.random() < (0.97 if bad else 0.05), bad))
    return out


def test_mined_rules_equal_all_combinations(spark):
    rows = made(random.Random(3), 1500)
    labelled = spark.createDataFrame([r[:2] for r in rows] + [(rows[0][0], None), (None, True)], "url string, bad boolean")
    found = {tuple(r["rule"]): (r["n_bad"], r["n"], r["key"]) for r in urls.mined_rules(labelled, work_dir(spark)).collect()}
    counts, often = {}, {}
    for url, bad, _ in rows:
        t = sorted(plain_tokens(url))
        for x in t:
            often[x] = often.get(x, 0) + 1
        for k in (1, 2, 3):
            for c in combinations(t, k):
                a, b = counts.get(c, (0, 0))
                counts[c] = (a + bad, b + 1)
    sure = {c for c, (a, b) in counts.items() if a >= urls.LEAST and a >= b * urls.CONFIDENCE}
    least = {c for c in sure if not any(p in sure for k in range(1, len(c)) for p in combinations(c, k))}
    assert found == {c: (*counts[c], min(c, key=lambda x: (often[x], x))) for c in least}
    assert ("h:farm",) in found and ("h:shop", "p:pills", "q:feed") in found


def test_held_out_urls(spark):
    rng = random.Random(9)
    labelled = spark.createDataFrame([r[:2] for r in made(rng, 2000)], "url string, bad boolean")
    rules = urls.mined_rules(labelled, work_dir(spark))
    held = made(rng, 1500)
    pages = spark.createDataFrame([(i, u, b) for i, (u, _, b) in enumerate(held)], "page_id long, url string, bad boolean")
    judged = urls.judge(pages, urls.listed_rules(spark, (("nowhere", "/", "block"),)), rules).collect()
    right = sum((r["verdict"] == "block") == r["bad"] for r in judged)
    assert len(judged) == 1500 and right >= 0.98 * len(judged)


def test_urls_of_very_many_tokens(spark):
    """Subsets of 3,000 tokens that repeat in many rows are not all made."""
    long_ = "http://h.com/" + "/".join(chr(97 + i % 26) * (i // 26 + 1) for i in range(3000))
    labelled = spark.createDataFrame([(long_, True)] * 60 + [("http://h.com/a", False)] * 40, "url string, bad boolean")
    rules = urls.mined_rules(labelled, work_dir(spark))
    assert rules.count() > 0
    judged = urls.judge(spark.createDataFrame([(1, long_), (2, "http://h.com/a"), (3, None)], "page_id long, url string"), urls.listed_rules(spark), rules)
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_wide_urls_keep_all_rules(spark):
    """Tokens past the ones that FP-growth takes: twins, pairs and triples of wide URLs, counted in narrow ones too."""
    rng = random.Random(4)
    worse, rows = [chr(97 + i) + "z" for i in range(14)], []
    for i in range(400):
        if i % 4:
            held, bad = {*rng.sample(["us", "vs", "ws"], 2), "xs", "xt"}, rng.random() < 0.05
        else:
            held, bad = {w for w in worse if rng.random() < 0.95} | {"xs", "xt"}, rng.random() < 0.7
            if i % 8:
                held, bad = held | {"us", "vs", "ws"}, True
        rows.append(("http://h/" + "/".join(sorted(held)), bad))
    found = {tuple(r["rule"]): (r["n_bad"], r["n"]) for r in urls.mined_rules(spark.createDataFrame(rows, "url string, bad boolean"), work_dir(spark)).collect()}
    counts = {}
    for url, bad in rows:
        for k in (1, 2, 3):
            for c in combinations(sorted(plain_tokens(url)), k):
                a, b = counts.get(c, (0, 0))
                counts[c] = (a + bad, b + 1)
    sure = {c for c, (a, b) in counts.items() if a >= urls.LEAST and a >= b * urls.CONFIDENCE}
    least = {c for c in sure if not any(p in sure for k in range(1, len(c)) for p in combinations(c, k))}
    assert found == {c: counts[c] for c in least}
    assert ("p:us", "p:vs", "p:ws") in found


@pytest.mark.parametrize("case", ["made", "empty", "unlabelled"])
def test_query_equals_sql(spark, tmp_path, case):
    rng = random.Random(1)
    pages, labels = [], []
    if case != "empty":
        pages = [(i, u) for i, u in enumerate(ODD)] + [(100, ODD[5]), (None, ODD[6]), (100, ODD[5])]
        for i in range(600):
            host, lang = rng.choice(["a.example.org", "b.example.com", "spam.example.net", "org"]), rng.choice(["de", "en", "fr", "es"])
            pages.append((1000 + i, f"http://{host}/{lang}/{i}{rng.choice(['', '/', '.html', '?k=1'])}"))
    if case == "made":
        labels = [(i, rng.choice([0, 1, 1, None]), rng.choice([0, 0, 0, 1, None])) if i % 3 else (i, 0, 0) for i in range(0, 600, 2)] + [(4, 0, 0), (4, 1, 0), (None, 0, 0), (5000, 0, 1)]
    spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = urls.op13_url_filters(spark, str(tmp_path))
    columns = ["page_id", "host", "path", "rule", "verdict", "n_rules", "mined"]
    assert out.columns == columns
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    told = lambda rows: sorted(tuple("-" if x is None else str(x) for x in r) for r in rows)
    got = told(out.collect())
    assert got == told(con.execute(f"SELECT {', '.join(columns)} FROM ({urls.OP13_SQL})").fetchall())
    assert len(got) == len(pages)
    if case == "made":
        assert any(r[-1] != "-" for r in got)
