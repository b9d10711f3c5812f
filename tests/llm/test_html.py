import random

import pytest

from histlake.llm import html


def main(source, template=()):
    return html.Page(source).main_text(set(template))[0]


def test_blocks_references_and_space():
    assert main("<article><h1>A &amp; B</h1><p>one\n  two<br>three <b>fo</b>ur&copy; &#233;&nbsp;x</p><ul><li>x<li>y</ul>tail</article>") == "A & B\n\none two three four© é x\n\nx\n\ny\n\ntail"


def test_boilerplate_goes():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script><style>p{}</style></head>
    <body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use</div>
    <article><header><h1>Title</h1></header><p>Body a < b and <i>more</i></p><div class="ad">Buy</div><form>name</form>
    <aside>side</aside><footer>share</footer><section id="comments"><p>First!</p></section></article><div role="complementary">x</div><footer>&copy;</footer></body></html>"""
    assert main(page) == "Title\n\nBody a < b and more"


def test_no_article_and_broken_pages():
    assert main("<body><div id=sidebar>no</div><div><p>yes<p>also <b>bold</div>end") == "yes\n\nalso bold\n\nend"
    assert main(None) == main("") == main("<") == "" or main("<") == "<"
    assert main("plain text") == "plain text"
    assert main("<article><p>cut <a href=\"x") == "cut"
    assert main("<article><p title=\"a>b\">kept</p><p class='x'>too</p>") == "kept\n\ntoo"


def test_template_texts_go_outside_articles(spark):
    rows = [(i, f"http://host.example/{i}", f"<body><div><p>Welcome to our place</p></div><div><p>story number {i}</p></div><div><p>Call us</p></div></body>") for i in range(8)]
    rows += [(100, "http://other.example/", "<body><p>Welcome to our place</p></body>"), (101, None, "<p>no host"), (102, "odd", None)]
    rows += [(103 + i, "http://same.example/", "<body><p>all alike</p></body>") for i in range(3)]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"story number {i}" for i in range(8))
    assert out[100] == "Welcome to our place" and out[101] == "no host" and out[102] == "" and out[103] == "all alike"


def test_query_and_empty(spark, tmp_path):
    rows = [(1, "http://a.example/", "<article><p>x é</p></article>", "clash"), (1, "http://a.example/", "<article><p>x é</p></article>", None), (None, "http://a.example/", None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in html.op4_html_extraction(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == [(1, "x é", 3), (1, "x é", 3), (None, "", 0)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes_need_equal_vectors(spark):
    pages = [(i, "http://h.example/", "<body><ul>" + "".join(f"<li>{i}.{k}" for k in range(i)) + "</ul><p>t</p></body>") for i in range(1, 6)]
    (row,) = html.templates(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    page = html.Page(pages[3][2])
    body = html._below(html.DOCUMENT, "body")
    assert {body, html._below(body, "ul"), html._below(body, "p")} <= set(row["template"])
    assert html._below(html._below(body, "ul"), "li") in page.tokens() and html._below(html._below(body, "ul"), "li") not in row["template"]


def test_template_texts_go_inside_articles(spark):
    body = "<body><article><h1>Title {0}</h1><div class='x1'><p>Subscribe to our letters</p></div><p>story number {0}</p></article></body>"
    rows = [(i, "http://notice.example/", body.format(i)) for i in range(8)]
    # copies of one article, and two pages with a text in common, keep all
    rows += [(10 + i, "http://copies.example/", body.format(1)) for i in range(5)]
    rows += [(20 + i, "http://pair.example/", body.format(i)) for i in range(2)]
    # an article that holds only a repeated text gives way to the slots outside
    rows += [(30 + i, "http://promo.example/", f"<body><article><p>Buy {'ABC'[i % 3]}</p><p>Call us</p></article></body>") for i in range(3)]
    rows += [(33, "http://promo.example/", "<body><article><p>Call us</p></article><div>story 33</div></body>")]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Title {i}\n\nstory number {i}" for i in range(8))
    whole = "Title {0}\n\nSubscribe to our letters\n\nstory number {0}"
    assert all(out[10 + i] == whole.format(1) for i in range(5)) and all(out[20 + i] == whole.format(i) for i in range(2))
    assert [out[30 + i] for i in range(4)] == ["Buy A", "Buy B", "Buy C", "story 33"]


def test_article_marks():
    import xxhash

    for n in range(1, 9):
        marks = 0
        for k in range(n):
            marks |= html._article_mark(xxhash.xxh64_intdigest(str(k))) & (1 << 64) - 1
        assert 1 <= max((marks >> 8 * i & 255).bit_count() for i in range(8)) <= n


def brute(rows, hints=True):
    """(page_id, text) of each row, sorted: vectors as whole tables, classes by equality, the region by looking at all containers."""
    by_host = {}
    for page_id, url, source in rows:
        by_host.setdefault(html.host(url), []).append((page_id, html.Page(source, hints)))
    out = []
    for name, pages in by_host.items():
        vectors, articles, masses, times = {}, {}, {}, {}
        for i, (_, page) in enumerate(pages):
            texts = [(t, m, k) for t, m, k, _ in page.blocks]
            own = tuple(k for _, m, k in texts if m)
            outside = {k for _, m, k in texts if not m} | {e[0] for e in page.elements}
            for token in [e[0] for e in page.elements] + [k for _, _, k in texts]:
                vectors.setdefault(token, {}).setdefault(i, 0)
                vectors[token][i] += 1
                articles.setdefault(token, set()).add(None if token in outside else own)
            for at, (token, _, region) in enumerate(page.elements):
                times[token] = times.get(token, 0) + 1
                below = {at}
                for k in range(at + 1, len(page.elements)):
                    if page.elements[k][1] in below:
                        below.add(k)
                if region:
                    masses[token] = masses.get(token, 0) + sum(len(t) for t, _, _, e in page.blocks if e in below)
        common = {t: tuple(sorted(v.items())) for t, v in vectors.items() if name and len(pages) > 1 and len(v) > 1 and 2 * len(v) >= len(pages) and (None in articles[t] or len(articles[t]) >= 3)}
        template = {t for t, v in common.items() if list(common.values()).count(v) > 1}
        whole = max((masses.get(t, 0) for t in template), default=0)
        regions = [(masses[t], t) for t in template if 0 < masses.get(t, 0) >= whole * html.REGION_SHARE and times[t] == len(vectors[t])]
        region = min(regions)[1] if regions else html.DOCUMENT
        for page_id, page in pages:

            def held(at):
                return region == html.DOCUMENT or at > 0 and (page.elements[at][0] == region or held(page.elements[at][1]))

            free = [b for b in page.blocks if b[2] not in template]
            tries = [[b for b in free if held(b[3]) and b[1]], [b for b in free if b[1]], [b for b in free if held(b[3])], free, [b for b in page.blocks if b[1]], page.blocks]
            out.append((page_id, "\n\n".join(b[0] for b in next((t for t in tries if t), []))))
    return sorted(out)


def made_pages(rng):
    """Pages of several hosts: fixed texts in and beside the articles, some without an article element."""
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = []
    for h in range(12):
        frame = rng.choice(["<article>{}</article>", "<div class=c7>{}</div>", "<div><div>{}</div></div>", "<main><div>{}</div></main>"])
        box, foot, promo = f"<div class=x{h}><p>{say(6)}</p><p>{say(3)}</p></div>", f"<div id=y>{say(5)}</div>", f"<p>{say(8)}</p>"
        for i in range(rng.choice([1, 2, 3, 9, 25])):
            body = [f"<h1>{say(4)}</h1>"] + [f"<p>{say(30)}</p>" for _ in range(rng.randrange(1, 5))]
            if rng.random() < 0.8:
                body.insert(rng.randrange(len(body) + 1), box)
            menu = "<ul>" + "".join(f"<li>{say(1)}" for _ in range(rng.randrange(4))) + "</ul>"
            rows.append((1000 * h + i, f"http://h{h}.example/{i}", f"<html><body>{menu}{promo if rng.random() < 0.9 else ''}{frame.format(''.join(body))}{foot}</body></html>"))
    return rows + [(90_000, None, "<p>no host"), (90_001, "odd", None)]


@pytest.mark.parametrize("hints", [True, False])
def test_extraction_equals_brute_force(spark, hints):
    rows = made_pages(random.Random(8))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = sorted((r["page_id"], r["text"]) for r in html.extract(frame, hints=hints).collect())
    assert out == brute(rows, hints)
    # the template decides: without it, most pages hold other text
    bare = sorted((i, html.Page(x, hints).main_text(set())[0]) for i, _, x in rows)
    assert sum(a != b for a, b in zip(out, bare, strict=True)) > 0.5 * len(rows)


def test_repeated_rows_change_nothing(spark):
    rows = made_pages(random.Random(3)) + [(i, "http://twice.example/", f"<body><article><p>Alpha story</p><p>Own {i}</p></article></body>") for i in range(8)]
    once = spark.createDataFrame(rows, "page_id long, url string, html string")
    twice = spark.createDataFrame(rows * 2, "page_id long, url string, html string").repartition(3)
    texts = lambda frame: sorted({(r["page_id"], r["text"]) for r in html.extract(frame).collect()})
    assert texts(twice) == texts(once)


def test_given_pages_need_no_hints(spark):
    """On the given tables the template and the main region alone find the article that its tag marks."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    lone = {r["host"] for r in pages.select(html._host(pages["url"]).alias("host")).groupBy("host").count().where("count < 8").collect()}
    read = lambda hints: {r["page_id"]: r["text"] for r in html.extract(pages, hints=hints).collect() if html.host(r["url"]) not in lone}
    marked, deduced = read(True), read(False)
    assert len(marked) > 50
    assert sum(marked[i] == deduced[i] for i in marked) >= 0.95 * len(marked)


def test_very_long_and_deep_pages(spark):
    deep = "<div>" * 20_000 + "<p>core" + "</div>" * 20_000 + "</x>" * 20_000
    long_ = "<article>" + "<p>word " * 50_000 + "</article>"
    rows = [(i, "http://big.example/", x) for i, x in enumerate((deep, long_, "<" * 100_000, "<a " * 50_000, "&amp;" * 50_000))]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == "core" and out[1].count("word") == 50_000 and out[4] == "&" * 50_000


ARTICLE = "<h1>The Title</h1><p>First paragraph of text.</p><section class='related-work'><p>Related work.</p></section><p class='ad-hoc'>Ad hoc.</p><div id='social-policy'><p>Policy.</p></div>"
KEPT = ["The Title", "First paragraph of text.", "Related work.", "Ad hoc.", "Policy."]


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<body class='has-sidebar'><nav>Menu</nav><article>{}</article><div class='ad'>Buy</div></body>", KEPT),
        ("<html class='no-banner'><body class='post no-comments'><article>{}</article></body>", KEPT),
        ("<body><div aria-hidden='false'><article>{}</article></div><div aria-hidden='true'>Not shown</div></body>", KEPT),
        ("<body><article><div class='article-header'><h1>Head</h1></div>{}</article><div class='site-footer'>Foot</div></body>", ["Head", *KEPT]),
        ("<body><div class='sidebar-layout'><article>{}</article><div class='sidebar'>Links</div></div></body>", KEPT),
        ("<body><form id='page'><article>{}</article><input></form><form>Search</form></body>", KEPT),
        ("<body><article>{}<div class='comments'><article class='comment'>Nice</article></div></article></body>", KEPT),
        ("<body><article>{}</article><div id='comments'><article class='comment-body'>Nice</article></div></body>", KEPT),
        ("<body class='ads'><div class='widget-area'><h1>The Title</h1><p>First paragraph of text.</p></div><div class='cookie-notice'>Cookies</div></body>", KEPT[:2]),
        ("<div data-hidden='x'>Shown</div><div hidden>Not shown</div><div hidden=''>Nor this</div>", ["Shown"]),
        ("<body><div class='ad'>Only adverts</div></body>", ["Only adverts"]),
    ],
)
def test_classes_are_hints(page, expected):
    assert [b[0] for b in html.Page(page.replace("{}", ARTICLE)).blocks] == expected


def test_class_of_the_body_leaves_articles(spark):
    """Six pages of one host whose body has a class with a word for what stands beside articles."""
    rows = [(i, f"http://a.example.org/{i}", f"<body class='has-sidebar'><nav>Menu</nav><article><h1>Title {i}</h1><p>Text {i} of its own.</p></article><footer>Foot</footer></body>") for i in range(6)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in found.collect()} == {i: f"Title {i}\n\nText {i} of its own." for i in range(6)}


def test_deep_elements_with_words_are_linear():
    page = html.Page("<div class='ad'>" * 20_000 + "x" + "</div>" * 20_000 + "<article>y</article>")
    assert [b[0] for b in page.blocks] == ["y"]
