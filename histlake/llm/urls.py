"""URL filters: a list of rules, and association rules mined from labels.

A URL is a set of tokens: the parts of its host, its path segments, the keys of
its query, its fragment; digits become ``#``.  Spark's FP-growth mines the token
combinations of labelled URLs; a combination that at least ``support`` bad URLs
hold, and of which at least ``confidence`` of the labelled URLs are bad, becomes
a rule.  A rule is dropped where a part of it is a rule already: it would add
nothing.  What is left is an inverted index: a rule stands under its rarest
token, so a URL looks up its own tokens and compares in full only the rules it
finds there.

Rules have up to ``longest`` tokens.  A token that is a rule by itself is in no
other, and of tokens that the very same labelled URLs hold (told by 128 bits of
hash) one is mined and stands for its twins: a rule with two of them would hold
a smaller one.  FP-growth makes all subsets of a URL's tokens, so it gets the URLs of at most
``WIDTH`` tokens that are left; combinations that wider URLs hold are counted in
all URLs, size by size, by joins.  Both ways are exact, so every rule is found.
Frequent tokens, and so the list that Spark's FP-growth keeps on
the driver, are as many as all tokens over the support at most.

A listed rule (host, path, verdict) fits its host and all below it where the
path begins with the rule's; the longest that fits wins, and goes before mined
rules.

URLs are judged once each, whatever the rows that repeat them.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
no token and no rule, and is allowed; repeated rows give repeated results;
labels of unknown URLs are not used, those of repeated rows count once for each
row; without labels, or without a bad one, nothing is mined; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table, work_dir
from .lines import LOWER, UPPER

# The listed rules of the registered query.
LISTED = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Bad URLs that a combination must be in: a share of the labelled ones, and a number.
SUPPORT, LEAST = 0.002, 10
CONFIDENCE = 0.9
#: Tokens of a URL that FP-growth takes, and of a rule.
WIDTH, LONGEST = 12, 3

URL_PARTS = r"://([^/?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?"
#: The item that stands for a bad label; tokens begin with a letter and a colon.
BAD = "bad"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    part = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, i)
    filled = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{mark}:"), x))
    keys = F.transform(F.split(F.substring(part(3), 2, 1 << 30), "&", -1), lambda x: F.substring_index(x, "=", 1))
    marked = F.concat(filled("h", F.split(host(url), "[.:@]", -1)), filled("p", F.split(path(url), "/", -1)), filled("q", keys), filled("f", F.array(F.substring(part(4), 2, 1 << 30))))
    return F.array_distinct(F.transform(marked, lambda x: F.regexp_replace(x, "[0-9]+", "#")))


def listed_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict of the distinct urls that a listed rule fits; rules: host, path, verdict.

    A URL's host is looked up by its last one, two, ... parts, as many as a rule has.
    """
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    known = rules.select(F.col("host").alias("suffix"), F.col("path").alias("begins"), F.concat("host", "path").alias("rule"), "verdict")
    seen = urls.select("url", F.split(host(F.col("url")), r"\.", -1).alias("parts"), path(F.col("url")).alias("path"))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(max(most, 1)))), lambda n: F.array_join(F.slice("parts", -n, n), "."))
    fits = seen.select("url", "path", F.explode(ends).alias("suffix")).join(known, "suffix").where(F.startswith("path", "begins"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("rule")))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


def mined_rules(labelled: DataFrame, folder: str, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, width: int = WIDTH, longest: int = LONGEST) -> DataFrame:
    """rule array<string> (sorted tokens), n_bad, n, key: combinations of tokens of bad URLs.

    labelled: url, bad boolean.  n and n_bad count labelled URLs that hold all
    of a rule's tokens, key is the rule's rarest token.
    """
    spark = labelled.sparkSession
    rows = labelled.where("bad IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "bad", tokens(F.col("url")).alias("tokens"))
    rows = materialise(rows.where("size(tokens) > 0"), folder, "labelled")
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    needed = max(least, math.ceil(round(total * support, 9)))
    schema = "rule array<string>, n_bad long, n long, key string"
    if bad < needed:
        return spark.createDataFrame([], schema)
    each = rows.select("id", "bad", F.explode("tokens").alias("token"))
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).where(F.col("n_bad") >= needed)
    counted = materialise(counted, folder, "tokens")
    sure = F.col("n_bad") >= F.col("n") * F.lit(confidence)
    singles = counted.where(sure).select(F.array("token").alias("rule"), "n_bad", "n")
    # what holds a rule is none, so its token is done with
    each = materialise(each.join(counted.where(~sure).select("token"), "token"), folder, "each")
    marks = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    alike = marks.groupBy("n", "x", "y").agg(F.min("token").alias("twin"), F.collect_list("token").alias("members"))
    twins = materialise(alike.select("twin", F.explode("members").alias("token")), folder, "twins")
    kept = each.join(twins.where("token = twin").select("token"), "token")
    bundles = materialise(kept.groupBy("id", "bad").agg(F.array_sort(F.collect_list("token")).alias("items")), folder, "bundles")
    by_growth = _grown(bundles.where(F.size("items") <= width), needed, folder, longest)
    by_joins = _joined(bundles, needed, confidence, width, folder, longest)
    if by_joins is not None:
        by_growth = by_joins if by_growth is None else by_growth.join(by_joins.select("rule"), "rule", "left_anti").unionByName(by_joins)
    if by_growth is None:
        return _indexed(singles, counted)
    found = materialise(by_growth.where((F.size("rule") > 1) & (F.size("rule") <= longest) & sure), folder, "mined")
    return _indexed(singles.unionByName(_told(_least(found, longest), twins, longest)), counted)


def _grown(bundles: DataFrame, needed: int, folder: str, longest: int) -> DataFrame | None:
    """rule, n_bad, n of the combinations that ``needed`` bad bundles hold, by FP-growth; None where there is no bundle."""
    among = bundles.count()
    if not among:
        return None
    items = bundles.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    # FP-growth takes the share of the rows and rounds up
    model = FPGrowth(itemsCol="items", minSupport=(needed - 0.5) / among, minConfidence=0.0, numPartitions=shuffle_partitions(bundles.sparkSession)).fit(items)
    frequent = materialise(model.freqItemsets.where(F.size("items") <= longest + 1), folder, "frequent")
    found = frequent.where(F.array_contains("items", BAD)).select(F.array_sort(F.array_remove("items", BAD)).alias("rule"), F.col("freq").alias("n_bad"))
    alone = frequent.select(F.array_sort("items").alias("rule"), F.col("freq").alias("n"))
    return found.join(alone, "rule").select("rule", "n_bad", "n")


def _joined(bundles: DataFrame, needed: int, confidence: float, width: int, folder: str, longest: int) -> DataFrame | None:
    """rule, n_bad, n of the combinations that bundles of more than ``width`` tokens hold, counted in all bundles; None where there is no such bundle.

    Of two and more tokens, with ``needed`` bad ones; combinations of one size
    are joined to the next, but for those that are rules already.
    """
    wide = bundles.where(F.size("items") > width)
    if wide.isEmpty():
        return None
    weights = bundles.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).withColumn("id", F.monotonically_increasing_id())
    weights = materialise(weights.withColumn("wide", F.size("items") > width), folder, "weights")
    weigh = weights.drop("items")
    known = wide.select(F.explode("items").alias("token")).distinct()
    held = weights.select("id", F.explode("items").alias("token")).join(known, "token").select("id", F.array().cast("array<string>").alias("front"), F.col("token").alias("last"))
    levels = []
    for k in range(2, longest + 1):
        further = held.select("id", "front", F.col("last").alias("next"))
        pairs = held.join(further, ["id", "front"]).where(F.col("next") > F.col("last"))
        grown = pairs.select("id", F.array_append("front", F.col("last")).alias("front"), F.col("next").alias("last"))
        counts = grown.join(weigh, "id").groupBy("front", "last").agg(F.sum("n_bad").alias("n_bad"), F.sum("n").alias("n"), F.bool_or("wide").alias("wide"))
        level = materialise(counts.where((F.col("n_bad") >= needed) & F.col("wide")).drop("wide"), folder, f"level-{k}")
        levels.append(level.select(F.array_append("front", F.col("last")).alias("rule"), "n_bad", "n"))
        if k < longest:
            open_ = level.where(F.col("n_bad") < F.col("n") * F.lit(confidence)).select("front", "last")
            held = materialise(grown.join(open_, ["front", "last"], "left_semi"), folder, f"held-{k}")
    return reduce(DataFrame.union, levels)


def _told(rules: DataFrame, twins: DataFrame, longest: int) -> DataFrame:
    """The rules, with each of its twins in the place of a token."""
    out = rules.withColumn("told", F.array().cast("array<string>"))
    for i in range(longest):
        out = out.withColumn("twin", F.get("rule", F.lit(i))).join(twins, "twin", "left")
        out = out.withColumn("told", F.when(F.col("token").isNull(), F.col("told")).otherwise(F.array_append("told", F.col("token")))).drop("twin", "token")
    return out.select(F.array_sort("told").alias("rule"), "n_bad", "n")


def _least(rules: DataFrame, longest: int) -> DataFrame:
    """The rules of which no part is a rule."""
    parts = rules.select("rule", F.explode(F.filter(_subsets(F.col("rule"), longest), lambda s: F.size(s) < F.size("rule"))).alias("part"))
    larger = parts.join(rules.select(F.col("rule").alias("part")), "part").select("rule").distinct()
    return rules.join(larger, "rule", "left_anti")


def _subsets(items: Column, longest: int) -> Column:
    """The parts of 1 to longest - 1 of a few sorted items."""
    singles = F.transform(items, lambda x: F.array(x))
    out = grown = singles
    for _ in range(longest - 2):
        more = F.flatten(F.transform(grown, lambda s: F.transform(F.filter(items, lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))
        out, grown = F.concat(out, more), more
    return out


def _indexed(rules: DataFrame, counted: DataFrame) -> DataFrame:
    """The rules with their rarest token."""
    each = rules.select("rule", "n_bad", "n", F.explode("rule").alias("token")).join(counted.select("token", F.col("n").alias("often")), "token")
    return each.groupBy("rule").agg(F.first("n_bad").alias("n_bad"), F.first("n").alias("n"), F.min_by("token", F.struct("often", "token")).alias("key"))


def mined_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, n_rules, mined of the distinct urls that a mined rule fits: how many, and the surest of them."""
    seen = urls.select("url", tokens(F.col("url")).alias("tokens"))
    hits = seen.select("url", "tokens", F.explode("tokens").alias("key")).join(rules, "key").where(F.size(F.array_except("rule", "tokens")) == 0)
    best = F.max_by(F.array_join("rule", " "), F.struct(F.col("n_bad") / F.col("n"), F.col("n_bad"), F.col("rule")))
    return hits.groupBy("url").agg(F.count("*").alias("n_rules"), best.alias("mined"))


def judge(pages: DataFrame, listed: DataFrame, mined: DataFrame) -> DataFrame:
    """pages with host, path, rule, verdict, n_rules and mined of their url, in place of columns of these names."""
    urls = pages.select(F.col("url").cast("string")).where("url IS NOT NULL").distinct()
    known = listed_verdicts(urls, listed).join(mined_matches(urls, mined), "url", "full")
    known = known.select(*(F.col(c).alias(f"__{c}") for c in known.columns))
    told = pages.join(known, F.col("url") == F.col("__url"), "left")
    verdict = F.coalesce("__verdict", F.when(F.col("__n_rules") > 0, "block").otherwise("allow"))
    columns = {"host": host(F.col("url")), "path": path(F.col("url")), "rule": F.col("__rule"), "verdict": verdict, "n_rules": F.coalesce("__n_rules", F.lit(0).cast("long")), "mined": F.col("__mined")}
    return told.withColumns(columns).drop(*known.columns)


def listed_rules(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = LISTED) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def labelled_pages(pages: DataFrame, labels: DataFrame, listed: DataFrame) -> DataFrame:
    """url, bad of the pages whose label is known.

    A page that a listed rule fits has the rule's verdict for a label.  Another
    shows the document that its path numbers, and is bad where that is labelled
    as poor or toxic.
    """
    urls = pages.select("url").where("url IS NOT NULL")
    ruled = listed_verdicts(urls.distinct(), listed).select("url", (F.col("verdict") == "block").alias("listed"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("labelled"))
    shown = urls.withColumn("doc_id", F.expr(r"try_cast(regexp_extract(coalesce(url, ''), '://[^/?#]*[^?#]*/([0-9]+)[^/?#]*/?([?#]|$)', 1) AS BIGINT)"))
    both = shown.join(said, "doc_id", "left").join(ruled, "url", "left")
    return both.select("url", F.coalesce("listed", "labelled").alias("bad"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed, folder = listed_rules(spark), work_dir(spark)
    rules = materialise(mined_rules(labelled_pages(pages, table(spark, sf_dir, "labels"), listed), folder), folder, "rules")
    return judge(pages, listed, rules).select("page_id", "host", "path", "rule", "verdict", "n_rules", "mined")


#: The same from the definition: every combination of up to three tokens is counted.
OP13_SQL = rf"""
WITH split_ AS (
  SELECT DISTINCT url, translate(regexp_extract(url, '{URL_PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(url, '{URL_PARTS}', 2) AS path,
         substr(regexp_extract(url, '{URL_PARTS}', 3), 2) AS query, substr(regexp_extract(url, '{URL_PARTS}', 4), 2) AS fragment
  FROM pages WHERE url IS NOT NULL),
raw_tokens AS (
  SELECT url, 'h:' || x AS token FROM (SELECT url, unnest(regexp_split_to_array(host, '[.:@]')) AS x FROM split_) WHERE x <> ''
  UNION ALL SELECT url, 'p:' || x FROM (SELECT url, unnest(string_split(path, '/')) AS x FROM split_) WHERE x <> ''
  UNION ALL SELECT url, 'q:' || x FROM (SELECT url, string_split(unnest(string_split(query, '&')), '=')[1] AS x FROM split_) WHERE x <> ''
  UNION ALL SELECT url, 'f:' || fragment FROM split_ WHERE fragment <> ''),
toks AS (SELECT DISTINCT url, regexp_replace(token, '[0-9]+', '#', 'g') AS token FROM raw_tokens),
listed(host, path, verdict) AS (VALUES {", ".join(str(r) for r in LISTED)}),
fits AS (
  SELECT s.url, l.host || l.path AS rule, l.verdict, row_number() OVER (PARTITION BY s.url ORDER BY length(l.host || l.path) DESC, l.host || l.path DESC) AS k
  FROM split_ s JOIN listed l ON (s.host = l.host OR ends_with(s.host, '.' || l.host)) AND starts_with(s.path, l.path)),
said AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS labelled FROM labels GROUP BY doc_id),
rows_ AS (
  SELECT p.url, row_number() OVER () AS id, try_cast(nullif(regexp_extract(p.url, '://[^/?#]*[^?#]*/([0-9]+)[^/?#]*/?([?#]|$)', 1), '') AS BIGINT) AS doc_id
  FROM pages p WHERE p.url IS NOT NULL),
labelled AS (
  SELECT r.id, r.url, coalesce(f.verdict = 'block', s.labelled) AS bad
  FROM rows_ r LEFT JOIN said s ON s.doc_id = r.doc_id LEFT JOIN fits f ON f.url = r.url AND f.k = 1
  WHERE r.url IN (SELECT url FROM toks)),
known AS (SELECT * FROM labelled WHERE bad IS NOT NULL),
need AS (SELECT greatest({LEAST}, ceil(round(count(*) * {SUPPORT}::DOUBLE, 9)))::BIGINT AS least FROM known),
counted AS (
  SELECT t.token, count(*) AS n, count(*) FILTER (WHERE k.bad) AS n_bad FROM known k JOIN toks t ON t.url = k.url
  GROUP BY t.token HAVING count(*) FILTER (WHERE k.bad) >= (SELECT least FROM need)),
items AS (
  SELECT id, bad, token FROM (
    SELECT k.id, k.bad, t.token, row_number() OVER (PARTITION BY k.id ORDER BY c.n_bad / c.n DESC, t.token) AS rank_
    FROM known k JOIN toks t ON t.url = k.url JOIN counted c ON c.token = t.token) WHERE rank_ <= {WIDTH}),
combined AS (
  SELECT id, bad, token AS a, NULL AS b, NULL AS c FROM items
  UNION ALL SELECT x.id, x.bad, x.token, y.token, NULL FROM items x JOIN items y ON y.id = x.id AND y.token > x.token
  UNION ALL SELECT x.id, x.bad, x.token, y.token, z.token FROM items x JOIN items y ON y.id = x.id AND y.token > x.token JOIN items z ON z.id = x.id AND z.token > y.token),
sure AS (
  SELECT a, b, c, n, n_bad FROM (SELECT a, b, c, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM combined GROUP BY a, b, c)
  WHERE n_bad >= (SELECT least FROM need) AND n_bad >= n * {CONFIDENCE}::DOUBLE),
rules AS (
  SELECT * FROM sure s WHERE NOT EXISTS (
    SELECT 1 FROM sure t WHERE (t.c IS NULL AND (s.b IS NOT NULL AND t.b IS NULL AND (t.a = s.a OR t.a = s.b OR t.a = coalesce(s.c, ''))
      OR s.c IS NOT NULL AND t.b IS NOT NULL AND t.a IN (s.a, s.b) AND t.b IN (s.b, s.c))))),
hits AS (
  SELECT x.url, r.*, r.a || coalesce(' ' || r.b, '') || coalesce(' ' || r.c, '') AS told
  FROM rules r JOIN toks x ON x.token = r.a LEFT JOIN toks y ON y.url = x.url AND y.token = r.b LEFT JOIN toks z ON z.url = x.url AND z.token = r.c
  WHERE (r.b IS NULL OR y.url IS NOT NULL) AND (r.c IS NULL OR z.url IS NOT NULL)),
best AS (
  SELECT url, told, count(*) OVER (PARTITION BY url) AS n_rules, row_number() OVER (PARTITION BY url ORDER BY n_bad / n DESC, n_bad DESC, told DESC) AS k FROM hits)
SELECT p.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, f.rule,
       coalesce(f.verdict, CASE WHEN b.n_rules > 0 THEN 'block' ELSE 'allow' END) AS verdict, coalesce(b.n_rules, 0)::BIGINT AS n_rules, b.told AS mined
FROM pages p LEFT JOIN split_ s ON s.url = p.url LEFT JOIN fits f ON f.url = p.url AND f.k = 1 LEFT JOIN best b ON b.url = p.url AND b.k = 1
"""
