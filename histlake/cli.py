"""Command line: python -m histlake.cli <repo> <question> ...

  <repo> <type> <regex> [-e] [-s] [oldest|newest|N]   objects that match
  <repo> find <sha> [N] [-s]                          oldest commits whose tree holds an object
  <repo> dag [<sha>]                                  the graph, or a commit in it
  <repo> landed <sha> [<head>] [-s]                   the merge that landed a commit
  <repo> contains <sha> [-a] [-s]                     the earliest tag (all tags) with a commit
  comp <base> <target>...                             ancestors in common, ahead, behind
  comp-has <sha> <repo>...                            who has a commit
  <repo> refs [<regex>] [N] [-e]                      references by what they point at
  churn <base> <fork> [N]                             paths changed most in a fork
  <repo> duper [N] [LINES] [--exclude=<regex>]...     repeated blocks of code

-e/--exact: whole words; -s/--summary: a line about each; -a/--all: all tags.
HISTLAKE_CACHE_DIR: where graphs are kept.
"""

from __future__ import annotations

import sys

from histlake.operators.scan import DEFAULT_LIMIT
from histlake.plans import history
from histlake.plans.catalog import RepoCatalog

LONG = {"--exact": "e", "--summary": "s", "--all": "a"}


def parse(argv: list[str]) -> tuple[list[str], set[str], list[str]]:
    """(words, flags, excludes); flags may stand anywhere and short ones together."""
    words, flags, excludes = [], set(), []
    for arg in argv:
        if arg in ("--help", "-h"):
            flags.add("h")
        elif arg in LONG:
            flags.add(LONG[arg])
        elif arg.startswith("--exclude="):
            excludes.append(arg.partition("=")[2])
        elif arg.startswith("--"):
            raise ValueError(f"unknown option '{arg}' (try --help)")
        elif len(arg) > 1 and arg[0] == "-" and set(arg[1:]) <= set("esa"):
            flags |= set(arg[1:])
        else:
            words.append(arg)
    return words, flags, excludes


def number(words: list[str], at: int, default: int) -> int:
    return int(words[at]) if len(words) > at and words[at].isdigit() else default


def lines(spark, words: list[str], flags: set[str], excludes: list[str]):
    """The lines of an answer."""
    exact, summary = "e" in flags, "s" in flags
    tail = lambda r: f"  {r['summary']}" if summary else ""
    if words[0] == "comp" and len(words) > 2:
        base, targets = RepoCatalog(spark, words[1], {"commit"}), []
        for w in words[2:]:
            try:
                targets.append(RepoCatalog(spark, w, {"commit"}))
            except OSError as e:  # the others are compared all the same
                print(f"target {w}: {e}", file=sys.stderr)
        for r in history.comp(base, targets).collect() if targets else ():
            lca = f"{r['lca']}  (gen {r['lca_generation']})" if r["lca"] else "none (no shared history)"
            yield f"vs {r['target']}  HEAD {r['head']}  ancestors {r['ancestors']}  common {r['common']}  ahead {r['ahead']}  behind {r['behind']}  LCA {lca}"
        return
    if words[0] == "comp-has" and len(words) > 2:
        yield f"sha: {words[1]}"
        opened, failed = {}, {}
        for w in words[2:]:
            try:
                opened[w] = RepoCatalog(spark, w, {"commit"})
            except OSError as e:  # the others are asked all the same
                failed[w] = e
        found = {r["repo"]: r for r in history.comp_has(words[1], list(opened.values())).collect()} if opened else {}
        for w in words[2:]:
            if w in failed:
                yield f"  {w}  ERROR ({failed[w]})"
            else:
                yield f"  {w}  " + ("no" if found[w]["state"] == "no" else f"yes  ({found[w]['state']}, gen {found[w]['generation']})")
        return
    if words[0] == "churn" and len(words) > 2:
        top, own = history.churn(RepoCatalog(spark, words[1], {"commit"}), RepoCatalog(spark, words[2], {"commit", "tree"}), number(words, 3, 20))
        yield f"paths by change count in fork-not-base ({own.count()} commits):"
        for r in top.collect():
            yield f"  {r['changes']:>5}  {r['path']}"
        return
    if len(words) < 2:
        raise ValueError(__doc__)
    what = words[1]
    if what == "dag":
        repo = RepoCatalog(spark, words[0], {"commit"})
        row = history.dag_commit(repo, words[2]).first() if len(words) > 2 else history.dag_stats(repo).first()
        if row is None:
            raise history.NotFound("sha not in DAG (not a commit?)")
        yield from (f"{k}: {v}" for k, v in row.asDict().items())
    elif what == "refs":
        for r in history.refs(RepoCatalog(spark, words[0], {"commit"}), words[2] if len(words) > 2 else "", exact, number(words, 3, 50)).collect():
            yield f"{r['sha']}  {r['names']}"
    elif what == "duper":
        groups, counts = history.duper(RepoCatalog(spark, words[0]), number(words, 2, 15), number(words, 3, 3), excludes)
        yield "  ".join(f"{k}: {v}" for k, v in counts.first().asDict().items())
        for i, r in enumerate(groups.collect(), 1):
            yield f"#{i}  {r['line_count']} lines, {r['occurrences']} occurrences, {r['wasted']} wasted"
            yield from (f"    | {x}" for x in r["snippet"])
            yield from (f"    @ {p['path']}:{p['start_line']}" for p in r["places"])
    elif len(words) < 3:
        raise ValueError(__doc__)
    elif what == "find":
        found = history.find(RepoCatalog(spark, words[0], {"commit", "tree"}), words[2], number(words, 3, 1), summary).collect()
        if not found:
            raise history.NotFound("not found")
        yield from (f"{r['sha']}  commit{tail(r)}" for r in found)
    elif what == "landed":
        r = history.landed(RepoCatalog(spark, words[0], {"commit"}), words[2], words[3] if len(words) > 3 else None, summary).first()
        if r is None:
            raise history.NotFound("no landing merge")
        yield f"{r['sha']}  {r['merge']}  (gen {r['generation']}){tail(r)}"
    elif what == "contains":
        found = history.contains(RepoCatalog(spark, words[0], {"commit", "tag"}), words[2], "a" in flags, summary).collect()
        if not found:
            raise history.NotFound(f"no tag contains {words[2]}")
        yield from (f"{r['name']}  {r['sha']}  (gen {r['generation']}){tail(r)}" for r in found)
    else:
        order = words[3] if len(words) > 3 else None
        order = order if order in ("oldest", "newest") else number(words, 3, DEFAULT_LIMIT)
        kinds = {"commit", "tag"} if what.startswith(("commit", "tag")) else {"commit", "tag", "tree"} if what.startswith("tree") else None
        found = history.scan(RepoCatalog(spark, words[0], kinds), what, words[2], exact, order, summary).collect()
        if not found:
            print("no matches", file=sys.stderr)
        for r in found:
            yield f"{r['sha']}  {r['kind']}" + (f"  {r['summary']}" if summary and r["summary"] else "")


def main(argv: list[str] | None = None) -> int:
    try:
        words, flags, excludes = parse(sys.argv[1:] if argv is None else argv)
        if "h" in flags or not words:
            print(__doc__, file=sys.stderr)
            return 0 if "h" in flags else 1
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("histlake").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        for line in lines(spark, words, flags, excludes):
            print(line)
        return 0
    except (ValueError, LookupError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
