"""Whole queries on small real repositories, held against git itself."""

import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from histlake import cli
from histlake.plans import history
from histlake.plans.catalog import RepoCatalog
from histlake.sources import objects as source
from histlake.sources.objects import GitObjects

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git is not here")


class Repo:
    def __init__(self, path):
        self.path, self.clock = str(path), 1_600_000_000
        self.git("init", "-q", "-b", "main", self.path, cwd=None)

    def git(self, *args, cwd=""):
        env = os.environ | {"GIT_AUTHOR_DATE": f"{self.clock} +0000", "GIT_COMMITTER_DATE": f"{self.clock} +0000", "GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Bob", "GIT_COMMITTER_EMAIL": "b@x", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
        return subprocess.run(["git", *args], cwd=self.path if cwd == "" else cwd, env=env, check=True, capture_output=True, text=True).stdout.strip()

    def commit(self, message, **files):
        self.clock += 60
        for name, text in files.items():
            name = name.replace("__", "/").replace("_DOT_", ".")
            full = os.path.join(self.path, name)
            if text is None:
                self.git("rm", "-rq", name)
                continue
            if os.path.isdir(full):
                shutil.rmtree(full)
            os.makedirs(os.path.dirname(full) or self.path, exist_ok=True)
            with open(full, "wb") as f:
                f.write(text if isinstance(text, bytes) else text.encode())
        self.git("add", "-A")
        self.git("commit", "-qm", message, "--allow-empty")
        return self.git("rev-parse", "HEAD")

    def merge(self, *branches):
        self.clock += 60
        self.git("merge", "-q", "--no-ff", "-m", f"Merge {' '.join(branches)}", *branches)
        return self.git("rev-parse", "HEAD")

    def ids(self, *args):
        return set(self.git(*args).split())


BLOCK = "def compute(values):\n    total = sum(values)\n    return total / len(values)\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = Repo(tmp_path_factory.mktemp("repos") / "one")
    r.first = r.commit("Initial cat", a_DOT_txt="one\n" * 200, src__x_DOT_py=BLOCK + "print(1)\n")
    r.git("tag", "v0")
    r.git("checkout", "-qb", "feature")
    r.feature = r.commit("Add cat-file", src__y_DOT_py="import os\n" + BLOCK, b_DOT_txt="b")
    r.git("checkout", "-qb", "third", "main")
    r.third = r.commit("Third", c_DOT_txt="c")
    r.git("checkout", "-q", "main")
    r.commit("Work on main", a_DOT_txt="one\n" * 201 + "two\n")
    r.landing = r.merge("feature")
    r.git("tag", "-a", "-m", "release one", "rel/v1")
    r.octopus_side = r.git("rev-parse", "third")
    r.git("checkout", "-qb", "fourth", "main~1")
    r.commit("Fourth", d_DOT_txt="d")
    r.git("checkout", "-q", "main")
    r.octopus = r.merge("third", "fourth")
    r.commit("Rename and swap", b_DOT_txt=None, b__inner_DOT_txt="b", latin_DOT_txt=b"caf\xe9 cat\n", zero_DOT_bin=b"a\0b", LICENSE_DOT_md="x")
    r.git("tag", "v2")
    r.git("gc", "-q", "--aggressive")
    r.tail = r.commit("Loose tail", a_DOT_txt="one\n" * 200 + "three\n", src__z_DOT_py=BLOCK)
    r.git("tag", "-a", "-m", "late", "late")
    return r


@pytest.fixture(scope="module")
def catalog(spark, repo):
    return RepoCatalog(spark, repo.path)


def all_objects(repo):
    out = {}
    for line in repo.git("cat-file", "--batch-all-objects", "--batch-check").splitlines():
        sha, kind, size = line.split()
        out[sha] = (kind, int(size))
    return out


def test_objects_equal_git(spark, repo, catalog):
    rows = {r["sha"]: (r["kind"], r["size"]) for r in catalog.objects.select("sha", "kind", "size").collect()}
    assert rows == all_objects(repo)
    from histlake.functions.objects import object_id

    assert catalog.objects.where(object_id(F.col("kind"), F.col("content")) != F.col("sha")).count() == 0
    assert {r["storage"] for r in catalog.objects.select("storage").collect()} == {"pack", "loose"}


def test_source_options(spark, repo):
    spark.dataSource.register(GitObjects)
    load = lambda **o: spark.read.format("git_objects").options(path=repo.path, **o).load()
    want = all_objects(repo)
    small = load(partition_bytes="200")
    assert small.rdd.getNumPartitions() > 3 and {r["sha"] for r in small.select("sha").collect()} == set(want)
    assert {r["kind"] for r in load(kinds="commit,tag").select("kind").collect()} == {"commit", "tag"}
    assert load(content="false").where("content IS NOT NULL").count() == 0
    heads = load(content="false", loose="false").collect()
    assert heads and all(want[r["sha"]][0] == r["kind"] for r in heads)
    assert load(loose="false").where("storage = 'loose'").count() == 0
    assert {r["kind"] for r in load().where("kind = 'tree'").select("kind").collect()} == {"tree"}
    assert {r["sha"] for r in source.from_binary_files(spark, repo.path + "/.git").select("sha").collect()} == set(want)
    index = {r["sha"] for r in source.pack_index(spark, repo.path).collect()}
    assert index and index <= set(want)


def test_pack_without_index(spark, repo, tmp_path):
    pack = source.pack_files(repo.path)[0]
    alone = shutil.copy(pack, tmp_path)
    rows = spark.read.format("git_objects").option("path", alone).load().select("sha", "kind").collect()
    assert {r["sha"] for r in rows} == {r["sha"] for r in source.pack_index(spark, repo.path).collect()}


def test_filter_pushdown(spark, repo):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("git_objects").options(path=repo.path, pushdown="true").load().where("kind IN ('commit', 'tag')")
        assert {r["kind"] for r in df.select("kind").collect()} == {"commit", "tag"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_graph_equals_git(repo, catalog):
    head = repo.git("rev-parse", "HEAD")
    reachable = repo.ids("rev-list", "--all")
    rows = {r["sha"]: r for r in catalog.dag.collect()}
    assert set(rows) == reachable and catalog.head == head
    parents = {line.split()[0]: line.split()[1:] for line in repo.git("rev-list", "--all", "--parents").splitlines()}
    for sha, r in rows.items():
        assert r["parents"] == parents[sha] and r["n_parents"] == len(parents[sha])
        assert r["generation"] == 1 + max((rows[p]["generation"] for p in parents[sha]), default=0)
    one = history.dag_commit(catalog, repo.feature).first()
    assert one["ancestors"] == len(repo.ids("rev-list", repo.feature))
    assert one["descendants"] == sum(repo.feature in repo.ids("rev-list", s) for s in reachable)
    stats = history.dag_stats(catalog).first()
    assert (stats["commits"], stats["roots"], stats["merges"], stats["packs"]) == (len(rows), 1, 2, 1)


def test_scan(repo, catalog):
    got = [r["sha"] for r in history.scan(catalog, "commit", "cat", order="oldest").collect()]
    assert got == [repo.first, repo.feature]
    assert {r["sha"] for r in history.scan(catalog, "commits", "cat", exact=True).collect()} <= set(got)
    assert history.scan(catalog, "commit", "(?m)^Merge").count() == 2
    assert [r["summary"] for r in history.scan(catalog, "commit", "cat-file", summary=True).collect()] == ["Ann: Add cat-file"]
    assert history.scan(catalog, "blob", "caf", summary=True).first()["summary"] == "caf� cat"
    assert "inner.txt" in {r["summary"] for r in history.scan(catalog, "tree", "inner", summary=True).collect()}
    assert history.scan(catalog, "all", ".", order=3).count() == 3
    assert history.scan(catalog, "tag", "release").count() == 1
    assert history.scan(catalog, "commit", "x" * 30).count() == 0


def test_find(repo, catalog):
    blob = repo.git("rev-parse", "main:src/x.py")
    assert [r["sha"] for r in history.find(catalog, blob).collect()] == [repo.first]
    assert history.find(catalog, blob, 100).count() == len(repo.ids("rev-list", "--all"))
    inner = repo.git("rev-parse", "main:b")
    assert {r["summary"] for r in history.find(catalog, inner, 9, summary=True).collect()} == {"Ann: Rename and swap", "Ann: Loose tail"}
    assert history.find(catalog, "0" * 39 + "1").count() == 0
    with pytest.raises(ValueError):
        history.find(catalog, "zz")


def test_landed(repo, catalog):
    assert history.landed(catalog, repo.feature).first()["merge"] == repo.landing
    assert history.landed(catalog, repo.third, summary=True).first()["summary"] == "Ann: Merge third fourth"
    assert history.landed(catalog, repo.tail).first() is None
    assert history.landed(catalog, repo.feature, repo.feature).first() is None


def test_contains(repo, catalog):
    for sha in (repo.first, repo.feature, repo.third, repo.tail):
        names = [r["name"] for r in history.contains(catalog, sha, all_tags=True).collect()]
        assert set(names) == repo.ids("tag", "--contains", sha)
        assert history.contains(catalog, sha).first()["name"] == names[0]
    assert history.contains(catalog, repo.feature).first()["name"] == "rel/v1"
    assert history.unresolved_tags(catalog).count() == 0


def test_refs(repo, catalog):
    rows = {r["sha"]: r["names"] for r in history.refs(catalog).collect()}
    want = {}
    for line in repo.git("for-each-ref", "--format=%(objectname) %(refname)").splitlines():
        sha, name = line.split()
        want.setdefault(sha, []).append(name)
    assert rows == {s: ", ".join(sorted(n)) for s, n in want.items()}
    assert history.refs(catalog, "v[0-9]+", exact=True, n=2).count() == 2


@pytest.fixture(scope="module")
def fork(repo, tmp_path_factory):
    path = tmp_path_factory.mktemp("forks") / "two"
    repo.git("clone", "-q", repo.path, str(path), cwd=None)
    f = Repo.__new__(Repo)
    f.path, f.clock = str(path), repo.clock + 10_000
    f.own = [f.commit("Fork one", a_DOT_txt="fork\n", new__deep__x_DOT_txt="1"), f.commit("Fork two", a_DOT_txt="fork2\n", src__x_DOT_py=None), f.commit("Fork swap", new="now a file"), f.commit("Empty")]
    f.git("checkout", "-qb", "side", f.own[0])
    f.own.append(f.commit("Side", side_DOT_txt="s"))
    f.git("checkout", "-q", "main")
    f.own.append(f.merge("side"))
    return f


def test_comparisons(spark, repo, catalog, fork):
    other = RepoCatalog(spark, fork.path)
    row = history.comp(catalog, [other, catalog]).collect()
    ours, theirs = repo.ids("rev-list", "HEAD"), fork.ids("rev-list", "HEAD")
    assert (row[0]["common"], row[0]["ahead"], row[0]["behind"], row[0]["ancestors"]) == (len(ours & theirs), len(theirs - ours), len(ours - theirs), len(theirs))
    assert row[0]["lca"] in fork.ids("merge-base", "--all", repo.git("rev-parse", "HEAD"), "HEAD")
    assert (row[1]["ahead"], row[1]["behind"]) == (0, 0)
    states = {r["repo"]: r["state"] for r in history.comp_has(fork.own[0], [catalog, other]).collect()}
    assert states == {repo.path: "no", fork.path: "in HEAD"}


def test_many_repositories_in_one_plan(spark, repo, catalog, fork, tmp_path, monkeypatch):
    """A shallow clone ends where it was cut, whatever the others hold; blocks of two targets."""
    from histlake.operators import graph

    shallow, alone = tmp_path / "shallow", tmp_path / "alone"
    repo.git("clone", "-q", "--depth", "3", f"file://{fork.path}", str(shallow), cwd=None)
    lone = Repo(alone)
    lone.commit("Alone", z_DOT_txt="z")
    monkeypatch.setattr(graph, "HEADS", 3)
    targets = [RepoCatalog(spark, str(p)) for p in (fork.path, shallow, alone, repo.path, fork.path)]
    rows = history.comp(catalog, targets).collect()
    assert [r["target"] for r in rows] == [t.location for t in targets]
    ours = repo.ids("rev-list", "HEAD")
    for r in rows:
        theirs = set(repo.git("-C", r["target"], "rev-list", "HEAD", cwd=None).split())
        assert (r["ancestors"], r["common"], r["ahead"], r["behind"]) == (len(theirs), len(ours & theirs), len(theirs - ours), len(ours - theirs))
        assert (r["lca"] is None) == (not ours & theirs)
    assert rows[0]["lca"] == rows[4]["lca"] and rows[3]["lca"] == repo.git("rev-parse", "HEAD")
    states = [(r["repo"], r["state"]) for r in history.comp_has(fork.own[0], [targets[2], targets[0], catalog, targets[0]]).collect()]
    assert states == [(str(alone), "no"), (fork.path, "in HEAD"), (repo.path, "no"), (fork.path, "in HEAD")]


def test_questions_without_kernels(spark, repo, catalog, monkeypatch):
    from histlake.operators import graph

    assert not catalog.large
    monkeypatch.setattr(graph, "KERNEL_COMMITS", 1)
    again = RepoCatalog(spark, repo.path)
    rows = lambda df: sorted(map(str, df.collect()))
    assert again.large
    assert rows(again.dag.select("sha", "generation", "n_parents", "n_children")) == rows(catalog.dag.select("sha", "generation", "n_parents", "n_children"))
    for sha in (repo.feature, repo.third, repo.first):
        assert rows(history.landed(again, sha)) == rows(history.landed(catalog, sha))
        assert rows(history.contains(again, sha)) == rows(history.contains(catalog, sha))


def test_churn(spark, catalog, fork):
    other = RepoCatalog(spark, fork.path)
    top, own = history.churn(catalog, other, 100)
    assert {r["sha"] for r in own.collect()} == set(fork.own)
    want = {}
    for sha in fork.own:
        changed = {}
        for line in fork.git("diff-tree", "-r", "--no-renames", "--name-status", f"{sha}^1", sha).splitlines():
            state, name = line.split("\t")
            changed[name] = state
        if changed.get("new") == "A":  # a directory became a file: one path
            changed.pop("new/deep/x.txt")
        for name in changed:
            want[name] = want.get(name, 0) + 1
    assert {r["path"]: r["changes"] for r in top.collect()} == want
    same, none = history.churn(catalog, catalog)
    assert same.count() == 0 and none.count() == 0


def test_duper(repo, catalog):
    groups, counts = history.duper(catalog)
    rows = groups.collect()
    block = next(r for r in rows if r["window"].startswith("def compute"))
    assert block["occurrences"] == 3 and block["wasted"] == 6 and block["snippet"] == BLOCK.rstrip("\n").split("\n")
    assert {p["path"] for p in block["places"]} == {"src/x.py", "src/y.py", "src/z.py"}
    c = counts.first()
    assert c["files_skipped"] == 0 and c["windows"] >= c["unique_windows"]
    none, _ = history.duper(catalog, excludes=["^src"])
    assert not any(r["window"].startswith("def compute") for r in none.collect())


def test_cache(spark, repo, tmp_path):
    cached = RepoCatalog(spark, repo.path, cache=str(tmp_path))
    rows = sorted(r["sha"] for r in cached.dag.collect())
    again = RepoCatalog(spark, repo.path, cache=str(tmp_path))
    assert os.path.exists(f"{tmp_path}/{again.key()}/dag/_SUCCESS")
    assert sorted(r["sha"] for r in again.dag.collect()) == rows
    again.views()
    assert spark.sql("SELECT count(*) FROM dag WHERE generation = 1").first()[0] == 1


def test_command_line(spark, repo, fork, capsys):
    run = lambda *a: (cli.main(list(a)), capsys.readouterr())

    def lines(*a):
        words, flags, excludes = cli.parse(list(a))
        return list(cli.lines(spark, words, flags, excludes))

    assert lines(repo.path, "commit", "-s", "cat-file") == [f"{repo.feature}  commit  Ann: Add cat-file"]
    assert lines(repo.path, "commit", "cat", "oldest", "-e", "1")[0].startswith(repo.first)
    assert lines(repo.path, "contains", repo.feature)[0].startswith("rel/v1  ")
    assert lines(repo.path, "landed", repo.feature)[0].startswith(f"{repo.feature}  {repo.landing}")
    assert lines("comp-has", repo.first, repo.path, "/nowhere")[1:] == [f"  {repo.path}  yes  (in HEAD, gen 1)", "  /nowhere  ERROR (no repository at /nowhere)"]
    assert "commits:" in " ".join(lines(repo.path, "dag")) and lines("churn", repo.path, fork.path, "1")[0].endswith("(6 commits):")
    assert lines(repo.path, "refs", "main", "1") and lines(repo.path, "duper", "1")[1].startswith("#1")
    assert lines(repo.path, "find", repo.git("rev-parse", "main:src/x.py"))[0].startswith(repo.first)
    assert len(lines("comp", repo.path, "/nowhere", fork.path)) == 1
    assert cli.parse(["-es", "x", "--all", "--exclude=a"]) == (["x"], {"e", "s", "a"}, ["a"])
    assert run("--nope")[0] == 1 and run("--help")[0] == 0 and run()[0] == 1


def test_smart_http(spark, repo, tmp_path, monkeypatch):
    """A fetch against canned answers: the pack that git itself makes, in side-band packets."""
    import io

    from histlake.sources import packfmt, smart_http

    data = subprocess.run(["git", "pack-objects", "--stdout", "--revs", "-q"], input=b"HEAD\n", cwd=repo.path, capture_output=True, check=True).stdout
    head = repo.git("rev-parse", "HEAD")
    tag = repo.git("rev-parse", "v0")
    advertised = packfmt.packet("# service=git-upload-pack\n") + packfmt.FLUSH + packfmt.packet(f"{head} HEAD\0side-band-64k ofs-delta\n") + packfmt.packet(f"{tag} refs/tags/v0\n") + packfmt.FLUSH
    answer = packfmt.packet("NAK\n") + b"".join(packfmt.packet(b"\1" + data[i : i + 1000]) for i in range(0, len(data), 1000)) + packfmt.FLUSH
    monkeypatch.setattr(smart_http.urllib.request, "urlopen", lambda request, timeout: io.BytesIO(advertised if isinstance(request, str) else answer))
    remote = RepoCatalog(spark, "https://example.com/one.git")
    assert remote.head == head
    assert {r["sha"] for r in remote.dag.select("sha").collect()} == repo.ids("rev-list", "HEAD")
    assert history.contains(remote, repo.first).first()["name"] == "v0"
