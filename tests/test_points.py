"""Point reads, deltas on ids outside their packs, and scans that stop: on written repositories, with counted reads."""

import random
import shutil
import warnings

import pytest
from pyspark.sql import functions as F

from histlake.operators import scan
from histlake.plans import catalog, history
from histlake.plans.catalog import RepoCatalog
from histlake.sources import deltas, packfmt, packwrite
from histlake.sources import objects as source
from histlake.sources.objects import GitObjects, GitObjectsReader, GitOpenDeltas


def bodies(n, kind="blob"):
    """Families of objects that begin alike, of which all but the first become deltas."""
    rng = random.Random(n)
    return [(kind, f"family {i // 8:04d} of objects, ".encode() + rng.randbytes(60).hex().encode() + f" the {i}".encode()) for i in range(n)]


def put(folder, packs, loose=()):
    """A repository of packs, each (data, index or None)."""
    for sub in ("objects/pack", "refs/heads"):
        (folder / sub).mkdir(parents=True, exist_ok=True)
    (folder / "HEAD").write_text("ref: refs/heads/main\n")
    for data, index in packs:
        top = folder / "objects/pack" / f"pack-{packfmt.pack_id(data)}"
        top.with_suffix(".pack").write_bytes(data)
        if index:
            top.with_suffix(".idx").write_bytes(index)
    for kind, content in loose:
        sha = packfmt.object_id(kind, content)
        (folder / "objects" / sha[:2]).mkdir(exist_ok=True)
        (folder / "objects" / sha[:2] / sha[2:]).write_bytes(packwrite.loose(kind, content))
    return str(folder)


def ids_of(objects):
    return {packfmt.object_id(k, c): (k, c) for k, c in objects}


def test_index_lookups_equal_the_parsed_index():
    data, index = packwrite.pack(bodies(600))
    found = packfmt.PackIndex(index)
    parsed = dict(packfmt.parse_index(index))
    assert all(found.get(sha) == at for sha, at in parsed.items()) and found.count == len(parsed)
    assert found.get("00" * 20) is None and found.get("ff" * 20) is None
    far = packwrite._index([(bytes([9]) * 20, 0, 1 << 33), (bytes([9]) * 19 + b"\x0a", 0, 99)], b"t" * 20)
    assert (packfmt.PackIndex(far).get("09" * 20), packfmt.PackIndex(far).get("09" * 19 + "0a")) == (1 << 33, 99)
    with pytest.raises(packfmt.FormatError):
        packfmt.PackIndex(b"old index, of another format")


def test_a_point_read_inflates_one_chain(tmp_path, monkeypatch):
    objects = bodies(800)
    path = put(tmp_path / "r", [packwrite.pack(objects)])
    streams, inflate = [], packfmt.inflate
    monkeypatch.setattr(packfmt, "inflate", lambda data, at: streams.append(at) or inflate(data, at))
    for i in (0, 5, 403):
        sha = packfmt.object_id(*objects[i])
        reader = GitObjectsReader({"path": path, "sha": sha})
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["sha"], r["content"]) for r in rows] == [(sha, objects[i][1])]
        assert len(streams) == i % 8 + 1
        streams.clear()
        offset = rows[0]["offset"]
        reader = GitObjectsReader({"path": path, "offset": f"{offset},13,99999999"})
        assert [r["sha"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [sha]
        assert len(streams) == i % 8 + 1
        streams.clear()
    assert GitObjectsReader({"path": path, "sha": "ab" * 20}).stored() == []


def test_ids_from_packs_with_and_without_index_and_loose_files(spark, tmp_path):
    one, two, three = bodies(80), bodies(120, "commit"), bodies(24, "tag")
    path = put(tmp_path / "r", [packwrite.pack(one), (packwrite.pack(two)[0], None)], three + one[:2])
    known = ids_of(one + two + three)
    wanted = sorted(known)[::3]
    asked = spark.createDataFrame([(x,) for x in [*wanted, wanted[0], "ab" * 20, "short", None]], "sha string")
    rows = source.read_ids(asked, path, "r").collect()
    assert sorted(r["sha"] for r in rows) == wanted
    assert all((r["kind"], bytes(r["content"])) == known[r["sha"]] and r["repo"] == "r" for r in rows)
    assert {r["kind"] for r in source.read_ids(asked, path, kinds=["tag"]).collect()} == {"tag"}
    assert source.read_ids(asked.limit(0), path).count() == 0
    single = packfmt.object_id(*one[11])
    row = source.read_ids(spark.createDataFrame([(single,)], "sha string"), put(tmp_path / "s", [packwrite.pack(one)])).first()
    assert (row["sha"], row["chain"]) == (single, 4)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(GitObjects)
        df = spark.read.format("git_objects").options(path=path, pushdown="true").load()
        assert [r["sha"] for r in df.where(F.col("sha") == single).collect()] == [single]
        assert df.where(F.col("sha").isin(wanted)).select("sha").distinct().count() == len(wanted)
        at = df.where(F.col("sha") == single).where("storage = 'pack'").first()["offset"]
        assert single in {r["sha"] for r in df.where(F.col("offset") == at).collect()}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.skipif(shutil.which("git") is None, reason="git is not here")
def test_summaries_read_the_commits_they_show(spark, tmp_path):
    from tests.test_repositories import Repo

    r = Repo(tmp_path / "work")
    first = r.commit("The first of all", a_DOT_txt="x")
    r.git("checkout", "-qb", "side")
    side = r.commit("On the side")
    r.git("checkout", "-q", "main")
    for i in range(40):
        r.commit(f"Work {i}")
    merge = r.merge("side")
    r.git("gc", "-q", "--aggressive")
    repo = RepoCatalog(spark, r.path)
    assert [(x["merge"], x["summary"]) for x in history.landed(repo, side, summary=True).collect()] == [(merge, "Ann: Merge side")]
    assert [x["summary"] for x in history.find(repo, r.git("rev-parse", f"{first}:a.txt"), 1, summary=True).collect()] == ["Ann: The first of all"]
    # of 43 commits the chain below one is inflated
    chain = source.read_ids(spark.createDataFrame([(merge,)], "sha string"), r.path).first()["chain"]
    assert chain <= 5
    assert history.commit_bodies(repo, spark.createDataFrame([(side,)], "sha string")).first()["body"].endswith("On the side\n")


def stored(spark, path):
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        repo = RepoCatalog(spark, path)
        rows = {r["sha"]: (r["kind"], bytes(r["content"])) for r in repo.objects.collect()}
        return rows, [str(w.message) for w in told if "no base" in str(w.message)], repo


def test_id_deltas_in_a_pack_without_index(spark, tmp_path):
    objects = bodies(64) + bodies(40, "commit")
    data, index = packwrite.pack(objects, by_id=True)
    rows, told, repo = stored(spark, put(tmp_path / "a", [(data, None)]))
    assert rows == ids_of(objects) and told == [] and repo.unresolved.count() == 0
    assert {r["sha"] for r in repo.of_kinds("commit").collect()} == set(ids_of(bodies(40, "commit")))
    some = sorted(ids_of(objects))[:9]
    assert sorted(r["sha"] for r in repo.by_ids(spark.createDataFrame([(x,) for x in some], "sha string")).collect()) == some
    # in small parts, and with an index
    reader = GitObjectsReader({"path": str(tmp_path / "a"), "partition_bytes": "300"})
    assert len(reader.stored()) > 10
    assert stored(spark, put(tmp_path / "b", [(data, index)]))[0] == ids_of(objects)


def test_bases_in_other_packs_loose_files_and_nowhere(spark, tmp_path):
    objects = bodies(48)
    (whole, whole_index), (thin, thin_index) = packwrite.thin_packs(objects)
    for name, packs, loose in (("both", [(whole, whole_index), (thin, thin_index)], ()), ("bare", [(whole, None), (thin, None)], ()), ("loose", [(thin, None)], objects[::8])):
        rows, told, _ = stored(spark, put(tmp_path / name, packs, loose))
        assert rows == ids_of(objects) and told == [], name
    rows, told, repo = stored(spark, put(tmp_path / "lost", [(thin, thin_index)], objects[:1]))
    assert rows == ids_of(objects[:8])  # one family has its base
    assert len(told) == 1 and "35 deltas have no base" in told[0]
    assert {r["base_sha"] for r in repo.unresolved.where("level = 0").collect()} <= set(ids_of(objects)) and repo.unresolved.count() == 35


def test_places_below_open_deltas(spark, tmp_path):
    """Deltas by distance upon deltas by id."""
    base, one, two = (f"some common beginning {x}".encode() for x in ("a", "bb", "ccc"))
    change, further = packwrite.delta(base, one), packwrite.delta(one, two)
    import hashlib
    import struct
    import zlib

    first = packwrite.header(packfmt.ID_DELTA, len(change)) + bytes.fromhex(packfmt.object_id("blob", base)) + zlib.compress(change)
    second = packwrite.header(packfmt.OFFSET_DELTA, len(further)) + packwrite.distance(len(first)) + zlib.compress(further)
    body = struct.pack(">4sII", b"PACK", 2, 2) + first + second
    path = put(tmp_path / "r", [(body + hashlib.sha1(body).digest(), None)], [("blob", base)])
    assert stored(spark, path)[0] == ids_of(("blob", x) for x in (base, one, two))
    spark.dataSource.register(GitOpenDeltas)
    listed = spark.read.format("git_open_deltas").option("path", path).load()
    assert [(r["offset"], r["base_offset"]) for r in listed.orderBy("offset").collect()] == [(12, None), (12 + len(first), 12)]
    found, rest = deltas.resolve(listed.limit(0), lambda ids: None if ids is None else source.read_ids(ids, path), str(tmp_path / "work"))
    assert found is None and rest.count() == 0


def test_scans_stop(spark, tmp_path):
    packs = [packwrite.pack([(k, c + b" %d" % i) for k, c in bodies(160)]) for i in range(6)]
    path = put(tmp_path / "r", packs, bodies(10))
    repo = RepoCatalog(spark, path)
    every = history.first_matches(repo, "blob", "the", 10**6, partition_bytes="2000")
    parts = repo.parts(kinds="blob", partition_bytes="2000")
    assert every[1] == len(parts) > 40
    order = sorted(packfmt.pack_id(d) for d, _ in packs)
    expected = []
    for data, index in sorted(packs, key=lambda x: packfmt.pack_id(x[0])):
        expected += [sha for sha, _ in sorted(packfmt.parse_index(index), key=lambda x: x[1])]
    expected += sorted(ids_of(bodies(10)))
    assert [r["sha"] for r in every[0].collect()] == expected
    for n, most in ((1, 5), (10, 5), (100, 21)):
        found, read = history.first_matches(repo, "blob", "the", n, summary=True, partition_bytes="2000")
        assert [r["sha"] for r in found.collect()] == expected[:n] and read <= most, (n, read)
    assert [r["sha"] for r in history.scan(repo, "blob", "the", order=12).collect()] == expected[:12]
    assert history.scan(repo, "blob", "nowhere to be found").count() == 0 and history.scan(repo, "blob", "the", order=0).count() == 0
    assert order[0] == parts[0][0] and parts[-1] is None


def test_packs_are_closed_when_full_and_objects_are_not_weighed(spark, tmp_path):
    from histlake.plans import star

    objects = bodies(300)
    df = spark.createDataFrame(objects, "kind string, content binary").coalesce(1)
    packwrite.write_packs(df, str(tmp_path / "r"), pack_bytes=4000)
    assert len(source.pack_files(str(tmp_path / "r"))) > 3
    assert stored(spark, str(tmp_path / "r"))[0] == ids_of(objects)
    star._dealt(df.select(F.lit("x").alias("sha"), F.raise_error(F.lit("made")).cast("long").alias("size")))


def test_ids_meet_indexes_in_a_join(spark, tmp_path):
    """Each id was looked up in one pack after another."""
    objects = bodies(90)
    path = put(tmp_path / "r", [packwrite.pack(objects[i : i + 30]) for i in (0, 30, 60)] + [packwrite.pack(objects[20:40])])
    found = source.read_ids(spark.createDataFrame([(x,) for x in ids_of(objects)], "sha string"), path)
    assert {r["sha"]: (r["kind"], bytes(r["content"])) for r in found.collect()} == ids_of(objects)
    assert found.count() == len(objects) and "Join" in found._jdf.queryExecution().executedPlan().toString()


def test_packs_that_fit_a_part_are_planned_without_their_objects(spark, tmp_path, monkeypatch):
    thin = [p for i in range(90) for p in packwrite.thin_packs([(k, c + b" of %d" % i) for k, c in bodies(16)])]
    path = put(tmp_path / "r", thin + [(packwrite.pack(bodies(40, "tag"))[0], None)])
    monkeypatch.setattr(packfmt, "read_index", lambda data: pytest.fail("planning reads an index"))
    reader = GitObjectsReader({"path": path})
    parts = reader.stored()
    monkeypatch.undo()
    # as many parts as are wanted at least, not one for each of 181 packs; none carries offsets or ids
    assert source.LEAST_PARTS <= len(parts) <= 2 * source.LEAST_PARTS and all(x.offsets is None and not x.ids for x in parts)
    packs = [x for part in parts for x in (part.pack, *part.more)]
    assert packs == sorted(source.pack_files(path), key=lambda x: packfmt.pack_id(source.mapped(x)))
    rows = [r for part in parts for b in reader.read(part) for r in b.to_pylist()]
    want = ids_of([(k, c + b" of %d" % i) for i in range(90) for k, c in bodies(16)] + bodies(40, "tag"))
    late = {r["sha"]: (r["kind"], bytes(r["content"])) for r in RepoCatalog(spark, path).objects.collect()}
    assert late == want and {r["sha"]: (r["kind"], r["content"]) for r in rows}.items() <= want.items() and 0 < len(rows) < len(want)


def test_bodies_are_not_shuffled_where_nobody_asks_for_them(spark, tmp_path):
    objects = [("commit", c) for _, c in bodies(40)]
    path = put(tmp_path / "r", [packwrite.pack(objects), packwrite.pack(objects[:9] + [("tag", b"t")])], objects[5:7])
    spark.dataSource.register(GitObjects)
    read = spark.read.format("git_objects").options(path=path).load()
    for df, n in ((scan.deduped(read).select("sha", "kind", "size"), 41), (catalog.commits_of(read), 40)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        below = plan[: plan.index("RepartitionByExpression")] + plan[plan.index("RepartitionByExpression") :].split("Project", 1)[0]
        assert "content" not in below and df.count() == n
    one = scan.deduped(read)
    assert {r["sha"]: (r["kind"], bytes(r["content"])) for r in one.collect()} == ids_of(objects + [("tag", b"t")])
    assert one.columns == read.columns and one.where("storage = 'loose'").count() == 0


def test_a_table_of_ids_is_read_by_many_tasks(spark, tmp_path):
    objects = [[(k, c + b" of %d" % i) for k, c in bodies(8)] for i in range(30)]
    path = put(tmp_path / "r", [packwrite.pack(x) for x in objects])
    known = ids_of(sum(objects, []))
    found = source.read_ids(spark.createDataFrame([(x,) for x in known], "sha string"), path)
    assert {r["sha"]: (r["kind"], bytes(r["content"])) for r in found.collect()} == known
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 8
