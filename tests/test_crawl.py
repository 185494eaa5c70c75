"""Crawls against os.walk over a made tree with hidden, empty, linked, odd and unreadable entries."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from folioscope.sources import crawl


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for folder in ("a/b/c/d", ".hidden/_x", "empty", "a/deep/" + "/".join("xyz"), "ü b", "many"):
        (root / folder).mkdir(parents=True, exist_ok=True)
    for i in range(40):
        (root / "many" / f"dir{i}" / "leaf").mkdir(parents=True)
        (root / "many" / f"dir{i}" / f"f{i}.Tar.GZ").write_bytes(b"x" * i)
    for name in (".dot", "_SUCCESS", "a/plain.txt", "a/b/c/d/last.CSV", "ü b/ß.txt", ".hidden/_x/y"):
        (root / name).write_text("text")
    os.symlink(root / "a", root / "link_to_a")
    os.symlink(root / "gone", root / "broken")
    os.symlink(root / "a/plain.txt", root / "link_to_file")
    with open(os.path.join(os.fsencode(root), b"bad\xff.txt"), "wb") as file:
        file.write(b"1")
    os.mkdir(os.path.join(os.fsencode(root), b"bad\xfe"))
    with open(os.path.join(os.fsencode(root), b"bad\xfe", b"in"), "wb") as file:
        file.write(b"22")
    return str(root)


def shown(path):
    return os.fsencode(path).decode("utf-8", "replace")


def walked(root):
    folders, files = {}, {}
    for path, dirs, names in os.walk(root):
        folders[shown(path)] = (len(names), len(dirs))
        for name in names:
            whole = os.path.join(path, name)
            files[shown(whole)] = os.stat(whole).st_size if os.path.exists(whole) else None
    return folders, files


@pytest.mark.parametrize("first,later", [(1, 1), (3, 7), (64, 4096)])
def test_equals_walk(spark, made, first, later):
    found = crawl.crawl(spark, [made], first_budget=first, budget=later)
    folders, files = walked(made)
    got = crawl.crawled_directories(found).collect()
    assert {r.path: (r.num_files, r.num_subdirs) for r in got} == folders and len(got) == len(folders)
    assert all(r.walk_error is None and r.created_ts and r.modified_ts for r in got)
    depth = {r.path: r.depth for r in got}
    assert depth[made] == 0 and depth[f"{made}/a/b/c/d"] == 4
    listed = crawl.crawled_files(found).collect()
    assert {r.path: r.size_bytes for r in listed} == files and len(listed) == len(files)
    by_name = {r.file_name: r for r in listed}
    assert by_name["f3.Tar.GZ"].extension == "gz" and by_name["f3.Tar.GZ"].subfolder == "many/dir3"
    assert by_name["broken"].read_error.startswith("stat_error") and by_name["broken"].created_by is None
    if sys.platform == "linux":
        import pwd

        assert by_name[".dot"].modified_by == pwd.getpwuid(os.stat(f"{made}/.dot").st_uid).pw_name
    links = [r for r in found.filter("kind = 'link'").collect()]
    assert [r.name for r in links] == ["link_to_a"]
    summary = crawl.crawl_summary(found).collect()[0]
    assert (summary.directories, summary.files, summary.errors) == (len(folders), len(files) - 1, 1)


def test_filters_reach_the_walk(spark, made):
    crawl.register(spark)
    source = spark.read.format("file_tree").option("roots", f'["{made}", "/nowhere"]').load()
    plan = source.filter("depth <= 1 and kind = 'directory'")._jdf.queryExecution().toString()
    # Spark itself only looks for NULLs.
    assert "<= 1" not in plan.split("== Physical Plan ==")[1].split("BatchScan")[0]
    reader = crawl.TreeReader([made, "/other"], 10)
    left = list(reader.pushFilters([crawl.LessThan(("depth",), 3), crawl.EqualTo(("root_path",), made), crawl.EqualTo(("kind",), "file")]))
    assert left == [crawl.EqualTo(("kind",), "file")] and reader.max_depth == 2 and reader.roots == [made]
    upper = crawl.crawl(spark, [made], max_depth=1, directories_only=True).collect()
    folders, _ = walked(made)
    assert {r.path: (r.num_files, r.num_subdirs) for r in upper} == {p: c for p, c in folders.items() if p.count("/") <= made.count("/") + 1}


def test_errors_are_rows(spark, made, monkeypatch):
    rows = crawl.crawl(spark, ["/nowhere/at/all", f"{made}/_SUCCESS"]).collect()
    assert [(r.depth, r.num_files, bool(r.error)) for r in rows] == [(0, None, True)] * 2
    assert crawl.crawl(spark, []).count() == 0

    plain = os.scandir

    def closed(path):
        if os.fsencode(path).endswith(b"/many"):
            raise PermissionError(13, "Permission denied", path)
        return plain(path)

    monkeypatch.setattr(os, "scandir", closed)
    errors = []
    want = {shown(p): (len(f), len(d)) for p, d, f in os.walk(made, onerror=errors.append)}
    got = {r["path"]: r for r in crawl.walk([(made, os.fsencode(made), 0)], 1 << 30) if r["kind"] == "directory"}
    refused = got.pop(f"{made}/many")
    assert refused["error"] == "walk_error: Permission denied" and refused["num_files"] is None and len(errors) == 1
    assert {p: (r["num_files"], r["num_subdirs"]) for p, r in got.items()} == want


def test_several_roots(spark, made):
    roots = [f"{made}/a", f"file://{made}/many", f"{made}/a"]
    found = crawl.crawl(spark, roots, first_budget=2, budget=3)
    assert {r.root_path for r in found.select("root_path").distinct().collect()} == {f"{made}/a", f"{made}/many"}
    assert found.filter("kind = 'directory'").count() == sum(len(walked(r.removeprefix("file://"))[0]) for r in roots[:2])
    assert found.groupBy("root_path", "path").agg(F.count("*").alias("n")).filter("n > 1").count() == 0
