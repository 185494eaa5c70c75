"""Sources, extraction, ingest, sinks and streams over small real files."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators import query
from folioscope.plans.features import feature_frame
from folioscope.plans.ingest import ingest
from folioscope.sources import extract, sinks, tables, tree
from folioscope.streaming import scans

TWB = b'<w><d name="n" caption="c">t</d></w>'


def packed(name, body):
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as archive:
        archive.writestr(name, body)
    return target.getvalue()


FILES = {
    "a.txt": (b"h\xffi\r\nx", "hi\nx"),
    "b.csv": (b'a, ,b\r\n"x,y",,z\n\nlast', "a, , b\nx,y, z\n\nlast"),
    "c.twb": (TWB, "t\nn\nc"),
    "d.twb": (b"<a><b", ""),
    "e.twbx": (packed("in/x.twb", TWB), "t\nn\nc"),
    "f.twbx": (packed("x.hyper", b"1"), ""),
    "g.dll": (b"\x00ABCD\x00a\xffbcdef", "ABCD\nbcdef"),
    "h.pdf": (b"%PDF", ""),
    "i.HTM": (b"<b>x</b>", "<b>x</b>"),
    "j.twbx": (b"not a zip", ""),
    "noext": (b"text", ""),
    "long.md": (b"y" * 150_000, "y" * 150_000),
    "long.csv": (b"abc\n" * 60_000, ("abc\n" * 60_000)[:-1]),
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for place, (name, (body, _)) in enumerate(FILES.items()):
        sub = folder / ("deep/er" if place % 2 else ".")
        sub.mkdir(parents=True, exist_ok=True)
        (sub / name).write_bytes(body)
    return str(folder)


def listed(spark, root, content=True):
    return tree.listing_columns(tree.scan_tree(spark, root, with_content=content), root)


def test_scan_and_extract(spark, root):
    rows = extract.reader_text(listed(spark, root)).collect()
    assert {r.file_name: r.content_text for r in rows} == {n: t for n, (_, t) in FILES.items()}
    assert {r.subfolder for r in rows} == {"/", "deep/er"}
    assert {r.file_name: r.size_bytes for r in rows} == {n: len(b) for n, (b, _) in FILES.items()}


def test_scan_reads_no_content_unless_asked(spark, root):
    plan = listed(spark, root, content=False)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_large_files_stay_listed(spark, root):
    rows = tree.scan_tree(spark, root, with_content=True, max_content_bytes=1000).collect()
    assert len(rows) == len(FILES)
    assert {r.path.split("/")[-1] for r in rows if r.content is None} == {"long.md", "long.csv"}


def test_extractor_hook(spark, root):
    rows = extract.reader_text(listed(spark, root), extractors={"pdf": lambda b: b.decode()[:4], "txt": lambda b: 1 / 0})
    got = {r.file_name: r.content_text for r in rows.collect()}
    assert got["h.pdf"] == "%PDF" and got["a.txt"] == "" and got["b.csv"] == FILES["b.csv"][1]


def test_feature_text(spark, root):
    got = {r.file_name: r.content_text for r in extract.feature_text(listed(spark, root)).collect()}
    assert got["a.txt"] == "hi x" and got["i.HTM"] == "x" and got["noext"] == "text" and got["h.pdf"] == ""
    assert len(got["long.md"]) == 150_000
    cut = extract.feature_text(listed(spark, root), limit=5000)
    assert {r.file_name: len(r.content_text) for r in cut.collect()}["long.md"] == 5000
    hooked = extract.feature_text(listed(spark, root), extractors={"pdf": lambda b: " p \n q "})
    assert {r.file_name: r.content_text for r in hooked.collect()}["h.pdf"] == "p q"


def test_ingest_twice(spark, root):
    listing = tree.scan_tree(spark, root, with_content=True)
    rows = [
        (1, f"{root}/a.txt", "L1"), (2, f"{root}/./a.txt", ""), (3, None, "x"), (4, "  ", "x"),
        (5, f"{root}/deep/er/b.csv", "L2"), (6, f"{root}/gone.txt", "L3"),
    ]
    names = "n int, file_path string, business_category string"
    done = ingest(spark.createDataFrame(rows, names), listing, "n")
    files = {r.file_name: r for r in done.files.collect()}
    assert files["a.txt"].exists_flag and files["a.txt"].sha1 == hashlib.sha1(FILES["a.txt"][0]).hexdigest()
    assert files["gone.txt"].size_bytes is None and files["gone.txt"].read_error.startswith("stat_error")
    assert files["b.csv"].mime_type == "text/csv" and files["b.csv"].folder == f"{root}/deep/er"
    ids = {r.file_id: r.file_name for r in files.values()}
    assert {ids[r.file_id]: r.business_category for r in done.labels.collect()} == {"b.csv": "L2", "gone.txt": "L3"}
    assert {ids[r.file_id]: r.content_text for r in done.content.collect()} == {
        "a.txt": "hi\nx", "b.csv": FILES["b.csv"][1], "gone.txt": "",
    }
    assert done.stats.first().asDict() == {
        "inserted": 4, "errors": 0, "empty_text": 1, "skipped_missing": 2, "distinct_files": 3,
    }
    more = spark.createDataFrame([(1, f"{root}/gone.txt", ""), (2, f"{root}/noext", "L4")], names)
    again = ingest(more, listing, "n", tables=(done.files, done.labels, done.content))
    assert sorted(r.business_category for r in again.labels.collect()) == ["L2", "L4"]
    assert again.files.count() == 4 and again.content.count() == 4


def test_feature_frame_with_a_missing_file(spark, root):
    listing = tree.scan_tree(spark, root, with_content=True).withColumn("modified_epoch", F.lit(1704067200))
    rows = spark.createDataFrame(
        [("x/Old Name.TXT", " a.txt ", "K"), ("y", "gone.xlsx", None)],
        "`Original File Path` string, `File Path` string, `Business Capability` string",
    )
    got = {r.file_name: r for r in feature_frame(rows, listing, root).collect()}
    a, gone = got["a.txt"], got["gone.xlsx"]
    assert (a.file_exists, a.content_text, a.content_word_count, a.has_content) == (1, "hi x", 2, 1)
    assert a.modified_time_iso == "2024-01-01T00:00:00" and a.original_path_keywords.endswith("x old name txt")
    assert (gone.file_exists, gone.file_size_bytes, gone.modified_time_iso, gone.extension_family) == (0, 0, "", "excel")
    assert gone.business_capability == "" and gone.notes_text == "" and gone.has_content == 0


def test_column_resolution(spark):
    rows = spark.createDataFrame([("b", "c", 2), ("a", "d", 1)], "path string, BusinessCapability string, n int")
    assert [tuple(r) for r in tables.ingest_list(rows, 1, "n").collect()] == [("a", "d", 1)]
    assert tables.ingest_list(rows, 0).count() == 2
    with pytest.raises(KeyError, match="file_location"):
        tables.ingest_list(rows.drop("path"))
    with pytest.raises(ValueError, match="order"):
        tables.ingest_list(rows, 5)
    with pytest.raises(ValueError, match="File Path"):
        tables.lifecycle_catalog(rows)


def test_feature_table_encodings(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.DoubleType())])
    (tmp_path / "u.csv").write_text("a,n\né,1\nlong,2,3\nshort\n", encoding="utf-8")
    (tmp_path / "l.csv").write_bytes("a,n\né,1\n".encode("latin-1"))
    got = tables.feature_table(spark, str(tmp_path / "u.csv"), schema).collect()
    assert [tuple(r) for r in got] == [("é", 1.0), ("short", None)]
    assert tables.feature_table(spark, str(tmp_path / "l.csv"), schema).first().a == "é"
    with pytest.raises(ValueError, match="none of"):
        tables.feature_table(spark, str(tmp_path / "l.csv"), schema, ("utf-8",))
    (tmp_path / "q.csv").write_text('a,n\n"say ""hi"", ok",1\n"two\nlines",2\n', encoding="utf-8")
    got = tables.feature_table(spark, str(tmp_path / "q.csv"), schema).collect()
    assert [tuple(r) for r in got] == [('say "hi", ok', 1.0), ("two\nlines", 2.0)]


def test_catalog_sink_replaces_one_root(spark, tmp_path):
    path = str(tmp_path / "catalog")
    rows = spark.createDataFrame(
        [("/srv/A b", "/srv/A b/x", "Sub", "txt"), ("/srv/B", "/srv/B/y", "/", "csv")],
        "root_path string, path string, subfolder string, extension string",
    )
    sinks.write_catalog(rows, path)
    new = spark.createDataFrame([("/srv/A b", "/srv/A b/z", "q", "md")], rows.schema)
    sinks.overwrite_root(new, path, "/srv/A b")
    assert sorted(r.path for r in spark.read.parquet(path).collect()) == ["/srv/A b/z", "/srv/B/y"]
    wanted = query.CatalogFilter({"root_path": "/srv/B"}, ["csv", ""], "/")
    found = wanted.apply(spark.read.parquet(path))
    assert [r.path for r in found.collect()] == ["/srv/B/y"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "root_path" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(extension" in plan.split("PushedFilters: [")[1]
    strict = query.CatalogFilter(subfolder_contains="UB", null_as_blank=False)
    plan = strict.apply(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(subfolder_lc,ub)" in plan
    sinks.overwrite_root(new.limit(0), path, "/srv/A b")
    assert [r.path for r in spark.read.parquet(path).collect()] == ["/srv/B/y"]


@pytest.mark.parametrize("root", ["/srv/Müller", "/srv/a&b (ü)", "/srv/x(1)=%20", "plain"])
def test_root_names_survive_overwriting(spark, tmp_path, root):
    path, schema = str(tmp_path / "catalog"), "root_path string, path string, subfolder string, extension string"
    sinks.write_catalog(spark.createDataFrame([(root, "old", "s", "txt"), ("/srv/B", "y", "/", "csv")], schema), path)
    new = spark.createDataFrame([(root, "new", "q", "md")], schema)
    sinks.overwrite_root(new, path, root)
    assert {(r.root_path, r.path) for r in spark.read.parquet(path).collect()} == {(root, "new"), ("/srv/B", "y")}
    sinks.overwrite_root(new.limit(0), path, root)
    assert {(r.root_path, r.path) for r in spark.read.parquet(path).collect()} == {("/srv/B", "y")}


def test_paths_with_a_scheme(spark):
    listing = spark.createDataFrame([("hdfs://nn:8020/a/b.txt", 3), ("/c.md", 4)], "path string, size_bytes long")
    asked = spark.createDataFrame([("hdfs://nn:8020//a/./b.txt",), ("hdfs://nn:8020/gone",), ("//c.md",)], "path string")
    got = {r.path: (r.exists_flag, r.size_bytes, r.folder) for r in tree.path_status(asked, listing).collect()}
    assert got == {"hdfs://nn:8020/a/b.txt": (True, 3, "hdfs://nn:8020/a"), "hdfs://nn:8020/gone": (False, None, "hdfs://nn:8020"),
                   "/c.md": (True, 4, "/")}


def test_ingest_counts_errors(spark, root):
    listing = tree.scan_tree(spark, root, with_content=True)
    rows = spark.createDataFrame([(i, f"{root}/{p}", "L") for i, p in enumerate(["a.txt", "deep/er/j.twbx", "deep/er/d.twb", "gone"])],
                                 "n int, path string, business_category string")
    done = ingest(rows, listing, "n", materialise=False)
    assert done.stats.first().errors == 2


def test_report_and_feature_sinks(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("split"))
    sinks.write_features(rows, str(tmp_path / "f"), csv=True)
    sinks.write_split(rows, str(tmp_path / "s"))
    sinks.write_report(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "f/parquet")).count() == 10
    assert spark.read.option("header", True).csv(str(tmp_path / "f/csv")).count() == 10
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = '1'").count() == 5
    assert spark.read.json(str(tmp_path / "r")).count() == 10


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(60).select(
        F.lit("r").alias("run_id"), F.concat(F.lit("p"), F.col("id") % 7).alias("path"),
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("modified_at"), F.col("id").alias("seq"),
    )
    for part in range(3):
        rows.filter(F.floor(F.col("seq") / 20) == part).coalesce(1).write.mode("append").parquet(source)
    reports = []
    stream = scans.read_files(spark, source, rows.schema, files_per_batch=1)
    listener = scans.ProgressReporter(lambda batch, n: reports.append(n))
    spark.streams.addListener(listener)
    job = scans.start_change_log(stream, str(tmp_path / "log"), str(tmp_path / "state"))
    job.awaitTermination()
    spark.streams.removeListener(listener)
    assert job.exception() is None
    got = sinks.current_table(spark, str(tmp_path / "log"), ["run_id", "path"], "seq", keep=["modified_at"])
    assert spark.read.parquet(str(tmp_path / "log")).select("batch_id").distinct().count() == 3
    from folioscope.operators.upsert import latest

    assert sorted(got.select("path", "modified_at").collect()) == sorted(
        latest(rows, ["run_id", "path"], "seq", ["modified_at"]).select("path", "modified_at").collect()
    )
    totals = scans.scan_progress(
        stream.withColumn("failed", F.col("modified_at").isNull()), "run_id", "path", "seq", "seq", "failed"
    )
    scans.start_change_log(totals, str(tmp_path / "log2"), str(tmp_path / "state2"), "update").awaitTermination()
    last = scans.newest(spark, str(tmp_path / "log2"), ["run_id"]).first()
    assert (last.total_files, last.total_errors, last.last_path) == (40, 20, "p3")


def test_workers_need_not_have_the_package(tmp_path):
    """The driver finds the package by path only, as from another folder."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(repo)!r})\n"
        "from folioscope.functions.text import strip_accents_expanding\n"
        "from folioscope.session import get_session\n"
        "from folioscope.sources.extract import reader_text\n"
        "spark = get_session('away', 'local[1]', spark__ui__enabled='false')\n"
        "rows = spark.createDataFrame([(bytearray(b'a,b'), 'csv')], 'content binary, extension string')\n"
        "row = reader_text(rows).select(strip_accents_expanding('content_text').alias('t')).first()\n"
        "assert row.t == 'a, b', row\n"
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, timeout=120, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
