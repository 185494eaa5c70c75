"""Path and text expressions against hand-written values."""

import mimetypes
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import paths, text
from folioscope.functions.fixed_values import with_extension_family, with_mime_type


def one(spark, value, build, kind="string"):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(build("v").alias("r")).first()[0]


NAMES = ["Foo.Tar.GZ", ".bashrc", "noext", "b.", "..hid.txt", "a.tar.gz", "x.tgz", "pic.svgz", "Z.HTML", "n\nl.csv"]


def test_names_match_the_standard_library(spark):
    rows = with_mime_type(
        spark.createDataFrame([(n,) for n in NAMES], "n string").withColumn("k", paths.mime_key("n")), "k"
    ).select("n", "mime_type", paths.suffix("n").alias("s"), paths.stem("n").alias("t"), paths.extension_key("n").alias("e"))
    guess = mimetypes.MimeTypes(filenames=()).guess_type
    for row in rows.collect():
        pure = PurePosixPath(row.n)
        assert (row.s, row.t) == (pure.suffix, pure.stem)
        assert row.e == pure.suffix.lower().lstrip(".")
        assert row.mime_type == (guess(row.n)[0] or "")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab./_ -", min_size=1, max_size=14).map(lambda t: "/" + t), min_size=1, max_size=30))
def test_paths_match_pathlib(spark, raw):
    raw = [p for p in raw if not p.startswith("//")] or ["/a"]
    frame = spark.createDataFrame([(p,) for p in raw], "p string").withColumn("c", paths.canonical("p"))
    for row in frame.select("p", "c", paths.folder("c").alias("f"), paths.file_name("c").alias("n"), paths.depth("c").alias("d")).collect():
        pure = PurePosixPath(row.p)
        assert (row.c, row.f, row.n, row.d) == (str(pure), str(pure.parent), pure.name, len(pure.parts))


@pytest.mark.parametrize(
    ("path", "tokens"),
    [("/a.b/c", "a b c ext_b/c"), ("/A/B.TXT", "a b txt ext_txt"), ("nodot", "nodot"), ("end.", "end")],
)
def test_path_tokens(spark, path, tokens):
    assert one(spark, path, paths.path_tokens) == tokens


def test_subfolder_and_depth(spark):
    rows = spark.createDataFrame(
        [("/r", "/r/x"), ("/r", "/r/a/b/x"), ("/r", "/q/x"), ("/", "/x"), ("/", "/a/x")], "r string, p string"
    )
    got = [r[0] for r in rows.select(paths.subfolder("r", "p")).collect()]
    assert got == ["/", "a/b", "/q", "/", "a"]
    depth = rows.select(paths.relative_depth("r", paths.folder("p"))).collect()
    assert [r[0] for r in depth][:2] == [0, 2]


def test_family(spark):
    rows = with_extension_family(
        spark.createDataFrame([(".xlsx",), (".TSV",), (".gz",), ("",)], "s string"), "s"
    )
    assert {r.s: r.extension_family for r in rows.collect()} == {
        ".xlsx": "excel", ".TSV": "tabular", ".gz": "other", "": "other",
    }


@pytest.mark.parametrize("name", ["a1b22", "٣x", "²x9", "none", "Ⅷ"])
def test_digits(spark, name):
    assert one(spark, name, paths.digit_count) == sum(c.isdigit() for c in name)


@pytest.mark.parametrize(
    ("build", "value", "expected"),
    [
        (text.printable, "a\x00b\tc\xa0d e", "abcd e"),
        (text.strip_html, "<SCRIPT>x</SCRIPT><p>a</p> <style>\n.b{}</style>c", "a c"),
        (text.normalise, "  a\x1c\tb\x85 ", "a b"),
        (text.word_count, "", 0),
        (text.word_count, None, 0),
        (text.word_count, " a\xa0b\x1fc ", 3),
        (text.safe_path, None, ""),
        (text.safe_path, "　 x ", "x"),
        (text.strip_accents, "Ünïcode é ß", "Unicode e ß"),
        (text.strip_accents_expanding, "ﬁx ½", "fix 1⁄2"),
    ],
)
def test_text(spark, build, value, expected):
    assert one(spark, value, build) == expected


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=30).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), min_size=1, max_size=25))
def test_words_and_space_match_python(spark, values):
    import re

    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for row in frame.select("v", text.normalise("v").alias("n"), text.word_count("v").alias("w")).collect():
        assert row.n == re.sub(r"\s+", " ", row.v).strip()
        assert row.w == len(row.v.split())


def test_ngrams(spark):
    assert one(spark, "aa bb cc", lambda v: text.ngrams(text.words(v), 1, 3)) == [
        "aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc",
    ]
    assert one(spark, "aa", lambda v: text.ngrams(text.words(v), 1, 3)) == ["aa"]
    assert one(spark, "", lambda v: text.ngrams(text.words(v), 2, 2)) == []


def test_numbers_and_times(spark):
    rows = spark.createDataFrame([("12", 0.0), ("x", 1704067200.9), ("nan", float("nan")), (None, None)], "s string, e double")
    got = rows.select(text.to_number("s").alias("n"), text.iso_timestamp(text.epoch_timestamp("e")).alias("t")).collect()
    assert [r.n for r in got] == [12.0, 0.0, 0.0, 0.0]
    assert [r.t for r in got] == ["1970-01-01T00:00:00", "2024-01-01T00:00:00", "", ""]


def test_bytes_to_text(spark):
    raw = [b"h\xffi", "x�y".encode() + b"\xff\r\nq\rz", "é".encode(), b""]
    rows = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary")
    got = [r[0] for r in rows.select(text.unix_newlines(text.valid_utf8("b"))).collect()]
    assert got == ["hi", "x�y\nq\nz", "é", ""]


def test_join_text_and_fill(spark):
    rows = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert rows.select(text.join_text(rows, ["x", "absent", "y", "z"])).first()[0] == "a  3"
    assert text.fill_blank(rows, ["y", "absent"]).first().y == ""
    with pytest.raises(ValueError, match="none of"):
        text.join_text(rows, ["absent"])


def test_resolve(spark):
    rows = spark.createDataFrame([("a/../../b//./c/", "/base/d"), ("/../x", "/"), ("/a/./b/../c", "/z")], "p string, b string")
    assert [r[0] for r in rows.select(paths.resolve("p", "b")).collect()] == ["/base/b/c", "/x", "/a/c"]
    assert rows.select(paths.parent_directory(F.lit("/r"), F.lit("/r"))).first()[0] is None
