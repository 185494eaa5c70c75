"""Searches in the trigram index against a scan, for every kind of pattern."""

import random

import pytest

from folioscope.operators.query import contains_nocase, fold_case
from folioscope.sources import substring_index
from folioscope.sources.substring_index import SubstringIndex, packed, required_trigrams, unpacked

PATTERNS = [
    "Reports", "rep%20", "q_ r", "a_b", "%", "", "ab", "abc", "zzz", "/2023/", "ÄÖ", "日本語", "50\\%", "x%y%z", "__rep", "REPORTS/Q1", "q1 reports/2021",
]


def test_lists_and_trigrams():
    rng = random.Random(1)
    for most in (1, 200, 70_000, 1 << 33):
        blocks = sorted({rng.randrange(most) for _ in range(300)})
        assert unpacked(packed(blocks)).tolist() == blocks
    assert unpacked(b"").tolist() == []
    assert required_trigrams("ABCd%xy_Zz9") == {"abc", "bcd", "zz9"} and required_trigrams("a%b") == set()
    assert required_trigrams("a%b_c", literal=True) == {"a%b", "%b_", "b_c"} and required_trigrams("İXyz") == {"İxy", "xyz"}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(2)
    folders = ["Q1 Reports", "q2 reports", "A_b", "axb", "50\\%", "x/y/z", "日本語", "Äö", "/", "", "2023", None]
    rows = [(i, None if (f := rng.choice(folders)) is None else f"{f}/{rng.choice(['2021', '2023', 'rep20', 'ab'])}") for i in range(3_000)]
    rows += [(10_000 + i, "only here") for i in range(3)]
    table = spark.createDataFrame(rows, "file_id long, subfolder string")
    folder = str(tmp_path_factory.mktemp("index") / "i")
    index = SubstringIndex.create(table.filter("file_id % 3 <> 0"), folder, "subfolder", 100)
    assert index.add(table.filter("file_id % 3 = 0")) >= 10 and index.add(table.limit(0)) == 0
    return table, index


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("pattern", PATTERNS)
def test_equals_a_scan(made, pattern, literal):
    table, index = made
    want = table.filter(contains_nocase(fold_case("subfolder"), pattern, literal))
    assert sorted(index.search(pattern, literal).collect(), key=str) == sorted(want.collect(), key=str)


def test_blocks_are_pruned(made):
    _, index = made
    whole = len(index.candidates(""))
    assert whole >= 28 and len(index.candidates("only here")) <= 4 and index.candidates("zzz") == []
    found = index.search("x/y/z/2021")
    assert 0 < len({f.split("/block=")[1].split("/")[0] for f in found.inputFiles()}) <= whole // 3
    assert "InMemoryFileIndex" in found._jdf.queryExecution().toString()


def test_segments_and_empty_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_index, "SEGMENT_BLOCKS", 3)
    rows = spark.range(200).selectExpr("id as file_id", "concat('folder', id % 50, '/Common') as subfolder")
    index = SubstringIndex.create(rows, str(tmp_path / "a"), "subfolder", 10)
    assert index.search("common").count() == 200 and index.search("FOLDER7/").count() == 4
    none = SubstringIndex.create(rows.limit(0), str(tmp_path / "b"), "subfolder")
    assert none.search("common").count() == 0 and none.search("%").count() == 0
    assert none.add(rows) == 1 and none.search("r49/c").count() == 4
