"""Pages of the stored order against a sort of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.sources.ranked_table import RankedTable


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, rng.choice(["/a", "/b", None]), rng.choice([None, "csv", "txt"]), rng.choice([None, *range(30)])) for i in range(3_000)]
    table = spark.createDataFrame(rows, "id long, root string, extension string, size long")
    order = [F.col("size").desc_nulls_last(), F.asc("id")]
    ranked = RankedTable.create(table, str(tmp_path_factory.mktemp("ranked") / "t"), order, ["root", "extension"], 100)
    return sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[0])), ranked


@pytest.mark.parametrize("wanted", [{}, {"root": "/a"}, {"root": None, "extension": "csv"}, {"extension": None}, {"root": "/none"}])
def test_pages(made, wanted):
    rows, ranked = made
    names = ["id", "root", "extension", "size"]
    kept = [r for r in rows if all(r[names.index(c)] == v for c, v in wanted.items())]
    assert ranked.total(wanted) == len(kept)
    last = max(0, -(-len(kept) // 50) - 1)
    for number in sorted({0, 1, last // 2, last, last + 1}):
        assert [tuple(r) for r in ranked.page(number, 50, wanted).collect()] == kept[number * 50 : (number + 1) * 50]
    assert [tuple(r) for r in ranked.page(2, 333, wanted).collect()] == kept[666:999]


def test_a_deep_page_reads_few_rows(made, spark, tmp_path):
    rows, ranked = made
    blocks = [f.split("/block=")[1].split("/")[0] for f in ranked.page(40, 50).inputFiles()]
    assert len(set(blocks)) <= 2
    wide = spark.range(50_000).select("id", F.col("id").cast("string").alias("name"))
    big = RankedTable.create(wide, str(tmp_path / "b"), [F.desc("id")], block_rows=500)
    page = big.page(900, 50)
    read = spark.read.parquet(*page.inputFiles()).count()
    assert read < 0.05 * 50_000 and [r.id for r in page.collect()] == list(range(4_999, 4_949, -1))


def test_odd_tables(spark, tmp_path, made):
    none = RankedTable.create(spark.createDataFrame([], "id long"), str(tmp_path / "e"), [F.asc("id")])
    assert none.total() == 0 and none.page(0).count() == 0
    one = RankedTable.create(spark.createDataFrame([(None,), (None,), (1,)], "id long"), str(tmp_path / "o"), [F.asc_nulls_first("id")], ["id"])
    assert [r.id for r in one.page(0).collect()] == [None, None, 1] and one.total({"id": None}) == 2 and one.page(-1).count() == 3 and one.page(1).count() == 0
    with pytest.raises(ValueError):
        made[1].total({"size": 1})
