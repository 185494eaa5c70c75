"""The keyed table against a dictionary, and how many files a small batch touches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.sources import keyed_table
from folioscope.sources.keyed_table import KeyedTable

SCHEMA = "root string, path string, size long, owner string"


def folded(state, batch):
    for root, path, size, owner, _ in sorted(batch, key=lambda r: r[4]):
        old = state.get((root, path))
        state[root, path] = (size, owner if owner is not None else old[1] if old else None)


def as_rows(state):
    return sorted(((*k, *v) for k, v in state.items()), key=str)


def got(frame):
    return sorted(map(tuple, frame.select("root", "path", "size", "owner").collect()), key=str)


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(2**63), 2**63 - 1, 5_000), rng.integers(-(2**63), 2**63 - 1, 20_000)
    made = keyed_table.bloom(own)
    assert keyed_table.may_hold(made, own).all() and keyed_table.may_hold(made, other).mean() < 0.03
    assert not keyed_table.may_hold(keyed_table.bloom(own[:0]), other).any()


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    first = [(f"/r{i % 3}", f"p{i:04d}é", i, rng.choice([None, "a"])) for i in range(0, 600, 2)]
    table = KeyedTable.create(spark.createDataFrame(first, SCHEMA), str(tmp_path / "t"), ["root", "path"], ["owner"], 50)
    state = {r[:2]: r[2:] for r in first}
    versions = {1: as_rows(state)}
    for step in range(5):
        batch = [
            (f"/r{(i := rng.randrange(700)) % 4}", f"p{i:04d}é", rng.choice([None, i]), rng.choice([None, "b", "c"]), n)
            for n in range(rng.choice([0, 3, 80]))
        ]
        number = table.append(spark.createDataFrame(batch, f"{SCHEMA}, seq long"), "seq", deltas=3)
        folded(state, batch)
        versions[number] = as_rows(state)
        assert got(table.read()) == as_rows(state)
    table.compact(range_files=2)
    assert got(table.read()) == as_rows(state)
    for version, rows in versions.items():
        assert got(table.read(version)) == rows
    files = table.manifest()
    assert all(f["batch"] is None for f in files) and sum(f["n_rows"] for f in files) == len(state)
    wanted = rng.sample(sorted(state), 7) + [("/r0", "nothing")]
    found = table.lookup(spark.createDataFrame(wanted, "root string, path string"))
    assert got(found) == [r for r in as_rows(state) if r[:2] in set(wanted)]


def test_a_small_batch_rewrites_few_files(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit("/r").alias("root"), F.format_string("p%06d", "id").alias("path"), F.col("id").alias("size"), F.lit("a").alias("owner"))
    table = KeyedTable.create(rows, str(tmp_path / "t"), ["root", "path"], file_rows=500)
    before = {f["file"] for f in table.manifest()}
    assert len(before) >= 35
    # One key in a hundred, all in one place.
    table.append(rows.filter("size between 7000 and 7199").withColumn("owner", F.lit("b")))
    assert before <= {f["file"] for f in table.manifest()}
    done = table.compact()
    after = {f["file"] for f in table.manifest()}
    assert done["rewritten"] <= 4 and len(before & after) == len(before) - done["rewritten"]
    assert table.read().groupBy("owner").count().orderBy("owner").collect() == [("a", 19_800), ("b", 200)]
    # Keys that no file holds rewrite none, but for a filter's rare error.
    fresh = rows.filter("size < 40").withColumn("path", F.concat("path", F.lit("x")))
    table.append(fresh)
    assert table.compact()["rewritten"] <= 1 and table.read().count() == 20_040
    found = table.lookup(rows.filter("size = 12345"))
    assert [r.size for r in found.collect()] == [12_345]
    assert len(set(found.inputFiles())) <= 2
    # A range that grows is cut into ranges of its own.
    table.append(rows.filter("size >= 19000").withColumn("path", F.concat("path", F.lit("y"))))
    table.append(rows.filter("size >= 19000").withColumn("path", F.concat("path", F.lit("z"))))
    table.compact(range_files=1)
    assert max(f["n_rows"] for f in table.manifest()) <= 1_500 and table.read().count() == 22_040


def test_versions_and_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    table = KeyedTable.create(none, str(tmp_path / "t"), ["root", "path"])
    assert table.read().count() == 0 and table.compact() == {"rewritten": 0, "kept": 0, "added": 0}
    table.append(none)
    one = spark.createDataFrame([("/a", "p", 1, None)], SCHEMA)
    number = table.append(one)
    assert got(table.read()) == [("/a", "p", 1, None)] and table.compact()["added"] == 1
    assert got(table.read(number)) == got(table.read()) == got(table.lookup(one))
    with pytest.raises(Exception, match="already exists"):
        table._commit(number, [])
    with pytest.raises(Exception, match="NULL"):
        table.append(spark.createDataFrame([("/a", None, 1, None)], SCHEMA))
    assert got(table.read()) == [("/a", "p", 1, None)]
