"""Groups against a comparison of all pairs."""

import pytest
from helpers import SCHEMA, components, edited, invented, shingles

from folioscope.llm import near_dedup
from folioscope.llm.components import connected_components


def expected(rows, percent=85):
    sets = {i: shingles(r[1]) for i, r in enumerate(rows)}
    roots = components(sets, percent)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(roots[i], []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [d for d in groups[roots[i]] if d is not None]
        smallest = min(ids) if ids else None
        out.append((r[0], len(sets[i]), smallest, r[0] == smallest))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in near_dedup.near_duplicates(df, **kw).collect()), key=repr)


def test_awkward_and_empty(awkward, nothing):
    assert found(awkward) == expected([tuple(r) for r in awkward.collect()])
    assert found(nothing) == []


def test_documents(documents):
    assert found(documents) == expected([tuple(r) for r in documents.collect()])


@pytest.mark.parametrize("seed", range(2))
def test_large_groups_in_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(near_dedup, "LIST_ROWS", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_ELEMENTS", 900)
    base = invented(seed, 140)
    rows = [(i, edited(base, 100 * seed + i, i % 5), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, base, "en", "s", 0) for i in range(30)] + [(200 + i, invented(900 + i, 90), "en", "s", 0) for i in range(20)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


@pytest.mark.parametrize("percent", [70, 80, 95])
def test_other_thresholds(spark, percent):
    base, rows = invented(50, 300), []
    for i in range(40):
        rows.append((i, edited(base, i, i % 16), "en", "s", 0))
    rows += [(100 + i, edited(invented(60 + i // 4, 150), i, i % 4 * 2), "en", "s", 0) for i in range(40)]
    assert found(spark.createDataFrame(rows, SCHEMA), percent=percent) == expected(rows, percent)
    assert near_dedup.shared_part(85) == 0.625 and near_dedup.shared_part(80) < 0.625 < near_dedup.shared_part(95)


def test_ids_that_are_missing_or_repeat(spark):
    base, other = invented(70, 120), invented(71, 120)
    near, near2 = edited(base, 1, 1), edited(base, 2, 1)
    # A copy without an id, two texts under one id, and a group in which no row has an id.
    rows = [(None, base, "", "", 0), (5, near, "", "", 0), (1, other, "", "", 0), (2, edited(other, 3, 1), "", "", 0), (2, near2, "", "", 0),
            (2, near2, "", "", 0), (None, invented(72, 90), "", "", 0), (None, edited(invented(72, 90), 4, 1), "", "", 0), (None, None, "", "", 0),
            (None, None, "", "", 1), (9, "", "", "", 0), (9, invented(73, 80), "", "", 0), (9, edited(invented(73, 80), 5, 1), "", "", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(table) == expected(rows)
    kept = near_dedup.without_near_duplicates(table).collect()
    assert sorted((r.doc_id, r.n_chars) for r in kept if r.doc_id is None and r.text is None) == [(None, 0), (None, 1)]
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 9, 9] and {r.text for r in kept if r.doc_id == 2} == {near2}
    assert sum(r.doc_id is None and r.text is not None for r in kept) == 1


def test_stage_keeps_one(awkward, spark):
    kept = near_dedup.without_near_duplicates(awkward.withColumn("node", near_dedup.F.lit(1)).withColumn("_id", near_dedup.F.lit(2)))
    rows = kept.filter("doc_id is not null").collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids))
    assert set(ids) == {d for d, _, c, k in expected([tuple(r) for r in awkward.collect()], 80) if d is not None and k}
    assert kept.columns == [*awkward.columns, "node", "_id"]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
