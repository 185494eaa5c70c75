"""Operators against brute force and the laws they must keep."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from folioscope.operators import metrics, query, ranking, runs, split, stats, tfidf, upsert


def test_upsert_rules(spark):
    old = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y")], "path string, m int, note string")
    new = spark.createDataFrame(
        [("p", None, "n1", 1), ("p", None, None, 2), ("r", 3, "z", 1), ("r", None, "w", 2)],
        "path string, m int, note string, seq int",
    )
    plain = {r.path: (r.m, r.note) for r in upsert.upsert(old, new, ["path"], "seq").collect()}
    assert plain == {"p": (None, None), "q": (2, "y"), "r": (None, "w")}
    kept = upsert.upsert(old, new, ["path"], "seq", keep=["m"])
    assert {r.path: (r.m, r.note) for r in kept.collect()} == {"p": (1, None), "q": (2, "y"), "r": (3, "w")}
    again = upsert.upsert(kept, new, ["path"], "seq", keep=["m"])
    assert sorted(again.collect()) == sorted(kept.collect())


def test_large_batches_take_the_shuffle_path(spark, monkeypatch):
    from folioscope import session

    old = spark.range(400).select(F.col("id").cast("string").alias("path"), F.col("id").alias("m"))
    new = spark.range(200, 600).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") % 2 == 0, -F.col("id")).alias("m"), F.col("id").alias("seq"),
    )
    wanted = sorted(map(tuple, upsert.upsert(old, new, ["path"], "seq", keep=["m"]).collect()))
    monkeypatch.setattr(session.small_keys, "__defaults__", (10,))
    assert upsert.small_keys(new.select("path")) is None
    assert sorted(map(tuple, upsert.upsert(old, new, ["path"], "seq", keep=["m"]).collect())) == wanted
    assert dict(wanted)["hot"] == -594 and dict(wanted)["201"] != -201


def test_finished_run(spark):
    from datetime import datetime

    counters = spark.createDataFrame([(7, 2)], "inserted long, errors long")
    begun = spark.createDataFrame([runs.change("/a", datetime(2024, 1, 1), 1, "running")], runs.LEDGER_SCHEMA)
    ended = runs.finishing_change(counters, "/a", datetime(2024, 1, 1, 0, 0, 5), 2)
    row = runs.current_runs(begun.unionByName(ended)).first()
    assert (row.status, row.total_files, row.total_errors, row.duration_seconds) == ("completed", 7, 2, 5.0)


def test_labels_and_roots(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, business_category string")
    batch = spark.createDataFrame([(1, "c", 1), (1, "", 2), (3, "d", 1)], "file_id long, business_category string, seq int")
    assert sorted(map(tuple, upsert.replace_labels(labels, batch, "seq").collect())) == [(2, "b"), (3, "d")]
    table = spark.createDataFrame([("A", "p"), ("B", "q")], "root_path string, path string")
    moved = spark.createDataFrame([("B", "p", 1)], "root_path string, path string, seq int")
    assert sorted(map(tuple, upsert.upsert(table, moved, ["path"], "seq").collect())) == [("B", "p"), ("B", "q")]
    assert sorted(map(tuple, upsert.replace_root(table, table.limit(0), "A").collect())) == [("B", "q")]


def test_missing_rows(spark):
    rows = spark.createDataFrame([(None, 1, None), ("", 1, 1), ("  ", None, 1), ("/a", None, None)], "p string, c int, m int")
    assert [r.p for r in upsert.drop_missing_paths(rows, "p").collect()] == ["/a"]
    assert upsert.drop_unreadable(rows, "c", "m").count() == 3


def test_sort_rules():
    keys = query.audit_order([("bad", "asc"), ("file_name", "asc"), ("extension", "down"), ("subfolder", "asc")])
    shown = [str(k) for k in keys]
    assert len(shown) == 3
    assert "file_name ASC" in shown[0] and "extension DESC" in shown[1] and "path ASC" in shown[2]
    assert "file_name ASC" in str(query.audit_order([])[0])
    assert "subfolder ASC" in str(query.catalog_order("bad", "descending")[0])


def test_page_count():
    assert [query.page_count(t, 50) for t in (0, 1, 50, 101)] == [0, 1, 1, 3]


def test_pages_agree(spark):
    rows = spark.range(997).select(
        (F.col("id") * 7919 % 101).alias("k"), F.col("id").cast("string").alias("path")
    )
    order = [F.desc("k"), F.asc("path")]
    for number in (0, 3, 19, 20):
        near = query.page(rows, order, number).collect()
        assert near == query.page(rows, order, number, deep_after=0).collect()
    assert query.page(rows, order, -4).collect() == query.page(rows, order, 0).collect()


def test_like_keeps_wildcards_and_backslashes(spark):
    rows = spark.createDataFrame([("a\\B_c",), ("axbyc",), ("Äb",), (None,)], "subfolder string")
    def found(text, **kw):
        return [r[0] for r in rows.filter(query.contains_nocase(query.fold_case("subfolder"), text, **kw)).collect()]
    assert found("\\b") == ["a\\B_c"]
    assert found("B_C") == ["a\\B_c", "axbyc"]
    assert found("B_C", literal=True) == ["a\\B_c"]
    assert found("ä") == []


def test_exact_median_with_narrowing(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_TASK_VALUES", 50)
    rng = random.Random(3)
    for values in (
        [rng.random() for _ in range(4001)],
        [rng.random() for _ in range(4000)],
        [1.0] * 3000 + [float(i) for i in range(1500)],
        [5.0],
        [1.0, 2.0],
        [float(i % 7) for i in range(2000)],
    ):
        frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        assert ranking.exact_median(frame, "v") == statistics.median(values)
    assert ranking.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None


def test_mode_prefers_the_smallest(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "v string")
    assert ranking.mode(rows, "v") == "a"


def test_medians_and_modes_together(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(1.0, 4, "b", "x"), (float("nan"), 1, "a", None), (3.0, None, "b", None), (8.0, 2, "a", "z")],
        "d double, i int, s string, t string",
    )
    wanted = {"d": 3.0, "i": 2.0}
    assert ranking.exact_medians(rows, ["d", "i"]) == wanted
    monkeypatch.setattr(ranking, "ONE_TASK_VALUES", 2)
    assert ranking.exact_medians(rows, ["d", "i"]) == wanted
    assert ranking.modes(rows, ["s", "t"]) == {"s": "a", "t": "x"}


def test_running_totals(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 501).alias("o"), F.col("id").alias("v"))
    got = ranking.running_totals(rows, "g", "o", ["v"]).collect()
    for row in got:
        assert row.v_before == sum(r.v for r in got if r.g == row.g and r.o < row.o)


@pytest.mark.parametrize("share", [0.1, 0.2, 0.4])
def test_split_is_exact_per_class(spark, share):
    rows = spark.range(1300).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 1299, F.concat(F.lit("c"), F.col("id") % 9)).otherwise("single").alias("y"))
    done = split.stratified_split(rows, "y", "id", share).collect()
    assert sorted(r.id for r in done) == list(range(1300))
    for label in {r.y for r in done}:
        n = sum(r.y == label for r in done)
        tests = sum(r.y == label and r.split == "test" for r in done)
        assert tests == min(n - 1, max(1, int(share * n + 0.5)))


def test_folds_differ_by_one(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("y"))
    done = split.stratified_folds(rows, "y", "id", 5).collect()
    for label in ("hot", "rest"):
        sizes = [sum(r.y == label and r.fold == f for r in done) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_fold_plan(spark):
    for smallest, expected in ((1, 2), (2, 2), (9, 3)):
        rows = spark.createDataFrame([("a",)] * smallest + [("b",)] * 9, "y string")
        assert stats.fold_plan(rows, "y", 3).first().folds == expected


def test_tfidf_against_a_loop(spark):
    import math
    from collections import Counter

    texts = ["aa bb aa cc", "bb bb dd", "", "aa", "ee " * 40 + "aa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", tfidf.terms("text").alias("t"))
    counts = [Counter(t.split()) for t in texts]
    df = Counter(term for c in counts for term in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    got = {(r.id, r.term): r.weight for r in tfidf.tfidf_vectors(docs, "id", "t").collect()}
    for i, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        for term, n in c.items():
            assert got.pop((i, term)) == pytest.approx(n * idf[term] / norm)
    assert not got
    top = tfidf.vocabulary(tfidf.term_statistics(docs, "t"), 5, max_features=2, min_df=2).collect()
    assert [r.term for r in top] == ["aa", "bb"]


def test_metrics_with_a_class_never_predicted(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), ("b", "b")], "y string, p string")
    counts = metrics.confusion_counts(rows, "y", "p")
    report = {r.label: r for r in metrics.class_report(counts).collect()}
    assert (report["c"].precision, report["c"].recall, report["c"].support) == (0.0, 0.0, 1)
    assert report["a"].precision == 0.5 and report["macro avg"].support == 4
    assert metrics.headline_metrics(counts).first().accuracy == 0.5
    matrix = {r.actual: (r.a, r.b, r.c) for r in metrics.confusion_matrix(counts, ["a", "b", "c"]).collect()}
    assert matrix == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (1, 0, 0)}


def test_auc_with_ties(spark):
    rng = random.Random(5)
    data = [(c, rng.randint(0, 6) / 6, rng.random() < 0.4) for c in "abc" for _ in range(200)]
    got = {r.label: r.auc for r in metrics.auc_per_class(spark.createDataFrame(data, "label string, score double, positive boolean")).collect()}
    for label in "abc":
        pos = [s for c, s, p in data if c == label and p]
        neg = [s for c, s, p in data if c == label and not p]
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert got[label] == pytest.approx(wins / len(pos) / len(neg))


def test_run_reset_and_order(spark):
    from datetime import datetime

    def at(m):
        return datetime(2024, 1, 1, 0, m)
    ledger = spark.createDataFrame(
        [
            runs.change("/a", at(0), 1, "queued"), runs.change("/a", at(1), 2, "running"),
            runs.change("/a", at(3), 3, "completed", 9, 1), runs.change("/b", at(4), 4, "queued"),
            runs.change("/c", at(0), 5, "queued"), runs.change("/c", at(2), 6, "running"),
            runs.change("/c", at(5), 7, "progress", 4, 0),
            runs.change("/d", at(0), 8, "running"), runs.change("/d", at(1), 9, "failed", 2, 2, "stat_error"),
            runs.change("/d", at(6), 10, "queued"),
        ],
        runs.LEDGER_SCHEMA,
    )
    state = runs.current_runs(ledger)
    rows = {r.root_path: r for r in state.collect()}
    assert (rows["/a"].status, rows["/a"].duration_seconds, rows["/a"].total_files) == ("completed", 120.0, 9)
    assert (rows["/d"].status, rows["/d"].started_at, rows["/d"].total_errors, rows["/d"].error_message) == ("queued", None, 0, None)
    assert [r.root_path for r in state.orderBy(*query.run_order()).collect()] == ["/c", "/d", "/b", "/a"]


def test_column_profile(spark):
    rows = spark.createDataFrame([("x", None), ("x", " "), (None, "z")], "a string, b string")
    got = {r.column: (r.distinct_values, r.non_blank, r.row_count) for r in stats.column_profile(rows, ["a", "b"]).collect()}
    assert got == {"a": (1, 2, 3), "b": (2, 1, 3)}


def test_scaling_of_a_constant(spark):
    rows = spark.createDataFrame([(4.0, 1.0), (4.0, 3.0)], "c double, v double")
    done = stats.scaled(rows, stats.fit_scaling(rows, ["c", "v"])).collect()
    assert [r.c_scaled for r in done] == [0.0, 0.0] and [r.v_scaled for r in done] == [-1.0, 1.0]


def test_key_pages_reach_every_row_with_nulls_and_descending_keys(spark):
    rows = [(a, b, i) for i, (a, b) in enumerate((a, b) for a in (None, 1, 2, 3) for b in (None, "x", "y"))]
    df = spark.createDataFrame(rows, "a int, b string, i int")
    for descending in ((), ("a",), ("a", "b"), ("b",)):
        order = [F.desc(k) if k in descending else F.asc(k) for k in ("a", "b", "i")]
        want = [r.i for r in df.orderBy(*order).collect()]
        got = [r for r in df.orderBy(*order).limit(5).collect()]
        while True:
            last = [got[-1][k] for k in ("a", "b", "i")]
            more = query.page_after(df, ["a", "b", "i"], last, 5, descending).collect()
            if not more:
                break
            got += more
        assert [r.i for r in got] == want
