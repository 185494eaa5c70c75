"""What must not grow: what tasks of a fit unpack, rows of a forest's task, work by element of a text, memory of a worker."""

from collections import Counter

from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from folioscope.llm import shingles
from folioscope.llm.common import worker_cache
from folioscope.operators import tfidf
from folioscope.plans import training as t
from folioscope.session import evenly
from folioscope.streaming.tracked_runs import RunTracker


class Probe(Estimator):
    """Keeps what it is to be fitted on."""

    def copy(self, extra=None):
        return self

    def setFeaturesCol(self, name):
        return self

    def setLabelCol(self, name):
        return self

    def _fit(self, dataset):
        self.seen = dataset
        self.metadata, self.plan = dataset.schema["features"].metadata, dataset._jdf.queryExecution().analyzed().toString()
        self.size = dataset.first()["features"].size


def test_fits_get_vectors_without_names_and_lineage(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"word{i} common{i % 3}") for i in range(30)], "id long, label string, text string")
    spec = t.FeatureSpec(text=(t.TextFeature("text"),), categorical=(), numeric=())
    probe = Probe()
    trained = t.train(rows, "label", spec, probe)
    assert probe.size == len(t.feature_names(trained.features))
    assert not probe.metadata
    assert "RDD" in probe.plan and "_tfidf_text" not in probe.plan


def test_forests_get_even_tasks(spark, monkeypatch):
    monkeypatch.setattr(t, "FIT_TASK_ROWS", 10)
    found = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: (found.append(df.rdd.glom().map(len).collect()), fit(self, df))[1])
    rows = spark.range(60).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), (F.col("id") % 7).alias("n")).coalesce(1)
    spec = t.FeatureSpec(text=(), categorical=(), numeric=("n",))
    t.train(rows, "label", spec, t.random_forest(trees=2, depth=2))
    assert sum(found[0]) == 60 and max(found[0]) <= 15


def test_evenly(spark):
    rows = spark.range(100, numPartitions=2)
    assert [evenly(rows, 100, n).rdd.getNumPartitions() for n in (10, 50, 1000)] == [10, 2, 1]


def test_term_counts_in_batches(spark):
    rows = [(i, [f"w{(i * k) % 11}" for k in range(i % 40)] if i % 50 else None) for i in range(700)] + [(None, ["a", "a"]), (3, ["b"])]
    counted = tfidf.term_counts(spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(1), "id", "tokens")
    expected = Counter((i, w, n) for i, tokens in rows for w, n in Counter(tokens or []).items())
    assert Counter(map(tuple, counted.collect())) == expected
    assert "MapInArrow" in counted._jdf.queryExecution().executedPlan().toString()


def test_vectors_with_a_small_vocabulary_shuffle_no_terms(spark):
    rows = spark.createDataFrame([(i, ["the", f"w{i % 5}"]) for i in range(50)], "id long, tokens array<string>")
    found = tfidf.tfidf_vectors(rows, "id", "tokens", None, 2)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 100


def test_run_reports_are_plain():
    report = RunTracker(1, 1)._report("/r", {"queued": (1, 2, "queued", None, None, None)}, False)
    assert (report.dtypes == object).all() and report.loc[0, "queued_seq"] == 2 and report.loc[0, "ended_seq"] is None


def test_word_hashes_keep_few_words():
    for part in range(250):
        shingles.word_hashes([b"%d" % (1000 * part + i) for i in range(1000)])
    assert len(worker_cache("word_hashes")) <= 101_000
