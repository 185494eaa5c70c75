"""Splits, folds and metrics, with a fixed rule in place of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.split import stratified_folds, stratified_split
from .registry import files, labelled, query
from .statistics import LABELLED_SQL

CLASSES = ["Reference", "Reports-de", "Reports-en", "Reports-es", "Reports-fr", "Transitory"]
RULE = """case file_id % 5 when 0 then 'Transitory' when 1 then 'Reports-en' when 2 then business_capability
      when 3 then 'Reference' else 'Unseen' end"""
COUNTS_SQL = f"""{LABELLED_SQL}, scored as (select business_capability as actual, {RULE} as predicted from labelled),
    counts as (select actual, predicted, count(*) as n from scored group by 1, 2),
    names as (select actual as label from counts union select predicted from counts),
    per_class as (
      select label, coalesce(sum(n) filter (where actual = label), 0)::bigint as support,
        coalesce(sum(n) filter (where predicted = label), 0)::bigint as predicted_n,
        coalesce(sum(n) filter (where actual = label and predicted = label), 0)::bigint as hit
      from names left join counts on actual = label or predicted = label group by label),
    scores as (
      select label, support, coalesce(hit::double / nullif(predicted_n, 0), 0) as "precision",
        coalesce(hit::double / nullif(support, 0), 0) as recall,
        coalesce(2 * hit::double / nullif(predicted_n + support, 0), 0) as f1
      from per_class)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rows.select(F.col("business_capability").alias("actual"), F.expr(RULE).alias("predicted"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_counts(predictions(spark, sf_dir), "actual", "predicted")


@query(
    "stratified_split",
    f"""{LABELLED_SQL}, r as (
      select file_id, business_capability, count(*) over (partition by business_capability) as n,
        row_number() over (partition by business_capability order by md5(concat('42:', file_id)), file_id) as k
      from labelled)
    select file_id, business_capability,
      case when k <= least(n - 1, greatest(1, floor(0.2::double * n + 0.5))) then 'test' else 'train' end as split from r""",
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("file_id", "business_capability")
    return stratified_split(rows, "business_capability", "file_id")


@query(
    "stratified_split_all",
    f"""{LABELLED_SQL}, r as (
      select file_id, extension, count(*) over (partition by extension) as n,
        row_number() over (partition by extension order by md5(concat('7:', file_id)), file_id) as k
      from files where extension is not null)
    select file_id, extension,
      case when k <= least(n - 1, greatest(1, floor(0.4::double * n + 0.5))) then 'test' else 'train' end as split from r""",
)
def split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("file_id", "extension").filter("extension is not null")
    return stratified_split(rows, "extension", "file_id", 0.4, seed=7)


@query(
    "stratified_folds",
    f"""{LABELLED_SQL} select file_id, business_capability,
      ((row_number() over (partition by business_capability
        order by md5(concat('42:', file_id)), file_id) - 1) % 5)::int as fold from labelled""",
)
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("file_id", "business_capability")
    return stratified_folds(rows, "business_capability", "file_id", 5)


@query("confusion", f"{COUNTS_SQL} select * from counts")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir)


@query(
    "confusion_matrix",
    f"""{COUNTS_SQL} select label as actual, {', '.join(
        f"coalesce(sum(n) filter (where predicted = '{c}'), 0)::bigint as " + f'"{c}"' for c in CLASSES)}
    from names left join counts on actual = label where label <> 'Unseen' group by label""",
)
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(counts(spark, sf_dir), CLASSES)


@query("class_labels", f"{COUNTS_SQL} select label from names")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_labels(counts(spark, sf_dir))


@query(
    "class_report",
    f"""{COUNTS_SQL}, rows as (
      select label, "precision", recall, f1, support from scores union all
      select 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support)::bigint from scores union all
      select 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support)::bigint from scores)
    select label, round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1, support from rows""",
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.class_report(counts(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "accuracy_f1",
    f"""{COUNTS_SQL} select round((select sum(n) filter (where actual = predicted) / sum(n) from counts), 9) as accuracy,
      round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from scores""",
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = metrics.headline_metrics(counts(spark, sf_dir))
    return row.select(*[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


SCORE = """((file_id * 7919 + length(label) * 31 + ascii(right(label, 1))) % 101
      + case when label = business_capability and file_id % 2 = 0 then 40 else 0 end) / 141.0"""
SCORES_SQL = f"""{LABELLED_SQL}, names as (select distinct business_capability as label from labelled),
    s as (select label, business_capability = label as positive, {SCORE.replace('141.0', '141.0::double')} as score
          from labelled, names),
    r as (select *, rank() over (partition by label order by score) + (count(*) over (partition by label, score) - 1) / 2.0 as r from s),
    a as (select label, (sum(r) filter (where positive) - count(*) filter (where positive) * (count(*) filter (where positive) + 1) / 2.0)::double
            / (count(*) filter (where positive) * count(*) filter (where not positive)) as auc
          from r group by label)"""


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per row and class; the class list is the fixed one."""
    named = labelled(spark, sf_dir).select(
        "file_id", "business_capability", F.explode(F.array(*map(F.lit, CLASSES))).alias("label")
    )
    return named.select(
        "label",
        (F.col("label") == F.col("business_capability")).alias("positive"),
        F.expr(SCORE.replace("141.0", "141.0D")).alias("score"),
    )


@query("auc_per_class", f"{SCORES_SQL} select label, round(auc, 9) as auc from a")
def auc_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.auc_per_class(class_scores(spark, sf_dir))
    return rows.withColumn("auc", F.round("auc", 9))


@query(
    "auc_ovr",
    f"{SCORES_SQL} select round(case when count(*) > 2 then avg(auc) end, 9) as roc_auc_ovr from a",
)
def auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = metrics.auc_macro(metrics.auc_per_class(class_scores(spark, sf_dir)))
    return row.select(F.round("roc_auc_ovr", 9).alias("roc_auc_ovr"))
