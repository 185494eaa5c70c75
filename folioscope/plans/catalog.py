"""A file catalog derived from the document and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

# The catalog view; the text runs unchanged in Spark and DuckDB.
CATALOG_SQL = """
with b as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         split_part('txt,csv,HTML,json,xml,yml,cfg,docx,pdf,pptx,msg,sql,sas7bdat,ipynb,JPG,twbx,,tar.gz,dll,xlsx', ',', cast(d.doc_id % 20 + 1 as int)) as x
  from documents d left join labels l on l.doc_id = d.doc_id
), n as (
  select *, concat('/srv/', source) as root_path,
         case when doc_id % 5 = 0 then '/' else concat(lang, '/Q', doc_id % 4 + 1, ' Reports') end as subfolder,
         case when doc_id % 40 = 16 then concat('.doc_', doc_id)
              when x = '' then concat('doc_', doc_id)
              else concat('Doc-', doc_id, '_v', doc_id % 3, '.', x) end as file_name
  from b
)
select doc_id as file_id, root_path,
       concat(root_path, case when subfolder = '/' then '/' else concat('/', subfolder, '/') end, file_name) as path,
       file_name, subfolder, n_chars as size_bytes, 1704067200 + doc_id * 3607 as modified_epoch,
       case when doc_id % 11 = 0 then null else concat('user', doc_id % 17) end as modified_by,
       case when toxic = 1 then 'Transitory' when quality = 1 then concat('Reports-', lang)
            when quality = 0 then 'Reference' end as business_capability,
       text as content_text
from n
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table whose text is worked on, shared out when it has too few splits."""
    return spread(table(spark, sf_dir, name), key)


def catalog(spark: SparkSession, sf_dir: str, spread_text: bool = False) -> DataFrame:
    """The catalog over the tables in ``sf_dir``; ask for spread text to work on it."""
    documents = texts(spark, sf_dir) if spread_text else table(spark, sf_dir, "documents")
    return spark.sql(
        CATALOG_SQL.replace("from documents d", "from {documents} d").replace(
            "join labels l", "join {labels} l"
        ),
        documents=documents,
        labels=table(spark, sf_dir, "labels"),
    )
