"""Registration of queries with their SQL, and the listing view that many of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Listings made from documents, once for SQL and, by the same expressions, for DataFrames.
_DAY = "lpad(cast(1 + length(split_part(text, chr(10), 1)) % 28 as {s}), 2, '0')"
LISTINGS = """
select concat(source, ':', cast(doc_id as {s})) as source_id, doc_id as ord, source, lang as city,
  split_part(text, chr(10), 1) as title, text as description,
  concat('2024-01-', """ + _DAY + """, 'T', lpad(cast(doc_id % 24 as {s}), 2, '0'), ':00:00') as start_date,
  case when doc_id % 5 = 0 then concat('2024-02-', lpad(cast(1 + doc_id % 28 as {s}), 2, '0'), 'T12:00:00') end as end_date,
  case when doc_id % 2 = 0 then 'los-angeles' else 'orange-county' end as metro,
  case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then cast(0 as double) else 33.3e0 + cast((doc_id * 37) % 900 as double) / 1000e0 end as latitude,
  case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then cast(0 as double) else -118.5e0 + cast((doc_id * 53) % 1100 as double) / 1000e0 end as longitude,
  case doc_id % 8 when 0 then 'Free' when 1 then '$5' when 2 then '$10.50' when 3 then '$15 - $25' when 4 then null when 5 then '' when 6 then 'Donation' else 'Ages 12 & under $60' end as price,
  doc_id % 17 = 0 as is_featured, doc_id % 19 = 0 as is_recurring, doc_id % 9 = 0 as is_all_day,
  case doc_id % 6 when 0 then 'Music' when 1 then 'Craft' when 2 then 'Outdoor' when 3 then 'Museum' when 4 then 'Free Movie' else 'Other' end as category,
  case when doc_id % 3 = 0 then null else concat('Hall ', cast(doc_id % 7 as {s})) end as location_name,
  case when doc_id % 4 = 0 then concat(cast(doc_id % 90 as {s}), ' Main St, Irvine, CA 92602, USA') end as address,
  case doc_id % 5 when 0 then concat('https://cdn.example.org/', cast(doc_id as {s}), '.jpg') when 1 then 'https://images.unsplash.com/a.jpg' when 2 then '' end as image_url,
  case doc_id % 4 when 0 then concat('https://venue', cast(doc_id % 10 as {s}), '.example.org/e') when 1 then 'https://www.google.com/search?q=x' when 2 then '' end as external_url,
  case when doc_id % 10 = 3 then 'https://site.example.net' end as website_url,
  case doc_id % 14 when 3 then 'draft' when 5 then 'rejected' when 7 then null else 'published' end as status
from documents
"""  # fmt: skip


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view LISTINGS as a DataFrame, with tags."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents_of_listings")
    df = spark.sql(LISTINGS.format(s="string").replace("from documents", "from documents_of_listings"))
    return df.withColumn("tags", F.array(F.lower("category"), F.lit("family")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of (listings, spark, sf_dir); in sql, {listings} stands for the view."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(listings(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            SQL[name] = sql.replace("{listings}", "(" + LISTINGS.format(s="varchar") + ") l")
        return f

    return register
