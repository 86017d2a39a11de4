"""From documents to packed training windows, in five stages.

1. language_id: documents whose language isn't told (no letter, or a score below one half) go;
   a missing label takes the prediction.
2. near_dedup: of documents linked by near-duplicate texts, the one with the smallest id stays.
3. substring_dedup: words of passages that occur again go; texts without such words stay as they are.
4. secret_scan: secrets and random strings in texts become marks.
5. packing: pieces of token sequences in windows of 2048.

Rows with null or empty text leave in stage 1.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm import language, near, packing, secrets, substring
from listwright.llm.frames import batches_of, documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5
#: Rows that a Python worker holds at once; texts may be long, and workers keep what they once took.
BATCH = 1000


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.filter(~language.held_out()), "doc_id", "text", "lang")
    found = language.predict(docs.select(*COLUMNS), model)
    kept = found.filter((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_first(docs.select(*COLUMNS))


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs.select(*COLUMNS), secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES = [
    ("language_id", _language_id),
    ("near_dedup", _near_dedup),
    ("substring_dedup", _substring_dedup),
    ("secret_scan", _secret_scan),
    ("packing", _packing),
]

#: The stages are models, sketches and tokenizers, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with batches_of(spark, BATCH):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
