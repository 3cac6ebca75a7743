"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

language: documents that language identification rejects go; `lang` becomes the language found.
near_duplicates: one row of each component of the Jaccard join stays, the one with the least id.
personal_data: what is found in a text becomes a mark, and `n_chars` follows.
mixture: each row stands as often as the mix takes it, from never to twice.
packing: the packed pieces, one row each.

No stage drops a row for want of an id: decisions are joined by a hash of a row's values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import jaccard, language, mixing, packing, pii
from quernel.llm.common import cut, ready

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The cube method is random, PII discovery and the join are iterative: SQL cannot express the whole.
ORACLE_SQL = None


def _key(columns: tuple[str, ...]) -> Column:
    """A number for the values of the columns, nulls included: rows with equal values share it, ids or not."""
    return F.xxhash64(*columns, *[F.isnull(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row by its own text, source and declared language; rows without an id are treated like others."""
    ready(spark)
    keyed = docs.select(*COLUMNS).withColumn("_key", _key(COLUMNS))
    found = language.identify(keyed.drop("doc_id").withColumnRenamed("_key", "doc_id"), models=language.fit(docs))
    kept = found.filter("kept").groupBy(F.col("doc_id").alias("_key")).agg(F.min("language").alias("_language"))
    return keyed.join(kept, "_key").withColumn("lang", F.col("_language")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the least id, a row without an id only where none has one.

    Texts that share an id are documents of their own. Rows with equal id and text are one document,
    of which the row with the least source, language and length stays.
    """
    ready(spark)
    keyed = docs.select(*COLUMNS).withColumn("_key", _key(("doc_id", "text")))
    parts = jaccard.join(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ids = keyed.select("_key", "doc_id").distinct()
    least = F.min(F.struct(F.isnull("doc_id").alias("lost"), "doc_id", "_key")).alias("_least")
    first = cut(parts.join(ids, "_key").groupBy("component_id").agg(least).select("_least._key"))
    rest = F.min(F.struct("source", "lang", "n_chars")).alias("_rest")
    rows = keyed.join(first, "_key", "left_semi").groupBy("_key").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), rest)
    return rows.select("doc_id", "text", "_rest.lang", "_rest.source", "_rest.n_chars").select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    text = pii.redact(F.col("text"), F.col("spans"))
    return pii.find(docs.select(*COLUMNS)).withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies are those of each row, with an id or not; wholly equal rows stand as often as all of them are taken."""
    ready(spark)
    keyed = docs.select(*COLUMNS).withColumn("_key", _key(COLUMNS))
    mixed = mixing.mix(keyed.select(F.col("_key").alias("doc_id"), "text", "source"))
    copies = mixed.groupBy(F.col("doc_id").alias("_key")).agg(F.sum("copies").cast("int").alias("_copies")).filter("_copies > 0")
    return keyed.dropDuplicates(["_key"]).join(copies, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what is between them is written to the shared checkpoint folder."""
    ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
