"""The corpus pipeline: five stages over ``documents``, each one operator of ``ledgerloom.llm``.

A stage takes (spark, docs, sf_dir), with docs as the stage before left them,
and returns the documents it keeps with all their columns; the last returns
the packed pieces. Between stages the rows are written as Parquet and read
again. The third and the fourth stage decide by doc_id and text, so null and
repeated ids are decided like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontam, packing, quality_knn, quality_rules, simhash
from ledgerloom.llm.common import scratch, small_batches, table
from ledgerloom.llm.queries import MIN_SCORE, TOKENIZER, learned_labels


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as one column, safe from clashing names."""
    cols = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(cols))])
    return plain.select(plain[f"_{cols.index('doc_id')}"].alias("doc_id"), plain[f"_{cols.index('text')}"].alias("text"),
                        F.struct(*[F.col(f"_{i}") for i in range(len(cols))]).alias("row"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The carried rows with a key of their text; null is not the empty text."""
    return _carried(docs).withColumn("key", F.coalesce(F.md5("text"), F.lit("null")))


def _rows(carried: DataFrame, columns: list[str]) -> DataFrame:
    return carried.select([F.col(f"row._{i}").alias(c) for i, c in enumerate(columns)])


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the threshold table."""
    return _rows(quality_rules.judge(_carried(docs), "row").where("kept"), docs.columns)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least MIN_SCORE; learned from the labelled rows of the documents table."""
    scored = quality_knn.score(_carried(docs), table(spark, sf_dir, "documents"), learned_labels(spark, sf_dir), "row")
    return _rows(scored.where(F.col("score") >= MIN_SCORE), docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id, null last, then the smallest key of the text."""
    small_batches(spark)
    keyed = _keyed(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = (simhash.near_duplicates(keyed, carry="key").groupBy("root").agg(least.alias("least"))
            .select(F.col("least.doc_id").alias("i"), F.col("least.key").alias("k")))
    same = keyed.doc_id.eqNullSafe(F.col("i")) & (keyed.key == F.col("k"))
    # of rows that share id and text the first by its other columns
    order = F.to_json(F.struct(*[F.col(f"row._{i}") for i, c in enumerate(docs.columns) if c != "text"], F.lit(0).alias("_")))
    one = keyed.join(kept, same, "left_semi").withColumn("order", order).groupBy("doc_id", "key").agg(F.min_by("row", "order").alias("row"))
    return _rows(one, docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""
    keyed = _keyed(docs)
    found = (decontam.contaminated(keyed, table(spark, sf_dir, "benchmark"), carry="key")
             .select(F.col("doc_id").alias("i"), F.col("key").alias("k")).distinct())
    same = keyed.doc_id.eqNullSafe(F.col("i")) & (keyed.key == F.col("k"))
    return _rows(keyed.join(found, same, "left_anti"), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    small_batches(spark)
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=1))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
