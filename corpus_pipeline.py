"""A corpus pipeline over ``documents``: rules, near copies, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, jaccard_join, mixing, quality_rules, secrets
from docloom.llm.tables import checkpointed, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules and the model trained on the labelled rows accept."""
    return quality_rules.keep(docs, quality_rules.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return jaccard_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts masked."""
    found = checkpointed(secrets.candidates(docs))
    return secrets.redact(docs, found, secrets.train(docs, found))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix."""
    return mixing.mix(docs, mixing.root_weights(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded text, and its slot and block in the mix.

    Files don't keep an order, so the mix's schedule of the same rows is a part of them; rows ascend by slot. Rows
    with equal ids, sources and texts share their first slot.
    """
    place = mixing.schedule(docs.select("doc_id", "source", "text"), mixing.root_weights(docs))
    place = place.select(F.struct("doc_id", "source", "hash").alias("own"), F.struct("slot", "block").alias("at")).groupBy("own").agg(F.min("at").alias("at"))
    keyed = docs.select(F.struct("doc_id", "source", mixing.text_hash().alias("hash")).alias("key"), "text")
    found = bpe.encode_documents(keyed, bpe.public_paths(), key="key", with_ids=True)
    values = [c for c in found.columns if c != "key"]
    same = [F.col(f"key.{c}").eqNullSafe(F.col(f"own.{c}")) for c in ("doc_id", "source", "hash")]
    placed = found.join(place, same[0] & same[1] & same[2], "left")
    out = placed.select("key.doc_id", *values, F.col("at.slot").alias("slot"), F.col("at.block").alias("block_no"), "key.source")
    return out.repartitionByRange("slot", "doc_id").sortWithinPartitions("slot", "source", "doc_id").drop("source")


STAGES = [("quality rules", quality), ("near copies", near_copies), ("secret scan", secret_scan), ("mix", mixed), ("tokens", tokens)]
#: Models and the merging of near copies are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    import uuid

    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
