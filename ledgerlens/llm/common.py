"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text only, typed; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def is_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def joined(rows: DataFrame, counts: DataFrame, key: str, share: int = 1_000) -> DataFrame:
    """rows with the columns of counts(key, n, ...), which has every key of rows once; n says how many rows carry it.

    Keys that hold more than 1/share of the rows are fewer than `share` and are broadcast;
    the other rows are shuffled, and no key among them is hot. n itself is left out.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share > total
    few, many = F.broadcast(counts.where(hot).drop("n")), counts.where(~hot).drop("n")
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(many, key))
