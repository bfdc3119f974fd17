"""A corpus pipeline over `documents`: five stages, each written as Parquet and reread by the caller.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last
return the columns of docs: toxic documents go, one document of each near-duplicate
group stays, secrets are masked in the text, documents are dropped or repeated by
their mixing rate; the last returns the packed pieces.

In every stage an empty table gives an empty result, null and empty texts are kept unless the stage
says otherwise, rows without a doc_id are carried, and columns of docs with other names, whatever
they are called, go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, near_dedup, packing, secrets, toxicity
from ledgerloom.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below one half; a score of exactly one half goes, rows with equal texts share their fate, and without labels of both classes all stay."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of its least doc_id; rows without words or without a doc_id all stay.

    Rows that share a doc_id are one document: of those the one with the least text (none before any) stays, of equal texts any.
    """
    kept = near_dedup.near_groups(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    mine = docs.where("doc_id is not null").select("doc_id", "text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text")))
    one_each = mine.join(kept, "doc_id", "left_semi").withColumn("k", first).where("k = 1").select("row.*")
    return one_each.unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in the text replaced by a mark and n_chars counted anew; null texts stay null, rows with equal texts are masked alike."""
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "text")  # no name of docs can clash
    found = secrets.scanned(rows)
    masked = found.select("row", secrets.redacted(F.col("text"), F.col("spans")).alias("masked"), (F.size("spans") > 0).alias("changed"))
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("changed"), F.char_length("masked").cast("long")).otherwise(F.col("row.n_chars"))}
    return masked.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their mixing rate says; repeated rows are documents of their own, rows of equal length are taken in the order of a hash."""
    return mixing.sample(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token piece and its place; a null text is one piece holding id 0, repeated rows are packed each, pieces of equal length in the order of their ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # packing and the learnt stages have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
