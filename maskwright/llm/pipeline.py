"""From raw documents to token ids, in five stages. Each is written as Parquet in the shared folder and read again by the next.

Every stage but the last takes and returns the columns of documents. A stage's n_chars follows its text. Each row is a document of its own, but
for the line index, where rows that repeat an id (or have none) are parts of one document. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard_join, line_dedup, mixing, toxicity
from .common import NULL_ID, WORD, real_id, table, write_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go; null and empty ones have no toxic word and stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).where(~F.col("toxic")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id has too go. A document that loses all its lines stays, with the empty text; a null text
    becomes empty."""
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return kept.select(real_id().alias("doc_id"), "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def with_rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """With row, which tells rows apart, and whether that is the id: where ids are unique, null being one of them. Else rows
    are numbered, and written once so that numbers hold."""
    ids = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("row"))
    if ids.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return ids, True
    return write_once(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows"), False


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays, null being the smallest. Documents without words are in no
    class, and stay."""
    rows, unique = with_rows(docs)
    classes = jaccard_join.jaccard_join(rows, id_col="row").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("row"), F.coalesce("component_id", F.lit(NULL_ID)).alias("class"))
    if unique:
        first = classes.where("row = class").select("row")
    else:
        ids = rows.select("row", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"))
        first = ids.join(classes, "row").groupBy("class").agg(F.min(F.struct("id", "row")).alias("f")).select(F.col("f.row").alias("row"))
    return rows.join(first.hint("shuffle_hash"), "row", "left_semi").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each whole epoch of a document, and one with its first words where the budget ends. Documents that it
    doesn't take, and those without words, go."""
    rows, _ = with_rows(docs)
    plan = mixing.mix_to_weights(rows, row_col="row").where("taken > 0").select("row", F.col("size").alias("mix_size"), "taken")
    both = rows.join(plan.hint("shuffle_hash"), "row")
    parts = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("mix_size")) - 1).cast("int"))).alias("epoch")
    epochs = both.select(*COLUMNS, "mix_size", "taken", parts)
    words = F.least("mix_size", F.col("taken") - F.col("epoch") * F.col("mix_size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words), " ")
    text = F.when(words == F.col("mix_size"), F.col("text")).otherwise(cut)
    return epochs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact byte-level BPE ids of every row, with digests of the ids and of what they decode to; null texts are empty."""
    return bpe.encode_decode(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, remembered=60_000, forget=True)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix), ("BPE", encode)]

#: The model of the first stage and the encoding of the last can't be written in SQL; tests/llm/test_pipeline.py holds every stage and run()
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
