"""A training-data pipeline of the corpus operators: every stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochline.llm import decontaminate, jaccard, repeats
from epochline.llm.queries import bpe_digests, quality_rows, test_items
from epochline.session import settle


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labels of those that are here.

    Null and empty texts are scored like others, repeated rows stay or go together, a null id teaches nothing; an empty table
    stays one. Other columns are kept as they are, whatever their names; a text is looked at whole, however long.
    """
    return quality_rows(spark, docs, sf_dir).where("predicted = 1").select(*docs.columns)


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies: five-word shingles that agree to 80 in 100.

    A document without words is alone in its class. Of repeated rows one stays. Rows without an id stay only in
    classes of which no row has one.
    """
    classes = jaccard.similar_classes(docs, k=5, num=80, den=100)
    first = classes.where(F.col("component").eqNullSafe(F.col("doc_id"))).select("doc_id", "tie")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    same = F.col("d.id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.tie") == F.col("f.tie"))
    kept = rows.alias("d").join(first.alias("f"), same, "left_semi")
    return kept.dropDuplicates(["id", "tie"]).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that start earlier; characters that a cut would split go too.

    A document of which nothing but white space is left is dropped; one without repeats stays as it is.
    """
    none = "no_text"
    while none in docs.columns:
        none += "_"
    others = [c for c in docs.columns if c != "text"]  # the text goes with the operator, and once
    cut = repeats.remove_repeats(docs.withColumn(none, F.col("text").isNull()), carry=(*others, none), as_text=True)
    whole = F.col("n_removed") == 0
    new = {
        "text": F.when(~F.col(f"carried.{none}"), F.col("kept")),
        "n_chars": F.when(whole, F.col("carried.n_chars")).otherwise(F.char_length("kept").cast("long")),
    }
    return cut.where(whole | (F.trim("kept") != "")).select(*(new[c].alias(c) if c in new else F.col(f"carried.{c}").alias(c) for c in docs.columns))


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none and stay, and so do repeated rows and null ids; an empty table stays one. Other columns are kept.
    """
    return decontaminate.decontaminate(docs, test_items(spark, sf_dir)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document that is left, a row each; null and empty texts have no tokens."""
    return bpe_digests(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_a_kind),
    ("repeats", cut_repeats),
    ("decontaminate", drop_test_items),
    ("bpe", encode),
]
#: No SQL: classifier, decontamination and encoding can't be expressed. The tests hold near copies, repeats and encoding against brute
#: force, decontamination against planted items and the rules of the classifier against conditions checked one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
