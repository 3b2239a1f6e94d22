"""A corpus pipeline of five stages: quality, exact duplicates, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. run() applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import bpe_automaton, cotraining, decontaminate, exact_dedup, simhash
from veldspar.llm.common import written


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its rows, and that column's name, from a written table, so that the keys are the same each time they are read."""
    key = "row_key"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of _keyed() whose key isn't in gone (its one column), without the key."""
    return rows.join(gone.toDF(key), key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Each row is judged by itself, so repeated rows share one decision. Null and empty texts and null metadata are
    scored as such; an empty table gives an empty one; more columns are passed on.
    """
    return cotraining.accepted(docs, cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the row with the smallest doc_id.

    Rows are decided one by one: of equal texts one row stays, whether doc_ids repeat or are null (null gives way to
    any id; of several rows with the smallest id the first stays). Null text is empty, and all empty texts are equal;
    texts of any length are compared whole; an empty table gives an empty one; more columns are passed on.
    """
    rows, key = _keyed(docs)
    found = written(exact_dedup.exact_groups(rows.select(F.col(key).alias("row_key"), "doc_id", "text"), also=("row_key",)), "groups")
    equal = found.where("kept and group_size > 1")
    first = equal.groupBy("text_sha256").agg(F.min("row_key").alias("row_key"))
    return _without(rows, key, found.where("not kept").select("row_key").union(equal.select("row_key").join(first, "row_key", "left_anti")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that pairs with a five-word Jaccard similarity of 0.8 or more link, the row with the smallest doc_id.

    Rows are decided one by one: one row of a group stays, null ids after all others, of equal ids the first row. Texts
    without words are copies of each other; an empty table gives an empty one; more columns are passed on.
    """
    rows, key = _keyed(docs)
    part = written(simhash.similar_rows(rows.select(F.col(key).alias("row"), "text")), "parts")
    found = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id")).join(part, F.col("row") == F.col("node"))
    first = found.groupBy("component").agg(F.min(F.struct(F.isnull("id"), "id", "row"))["row"].alias("node"))
    return _without(rows, key, part.join(first, "node", "left_anti").select("node"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.

    Each row is judged by itself. Null and empty texts hit nothing and stay; an empty benchmark removes nothing; an
    empty table gives an empty one; more columns are passed on.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents' token ids and of the text decoded from them: a row for each row, null text as empty."""
    import public_tokenizers

    return bpe_automaton.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: SQL can express neither the classifier, nor the linking of near duplicates, nor tiling, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
