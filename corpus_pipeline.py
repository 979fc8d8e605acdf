"""A corpus pipeline of five stages: quality rules, quality classifier, near-duplicate join, passage dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
documents; the last returns the packed pieces. Between stages the rows are written and read again.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalake.llm.common import discard, shared_folder, stored, table
from mutalake.llm.ngram_join import ngram_components
from mutalake.llm.packing import pack_documents
from mutalake.llm.passages import without_repeats
from mutalake.llm.quality_rules import judge
from mutalake.llm.quality_votes import vote_quality
from mutalake.llm.queries import remainder


def _rows(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """docs with an id for each row, and the column that holds its own id; docs as they are if their ids do.

    Where ids repeat or are missing, rows are numbered in a stored copy, so that each is decided by itself.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, None
    own = "own_id"
    while own in docs.columns:
        own += "_"
    return stored(docs.withColumnRenamed("doc_id", own).withColumn("doc_id", F.monotonically_increasing_id())), own


def _labels(rows: DataFrame, own: str | None, labels: DataFrame) -> DataFrame:
    """The labels under the ids of rows."""
    return labels if own is None else rows.select("doc_id", F.col(own).alias("own_id")).join(labels.withColumnRenamed("doc_id", "own_id"), "own_id").drop("own_id")


def _back(rows: DataFrame, own: str | None, columns: list[str]) -> DataFrame:
    return rows.select(*columns) if own is None else rows.drop("doc_id").withColumnRenamed(own, "doc_id").select(*columns)


def _only(rows: DataFrame, own: str | None, kept: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose id is among the kept ones."""
    return _back(rows.join(kept.select("doc_id"), "doc_id", "left_semi"), own, columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep.

    Each row is decided by its own text and language, whether its id is null, repeated or neither; null and empty texts
    go (fewer than 50 words). Labels with a null or unknown id count for nothing; a label counts for
    each row of its id. Repeated rows share their fate, ties of cutoffs go to the looser one. An empty
    table stays empty. Further columns stay and are not read, whatever their names.
    """
    rows, own = _rows(docs)
    return _only(rows, own, judge(rows, _labels(rows, own, table(spark, sf_dir, "labels"))).where("kept"), docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier scores 0.3 or more, fitted on labels whose crc32(doc_id) mod 5 is not 0.

    Each row is decided by its own text; null and empty texts are scored as such. Without labels of
    both marks all rows have the share of good labels, 0.5 without any. Equal texts score alike; null
    and repeated ids, empty tables and further columns as in quality_rules.
    """
    rows, own = _rows(docs)
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    return _only(rows, own, vote_quality(rows, _labels(rows, own, labels), F.lit(True)).where("predicted = 1"), docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id; the first one where ids repeat or are missing.

    Rows without words are no group and stay. Copies under one id are a group like any other. An empty
    table stays empty. Further columns stay and are not read, whatever their names.
    """
    rows, own = _rows(docs)
    return _only(rows, own, ngram_components(rows).where("doc_id = component_id"), docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages of 50 words that occur earlier are cut from their texts, and n_chars is the new length.

    Earlier is a smaller id, then a smaller place; where ids repeat or are missing, an earlier row. Null
    texts stay null, a text that is cut whole stays as an empty one. A row that repeats an earlier one
    is cut like any copy. An empty table stays empty. Further columns stay and are not read, whatever their names.
    """
    rows, own = _rows(docs)
    return _back(without_repeats(rows).withColumn("n_chars", F.length("text").cast("long")), own, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 1024 tokens; see pack_documents.

    A null text is packed as an empty one, a row with a null or repeated id as a document of its own under
    that id. An empty table gives no pieces. Further columns are neither read nor returned.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Not expressible: tokenizer ids, MinHash candidates and fitted models; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    A stage's rows are deleted when the next stage's are written; those that the last one reads, when the session ends.
    """
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    atexit.register(discard, spark, at)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                discard(spark, f"{at}/{k - 1}")
    return docs
