"""A corpus pipeline: quality rules, line dedup, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the columns of documents, with
n_chars set to the length of the text that is left. run() writes each result as Parquet and hands on what is read back.

Where doc_ids repeat, rows are told apart by doc_id and text. Extra columns, whatever their names, are carried through
by all stages but the last, which does not read them. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noveltide.llm import jaccard, line_dedup, packing, quality, suffix_dedup
from noveltide.llm.common import forget, free_name, saved_outside, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null, empty and short texts fail the base rules and go. Rows are judged one by one, so null and repeated doc_ids
    are no exception.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share.

    A null text comes back empty. A null doc_id keeps its lines. Rows of one doc_id count as one document.
    """
    own = {c: free_name(docs.columns, f"{c}_own") for c in docs.columns if c in ("n_lines", "n_dropped")}  # names that dedup_lines adds
    found = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped")
    return _with_text(found.withColumnsRenamed({v: k for k, v in own.items()}), "text", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, then text hash (five words, similarity 0.8).

    Texts without words and rows with a null doc_id are in no group and all stay. Of rows with equal doc_id and text one
    stays, and of rows with equal doc_id and different texts each is its own document.
    """
    found = jaccard.similar_documents(docs.select("doc_id", "text"), width=5, percent=80)
    first = found.where("group_key is not null").groupBy("group_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    names = [free_name(docs.columns, x) for x in ("_id", "_key", "_grouped", "_place")]
    doc, key, grouped, place = names
    alone = found.where("group_key is null and doc_id is not null").select("doc_id", "text_key").distinct()
    stay = first.select("first.doc_id", "first.text_key", F.lit(True)).union(alone.select("doc_id", "text_key", F.lit(False))).toDF(doc, key, grouped)
    kept = docs.join(stay, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(key)))
    kept = kept.withColumn(place, F.row_number().over(Window.partitionBy(doc, key).orderBy(doc))).where(f"{place} = 1 or not {grouped}")
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that stand in an earlier one. Cut characters go whole.

    Null texts stay null. Rows with a null doc_id take no part. Rows of one doc_id do not cut each other.
    """
    found = suffix_dedup.dedup_passages(docs.where("doc_id is not null").select("doc_id", "text"), 50, as_text=True)
    doc, key, text = (free_name(docs.columns, x) for x in ("_id", "_key", "_text"))
    cut = found.where("n_removed > 0").select("doc_id", "text_key", "kept")
    cut = cut.dropDuplicates(["doc_id", "text_key"]).toDF(doc, key, text)
    rest = docs.join(cut, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(key)), "left")
    return _with_text(rest, F.coalesce(F.col(text), docs["text"]), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens.

    A null or empty text is one piece, the end id. Rows are packed one by one, whatever their doc_id.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


def _with_text(df: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns, with `text` for text and its length for n_chars."""
    text = F.col(text) if isinstance(text, str) else text
    length = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return df.select(*[text.alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(c) for c in columns])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark):  # a stage's intermediates go once its result is written
            found = stage(spark, docs, sf_dir)
            docs = saved_outside(found)
        if before is not None:
            forget(before)
        before = docs
    return docs


#: SQL can't express the fitted rules nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None
