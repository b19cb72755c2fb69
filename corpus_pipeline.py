"""A corpus from raw documents to packed training sequences, in stages.

Every stage takes the documents that its predecessor kept, as a stored table, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged
from tickersift.llm.language import fit_languages, predict_languages, prediction_column
from tickersift.llm.line_templates import drop_recurring_lines
from tickersift.llm.mixing import mixed_documents
from tickersift.llm.packing import pack_documents
from tickersift.llm.simhash import verified_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the classifier learns from their own labels, as in op2."""
    predicted = predict_languages(docs, fit_languages(docs))
    return predicted.where(~F.col(prediction_column(docs))["rejected"]).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, long ones from the second document on.

    One that had nothing else goes; the first document with a line keeps it.
    """
    cleaned = drop_recurring_lines(docs, min_docs_long=2, leaf_lines_long=2, several=True, words=0.7)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("n_dropped") > 0
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return cleaned.where(~emptied).select(*[v.alias(c) for c, v in columns.items()])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest id, then the first row: texts that share 0.8 of their five-word shingles."""
    placed = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("place"))
    rows = staged(placed, "placed-documents")  # written, so that a row's place stays the same
    keys = rows.select(F.struct(F.col("row.doc_id").alias("doc_id"), "place").alias("id"), F.col("row.text").alias("text"))
    groups = verified_near_duplicates(keys, words=5, id_column="id")
    stay = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select("id.place")
    return rows.join(stay, "place", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

# Language identification learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
