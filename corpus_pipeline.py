"""The corpus pipeline: filter, deduplicate, decontaminate and pack the documents of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, quality, toxicity
from tessera.llm.ngram_join import similar_components
from tessera.llm.shared import passing, scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores under its threshold: rows with a null id, null or empty text are clean
    and stay, repeated rows go or stay together. All columns of docs are returned, whatever their names."""
    net = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, net)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking scores at its threshold or more; null and empty texts by their zero measures,
    repeated rows alike. All columns of docs are returned."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component; of repeated rows (id and text) one stays.
    Null and empty texts are near nothing, and rows with a null id are never linked: they stay."""
    found = similar_components(docs)
    dropped = found.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("many")).filter("many > 1 AND doc_id IS NOT NULL").select("doc_id")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return once.union(kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, null and empty texts among them; an empty benchmark takes none away."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies among the training windows; a document without words has bin -1."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_windows),
]

#: Two stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir; each result is written and read again.

    What a stage writes on its way is deleted with it. Nulls, empty texts, repeated rows and empty tables go through
    as each stage's operator says; an empty table of documents gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-").lower())
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
