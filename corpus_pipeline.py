"""The corpus pipeline: language id, near-duplicates, decontamination, personal data, source mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last returns one row for each reading of a document.
Extra columns pass through all stages, whatever their names. A text is held whole by one task at a time, never in a prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, language_id, mixture, pii
from tessera.runtime import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language go: those that are null, empty or without a letter. Every other text has a nearest language and
    stays, as it is, repeated rows each; where no row is labelled no language is known, and all go. Texts are judged whole."""
    profiles = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return language_id.identify(docs, profiles).where("guess.lang != 'und'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id, then the least hash of its text;
    of rows of one id and text the least by the JSON of its other columns. Texts without words are groups of their own,
    equal ones under one id together. An empty table gives an empty one."""
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, repeated rows each; null and empty texts hold none and stay. With
    an empty benchmark, or null items only, all documents stay."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.clean(found, docs.columns, "document")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows. Null texts stay null, texts without a span
    stay as they are; equal texts are treated alike, and no row goes. The classifier learns from the counts of all documents;
    without any it adds no span, and base spans are replaced all the same."""
    return pii.redacted(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Readings of the documents in mixed order keys: sources flattened to the target entropy within the repeats limit. A null
    source is one of its own, one without tokens is left out, repeated rows are documents of their own, and a very long
    text is read only where it fits its source's budget whole. Columns named like those added give way to them."""
    return mixture.mixed(docs, carry_text=True)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", benchmark_free), ("pii", personal_data), ("mixing", mix)]

#: Language ranks, MinHash, EM and bisection have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
