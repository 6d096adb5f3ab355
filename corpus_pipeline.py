"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage works on what the stage before kept: documents in, documents out (the last: the mix's plan by document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from angula.llm import decontaminate, jaccard, lines, mix, toxicity
from angula.llm.common import fresh, new_folder, remove, table


def same(docs: DataFrame) -> list:
    """The columns of docs, whatever they are called."""
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled rows of docs, does not take for toxic.

    Each row is judged by its text: equal rows alike, rows with a null id like others, a null text as an empty one. All
    columns stay as they were, whatever they are called; an empty table gives none; without labels all rows stay.
    """
    s, p = fresh(docs, "score", "predicted")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col=s, predicted_col=p).filter(F.col(p) == 0).select(*same(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their recurring lines; n_chars follows the text where a line went.

    Null texts stay null, equal rows stay equal, rows with null or repeated ids stay; other columns stay as they were; an
    empty table gives none.
    """
    n, dropped = fresh(docs, "n_lines", "n_dropped")
    out = lines.dedup(docs, n_lines=n, n_dropped=dropped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*same(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join: the one with the smallest id, once.

    Rows go by their text, so another row of the same id stays; of equal rows one stays. Null and empty texts all stay; a
    component without any id keeps one row. All columns stay as they were; an empty table gives none.
    """
    return jaccard.keep_one(docs).select(*same(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found.

    Null and empty texts stay, equal rows are treated alike, rows with null ids are held to the same rule; all columns stay
    as they were; an empty table gives none.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document of the mix.

    Null texts have no words, a null source is one of its own, null and repeated ids are rows like others; an empty table
    gives none.
    """
    return mix.mixed_sizes(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
]

#: Learned and iterative stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                remove(spark, before)
            before = path
    return docs
