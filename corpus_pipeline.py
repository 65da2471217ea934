"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.llm.decontaminate import decontaminate
from perfloom.llm.line_dedup import dedup_lines
from perfloom.llm.near_dup import near_duplicates, text_hash
from perfloom.llm.packing import pack
from perfloom.llm.quality import fold, score, train
from perfloom.llm.tables import bounded, dropped, read, stored

#: Documents below this score are rejected.
LEAST_SCORE = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts. It learns from `labels` for the documents at hand, without those of the held-out fold.

    null and empty texts are scored like others; of repeated rows all stay or none; rows with a null doc_id are scored,
    not learnt from. Without labels every score is 0.5, and all rows stay.
    """
    model = train(docs, read(spark, sf_dir, "labels").where(fold() != 1))
    mine = _free("score", docs)
    return score(docs, model, mine).where(F.col(mine) >= LEAST_SCORE).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that occur earlier. A document of which nothing but white space is left by that goes.

    null and empty texts stay as they are, and so do rows with a null doc_id. Rows that repeat a doc_id are one document.
    """
    lines, removed = _free("n_lines", docs), _free("n_removed", docs)
    out = dedup_lines(docs, names=(lines, removed)).where(f"`{removed}` = 0 or text rlike '[^\\\\s]'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    A row goes by its own doc_id and text, so rows that repeat a doc_id with other texts are judged apart; those that
    repeat both stay together. Rows with a null doc_id and texts without words stay.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct().checkpoint()
    return docs.join(bounded(gone), (F.col("doc_id") == F.col("__id")) & (text_hash() == F.col("__hash")), "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go. null and empty texts, and rows with a null doc_id, stay; rows that repeat a doc_id go together."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence, with its token ids. null and empty texts give their end token; repeated rows are packed as often as they occur."""
    return pack(docs)


def _free(name: str, docs: DataFrame) -> str:
    """`name`, or a longer one that no column of `docs` has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
#: SQL has no way to fit the classifier or to tokenise; the stages are tested one by one instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = stored(out)
            # The table before it is not needed again; that of the caller is left alone.
            if k:
                dropped(docs)
        docs = out
    return docs
