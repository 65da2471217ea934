"""One query opN_<name> for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.llm.ann import nearest_neighbours
from perfloom.llm.collocations import collocations
from perfloom.llm.decontaminate import leaks
from perfloom.llm.hard_negatives import hard_negatives
from perfloom.llm.html_text import extract
from perfloom.llm.line_dedup import dedup_lines
from perfloom.llm.matching import pack_whole
from perfloom.llm.near_dup import near_duplicates
from perfloom.llm.oracles import COLLOCATIONS, HARD_NEGATIVES, LINE_DEDUP, NEAR_DUPLICATES, PERSONAL_DATA, SUFFIX_DEDUP
from perfloom.llm.packing import pack
from perfloom.llm.pii import KINDS, find_personal_data, written
from perfloom.llm.quality import fold, score, train
from perfloom.llm.suffix_dedup import remove_repeats
from perfloom.llm.tables import read
from perfloom.llm.token_count import LIMIT, count_tokens


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(written(KINDS), 256).alias("base_sha256"), written((*KINDS, "term")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").where(fold() != 1))
    out = score(docs, model).withColumn("held_out", fold() == 1)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), with_ids=False)


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    # A component that no long holds is beyond what the operator takes.
    scaled = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1e9)), F.lit(1e9)) * 256))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings").where(finite).select(F.col("vec_id").alias("id"), label.alias("label"), scaled.alias("v")), "id % 100 = 0")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole(read(spark, sf_dir, "documents"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_duplicates, op2_personal_data, op3_line_dedup, op4_decontamination, op5_quality, op6_suffix_dedup, op7_main_text, op8_packing, op9_token_count, op10_nearest_neighbours, op11_hard_negatives, op12_collocations, op13_best_fit_packing)}
#: The others read tokenizers, fit models or search by words and terms; tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_near_duplicates": NEAR_DUPLICATES, "op2_personal_data": PERSONAL_DATA, "op3_line_dedup": LINE_DEDUP, "op6_suffix_dedup": SUFFIX_DEDUP, "op11_hard_negatives": HARD_NEGATIVES, "op12_collocations": COLLOCATIONS}
