"""Corpus pipeline: quality, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which is what the stage
before it kept; all but the last return the columns of documents. Row order means nothing.

In every stage: an empty table gives an empty one; texts of any length are read whole; a null text
counts as empty; further columns, whatever their names, do not disturb a stage, and all but the
last hand them on. What null ids, ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.llm import common, decontaminate, line_dedup, near_join, packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled rows of sf_dir.

    Ids are not read: a row with a null id is kept or goes by its text, and repeated rows fare alike.
    Null and empty texts are scored too. A score at the threshold stays.
    """
    return quality.drop_rejected(docs, quality.fitted(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents hold stay in the one of the largest id. Texts that lose lines get a new n_chars.

    Null texts become empty. A row with a null id keeps its lines and counts for none. Rows that repeat
    an id are one document and are treated alike.
    """
    out = line_dedup.dedup_lines(docs)
    same = F.col("n_dropped") == 0
    return out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.char_length("text"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays.

    Empty and null texts are near nothing and stay, and so do rows with a null id. Rows that repeat an
    id stay or go together.
    """
    gone = near_join.near_groups(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Texts without words stay. Rows are judged by their text: with a null id or a repeated one too.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.drop_contaminated(docs, bench)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token pieces of packed sequences.

    An empty or null text is its end id alone; a null id is kept as null; repeated rows are packed each
    on its own.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_join", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: A trained classifier cannot be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), free=True)
    return STAGES[-1][1](spark, docs, sf_dir)
