"""Ranking: module proximity to the seeds, weighted scores, optional judgements, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailhead.functions import paths as P

# Weights of the parts of a structural score, of a judgement, and of its labels.
WEIGHTS = {"discovery": 0.35, "module_weight": 0.15, "heuristic": 0.20, "profile": 0.10}
LLM_WEIGHT = 0.65
LABELS = {"main_chain": 1.0, "companion": 0.7, "uncertain": 0.4, "irrelevant": 0.0}


def is_sub_module(child: Column, parent: Column) -> Column:
    return (parent == "") | (child == parent) | ((child != "") & F.startswith(child, F.concat(parent, F.lit("/"))))


def module_weight(module: Column, seeds: Column) -> Column:
    """Nearness to an array of seed modules: equal 1, below 0.8, above 0.6, a common beginning 0.4."""
    one = lambda s: (
        F.when(module == s, F.lit(1.0)).when(is_sub_module(module, s), F.lit(0.8)).when(is_sub_module(s, module), F.lit(0.6))
        .when(P.shared_depth(module, s) > 0, F.lit(0.4)).otherwise(F.lit(0.0))
    )
    return F.coalesce(F.array_max(F.transform(seeds, one)), F.lit(0.0))


def structural_score() -> Column:
    """Added from left to right, as doubles."""
    parts = [F.col(c) * F.lit(w) for c, w in WEIGHTS.items()]
    return parts[0] + parts[1] + parts[2] + parts[3]


def llm_score(label: Column, confidence: Column) -> Column:
    return F.when(confidence > 0, F.coalesce(P.lookup(LABELS, label), F.lit(0.0)) * confidence).otherwise(F.lit(0.0))


def judged(label: Column, confidence: Column) -> Column:
    return F.coalesce((confidence > 0) & label.isin(list(LABELS)), F.lit(False))


def rank_cards(cards: DataFrame, by: tuple[str, ...] = (), max_score: float = 1.0) -> DataFrame:
    """`cards` with module_weight, structural, contributions, final and rank (from 1; ties by ord, then path).

    Seed modules are a small set per group of `by`, gathered by a window that the ranks' window shares
    its exchange with, so the cards are read and moved once. With no group there is one request, whose
    candidates are capped before.
    """
    for c, kind in (("llm_label", "string"), ("llm_conf", "double")):
        if c not in cards.columns:
            cards = cards.withColumn(c, F.lit(None).cast(kind))
    seed = F.when(F.array_contains("discovered_by", "seed") & (F.col("module") != ""), F.col("module"))
    out = cards.withColumn("__seeds", F.array_sort(F.collect_set(seed).over(Window.partitionBy(*by))))
    out = out.withColumn("module_weight", module_weight(F.col("module"), F.coalesce("__seeds", F.array().cast("array<string>"))))
    score = llm_score(F.col("llm_label"), F.col("llm_conf"))
    out = out.withColumns({"structural": structural_score(), "llm_score": score})
    blend = F.col("structural") * F.lit(1 - LLM_WEIGHT) + F.col("llm_score") * F.lit(LLM_WEIGHT)
    final = F.when(judged(F.col("llm_label"), F.col("llm_conf")), blend).otherwise(F.col("structural"))
    out = out.withColumn("final", F.least(final, F.lit(max_score)))
    order = Window.partitionBy(*by).orderBy(F.desc("final"), F.asc("ord"), F.asc("path"))
    return out.withColumn("rank", F.row_number().over(order).cast("long")).drop("__seeds")


def breakdown(ranked: DataFrame) -> DataFrame:
    """Inputs, contributions and result of each path's score."""
    parts = [(F.col(c) * F.lit(w)).alias(f"{c}_contribution") for c, w in WEIGHTS.items()]
    given = F.when(judged(F.col("llm_label"), F.col("llm_conf")), F.col("llm_score") * F.lit(LLM_WEIGHT)).otherwise(F.lit(0.0))
    return ranked.select("path", *WEIGHTS, "llm_score", "structural", *parts, given.alias("llm_contribution"), "final", "rank")


def top_n(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= max(n, 0))


def above(ranked: DataFrame, threshold: float) -> DataFrame:
    return ranked.where(F.col("final") >= threshold)
