"""Evaluation: ranked lists against expected files; recall and precision at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_metrics(ranked: DataFrame, expected: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per sample: hits, misses, extras, recall_at_10, recall_at_20, recall_all, precision_at_10, precision_at_20.

    ranked: (sample_id, pos from 1, path); expected: (sample_id, path); errors: (sample_id, error).
    k is at most the list's length; a path that repeats counts each time. One equi-join and one
    aggregation, however many samples there are.
    """
    want = expected.distinct().withColumn("want", F.lit(True))
    both = ranked.join(want, ["sample_id", "path"], "full")
    there, hit = F.col("pos").isNotNull(), F.col("pos").isNotNull() & F.col("want")
    at = lambda k: F.count_if(hit & (F.col("pos") <= k))
    agg = both.groupBy("sample_id").agg(
        F.count_if(hit).alias("hits"), F.count_if(~there).alias("misses"), F.count_if(there & F.col("want").isNull()).alias("extras"),
        F.count_if(there).alias("n"), F.countDistinct(F.when(F.col("want"), F.col("path"))).alias("n_expected"), at(10).alias("h10"), at(20).alias("h20"),
    )
    over = lambda a, b: F.when(b > 0, F.col(a) / b).otherwise(F.lit(0.0))
    n, want_n = F.col("n"), F.col("n_expected")
    out = agg.select(
        "sample_id", "hits", "misses", "extras", over("h10", want_n).alias("recall_at_10"), over("h20", want_n).alias("recall_at_20"),
        over("hits", want_n).alias("recall_all"), over("h10", F.least(n, F.lit(10))).alias("precision_at_10"),
        over("h20", F.least(n, F.lit(20))).alias("precision_at_20"),
    )
    if errors is None:
        return out.withColumn("error", F.lit(None).cast("string"))
    return out.join(errors, "sample_id", "full")


def hit_lists(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(sample_id, path, verdict): hit, extra or miss."""
    key = ["sample_id", "path"]
    hit = ranked.join(expected, key, "left_semi").select(*key, F.lit("hit").alias("verdict"))
    extra = ranked.join(expected, key, "left_anti").select(*key, F.lit("extra").alias("verdict"))
    miss = expected.distinct().join(ranked, key, "left_anti").select(*key, F.lit("miss").alias("verdict"))
    return hit.unionByName(extra).unionByName(miss)


METRICS = ["recall_at_10", "recall_at_20", "recall_all", "precision_at_10", "precision_at_20"]


def summarize(metrics: DataFrame) -> DataFrame:
    """One row: counts, and means over the samples without an error."""
    ok = F.col("error").isNull()
    return metrics.agg(
        F.count("*").alias("total_samples"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("error_count"),
        *[F.coalesce(F.avg(F.when(ok, F.col(m))), F.lit(0.0)).alias(f"mean_{m}") for m in METRICS],
    )
