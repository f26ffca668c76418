"""Packing: thresholds to buckets, limits, reading order, risk hints, the context pack."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailhead.functions import rules as R

BUCKETS = ["main_chain", "companion", "uncertain"]
# The texts of risk hints.
COVERAGE = "No test files found in the candidate set. Consider verifying the changes have adequate test coverage."
COMPLEX = "File has many symbols, may require careful review."
CONFIGURED = "Configuration files detected in candidate set. Verify changes don't break existing configurations."


@dataclass(frozen=True)
class PackConfig:
    main: float = 0.5
    companion: float = 0.3
    uncertain: float = 0.1
    max_main: int = 10
    max_companion: int = 20
    max_uncertain: int = 10
    max_total: int = 50


def bucket_of(score: Column, c: PackConfig = PackConfig()) -> Column:
    """Null for a score that is too low."""
    return F.when(score >= c.main, BUCKETS[0]).when(score >= c.companion, BUCKETS[1]).when(score >= c.uncertain, BUCKETS[2])


def pack_files(ranked: DataFrame, c: PackConfig = PackConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, path, bucket, pos, reading_pos): each bucket's best, within its limit and the total one.

    Positions are windows per group of `by`; the first filter drops what no bucket takes.
    """
    bucket = bucket_of(F.col("final"), c)
    out = ranked.withColumn("bucket", bucket).where("bucket is not null")
    at = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    out = out.withColumn("__b", at)
    w = Window.partitionBy(*by, "bucket").orderBy("rank")
    out = out.withColumn("pos", F.row_number().over(w).cast("long"))
    caps = dict(zip(BUCKETS, (c.max_main, c.max_companion, c.max_uncertain)))
    for b, most in caps.items():
        if most > 0:
            out = out.where((F.col("bucket") != b) | (F.col("pos") <= most))
    if c.max_total > 0:
        total = F.row_number().over(Window.partitionBy(*by).orderBy("__b", "rank"))
        out = out.withColumn("__t", total).where(F.col("__t") <= c.max_total).drop("__t")
    order = Window.partitionBy(*by).orderBy("__b", F.desc("is_seed"), "rank")
    return out.withColumn("reading_pos", F.row_number().over(order).cast("long")).select(*by, "path", "bucket", "pos", "reading_pos")


HINT = "struct<level:string,category:string,message:string,affected_files:array<string>>"


def risk_hints(ranked: DataFrame, c: PackConfig = PackConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, hints): coverage, then complexity by rank, then configuration; from all ranked cards."""
    test = R.pack_test(F.col("path"), F.col("heuristic_tags"))
    none = F.array().cast("array<string>")
    hint = lambda level, category, text, paths: F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(text).alias("message"), paths.alias("affected_files"))
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "path")))), lambda x: x["path"])
    agg = ranked.groupBy(*by).agg(
        F.count_if(~test & (F.col("final") >= c.companion)).alias("plain"), F.coalesce(F.bool_or(test), F.lit(False)).alias("tests"),
        ordered(F.size("symbols") > 20).alias("complex"), ordered(R.config_tag(F.col("heuristic_tags"))).alias("configured"),
    )
    cover = F.when((F.col("plain") > 3) & ~F.col("tests"), F.array(hint("warning", "test-coverage", COVERAGE, none)))
    each = F.transform("complex", lambda p: hint("info", "complexity", COMPLEX, F.array(p)))
    conf = F.when(F.size("configured") > 0, F.array(hint("info", "configuration", CONFIGURED, F.col("configured"))))
    empty = F.array().cast(f"array<{HINT}>")
    return agg.select(*by, F.concat(F.coalesce(cover, empty), each, F.coalesce(conf, empty)).alias("risk_hints"))


def build_pack(ranked: DataFrame, task: str, c: PackConfig = PackConfig(), model_enhanced: bool = False, repo_family: str | None = None) -> DataFrame:
    """The context pack of one request as one row."""
    files = pack_files(ranked, c)
    pick = lambda b, key: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct(key, "path")))), lambda x: x["path"])
    order = F.transform(F.array_sort(F.collect_list(F.struct("reading_pos", "path"))), lambda x: x["path"])
    lists = files.agg(pick("main_chain", "pos").alias("main_chain"), pick("companion", "pos").alias("companion_files"), pick("uncertain", "pos").alias("uncertain_nodes"), order.alias("reading_order"))
    out = lists.crossJoin(risk_hints(ranked, c))
    size = lambda x: F.size(x)
    stats = F.struct(
        (size("main_chain") + size("companion_files") + size("uncertain_nodes")).alias("total_files"), size("main_chain").alias("main_chain_count"),
        size("companion_files").alias("companion_count"), size("uncertain_nodes").alias("uncertain_count"), F.lit(model_enhanced).alias("model_enhanced"),
    )
    out = out.select(F.lit(task).alias("task"), F.lit(repo_family).cast("string").alias("repo_family"), "*", stats.alias("stats"))
    return out.withColumn("summary_markdown", summary(F.col("task"), F.col("reading_order"), F.col("risk_hints")))


def summary(task: Column, order: Column, hints: Column) -> Column:
    first = F.array_join(F.transform(F.slice(order, 1, 5), lambda p: F.concat(F.lit("- `"), p, F.lit("`\n"))), "")
    told = F.array_join(F.transform(hints, lambda h: F.concat(F.lit("- "), h["message"], F.lit("\n"))), "")
    reads = F.when(F.size(order) > 0, F.concat(F.lit("## Recommended First Reads\n\n"), first, F.lit("\n"))).otherwise("")
    risks = F.when(F.size(hints) > 0, F.concat(F.lit("## Risk Hints\n\n"), told)).otherwise("")
    return F.concat(F.lit("# Trailhead Summary\n\n## Task\n\n"), task, F.lit("\n\n"), reads, risks)
