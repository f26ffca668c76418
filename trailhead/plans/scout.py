"""From a request and a tree of files to a context pack, and the evaluation of many requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead import ship
from trailhead.functions import text as T
from trailhead.operators import cards as cards_
from trailhead.operators import context, evaluate, expand, graph, judge, pack, rank
from trailhead.operators.tables import cut
from trailhead.sources import requests as rq
from trailhead.sources import tree

NEIGHBORS_IN_PROMPT = 8


def ranked_files(files: DataFrame, request: rq.Request, config: rq.Config | None = None, adapter=None) -> tuple[DataFrame, bool]:
    """(ranked cards, whether judgements took part) for a request over files (path, content).

    `files` is read by the regular expressions once, for its imports; edges are small beside it
    and are checkpointed, since every round of the expansion uses them.
    """
    config = config or rq.Config()
    run = config.runtime
    nbrs = cut(graph.neighbors(graph.import_edges(files)))
    found = expand.expand(request.seed_files, files.select("path"), nbrs, request.depth, request.limit("max_seed_neighbors"), run.max_candidates)
    found = cut(found)
    cards = cards_.build_cards(found, files, nbrs, request.profile, request.focus_symbols, request.focus_checks)
    if adapter is None and run.enable_model_rerank and config.provider.base_url:
        p = config.provider
        adapter = judge.HttpAdapter(p.base_url, p.model, p.api_key, run.request_timeout_sec, judge.load_system_prompt(p.system_prompt_path))
    use = run.enable_model_rerank and adapter is not None and getattr(adapter, "available", lambda: True)()
    if not use:
        return rank.rank_cards(cards), False
    cards = cut(cards)
    results = cut(judge.judge(prompts(rank.rank_cards(cards), request, config), adapter, max_concurrency=run.max_concurrency))
    return rank.rank_cards(judge.write_back(cards, results)), not results.where("error is null").isEmpty()


def prompts(ranked: DataFrame, request: rq.Request, config: rq.Config) -> DataFrame:
    """(idx, path, prompt) of the best cards, as many as the budget has jobs; filtered before any Python runs."""
    ship(ranked.sparkSession)
    jobs = request.limit("max_llm_jobs")
    few = rank.top_n(ranked, jobs) if jobs else ranked
    own = F.array(*[F.lit(s) for s in request.seed_files]) if request.seed_files else F.array().cast("array<string>")
    first = F.filter("neighbors", lambda n: F.array_contains(own, n))
    rest = F.filter("neighbors", lambda n: ~F.array_contains(own, n))
    near = F.slice(F.concat(first, rest), 1, NEIGHBORS_IN_PROMPT)
    make = lambda ctx: T.prompt(
        request.task, F.col("path"), F.col("lang"), F.col("module"), F.col("symbols"), near, F.col("heuristic_tags"), ctx, request.seed_files, request.focus_symbols
    )
    hints = T.static_hints(
        F.col("discovered_by"), F.col("heuristic_tags"), F.col("structural"), discovery=F.col("discovery"), module=F.col("module_weight"),
        heuristic=F.col("heuristic"), profile=F.col("profile"),
    )
    reserved = T.tokens(make(F.lit(""))) + T.tokens(F.lit(judge.SYSTEM)) + T.tokens(F.lit("## Context\n"))
    budget = F.greatest(F.lit(config.runtime.max_input_tokens) - reserved, F.lit(0))
    told = context.context_column(F.col("content"), F.col("lang"), F.col("symbols"), hints, budget, request.focus_symbols)
    return few.withColumn("__ctx", told).select((F.col("rank") - 1).alias("idx"), "path", make(F.col("__ctx")).alias("prompt"))


def run(spark: SparkSession, request: rq.Request, config: rq.Config | None = None, files: DataFrame | None = None, adapter=None) -> DataFrame:
    """The context pack of one request, as one row. `files` replaces the scan of request.repo_root."""
    request.validate()
    config = config or rq.Config()
    config.validate()
    files = tree.scan(spark, request.repo_root) if files is None else files
    ranked, enhanced = ranked_files(files, request, config, adapter)
    most = request.limit("max_output_files") or config.runtime.max_output_files
    return pack.build_pack(ranked, request.task, pack.PackConfig(max_total=most), enhanced)


def evaluate_goldens(spark: SparkSession, root: str, runner: Callable | None = None, sample: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, metrics per sample) of golden samples. A sample that fails is counted; none at all raises.

    The metrics of all samples are one join and one aggregation; only the runs are one by one.
    """
    goldens = rq.read_goldens(spark, root, sample)
    rows = goldens.select("sample_id", F.to_json("request").alias("request")).collect()
    if not rows:
        raise ValueError(f"no samples in {root}")
    order, errors = [], []
    for r in rows:
        try:
            request = rq.Request.parse(r.request)
            got = runner(request) if runner else run(spark, request).first().reading_order
            order += [(r.sample_id, i, p) for i, p in enumerate(got, 1)]
        except Exception as e:
            errors.append((r.sample_id, f"{type(e).__name__}: {e}"))
    ranked = spark.createDataFrame(order, "sample_id string, pos int, path string")
    bad = spark.createDataFrame(errors, "sample_id string, error string")
    expected = rq.expected_files(goldens).join(bad, "sample_id", "left_anti")
    metrics = evaluate.sample_metrics(ranked, expected, bad)
    return evaluate.summarize(metrics), metrics
