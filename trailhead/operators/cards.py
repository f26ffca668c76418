"""File cards: one row per candidate, with what is known about it and its scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.functions import extract as X
from trailhead.functions import paths as P
from trailhead.functions import rules as R

# The score of each way of discovery.
DISCOVERY = {"seed": 1.0, "import": 0.7, "sibling_match": 0.5, "symbol_hit": 0.3, "same_dir": 0.2, "prefix_match": 0.2, "same_module": 0.1}
SYMBOL_BOOST = 0.2
# Files of more bytes have no symbols read.
MAX_SYMBOL_BYTES = 500 * 1024


def discovery_score(sources: Column) -> Column:
    """The best source's score; 0 for none."""
    scores = F.transform(sources, lambda s: F.coalesce(P.lookup(DISCOVERY, s), F.lit(0.0)))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def build_cards(
    candidates: DataFrame, files: DataFrame, nbrs: DataFrame | None = None, profile: str = "",
    focus_symbols: list[str] | None = None, focus_checks: list[str] | None = None, max_symbols: int = 100,
) -> DataFrame:
    """Cards of candidates (path, ord, is_seed, sources), joined to their content and sorted neighbours.

    Only candidates' rows reach the regular expressions: the joins come first. The first of them keeps
    the candidates' content, so that the texts of all others are not shuffled by the outer join.
    """
    path = F.col("path")
    texts = files.select("path", "content").join(candidates.select("path"), "path", "left_semi")
    out = candidates.join(texts, "path", "left")
    if nbrs is not None:
        near = nbrs.join(candidates.select("path"), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("neighbor")).alias("neighbors"))
        out = out.join(near, "path", "left")
    else:
        out = out.withColumn("neighbors", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    profiled = R.profile_rules(path) if profile and R.matches_profile(profile) else F.lit(None).cast("struct<tags:array<string>,score:double,discovered_by:array<string>>")
    out = out.withColumns({"lang": P.language(path), "module": P.module(path), "basic": R.basic_rules(path, focus_checks), "own": profiled})
    small = F.coalesce(F.octet_length("content"), F.lit(0)) <= MAX_SYMBOL_BYTES
    found = F.when(F.col("lang").isin(P.SOURCE) & small, X.symbol_names(F.coalesce("content", F.lit("")), F.col("lang"), max_symbols)).otherwise(none)
    out = out.withColumns({"symbols": found, "neighbors": F.coalesce("neighbors", none)})
    hit = R.symbol_hit(path, F.col("symbols"), focus_symbols or [])
    out = out.withColumn("hit", F.coalesce(hit, F.lit(False)))
    by = F.concat(
        F.when(F.col("is_seed"), F.array(F.lit("seed"))).otherwise(none), F.coalesce("sources", none), F.col("basic.discovered_by"),
        F.coalesce("own.discovered_by", none), F.when(F.col("hit"), F.array(F.lit("symbol_hit"))).otherwise(none),
    )
    heuristic = F.col("basic.score")
    heuristic = F.when(F.col("hit"), F.least(heuristic + F.lit(SYMBOL_BOOST), F.lit(1.0))).otherwise(heuristic)
    out = out.withColumns({
        "discovered_by": F.array_distinct(by),
        "heuristic_tags": F.array_distinct(F.concat("basic.tags", F.coalesce("own.tags", none))),
        "heuristic": heuristic,
        "profile": F.coalesce("own.score", F.lit(0.0)),
        "seed_weight": F.when(F.col("is_seed"), 1.0).otherwise(0.0),
    })
    return out.select(
        "path", "ord", "is_seed", "lang", "module", "symbols", "neighbors", "discovered_by", "heuristic_tags", "seed_weight",
        discovery_score(F.col("discovered_by")).alias("discovery"), "heuristic", "profile", "content",
    )
