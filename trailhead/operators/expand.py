"""Expansion from seeds: five strategies as equi-joins, first source wins, rounds under a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.functions import paths as P

from .tables import cut

# Sources in the order in which a seed tries them.
SOURCES = ["seed", "same_dir", "same_module", "prefix_match", "sibling_match", "import"]
HEADER_EXTS = sorted({h for hs in P.HEADERS.values() for h in hs})


@dataclass(frozen=True)
class ExpandConfig:
    same_dir: bool = True
    same_module: bool = True
    prefix_match: bool = True
    sibling_match: bool = True
    imports: bool = True
    prefix_min: int = 3
    module_depth: int = 2


def described(files: DataFrame, module_depth: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """The join keys of a path, beside the columns of `keep`."""
    path = F.col("path")
    return files.select(
        "path", P.dir_of(path).alias("dir"), P.module(path, module_depth).alias("module"), P.stem(path).alias("stem"),
        P.companion_stem(P.stem(path)).alias("companion"), F.lower(P.ext(path)).alias("ext"), *keep,
    )


def _key(source: str, key: Column, name: Column | None = None, kind: Column | None = None) -> Column:
    empty = F.lit("")
    parts = {"rank": F.lit(SOURCES.index(source)), "key": key, "name": empty if name is None else name, "kind": empty if kind is None else kind}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _keys(sources: list[str], prefixes: Column) -> Column:
    """(rank, key, name, kind) by which seeds and files meet; the key is null where there is none.

    Siblings are told apart by lower-case name and by extension, as far as it has to do with headers:
    a companion name has few kinds of them. It holds no slash, so that their keys are unambiguous.
    """
    named = (F.col("companion") != "") & (F.col("stem") != "")
    kind = F.when(F.col("ext").isin([*P.HEADERS, *HEADER_EXTS]), F.col("ext")).otherwise("")
    beside = lambda at: F.when(named, F.concat(F.lit(at[0]), F.col(at), F.lit("/"), F.col("companion")))
    single = [_key("same_dir", F.col("dir")), _key("same_module", F.col("module"))]
    siblings = [_key("sibling_match", beside(c), F.lower("stem"), kind) for c in ("dir", "module")]
    every = [k for s, k in zip(["same_dir", "same_module", "sibling_match", "sibling_match"], single + siblings) if s in sources]
    begun = F.transform(prefixes, lambda p: _key("prefix_match", p))
    return F.concat(F.array(*every), begun) if every and "prefix_match" in sources else F.array(*every) if every else begun


def by_keys(seeds: DataFrame, files: DataFrame, sources: list[str], least: int = 3) -> DataFrame:
    """(path, ord, rank): what seeds reach by directory, module, beginning of a name or sibling name, in one equi-join.

    What a later seed reaches by a key, the key's first seed has reached: the join gets one row for
    each distinct key, however many seeds share it, so that it grows with files and not with pairs.
    """
    least = least if least > 0 else 3
    n = F.length("stem")
    size = F.greatest(F.lit(least), F.floor(n / 2).cast("int"))
    cut_at = lambda i: F.lower(F.substr("stem", F.lit(1), i))
    lengths = []
    if "prefix_match" in sources:
        lengths = sorted(r[0] for r in seeds.where(n >= least).select(size).distinct().collect())  # at most as many as a name has letters
    own = F.when(n >= least, F.array(cut_at(size))).otherwise(F.array().cast("array<string>"))
    begun = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda i: (i <= n) & (n >= least)), cut_at)
    s = seeds.select("ord", F.explode(_keys(sources, own)).alias("k")).select("ord", "k.*").where("key is not null")
    s = s.groupBy("rank", "key", F.col("name").alias("s_name"), F.col("kind").alias("s_kind")).agg(F.min("ord").alias("ord"))
    f = files.select("path", F.explode(_keys(sources, begun)).alias("k")).select("path", "k.*").where("key is not null")
    pair = (F.col("s_name") != F.col("name")) | P.is_header_pair(F.col("s_kind"), F.col("kind"))
    return s.join(f, ["rank", "key"]).where((F.col("rank") != SOURCES.index("sibling_match")) | pair).select("path", "ord", "rank")


def by_dir(seeds: DataFrame, files: DataFrame) -> DataFrame:
    return by_keys(seeds, files, ["same_dir"]).select("path", "ord")


def by_module(seeds: DataFrame, files: DataFrame) -> DataFrame:
    return by_keys(seeds, files, ["same_module"]).select("path", "ord")


def by_prefix(seeds: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """Names that begin with the first half of a seed's name, at least `least` long: an equi-join on prefixes of the lengths that seeds have."""
    return by_keys(seeds, files, ["prefix_match"], least).select("path", "ord")


def by_sibling(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """Tests with what they test, sources with their headers, in one directory or module. Such a pair differs in name or extension, so no path is its own sibling."""
    return by_keys(seeds, files, ["sibling_match"]).select("path", "ord")


def by_import(seeds: DataFrame, nbrs: DataFrame) -> DataFrame:
    return seeds.select("ord", F.col("path").alias("__p")).join(nbrs, F.col("__p") == nbrs["path"]).select(F.col("neighbor").alias("path"), "ord")


def expand_round(seeds: DataFrame, files: DataFrame, nbrs: DataFrame | None = None, config: ExpandConfig = ExpandConfig()) -> DataFrame:
    """(path, source): what seeds (path, ord) reach, with the source that came first, by seed and then by strategy.

    One equi-join on derived keys serves all strategies but imports, which has its own; one aggregation takes the first source.
    """
    known = described(files, config.module_depth)
    own = described(seeds, config.module_depth, ("ord",))
    how = lambda df, rank: df.select("path", F.struct(F.col("ord").cast("long").alias("ord"), rank.alias("rank")).alias("how"))
    every = how(seeds.select("path", F.lit(-1).alias("ord")), F.lit(0))
    wanted = {"same_dir": config.same_dir, "same_module": config.same_module, "prefix_match": config.prefix_match, "sibling_match": config.sibling_match}
    if sources := [s for s, on in wanted.items() if on]:
        every = every.unionByName(how(by_keys(own, known, sources, config.prefix_min), F.col("rank")))
    if config.imports and nbrs is not None:
        every = every.unionByName(how(by_import(own, nbrs), F.lit(SOURCES.index("import"))))
    first = every.where("path <> ''").groupBy("path").agg(F.min("how").alias("how"))
    return first.select("path", F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.col("how.rank") + 1).alias("source"))


def expand(
    seeds: list[str], files: DataFrame, nbrs: DataFrame | None = None, depth: int = 1, max_neighbors: int = 0,
    max_candidates: int = 100, config: ExpandConfig = ExpandConfig(),
) -> DataFrame:
    """(path, ord, sources): candidates in order, seeds first as given and the rest by path.

    A round's new paths are the next round's seeds. `max_neighbors` bounds the new paths of all
    rounds, taken in path order. Seeds need not exist and repeat once. Without seeds the first 100
    paths at most are the candidates. Rounds are checkpointed; no path comes to the driver.
    """
    spark = files.sparkSession
    if not seeds:
        most = max_candidates if 0 < max_candidates <= 100 else 100
        few = files.select("path").orderBy("path").limit(most)
        return _ordered(few.withColumn("seed_ord", F.lit(None).cast("long")).withColumn("sources", F.array().cast("array<string>")), max_candidates)
    own = list(dict.fromkeys(seeds))
    seen = spark.createDataFrame([(p, i) for i, p in enumerate(own)], "path string, ord long")
    log = seen.select("path", F.lit(-1).alias("round"), F.lit("seed").alias("source"))
    frontier, first, admitted = seen, seen, 0
    seen = seen.select("path")
    for i in range(max(depth, 1)):
        found = cut(expand_round(frontier, files, nbrs, config))
        new = found.join(seen, "path", "left_anti").select("path")
        if max_neighbors > 0:
            new = new.orderBy("path").limit(max(0, max_neighbors - admitted))
        new = cut(new)
        seen = cut(seen.unionByName(new))
        log = log.unionByName(found.join(seen, "path", "left_semi").select("path", F.lit(i).alias("round"), "source"))
        if i + 1 == max(depth, 1):
            break
        admitted += new.count()
        frontier = cut(new.orderBy("path").withColumn("ord", F.monotonically_increasing_id()))  # grows with the path; only its order counts
        if frontier.isEmpty():
            break
    sources = log.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("round", "source"))).alias("s"))
    sources = sources.select("path", F.array_distinct(F.col("s.source")).alias("sources"))
    out = seen.join(sources, "path").join(first.withColumnRenamed("ord", "seed_ord"), "path", "left")
    return _ordered(out, max_candidates)


def _ordered(df: DataFrame, most: int) -> DataFrame:
    """Seeds first, then by path; the cap applies to that order. The window sees at most the cap's rows."""
    order = [F.col("seed_ord").asc_nulls_last(), F.col("path")]
    if most > 0:
        df = df.orderBy(*order).limit(most)
    from pyspark.sql.window import Window

    return df.select("path", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("ord"), F.col("seed_ord").isNotNull().alias("is_seed"), "sources")
