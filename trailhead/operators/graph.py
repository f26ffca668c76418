"""Import graph: every import becomes ordered probes, one equi-join resolves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.functions import extract as X
from trailhead.functions import paths as P

# What a relative import may leave out, in the order in which it is tried.
PROBE_EXT = [".ts", ".tsx", ".js", ".jsx", ".go", ".py", ".rb", ".php"]
PROBE_INDEX = ["/index.ts", "/index.tsx", "/index.js"]
PY_PROBES = [".py", ".pyx", ".pyi", "/__init__.py", "/__init__.pyi"]


def dir_keys(path: Column) -> Column:
    """Lower-case directory and each of its proper suffixes; the root is empty."""
    d = F.split(F.lower(P.dir_of(path)), "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(d)), lambda i: F.array_join(F.slice(d, i, F.size(d)), "/")))


def dir_index(files: DataFrame) -> DataFrame:
    """(key, path): a row for each of dir_keys."""
    return files.select(F.explode(dir_keys(F.col("path"))).alias("key"), "path")


def clean_join(folder: Column, rel: Column) -> Column:
    """folder/rel without `.`, and with each `..` taking off a component."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(rel, "/")), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(parts, empty, step), "/")


def _probes(*rows: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in rows])


def relative_probes(imp: Column, src: Column) -> Column:
    at = clean_join(P.dir_of(src), imp)
    near = _probes(*[("path", F.concat(at, F.lit(x))) for x in ["", *PROBE_EXT, *PROBE_INDEX]], ("base", P.stem(at)))
    return F.when(F.startswith(imp, F.lit(".")), near).otherwise(_probes(("base", P.strip_ext(P.last_segment(imp, "/")))))


def c_probes(imp: Column, src: Column) -> Column:
    return _probes(("path", clean_join(P.dir_of(src), imp)), ("base", P.stem(imp)))


def go_probes(imp: Column, src: Column) -> Column:
    """The shortest directory suffix first, then the base name."""
    parts = F.split(F.lower(imp), "/")
    n = F.size(parts)
    suffix = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.lit("dir").alias("kind"), F.array_join(F.slice(parts, n - i, i + 1), "/").alias("key")),
    )
    return F.concat(suffix, _probes(("base", P.last_segment(imp, "/"))))


def python_probes(imp: Column, src: Column) -> Column:
    dots = F.length(F.regexp_extract(imp, r"^(\.*)", 1))
    name = F.translate(F.substr(imp, dots + 1, F.length(imp)), ".", "/")
    folder = F.filter(F.split(P.dir_of(src), "/"), lambda x: x != "")
    up = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0))), "/")
    at = F.when(up == "", name).otherwise(F.concat(up, F.lit("/"), name))
    near = _probes(*[("path", F.concat(at, F.lit(x))) for x in PY_PROBES], ("base", P.last_segment(name, "/")))
    none = F.filter(near, lambda x: F.lit(False))
    return F.when(dots == 0, _probes(("base", P.last_segment(imp, ".")))).when(name == "", none).otherwise(near)


def java_probes(imp: Column, src: Column) -> Column:
    last = P.last_segment(imp, ".")
    before = F.element_at(F.concat(F.array(F.lit("")), F.split(imp, r"\.")), -2)
    return _probes(("base", F.when(last == "*", before).otherwise(last)))


def rust_probes(imp: Column, src: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(imp, "^crate::", ""), "^super::", ""), "^self::", "")
    seg = F.trim(F.substring_index(P.last_segment(clean, "::"), "{", 1))
    found = _probes(("base", seg))
    return F.when(seg == "", F.filter(found, lambda x: F.lit(False))).otherwise(found)


RESOLVERS = {
    "js jsx ts tsx rb php": relative_probes, "c cpp h hpp": c_probes, "go": go_probes, "py": python_probes, "java": java_probes, "rust": rust_probes,
}


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, imp_ord, imp, dst): the targets of the first probe of each import that finds any.

    `imports` has (src, lang, imp_ord, imp). Probes of all languages meet the distinct keys of one
    index in one equi-join, which at most keeps a probe; one aggregation takes each import's first; and
    only that one fetches its targets. So an import that an exact path resolves is never paired with all
    the files of a common name. Spark chooses broadcast or shuffle by size.
    """
    col = F.when(F.lit(False), _probes(("base", F.lit(""))))
    for langs, make in RESOLVERS.items():
        col = col.when(F.col("lang").isin(langs.split()), make(F.col("imp"), F.col("src")))
    probes = imports.select("src", "imp_ord", "imp", F.posexplode(col).alias("probe", "p"))
    probes = probes.select("src", "imp_ord", "imp", "probe", F.col("p.kind").alias("kind"), F.col("p.key").alias("key"))
    path = F.col("path")
    named = _probes(("path", P.normalize(path)), ("base", F.lower(P.stem(path))))
    keys = F.concat(named, F.transform(dir_keys(path), lambda k: F.struct(F.lit("dir").alias("kind"), k.alias("key"))))
    index = files.select(F.explode(keys).alias("k"), path.alias("dst")).select("k.kind", "k.key", "dst")
    known = probes.join(index.select("kind", "key").distinct(), ["kind", "key"])
    first = known.groupBy("src", "imp_ord", "imp").agg(F.min(F.struct("probe", "kind", "key")).alias("p"))
    first = first.select("src", "imp_ord", "imp", F.col("p.kind").alias("kind"), F.col("p.key").alias("key"))
    return first.join(index, ["kind", "key"]).select("src", "imp_ord", "imp", "dst")


def extract_imports(files: DataFrame) -> DataFrame:
    """(src, lang, imp_ord, imp) of files (path, content); an empty file has none."""
    lang = P.language(F.col("path"))
    named = files.where("content <> ''").select(F.col("path").alias("src"), lang.alias("lang"), "content")
    return named.select("src", "lang", F.posexplode(X.imports(F.col("content"), F.col("lang"))).alias("imp_ord", "imp"))


def import_edges(files: DataFrame) -> DataFrame:
    """(src, dst, imp_ord), without loops. The same target may come from several imports."""
    return resolve(extract_imports(files), files).where("src <> dst").select("src", "dst", "imp_ord")


def neighbors(edges: DataFrame) -> DataFrame:
    """(path, neighbor): both directions, distinct."""
    one = edges.select(F.col("src").alias("path"), F.col("dst").alias("neighbor"))
    return one.unionByName(edges.select(F.col("dst").alias("path"), F.col("src").alias("neighbor"))).distinct()
