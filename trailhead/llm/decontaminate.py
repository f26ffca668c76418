"""Benchmark decontamination by winnowing, in native Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only. lower() does the same for all-ASCII texts, many times faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words_of(col: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(col, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(hashes: Column, k: int) -> Column:
    """A hash for each run of k words; none if there are fewer."""
    n = F.size(hashes) - (k - 1)
    at = F.sequence(F.lit(0), n - 1)
    one = lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)])
    return F.when(n > 0, F.transform(at, one)).otherwise(F.array().cast("array<bigint>"))


def _winnow(grams: Column, w: int) -> Column:
    """The least hash of each window of w grams, once each; all of them where there are fewer."""
    n = F.size(grams) - (w - 1)
    at = F.sequence(F.lit(0), n - 1)
    least = F.transform(at, lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]))
    return F.array_distinct(F.when(n > 0, least).otherwise(grams))


def _windows(rows: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """(keep, __pos, __len, __win): each window of the lengths, as its words with a blank between."""

    def cut(n: int) -> Column:
        last = F.size("__words") - n
        win = lambda i: F.array_join(F.slice("__words", i + 1, n), " ")
        spans = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(i.alias("__pos"), F.lit(n).alias("__len"), win(i).alias("__win")),
        )
        return F.coalesce(F.when(last >= 0, spans), empty)

    empty = F.array().cast("array<struct<__pos:int,__len:int,__win:string>>")
    every = F.concat(*[cut(n) for n in lengths])
    return rows.select(*keep, F.inline(every))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
) -> DataFrame:
    """One row per distinct (id, text): n_words, n_hit, n_items, items (sorted), contaminated, __text_key.

    Winnowing: the least k-word hash in each span of window-k+1 hashes is a fingerprint, so any
    shared run of `window` words shares one. Fingerprints of texts and items are joined; texts
    with a match are cut into all their windows, which are joined as words (not hashes) to the
    items' windows: the hits extended to their exact length. Items shorter than `window` words
    are one window each; their lengths (at most window-1 numbers) add grams of just those lengths.

    No side is hinted: Spark broadcasts fingerprints of the benchmark only under its own size
    threshold and otherwise joins them by hash with skewed keys split. Texts whose fingerprints
    do not match are left out of the second pass, which reads texts again rather than keeping them.

    Edge cases: null or wordless texts have no words and no hits. Items without words or with a
    null id never match. Items that repeat count once by id. Rows with the same id and the same
    text give one row; the same id with other texts gives one row for each text. A null id is kept.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("__item"), words_of(F.col(item_text_col)).alias("__words"))
    items = store(items.where("__item is not null and size(__words) > 0"))
    short = sorted(r[0] for r in items.where(F.size("__words") < window).select(F.size("__words")).distinct().collect())
    lengths = [window, *short]

    hashed = items.select("__words", F.transform("__words", lambda x: F.xxhash64(x)).alias("__h"))
    size = F.size("__words")
    marks = [F.when(size >= window, _grams(F.col("__h"), k))]
    marks += [F.when(size == n, _grams(F.col("__h"), n)) for n in short]
    none = F.array().cast("array<bigint>")
    marked = hashed.select(F.explode(F.concat(*[F.coalesce(m, none) for m in marks])).alias("__fp")).distinct()

    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    named = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"), key.alias("__text_key"))
    worded = named.select("__doc", "__text_key", words_of(F.col("__text")).alias("__words"))
    hashes = worded.select(
        "__doc", "__text_key", F.size("__words").cast("long").alias("__n"),
        F.transform("__words", lambda x: F.xxhash64(x)).alias("__h"),
    )
    grams = hashes.select("__doc", "__text_key", "__n", "__h", _grams(F.col("__h"), k).alias("__g"))
    prints = grams.select(
        "__doc", "__text_key", "__n",
        F.concat(_winnow(F.col("__g"), window - k + 1), *[F.array_distinct(_grams(F.col("__h"), n)) for n in short]).alias("__fps"),
    )
    one = prints.select("__doc", "__text_key", "__n", F.explode_outer("__fps").alias("__fp"))
    seen = (
        one.join(marked.withColumn("__hit", F.lit(1)), "__fp", "left")
        .groupBy("__doc", "__text_key", "__n")
        .agg(F.coalesce(F.max("__hit"), F.lit(0)).alias("__hit"))
    )
    seen = store(seen)

    suspects = seen.where("__hit = 1").select("__doc", "__text_key")
    again = named.join(
        suspects.withColumnsRenamed({"__doc": "__d", "__text_key": "__k"}),
        F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__text_key") == F.col("__k")),
        "left_semi",
    ).select("__doc", "__text_key", words_of(F.col("__text")).alias("__words"))
    spans = _windows(again, lengths, ["__doc", "__text_key"])
    item_windows = items.select("__item", "__words").where(size >= window)
    whole = _windows(item_windows, [window], ["__item"]).select("__item", "__win")
    if short:
        tiny = items.where(size < window).select("__item", F.array_join("__words", " ").alias("__win"))
        whole = whole.unionByName(tiny)
    whole = store(whole.distinct())
    known = store(whole.select("__win").distinct())  # plain, so that a hot window's rows can be split
    hits = store(spans.join(known, "__win", "left_semi").distinct())
    by_doc = ["__doc", "__text_key"]
    covered = hits.groupBy(*by_doc).agg(
        F.size(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.collect_set(F.struct("__pos", "__len")),
                        lambda s: F.sequence(s["__pos"], s["__pos"] + s["__len"] - 1),
                    )
                )
            )
        ).cast("long").alias("n_hit")
    )
    found = (
        hits.select(*by_doc, "__win").distinct().join(whole, "__win").select(*by_doc, "__item").distinct()
        .groupBy(*by_doc).agg(F.array_sort(F.collect_list("__item")).alias("items"))
    )
    both = _join(covered, found, by_doc)
    out = _join(seen.drop("__hit"), both, by_doc, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("__doc").alias(id_col), "__text_key", F.col("__n").alias("n_words"),
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def _join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, null equal to null."""
    b = b.withColumnsRenamed({c: f"{c}_r" for c in on})
    cond = [a[c].eqNullSafe(b[f"{c}_r"]) for c in on]
    out = a.join(b, cond, how)
    return out.drop(*[f"{c}_r" for c in on])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text has no hit."""
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated")
    bad = bad.select(F.col(id_col).alias("__bad"), "__text_key")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")) & (key == F.col("__text_key")), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bwin AS (
  SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM bw WHERE len(w) > 0)
), dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM dw, (SELECT DISTINCT n FROM bwin))
), hit AS (
  SELECT d.doc_id, d.i, d.n, b.item FROM dwin d JOIN bwin b ON d.win = b.win AND d.n = b.n
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
