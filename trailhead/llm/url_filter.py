"""URL filters: dated list entries become validity intervals; an as-of join evaluates each capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys_of(host: Column) -> Column:
    """The host and each of its parent domains, as list entries name them; none for no host."""
    labels = F.split(host, r"\.", -1)
    every = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.when(host != "", F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, starts, ends): when each entry is active, as sorted arrays, from dated additions and removals.

    An event holds from its time to the entry's next one; of events at one time a removal counts.
    """
    clean = entries.where("list is not null and key is not null and at is not null and action is not null")
    one = clean.groupBy("list", F.lower("key").alias("key"), "at").agg(F.max(F.col("action") == "remove").alias("off"))
    w = Window.partitionBy("list", "key").orderBy("at")
    spans = one.withColumn("until", F.lead("at").over(w)).where(~F.col("off"))
    return (
        spans.groupBy("list", "key")
        .agg(F.array_sort(F.collect_list(F.struct("at", "until"))).alias("__spans"))
        .select("list", "key", F.col("__spans.at").alias("starts"), F.col("__spans.until").alias("ends"))
    )


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", allow: str = "allow") -> DataFrame:
    """All columns of `captures` with host, lists (active at the time, sorted, comma-joined) and blocked.

    A capture is joined once to each (list, key) of its host and parent domains, and looks its time
    up in that entry's sorted starts: the last start at or before it, if its end is later. Rows
    never multiply by an entry's history. The join is an equality on the key, so Spark broadcasts
    the entries if they are small and splits a hot host if not. An active entry of the list
    named by `allow` overrides the others.

    Edge cases: a null or malformed URL has an empty host and no lists; a null time has none
    active. Repeated captures are each kept. Columns named like the results are replaced.
    """
    keep = captures.columns
    uid = "__uid"
    host = host_of(F.col(url_col))
    base = captures.withColumn(uid, F.struct(*[F.col(c) for c in [url_col, time_col]]))
    named = base.select(host.alias("__host"), F.col(url_col).alias("__url"), F.col(time_col).alias("__at")).distinct()
    spans = intervals(entries)
    keyed = named.select("__host", "__url", "__at", F.explode(keys_of(F.col("__host"))).alias("key"))
    last = F.array_max(F.filter(F.sequence(F.lit(1), F.size("starts")), lambda i: F.get("starts", i - 1) <= F.col("__at")))
    end = F.get("ends", last - 1)
    active = last.isNotNull() & (end.isNull() | (end > F.col("__at")))
    hits = keyed.join(spans, "key").where(active)
    found = hits.groupBy("__url", "__at").agg(F.array_sort(F.collect_set("list")).alias("__lists"))
    out = base.join(found, F.col(f"{uid}.{url_col}").eqNullSafe(F.col("__url")) & F.col(f"{uid}.{time_col}").eqNullSafe(F.col("__at")), "left")
    lists = F.coalesce("__lists", F.array().cast("array<string>"))
    new = {"host": host, "lists": F.array_join(lists, ","), "blocked": (F.size(lists) > 0) & ~F.array_contains(lists, allow)}
    return out.select(*[c for c in keep if c not in new], *[v.alias(k) for k, v in new.items()])


def dated_lists(pages: DataFrame) -> DataFrame:
    """The query's lists, made by a rule from the hosts: (list, key, action, at).

    A third of the hosts is put on `spam` on a day of 2024, taken off 60 days later and put back
    after another 60; a fifth is put on `adult` once; a seventh is allowed for 90 days; the shared
    parent domain is on `parked` for ten days.
    """
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key <> ''").distinct()
    c = hosts.withColumn("c", F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 7), 16, 10).cast("long"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    rows = []
    for name, mod, action, offset in [
        ("spam", 3, "add", 0), ("spam", 3, "remove", 60), ("spam", 3, "add", 120),
        ("adult", 5, "add", 30), ("allow", 7, "add", 10), ("allow", 7, "remove", 100),
    ]:
        rows.append(c.where(F.col("c") % mod == 0).select(
            F.lit(name).alias("list"), "key", F.lit(action).alias("action"), day(F.col("c") % 200 + offset).alias("at")
        ))
    parent = pages.sparkSession.sql(
        "SELECT 'parked' AS list, 'example.com' AS key, IF(id = 0, 'add', 'remove') AS action, "
        "date_add(DATE'2024-05-01', CAST(id * 10 AS INT)) AS at FROM range(2)"
    )
    out = rows[0]
    for r in [*rows[1:], parent]:
        out = out.unionByName(r)
    return out


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    out = filter_urls(pages.withColumn("fetched", fetched), dated_lists(pages))
    return out.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "lists", "blocked")


SQL = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched FROM pages
), h AS (
  SELECT host AS key, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS c FROM (SELECT DISTINCT host FROM p WHERE host <> '')
), ev AS (
  SELECT list, key, action, DATE '2024-01-01' + CAST(c % 200 + off AS INTEGER) AS dt
  FROM h, (VALUES ('spam', 3, 'add', 0), ('spam', 3, 'remove', 60), ('spam', 3, 'add', 120),
                  ('adult', 5, 'add', 30), ('allow', 7, 'add', 10), ('allow', 7, 'remove', 100)) r(list, m, action, off)
  WHERE c % m = 0
  UNION ALL SELECT 'parked', 'example.com', 'add', DATE '2024-05-01'
  UNION ALL SELECT 'parked', 'example.com', 'remove', DATE '2024-05-11'
), iv AS (
  SELECT list, key, action, dt, lead(dt) OVER (PARTITION BY list, key ORDER BY dt) AS until FROM ev
), k AS (
  SELECT page_id, fetched, array_to_string(parts[i + 1 :], '.') AS key
  FROM (SELECT page_id, fetched, string_split(host, '.') AS parts, unnest(range(len(string_split(host, '.')))) AS i FROM p WHERE host <> '')
), act AS (
  SELECT k.page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, bool_or(list = 'allow') AS allowed
  FROM k JOIN iv ON k.key = iv.key AND iv.action = 'add' AND iv.dt <= k.fetched AND (iv.until IS NULL OR iv.until > k.fetched)
  GROUP BY k.page_id
)
SELECT p.page_id, p.host, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(lists, '') AS lists,
       lists IS NOT NULL AND NOT allowed AS blocked
FROM p LEFT JOIN act USING (page_id)
"""
