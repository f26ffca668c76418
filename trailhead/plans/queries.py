"""Registered queries of the engine's own operators, with SQL for each that SQL can say."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.functions import extract as X
from trailhead.functions import paths as P
from trailhead.functions import rules as R
from trailhead.functions import text as T
from trailhead.operators import cards as cards_
from trailhead.operators import evaluate, expand, graph, judge, pack, rank
from trailhead.plans import scout, vrepo
from trailhead.sources import requests as rq

FILES = f"WITH f AS ({vrepo.files_sql()})"
PATHS = f"WITH f AS ({vrepo.files_sql(False)})"
EXT = "regexp_extract(path, '(\\.[^./]*)$', 1)"
BASE = "regexp_extract(path, '([^/]*)$', 1)"
STEM = f"regexp_replace({BASE}, '\\.[^./]*$', '')"
DIR = "regexp_replace(path, '/?[^/]*$', '')"
LANG = (
    f"CASE {EXT} WHEN '.go' THEN 'go' WHEN '.py' THEN 'py' WHEN '.ts' THEN 'ts' WHEN '.cc' THEN 'cpp' WHEN '.h' THEN 'c' WHEN '.java' THEN 'java' "
    "WHEN '.rs' THEN 'rust' WHEN '.json' THEN 'json' WHEN '.md' THEN 'markdown' WHEN '.yaml' THEN 'yaml' ELSE 'text' END"
)
COMPANION = f"regexp_replace(lower({STEM}), '(_tests?|\\.tests?|_specs?|\\.specs?|[_.]mock|[_.]fixture)$', '')"
ANY = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"
#: Seeds of the expansion queries.
SEEDS = 5


def paths_of(spark: SparkSession, sf: str) -> DataFrame:
    return vrepo.files(spark, sf, False).select("path")


def lang_detect(spark, sf):
    p = F.col("path")
    return paths_of(spark, sf).select("path", P.language(p).alias("lang"), P.is_source(p).alias("is_source"), P.is_config(p).alias("is_config"), P.is_generated(p).alias("is_generated"))


LANG_DETECT = f"""{PATHS} SELECT path, {LANG} AS lang, {LANG} IN ('go', 'py', 'ts', 'cpp', 'c', 'java', 'rust') AS is_source, {LANG} IN ('json', 'yaml') AS is_config,
  {ANY(f"lower({BASE})", P.GENERATED_NAMES)} OR {ANY(f"lower({DIR})", P.GENERATED_DIRS)} AS is_generated FROM f"""


def module_detect(spark, sf):
    m = P.module(F.col("path"))
    return paths_of(spark, sf).select("path", m.alias("module"), P.module_depth(m).cast("long").alias("depth"), P.parent_module(m).alias("parent"), P.module(F.col("path"), 1, ("src0",)).alias("short"))


MODULE_DETECT = f"""{PATHS} SELECT path, {DIR} AS module, 2::BIGINT AS depth, split_part(path, '/', 1) AS parent,
  CASE WHEN split_part(path, '/', 1) = 'src0' THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS short FROM f"""


def module_group(spark, sf):
    one = paths_of(spark, sf).select("path", P.module(F.col("path")).alias("module"))
    return one.groupBy("module").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


MODULE_GROUP = f"{PATHS} SELECT {DIR} AS module, count(*) AS n, min(path) AS first_path FROM f GROUP BY 1"


def common_module(spark, sf):
    """The deepest module that all paths of a source share: of the least and the greatest module, the components in common."""
    one = paths_of(spark, sf).select(P.module(F.col("path")).alias("m"), F.substring_index("path", "/", 1).alias("source"))
    ends = one.groupBy("source").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    depth = P.shared_depth(F.col("a"), F.col("b"))
    return ends.select("source", F.array_join(F.slice(F.split("a", "/"), F.lit(1), depth), "/").alias("common"))


COMMON_MODULE = f"{PATHS} SELECT split_part(path, '/', 1) AS source, CASE WHEN count(DISTINCT {DIR}) = 1 THEN min({DIR}) ELSE split_part(path, '/', 1) END AS common FROM f GROUP BY split_part(path, '/', 1)"


def companion_stem(spark, sf):
    return paths_of(spark, sf).select("path", P.stem(F.col("path")).alias("stem"), P.companion_stem(F.regexp_replace(P.stem(F.col("path")), r"_\d+$", "")).alias("companion"))


COMPANION_STEM = f"""{PATHS} SELECT path, {STEM} AS stem,
  regexp_replace(lower(regexp_replace({STEM}, '_[0-9]+$', '')), '(_tests?|\\.tests?|_specs?|\\.specs?|[_.]mock|[_.]fixture)$', '') AS companion FROM f"""


def locale_code(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    seg = F.explode(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"))
    return pages.select("page_id", seg.alias("segment")).where("segment <> ''").distinct().select("page_id", "segment", P.is_locale(F.col("segment")).alias("is_locale"))


LOCALE_CODE = f"""SELECT DISTINCT page_id, segment, NOT lower(segment) IN ({", ".join(f"'{x}'" for x in P.NOT_LOCALES)}) AND
  (regexp_matches(lower(segment), '^[a-z]{{2,3}}$') OR regexp_matches(lower(segment), '^[-_]*[a-z]{{2,4}}[-_]+[a-z]{{2,4}}[-_]*$')) AS is_locale
FROM (SELECT page_id, unnest(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS segment FROM pages) WHERE segment <> ''"""


def _rules(df, result):
    r = F.col("r")
    return df.select("path", result.alias("r")).select("path", F.array_join(r["tags"], ",").alias("tags"), F.round(r["score"], 9).alias("score"), F.array_join(r["discovered_by"], ",").alias("found_by"))


def rules_basic(spark, sf):
    return _rules(paths_of(spark, sf), R.basic_rules(F.col("path")))


TESTED = ANY("lower(path)", R.TEST[:-3])
#: A component of a virtual path that names a configuration is its file name, or `pref` in it.
CONFIGURED = f"(({ANY(f'lower({STEM})', R.CONFIG)} AND NOT contains(lower({STEM}), 'test')) OR ({EXT} IN ('.json', '.yaml') AND contains(lower(path), 'config')))"
RESOURCED = "(regexp_matches(path, '/(strings|resources|i18n|locale|locales|localization|translations|messages)_') OR regexp_matches(split_part(path, '/', 2), '^[a-z]{2,3}$'))"
FLAGGED = ANY(f"lower({STEM})", R.FLAG)
CONCAT = lambda rows, k: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r[0]} THEN '{r[k]}' END" for r in rows) + "], lambda x: x IS NOT NULL), ',')"
BASIC_ROWS = [(TESTED, "test_file", "test_rule", 0.3), (CONFIGURED, "default_config", "config_rule", 0.4), (RESOURCED, "resources_or_strings", "resource_rule", 0.3), (FLAGGED, "feature_flag", "feature_flag_rule", 0.35)]
SCORED = lambda rows: "round(least(" + " + ".join(f"CASE WHEN {r[0]} THEN {r[-1]}::DOUBLE ELSE 0::DOUBLE END" for r in rows) + ", 1::DOUBLE), 9)"
RULES_BASIC = f"{PATHS} SELECT path, {CONCAT(BASIC_ROWS, 1)} AS tags, {SCORED(BASIC_ROWS)} AS score, {CONCAT(BASIC_ROWS, 2)} AS found_by FROM f"


def rules_profile(spark, sf):
    return _rules(paths_of(spark, sf), R.profile_rules(F.col("path")))


CODE = f"{EXT} IN ('.cc', '.h', '.ts', '.go', '.py', '.java')"
PROFILE_ROWS = [
    (f"regexp_matches(path, '/(settings|options|preferences|prefs)_') AND {EXT} IN ('.ts', '.cc', '.h') AND contains(lower({STEM}), 'page')", "settings_page", "browser_settings:settings_page", 0.5),
    (f"regexp_matches(path, '(settings|options|preferences|prefs|config)_(handler|controller|delegate|service|manager)') AND {CODE}", "handler", "browser_settings:handler", 0.45),
    (f"{CODE} AND {ANY(f'lower({STEM})', R.PREFS)}", "prefs_registration", "browser_settings:prefs_registration", 0.4),
    (f"{ANY('lower(path)', R.PROFILE_TEST)} AND {ANY('lower(path)', [*R.SETTINGS, 'pref_', 'config'])}", "browser_settings_test", "browser_settings:test", 0.3),
]
RULES_PROFILE = f"{PATHS} SELECT path, {CONCAT(PROFILE_ROWS, 1)} AS tags, {SCORED(PROFILE_ROWS)} AS score, {CONCAT(PROFILE_ROWS, 2)} AS found_by FROM f"


def focus_boost(spark, sf):
    df = vrepo.files(spark, sf).withColumn("symbols", X.symbol_names(F.col("content"), P.language(F.col("path"))))
    return df.select("path", R.symbol_hit(F.col("path"), F.col("symbols"), ["AUTH_", "page1"]).alias("hit"))


FOCUS_BOOST = f"{FILES} SELECT path, contains(lower(path), 'auth_') OR ({EXT} IN ('.go', '.py', '.ts', '.cc', '.h', '.java', '.rs') AND CAST(doc_id AS VARCHAR) LIKE '1%') AS hit FROM f"


def imports(spark, sf):
    return vrepo.files(spark, sf).select("path", F.array_join(X.imports(F.col("content"), P.language(F.col("path"))), "|").alias("imports"))


FOUND = lambda p: f"regexp_extract_all(content, '{p}', 1)"
IMPORT_LIST = (
    f"CASE {EXT} WHEN '.go' THEN " + FOUND('(?m)^\\s*import\\s+"([^"]+)"') + " WHEN '.py' THEN " + FOUND("(?m)^\\s*from\\s+(\\.+[\\w.]*)\\s+import")
    + " WHEN '.ts' THEN " + FOUND("from\\s+[''\"]([^''\"]+)[''\"]") + " WHEN '.java' THEN " + FOUND("(?m)^\\s*import\\s+([\\w.]+)\\s*;")
    + " WHEN '.rs' THEN " + FOUND("(?m)^\\s*use\\s+([\\w:]+)") + " WHEN '.cc' THEN " + FOUND('(?m)^\\s*#\\s*include\\s+["<]([^">]+)[">]')
    + " WHEN '.h' THEN " + FOUND('(?m)^\\s*#\\s*include\\s+["<]([^">]+)[">]') + " ELSE []::VARCHAR[] END"
)
IMPORTS = f"{FILES} SELECT path, array_to_string({IMPORT_LIST}, '|') AS imports FROM f"


def symbols(spark, sf):
    found = X.symbols(F.col("content"), P.language(F.col("path")))
    return vrepo.files(spark, sf).select("path", F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["name"])), "|").alias("symbols"))


SYMBOLS = f"""{FILES} SELECT path, CASE {EXT} WHEN '.go' THEN 'func:Run' || doc_id || '|type:Page' || doc_id WHEN '.py' THEN 'class:Page' || doc_id || '|func:run' || doc_id
  WHEN '.ts' THEN 'class:Page' || doc_id || '|func:run' || doc_id WHEN '.cc' THEN 'class:Page' || doc_id || '|func:Run' || doc_id
  WHEN '.h' THEN 'struct:Page' || doc_id || '|macro:RUN' || doc_id WHEN '.java' THEN 'class:Page' || doc_id || '|func:run' || doc_id
  WHEN '.rs' THEN 'struct:Page' || doc_id || '|func:run' || doc_id ELSE '' END AS symbols FROM f"""


def symbol_lines(spark, sf):
    df = vrepo.files(spark, sf).withColumn("lang", P.language(F.col("path")))
    each = df.select("path", X.lines(F.col("content")).alias("lines"), F.explode(X.symbol_names(F.col("content"), F.col("lang"))).alias("symbol"))
    return each.select("path", "symbol", X.symbol_line(F.col("lines"), F.col("symbol")).cast("long").alias("line"))


SYMBOL_LINES = f"""{FILES}, l AS (SELECT doc_id, path, unnest(string_split(content, chr(10))) AS x, unnest(range(len(string_split(content, chr(10))))) AS i FROM f WHERE {EXT} IN ('.go', '.py', '.ts', '.cc', '.h', '.java', '.rs')),
s AS (SELECT doc_id, unnest(CASE {EXT} WHEN '.go' THEN ['Run', 'Page'] WHEN '.cc' THEN ['Page', 'Run'] WHEN '.h' THEN ['Page', 'RUN'] ELSE ['Page', 'run'] END) || doc_id AS symbol FROM f WHERE {EXT} IN ('.go', '.py', '.ts', '.cc', '.h', '.java', '.rs'))
SELECT path, symbol, coalesce(min(i) FILTER (regexp_matches(x, '\\b(func|type|class|struct|interface|enum|trait|const|var|let|def|fn)\\b[^{{=]*\\b' || symbol || '\\b')), min(i) FILTER (regexp_matches(x, '\\b' || symbol || '\\b'))) AS line
FROM l JOIN s USING (doc_id) GROUP BY path, symbol"""


def line_source(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    each = docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.char_length("line")).cast("long").alias("longest"), F.max("pos").cast("long").alias("last_pos"))


LINE_SOURCE = """SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, max(pos) AS last_pos FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) GROUP BY doc_id"""


def dir_suffix_index(spark, sf):
    return graph.dir_index(paths_of(spark, sf)).groupBy("key").agg(F.count("*").alias("n"))


DIR_SUFFIX_INDEX = f"{PATHS} SELECT key, count(*) AS n FROM (SELECT lower({DIR}) AS key FROM f UNION ALL SELECT lower(split_part(path, '/', 2)) FROM f) GROUP BY key"


def import_edges(spark, sf):
    return graph.import_edges(vrepo.files(spark, sf)).select("src", "dst").distinct()


EDGE_ROWS = f"""e AS (SELECT a.path AS src, b.path AS dst FROM f a JOIN f b ON b.doc_id = greatest(a.doc_id - 10, 0) AND a.doc_id <> b.doc_id
  AND ((a.doc_id >= 10 AND a.doc_id % 10 = b.doc_id % 10) OR (a.doc_id < 10 AND a.doc_id = 0))
  WHERE regexp_extract(a.path, '(\\.[^.]*)$', 1) IN ('.go', '.py', '.java', '.rs') OR (regexp_extract(a.path, '(\\.[^.]*)$', 1) IN ('.ts', '.cc', '.h') AND a.doc_id % 10 <> 7))"""
IMPORT_EDGES = f"{PATHS}, {EDGE_ROWS} SELECT src, dst FROM e"


def neighbors(spark, sf):
    return graph.neighbors(graph.import_edges(vrepo.files(spark, sf))).groupBy("path").agg(F.count("*").alias("n"), F.min("neighbor").alias("first_neighbor"))


NEIGHBORS = f"{PATHS}, {EDGE_ROWS} SELECT path, count(*) AS n, min(neighbor) AS first_neighbor FROM (SELECT src AS path, dst AS neighbor FROM e UNION SELECT dst, src FROM e) GROUP BY path"


def _seeds(spark, sf):
    few = vrepo.files(spark, sf, False).where(F.col("doc_id") < SEEDS)
    return few.select("path", F.col("doc_id").alias("ord"))


def _strategy(make):
    def query(spark, sf):
        files = expand.described(paths_of(spark, sf))
        own = expand.described(_seeds(spark, sf)).join(_seeds(spark, sf), "path")
        return make(own, files, spark, sf).groupBy("path").agg(F.min("ord").alias("first_seed"))

    return query


def expand_sibling(spark, sf):
    """Over names without numbers, so that tests and headers have companions; seeds are a fifth of these."""
    plain = vrepo.files(spark, sf, False).groupBy(F.regexp_replace(F.regexp_replace("path", r"_\d+\.", "."), "^[^/]*/", "").alias("path")).agg(F.min("doc_id").alias("ord"))
    seeds = plain.where("ord % 5 = 4")
    own = expand.described(seeds).join(seeds, "path")
    return expand.by_sibling(own, expand.described(plain)).groupBy("path").agg(F.min("ord").alias("first_seed"))


EXPAND_SIBLING = f"""{PATHS}, g AS (SELECT regexp_replace(regexp_replace(path, '_[0-9]+[.]', '.'), '^[^/]*/', '') AS path, min(doc_id) AS o FROM f GROUP BY 1),
k AS (SELECT o, path, {DIR} AS dir, lower({STEM}) AS stem, {COMPANION} AS comp, lower({EXT}) AS ext FROM g)
SELECT b.path, min(a.o) AS first_seed FROM k a JOIN k b ON a.comp = b.comp AND a.path <> b.path AND a.dir = b.dir AND a.o % 5 = 4
  AND (a.stem <> b.stem OR (a.ext || '|' || b.ext) IN ('.cc|.h', '.h|.cc')) GROUP BY b.path"""
EXPANDS = {
    "expand_dir": lambda s, f, spark, sf: expand.by_dir(s, f),
    "expand_module": lambda s, f, spark, sf: expand.by_module(s, f),
    "expand_prefix": lambda s, f, spark, sf: expand.by_prefix(s, f),
    "expand_import": lambda s, f, spark, sf: expand.by_import(s, graph.neighbors(graph.import_edges(vrepo.files(spark, sf)))),
}
KEYS = f"k AS (SELECT doc_id, path, {DIR} AS dir, {STEM} AS stem, {COMPANION} AS comp, lower({EXT}) AS ext FROM f), sd AS (SELECT * FROM k WHERE doc_id < {SEEDS})"
PREFIXED = "length(f2.stem) >= greatest(3, length(s.stem) // 2) AND length(f2.stem) >= 3 AND lower(f2.stem[1:greatest(3, length(s.stem) // 2)]) = lower(s.stem[1:greatest(3, length(s.stem) // 2)])"
ON = {"expand_dir": "f2.dir = s.dir", "expand_module": "f2.dir = s.dir", "expand_prefix": PREFIXED}
EXPAND_SQL = {n: f"{PATHS}, {KEYS} SELECT f2.path, min(s.doc_id) AS first_seed FROM sd s JOIN k f2 ON {on} GROUP BY f2.path" for n, on in ON.items()}
EXPAND_SQL["expand_import"] = f"""{PATHS}, {EDGE_ROWS}, n AS (SELECT src AS path, dst AS nb FROM e UNION SELECT dst, src FROM e)
SELECT n.nb AS path, min(f.doc_id) AS first_seed FROM f JOIN n ON f.path = n.path WHERE f.doc_id < {SEEDS} GROUP BY n.nb"""


def expand_round(spark, sf):
    files = vrepo.files(spark, sf)
    return expand.expand_round(_seeds(spark, sf), files.select("path"), graph.neighbors(graph.import_edges(files)))


EXPAND_ROUND = f"""{PATHS}, {KEYS}, {EDGE_ROWS}, n AS (SELECT src AS path, dst AS nb FROM e UNION SELECT dst, src FROM e), h AS (
  SELECT path, -1 AS o, 0 AS r FROM sd UNION ALL SELECT f2.path, s.doc_id, 1 FROM sd s JOIN k f2 ON f2.dir = s.dir
  UNION ALL SELECT f2.path, s.doc_id, 3 FROM sd s JOIN k f2 ON {PREFIXED} UNION ALL SELECT n.nb, s.doc_id, 5 FROM sd s JOIN n ON s.path = n.path)
SELECT path, (['seed', 'same_dir', 'same_module', 'prefix_match', 'sibling_match', 'import'])[r + 1] AS source
FROM (SELECT path, r, row_number() OVER (PARTITION BY path ORDER BY o, r) AS q FROM h) WHERE q = 1"""


def _request(spark, sf, depth=1, budget=0):
    seeds = [r.path for r in vrepo.files(spark, sf, False).where("doc_id in (1, 4)").orderBy("doc_id").select("path").collect()]
    return rq.Request("Change the settings page", "/virtual", "browser_settings", seeds, ["auth"], [], rq.Budget(max_seed_neighbors=budget, expand_depth=depth))


def expand_bfs2(spark, sf):
    """Two rounds under a budget; the candidates' cap is the reference limit of a request."""
    files = vrepo.files(spark, sf)
    r = _request(spark, sf, 2, 60)
    out = expand.expand(r.seed_files, files.select("path"), graph.neighbors(graph.import_edges(files)), 2, 60, 0)
    return out.select("path", "ord", F.array_join("sources", ",").alias("sources"))


def discovery_score(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    names = [*cards_.DISCOVERY, "other"]
    pick = F.filter(F.array(*[F.when(F.col("page_id") % (i + 2) == 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return pages.select("page_id", pick.alias("s")).select("page_id", F.array_join("s", ",").alias("sources"), cards_.discovery_score(F.col("s")).alias("score"))


NAMES_ = [*cards_.DISCOVERY.items(), ("other", 0.0)]
DISCOVERY_SCORE = "SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN page_id % {i + 2} = 0 THEN '{n}' END" for i, (n, _) in enumerate(NAMES_)) + "], lambda x: x IS NOT NULL), ',') AS sources, greatest(" + ", ".join(f"CASE WHEN page_id % {i + 2} = 0 THEN {v}::DOUBLE ELSE 0::DOUBLE END" for i, (_, v) in enumerate(NAMES_)) + ") AS score FROM pages"


def module_weight(spark, sf):
    m = F.col("module")
    seeds = F.array(F.lit("src0/en"), F.lit("src1"))
    return paths_of(spark, sf).select("path", P.module(F.col("path")).alias("module")).select("path", rank.module_weight(m, seeds).alias("weight"))


MODULE_WEIGHT = f"""{PATHS} SELECT path, CASE WHEN {DIR} = 'src0/en' THEN 1::DOUBLE WHEN split_part(path, '/', 1) = 'src1' THEN 0.8::DOUBLE
  WHEN split_part(path, '/', 1) = 'src0' THEN 0.4::DOUBLE ELSE 0::DOUBLE END AS weight FROM f"""


def rank_cards(spark, sf):
    out = rank.rank_cards(vrepo.cards(spark, sf), ("request_id",))
    return out.select("request_id", "path", F.round("structural", 9).alias("structural"), F.round("final", 9).alias("final"), "rank")


RANK_CARDS = f"WITH {vrepo.RANKED_SQL} SELECT request_id, path, round(structural, 9) AS structural, round(final, 9) AS final, rank FROM r"


def score_breakdown(spark, sf):
    b = rank.breakdown(rank.rank_cards(vrepo.cards(spark, sf), ("request_id",)))
    return b.select("path", F.round("discovery_contribution", 9).alias("d"), F.round("module_weight_contribution", 9).alias("m"), F.round("heuristic_contribution", 9).alias("h"), F.round("llm_contribution", 9).alias("l"))


SCORE_BREAKDOWN = f"""WITH {vrepo.RANKED_SQL} SELECT path, round(discovery * 0.35::DOUBLE, 9) AS d, round(module_weight * 0.15::DOUBLE, 9) AS m, round(heuristic * 0.2::DOUBLE, 9) AS h,
  round(CASE WHEN llm_label IS NOT NULL AND llm_conf > 0 THEN llm_score * 0.65::DOUBLE ELSE 0::DOUBLE END, 9) AS l FROM r"""


def top_n(spark, sf):
    return rank.top_n(rank.rank_cards(vrepo.cards(spark, sf), ("request_id",)), 3).select("request_id", "path", "rank")


TOP_N = f"WITH {vrepo.RANKED_SQL} SELECT request_id, path, rank FROM r WHERE rank <= 3"


def threshold(spark, sf):
    return rank.above(rank.rank_cards(vrepo.cards(spark, sf), ("request_id",)), 0.3).groupBy("request_id").agg(F.count("*").alias("n"))


THRESHOLD = f"WITH {vrepo.RANKED_SQL} SELECT request_id, count(*) AS n FROM r WHERE final >= 0.3::DOUBLE GROUP BY request_id"


def pack_files(spark, sf):
    return pack.pack_files(rank.rank_cards(vrepo.cards(spark, sf), ("request_id",)), by=("request_id",))


PACK_FILES = f"""WITH {vrepo.RANKED_SQL}, b AS (SELECT *, CASE WHEN final >= 0.5::DOUBLE THEN 1 WHEN final >= 0.3::DOUBLE THEN 2 WHEN final >= 0.1::DOUBLE THEN 3 END AS b FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY request_id, b ORDER BY rank) AS pos FROM b WHERE b IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY b, rank) AS t FROM p WHERE pos <= ([10, 20, 10])[b])
SELECT request_id, path, (['main_chain', 'companion', 'uncertain'])[b] AS bucket, pos, row_number() OVER (PARTITION BY request_id ORDER BY b, is_seed DESC, rank) AS reading_pos FROM q WHERE t <= 50"""


def risk_hints(spark, sf):
    h = pack.risk_hints(rank.rank_cards(vrepo.cards(spark, sf), ("request_id",)), by=("request_id",))
    n = lambda c: F.size(F.filter("risk_hints", lambda x: x["category"] == c)).cast("long")
    files = F.filter("risk_hints", lambda x: x["category"] == "configuration")
    return h.select("request_id", n("test-coverage").alias("coverage"), n("complexity").alias("complexity"), F.array_join(F.flatten(F.transform(files, lambda x: x["affected_files"])), ",").alias("configured"))


RISK_HINTS = f"""WITH {vrepo.RANKED_SQL} SELECT request_id, CAST(count(*) FILTER (final >= 0.3::DOUBLE) > 3 AS BIGINT) AS coverage, count(*) FILTER (n_symbols > 20) AS complexity,
  coalesce(string_agg(path, ',' ORDER BY rank) FILTER (configured), '') AS configured FROM r GROUP BY request_id"""


def evaluate_lists(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = docs.select(F.col("source").alias("sample_id"), pos.alias("pos"), F.col("doc_id").cast("string").alias("path")).where("pos <= 30")
    want = docs.join(labels.where("quality = 1"), "doc_id").select(F.col("source").alias("sample_id"), F.col("doc_id").cast("string").alias("path"))
    out = evaluate.sample_metrics(ranked, want).drop("error")
    return out.select("sample_id", "hits", "misses", "extras", *[F.round(m, 9).alias(m) for m in evaluate.METRICS])


EVALUATE_LISTS = """WITH r AS (SELECT source AS sample_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents QUALIFY pos <= 30),
w AS (SELECT source AS sample_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
j AS (SELECT coalesce(r.sample_id, w.sample_id) AS sample_id, r.pos, r.doc_id AS rd, w.doc_id AS wd FROM r FULL JOIN w ON r.sample_id = w.sample_id AND r.doc_id = w.doc_id),
a AS (SELECT sample_id, count(*) FILTER (rd = wd) AS hits, count(*) FILTER (rd IS NULL) AS misses, count(*) FILTER (wd IS NULL) AS extras, count(rd) AS n, count(DISTINCT wd) AS e,
  count(*) FILTER (rd = wd AND pos <= 10) AS h10, count(*) FILTER (rd = wd AND pos <= 20) AS h20 FROM j GROUP BY sample_id)
SELECT sample_id, hits, misses, extras, round(coalesce(h10 / nullif(e, 0)::DOUBLE, 0), 9) AS recall_at_10, round(coalesce(h20 / nullif(e, 0)::DOUBLE, 0), 9) AS recall_at_20,
  round(coalesce(hits / nullif(e, 0)::DOUBLE, 0), 9) AS recall_all, round(coalesce(h10 / nullif(least(n, 10), 0)::DOUBLE, 0), 9) AS precision_at_10,
  round(coalesce(h20 / nullif(least(n, 20), 0)::DOUBLE, 0), 9) AS precision_at_20 FROM a"""


def token_estimate(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.sum(T.tokens(F.col("text"))).alias("tokens"), F.max(F.char_length(T.collapse(F.col("text")))).cast("long").alias("longest"))


TOKEN_ESTIMATE = "SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, max(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS longest FROM conversations GROUP BY conv_id"


def _reply(kind: str, prompt: str) -> str:
    n = len(prompt)
    if n % 7 == 0:
        return "no answer"
    if n % 11 == 0:
        raise ValueError("refused")
    return 'Sure: {"classification": "%s", "confidence": 0.%d, "reason": "a \\"{\\" b"} done' % ("companion" if n % 2 else "main_chain", n % 9)


def judge_map(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    prompts = bench.select(F.col("item_id").alias("idx"), F.col("item_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("prompt"))
    out = judge.judge(prompts, judge.MockAdapter(reply=_reply))
    return out.select("idx", "label", F.round("confidence", 9).alias("confidence"), F.col("error").isNotNull().alias("failed"))


JUDGE_MAP = """SELECT item_id AS idx, CASE WHEN n % 7 = 0 OR n % 11 = 0 THEN '' WHEN n % 2 = 1 THEN 'companion' ELSE 'main_chain' END AS label,
  CASE WHEN n % 7 = 0 OR n % 11 = 0 THEN 0::DOUBLE ELSE round((n % 9) / 10.0::DOUBLE, 9) END AS confidence, n % 7 <> 0 AND n % 11 = 0 AS failed
FROM (SELECT item_id, length(coalesce(text, '')) AS n FROM benchmark)"""


def prompt_text(spark, sf):
    df = vrepo.files(spark, sf).withColumn("lang", P.language(F.col("path")))
    none = F.array().cast("array<string>")
    p = T.prompt("Find it", F.col("path"), F.col("lang"), P.module(F.col("path")), X.symbol_names(F.col("content"), F.col("lang")), none, R.basic_rules(F.col("path"))["tags"], F.lit(""), ["a/b.go"], ["auth"])
    return df.select("path", F.sha2(p.cast("binary"), 256).alias("prompt_sha256"))


PROMPT_TEXT = f"""{FILES}, g AS (SELECT *, {CONCAT(BASIC_ROWS, 1)} AS tags, CASE {EXT} WHEN '.go' THEN 'Run' || doc_id || ', Page' || doc_id WHEN '.cc' THEN 'Page' || doc_id || ', Run' || doc_id
  WHEN '.h' THEN 'Page' || doc_id || ', RUN' || doc_id WHEN '.json' THEN '' WHEN '.md' THEN '' WHEN '.yaml' THEN '' ELSE 'Page' || doc_id || ', run' || doc_id END AS syms FROM f)
SELECT path, sha256('## Task' || chr(10) || 'Find it' || chr(10) || chr(10) || '## File' || chr(10) || 'Path: ' || path || chr(10) || 'Language: ' || {LANG} || chr(10) || 'Module: ' || {DIR} || chr(10)
  || CASE WHEN syms <> '' THEN 'Symbols: ' || syms || chr(10) ELSE '' END || CASE WHEN tags <> '' THEN 'Tags: ' || replace(tags, ',', ', ') || chr(10) ELSE '' END || chr(10)
  || '## Seed Files' || chr(10) || '- a/b.go' || chr(10) || chr(10) || '## Focus Symbols' || chr(10) || 'auth' || chr(10) || chr(10) || '## Question' || chr(10)
  || '{T.question("classify_file_role").replace("'", "''")}') AS prompt_sha256 FROM g"""


def scout_run(spark, sf):
    """The flagship: a request over the whole virtual repository to a context pack."""
    ranked, _ = scout.ranked_files(vrepo.files(spark, sf), _request(spark, sf))
    return pack.pack_files(ranked)


def scout_pack(spark, sf):
    """The context pack itself, with hints and statistics, as JSON."""
    ranked, _ = scout.ranked_files(vrepo.files(spark, sf), _request(spark, sf, 2))
    one = pack.build_pack(ranked, "Change the settings page")
    return one.select("task", F.to_json(F.struct("main_chain", "companion_files", "uncertain_nodes", "reading_order", "risk_hints", "stats")).alias("pack"))


def judged_run(spark, sf):
    """The same with judgements from a deterministic adapter."""
    config = rq.Config()
    config.runtime.enable_model_rerank = True
    ranked, _ = scout.ranked_files(vrepo.files(spark, sf), _request(spark, sf), config, judge.MockAdapter(reply=_role))
    return ranked.select("path", "llm_label", F.round("final", 9).alias("final"), "rank")


def _role(kind: str, prompt: str) -> str:
    return json.dumps({"classification": "main_chain" if "test" in prompt else "uncertain", "confidence": 0.8})


def path_relations(spark, sf):
    f = vrepo.files(spark, sf, False).select("doc_id", "path")
    after = f.select((F.col("doc_id") - 10).alias("doc_id"), F.col("path").alias("other"))
    a, b = F.col("path"), F.col("other")
    m, n = P.module(a), P.module(b)
    return f.join(after, "doc_id").select(
        "doc_id", P.same_module(a, b).alias("same_module"), P.is_sub_module_of(m, P.parent_module(n)).alias("below"), P.shared_depth(m, n).cast("long").alias("shared"),
        P.is_header_pair(P.ext(a), P.ext(b)).alias("header_pair"), P.is_test_pair(P.stem(a), F.concat(P.stem(a), F.lit("_test"))).alias("test_pair"),
    )


PATH_RELATIONS = f"""{PATHS}, p AS (SELECT a.doc_id, a.path AS x, b.path AS y FROM f a JOIN f b ON b.doc_id = a.doc_id + 10),
q AS (SELECT doc_id, split_part(x, '/', 1) AS s, split_part(y, '/', 1) AS t, split_part(x, '/', 2) AS l, split_part(y, '/', 2) AS k, regexp_extract(x, '(\\.[^.]*)$', 1) || '|' || regexp_extract(y, '(\\.[^.]*)$', 1) AS e,
  NOT regexp_matches(x, '(_test|_spec)[^/]*$') OR TRUE AS tp FROM p)
SELECT doc_id, s = t AND l = k AS same_module, s = t AS below, CASE WHEN s <> t THEN 0 WHEN l <> k THEN 1 ELSE 2 END::BIGINT AS shared,
  e IN ('.cc|.h', '.h|.cc') AS header_pair, tp AS test_pair FROM q"""


def pack_predicates(spark, sf):
    df = paths_of(spark, sf).select("path", R.basic_rules(F.col("path"))["tags"].alias("tags"))
    return df.select("path", R.pack_test(F.col("path"), F.col("tags")).alias("is_test"), R.config_tag(F.col("tags")).alias("is_config"))


PACK_PREDICATES = f"""{PATHS} SELECT path, {TESTED} OR regexp_matches(lower(path), '(_test\\.go|_test\\.py|[.](test|spec)\\.tsx?)$') AS is_test, {CONFIGURED} AS is_config FROM f"""


def scan_filter(spark, sf):
    return paths_of(spark, sf).where(P.kept(F.col("path"), ["de", "src3"], 3)).select("path")


SCAN_FILTER = f"{PATHS} SELECT path FROM f WHERE split_part(path, '/', 2) <> 'de' AND split_part(path, '/', 1) <> 'src3'"


def task_ids(spark, sf):
    f = vrepo.files(spark, sf, False)
    return f.select("path", P.task_id(F.lit("classify_file_role"), F.col("path"), F.col("doc_id")).alias("task_id"))


TASK_IDS = f"{PATHS} SELECT path, 'classify_file_role-' || replace(path, '/', '_') || '-' || doc_id AS task_id FROM f"


def source_descriptions(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    names = ["seed", "import", "config_rule"]
    pick = F.filter(F.array(*[F.when(F.col("page_id") % (i + 2) == 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return pages.select("page_id", T.described(pick).alias("described"), T.joined(pick, 2).alias("joined"))


SOURCE_DESCRIPTIONS = """SELECT page_id, concat_ws(', ', CASE WHEN page_id % 2 = 0 THEN 'seed file (user-provided)' END, CASE WHEN page_id % 3 = 0 THEN 'import graph (strong structural link)' END,
  CASE WHEN page_id % 4 = 0 THEN 'config_rule' END) AS described, '[' || array_to_string(list_filter([CASE WHEN page_id % 2 = 0 THEN 'seed' END, CASE WHEN page_id % 3 = 0 THEN 'import' END,
  CASE WHEN page_id % 4 = 0 THEN 'config_rule' END], lambda x: x IS NOT NULL)[1:2], ' ') || ']' AS joined FROM pages"""


def text_shapes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    each = docs.select("doc_id", F.explode(X.lines(F.col("text"))).alias("line"))
    return each.groupBy("doc_id").agg(
        F.max(T.indent(F.col("line"))).cast("long").alias("indent"), F.sum(F.char_length(T.collapse(F.col("line")))).alias("collapsed"),
        F.sum(F.char_length(T.quoted(F.col("line")))).alias("quoted"),
    )


TEXT_SHAPES = """SELECT doc_id, max(length(regexp_extract(line, '^([ \\t]*)', 1))) AS indent, CAST(sum(length(trim(regexp_replace(line, '\\s+', ' ', 'g')))) AS BIGINT) AS collapsed,
  CAST(sum(length(regexp_extract(line, '"(.*)"', 1))) AS BIGINT) AS quoted FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id"""


def eval_summary(spark, sf):
    metrics = evaluate_lists(spark, sf).withColumn("error", F.when(F.col("sample_id") == "src1", "failed"))
    out = evaluate.summarize(metrics)
    return out.select("total_samples", "success_count", "error_count", *[F.round(f"mean_{m}", 6).alias(f"mean_{m}") for m in evaluate.METRICS])


EVAL_SUMMARY = f"""SELECT count(*) AS total_samples, count(*) FILTER (sample_id <> 'src1') AS success_count, count(*) FILTER (sample_id = 'src1') AS error_count,
  {", ".join(f"round(avg({m}) FILTER (sample_id <> 'src1'), 6) AS mean_{m}" for m in evaluate.METRICS)} FROM ({EVALUATE_LISTS})"""


def hit_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    key = [F.col("source").alias("sample_id"), F.col("doc_id").cast("string").alias("path")]
    out = evaluate.hit_lists(docs.where("n_chars > 1500").select(*key), docs.join(labels.where("quality = 1"), "doc_id").select(*key))
    return out.groupBy("sample_id", "verdict").agg(F.count("*").alias("n"))


HIT_VERDICTS = """SELECT source AS sample_id, CASE WHEN long AND good THEN 'hit' WHEN long THEN 'extra' ELSE 'miss' END AS verdict, count(*) AS n
FROM (SELECT source, n_chars > 1500 AS long, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents) WHERE long OR good GROUP BY 1, 2"""


def pool_counts(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    prompts = bench.select(F.col("item_id").alias("idx"), F.col("item_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("prompt"))
    out = judge.pool_counts(judge.judge(prompts, judge.MockAdapter(reply=_reply)))
    return out.withColumn("failed_idx", F.array_join("failed_idx", ","))


POOL_COUNTS = f"""SELECT count(*) AS total, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed,
  coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (failed), '') AS failed_idx FROM ({JUDGE_MAP})"""


def positive_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kinds = list(T.POSITIVE)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 4 + 1).cast("int"))
    label = F.when(F.col("quality") == 0, "skip").when(F.col("doc_id") % 4 == 0, "companion").when(F.col("doc_id") % 4 == 1, "relevant").when(F.col("doc_id") % 4 == 2, "expand").otherwise("no")
    return labels.select("doc_id", T.is_positive(kind, label).alias("positive"), T.level_mark(F.when(F.col("toxic") == 1, "error").otherwise("info")).alias("mark"))


POSITIVE_LABELS = "SELECT doc_id, quality = 1 AND doc_id % 4 <> 3 AS positive, CASE WHEN toxic = 1 THEN '❌' ELSE 'ℹ️' END AS mark FROM labels"

#: Import forms that the virtual repository's headers lack, by doc_id; in Spark's and DuckDB's dialect.
FORMS_SQL = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'block.go' WHEN 1 THEN 'calls.ts' WHEN 2 THEN 'plain.py' WHEN 3 THEN 'mods.rs' WHEN 4 THEN 'gems.rb' WHEN 5 THEN 'pages.php' ELSE 'none.go' END AS path,
  CASE doc_id % 7 WHEN 0 THEN concat('import (', chr(10), '  "fmt"', chr(10), '  x "lib/m', CAST(doc_id AS VARCHAR(20)), '"', chr(10), ')', chr(10))
  WHEN 1 THEN concat('const a = require("./m', CAST(doc_id AS VARCHAR(20)), '");', chr(10), 'const b = import("./n', CAST(doc_id AS VARCHAR(20)), '");', chr(10))
  WHEN 2 THEN concat('import os, m', CAST(doc_id AS VARCHAR(20)), ' as z', chr(10), 'from pkg.n', CAST(doc_id AS VARCHAR(20)), ' import q', chr(10))
  WHEN 3 THEN concat('mod n', CAST(doc_id AS VARCHAR(20)), ';', chr(10), 'use a::m', CAST(doc_id AS VARCHAR(20)), ';', chr(10))
  WHEN 4 THEN concat('require_relative "n', CAST(doc_id AS VARCHAR(20)), '"', chr(10), 'require "m', CAST(doc_id AS VARCHAR(20)), '"', chr(10))
  WHEN 5 THEN concat('require_once("m', CAST(doc_id AS VARCHAR(20)), '.php");', chr(10), 'include "n', CAST(doc_id AS VARCHAR(20)), '.php";', chr(10))
  ELSE '' END AS content FROM documents"""


def import_forms(spark, sf):
    """Blocks, calls, plain lists, modules, Ruby and PHP; an empty file has no imports. Ruby is asked for by
    the extractor's own label `rb`: the label that a path gets, `ruby`, has no patterns, as fixed."""
    files = spark.sql(FORMS_SQL.replace("FROM documents", "FROM {docs}"), docs=spark.read.parquet(f"{sf}/documents.parquet"))
    lang = F.when(F.endswith("path", F.lit(".rb")), "rb").otherwise(P.language(F.col("path")))
    return files.select("doc_id", F.array_join(X.imports(F.col("content"), lang), "|").alias("imports"))


_FIRST = lambda p: f"regexp_extract(content, '{p}', 1)"
IMPORT_FORMS = f"""SELECT doc_id, CASE {EXT} WHEN '.go' THEN array_to_string(regexp_extract_all(content, '"([^"]+)"', 1), '|')
  WHEN '.ts' THEN {_FIRST('require."([^"]+)')} || '|' || {_FIRST('import."([^"]+)')} WHEN '.py' THEN {_FIRST('from ([^ ]+) import')} || '|' || {_FIRST('import ([a-z]+),')} || '|' || {_FIRST(', ([^ ]+) as')}
  WHEN '.rs' THEN {_FIRST('use ([^;]+);')} || '|' || {_FIRST('mod ([^;]+);')} WHEN '.rb' THEN {_FIRST('require "([^"]+)')} || '|' || {_FIRST('relative "([^"]+)')}
  ELSE {_FIRST('once."([^"]+)')} || '|' || {_FIRST('include "([^"]+)')} END AS imports FROM ({FORMS_SQL})"""


#: Paths with backslashes, build files and directories of several depths, in both dialects.
ODD_SQL = """SELECT doc_id, concat(coalesce(source, 'x'), CASE doc_id % 3 WHEN 0 THEN chr(92) ELSE '/' END, CASE doc_id % 5 WHEN 0 THEN 'a/b/c/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'a/' ELSE '' END,
  CASE doc_id % 4 WHEN 0 THEN 'BUILD.gn' WHEN 1 THEN concat('args', CAST(doc_id AS VARCHAR(20)), '.gni') WHEN 2 THEN 'build.gn.txt' ELSE 'Makefile' END) AS path FROM documents"""


def odd_paths(spark, sf):
    """Normalised paths, the build rule, and what a scan with an ignored directory and a depth limit keeps."""
    rows = spark.sql(ODD_SQL.replace("FROM documents", "FROM {docs}"), docs=spark.read.parquet(f"{sf}/documents.parquet"))
    p = P.normalize(F.col("path"))
    return rows.select("doc_id", p.alias("normal"), R.is_build(F.col("path")).alias("is_build"), P.kept(p, ["node_modules"], 3).alias("kept"))


ODD_PATHS = f"""SELECT doc_id, replace(path, chr(92), '/') AS normal, doc_id % 4 <> 2 AS is_build,
  length(path) - length(replace(replace(path, chr(92), '/'), '/', '')) <= 2 AND NOT contains(path, 'node_modules') AS kept FROM ({ODD_SQL})"""

#: Query name -> (function, SQL or None).
TABLE = {
    "lang_detect": (lang_detect, LANG_DETECT), "module_detect": (module_detect, MODULE_DETECT), "module_group": (module_group, MODULE_GROUP),
    "common_module": (common_module, COMMON_MODULE), "companion_stem": (companion_stem, COMPANION_STEM), "locale_code": (locale_code, LOCALE_CODE),
    "rules_basic": (rules_basic, RULES_BASIC), "rules_profile": (rules_profile, RULES_PROFILE), "focus_boost": (focus_boost, FOCUS_BOOST),
    "imports": (imports, IMPORTS), "symbols": (symbols, SYMBOLS), "symbol_lines": (symbol_lines, SYMBOL_LINES), "line_source": (line_source, LINE_SOURCE),
    "dir_suffix_index": (dir_suffix_index, DIR_SUFFIX_INDEX), "import_edges": (import_edges, IMPORT_EDGES), "neighbors": (neighbors, NEIGHBORS),
    **{n: (_strategy(f), EXPAND_SQL[n]) for n, f in EXPANDS.items()}, "expand_sibling": (expand_sibling, EXPAND_SIBLING),
    "expand_round": (expand_round, EXPAND_ROUND), "expand_bfs2": (expand_bfs2, None), "discovery_score": (discovery_score, DISCOVERY_SCORE),
    "module_weight": (module_weight, MODULE_WEIGHT), "rank_cards": (rank_cards, RANK_CARDS), "score_breakdown": (score_breakdown, SCORE_BREAKDOWN),
    "top_n": (top_n, TOP_N), "threshold": (threshold, THRESHOLD), "pack_files": (pack_files, PACK_FILES), "risk_hints": (risk_hints, RISK_HINTS),
    "evaluate_lists": (evaluate_lists, EVALUATE_LISTS), "token_estimate": (token_estimate, TOKEN_ESTIMATE), "judge_map": (judge_map, JUDGE_MAP),
    "prompt_text": (prompt_text, PROMPT_TEXT), "path_relations": (path_relations, PATH_RELATIONS),
    "pack_predicates": (pack_predicates, PACK_PREDICATES), "scan_filter": (scan_filter, SCAN_FILTER), "task_ids": (task_ids, TASK_IDS),
    "source_descriptions": (source_descriptions, SOURCE_DESCRIPTIONS), "text_shapes": (text_shapes, TEXT_SHAPES), "eval_summary": (eval_summary, EVAL_SUMMARY),
    "hit_verdicts": (hit_verdicts, HIT_VERDICTS), "pool_counts": (pool_counts, POOL_COUNTS), "positive_labels": (positive_labels, POSITIVE_LABELS),
    "import_forms": (import_forms, IMPORT_FORMS), "odd_paths": (odd_paths, ODD_PATHS),
    "scout_run": (scout_run, None), "scout_pack": (scout_pack, None), "judged_run": (judged_run, None),
}


def queries() -> dict:
    return {n: f for n, (f, _) in TABLE.items()}


def oracle_sql() -> dict:
    return {n: s for n, (_, s) in TABLE.items() if s}
