"""A virtual repository over the documents table, so that every operator runs on a large set of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEMS = ["settings_page", "settings_handler", "pref_service", "user_config", "auth", "auth_test", "feature_flags", "BUILD", "bridge", "strings"]
EXTS = [".go", ".py", ".ts", ".cc", ".h", ".java", ".rs", ".json", ".md", ".yaml"]
#: A file's header by extension; {t} is the name of the file ten documents before, {d} the document.
HEADERS = {
    ".go": 'package app\n\nimport "example.org/app/{t}"\n\nfunc Run{d}() {{\n}}\n\ntype Page{d} struct {{\n}}\n',
    ".py": "from .{t} import run\n\n\nclass Page{d}:\n    def run{d}(self):\n        pass\n\n    def _hidden{d}(self):\n        pass\n",
    ".ts": "import {{ run }} from './{t}';\n\nexport class Page{d} {{\n}}\n\nexport function run{d}() {{\n}}\n",
    ".cc": '#include "{t}.h"\n\nclass Page{d} {{\n}};\n\nvoid Run{d}() {{\n}}\n',
    ".h": '#include "{t}.h"\n\nstruct Page{d} {{\n}};\n\n#define RUN{d} 1\n',
    ".java": "import app.{t};\n\npublic class Page{d} {{\n    public void run{d}() {{\n    }}\n}}\n",
    ".rs": "use crate::{t};\n\npub struct Page{d} {{\n}}\n\npub fn run{d}() {{\n}}\n",
}


def _sql(header: str) -> str:
    """The header as a SQL concatenation over doc_id and `target`, in Spark's and DuckDB's dialect."""
    out = []
    for i, part in enumerate(header.replace("{{", "{").replace("}}", "}").replace("{t}", "\0target\0").replace("{d}", "\0doc\0").split("\0")):
        if i % 2:
            out.append("target" if part == "target" else "CAST(doc_id AS VARCHAR(20))")
        elif part:
            out += ["chr(10)" if x is None else "'" + x.replace("'", "''") + "'" for x in _cut(part)]
    return " || ".join(out)


def _cut(text: str) -> list[str | None]:
    rows: list[str | None] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            rows.append(None)
        if line:
            rows.append(line)
    return rows


def files_sql(with_text: bool = True) -> str:
    """(doc_id, path, content), the same query for Spark and DuckDB."""
    pick = lambda values, n: "CASE " + " ".join(f"WHEN {n} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    head = "CASE ext " + " ".join(f"WHEN '{e}' THEN {_sql(h)}" for e, h in HEADERS.items()) + " ELSE '' END"
    text = " || coalesce(text, '')" if with_text else ""
    return f"""
    SELECT doc_id, coalesce(source, 'x') || '/' || coalesce(lang, 'x') || '/' || stem || '_' || CAST(doc_id AS VARCHAR(20)) || ext AS path, ({head}){text} AS content
    FROM (SELECT *, stem || '_' || CAST(greatest(doc_id - 10, 0) AS VARCHAR(20)) AS target FROM (
      SELECT doc_id, source, lang, text, {pick(STEMS, "doc_id % 10")} AS stem, {pick(EXTS, "CAST(floor(doc_id / 10) AS BIGINT) % 10")} AS ext FROM documents) AS v) AS w"""


def files(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(_for_spark(with_text), docs=docs)


def _for_spark(with_text: bool) -> str:
    return files_sql(with_text).replace("{", "{{").replace("}", "}}").replace("FROM documents)", "FROM {docs})")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of many requests: line items, a request for each supplier."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.col("l_suppkey").alias("request_id"),
        F.concat_ws("/", F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")), F.concat(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(".go"))).alias("path"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_linenumber") == 1).alias("is_seed"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")).alias("module"),
        F.when(F.col("l_linenumber") == 1, F.array(F.lit("seed"))).otherwise(F.array(F.lit("same_dir"))).alias("discovered_by"),
        F.when(F.col("l_linenumber") == 7, F.array(F.lit("default_config"))).otherwise(F.array().cast("array<string>")).alias("heuristic_tags"),
        F.array_repeat(F.lit("s"), F.col("l_quantity").cast("int")).alias("symbols"),
        (F.col("l_discount") * 10).cast("double").alias("discovery"), (F.col("l_tax") * 10).cast("double").alias("heuristic"), F.lit(0.0).alias("profile"),
        F.when(F.col("l_returnflag") == "R", "companion").when(F.col("l_returnflag") == "A", "irrelevant").alias("llm_label"),
        (F.col("l_quantity") / 50).cast("double").alias("llm_conf"),
    )


CARDS_SQL = """
SELECT l_suppkey AS request_id, 'm' || CAST(l_partkey % 7 AS VARCHAR) || '/' || concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) || '.go' AS path,
       l_orderkey * 10 + l_linenumber AS ord, l_linenumber = 1 AS is_seed, 'm' || CAST(l_partkey % 7 AS VARCHAR) AS module, l_linenumber = 7 AS configured,
       CAST(l_quantity AS INTEGER) AS n_symbols, CAST(l_discount * 10 AS DOUBLE) AS discovery, CAST(l_tax * 10 AS DOUBLE) AS heuristic,
       CASE l_returnflag WHEN 'R' THEN 'companion' WHEN 'A' THEN 'irrelevant' END AS llm_label, CAST(l_quantity AS DOUBLE) / 50 AS llm_conf
FROM lineitem"""
RANKED_SQL = f"""
c AS ({CARDS_SQL}), s AS (SELECT DISTINCT request_id, module FROM c WHERE is_seed),
r0 AS (SELECT c.*, CASE WHEN s.module IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS module_weight FROM c LEFT JOIN s USING (request_id, module)),
r1 AS (SELECT *, discovery * 0.35::DOUBLE + module_weight * 0.15::DOUBLE + heuristic * 0.2::DOUBLE + 0::DOUBLE * 0.1::DOUBLE AS structural,
       CASE llm_label WHEN 'companion' THEN 0.7::DOUBLE * llm_conf ELSE 0::DOUBLE END AS llm_score FROM r0),
r2 AS (SELECT *, least(CASE WHEN llm_label IS NOT NULL AND llm_conf > 0 THEN structural * (1 - 0.65::DOUBLE) + llm_score * 0.65::DOUBLE ELSE structural END, 1::DOUBLE) AS final FROM r1),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final DESC, ord, path) AS rank FROM r2)"""
