"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The white space that a key loses at both ends, and only that.
BLANKS = b" \t\n\x0b\x0c\r"
INTERNAL = ("__doc", "__text", "__drop", "__key")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None for a key of fewer code points than `min_chars`.

    bytes.lower() lower-cases A-Z and nothing else, as a key wants.
    """
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and sum(b & 0xC0 != 0x80 for b in key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    schema = pa.schema([("__doc", pa.int64()), ("__key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = [], []
            for doc, text in zip(*common.columns(batch, "__doc", "__text")):
                found = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                docs += [doc] * len(found)
                keys += found
            yield common.batch_of(schema, __doc=docs, __key=keys)

    return run


def _reassemble(text_col: str, min_chars: int, fields: list[str]):
    """Batches with their drop lists, to the new texts. A text without a drop list is handed on as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = common.columns(batch, "__text", "__drop")
            new, n_lines, n_dropped = [], [], []
            for text, drop in zip(texts, drops):
                total = text.count(b"\n") + 1
                if drop:
                    gone = set(drop)
                    kept = [x for x in text.split(b"\n") if len(x) < min_chars or line_key(x, min_chars) not in gone]
                    text = b"\n".join(kept)
                    n_dropped.append(total - len(kept))
                else:
                    n_dropped.append(0)
                new.append(text)
                n_lines.append(total)
            own = {text_col: pa.array(new, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            at = {n: i for i, n in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(at[n]) for n in fields], names=fields)

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Drop each line whose key is in `min_docs` documents or more, but in the largest id holding it.

    Returns all columns of `docs` with the new text, n_lines (before) and n_dropped; columns of
    those names are replaced, and columns named __doc, __text, __drop or __key are not returned. A
    text without a dropped line is unchanged; null becomes empty.

    Only (id, 128-bit key) pairs, one per document and key, are shuffled to be counted: Spark
    counts them distinct by (key, id) first, so a line in a third of all documents is spread
    over tasks. Pairs and frequent keys are written to the shared folder, so that their join
    reads two plain tables and adaptive execution can split a hot key. Texts move once, to meet
    their own drop list, and lines keep their order within the text.

    Edge cases: null text is one empty line. Rows that repeat an id count as one document and
    each gets the same treatment. A null id counts for nothing and keeps all its lines. Ids are cast
    to long, and one that cannot be raises. Texts of any length are split whole. No rows give no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    key = F.col(id_col).cast("long")
    named = docs.select(key.alias("__doc"), common.as_bytes(F.col(text_col)).alias("__text"))
    pairs = common.store(named.where("__doc is not null").mapInArrow(_keys(min_chars), "__doc long, __key binary"))
    frequent = common.store(
        pairs.groupBy("__key")
        .agg(F.countDistinct("__doc").alias("__n"), F.max("__doc").alias("__last"))
        .where(F.col("__n") >= min_docs)
        .drop("__n")
    )
    drops = (
        pairs.join(frequent, "__key")
        .where("__doc < __last")
        .groupBy("__doc")
        .agg(F.collect_set("__key").alias("__drop"))
    )
    rest = docs.drop(text_col, "n_lines", "n_dropped", *INTERNAL)
    rest = docs.select(key.alias("__doc"), common.as_bytes(F.col(text_col)).alias("__text"), *[F.col(f"`{c}`") for c in rest.columns])
    out = rest.join(drops, "__doc", "left")
    kinds = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped", *INTERNAL)]
    shape = docs.select(*kinds, F.lit("").alias(text_col), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped", *INTERNAL)] + ["n_lines", "n_dropped"]
    shape = shape.select(*[F.col(f"`{c}`") for c in order])
    fields = [T.StructField(f.name, f.dataType, True) for f in shape.schema]
    return out.mapInArrow(_reassemble(text_col, min_chars, order), T.StructType(fields))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.last_doc AS gone FROM lines l LEFT JOIN frequent f USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
