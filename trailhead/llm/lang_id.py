"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PLAIN = re.compile("[A-Za-z]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """If a character of Unicode category L occurs; numerals such as a half or a Roman one are none."""
    return PLAIN.search(text) is not None or any(map(str.isalpha, text))


def features(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of each run of n code points."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.full(m, 0x9E37 + n, dtype=np.uint32)
    for j in range(n):
        h = (h ^ codes[j : j + m]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def chunks(texts: list[str], orders: tuple[int, ...], bits: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse rows of a batch, a bounded number of characters at a time.

    Yields (document index, first position of each row, buckets). Texts are lower-cased and
    joined with blanks at both ends; a text longer than `most` is read in parts that overlap, so
    each n-gram counts once.
    """
    widest = max(orders)
    group: list[tuple[int, np.ndarray]] = []
    size = 0

    def emit() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for n in orders:
            owner, first, found, at = [], [], [], 0
            for i, codes in group:
                f = features(codes, n, bits)[:most]  # those that start later are in the next part
                if len(f):
                    owner.append(i)
                    first.append(at)
                    found.append(f)
                    at += len(f)
            if found:
                yield np.array(owner), np.array(first), np.concatenate(found)

    for i, text in enumerate(texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for at in range(0, len(codes), most):
            group.append((i, codes[at : at + most + widest - 1]))
            size += len(group[-1][1])
            if size >= most:
                yield from emit()
                group, size = [], 0
    if group:
        yield from emit()


def _count(langs: list[str], orders: tuple[int, ...], bits: int):
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: i for i, x in enumerate(langs)}
        total = np.zeros((len(langs), 1 << bits), dtype=np.int64)
        for batch in batches:
            texts, lang = common.columns(batch, "__text", "__lang")
            code = np.array([at[x] for x in lang])
            for owner, first, found in chunks(texts, orders, bits):
                who = np.repeat(code[owner], np.diff(np.append(first, len(found))))
                for k in np.unique(who):
                    total[k] += np.bincount(found[who == k], minlength=1 << bits)
        lang, bucket = np.nonzero(total)
        n = total[lang, bucket]
        for i in range(0, len(n), 50_000):
            yield common.batch_of(schema, lang=lang[i : i + 50_000], bucket=bucket[i : i + 50_000], n=n[i : i + 50_000])

    return run


class Model:
    """Languages and a matrix (bucket, language) of log probabilities, with log priors."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray, orders: tuple[int, ...], bits: int):
        self.langs, self.table, self.prior, self.orders, self.bits = langs, table, prior, orders, bits

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its posterior) for each text; ties go to the first language."""
        total = np.tile(self.prior, (len(texts), 1))
        for owner, first, found in chunks(texts, self.orders, self.bits):
            for k in range(len(self.langs)):
                np.add.at(total[:, k], owner, np.add.reduceat(self.table[k][found], first))
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        return best, 1.0 / np.exp(total - top[:, None]).sum(axis=1)


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    max_rows_per_lang: int = 5000, max_langs: int = 256, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, alpha: float = 0.5,
) -> Model:
    """Fit on at most about `max_rows_per_lang` rows of each language, chosen by a hash of the id.

    Tasks count their rows into one dense matrix and give its nonzero cells; Spark sums them, and
    2^bits * languages sums at most come to the driver. More than `max_langs` languages raise, because
    a task holds a matrix of them all (64 MB at the default).
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1 << bits)), np.zeros(0), orders, bits)
    share = F.element_at(
        F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, max_rows_per_lang / sizes[x]))]), F.col(lang_col)
    )
    dice = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 20)) / (1 << 20)
    picked = known.where(dice < share).select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    rows = (
        picked.mapInArrow(_count(langs, orders, bits), "lang int, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    table = np.full((len(langs), 1 << bits), alpha)
    table[rows.lang.to_numpy(), rows.bucket.to_numpy()] += rows.n.to_numpy()
    log = np.log(table / table.sum(axis=1, keepdims=True))
    count = np.array([sizes[x] for x in langs], dtype=float)
    return Model(langs, log, np.log(count / count.sum()), orders, bits)


def _predict(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = spread.value
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            texts = batch.column(at).to_pylist()
            sure = [i for i, t in enumerate(texts) if t is not None and model.langs and has_letter(t)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if sure:
                best, p = model.score([texts[i] for i in sure])
                for i, b in zip(sure, best):
                    lang[i] = model.langs[b]
                score[sure] = np.clip(p, 0, 1)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with lang_pred and score (the posterior of that language); columns of these names are replaced.

    The log-probability matrix is broadcast: its size is 2^bits * languages floats. Scoring is
    row-wise sums of matrix cells over a batch's n-grams.

    Edge cases: null text, or text without a letter, or a model without languages: `und`, 0.
    Long texts are read in parts. Rows that repeat are scored alike. Ids are not read. No rows give
    no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    named = docs.select(*[c for c in keep if c not in ("lang_pred", "score", "__text")], F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name != "__text")
    return named.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"{fields}, lang_pred string, score double")


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~common.held_out(F.col("doc_id"))))
    named = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(named, model, keep=("doc_id", "held_out"))
