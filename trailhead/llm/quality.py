"""Quality classifier: attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .lang_id import features

PASSAGE = 512  # characters
BITS = 10
ORDERS = (1, 2, 3)
#: Hashed counts, and how much a passage repeats itself.
WIDTH = (1 << BITS) + 1


def passages(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner of each passage, hashed n-gram counts of each passage), a bounded number of characters at a time.

    A passage is a run of PASSAGE characters; the whole text is covered. Empty texts have one
    empty passage. A long text comes in several parts with the same owner.
    """
    group: list[tuple[int, np.ndarray]] = []
    size = 0
    width = 1 << BITS

    def emit() -> tuple[np.ndarray, np.ndarray]:
        counts = [max(1, -(-len(c) // PASSAGE)) for _, c in group]
        owner = np.repeat([i for i, _ in group], counts)
        first = np.concatenate([[0], np.cumsum(counts)])
        dense = np.zeros(len(owner) * width, dtype=np.float32)
        for n in ORDERS:
            cells = []
            for (_, codes), at in zip(group, first):
                f = features(codes, n, BITS)
                if len(f):
                    cells.append((np.arange(len(f)) // PASSAGE + at) * width + f)
            if cells:
                dense += np.bincount(np.concatenate(cells), minlength=len(dense)).astype(np.float32)
        x = np.log1p(dense.reshape(len(owner), width))
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x /= norm + 10  # a few characters are little evidence
        total = dense.reshape(x.shape).sum(axis=1)
        alike = np.sqrt(np.square(dense.reshape(x.shape)).sum(axis=1)) / np.maximum(total, 1)
        return owner, np.column_stack([x, 8 * alike * total / (total + 300)]).astype(np.float32)

    step = PASSAGE * 256
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for at in range(0, max(1, len(codes)), step):
            group.append((i, codes[at : at + step]))
            size += len(group[-1][1]) + 64
            if size >= most:
                yield emit()
                group, size = [], 0
    if group:
        yield emit()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Mil:
    """h = tanh(xW + b); attention e = (tanh(hV) * sigmoid(hU)) w; z = sum softmax(e) h; score = sigmoid(zc + d)."""

    hidden: int = 32
    gate: int = 16
    seed: int = 7
    par: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, width: int) -> None:
        r = np.random.default_rng(self.seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        h, k = self.hidden, self.gate
        self.par = {"W": 3 * g(width, h), "b": np.zeros(h, np.float32), "V": g(h, k), "U": g(h, k), "w": g(k), "c": g(h), "d": np.zeros(1, np.float32)}

    def instance(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(encoding, attention logit) of each passage."""
        p = self.par
        h = np.tanh(x @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, share: float | None = None, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> None:
        """Adam on the log loss, label 1 weighing `share` in all (None: as in the bags). Deterministic for the same bags in order."""
        self.start(bags[0].shape[1])
        p, r = self.par, np.random.default_rng(self.seed)
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        own = y.mean()
        share = own if share is None else share
        weight = np.where(y == 1, share / max(own, 1e-3), (1 - share) / max(1 - own, 1e-3)).astype(np.float32)
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x = np.concatenate([bags[i] for i in pick]).astype(np.float32)
                n = np.array([len(bags[i]) for i in pick])
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                own = np.repeat(np.arange(len(pick)), n)
                h = np.tanh(x @ p["W"] + p["b"])
                a, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
                e = (a * s) @ p["w"]
                e = np.exp(e - np.maximum.reduceat(e, first)[own])
                att = e / np.add.reduceat(e, first)[own]
                z = np.add.reduceat(att[:, None] * h, first)
                q = _sigmoid(z @ p["c"] + p["d"])
                dq = (q - y[pick]) * weight[pick] / len(pick)
                dz = dq[:, None] * p["c"]
                dh = att[:, None] * dz[own]
                datt = (h * dz[own]).sum(axis=1)
                de = att * (datt - np.add.reduceat(att * datt, first)[own])
                da, ds = de[:, None] * p["w"] * s * (1 - a * a), de[:, None] * p["w"] * a * s * (1 - s)
                dh += da @ p["V"].T + ds @ p["U"].T
                dx = dh * (1 - h * h)
                grad = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ da, "U": h.T @ ds, "w": (a * s).T @ de, "c": z.T @ dq, "d": dq.sum(keepdims=True)}
                t += 1
                for k, g in grad.items():
                    g = g + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text; softmax sums are carried over the parts of a long text."""
        top = np.full(len(texts), -np.inf)
        mass = np.zeros(len(texts))
        z = np.zeros((len(texts), self.hidden))
        for owner, x in passages(texts):
            h, e = self.instance(x)
            new = top.copy()
            np.maximum.at(new, owner, e)
            scale = np.where(np.isfinite(top), np.exp(np.where(np.isfinite(top), top, 0) - np.where(np.isfinite(new), new, 0)), 0)
            mass, z, top = mass * scale, z * scale[:, None], new
            w = np.exp(e - top[owner])
            np.add.at(mass, owner, w)
            np.add.at(z, owner, w[:, None] * h)
        return _sigmoid(z / np.maximum(mass, 1e-30)[:, None] @ self.par["c"] + self.par["d"]) if len(texts) else mass


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("label", pa.int32()), ("part", pa.int32()), ("bag", pa.binary())])
    for batch in batches:
        docs, labels, texts = common.columns(batch, "__doc", "__label", "__text")
        for owner, x in passages(texts):
            parts = [(docs[i], labels[i], k, x[owner == i].astype("<f2").tobytes()) for k, i in enumerate(np.unique(owner))]
            yield common.batch_of(schema, **dict(zip(schema.names, zip(*parts))))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_per_class: int = 1500, max_chars: int = 20_000, **fit,
) -> Mil | float:
    """Learn from at most `max_per_class` documents of each label, the first in the order of a hash of the id.

    The sample is taken from the labels alone: at most 2 * max_per_class ids, which are broadcast to
    the texts, so no text is shuffled. Documents of over `max_chars` characters are not learned from
    (they are scored), so what comes to the driver is bounded: bags of max_chars / 512 encoded
    passages of 2 KB each, 240 MB at most. With one label only, its value is the model; with none, 0.5.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    sizes = {r[0]: r[1] for r in marked.groupBy("__label").count().collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    picked = [marked.where(F.col("__label") == k).orderBy(F.xxhash64("__id", F.lit(11)), "__id").limit(max_per_class) for k in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    named = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).where(F.coalesce(F.char_length("__text"), F.lit(0)) <= max_chars)
    both = named.join(picked, F.col("__doc") == F.col("__id")).select("__doc", "__label", "__text")
    rows = both.mapInArrow(_encode, "doc long, label int, part int, bag binary").collect()
    if len({r.label for r in rows}) < 2:
        return float(rows[0].label) if rows else 0.5
    bags: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r.doc, r.part)):
        bags.setdefault((r.doc, r.label), []).append(np.frombuffer(r.bag, "<f2").reshape(-1, WIDTH))
    del rows
    model = Mil()
    model.fit([b[0] if len(b) == 1 else np.concatenate(b) for b in bags.values()], np.array([k[1] for k in bags]), **{"share": sizes[1] / sum(sizes.values())} | fit)
    return model


def _score(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            texts = batch.column(at).to_pylist()
            score = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score, pa.float64())], names=[*names, "score"])

    return run


def score_quality(docs: DataFrame, model: Mil | float, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and score; a column of that name is replaced. The model (about 140 KB) is broadcast;
    every passage of every text is read.

    Edge cases: null and empty texts have one empty passage and so a score. Repeated rows score
    alike. `keep` may hold the text column itself. No rows give no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    named = docs.select(*[c for c in keep if c not in ("score", "__text")], F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name != "__text")
    return named.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"{fields}, score double")


THRESHOLD = 0.7


def drop_rejected(docs: DataFrame, model: Mil | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score `threshold` or more. Only texts go to Python."""
    spark = docs.sparkSession
    common.small_batches(spark)
    spread = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = spread.value
        return pd.Series(np.full(len(texts), m) if isinstance(m, float) else m.score(texts.tolist()))

    return docs.where(score(F.col(text_col)) >= threshold)


def fitted(spark: SparkSession, sf_dir: str) -> Mil | float:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return train(docs, labels.where(~common.held_out(F.col("doc_id"))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = score_quality(named, fitted(spark, sf_dir), keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
