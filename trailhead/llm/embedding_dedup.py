"""Embedding near-dedup: cover trees over blocks, joined by dual traversal."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

LEAF = 64


class Node:
    """A ball: centre, covering radius, and either children in half-radius balls or its points."""

    __slots__ = ("centre", "radius", "rows", "kids", "centres", "radii")

    def __init__(self, centre: np.ndarray, radius: float, rows: np.ndarray):
        self.centre, self.radius, self.rows = centre, radius, rows
        self.kids: list[Node] = []
        self.centres = self.radii = None

    def adopt(self, kids: list[Node]) -> None:
        self.kids = kids
        self.centres = np.stack([k.centre for k in kids])
        self.radii = np.array([k.radius for k in kids])


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Chord distances of unit vectors from one, or from each of several."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ c.T)))


def cover_tree(x: np.ndarray, rows: np.ndarray, at: int, far: np.ndarray, least: float) -> Node:
    """Nested nets with halving radii over unit vectors.

    A node's points are covered by balls of half its radius around points of it; a ball is a child.
    A node is a leaf when it is small or when its radius is below `least`, where no split can prune.
    """
    node = Node(x[at], float(far.max(initial=0.0)), rows)
    if len(rows) <= LEAF or node.radius <= least:
        return node
    left, kids = rows, []
    while len(left):
        some = left[: min(len(kids), 64)] if kids else np.array([at])
        table, free = _far(x[left], x[some]), np.ones(len(left), dtype=bool)
        for k, c in enumerate(some.tolist()):  # each centre is the first point that no ball before it covers
            if kids and not free[k]:
                continue
            near = np.flatnonzero(free & (table[:, k] <= node.radius / 2))
            free[near] = False
            kids.append((c, left[near], table[near, k]))
        left = left[free]
    node.adopt([cover_tree(x, r, c, d, least) for c, r, d in kids])
    return node


def dual(x: np.ndarray, a: Node, b: Node, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that may hold links: a leaf's and those of all leaves beside it that the radii allow. The bounds of
    all pairs of two nodes' children are one matrix, of which only pairs that the covering radii allow go
    on; a node against itself gives each pair once, and a leaf against itself the same rows twice."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if not p.kids and not q.kids:
            yield p.rows, q.rows
            continue
        left = p if p.kids and (p is q or not q.kids or p.radius >= q.radius) else q
        right = q if left is p else p
        if p is q or right.kids and right.radius >= left.radius / 2:
            centres, radii, kids = right.centres, right.radii, right.kids
        else:
            centres, radii, kids = right.centre[None], np.array([right.radius]), [right]
        leaf = np.array([not k.kids for k in kids])
        step = max(1, (1 << 21) // len(kids))
        for k in range(0, len(left.kids), step):
            near = _far(left.centres[k : k + step], centres) <= left.radii[k : k + step, None] + radii + reach + 1e-9
            near = np.triu(near, k) if p is q else near
            for u, kid in enumerate(left.kids[k : k + step]):
                beside = near[u]
                if p is q and beside[k + u]:
                    stack.append((kid, kid))
                    beside[k + u] = False
                if kid.kids:
                    stack += [(kid, kids[v]) for v in np.flatnonzero(beside)]
                    continue
                stack += [(kid, kids[v]) for v in np.flatnonzero(beside & ~leaf)]
                if (beside & leaf).any():
                    yield kid.rows, np.concatenate([kids[v].rows for v in np.flatnonzero(beside & leaf)])


def _merged(root: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each reaches, where `root` holds what it reached before these links."""
    if not links:
        return root
    i, j = (np.concatenate(c) for c in zip(*links))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _prepare(dtype: str):
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, v in zip(*common.columns(batch, "__id", "__label", "__vec")):
                if v is None or None in v or not v:
                    continue
                x = np.array(v, dtype=np.float64)
                if np.isfinite(x).all() and x.any():
                    rows.append((i, label, x.astype(dtype).tobytes()))
            yield common.batch_of(schema, **dict(zip(schema.names, zip(*rows)))) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return run


def _unit(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither over- nor underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(spread, dtype: str):
    """Each vector's cell: the nearest pivot of its label and dimension, and how far it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = spread.value
        for batch in batches:
            keys, raws = common.columns(batch, "key", "vec")
            cell, far = np.zeros(len(keys), np.int32), np.full(len(keys), 2.0)
            where: dict[str, list[int]] = {}
            for i, k in enumerate(keys):
                if k in pivots:
                    where.setdefault(k, []).append(i)
            for k, at in where.items():
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_unit([raws[i] for i in at], dtype) @ pivots[k].T)))
                cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"]
            )

    return run


def _deal(spread, dtype: str, reach: float, block: int):
    """A row for each block pair that a vector can have a link in."""
    schema = pa.schema([("pair", pa.string()), ("side", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = spread.value
        for batch in batches:
            rows = []
            keys, cell, ids, ns, raws, sizes = common.columns(batch, "key", "cell", "id", "n", "vec", "size")
            for k, c, i, n, raw, size in zip(keys, cell, ids, ns, raws, sizes):
                radius, parts = cells.get(k) or (None, [-(-size // block)])  # without pivots a label is one cell
                own = (c, i % parts[c])
                if k in pivots:
                    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots[k] @ _unit([raw], dtype)[0])))
                    near = np.flatnonzero(d <= radius + reach + 1e-9)
                else:
                    near = np.array([0])
                for j in near:
                    for s in range(parts[j]):
                        lo, hi = sorted((own, (int(j), s)))
                        rows.append((f"{k}|{lo[0]}.{lo[1]}|{hi[0]}.{hi[1]}", own != lo, i, n, raw))
                if len(rows) > 4000:
                    yield common.batch_of(schema, **dict(zip(schema.names, zip(*rows))))
                    rows = []
            if rows:
                yield common.batch_of(schema, **dict(zip(schema.names, zip(*rows))))

    return run


FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])


def _join_blocks(dtype: str, cosine: float):
    reach = math.sqrt(2 - 2 * cosine)

    def run(table: pa.Table) -> pa.Table:
        sides = np.array(table.column("side").to_pylist(), dtype=bool)
        ids = np.array(table.column("id").to_pylist(), dtype=np.int64)
        n = np.array(table.column("n").to_pylist(), dtype=np.int64)
        order = np.argsort(ids, kind="stable")  # the smallest index is then the smallest id
        sides, ids, n = sides[order], ids[order], n[order]
        raw = table.column("vec").to_pylist()
        x = _unit([raw[i] for i in order], dtype)
        pair = table.column("pair")[0].as_py().rsplit("|", 2)
        alone = pair[1] == pair[2]

        def tree(rows: np.ndarray) -> Node:
            return cover_tree(x, rows, int(rows[0]), _far(x[rows], x[rows[0]]), reach / 4)

        count = np.zeros(len(ids), dtype=np.int64)
        root, links, held = np.arange(len(ids)), [], 0
        a = np.flatnonzero(~sides)
        b = a if alone else np.flatnonzero(sides)
        if len(a) and len(b):
            left = tree(a)
            right = left if alone else tree(b)
            for p, q in dual(x, left, right, reach):
                hit = x[p] @ x[q].T >= cosine
                if p is q:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                count[p] += hit @ n[q]
                if p is not q:
                    count[q] += hit.T @ n[p]
                i, j = np.nonzero(hit)
                new = root[p[i]] != root[q[j]]  # links within what is connected already say nothing
                links.append((p[i[new]], q[j[new]]))
                held += len(links[-1][0])
                if held > 1 << 16:
                    root, links, held = _merged(root, links), [], 0
        root = _merged(root, links)
        keep = np.flatnonzero(count)
        return pa.table({"id": ids[keep], "links": count[keep], "least": ids[root[keep]]}, schema=FOUND)

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.93, block: int = 4096, pivots_per_label: int = 16, max_labels: int = 1024,
) -> DataFrame:
    """(id, n_links, component_id, kept): exact threshold links among vectors of equal label.

    Equal vectors are one class with a count. A label is cut into blocks of about `block` classes, and
    each pair of blocks is one task's work: two cover trees and a dual traversal; leaf pairs that
    survive are compared in double precision. A task returns a count and a component per class, never
    its pairs. The `max_labels` largest labels get pivots first (the top level of a cover tree, from a
    bounded sample): a class goes to its nearest pivot's cell, a cell over `block` is split by id, and a
    class is sent to a pair of blocks only if the pivots' covering radii allow a link there. The other
    labels are one cell, split alike, so that they too are compared whole. Only pivots, and a radius and
    a count for each of at most pivots_per_label * max_labels cells, come to the driver.

    Edge cases: null labels, and null, empty or zero vectors or ones with null or non-finite
    components, link with nothing. Vectors of other lengths are not comparable. Rows that repeat an
    id with the same vector and label are one vector; with another, their links add up. A null id
    is returned without links; ids are cast to long, and one that cannot be raises. No rows give no
    rows. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    kind = vectors.schema[vec_col].dataType
    dtype = "<f4" if "float" in kind.simpleString() else "<f8"
    reach = math.sqrt(2 - 2 * cosine)
    named = vectors.select(
        F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("string").alias("__label"), F.col(vec_col).alias("__vec")
    )
    sound = named.where("__id is not null and __label is not null").mapInArrow(_prepare(dtype), "id long, label string, vec binary")
    sound = store_keyed(sound)
    classes = common.store(sound.groupBy("key", "vec").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")))
    members = sound.select(F.col("id").alias("member"), "key", "vec").distinct()

    large = (
        classes.groupBy("key").count().where(F.col("count") > block).orderBy(F.desc("count"), "key").limit(max_labels).collect()
    )
    pivots = {}
    for r in large:  # a sample of each large label, in hash order, thinned to a net
        got = classes.where(F.col("key") == r.key).orderBy(F.xxhash64("id")).limit(256).select("vec").collect()
        x = _unit([bytes(g.vec) for g in got], dtype)
        picked, far = [0], _far(x, x[0])
        while len(picked) < min(pivots_per_label, -(-r["count"] // block)) and far.max() > reach:
            picked.append(int(far.argmax()))
            far = np.minimum(far, _far(x, x[picked[-1]]))
        pivots[r.key] = x[picked]
    sizes = common.store(classes.groupBy("key").agg(F.count("*").alias("size")), light=True)
    classes = common.store(classes.join(sizes, "key"))
    celled = classes.mapInArrow(_assign(spark.sparkContext.broadcast(pivots), dtype), "key string, vec binary, id long, n long, size long, cell int, far double")
    cells: dict[str, tuple[np.ndarray, list[int]]] = {}
    if large:
        celled = common.store(celled)
        sizes = celled.where(F.col("key").isin(list(pivots))).groupBy("key", "cell").agg(F.count("*").alias("c"), F.max("far").alias("r")).collect()
        for k, p in pivots.items():
            radius, parts = np.full(len(p), -9.0), [1] * len(p)
            for s in sizes:
                if s.key == k:
                    radius[s.cell], parts[s.cell] = s.r, -(-s.c // block)
            cells[k] = (radius, parts)
    dealt = celled.mapInArrow(
        _deal(spark.sparkContext.broadcast((pivots, cells)), dtype, reach, block), "pair string, side boolean, id long, n long, vec binary"
    )
    found = common.store(dealt.groupBy("pair").applyInArrow(_join_blocks(dtype, cosine), "id long, links long, least long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))

    least = classes.select("key", "vec", "id", "n").join(linked, "id", "left")
    least = least.join(roots.withColumnRenamed("node", "id"), "id", "left")
    each = members.join(least, ["key", "vec"]).select(
        "member", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "id").alias("root")
    )
    each = each.groupBy(F.col("member").alias("__m")).agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    ids = vectors.select(F.col(id_col).cast("long").alias(id_col))
    out = ids.join(each, F.col(id_col) == F.col("__m"), "left")
    comp = F.coalesce("root", id_col)
    return out.select(
        id_col, F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"), (comp == F.col(id_col)).alias("kept")
    )


def store_keyed(sound: DataFrame) -> DataFrame:
    """Vectors compare only at equal label and equal length."""
    return common.store(sound.select("id", F.concat_ws(":", "label", F.octet_length("vec")).alias("key"), "vec"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(n, r) AS (
  SELECT a, b FROM link UNION SELECT reach.n, link.b FROM reach JOIN link ON reach.r = link.a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links,
       least(v.vec_id, coalesce((SELECT min(r) FROM reach WHERE reach.n = v.vec_id), v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce((SELECT min(r) FROM reach WHERE reach.n = v.vec_id), v.vec_id)) AS kept
FROM v
"""
