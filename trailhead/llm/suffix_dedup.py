"""Suffix-array dedup: every repeated byte string of a fixed length, found without a global sort.

Each window of LENGTH bytes is named by an anchor, the GRAM-byte string of least hash in it, so equal
windows have equal anchors at equal places, and neighbouring windows share one: a run. Runs are dealt
to buckets by their anchor. Runs that are equal throughout collapse by hash to their first; of the
rest, where an anchor has several different runs, the suffixes are sorted, one bucket at a time:
by their first PERIOD bytes and then, where these tie, by the precomputed rank of a suffix in a
difference cover of the period, at most PERIOD bytes on. Only a block of suffixes is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 24
PERIOD = 32
#: Bytes of text whose anchors a task holds before it sends them on; and suffixes that are sorted at once.
CHUNK, BLOCK = 1 << 19, 1 << 17
FLUSH = 12 << 20
_POS = np.uint64((1 << 24) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def difference_cover(v: int) -> list[int]:
    """Residues such that every difference modulo v is one of two of them; greedy, smallest first."""
    cover, left = [0], set(range(1, v))
    new = lambda c: {(c - d) % v for d in cover} | {(d - c) % v for d in cover}
    while left:
        best = max(range(v), key=lambda c: (len(new(c) & left), -c))
        left -= new(best)
        cover.append(best)
    return sorted(cover)


def words_at(buf: np.ndarray) -> np.ndarray:
    """The big-endian 64-bit word at each byte: comparing words compares bytes. `buf` ends in 8 spare bytes."""
    return np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))


def anchors(text: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document index, first window, last window, anchor) of each run, and the anchors' hashes.

    `text` is some documents one after the other, then 8 spare bytes; `bounds` their ends.
    """
    n = len(text) - 8
    w = np.ndarray(shape=(n,), dtype="<u8", buffer=text, strides=(1,))
    m = n - GRAM + 1
    h = w[:m] * np.uint64(0x9E3779B97F4A7C15)
    h += w[8 : m + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h += w[16 : m + 16] * np.uint64(0x165667B19E3779F9)
    h = common.mix64(h)
    least = (h & ~_POS) | np.arange(m, dtype=np.uint64)
    wide, span = length - GRAM + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    ends = bounds
    begins = np.concatenate([[0], bounds[:-1]])
    counts = np.maximum(0, ends - begins - length + 1)
    doc = np.repeat(np.arange(len(bounds)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    where = (least[at] & _POS).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], at[first], at[last], where[first], h[where[first]]


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a set of intervals; those that touch are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


RUN = ["<u8", "<u8", "<i8", "<i8", "u1", "u1"]  # anchor, content, document, first window, anchor's place, windows


def _sorted(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs by (anchor, content, document, first window), and which are not the first of their content."""
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    key, body, doc, lo = cols[:4]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (body[1:] != body[:-1])
    first = np.flatnonzero(new)
    own = first[np.cumsum(new) - 1] if len(first) else first
    return cols, ~new & ((doc != doc[own]) | (lo != lo[own]))


def _by_doc(doc: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(doc, kind="stable")
    doc, cols = doc[order], [c[order] for c in cols]
    edge = np.flatnonzero(np.diff(doc)) + 1 if len(doc) else []
    if len(doc):
        for i, j in zip(np.concatenate([[0], edge]).astype(int), np.concatenate([edge, [len(doc)]]).astype(int)):
            yield int(doc[i]), [c[i:j] for c in cols]


FOUND = pa.schema([("doc", pa.int64()), ("kind", pa.int32()), ("block", pa.binary())])


def _found(kind: int, doc: np.ndarray, *cols: np.ndarray) -> pa.Table:
    """A row per document: 0: intervals to remove; 1: runs to be compared by their bytes."""
    docs, blocks = [], []
    for d, own in _by_doc(doc, *cols):
        docs.append(d)
        blocks.append(common.pack(*(merge(*own) if kind == 0 else own)))
    arrays = [pa.array(docs, pa.int64()), pa.array(np.full(len(docs), kind), pa.int32()), pa.array(blocks, pa.binary())]
    return pa.Table.from_arrays(arrays, schema=FOUND)


def _runs(buckets: int, length: int):
    """Texts to blocks of runs per bucket; repeats within the task are settled here and sent as intervals."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("gone", pa.binary())])

    def scan(texts: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        joined = b"".join(t for _, _, t in texts)
        buf = np.frombuffer(joined + bytes(8), dtype=np.uint8)
        ends = np.cumsum([len(t) for _, _, t in texts])
        begins = np.concatenate([[0], ends[:-1]])
        doc, lo, hi, at, key = anchors(buf, ends, length)
        digest = xxhash.xxh3_64_intdigest
        place, n = at - lo, hi - lo + 1
        body = np.fromiter((digest(joined[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
        body ^= common.mix64((place * 256 + n).astype(np.uint64))
        ids = np.array([i for i, _, _ in texts], dtype=np.int64)
        base = np.array([b for _, b, _ in texts], dtype=np.int64)
        return [key, body, ids[doc], lo - begins[doc] + base[doc], place.astype(np.uint8), n.astype(np.uint8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[int, int, bytes]] = []
        size = held_size = 0
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            cols, again = _sorted([np.concatenate(c) for c in zip(*held)])
            doc, lo, n = cols[2][again], cols[3][again], cols[5][again].astype(np.int64)
            gone: list[tuple[int, np.ndarray, np.ndarray]] = [(d, *merge(*own)) for d, own in _by_doc(doc, lo, lo + n - 1 + length)]
            cols = [c[~again] for c in cols]
            # an anchor is the least hash of many, so its own bits are uneven: buckets take them mixed again
            bucket = ((common.mix64(cols[0] ^ _SPREAD) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, cols = bucket[order], [c[order] for c in cols]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            share = -(-len(gone) // max(1, len(edge) - 1))
            for k, (x, y) in enumerate(zip(edge, edge[1:])):
                mine = gone[k * share : (k + 1) * share]
                told = [np.repeat([d for d, _, _ in mine], [len(s) for _, s, _ in mine]).astype("<i8")]
                told += [np.concatenate([g[c] for g in mine]).astype("<i8") if mine else np.empty(0, "<i8") for c in (1, 2)]
                block = common.pack(*[c[x:y].astype(t) for c, t in zip(cols, RUN)])
                yield common.batch_of(schema, bucket=[bucket[x]], block=[block], gone=[common.pack(*told)])

        for batch in batches:
            for doc, text in zip(*common.columns(batch, "__doc", "__text")):
                for at in range(0, len(text) - length + 1, CHUNK):  # windows that start in a part; it overlaps the next
                    part = text[at : at + CHUNK + length - 1]
                    if size + len(part) > CHUNK and texts:
                        held.append(scan(texts))
                        texts, size = [], 0
                    texts.append((doc, at, part))
                    size += len(part)
                    held_size += len(part)
                    if held_size >= FLUSH:
                        held.append(scan(texts))
                        texts, size, held_size = [], 0, 0
                        yield from flush()
                        held = []
        if texts:
            held.append(scan(texts))
        if held:
            yield from flush()

    return run


def _settle(length: int):
    """One bucket: equal runs but the first go; the firsts of an anchor with different runs are to be compared."""

    def run(table: pa.Table) -> pa.Table:
        parts = [common.unpack(b, *RUN) for b in table.column("block").to_pylist()]
        cols, again = _sorted([np.concatenate(c) for c in zip(*parts)])
        told = [common.unpack(b, "<i8", "<i8", "<i8") for b in table.column("gone").to_pylist()]
        doc, lo, hi = (np.concatenate(c) for c in zip(*told))
        n = cols[5].astype(np.int64)
        doc = np.concatenate([doc, cols[2][again]])
        lo, hi = np.concatenate([lo, cols[3][again]]), np.concatenate([hi, cols[3][again] + n[again] - 1 + length])
        gone = _found(0, doc, lo, hi)
        key, body = cols[0], cols[1]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (body[1:] != body[:-1])
        key, doc, lo, place, n = (c[new] for c in (key, cols[2], cols[3], cols[4], cols[5]))
        many = np.zeros(len(key), dtype=bool)
        if len(key):
            same = key[1:] == key[:-1]
            many[1:] |= same
            many[:-1] |= same
        return pa.concat_tables([gone, _found(1, doc[many], key[many], lo[many], place[many], n[many])])

    return run


PART = ["<u8", "<i8", "<i8", "u1", "u1", "<u4", "u1"]  # key, document, first window, anchor's place, windows, bytes' ends, bytes


def _first_halves(cols: list[np.ndarray], raw: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(columns key, doc, lo, place, n, index of the first of each content; intervals doc, start, end of the others)."""
    key, doc, lo, place, n = cols
    body = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    body ^= common.mix64(place.astype(np.uint64) * np.uint64(256) + n.astype(np.uint64))
    cols, again = _sorted([key.astype(np.uint64), body, doc, lo, place, n, np.arange(len(raw))])
    key, _, doc, lo, place, n, at = cols
    told = [doc[again], lo[again], lo[again] + n[again].astype(np.int64) - 1 + length]
    return [c[~again] for c in (key, doc, lo, place, n, at)], told


def _cut(buckets: int, length: int):
    """The bytes of runs to be compared, in two halves: the windows that reach far to the left of their
    anchor are keyed by that side too, the others by the other, so that a common anchor alone gathers nothing.
    Halves that are equal throughout within a task leave their first; the others are told as intervals."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("gone", pa.binary())])
    half = (length - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols = [np.array(c) for c in list(zip(*held))[:5]]
            cols, told = _first_halves(cols, [x[5] for x in held], length)
            key, at = cols[0], cols[5]
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            parts = np.array_split(np.arange(len(told[0])), max(1, len(edge) - 1))
            for x, y, part in zip(edge, edge[1:], parts):
                own = [held[i][5] for i in at[x:y]]
                ends = np.cumsum([len(o) for o in own])
                raw = np.frombuffer(b"".join(own), np.uint8)
                block = common.pack(*[np.asarray(c).astype(t) for c, t in zip([*[c[x:y] for c in cols[:5]], ends, raw], PART)])
                yield common.batch_of(schema, bucket=[bucket[x]], block=[block], gone=[common.pack(*[c[part].astype("<i8") for c in told])])

        for batch in batches:
            for doc, text, blocks in zip(*common.columns(batch, "__doc", "__text", "__asks")):
                for b in blocks:
                    key, lo, place, n = common.unpack(b, "<u8", "<i8", "u1", "u1")
                    for k, p, a, m in zip(key.tolist(), lo.tolist(), place.tolist(), n.tolist()):
                        at, last = p + a, p + m - 1
                        if last + length > len(text):
                            continue  # another text of the same id
                        cut = at - half  # windows up to here hold `half` bytes left of the anchor
                        if p <= cut:
                            name = xxhash.xxh3_64_intdigest(text[cut : at + GRAM], seed=1)
                            end = min(last, cut)
                            held.append((name, doc, p, at - p, end - p + 1, text[p : end + length]))
                            size += len(held[-1][5]) + 64
                        if last > cut:
                            q = max(p, cut + 1)
                            name = xxhash.xxh3_64_intdigest(text[at : at + GRAM + half - 1], seed=2)
                            held.append((name, doc, q, at - q, last - q + 1, text[q : last + length]))
                            size += len(held[-1][5]) + 64
                if size > FLUSH // 2:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def repeats(key: np.ndarray, doc: np.ndarray, lo: np.ndarray, place: np.ndarray, n: np.ndarray, raw: list[bytes], length: int = LENGTH, block: int = BLOCK) -> np.ndarray:
    """Of the windows of some runs, (run, window) of those that are not the first of their content.

    Each run's bytes are laid out with its anchor at a multiple of PERIOD, so suffixes that can be
    equal stand at the same residue and meet the cover at the same distance. Buckets of suffixes
    (of one key and one place) are gathered until a block is full, and a block is sorted by the
    first PERIOD bytes, then the rank of the cover suffix, then the bytes after what that rank spans.
    """
    cover = np.array(difference_cover(PERIOD))
    depth = length - PERIOD
    gap = np.array([min((c - r) % PERIOD for c in cover) for r in range(PERIOD)])  # from a residue to the cover
    order = np.argsort(key, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(key[order], prepend=key[order][:1] + np.uint64(1))), len(key)) if len(key) else np.array([0])
    out, group, held = [], [], 0

    def settle(runs: np.ndarray, shifts: tuple[int, int]) -> None:
        """Suffixes of these runs whose anchor is within `shifts` bytes after their start."""
        size = np.array([len(raw[r]) for r in runs])
        pad = (-place[runs].astype(np.int64)) % PERIOD
        room = -(-(pad + size + 16) // PERIOD) * PERIOD
        base = np.cumsum(room) - room + pad
        buf = np.zeros(int(room.sum()) + 2 * length, dtype=np.uint8)
        for b, s, r in zip(base.tolist(), size.tolist(), runs.tolist()):
            buf[b : b + s] = np.frombuffer(raw[r], np.uint8)
        w = words_at(buf)
        first = np.maximum(0, place[runs].astype(np.int64) - shifts[1])
        last = np.minimum(n[runs].astype(np.int64) - 1, place[runs].astype(np.int64) - shifts[0])
        count = np.maximum(0, last - first + 1)
        own = np.repeat(np.arange(len(runs)), count)
        off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        if not len(own):
            return
        at = base[own] + off
        shift = place[runs].astype(np.int64)[own] - off
        # ranks of the cover's suffixes to the depth that the first and last PERIOD bytes leave open
        need = np.unique(at + gap[at % PERIOD])
        deep = [w[need + 8 * j].astype(np.uint64) for j in range(depth // 8)] + ([w[need + depth - 8].astype(np.uint64)] if depth % 8 else [])
        by = np.lexsort(deep[::-1])
        step = np.zeros(len(need), dtype=bool)
        for d in deep:
            d = d[by]
            step[1:] |= d[1:] != d[:-1]
        rank = np.empty(len(need), dtype=np.int64)
        rank[by] = np.cumsum(step)
        tie = rank[np.searchsorted(need, at + gap[at % PERIOD])]
        head = [w[at + 8 * j].astype(np.uint64) for j in range(PERIOD // 8)]
        tail = [w[at + depth + 8 * j].astype(np.uint64) for j in range(PERIOD // 8)]
        name = key[runs][own]
        pos = lo[runs][own] + off
        who = doc[runs][own]
        keys = [name, shift, *head, tie, *tail]
        by = np.lexsort((pos, who, *keys[::-1]))
        new = np.zeros(len(by), dtype=bool)
        new[0] = True
        for k in keys:
            k = k[by]
            new[1:] |= k[1:] != k[:-1]
        at_first = np.flatnonzero(new)[np.cumsum(new) - 1]
        who, pos = who[by], pos[by]
        again = ~new & ((who != who[at_first]) | (pos != pos[at_first]))
        hit = by[again]
        out.append(np.stack([runs[own[hit]], off[hit]], axis=1))

    for i, j in zip(edge, edge[1:]):
        if j - i < 2:
            continue
        runs = order[i:j]
        size = int(n[runs].sum(dtype=np.int64))
        if size > block:  # a bucket too large for a block goes place by place
            if group:
                settle(np.concatenate(group), (0, length))
                group, held = [], 0
            step = max(1, length * block // size)
            for s in range(0, length, step):
                settle(runs, (s, s + step - 1))
            continue
        if held + size > block and group:
            settle(np.concatenate(group), (0, length))
            group, held = [], 0
        group.append(runs)
        held += size
    if group:
        settle(np.concatenate(group), (0, length))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def _compare(length: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [common.unpack(b, *PART) for b in table.column("block").to_pylist()]
        key, doc, lo, place, n = (np.concatenate([p[c] for p in parts]) for c in range(5))
        raw = []
        for p in parts:
            whole = p[6].tobytes()
            raw += [whole[a:b] for a, b in zip([0, *p[5][:-1].tolist()], p[5].tolist())]
        told = [common.unpack(b, "<i8", "<i8", "<i8") for b in table.column("gone").to_pylist()]
        (key, doc, lo, place, n, at), more = _first_halves([key, doc, lo, place, n], raw, length)
        found = repeats(key, doc, lo, place, n, [raw[i] for i in at], length)
        start = lo[found[:, 0]] + found[:, 1]
        gone = [np.concatenate(c) for c in zip(*told, more, (doc[found[:, 0]], start, start + length))]
        return _found(0, *gone)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
    for batch in batches:
        rows = []
        for doc, text, blocks in zip(*common.columns(batch, "__doc", "__text", "__gone")):
            size = len(text)
            gone, spans = 0, 0
            if blocks:
                s, e = (np.concatenate(c) for c in zip(*[common.unpack(b, "<i8", "<i8") for b in blocks]))
                s, e = merge(np.minimum(s, size), np.minimum(e, size))
                s, e = s[e > s], e[e > s]
                gone, spans = int((e - s).sum()), len(s)
                text = b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), size]))
            rows.append((doc, text, size, gone, spans))
        if rows:
            yield common.batch_of(schema, **dict(zip(schema.names, zip(*rows))))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans): texts without the bytes that a string of
    `length` bytes covers which also starts earlier (smaller id, or same text, earlier).

    Texts as UTF-8 bytes; matches never cross documents and are judged on the input. Repeats within
    a task are settled before anything is shuffled, so of a passage in a third of all documents each
    task sends one copy. `length` is from 64 to 255.

    Edge cases: null is empty; texts shorter than `length` lose nothing. Rows that repeat an id with
    the same text are one document and each gets its result; with other texts, what is found in any
    of them is removed from each. A null id loses nothing and is nobody's earlier string. Texts of
    any length are read in parts. Other columns are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    if not 64 <= length <= 255:
        raise ValueError("length is from 64 to 255")
    named = docs.select(F.col(id_col).cast("long").alias("__doc"), common.as_bytes(F.col(text_col)).alias("__text"))
    known = named.where("__doc is not null")
    total = known.agg(F.coalesce(F.sum(F.length("__text")), F.lit(0))).first()[0]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // (12 << 20) + 1)
    runs = known.mapInArrow(_runs(buckets, length), "bucket int, block binary, gone binary")
    kinds = "doc long, kind int, block binary"
    found = common.store(runs.groupBy("bucket").applyInArrow(_settle(length), kinds), free=True)
    asks = found.where("kind = 1").groupBy(F.col("doc").alias("__d")).agg(F.collect_list("block").alias("__asks"))
    cut = known.join(asks, F.col("__doc") == F.col("__d")).select("__doc", "__text", "__asks")
    cut = cut.mapInArrow(_cut(buckets, length), "bucket int, block binary, gone binary")
    more = common.store(cut.groupBy("bucket").applyInArrow(_compare(length), kinds), free=True)
    gone = found.where("kind = 0").unionByName(more).groupBy(F.col("doc").alias("__d")).agg(F.collect_list("block").alias("__gone"))
    out = named.join(gone, F.col("__doc") == F.col("__d"), "left").select("__doc", "__text", "__gone")
    out = out.mapInArrow(_remove, "doc long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumnRenamed("doc", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH b AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents
), win AS (
  SELECT doc_id, p, hex(t[p + 1 : p + 100]) AS s
  FROM (SELECT doc_id, t, unnest(range(greatest(octet_length(t) - 99, 0))) AS p FROM b)
), dup AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, p) AS k FROM win) WHERE k > 1
), iv AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM dup
), span AS (
  SELECT doc_id, g, min(p) AS a, max(p) + 100 AS z
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM iv) GROUP BY doc_id, g
), gap AS (
  SELECT doc_id, a AS upto, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span
  UNION ALL SELECT s.doc_id, octet_length(t), max(z) FROM span s JOIN b USING (doc_id) GROUP BY s.doc_id, t
), kept AS (
  SELECT doc_id, string_agg(hex(t[since + 1 : upto]), '' ORDER BY since) AS h FROM gap JOIN b USING (doc_id) GROUP BY doc_id
), n AS (
  SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id
)
SELECT b.doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n.doc_id IS NULL THEN t ELSE unhex(h) END) AS kept_sha256
FROM b LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
