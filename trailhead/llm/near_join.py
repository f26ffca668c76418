"""N-gram Jaccard join over parity sketches: pigeonhole join per size band, then exact verification.

A text is the set of its distinct word shingles. The shingles of a set are dealt to the blocks of
a sketch by hash; each flips its block's parity bit and is XORed into its block's 64-bit word. A
shingle that two sets do not share touches one block, so the Hamming distance of the parity bits
is at most the size of the symmetric difference, and so is the number of blocks that differ.

If 100 |A & B| >= 80 |A | B| then |A ^ B| <= (|A| + |B|) / 9 =: d. By the pigeonhole principle the
first d + 1 nonempty blocks of either set, in any order of (block, word) that both sets use, then
share one with an equal word. The order is by how many sets of the corpus have the word in that
block, counted exactly; words that are frequent within single tasks are not counted but come last.
Words that no other set has come first, so a set with more than d of these has no candidates at
all: texts that merely share a passage do not meet.

Equal texts are one set, named by their smallest id. A set's keys, its sizes and its component
travel in packed blocks, to the bucket of the key or back to the bucket of the set, and what a
bucket of sets says of a key is reduced first: a key that a third of all sets have costs one
entry for each bucket of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
#: Percent of the union that two linked texts share.
SHARE = 80
#: Size bands: each is four times as wide as the one before; sets within 1.25 of an edge are in both.
BAND = 4
#: Below this size every shingle has a block of its own.
TINY = 64
FREE = 1 << 40
#: Large groups are compared in parts of so many sets.
PART = 4096
#: While sets have more possible partners than this in a group, stars come before the pairs that are left.
MANY = 256

_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. bytes.lower() and split() treat A-Z and the
    six ASCII blanks only, as the definition of a word wants."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), dtype=np.uint64)
    for j in range(min(len(h), words)):
        out = common.mix64(out * _M + h[j : j + n])
    return np.unique(out)


def most_apart(n: int, m: int, share: int = SHARE) -> int:
    """The largest symmetric difference of linked sets of n and m shingles."""
    return (100 - share) * (n + m) // (100 + share)


def bands(n: int, share: int = SHARE) -> list[tuple[int, int]]:
    """(band, blocks of its sketches) for each band that holds sets a set of this size can link with.

    A band [4^b, 4^(b+1)) also takes in the sets below it that are big enough to link across the
    edge. Blocks are half as many as the largest set has shingles, so that far more blocks than d
    are nonempty; tiny sets get a block for each hash.
    """
    if n < TINY:
        b = 0
    else:
        b = 1
        while TINY * BAND**b <= n:
            b += 1
    found = [b]
    edge = TINY * BAND**b
    if 100 * n >= share * edge:
        found.append(b + 1)
    return [(x, FREE if x == 0 else TINY * BAND**x // 2) for x in found]


def sketch(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nonempty blocks, their XOR words, their parities) of sorted hashes."""
    if blocks >= FREE:
        return np.arange(len(h)), h, np.ones(len(h), dtype=bool)
    block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    return block[first], np.bitwise_xor.reduceat(common.mix64(h), first), np.diff(np.append(first, len(h))) % 2 == 1


def keys(h: np.ndarray, band: int, blocks: int) -> np.ndarray:
    """A 64-bit key for each nonempty block: its band, place and word."""
    block, word, _ = sketch(h, blocks)
    salt = np.zeros(len(word), np.uint64) if blocks >= FREE else block.astype(np.uint64)
    return common.mix64(word ^ common.mix64(salt * _M + np.uint64(band + 1)))


def bits(h: np.ndarray, blocks: int) -> bytes:
    """Parity bits, packed: four for each block, 256 for a tiny set. A wider band's fold to a narrower one's."""
    size = 256 if blocks >= FREE else 4 * blocks
    at = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) % 2 == 1).tobytes()


def fold(packed: np.ndarray, times: int) -> np.ndarray:
    """The parity bits of a sketch (or rows of sketches) a `times`-th as wide."""
    if times == 1:
        return packed
    wide = np.unpackbits(packed, axis=-1)
    return np.packbits(np.bitwise_xor.reduce(wide.reshape(*wide.shape[:-1], -1, times), axis=-1), axis=-1)


def whole(blob: bytes) -> np.ndarray:
    """The stored hashes of a set: 48 bits each, sorted."""
    wide = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    wide[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _sets(least: int, most: int):
    """A row for each text: its set. And of the task's texts, a row for each key that `least` of them
    or more have: at most `most`, with counts."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("weak", pa.int32()), ("key", pa.int64()), ("bits", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        total: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def count() -> None:
            nonlocal total, held, size
            k, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= 2
            k, n = np.concatenate([total[0], k[keep]]), np.concatenate([total[1], n[keep]])
            k, where = np.unique(k, return_inverse=True)
            total = k, np.bincount(where, weights=n, minlength=len(k)).astype(np.int64)
            if len(total[0]) > 8 * most:
                top = np.argsort(-total[1], kind="stable")[: 4 * most]
                total = total[0][np.sort(top)], total[1][np.sort(top)]
            held, size = [], 0

        for batch in batches:
            rows = []
            for i, text in zip(*common.columns(batch, "__doc", "__text")):
                h = shingles(text)
                n = len(h)
                blob = h.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
                h &= ~np.uint64(0xFFFF)
                at = bands(n) if n else []
                rows.append((i, n, sum(1 << x[0] for x in at if weak(h, *x)), None, bits(h, at[0][1]) if at else b"", blob))
                for band, blocks in at:
                    held.append(keys(h, band, blocks))
                    size += len(held[-1])
                if size > 2_000_000:
                    count()
            if rows:
                yield common.batch_of(schema, **dict(zip(schema.names, zip(*rows))))
        if held:
            count()
        k, n = total
        keep = np.flatnonzero(n >= least)
        keep = keep[np.argsort(-n[keep], kind="stable")][:most]
        empty = [None] * len(keep)
        yield common.batch_of(schema, rep=empty, n=n[keep], weak=empty, key=k[keep].astype(np.int64), bits=empty, hashes=empty)

    return run


def needed(n: int, share: int = SHARE) -> int:
    """d + 1, where d is the most that a set of n shingles can differ from one it links with."""
    return most_apart(n, 100 * n // share, share) + 1


def weak(h: np.ndarray, band: int, blocks: int, share: int = SHARE) -> bool:
    n = len(h)
    return blocks < FREE and len(sketch(h, blocks)[0]) < needed(n, share)


LOW = np.uint64((1 << 40) - 1)
KEYS = ["u1", "u1", "<u4", "<i8"]  # low 40 bits of keys, band (0 or 1), index of the set, sets
HEADS = ["<i8", "u1", "<i4", "<i4"]  # set, band, how many shared keys it lacks if no key is shared, size
SURE = ["<i8", "<i8"]  # key, set: popular keys that a set has to use
SHARED = ["<i8", "u1", "<i8", "<i4"]  # set, band, key, how many sets have it
MEMBER = ["<i8", "<i8", "<i8", "<i4", "u1"]  # set, root, key, size, how odd the set is: the share of keys that it alone has
TOP = ["<i8", "<i8", "<i8", "<i4", "u1", "<i8"]  # key, set, root, size, how odd, sets that it stands for
BLOCK = "bucket int, kind int, block binary"
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _name(key: np.ndarray, buckets: int) -> np.ndarray:
    return (_bucket(key, buckets) << 40) | (key & LOW).astype(np.int64)


def _home(cid: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a set."""
    return _bucket(common.mix64(cid.astype(np.int64).view(np.uint64) * _M), buckets)


def _split(by: np.ndarray, buckets: int, *cols: np.ndarray) -> list[list[np.ndarray]]:
    """Columns, sorted, for each bucket."""
    order = np.argsort(by, kind="stable")
    edge = np.searchsorted(by[order], np.arange(buckets + 1))
    cols = [c[order] for c in cols]
    return [[c[i:j] for c in cols] for i, j in zip(edge, edge[1:])]



def _cat(blocks: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    parts = [common.unpack(b, *kinds) for b in blocks if b]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, k) for k in kinds]


def _packed(cols: list[np.ndarray], kinds: list[str]) -> bytes:
    return common.pack(*[np.asarray(c).astype(t) for c, t in zip(cols, kinds)])


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    new = np.zeros(len(cols[0]), dtype=bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _emit(spread, buckets: int, loose: frozenset[int], chunk: int = 3_000_000):
    """For each bucket a block of keys (some bytes each instead of a JVM row), of heads, and of popular keys in use.

    Keys go to their own bucket, to be counted; heads and popular keys go to their set's.
    """
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("heads", pa.binary()), ("sure", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        popular = spread.value
        held: list[tuple[np.ndarray, int, int]] = []
        heads: list[tuple[int, int, int, int]] = []
        sure: list[tuple[np.ndarray, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate([k for k, _, _ in held])
            per = [len(k) for k, _, _ in held]
            which = np.repeat(np.arange(len(held)), per)
            band = np.repeat(np.array([b for _, b, _ in held], dtype=np.uint8), per)
            cids = np.array([c for _, _, c in held], dtype=np.int64)
            by_key = _split(_bucket(key, buckets), buckets, key, band, which)
            head = [np.array(c) for c in zip(*heads)]
            by_head = _split(_home(head[0], buckets), buckets, *head)
            pk = np.concatenate([k for k, _ in sure]) if sure else np.empty(0, np.int64)
            pc = np.repeat(np.array([c for _, c in sure], dtype=np.int64), [len(k) for k, _ in sure])
            by_sure = _split(_home(pc, buckets), buckets, pk, pc)
            for i in range(buckets):
                key, band, which = by_key[i]
                if not len(key) and not len(by_head[i][0]) and not len(by_sure[i][0]):
                    continue
                names, at = np.unique(which, return_inverse=True)
                low = np.ascontiguousarray((key & LOW).view(np.uint8).reshape(-1, 8)[:, :5])
                told = [_packed([low, band, at, cids[names]], KEYS), _packed(by_head[i], HEADS), _packed(by_sure[i], SURE)]
                yield common.batch_of(schema, bucket=[i], keys=[told[0]], heads=[told[1]], sure=[told[2]])

        for batch in batches:
            for c, n, blob in zip(*common.columns(batch, "rep", "n", "hashes")):
                h = whole(blob)
                for at, (band, blocks) in enumerate(bands(n)):
                    k = np.unique(keys(h, band, FREE if band in loose else blocks))
                    hot = popular[np.minimum(np.searchsorted(popular, k), max(len(popular) - 1, 0))] == k if len(popular) else np.zeros(len(k), bool)
                    lack = needed(n) - int((~hot).sum())
                    heads.append((c, at, lack, n))
                    held.append((k[~hot], at, c))
                    if lack > 0:
                        sure.append((_name(k[hot][:lack], buckets), c))
                    size += len(k)
                if size > chunk:
                    yield from flush()
                    held, heads, sure, size = [], [], [], 0
        if held:
            yield from flush()

    return run


def _count_keys(buckets: int):
    """One bucket of keys: those that several sets have, with how many, to the sets' buckets."""
    schema = pa.schema([("bucket", pa.int32()), ("heads", pa.binary()), ("sure", pa.binary()), ("shared", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = []
        for block in table.column("keys").to_pylist():
            low, band, at, names = common.unpack(block, *KEYS)
            wide = np.zeros((len(at), 8), dtype=np.uint8)
            wide[:, :5] = low.reshape(-1, 5)
            cols.append([wide.view("<i8").ravel(), names[at], band])
        key, cid, band = (np.concatenate(c) for c in zip(*cols))
        order = np.lexsort((cid, key))
        key, cid, band = key[order], cid[order], band[order]
        new = _starts(key, cid)  # repeated rows of a text may be in other tasks
        key, cid, band = key[new], cid[new], band[new]
        first = _starts(key)
        n = np.diff(np.append(first, len(key)))
        n = np.repeat(n, n)
        many = n > 1
        own = int(table.column("bucket")[0].as_py())
        key, cid, band, n = key[many] | (own << 40), cid[many], band[many], n[many]
        out = [{"bucket": own, "heads": h, "sure": s, "shared": b""} for h, s in zip(table.column("heads").to_pylist(), table.column("sure").to_pylist())]
        for i, part in enumerate(_split(_home(cid, buckets), buckets, cid, band, key, n)):
            if len(part[0]):
                out.append({"bucket": i, "heads": b"", "sure": b"", "shared": _packed(part, SHARED)})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _choose(table: pa.Table) -> pa.Table:
    """One bucket of sets, as one block of members: each set's first d + 1 keys that others have too."""
    hc, hb, lack, size = _cat(table.column("heads").to_pylist(), HEADS)
    pk, pc = _cat(table.column("sure").to_pylist(), SURE)
    cid, band, key, n = _cat(table.column("shared").to_pylist(), SHARED)
    out_c, out_k = [pc], [pk]
    names, at = np.unique(hc, return_index=True)
    sizes, odd = size[at], np.zeros(len(names))
    for b in (0, 1):
        head, at = np.unique(hc[hb == b], return_index=True)
        short = lack[hb == b][at]
        s = np.flatnonzero(band == b)
        s = s[np.lexsort((key[s], n[s], cid[s]))]
        c, k = cid[s], key[s]
        first = _starts(c)
        count = np.diff(np.append(first, len(c)))
        where = np.searchsorted(head, c[first])
        most = short[where] + count  # d + 1 less the keys that no other set has
        keep = np.arange(len(c)) - np.repeat(first, count) < np.repeat(most, count)
        out_c.append(c[keep])
        out_k.append(k[keep])
        need = np.array([needed(x) for x in sizes[np.searchsorted(names, head)].tolist()])
        alone = need - short
        alone[where] -= count
        place = np.searchsorted(names, head)
        odd[place] = np.maximum(odd[place], alone / np.maximum(need, 1))
    c, k = np.concatenate(out_c), np.concatenate(out_k)
    order = np.lexsort((k, c))
    c, k = c[order], k[order]
    new = _starts(c, k)
    c, k = c[new], k[new]
    at = np.searchsorted(names, c)
    block = _packed([c, c, k, sizes[at], np.clip(255 * odd[at], 0, 255)], MEMBER)
    return pa.Table.from_pylist([{"bucket": table.column("bucket")[0].as_py(), "kind": 0, "block": block}] if len(c) else [], schema=PACKED)


def _roots_by_bucket(buckets: int):
    """(node, root) rows as blocks for the buckets of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, 1 << 20):
            node, root = (table.column(c).to_numpy() for c in ("node", "root"))
            for i, (a, b) in enumerate(_split(_home(node, buckets), buckets, node, root)):
                if len(a):
                    yield common.batch_of(PACKED, bucket=[i], kind=[1], block=[_packed([a, b], ["<i8", "<i8"])])

    return run


def _bits_by_bucket(buckets: int):
    """(rep, bits) rows as blocks for the buckets of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, 1 << 16):
            cid = table.column("rep").to_numpy()
            raw = table.column("bits").to_pylist()
            for i, (c, at) in enumerate(_split(_home(cid, buckets), buckets, cid, np.arange(len(cid)))):
                if len(c):
                    own = [raw[x] for x in at]
                    block = common.pack(c.astype("<i8"), np.cumsum([len(x) for x in own]).astype("<i8"), np.frombuffer(b"".join(own), np.uint8))
                    yield common.batch_of(PACKED, bucket=[i], kind=[2], block=[block])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _of(table: pa.Table, kind: int) -> list[bytes]:
    return [b for k, b in zip(table.column("kind").to_pylist(), table.column("block").to_pylist()) if k == kind]


def _attach(table: pa.Table) -> pa.Table:
    """One bucket of sets: members with their present root."""
    cid, root, key, n, odd = _cat(_of(table, 0), MEMBER)
    node, to = _cat(_of(table, 1), ["<i8", "<i8"])
    if not len(cid):
        return PACKED.empty_table()
    if len(node):
        order = np.argsort(node)
        node, to = node[order], to[order]
        at = np.minimum(np.searchsorted(node, cid), len(node) - 1)
        root = np.where(node[at] == cid, to[at], cid)
    return pa.Table.from_pylist([{"bucket": table.column("bucket")[0].as_py(), "kind": 0, "block": _packed([cid, root, key, n, odd], MEMBER)}], schema=PACKED)


def _tops(buckets: int, first: bool):
    """Of each bucket of sets, one entry for a key (or a key and component, after the first turn): its least odd set."""
    schema = pa.schema([("bucket", pa.int32()), ("src", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, block in zip(*common.columns(batch, "bucket", "block")):
                cid, root, key, n, odd = common.unpack(block, *MEMBER)
                by = np.lexsort((cid, odd, key) if first else (cid, odd, root, key))
                cid, root, key, n, odd = (c[by] for c in (cid, root, key, n, odd))
                at = _starts(key) if first else _starts(key, root)
                count = np.diff(np.append(at, len(key)))
                for i, part in enumerate(_split(key[at] >> 40, buckets, key[at], cid[at], root[at], n[at], odd[at], count)):
                    if len(part[0]):
                        yield common.batch_of(schema, bucket=[i], src=[src], block=[_packed(part, TOP)])

    return run


def _centres(first: bool):
    """One bucket of keys: the centre of each that several sets (or components) have, told to each bucket of sets that has it.

    A centre is the least odd set of the largest component: what it shares, most of the others share.
    """
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary()), ("pairs", pa.int64()), ("entries", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        parts = [common.unpack(b, *TOP) for b in table.column("block").to_pylist()]
        src = np.repeat(np.array(table.column("src").to_pylist(), dtype=np.int64), [len(p[0]) for p in parts])
        key, cid, root, n, odd, count = (np.concatenate(c) for c in zip(*parts))
        by = np.lexsort((cid, odd, key) if first else (cid, odd, root, key))
        key, cid, root, n, odd, count, src = (c[by] for c in (key, cid, root, n, odd, count, src))
        at = _starts(key) if first else _starts(key, root)
        total = np.add.reduceat(count, at) if len(at) else count
        k, c, r, m, o = (x[at] for x in (key, cid, root, n, odd))
        own = _starts(k)
        size = np.add.reduceat(total, own) if len(own) else total
        inside = np.add.reduceat(total * total, own) if len(own) else total
        best = np.lexsort((c, o, -total, k))[own] if len(own) else own  # sorted by key, so each key's best stands at its start
        many = size > 1 if first else np.diff(np.append(own, len(k))) > 1
        pairs = np.where(many, size - 1 if first else (size * size - inside) // 2, 0)
        which = np.searchsorted(k[own], key)
        tell = many[which]
        s, w = src[tell], which[tell]
        order = np.lexsort((w, s))
        s, w = s[order], w[order]
        new = _starts(s, w)
        s, w = s[new], w[new]
        out = []
        edge = _starts(s)
        for i, j in zip(edge, [*edge[1:], len(s)]):
            x = best[w[i:j]]
            cols = [k[x], c[x], r[x], m[x], o[x], size[w[i:j]]]
            out.append({"bucket": int(s[i]), "kind": 3, "block": _packed(cols, TOP), "pairs": 0, "entries": 0})
        if out:
            out[0] |= {"pairs": int(pairs.sum()), "entries": int(size[many].sum())}
        return pa.Table.from_pylist(out, schema=schema)

    return run


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _meet(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
    """Members of one bucket of sets whose key has a centre, and their keys' centres."""
    members, tops = _cat(_of(table, 0), MEMBER), _cat(_of(table, 3), TOP)
    if not len(members[0]) or not len(tops[0]):
        return None
    order = np.argsort(tops[0], kind="stable")
    tops = [c[order] for c in tops]
    at = np.minimum(np.searchsorted(tops[0], members[2]), len(tops[0]) - 1)
    ok = tops[0][at] == members[2]
    return [c[ok] for c in members], [c[at[ok]] for c in tops]


def _star(share: int):
    """One bucket of sets: of each set the pair with the least odd centre, of another component, whose size allows a link."""

    def run(table: pa.Table) -> pa.Table:
        if (met := _meet(table)) is None:
            return PAIRS.empty_table()
        (cid, root, _, n, _), (_, centre, far, m, odd, _) = met
        ok = (root != far) & (cid != centre) & (100 * np.minimum(n, m).astype(np.int64) >= share * np.maximum(n, m).astype(np.int64))
        cid, centre, odd = cid[ok], centre[ok], odd[ok]
        by = np.lexsort((centre, odd, cid))
        cid, centre = cid[by], centre[by]
        new = _starts(cid)
        return pa.table([centre[new], cid[new]], schema=PAIRS)

    return run


CROSS = ["<i8", "<u4", "u1", "<u4", "<i8", "<i8", "<i4", "<i8", "u1"]  # key, part, of the largest component; index; set, root, size, bits' ends, bits


def _deal(buckets: int):
    """One bucket of sets: members of keys that several components have, with their bits, to the buckets of keys.

    A key of many sets is dealt in parts: the largest component's sets go to one part each, all others to every part.
    """

    def run(table: pa.Table) -> pa.Table:
        if (met := _meet(table)) is None:
            return PACKED.empty_table()
        (cid, root, key, n, _), (_, _, far, _, _, size) = met
        raw: dict[int, bytes] = {}
        have = set(cid.tolist())
        for block in _of(table, 2):
            c, ends, joined = common.unpack(block, "<i8", "<i8", "u1")
            for i, a, b in zip(c.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                if i in have:
                    raw[i] = joined[a:b].tobytes()
        parts = -(-size // PART)
        big = root == far
        own = np.flatnonzero(big)
        rest = np.flatnonzero(~big)
        take = np.concatenate([own, np.repeat(rest, parts[rest])])
        first = np.cumsum(parts[rest]) - parts[rest]
        part = np.concatenate([_home(cid[own], 1 << 30) % parts[own], np.arange(parts[rest].sum()) - np.repeat(first, parts[rest])])
        slot = np.where(parts[take] == 1, key[take] >> 40, _home(key[take] + 31 * part, buckets))
        out = []
        for i, (t, p) in enumerate(_split(slot, buckets, take, part)):
            if not len(t):
                continue
            names, at = np.unique(cid[t], return_inverse=True)
            one = np.zeros(len(names), dtype=np.int64)
            one[at] = t
            own_raw = [raw[x] for x in names.tolist()]
            ends = np.cumsum([len(x) for x in own_raw])
            cols = [key[t], p, big[t], at, names, root[one], n[one], ends, np.frombuffer(b"".join(own_raw), np.uint8)]
            out.append({"bucket": i, "kind": 0, "block": _packed(cols, CROSS)})
        return pa.Table.from_pylist(out, schema=PACKED)

    return run


def _cross(share: int, most: int = 1 << 20):
    """One bucket of keys: the pairs of its groups across components whose sizes and sketches allow a link."""

    def run(table: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = []
        raw: dict[int, bytes] = {}
        for block in table.column("block").to_pylist():
            key, part, big, at, names, root, n, ends, joined = common.unpack(block, *CROSS)
            cols.append([key, part, big, names[at], root[at], n[at].astype(np.int64)])
            for i, a, b in zip(names.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                raw[i] = joined[a:b].tobytes()
        key, part, big, cid, root, n = (np.concatenate(c) for c in zip(*cols))
        by = np.lexsort((n, part, key))
        key, part, big, cid, root, n = (c[by] for c in (key, part, big, cid, root, n))
        first = _starts(key, part)
        last = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
        once, big = part == 0, big.astype(bool)
        names, own = np.unique(cid, return_inverse=True)
        size = np.zeros(len(names), dtype=np.int64)
        size[own] = n
        blobs = [raw[x] for x in names.tolist()]
        found: list[np.ndarray] = []
        done = [np.empty(0, dtype=np.int64)]
        held = step = 0
        i = np.arange(len(key))
        while len(i) or found:  # each set with the one `step` further on in its group; sizes ascend, so too large a one ends the row
            step += 1
            i = i[i + step < last[i]]
            i = i[100 * n[i] >= share * n[i + step]]
            j = i + step
            ok = (root[i] != root[j]) & (once[i] | big[i] | big[j])
            x, y = own[i[ok]], own[j[ok]]
            found.append(np.minimum(x, y) * len(names) + np.maximum(x, y))
            held += len(x)
            if held > most or not len(i):
                done.append(_allowed(np.unique(np.concatenate(found)), blobs, size, share))
                found, held = [], 0
        pairs = np.unique(np.concatenate(done))
        return pa.table([names[pairs // max(1, len(names))], names[pairs % max(1, len(names))]], schema=PAIRS)

    return run


def _allowed(pairs: np.ndarray, blobs: list[bytes], size: np.ndarray, share: int) -> np.ndarray:
    """Pairs (first * sets + second) whose sketches' Hamming distance allows a link; pairs of equal widths are compared as matrices."""
    x, y = pairs // max(1, len(blobs)), pairs % max(1, len(blobs))
    width = np.array([len(b) for b in blobs], dtype=np.int64)
    most = (100 - share) * (size[x] + size[y]) // (100 + share)
    keep = np.zeros(len(pairs), dtype=bool)
    kinds = width[x] << 32 | width[y]
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        w, v = int(kind) >> 32, int(kind) & 0xFFFFFFFF
        low = min(w, v)
        sides = []
        for ends, wide in ((x[rows], w), (y[rows], v)):
            used, at = np.unique(ends, return_inverse=True)
            sides.append((fold(np.frombuffer(b"".join([blobs[k] for k in used.tolist()]), np.uint8).reshape(len(used), wide), wide // low), at))
        per = max(1, (1 << 22) // low)
        for k in range(0, len(rows), per):
            left, right = (m[at[k : k + per]] for m, at in sides)
            keep[rows[k : k + per]] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) <= most[rows[k : k + per]]
    return pairs[keep]


def _verify(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, n, m, p, q, x, y in zip(*common.columns(batch, "a", "b", "n", "m", "p", "q", "x", "y")):
                if 100 * min(n, m) < share * max(n, m):
                    continue
                p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                low = min(len(p), len(q))
                if int(np.bitwise_count(fold(p, len(p) // low) ^ fold(q, len(q) // low)).sum()) > (100 - share) * (n + m) // (100 + share):
                    continue
                both = len(np.intersect1d(whole(x), whole(y), assume_unique=True))
                if 100 * both >= share * (n + m - both):
                    a.append(i)
                    b.append(j)
            yield common.batch_of(PAIRS, a=a, b=b)

    return run


def links_of(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) whose sets share enough: sizes, then sketches, then whole sets.

    `sets` is dealt by its name, so b's sets are read where they lie. a, which may stand in very many
    pairs, is joined from a plain table, so that adaptive execution can split its rows.
    """
    left = sets.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("bits").alias("q"), F.col("hashes").alias("y"))
    ends = pairs.select(F.col("a").alias("__a")).distinct()
    right = sets.join(ends, sets["rep"] == ends["__a"], "left_semi")
    right = common.store(right.select(F.col("rep").alias("a"), "n", F.col("bits").alias("p"), F.col("hashes").alias("x")))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "n", "m", "p", "q", "x", "y")
    return both.mapInArrow(_verify(share), "a long, b long").distinct()  # rows of a repeated id may have come twice


def _follow(up: DataFrame) -> DataFrame:
    """(node, root) from pointers (node, root), one for each node, that run in no circle."""
    while True:
        ahead = up.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        up = common.store(up.join(ahead, "root", "left").select("node", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), light=True)
        still = up.where("moved").isEmpty()
        up = up.select("node", "root")
        if still:
            return up


def weak_bands(found: list[int]) -> frozenset[int]:
    """Bands with a set whose sketch has too few nonempty blocks; there each hash is a block of its own."""
    return frozenset(b for b in range(31) if any(w >> b & 1 for w in found))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", popular_keys: int = 1 << 16) -> DataFrame:
    """(id, n_shingles, component_id): exact Jaccard links of 0.8 or more between word-shingle sets.

    Equal texts are one set. A text is cut into shingles once; its set (six bytes a shingle) and its
    sketch are stored, dealt by name. All sets' keys are shuffled as packed blocks per bucket and
    counted; a set keeps the first d + 1 in the common order, if others have them. Candidates come
    in turns. First, every set is paired with the least odd of the centres of its keys, which is one
    pair for each set; pairs whose sizes and sketches' Hamming distance allow a link are verified on
    whole sets, and components are taken. While keys are left that several components have and stars
    join much, components get stars alike; at last all pairs across components are tried. After that
    every candidate pair was either tried or lies inside one component, so no link that would join
    two is lost. `popular_keys` bounds the broadcast list of keys that are frequent within tasks
    (8 bytes each); these are not shuffled to be counted, and any list gives the same result.

    Edge cases: null, empty or wordless texts have an empty set, 0, and link with nothing. Rows
    that repeat an id: one row per id; with other texts, the text of the least hash counts. A null
    id is dropped; ids are cast to long, and one that cannot be raises. No rows give no rows. Other
    columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__doc"), common.as_bytes(F.col(text_col)).alias("__text"))
    named = named.select("__doc", "__text", F.struct(F.xxhash64("__text").alias("h1"), F.xxhash64(F.lit(1), "__text").alias("h2")).alias("__h"))
    members = common.store(named.groupBy("__doc").agg(F.min("__h").alias("h")).select(F.col("__doc").alias("doc"), "h.h1", "h.h2"), light=True)
    reps = common.store(members.groupBy("h1", "h2").agg(F.min("doc").alias("rep")), light=True)
    # dealt by the id alone, so that what a task writes is one bucket of the table: an equality, however
    # negated, would become a second key of the exchange, so the hashes are compared by XOR
    one = reps.select("rep", F.col("h1").alias("__r1"), F.col("h2").alias("__r2"))
    same = (F.col("__h.h1").bitwiseXOR(F.col("__r1")) == 0) & (F.col("__h.h2").bitwiseXOR(F.col("__r2")) == 0)
    texts = named.join(one.hint("merge"), (F.col("__doc") == F.col("rep")) & same, "left_semi").select("__doc", "__text")
    kinds = "rep long, n long, weak int, key long, bits binary, hashes binary"
    stored = common.store(texts.mapInArrow(_sets(8, popular_keys // 8), kinds), free=True, by="rep")
    sets = stored.where("rep is not null")

    total, found = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_set("weak")).first()
    loose = weak_bands(found)
    popular = stored.where("rep is null").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(popular_keys).select("key").collect()
    popular = np.sort(np.array([r[0] for r in popular], dtype=np.int64).astype(np.uint64))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4_000_000 + 1)
    emitted = sets.where("n > 0").select("rep", "n", "hashes").mapInArrow(
        _emit(spark.sparkContext.broadcast(popular), buckets, loose), "bucket int, keys binary, heads binary, sure binary"
    )
    counted = emitted.groupBy("bucket").applyInArrow(_count_keys(buckets), "bucket int, heads binary, sure binary, shared binary")
    rooted = chosen = common.store(counted.groupBy("bucket").applyInArrow(_choose, BLOCK), free=True)

    roots: DataFrame | None = None
    gain = True
    while True:
        first = roots is None
        if not first:
            both = chosen.unionByName(roots.mapInArrow(_roots_by_bucket(buckets), BLOCK))
            rooted = common.store(both.groupBy("bucket").applyInArrow(_attach, BLOCK))
        tops = rooted.mapInArrow(_tops(buckets, first), "bucket int, src int, block binary")
        tops = common.store(tops.groupBy("bucket").applyInArrow(_centres(first), f"{BLOCK}, pairs long, entries long"))
        left, entries = tops.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
        if not left:
            break
        met = rooted.unionByName(tops.select("bucket", "kind", "block"))
        stars = first or gain and left > MANY * entries
        if stars:
            pairs = common.store(met.groupBy("bucket").applyInArrow(_star(SHARE), "a long, b long"), light=True)
        else:
            met = met.unionByName(sets.where("n > 0").select("rep", "bits").mapInArrow(_bits_by_bucket(buckets), BLOCK))
            dealt = met.groupBy("bucket").applyInArrow(_deal(buckets), BLOCK)
            pairs = common.store(dealt.groupBy("bucket").applyInArrow(_cross(SHARE), "a long, b long").distinct())
        links = common.store(links_of(pairs, sets), free=True)
        if first:
            roots = _follow(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
        else:
            n = links.count()
            gain = 5 * n >= pairs.count()
            if n:
                roots = _joined(roots, links)
        if not stars:
            break

    group = sets.where("n > 0").select("rep", "n").distinct()
    if roots is not None:
        group = group.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("root"))
        group = common.store(group, light=True)
        least = common.store(group.groupBy("root").agg(F.min("rep").alias("least")), light=True)
        group = group.join(least, "root").select("rep", "n", "least")
    else:
        group = group.select("rep", "n", F.col("rep").alias("least"))
    group = common.store(reps.join(group, "rep").select("h1", "h2", "n", "least"), light=True)
    out = members.join(group, ["h1", "h2"], "left")
    return out.select(F.col("doc").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` after further links, which are contracted to the present roots first."""
    to = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"__{c}"))
    ends = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"))
    more = components(ends)
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("__next")), "root", "left")
    return common.store(moved.select("node", F.coalesce("__next", "root").alias("root")).unionByName(more.where("node <> root")), light=True)


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), sym AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(x, r) AS (
  SELECT a, b FROM sym UNION SELECT reach.x, sym.b FROM reach JOIN sym ON reach.r = sym.a
), low AS (
  SELECT x, min(r) AS r FROM reach GROUP BY x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.r, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = w.doc_id
"""
