"""Packing: cut token streams into pieces and fill sequences by least attention cost."""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 2048
END = 1
#: Texts of these characters alone are split alike by both libraries, whatever their Unicode tables.
PLAIN = re.compile(r"[\t\n\r -~ -ɏ‐-‧€]*\Z")
SPECIAL = "<|endoftext|>"


def vocabulary(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


@lru_cache(maxsize=2)
def _encoders(path: str):
    """(tokenizers.Tokenizer, tiktoken.Encoding or None) of the vocabulary, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    fast = None
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks_file):
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(path), fast


def encode(text: str, path: str) -> list[int]:
    """Ids as tokenizers gives them with add_special_tokens=False.

    Plain texts go through the same vocabulary as ranks, three times as fast; texts with other
    characters or with the special string go through tokenizers itself.
    """
    slow, fast = _encoders(path)
    if fast is not None and SPECIAL not in text and PLAIN.match(text):
        return fast.encode_ordinary(text)
    return slow.encode(text, add_special_tokens=False).ids


def cost(n: int, linear: float, quadratic: float) -> float:
    return linear * n + quadratic * n * n


class Open:
    """Open sequences by remaining room: the cheapest with at least some room, in steps of log2(length).

    Each room has a heap of (cost, sequence); a tree over the rooms holds the least top below each node.
    """

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.heaps: dict[int, list[tuple[float, int]]] = {}
        self.least: list[tuple[float, int] | None] = [None] * (2 * self.size)

    def _mend(self, room: int) -> None:
        x = room + self.size
        heap = self.heaps.get(room)
        self.least[x] = heap[0] if heap else None
        while x > 1:
            x //= 2
            left, right = self.least[2 * x], self.least[2 * x + 1]
            self.least[x] = left if right is None or left is not None and left < right else right

    def add(self, room: int, spent: float, s: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (spent, s))
        self._mend(room)

    def take(self, room: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest sequence with `room` or more, which is open no longer."""
        best, x = None, room + self.size
        at = x
        while x >= 1:  # right-hand neighbours on the way up cover all larger rooms
            for node in (x,) if x == room + self.size else ():
                best, at = self.least[node], node
            if x % 2 == 0 and (other := self.least[x + 1]) is not None and (best is None or other < best):
                best, at = other, x + 1
            x //= 2
        return None if best is None else self._pop(at)

    def widest(self) -> tuple[float, int, int]:
        """The cheapest of the sequences with most room."""
        x = 1
        while x < self.size:
            x = 2 * x + (self.least[2 * x + 1] is not None)
        return self._pop(x)

    def _pop(self, x: int) -> tuple[float, int, int]:
        while x < self.size:
            x = 2 * x if self.least[2 * x] == self.least[x] else 2 * x + 1
        room = x - self.size
        spent, s = heapq.heappop(self.heaps[room])
        self._mend(room)
        return spent, s, room


def fill(sizes: list[int], length: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Assign documents to sequences: (index, start, size, sequence, offset) for each piece.

    Documents are cut into whole sequences first. The rests, by descending cost, go to the
    sequence with the least cost (ties: the first) of all that have room; only a rest that fits
    nowhere is cut, to fill the sequence with most room. There are as few sequences as the tokens
    allow, so only one of them can stay short.
    """
    out, rests, n_seq = [], [], 0
    for i, size in enumerate(sizes):
        for at in range(0, size - length + 1, length):
            out.append((i, at, length, n_seq, 0))
            n_seq += 1
        if size % length:
            rests.append((size % length, -i))
    open_ = Open(length)
    for s in range(-(-sum(n for n, _ in rests) // length)):
        open_.add(length, 0.0, s)
    for n, i in sorted(rests, reverse=True):
        i, at = -i, sizes[-i] - n
        while n:
            spent, s, room = open_.take(n) or open_.widest()
            cut = min(n, room)
            out.append((i, at, cut, n_seq + s, length - room))
            if room > cut:
                open_.add(room - cut, spent + cost(cut, linear, quadratic), s)
            at, n = at + cut, n - cut
    return out


def _pack(path: str, length: int, linear: float, quadratic: float, block_tokens: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()),
         ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_to", pa.int64()), ("sequence_cost", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        done = 0
        held: list[tuple[int, int, int, np.ndarray]] = []  # id, ids before, tokens of the document, ids

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done, held
            pieces = fill([len(x[3]) for x in held], length, linear, quadratic)
            used: dict[int, int] = {}
            spent: dict[int, float] = {}
            for _, _, n, s, _ in pieces:
                used[s] = used.get(s, 0) + n
                spent[s] = spent.get(s, 0.0) + cost(n, linear, quadratic)
            short = {s for s, n in used.items() if n < length} if not last else set()
            rows, kept = [], []
            names = {s: base + done + k for k, s in enumerate(sorted(set(used) - short))}
            for i, at, n, s, offset in pieces:
                doc, before, total, ids = held[i]
                part = ids[at : at + n]
                if s in short:
                    kept.append((doc, before + at, total, part))
                    continue
                full = used[s]
                raw = part.tobytes()
                rows.append((doc, before + at, n, raw, zlib.crc32(raw), total, names[s], offset, full if full & (full - 1) == 0 else length, spent[s]))
            done += len(names)
            held = kept
            rows.sort(key=lambda r: (r[6], r[7]))
            for k in range(0, len(rows), 2000):
                yield common.batch_of(schema, **dict(zip(schema.names, zip(*rows[k : k + 2000]))))

        size = 0
        for batch in batches:
            for doc, text in zip(*common.columns(batch, "__doc", "__text")):
                ids = np.array([*encode(text or "", path), END], dtype="<u4")
                for at in range(0, len(ids), block_tokens):  # a text longer than a block is held in parts
                    held.append((doc, at, len(ids), ids[at : at + block_tokens]))
                    size += len(held[-1][3])
                    if size >= block_tokens:
                        yield from flush(False)
                        size = sum(len(x[3]) for x in held)
        if held:
            yield from flush(True)

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    block_tokens: int = 1 << 20,
) -> DataFrame:
    """Pack every document's ids and the end id into sequences of at most `length` tokens.

    One row per piece: doc_id, start, length, ids (little-endian 32-bit), ids_crc32, doc_tokens,
    sequence_id, offset, padded_to, sequence_cost (the sum of its pieces' costs). The cost of a piece is linear * n + quadratic * n^2; pieces,
    dearest first, go to the cheapest of all sequences with room. Each task packs its own rows in blocks
    of `block_tokens` (the bound on its memory) and carries a short last sequence to the next
    block, so a task leaves one short sequence at most; no row moves between tasks. A sequence
    that ends at a power of two is not padded.

    Edge cases: null or empty text is the end id alone. Rows that repeat an id are packed each
    on its own. A null id is kept as null; ids are cast to long, and one that cannot be raises. No
    rows give no rows. Other columns are not read, whatever their names.
    """
    common.small_batches(docs.sparkSession)
    path = tokenizer or vocabulary()
    named = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    kinds = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, sequence_cost double"
    out = named.mapInArrow(_pack(path, length, linear, quadratic, block_tokens), kinds)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).drop("ids")
