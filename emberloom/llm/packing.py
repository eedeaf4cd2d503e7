"""Packing into token windows by bounded-space online best fit.

Each input partition keeps ``OPEN`` windows. A document is cut into full
windows and a rest; the rest goes to the open window it fits best, and when
none fits, the fullest is emitted: filled up from the rest if more than
``SLACK`` tokens are free. What is open at a partition's end is merged in
rounds over ``FAN_IN`` partitions each until one group is left.

The first pass is written to the shared folder, so documents are tokenized
once, and sequence ids, which derive from partition and order, stay fixed when
executors are lost.

Defined results: null and empty text is the end id alone; a text of any length
is cut into full windows and a rest; of equally full windows the one opened last
takes a rest, and of equally full ones to emit the first goes; every row is
packed by itself, repeated ids included; other columns are ignored, whatever
their names; no rows give no pieces.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, kept, materialise
from .tokens import PATTERN, Kept, byte_alphabet, chunks, ids_are_ranks, plain_byte_level

#: Tokens of a sequence at most.
SEQUENCE = 1024
#: Windows a partition keeps open.
OPEN = 32
#: Free tokens at which a window is emitted without being filled up.
SLACK = 0
#: Partitions whose open windows are merged in one task.
FAN_IN = 64
#: Chunks whose ids a worker keeps, in each of two generations.
KEPT = 300_000
#: Signs on whose kind all Unicode versions agree: Latin and its punctuation, as a regex class.
PLAIN = "\\x00-\u024f\u2010-\u2027"

#: ids is filled only in windows that are still open.
PIECES = "seq string, closed boolean, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint, ids binary"
_ARROW = pa.schema(
    [
        ("seq", pa.string()),
        ("closed", pa.bool_()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, chunk by chunk from a kept table.

    The table is filled by the file's vocabulary as ranks, which gives the
    library's ids where the file cuts texts by ``PATTERN`` and its ids stand
    in the order of its merges; both are checked when it is loaded, and any
    other file goes to its own library as a whole. So do chunks with special
    strings or with signs outside ``PLAIN``, where the two libraries' Unicode
    tables may differ.
    """

    def __init__(self, path: str, end_id: int = 0):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = np.array([end_id], "<u4").tobytes()
        self.by_ranks = plain_byte_level(spec) and ids_are_ranks(spec)
        if not self.by_ranks:
            return
        byte_of = byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte_of for c in token)}
        special = {t["content"] for t in spec["added_tokens"]}
        for content in special:
            ranks.pop(content.encode(), None)
        self.special = re.compile("|".join([*map(re.escape, sorted(special)), f"[^{PLAIN}]"]))
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept = Kept(self._fresh, KEPT)

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        out = []
        odd = self.special.search
        encode = self.ranks.encode_ordinary
        for c in chunks:
            ids = self.library.encode(c, add_special_tokens=False).ids if odd(c) else encode(c)
            out.append(pack_ids(ids))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_ranks:
            return [pack_ids(e.ids) + self.end for e in self.library.encode_batch(texts, add_special_tokens=False)]
        cut = [chunks(t) for t in texts]
        known = self.kept.of(set().union(*cut)).__getitem__
        return [b"".join(map(known, own)) + self.end for own in cut]


def encoder(path: str, end_id: int) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return kept(("packing", path, end_id), lambda: Encoder(path, end_id))


def pack_ids(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


class Packer:
    """The open windows of one task. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, name: str, size: int = SEQUENCE, windows: int = OPEN, slack: int = SLACK):
        self.name, self.size, self.limit, self.slack = name, size, windows, slack
        self.open: list[tuple[int, list]] = []  # tokens used, pieces
        self.made = 0

    def rows(self, pieces: list, closed: bool) -> Iterator[tuple]:
        seq, at = f"{self.name}-{self.made}", 0
        self.made += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield seq, closed, doc, start, n, zlib.crc32(ids), total, at, None if closed else ids
            at += n

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        full = self.size * 4
        while len(ids) >= full:
            yield from self.rows([(doc, start, ids[:full], total)], True)
            start, ids = start + self.size, ids[full:]
        while ids:
            n = len(ids) // 4
            fits = [(used, k) for k, (used, _) in enumerate(self.open) if used + n <= self.size]
            if fits:
                used, k = max(fits)
                self.open[k][1].append((doc, start, ids, total))
                if used + n == self.size:
                    yield from self.rows(self.open.pop(k)[1], True)
                else:
                    self.open[k] = (used + n, self.open[k][1])
                return
            if len(self.open) < self.limit:
                self.open.append((n, [(doc, start, ids, total)]))
                return
            used, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
            free = self.size - used
            if free > self.slack:
                pieces.append((doc, start, ids[: free * 4], total))
                start, ids = start + free, ids[free * 4 :]
            yield from self.rows(pieces, True)

    def rest(self) -> Iterator[tuple]:
        for _, pieces in self.open:
            yield from self.rows(pieces, False)
        self.open = []

    def last(self) -> Iterator[tuple]:
        """Close all: the windows are filled up one from another, so that one stays short at most."""
        pieces = [p for _, own in sorted(self.open, key=lambda x: -x[0]) for p in own]
        self.open, now, used = [], [], 0
        for doc, start, ids, total in pieces:
            while ids:
                take = min(len(ids), (self.size - used) * 4)
                now.append((doc, start, ids[:take], total))
                start, ids, used = start + take // 4, ids[take:], used + take // 4
                if used == self.size:
                    yield from self.rows(now, True)
                    now, used = [], 0
        if now:
            yield from self.rows(now, True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _first_pass(rows: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    def pack(batches):
        from pyspark import TaskContext

        own_encoder, packer = encoder(path, end_id), Packer(f"0-{TaskContext.get().partitionId()}", size)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(ids), 500):
                made: list[tuple] = []
                for doc, own in zip(ids[lo : lo + 500], own_encoder.encode(texts[lo : lo + 500]), strict=True):
                    made += packer.add(doc, 0, own, len(own) // 4)
                yield _batch(made)
        yield _batch(list(packer.rest()))

    return rows.mapInArrow(frugal(pack, "packing"), PIECES)


def _merge(left: DataFrame, level: int, groups: int, size: int) -> DataFrame:
    """Merge the open windows of FAN_IN partitions (of the level before) in each task."""

    def merge(key, table):
        packer = Packer(f"{level}-{key[0].as_py()}", size)
        made: list[tuple] = []
        rows = sorted(table.to_pylist(), key=lambda r: ([int(x) for x in r["seq"].split("-")], r["offset"]))
        for r in rows:
            made += packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        made += packer.last() if groups == 1 else packer.rest()
        return pa.Table.from_batches([_batch(made)])

    keyed = left.withColumn("part", F.expr(f"cast(split(seq, '-')[1] as bigint) div {FAN_IN}"))
    return keyed.groupBy("part").applyInArrow(merge, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialise(_first_pass(rows, tokenizer_path, end_id, size), "packed")
    parts = 1 + (made.agg(F.max(F.split("seq", "-")[1].cast("long"))).first()[0] or 0)
    closed, left, level = made.where("closed"), made.where("not closed"), 0
    while True:
        level += 1
        groups = -(-max(1, parts) // FAN_IN)
        merged = materialise(_merge(left, level, groups, size), "merged")
        closed = closed.unionByName(merged.where("closed"))
        if groups == 1:
            break
        left, parts = merged.where("not closed"), groups
    place = F.split("seq", "-")
    return closed.select(
        F.col("doc_id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        # level, partition and order in one number: 6, 24 and 32 bits
        (F.shiftleft(place[0].cast("long"), 56) + F.shiftleft(place[1].cast("long"), 32) + place[2].cast("long")).alias("sequence_id"),
        "offset",
    )
