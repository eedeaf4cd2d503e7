"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: each shard (a run of documents inside one
input partition) holds its own dictionary and, per term, the sorted list of
positions where the term stands. Shards are rows of a Parquet table in the
shared folder, so an index serves any number of benchmarks and a lost executor
costs a re-read. Test windows are looked up from their globally rarest term:
its postings, shifted by the term's offset, are the candidate starts, and each
next-rarest term's shifted list is intersected with what is left.

Benchmarks are taken in blocks of at most ``BLOCK_CHARS`` characters; only one
block is on the driver or broadcast at a time, whatever the benchmark's size.

Defined results: null or wordless text has no words and no hits; repeated rows
are each answered; a null item text has no windows; items with a null id have
windows like any other and together count as one item, which the digest of ids
leaves out; an empty benchmark leaves every document clean; other columns of the
inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialise

#: Words a window has.
WINDOW = 10
#: Words a shard holds at least, unless its partition ends before.
SHARD_WORDS = 400_000
#: Bytes of a row group of the stored index: readers hold one at a time.
GROUP_BYTES = 4_000_000
#: Characters of benchmark text looked up in one pass over the index.
BLOCK_CHARS = 4_000_000
#: Candidate starts intersected at once.
CANDIDATES = 250_000

#: A-Z become a-z, other ASCII signs that end a word become blanks.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c
    for c in range(256)
)

INDEX_SCHEMA = (
    "shard string, doc_ids array<bigint>, doc_words binary, terms array<binary>, "
    "term_starts binary, positions binary"
)
_INDEX_ARROW = pa.schema(
    [
        ("shard", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_words", pa.binary()),
        ("terms", pa.list_(pa.binary())),
        ("term_starts", pa.binary()),
        ("positions", pa.binary()),
    ]
)
MATCH_SCHEMA = (
    "shard string, ordinal int, doc_id bigint, n_words bigint, "
    "spans array<struct<lo:int,hi:int>>, items array<string>"
)
_SPAN = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
_MATCH_ARROW = pa.schema(
    [
        ("shard", pa.string()),
        ("ordinal", pa.int32()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(_SPAN)),
        ("items", pa.list_(pa.string())),
    ]
)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


#: Numbers of the index, one after the other in a binary column: neither side takes them apart one by one.
_INT = np.dtype("<i4")


def _ints(column) -> np.ndarray:
    return np.frombuffer(column, _INT)


def _index_batches(batches):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    made = 0

    def flush(ids, lengths, chunks, dictionary):
        nonlocal made
        tokens = np.concatenate(chunks) if chunks else np.zeros(0, np.int32)
        order = np.argsort(tokens, kind="stable").astype(_INT)
        starts = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(dictionary)))]).astype(_INT)
        row = [f"{part}-{made}", ids, np.array(lengths, _INT).tobytes(), list(dictionary), starts.tobytes(), order.tobytes()]
        made += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([v], type=f.type) for v, f in zip(row, _INDEX_ARROW, strict=True)], schema=_INDEX_ARROW
        )

    def fresh():
        return [], [], [], defaultdict(count().__next__)

    ids, lengths, chunks, dictionary = fresh()
    total = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = words(text.as_py())
            ids.append(doc_id)
            lengths.append(len(own))
            if own:
                chunks.append(np.fromiter(map(dictionary.__getitem__, own), np.int32, len(own)))
                total += len(own)
            if total >= SHARD_WORDS:
                yield flush(ids, lengths, chunks, dictionary)
                ids, lengths, chunks, dictionary = fresh()
                total = 0
    if ids:
        yield flush(ids, lengths, chunks, dictionary)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional inverted index: one row for each shard."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # row groups are looked at after each row, as rows are long
    return materialise(rows.mapInArrow(frugal(_index_batches), INDEX_SCHEMA), "postings", **{"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1})


def test_blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """Yield the benchmark as lists of (item id, words), each of about block_chars at most.

    Items are dealt to blocks by a hash of their id; the number of blocks
    follows the benchmark's size, so what is collected at once does not grow.
    """
    items = bench.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], words(r["text"])) for r in part.collect()]


class TestWindows:
    """The distinct windows of a block, grouped by length, terms numbered in the block."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int = WINDOW):
        numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, own) in enumerate(items):
            if not own:
                continue
            ids = [numbers.setdefault(w, len(numbers)) for w in own]
            for i in range(max(1, len(ids) - width + 1)):
                found.setdefault(tuple(ids[i : i + width]), set()).add(k)
        self.terms = list(numbers)
        self.by_length = []
        for size in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == size]
            owners = [sorted(found[w]) for w in own]
            self.by_length.append(
                (
                    np.array(own, np.int64),
                    np.array([x for o in owners for x in o], np.int64),
                    np.cumsum([0, *map(len, owners)]),
                )
            )

    def rank(self, frequency: dict[bytes, int]) -> None:
        """Fix, for each window, the order of its offsets from the rarest term on."""
        freq = np.array([frequency.get(t, 0) for t in self.terms], np.int64)
        self.by_length = [
            (w, owner, at, np.argsort(freq[w], axis=1, kind="stable"), freq[w].min(axis=1) > 0)
            for w, owner, at in self.by_length
        ]


def term_frequency(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Corpus frequency of a block's terms, summed over the shards on the executors."""
    wanted = index.sparkSession.sparkContext.broadcast(frozenset(terms))

    def counts(batches):
        total: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for names, starts in zip(batch.column(0), batch.column(1), strict=True):
                at = _ints(starts.as_buffer())
                for k, term in enumerate(names.as_py()):
                    if term in wanted.value:
                        total[term] += int(at[k + 1] - at[k])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = index.select("terms", "term_starts").mapInArrow(frugal(counts), "term binary, n bigint")
    return {bytes(r["term"]): r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}


class _Shard:
    """One row of the index, with its postings keyed for intersection."""

    def __init__(self, row: dict, block_terms: list[bytes]):
        self.doc_words = _ints(row["doc_words"]).astype(np.int64)
        self.doc_starts = np.concatenate([[0], np.cumsum(self.doc_words)])
        starts = _ints(row["term_starts"])
        local = {t: k for k, t in enumerate(row["terms"])}
        own = np.array([local.get(t, -1) for t in block_terms], np.int64)
        known = np.flatnonzero(own >= 0)
        self.length = np.zeros(len(block_terms), np.int64)
        self.length[known] = starts[own[known] + 1] - starts[own[known]]
        positions = _ints(row["positions"])
        parts = [positions[starts[own[k]] : starts[own[k] + 1]].astype(np.int64) for k in known]
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.positions = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # sorted by (term, position): membership in any term's list is one binary search
        self.span = max(1, int(self.doc_starts[-1])) + WINDOW
        self.keys = np.repeat(np.arange(len(block_terms)), self.length) * self.span + self.positions

    def holds(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(at), bool)
        key = term * self.span + at
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[found] == key

    def phrase_starts(self, windows: np.ndarray, order: np.ndarray):
        """Yield (window numbers, start positions) of all exact occurrences."""
        size = windows.shape[1]
        rarest = windows[np.arange(len(windows)), order[:, 0]]
        sizes = self.length[rarest]
        live = np.flatnonzero(sizes)
        bounds = np.searchsorted(np.cumsum(sizes[live]), np.arange(CANDIDATES, sizes.sum() + CANDIDATES, CANDIDATES), side="left")
        for chunk in np.split(live, np.unique(np.minimum(bounds + 1, len(live)))):
            if not len(chunk):
                continue
            n = sizes[chunk]
            window = np.repeat(chunk, n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[self.first[rarest[window]] + within] - order[window, 0]
            doc = np.searchsorted(self.doc_starts, start, side="right") - 1
            keep = (start >= 0) & (start + size <= self.doc_starts[np.minimum(doc + 1, len(self.doc_words))])
            window, start = window[keep], start[keep]
            for k in range(1, size):
                if not len(start):
                    break
                at = order[window, k]
                keep = self.holds(windows[window, at], start + at)
                window, start = window[keep], start[keep]
            if len(start):
                yield window, start


def _shards(batches, terms):
    for batch in batches:
        for k in range(batch.num_rows):
            row = {
                name: batch.column(name)[k].as_buffer()
                if name in ("doc_words", "term_starts", "positions")
                else batch.column(name)[k].as_py()
                for name in batch.schema.names
            }
            yield row, _Shard(row, terms)


def phrase_matches(index: DataFrame, block: TestWindows) -> DataFrame:
    """Per document of the index: hit word spans (merged) and the items with a window in it."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        tests = shared.value
        for row, shard in _shards(batches, tests.terms):
            n_docs, n_words = len(shard.doc_words), int(shard.doc_starts[-1])
            delta = np.zeros(n_words + 1, np.int32)
            pairs = []
            for windows, owner, at, order, possible in tests.by_length:
                some = np.flatnonzero(possible)
                for window, start in shard.phrase_starts(windows[some], order[some]):
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + windows.shape[1], -1)
                    doc = np.searchsorted(shard.doc_starts, start, side="right") - 1
                    key = np.unique(some[window] * n_docs + doc)
                    w, d = key // n_docs, key % n_docs
                    n = at[w + 1] - at[w]
                    item = owner[np.repeat(at[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    pairs.append(np.unique(np.repeat(d, n) * len(tests.names) + item))
            hit = np.concatenate([[0], (np.cumsum(delta)[:n_words] > 0).astype(np.int8), [0]])
            hit_docs: dict[int, list] = defaultdict(list)
            change = np.diff(hit)
            for lo, hi in zip(np.flatnonzero(change > 0), np.flatnonzero(change < 0), strict=True):
                # a run may go on over a document's end into hits of the next one
                d = int(np.searchsorted(shard.doc_starts, lo, side="right")) - 1
                while lo < hi:
                    end = min(hi, int(shard.doc_starts[d + 1]))
                    if lo < end:
                        base = int(shard.doc_starts[d])
                        hit_docs[d].append({"lo": int(lo) - base, "hi": int(end) - base})
                    lo, d = end, d + 1
            items: dict[int, list] = defaultdict(list)
            for key in np.unique(np.concatenate(pairs)) if pairs else ():
                items[int(key) // len(tests.names)].append(tests.names[int(key) % len(tests.names)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * n_docs, pa.string()),
                    pa.array(np.arange(n_docs), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(shard.doc_words, pa.int64()),
                    pa.array([hit_docs.get(k, []) for k in range(n_docs)], pa.list_(_SPAN)),
                    pa.array([items.get(k, []) for k in range(n_docs)], pa.list_(pa.string())),
                ],
                schema=_MATCH_ARROW,
            )

    return index.mapInArrow(frugal(search), MATCH_SCHEMA)


def proximity_matches(index: DataFrame, bench: DataFrame, span: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, position): places whose next ``span`` words on both sides hold all
    distinct terms of one of the item's windows, in any order, found from the rarest term."""
    made = None
    for items in test_blocks(bench, id_col, text_col):
        tests = TestWindows(items)
        tests.rank(term_frequency(index, tests.terms))
        shared = index.sparkSession.sparkContext.broadcast(tests)

        def search(batches, shared=shared):
            tests = shared.value
            for row, shard in _shards(batches, tests.terms):
                found = set()
                for windows, owner, at, order, _ in tests.by_length:
                    for k in range(len(windows)):
                        terms = list(dict.fromkeys(windows[k][order[k]].tolist()))
                        if not all(shard.length[t] for t in terms):
                            continue
                        lists = [shard.positions[shard.first[t] : shard.first[t + 1]] for t in terms]
                        here = lists[0]
                        doc = np.searchsorted(shard.doc_starts, here, side="right") - 1
                        low = np.maximum(here - span, shard.doc_starts[doc])
                        high = np.minimum(here + span, shard.doc_starts[doc + 1] - 1)
                        ok = np.ones(len(here), bool)
                        for other in lists[1:]:
                            ok &= np.searchsorted(other, low) < np.searchsorted(other, high, side="right")
                        for d, p in zip(doc[ok], here[ok] - shard.doc_starts[doc[ok]], strict=True):
                            found.update((int(d), int(x), int(p)) for x in owner[at[k] : at[k + 1]])
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_ids"][d] for d, _, _ in rows], pa.int64()),
                        pa.array([tests.names[x] for _, x, _ in rows], pa.string()),
                        pa.array([p for _, _, p in rows], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "position"],
                )

        part = index.mapInArrow(frugal(search), "doc_id bigint, item_id string, position bigint")
        made = part if made is None else made.unionByName(part)
    if made is None:
        return index.sparkSession.createDataFrame([], "doc_id bigint, item_id string, position bigint")
    return made.distinct()


def _merged_length(spans):
    """Words covered by an array column of spans that may overlap."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(acc["end"], s["lo"]))).cast("int").alias("n"),
            F.greatest(acc["end"], s["hi"]).cast("int").alias("end"),
        ),
    )
    return step["n"]


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted distinct), contaminated; one row per document row."""
    index = build_index(docs, id_col, text_col) if index is None else index
    parts = []
    for items in test_blocks(bench):
        tests = TestWindows(items)
        tests.rank(term_frequency(index, tests.terms))
        parts.append(phrase_matches(index, tests))
    if not parts:
        parts.append(phrase_matches(index, TestWindows([])))
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("shard", "ordinal").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
        )
    return found.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        _merged_length(F.col("spans")).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from contamination()'s."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def sha256_of_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n),
m AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = g.s),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  coalesce(t.s, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
