"""Token counts by rank-synchronous array merging.

Chunks that a worker has not met are cut into pre-tokens, which are merged
together as one ragged array; a document's count is the sum over its chunks.
Nothing is shuffled and a worker, which keeps what it has counted from task to
task, holds about twice ``KEPT`` chunks at most. Files whose pre-tokenizer is
not the plain byte-level one are counted by their own library, text by text.

Defined results: null and empty text count 0 bytes and 0 tokens; texts of any
length are counted whole; every row is answered by itself, repeated ids
included; other columns are ignored, whatever their names; an empty table gives
no rows. There are no ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Kept, MergeTable, chunks, count_symbols

#: Chunks whose counts a worker keeps, in each of two generations.
KEPT = 300_000
#: Documents' characters merged at once.
BATCH_CHARS = 4_000_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class Counter:
    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.known = Kept(self._fresh, KEPT)

    def _fresh(self, missing: list[str]) -> list[int]:
        numbers: dict[str, int] = {}
        own, specials = [], []
        for chunk in missing:
            found, special = self.table.pretokens(chunk)
            own.append([numbers.setdefault(p, len(numbers)) for p in found])
            specials.append(special)
        n = count_symbols(list(numbers), self.table)
        sizes = n.tolist()
        return [sum(map(sizes.__getitem__, ids)) + s for ids, s in zip(own, specials, strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.table.plain:
            return [len(e.ids) for e in self.table.library.encode_batch(texts, add_special_tokens=False)]
        cut = [chunks(t) for t in texts]
        known = self.known.of(set().union(*cut)).__getitem__
        return [sum(map(known, own)) for own in cut]


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """A worker's counter, kept from task to task."""
    return Counter(path)


def _batched(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    lo, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS or k == len(texts) - 1:
            yield ids[lo : k + 1], texts[lo : k + 1]
            lo, size = k + 1, 0


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document row."""

    def count(batches):
        own = counter(tokenizer_path)
        for batch in batches:
            for ids, texts in _batched(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                        pa.array(own.counts(texts), pa.int64()),
                    ],
                    schema=_SCHEMA,
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint").select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
