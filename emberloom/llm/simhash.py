"""SimHash near-duplicates by a binary-trie self-join over distinct fingerprints.

Fingerprints within ``MAX_BITS`` bits agree on at least ``blocks - MAX_BITS``
of ``blocks`` bit blocks. For each choice of so many blocks there is one trie
whose top levels are those blocks; a pair within the budget has no error there
in at least one trie, so the tries' subtrees below the top levels are joined
with themselves, each in one place. A join goes down pairs of nodes together,
adds an error whenever two nodes take different branches and drops a pair when
the errors exceed the budget. A subtree of more than ``CHUNK`` fingerprints is
dealt to a grid of chunk pairs. Subtrees report a spanning forest of their
links, never all pairs, and stars make components of those.

Defined results: null, empty and blank text has fingerprint zero and is linked
like any other; every row is answered, repeated ids included; null ids take
part in links but never name a component unless it has no other id (then null).
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialise
from .components import components

#: Words of a shingle.
SHINGLE = 4
#: Seed of XXH64.
SEED = 42
#: Bits in which linked fingerprints differ at most.
MAX_BITS = 4
#: Fingerprints of a subtree joined in one place; larger ones are dealt to a grid.
CHUNK = 4096
#: Node pairs followed at once.
FRONTIER = 400_000
#: Rows a task of the join takes, about.
TASK_ROWS = 100_000


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    own = text.encode("utf-8", "replace").lower().split() if text else []
    if not own:
        return 0
    if len(own) < SHINGLE:
        shingles = [b" ".join(own)]
    else:
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(own) - SHINGLE + 1
        shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65_536):
        part = np.unpackbits(h[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            own = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id bigint, fp bigint")


def bit_blocks(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block, from the highest bits down."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [(64 - edges[k + 1], edges[k + 1] - edges[k]) for k in range(blocks)]


def tries(blocks: int, max_bits: int) -> list[tuple[int, ...]]:
    """The choices of blocks that lead a trie."""
    return list(combinations(range(blocks), blocks - max_bits))


def _lead(values: np.ndarray, blocks: int, lead: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """The values with the leading blocks' bits moved to the top, and how many those are."""
    places = bit_blocks(blocks)
    order = [*lead, *(k for k in range(blocks) if k not in lead)]
    out = np.zeros(len(values), np.uint64)
    for k in order:
        shift, width = places[k]
        out = (out << np.uint64(width)) | ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out, sum(places[k][1] for k in lead)


def trie_links(values: np.ndarray, groups: np.ndarray, depth: int, budget: int = MAX_BITS):
    """Yield (i, j) arrays of all pairs within the budget inside the same group.

    values are sorted within groups, which are contiguous and share their top
    ``depth`` bits.
    """
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, int)
    ends = np.concatenate([begins[1:], [len(groups)]]) if len(begins) else begins
    many = ends - begins > 1
    lo, hi = begins[many], ends[many]
    stack = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        d, f = stack.pop()
        if not f.shape[1]:
            continue
        if f.shape[1] > FRONTIER:
            half = f.shape[1] // 2
            stack += [(d, f[:, half:]), (d, f[:, :half])]
            continue
        leaf = (f[1] - f[0] == 1) & (f[3] - f[2] == 1)
        if leaf.any():
            i, j = f[0][leaf], f[2][leaf]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            if near.any():
                yield i[near], j[near]
            f = f[:, ~leaf]
        if d == 64 or not f.shape[1]:
            continue
        if d not in zeros:
            bit = (values >> np.uint64(63 - d)) & np.uint64(1)
            zeros[d] = np.concatenate([[0], np.cumsum(bit == 0)])
        z = zeros[d]
        a, b, c, e, err = f
        m = a + z[b] - z[a]
        n = c + z[e] - z[c]
        alike = a == c
        parts = [
            np.stack([a, m, c, n, err]),
            np.stack([m, b, n, e, err]),
            np.stack([a, m, n, e, err + 1]),
            np.stack([m, b, c, n, err + 1])[:, ~alike],
        ]
        g = np.concatenate(parts, axis=1)
        own = (g[0] == g[2]) & (g[1] == g[3])
        g = g[:, (g[1] > g[0]) & (g[3] > g[2]) & (g[4] <= budget) & ~(own & (g[1] - g[0] == 1))]
        stack.append((d + 1, g))


def _forest(n: int, links) -> np.ndarray:
    """The least member of each element's component."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            least = np.minimum(a, b)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while not (label[label] == label).all():
                label = label[label]
    return label


def links(distinct: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): edges whose components are those of all pairs within max_bits."""
    n = distinct.count()
    # one more block each time the leading bits would no longer tell enough subtrees apart
    blocks = max_bits + 1
    while blocks < 16 and n > chunk << (64 * (blocks - max_bits) // blocks):
        blocks += 1
    leads = tries(blocks, max_bits)
    places = bit_blocks(blocks)

    def key(lead):
        out = F.lit(0).cast("long")
        for k in lead:
            shift, width = places[k]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    each = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), key(lead).alias("top")) for t, lead in enumerate(leads)])).alias("x")
    ).select("fp", "x.trie", "x.top")
    large = each.groupBy("trie", "top").agg(F.count("*").alias("size")).where(F.col("size") > chunk)
    sized = each.join(large, ["trie", "top"], "left")
    parts = F.ceil(F.coalesce("size", F.lit(1)) / F.lit(float(chunk))).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (
        sized.withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("fp", "trie", "top", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    )
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-n * len(leads) // TASK_ROWS))

    def join(batches):
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        rows = pa.Table.from_batches(rows)
        fp = rows.column("fp").to_numpy().view(np.uint64)
        columns = [rows.column(c).to_numpy() for c in ("trie", "top", "a", "b")]
        out = []
        for t in np.unique(columns[0]):
            own = np.flatnonzero(columns[0] == t)
            led, depth = _lead(fp[own], blocks, leads[t])
            order = np.lexsort([led, *(c[own] for c in columns[:0:-1])])
            own, led = own[order], led[order]
            change = np.zeros(len(own), bool)
            for c in columns[1:]:
                change[1:] |= c[own][1:] != c[own][:-1]
            label = _forest(len(own), trie_links(led, np.cumsum(change), depth, max_bits))
            moved = np.flatnonzero(label != np.arange(len(own)))
            out.append(np.stack([fp[own[moved]], fp[own[label[moved]]]]))
        both = np.concatenate(out, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

    return cells.repartition(tasks, "trie", "top", "a", "b").mapInArrow(frugal(join), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id; one row per document row."""
    own = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp", "left").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
