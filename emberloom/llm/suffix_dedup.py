"""Exact substring deduplication by a common-prefix-aware distributed merge sort.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id. Not every suffix has to be sorted for that: each
window of ``LENGTH`` bytes has an anchor, the place of its least-hashed
``GRAM``-gram, and equal windows have equal anchors. Consecutive windows with
the same anchor make one record: the suffix from the anchor to the last
window's end, then what stands before it, reversed.

Texts are written once, in runs of about ``RUN_BYTES``, bucketed by run, so that
no later step moves them. A first exchange of the grams' sorted hashes finds the
grams that stand in several documents; only their records can share a window.
Each run sorts those records by the gram's hash and then by their bytes, folds
equal ones to one with the least id, front-codes each against the one before
(length of the common prefix, then the rest) and sends every range of hashes to
one task. Ranges are even parts of the hashes, so nothing is sampled and the
driver holds nothing that grows. A task merges its runs with a loser tree that
keeps each string's common prefix with the last winner: strings with different
common prefixes are never compared again, equal ones only from there on. The
common prefixes of neighbours in the merged order tell which records can share
a window with others at all; only those are looked at window by window. The
least ids found go back to the runs, which cut their own texts.

A record that stands in very many documents reaches its range once for each
run; the windows of a gram with very many records are looked at in passes.

Defined results: null and empty text has no bytes; a text of any length lies in
one run as a whole; windows never cross documents; rows of one id never remove
from each other; a null id counts as larger than all others; repeated rows get
equal results; an empty table gives no rows; other columns are ignored, also
those named like the columns used here.
"""

from __future__ import annotations

import hashlib
import io
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, frugal, materialise

#: Bytes of a string that counts as repeated.
LENGTH = 50
#: Bytes of the gram whose hash makes a window's anchor.
GRAM = 16
#: Bytes of text in one sorted run, about.
RUN_BYTES = 4_000_000
#: Bytes of text for each range of hashes, about.
RANGE_BYTES = 6_000_000
#: Window starts hashed at once.
BLOCK = 1 << 18
#: Bits of a gram's hash that order the records, and their bytes before each record.
HASH_BITS = 40
HEAD = HASH_BITS // 8
#: Windows of one gram looked at in one pass.
PASS_WINDOWS = 2_000_000
#: The id that null stands for.
LAST_ID = 2**63 - 1
#: Documents in one batch of results.
ROWS = 2_000

_U = np.uint64


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Records of concatenated documents: first window start, end of the last window, anchor; and the hashes of their grams.

    ends holds each document's end in data.
    """
    out, hashes = [], []
    width = length - gram + 1
    total = len(data)
    for lo in range(0, max(0, total - length + 1), BLOCK):
        hi = min(lo + BLOCK, total - length + 1)
        part = data[lo : hi + length - 1].astype(np.uint64)
        two = part[:-1] | part[1:] << _U(8)
        four = two[:-2] | two[2:] << _U(16)
        eight = four[:-4] | four[4:] << _U(32)
        n = len(part) - gram + 1
        h = eight[:n] * _U(0x9E3779B97F4A7C15) + eight[gram - 8 : gram - 8 + n] * _U(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        least = ((h >> _U(32)) << _U(32)) | np.arange(n, dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: n - width + 1], least[width - size : width - size + n - width + 1])
        at = (least & _U(0xFFFFFFFF)).astype(np.int64)
        # starts whose window would reach into the next document
        inside = np.ones(hi - lo, bool)
        for end in ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, hi + length, side="left")].tolist():
            inside[max(0, end - length + 1 - lo) : max(0, end - lo)] = False
        s = np.flatnonzero(inside)
        at = at[s]
        if not len(s):
            continue
        fresh = np.ones(len(s), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [len(s)]]) - 1
        out.append(np.stack([s[first], s[last] + length, at[first]]) + lo)
        own = h[at[first]]
        own = (own ^ (own >> _U(32))) * _U(0x94D049BB133111EB)
        hashes.append((own ^ (own >> _U(29))) >> _U(64 - HASH_BITS))
    if not out:
        return np.zeros((3, 0), np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out, axis=1), np.concatenate(hashes)


def _pack(values: np.ndarray) -> bytes:
    """An integer array with its bytes grouped by place, so that zeros compress away."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _blob(*parts: bytes) -> bytes:
    import zstandard

    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _parts(blob: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:4], "little")
    sizes = np.frombuffer(data, "<u4", n, 4).tolist()
    at, out = 4 + 4 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix with the key before, length of the rest) of sorted distinct keys."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    shared = np.zeros(len(keys), np.int64)
    for lo in range(1, len(keys), 50_000):
        part = keys[lo - 1 : lo + 50_000]
        n = sizes[lo - 1 : lo + 50_000]
        width = int(n.max())
        table = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in part), np.uint8).reshape(len(part), width)
        differ = np.concatenate([table[1:] != table[:-1], np.ones((len(part) - 1, 1), bool)], axis=1).argmax(axis=1)
        shared[lo : lo + len(part) - 1] = np.minimum(differ, np.minimum(n[1:], n[:-1]))
    return shared.astype(np.uint8), (sizes - shared).astype(np.uint8)


def rests(keys: list[bytes], shared: np.ndarray) -> bytes:
    """What front coding leaves of the keys."""
    return b"".join([k[c:] for k, c in zip(keys, shared.tolist(), strict=True)])


def front_decode(shared: bytes, rest: bytes, tails: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for c, n in zip(shared, rest, strict=True):
        before = before[:c] + tails[at : at + n]
        at += n
        out.append(before)
    return out


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings equal up to at."""
    n = min(len(a), len(b))
    while at < n:
        step = min(8, n - at)
        differ = int.from_bytes(a[at : at + step], "big") ^ int.from_bytes(b[at : at + step], "big")
        if differ:
            return at + step - (differ.bit_length() + 7) // 8
        at += step
    return n


def merge(runs: list[tuple[list[bytes], bytes]]):
    """Yield (run, place in run, common prefix with the string before) in sorted order over all runs.

    runs are (sorted strings, common prefix of each with the one before). The
    tree's inner nodes hold losers; known[k] is the common prefix of run k's
    string with the last string that beat it, which is all that is compared
    unless two are alike.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r for r, _ in runs] + [[]] * (k - len(runs))
    known = [0 if s else -1 for s in strings]
    now: list = [s[0] if s else None for s in strings]
    place = [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b] or known[a] < 0:
            return (a, b) if known[a] >= known[b] else (b, a)
        x, y = now[a], now[b]
        c = _common(x, y, known[a])
        if x <= y:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    level = list(range(k))
    nodes = k // 2
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            losers[nodes + i // 2] = lost
            up.append(w)
        level, nodes = up, nodes // 2
    w = level[0]
    number = int.from_bytes
    while known[w] >= 0:
        at = place[w]
        yield w, at, known[w]
        at += 1
        place[w] = at
        own = strings[w]
        if at < len(own):
            now[w] = own[at]
            known[w] = runs[w][1][at]
        else:
            known[w] = -1
        node = (w + k) >> 1
        while node:
            other = losers[node]
            a, b = known[w], known[other]
            if b > a:
                losers[node] = w
                w = other
            elif a == b and a >= 0:
                x, y = now[w], now[other]
                # the next eight bytes settle nearly all
                p, q = x[a : a + 8], y[a : a + 8]
                if len(p) == 8 == len(q) and p != q:
                    c = a + 8 - ((number(p) ^ number(q)).bit_length() + 7) // 8
                    less = p < q
                else:
                    c = _common(x, y, a)
                    less = x <= y
                if less:
                    known[other] = c
                else:
                    known[w] = c
                    losers[node] = w
                    w = other
            node >>= 1


class Run:
    """A run's documents as one stretch of bytes, its records in the order of their grams' hashes."""

    def __init__(self, blob: bytes, length: int):
        self.rows = pa.ipc.open_stream(io.BytesIO(blob)).read_all().combine_chunks()
        text = pc.fill_null(self.rows["text"], "").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.begins, self.ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        self.ids = pc.fill_null(self.rows["doc_id"], LAST_ID).to_numpy()
        self.length = length

    def sort(self) -> None:
        records, hashes = anchors(self.data, self.ends, self.length)
        order = np.argsort(hashes, kind="stable")
        self.lo, self.hi, self.at = records[:, order]
        self.hashes = hashes[order]
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.first = np.flatnonzero(np.concatenate([[True], self.hashes[1:] != self.hashes[:-1]])) if len(self.hashes) else np.zeros(0, np.int64)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> _U(HASH_BITS - 32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _cuts(values: np.ndarray) -> list[int]:
    """Bounds of the runs of equal values."""
    return [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)] if len(values) else []


def _grams(run: Run, ranges: int):
    """(range, blob) of the distinct hashes of a run's grams, with a bit for those in several of its documents."""
    run.sort()
    if not len(run.hashes):
        return
    distinct = run.hashes[run.first]
    many = np.minimum.reduceat(run.doc, run.first) != np.maximum.reduceat(run.doc, run.first)
    of = _range_of(distinct, ranges)
    cuts = _cuts(of)
    for a, b in zip(cuts, cuts[1:]):
        own = distinct[a:b]
        yield int(of[a]), _blob(_pack(np.diff(own, prepend=_U(0)).astype("<u8")), np.packbits(many[a:b]).tobytes())


def _repeated(blobs: list[bytes]) -> list[bytes]:
    """For each run's blob of a range, a bit for each of its hashes: does it stand in several documents?"""
    hashes, many, sizes = [], [], []
    for blob in blobs:
        deltas, bits = _parts(blob)
        own = np.cumsum(_unpack(deltas, "<u8"), dtype=np.uint64)
        hashes.append(own)
        sizes.append(len(own))
        many.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool))
    whole, found = np.concatenate(hashes), np.concatenate(many)
    order = np.argsort(whole, kind="stable")
    same = np.flatnonzero(whole[order][1:] == whole[order][:-1])
    found[order[same]] = True
    found[order[same + 1]] = True
    ends = np.cumsum(sizes)
    return [np.packbits(found[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes)]


def _sorted_run(run: Run, flags: list[tuple[int, bytes]], ranges: int):
    """(pieces, places) of a run: its front-coded records by range, and where each of them stands."""
    run.sort()
    distinct = run.hashes[run.first]
    cuts = _cuts(_range_of(distinct, ranges))
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for (_, b), n in zip(sorted(flags), np.diff(cuts).tolist(), strict=True)]
    kept = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    kept = np.repeat(kept, np.diff(np.concatenate([run.first, [len(run.hashes)]])))
    lo, hi, at, doc, hashes = run.lo[kept], run.hi[kept], run.at[kept], run.doc[kept], run.hashes[kept]
    if not len(lo):
        return [], b""
    data = run.data.tobytes()
    heads = hashes.astype(">u8").tobytes()
    keys = [
        heads[k + 8 - HEAD : k + 8] + data[a:e] + data[s:a][::-1] + bytes((e - a,))
        for k, s, e, a in zip(range(0, len(heads), 8), lo.tolist(), hi.tolist(), at.tolist(), strict=True)
    ]
    # records stand in the order of hashes already: only those of one gram are left to sort
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))
    order = list(range(len(keys)))
    for i, j in zip(first[:-1][np.diff(first) > 1].tolist(), first[1:][np.diff(first) > 1].tolist(), strict=True):
        order[i:j] = sorted(range(i, j), key=keys.__getitem__)
    ordered = [keys[i] for i in order]
    place = np.array(order, np.int64)
    fresh = np.flatnonzero(np.fromiter((a != b for a, b in zip(ordered, [None, *ordered])), bool, len(ordered)))
    keys = [ordered[i] for i in fresh.tolist()]
    counts = np.diff(np.concatenate([fresh, [len(place)]]))
    ids = run.ids[doc[place]]
    least = np.minimum.reduceat(ids, fresh)
    many = least != np.maximum.reduceat(ids, fresh)
    of = _range_of(hashes[place][fresh], ranges)
    shared, rest = front_code(keys)
    pieces = []
    cuts = _cuts(of)
    for a, b in zip(cuts, cuts[1:]):
        c, r = shared[a:b].copy(), rest[a:b].copy()
        c[0], r[0] = 0, len(keys[a])
        pieces.append(
            (int(of[a]), _blob(np.array([a], "<i8").tobytes(), c.tobytes(), r.tobytes(), rests(keys[a:b], c), _pack(least[a:b].astype("<i8")), np.packbits(many[a:b]).tobytes()))
        )
    begin = (lo[place] - run.begins[doc[place]]).astype("<u4")
    return pieces, _blob(_pack(counts.astype("<u4")), _pack(doc[place].astype("<u4")), _pack(begin))


class Found:
    """Stretches of windows of a run's records, each with the least id that has them."""

    def __init__(self, runs: int):
        self.rows: list[list[int]] = [[] for _ in range(runs)]

    def add(self, run: int, record: int, lo: int, hi: int, least: int) -> None:
        self.rows[run] += (record, lo, hi, least)

    def blob(self, run: int) -> bytes:
        record, lo, hi, least = np.array(self.rows[run], np.int64).reshape(-1, 4).T
        return _blob(_pack(record.astype("<i8")), lo.astype(np.uint8).tobytes(), hi.astype(np.uint8).tobytes(), _pack(least.astype("<i8")))


def merge_range(blobs: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Found:
    """Merge one range's runs and find the windows that stand in a document with a smaller id."""
    runs, base, ids, many = [], [], [], []
    for blob in blobs:
        begin, shared, rest, tails, least, bits = _parts(blob)
        runs.append((front_decode(shared, rest, tails), shared))
        base.append(int.from_bytes(begin, "little"))
        ids.append(_unpack(least, "<i8").tolist())
        many.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(shared)).tobytes())
    strings = [r for r, _ in runs]
    found = Found(len(blobs))
    least_of = gram + HEAD

    def copies(key: bytes, own: list[tuple[int, int]]) -> None:
        """A record's copies in documents after its first go whole."""
        least = min([ids[r][i] for r, i in own])
        last = len(key) - 1 - HEAD - length
        for r, i in own:
            if many[r][i] or ids[r][i] > least:
                found.add(r, base[r] + i, 0, last, least)

    def group(members: list) -> None:
        """Members (key, where it stands) share a gram and can share windows."""
        if len(members) == 1:
            copies(*members[0])
            return
        opened = []
        for key, own in members:
            right = key[-1]
            whole = key[HEAD + right : -1][::-1] + key[HEAD : HEAD + right]
            opened.append((whole, own, min([ids[r][i] for r, i in own]), [LAST_ID + 1] * (len(whole) - length + 1)))
        passes = 1 + sum(len(x[3]) for x in opened) // PASS_WINDOWS
        for k in range(passes):
            first: dict[bytes, int] = {}
            for answer in (False, True):
                for whole, _, least, seen in opened:
                    for o in range(len(seen)):
                        w = whole[o : o + length]
                        if passes > 1 and hash(w) % passes != k:
                            continue
                        if answer:
                            seen[o] = first[w]
                        elif first.get(w, LAST_ID + 1) > least:
                            first[w] = least
        for _, own, _, seen in opened:
            for a, b in zip(cuts := _cuts(np.array(seen, np.int64)), cuts[1:]):
                for r, i in own:
                    if many[r][i] or ids[r][i] > seen[a]:
                        found.add(r, base[r] + i, a, b - 1, seen[a])

    members: list = []
    key, own, near = b"", [], 0

    def settle() -> None:
        """No key has more in common with this one than its neighbours in sorted order:
        it joins its group's members only if that leaves room for a window, else only its copies count."""
        if near >= least_of:
            right = key[-1]
            if len(key) - 1 - HEAD - right + min(near - HEAD, right) >= length:
                members.append((key, own))
                return
        if len(own) > 1 or many[own[0][0]][own[0][1]]:
            copies(key, own)

    for run, at, common in merge(runs):
        string = strings[run][at]
        if common == len(string) == len(key):
            own.append((run, at))
            continue
        if common > near:
            near = common
        if own and (near >= least_of or len(own) > 1 or many[own[0][0]][own[0][1]]):
            settle()
        if common < least_of and members:
            group(members)
            members = []
        key, own, near = string, [(run, at)], common
    if own:
        settle()
    if members:
        group(members)
    return found


_DOC = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
def merged_spans(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of (lo, hi) rows that touch or overlap."""
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    top = np.maximum.accumulate(pairs[:, 1])
    fresh = np.concatenate([[True], pairs[1:, 0] > top[:-1]])
    first = np.flatnonzero(fresh)
    return list(zip(pairs[first, 0].tolist(), top[np.concatenate([first[1:], [len(pairs)]]) - 1].tolist(), strict=True))


def removals(run: Run, places: bytes, found: list[bytes]) -> dict[int, list[tuple[int, int]]]:
    """The removed stretches of a run's documents, by their place in the run."""
    if not places or not found:
        return {}
    counts, doc, begin = (_unpack(p, "<u4").astype(np.int64) for p in _parts(places))
    ends = np.cumsum(counts)
    parts = [_parts(b) for b in found]
    record, least = (np.concatenate([_unpack(p[k], "<i8") for p in parts]) for k in (0, 3))
    lo, hi = (np.concatenate([np.frombuffer(p[k], np.uint8) for p in parts]).astype(np.int64) for k in (1, 2))
    n = counts[record]
    at = np.repeat(ends[record] - np.cumsum(n), n) + np.arange(n.sum())
    gone = run.ids[doc[at]] > np.repeat(least, n)
    at, lo, hi = at[gone], np.repeat(lo, n)[gone], np.repeat(hi, n)[gone]
    # a byte between documents keeps their stretches apart
    begins = run.begins + np.arange(len(run.begins))
    base = begins[doc[at]] + begin[at]
    spans = np.array(merged_spans(np.stack([base + lo, base + hi + run.length], axis=1)), np.int64).reshape(-1, 2)
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, a, b in zip((of := np.searchsorted(begins, spans[:, 0], side="right") - 1).tolist(), (spans[:, 0] - begins[of]).tolist(), (spans[:, 1] - begins[of]).tolist(), strict=True):
        out[k].append((a, b))
    return out


def _ranged(batches):
    """(range, [(run, blob)]) of rows that come sorted by range."""
    rows = ((r, k, b) for batch in batches for r, k, b in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "blob")), strict=True))
    for r, own in groupby(rows, key=lambda x: x[0]):
        yield r, [(k, b) for _, k, b in own]


def _batch(rows: list[tuple], **kinds) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


_KINDS = {"run": pa.int64(), "range": pa.int32(), "blob": pa.binary()}
_DDL = "run bigint, range int, blob binary"


def repeated_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_bytes, removed (byte spans), kept (text, if asked for; broken characters are left out), kept_sha256.

    Columns named in carry come along, as a struct column ``carried``.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    other = F.struct(*carry) if carry else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), other.alias("carried"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = n * max(1, -(-total // (n * RANGE_BYTES)))

    def deal(batches):
        base, k, held, size = TaskContext.get().partitionId() << 20, 0, [], 0

        def ship():
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                for part in held:
                    out.write_batch(part)
            return _batch([(base + k, sink.getvalue())], run=pa.int64(), texts=pa.binary())

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                end = min(batch.num_rows, int(np.searchsorted(sizes, done + RUN_BYTES - size)) + 1)
                held.append(batch.slice(at, end - at))
                size += int(sizes[end - 1]) - done
                at = end
                if size >= RUN_BYTES:
                    yield ship()
                    k, held, size = k + 1, [], 0
        if held:
            yield ship()

    base = bucketed(rows.mapInArrow(frugal(deal), "run bigint, texts binary"), "texts", "run", n)

    def grams(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _batch([(number, r, b) for r, b in _grams(Run(blob.as_py(), length), ranges)], **_KINDS)

    def repeated(batches):
        for r, own in _ranged(batches):
            yield _batch([(k, r, b) for (k, _), b in zip(own, _repeated([b for _, b in own]), strict=True)], **_KINDS)

    def by_range(found: DataFrame, step) -> DataFrame:
        return found.repartition(n, "range").sortWithinPartitions("range").mapInArrow(frugal(step), _DDL)

    def with_runs(found: DataFrame) -> DataFrame:
        each = found.groupBy("run").agg(F.collect_list(F.struct("range", "blob")).alias("found"))
        return base.join(each.hint("merge"), "run", "left").select("run", "texts", "found")

    flags = materialise(by_range(base.mapInArrow(frugal(grams), _DDL), repeated), "flags")

    def pieces(batches):
        for batch in batches:
            for number, blob, own in zip(*batch.columns, strict=True):
                made, places = _sorted_run(Run(blob.as_py(), length), [(x["range"], x["blob"]) for x in own.as_py() or []], ranges)
                yield _batch([(number.as_py(), r, b) for r, b in made] + ([(number.as_py(), -1, places)] if places else []), **_KINDS)

    dealt = materialise(with_runs(flags).mapInArrow(frugal(pieces), _DDL), "pieces")

    def combine(batches):
        for r, own in _ranged(batches):
            found = merge_range([b for _, b in own], length)
            yield _batch([(k, r, found.blob(i)) for i, (k, _) in enumerate(own) if found.rows[i]], **_KINDS)

    found = materialise(by_range(dealt.where("range >= 0"), combine), "found")
    carried = rows.schema["carried"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for _, blob, own in zip(*batch.columns, strict=True):
                run = Run(blob.as_py(), length)
                own = own.as_py() or []
                gone = removals(run, next((x["blob"] for x in own if x["range"] < 0), b""), [x["blob"] for x in own if x["range"] >= 0])
                for at in range(0, run.rows.num_rows, ROWS):
                    part = run.rows.slice(at, ROWS).combine_chunks()
                    spans, kept = [], []
                    for k in range(at, at + part.num_rows):
                        data, cuts = run.data[run.begins[k] : run.ends[k]], gone.get(k, [])
                        spans.append([{"lo": a, "hi": b} for a, b in cuts])
                        kept.append(b"".join(data[a:b].tobytes() for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(data)], strict=True)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part["doc_id"].combine_chunks(),
                            pa.array((run.ends - run.begins)[at : at + part.num_rows], pa.int64()),
                            pa.array(spans, pa.list_(_DOC)),
                            pa.array([x.decode("utf-8", "ignore") if with_text else None for x in kept], pa.string()),
                            pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                            part["carried"].combine_chunks(),
                        ],
                        names=["doc_id", "n_bytes", "removed", "kept", "kept_sha256", "carried"],
                    )

    ddl = f"doc_id bigint, n_bytes bigint, removed array<struct<lo:bigint,hi:bigint>>, kept string, kept_sha256 string, carried {carried}"
    made = with_runs(dealt.where("range < 0").unionByName(found)).mapInArrow(frugal(cut), ddl)
    return (made if carry else made.drop("carried")).withColumnRenamed("doc_id", id_col)


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, md5(hex(b[i + 1:i + {LENGTH}])) AS w FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - {LENGTH - 1})) AS i FROM d)),
f AS (SELECT w, min(doc_id) AS m FROM s GROUP BY w),
g AS (SELECT s.doc_id, s.i FROM s JOIN f USING (w) WHERE f.m < s.doc_id),
h AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, true) AS fresh FROM g),
k AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
r AS (SELECT doc_id, min(i) AS lo, max(i) + {LENGTH} AS hi FROM k GROUP BY doc_id, run),
p AS (SELECT r.doc_id, r.lo, r.hi, hex(d.b[coalesce(lag(r.hi) OVER (PARTITION BY r.doc_id ORDER BY r.lo), 0) + 1:r.lo]) AS kept FROM r JOIN d USING (doc_id)),
q AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY lo) AS kept, max(hi) AS last FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(q.n_removed, 0) AS BIGINT) AS n_removed, coalesce(q.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN q.doc_id IS NULL THEN hex(d.b) ELSE q.kept || hex(d.b[q.last + 1:octet_length(d.b)]) END)) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""
