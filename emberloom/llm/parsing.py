"""Document fingerprints by locally consistent parsing.

A text's code points are named, runs of one name become one, and deterministic
coin tossing cuts the names into phrases of a few names each; phrases are named
by their content and cut again. A cut depends on a handful of neighbours only,
so equal substrings have equal phrases inside, wherever they stand. The
fingerprint is a one-permutation MinHash of the phrase names of levels
``FIRST_LEVEL`` to ``LAST_LEVEL``: ``BINS`` minima of 16 bits in hexadecimal.

For the neighbour comparison, documents are dealt to id ranges and sorted there
(the only shuffle); a range's last document waits for the first of the next.

Defined results: null and empty text has the fingerprint of the empty text,
likeness 1 to another empty text and 0 to others; rows are ordered by id (null
first), then text; repeated rows are neighbours of each other; a single
document is its own next one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Levels whose phrases are sampled; a phrase of level k covers about 3 ** k code points.
FIRST_LEVEL, LAST_LEVEL = 2, 3
#: Minima of a fingerprint.
BINS = 64
#: Code points parsed together.
BATCH_CHARS = 1_000_000

_U = np.uint64
#: Odd multipliers and shifts of the 64-bit mixing of names.
_MIX = ((_U(30), _U(0xBF58476D1CE4E5B9)), (_U(27), _U(0x94D049BB133111EB)))


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in _MIX:
        x = (x ^ (x >> shift)) * factor
    return x ^ (x >> _U(31))


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: where a name first differs from the one before, and its bit there.

    Neighbours differ before and after; names of 64 bits become less than 128,
    those less than 14, those less than 8.
    """
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = ~names[first]
    differ = names ^ before
    low = np.bitwise_count((differ & (~differ + _U(1))) - _U(1)).astype(np.uint64)
    return (low << _U(1)) | ((names >> low) & _U(1))


def phrases(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names, text number of each) -> the same of the phrases."""
    if not len(names):
        return names, text
    fresh = np.empty(len(names), bool)
    fresh[0] = True
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(fresh)
    runs = np.diff(at, append=len(names)).astype(np.uint64)
    names, text = np.where(runs == 1, names[at], _mix(names[at] * _U(3) + runs)), text[at]
    n = len(names)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(text[1:], text[:-1], out=first[1:])
    # a collapsed run could only by a hash collision equal its neighbour
    label = names
    for _ in range(4):
        label = _toss(label, first)
    # local maxima cut; a plateau, which a hash collision alone could make, does not
    cut = first.copy()
    if n > 2:
        cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~first[2:]
    begin = np.flatnonzero(cut)
    place = np.arange(n) - np.repeat(begin, np.diff(begin, append=n))
    mixed = _mix(names + _mix(place.astype(np.uint64) + _U(0x9E3779B97F4A7C15)))
    return _mix(np.add.reduceat(mixed, begin)), text[begin]


def _sketch(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(n, BINS) minima; a bin that got no name takes the next bin's that did, changed by the distance."""
    empty = np.iinfo(np.uint64).max
    table = np.full(n * BINS, empty, np.uint64)
    for names, text in found:
        key = _mix(names)
        np.minimum.at(table, text * BINS + (key >> _U(58)).astype(np.int64), key & _U((1 << 58) - 1))
    table = table.reshape(n, BINS)
    out = table.copy()
    for step in range(1, BINS):
        missing = out == empty
        if not missing.any():
            break
        other = np.roll(table, -step, axis=1)
        out = np.where(missing & (other != empty), _mix(other + _U(step)), out)
    return (out & _U(0xFFFF)).astype(np.uint16)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    out: list[str] = []
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS or k == len(texts) - 1:
            out += _fingerprints(texts[lo : k + 1])
            lo, size = k + 1, 0
    return out


def _fingerprints(texts: list[str]) -> list[str]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    names, text = points + _U(1), np.repeat(np.arange(len(texts)), lengths)
    found = []
    size = np.bincount(text, minlength=len(texts))
    for level in range(1, LAST_LEVEL + 1):
        names, text = phrases(names, text)
        more = np.bincount(text, minlength=len(texts))
        if level >= FIRST_LEVEL:
            found.append((names, text))
        elif (more < 2).any():  # too short for the levels sampled: its phrases count as they are
            short = (more < 2)[text]
            found.append((names[short], text[short]))
        size = more
    del size
    minima = _sketch(len(texts), found)
    return [m.astype(">u2").tobytes().hex() if n else "" for m, n in zip(minima, lengths.tolist(), strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of equal minima of two fingerprints."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(f), np.uint16) for f in (a, b))
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = pa.schema(
    [
        ("part", pa.int32()),
        ("place", pa.string()),  # done, last (waits for the next range) or first (its text for the range before)
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
OUT_SCHEMA = (
    "part int, place string, doc_id bigint, text string, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _rows(part: int, ids: list, texts: list[str], following: list[str]):
    own = fingerprints([*texts, following[-1]])
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    after = fingerprints(changed)
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * n, pa.int32()),
            pa.array(["done"] * n, pa.string()),
            pa.array(ids, pa.int64()),
            pa.nulls(n, pa.string()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], pa.string()),
            pa.array(own[:-1], pa.string()),
            pa.array(after, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ],
        schema=_OUT,
    )


def _edge(part: int, place: str, doc_id, text: str):
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([part, place, doc_id, text, *[None] * 6], _OUT, strict=True)], schema=_OUT)


def _pieces(batches):
    """Lists of ids and texts, each about BATCH_CHARS long."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and likenesses to that and to the next document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def walk(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for ids, texts in _pieces(batches):
            if held is None:
                yield _edge(part, "first", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                yield _rows(part, ids[:-1], texts[:-1], texts[1:])
        if held is not None:
            yield _edge(part, "last", *held)

    made = materialise(dealt.mapInArrow(walk, OUT_SCHEMA), "parsed")
    done = made.where("place = 'done'")
    parts = sorted(r["part"] for r in made.where("place = 'first'").select("part").collect())  # one number for each range
    if parts:
        after = F.create_map(*[F.lit(x) for a, b in zip(parts, [*parts[1:], parts[0]], strict=True) for x in (a, b)])
        first = made.where("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
        waiting = made.where("place = 'last'").select("part", "doc_id", "text", after[F.col("part")].alias("next_part")).join(first, "next_part")

        def finish(batches):
            for batch in batches:
                for part, doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "next_text")), strict=True):
                    yield _rows(part, [doc_id], [text], [following])

        done = done.unionByName(waiting.select("part", "doc_id", "text", "next_text").mapInArrow(finish, OUT_SCHEMA))
    return done.select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
