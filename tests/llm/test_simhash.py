import random

import numpy as np
import xxhash

from emberloom.llm import simhash as sh
from emberloom.llm.components import components


def brute_fingerprint(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(30)] + ["É", " x", "Ab"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(40, 120))) for _ in range(12)]
    rows = []
    for i in range(150):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i * 7 % 151, " \n".join(w), "clash", "c"))
    rows += [(500, None, "", ""), (501, "  ", "", ""), (502, "a b", "", ""), (502, "a b", "", ""), (None, rows[0][1], "", ""), (None, "alone here now", "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id string").repartition(3)
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    want = sorted((str(i), "%016x" % f, str(c)) for i, f, c in zip(ids, fps, brute_components(ids, fps)))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in sh.near_duplicates(docs).collect()) == want


def test_large_subtrees_and_more_blocks_lose_no_link(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = set()
    for _ in range(600):
        x = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    want = {s: c for s, c in zip(signed, brute_components(signed, fps))}
    for chunk in (4096, 16, 1):
        found = {r["node"]: r["root"] for r in components(sh.links(frame, 4, chunk)).collect()}
        assert {s: found.get(s, s) for s in signed} == want


def test_frontier_is_cut(monkeypatch):
    rng = np.random.default_rng(2)
    v = np.unique(rng.integers(0, 2**20, 400, dtype=np.uint64) << np.uint64(3))
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(np.bitwise_count(v[i] ^ v[j])) <= 4}
    for limit in (50, 10**6):
        monkeypatch.setattr(sh, "FRONTIER", limit)
        got = {(min(i, j), max(i, j)) for a, b in sh.trie_links(v, np.zeros(len(v), int), 0) for i, j in zip(a.tolist(), b.tolist())}
        assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sh.near_duplicates(none).count() == 0
