import hashlib
import random

import numpy as np

from emberloom.llm import parsing as lcp


def text(rng, n):
    return "".join(rng.choices("abcdefghij é漢\n", k=n))


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(1)
    common = text(rng, 600)
    a, b = text(rng, 101) + common + text(rng, 57), text(rng, 38) + common + text(rng, 90)

    def names(t, level):
        x = np.array([ord(c) + 1 for c in t], np.uint64)
        owner = np.zeros(len(x), int)
        for _ in range(level):
            x, owner = lcp.phrases(x, owner)
        return x.tolist()

    for level, least in ((1, 150), (2, 45), (3, 10)):
        assert len(set(names(a, level)) & set(names(b, level)) & set(names(common, level))) >= least


def test_phrases_are_short_and_batching_changes_nothing():
    rng = random.Random(2)
    texts = [text(rng, rng.randint(0, 900)) for _ in range(60)] + ["", "a", "aa", "ab", "a" * 3000, "ab" * 2000, "\ud800x"]
    together = lcp.fingerprints(texts)
    assert together == [lcp.fingerprints([t])[0] for t in texts]
    x, owner = lcp.phrases(np.array([ord(c) + 1 for c in text(rng, 5000)], np.uint64), np.zeros(5000, int))
    assert 5000 / 5 < len(x) < 5000 / 1.8
    assert lcp.likeness(together[0], together[0]) == 1 and lcp.likeness("", together[0]) == 0 and lcp.likeness("", "") == 1


M64 = (1 << 64) - 1


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & M64
    return x ^ x >> 31


def plain_level(names):
    """One level on a list of names, name by name."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x if n == 1 else plain_mix((x * 3 + n) & M64) for x, n in runs]
    label = names
    for _ in range(4):
        step = []
        for k, x in enumerate(label):
            differ = x ^ (label[k - 1] if k else x ^ M64)
            low = (differ & -differ).bit_length() - 1
            step.append(2 * low + (x >> low & 1))
        label = step
    cuts = [k for k in range(len(names)) if k == 0 or (0 < k < len(names) - 1 and label[k] > label[k - 1] and label[k] >= label[k + 1])]
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(names)]):
        total = sum(plain_mix((names[k] + plain_mix((k - a + 0x9E3779B97F4A7C15) & M64)) & M64) for k in range(a, b)) & M64
        out.append(plain_mix(total))
    return out


def plain_fingerprint(text):
    if not text:
        return ""
    names, found = [ord(c) + 1 for c in text], []
    for level in range(1, lcp.LAST_LEVEL + 1):
        names = plain_level(names)
        if level >= lcp.FIRST_LEVEL or len(names) < 2:
            found += names
    least = {}
    for x in found:
        key = plain_mix(x)
        least[key >> 58] = min(least.get(key >> 58, M64), key & (1 << 58) - 1)
    out = []
    for b in range(lcp.BINS):
        step = next(d for d in range(lcp.BINS) if (b + d) % lcp.BINS in least)
        value = least[(b + step) % lcp.BINS]
        out.append((plain_mix((value + step) & M64) if step else value) & 0xFFFF)
    return "".join(f"{x:04x}" for x in out)


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / lcp.BINS


def test_fingerprints_against_plain_parsing():
    rng = random.Random(8)
    texts = [text(rng, rng.choice([0, 1, 2, 3, 5, 9, 40, 300, 1500])) for _ in range(80)] + ["a" * 500, "ab" * 300, "aab" * 200, "\U0001f600é" * 30]
    assert lcp.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_very_long_text_is_parsed_whole():
    rng = random.Random(10)
    t = text(rng, 3_000_000)
    a, b = lcp.fingerprints([t, t[:-1000] + text(rng, 1000)])
    assert lcp.likeness(a, b) > 0.9


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        f, g, h = (plain_fingerprint(x) for x in (t, e, nxt))
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.choice([0, 1, 3, 50, 400, 3000]))) for i in rng.sample(range(500), 90)] + [(7000, None), (7001, "x"), (7001, "x"), (None, "null id")]
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id bigint, text string, part string, place string").repartition(4)
    assert sorted((str(r[0]), *r[1:]) for r in lcp.neighbour_fingerprints(docs).collect()) == brute(rows)


def test_one_and_none(spark):
    one = spark.createDataFrame([(5, "alone " * 40)], "doc_id bigint, text string")
    assert [tuple(r) for r in lcp.neighbour_fingerprints(one).collect()] == [(5, *brute([(5, "alone " * 40)])[0][1:])]
    assert lcp.neighbour_fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_edited_texts_are_nearer_than_next_ones(spark):
    from emberloom.llm import queries

    got = queries.op9_fingerprints(spark, "/root/testdata/sf0.001").where("n_chars > 200").collect()
    edited = sorted(r["near_edited"] for r in got)
    other = sorted(r["near_next"] for r in got)
    assert edited[len(edited) // 20] > 0.3 and edited[len(edited) // 2] > 0.5 and other[len(other) * 8 // 10] < 0.3
