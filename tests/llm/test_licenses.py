import math
import re
from collections import Counter

from emberloom.llm import licenses as lic


def brute(rows, threshold=lic.THRESHOLD, every=False):
    lines = [line for _, _, t in rows for line in (t or "").split("\n")]
    df = Counter(t for x in lines for t in set(re.findall(lic.TERM, x.lower())))

    def idf(n):
        return math.log((1 + len(lines)) / (1 + n)) + 1

    mean = sum(n * idf(n) for n in df.values()) / sum(df.values()) if df else 1.0

    def w2(t):
        return (idf(df[t]) if t in df else mean) ** 2

    def best(text, whole=False):
        own = set(re.findall(lic.TERM, text.lower()))
        out = []
        for name, template in lic.TEMPLATES + lic.TEXTS * whole:
            t = set(lic.terms_of(template))
            if own:
                out.append((round(sum(map(w2, own & t)) / math.sqrt(sum(map(w2, own)) * sum(map(w2, t))), 9), name))
        top = max((s for s, _ in out), default=0)
        return next(((s, n) for s, n in out if s == top), None)

    own = {}
    for i, (key, path, text) in enumerate(rows):
        found = [best(x) for x in (text or "").split("\n")]
        if text and (path or "").rsplit("/", 1)[-1].split(".")[0].lower() in lic.LICENSE_FILES:
            found.append(best(text, True))
        found = [f for f in found if f and f[0] >= threshold]
        own[i] = min(((-s, n) for s, n in found), default=None)
    stated = {}
    for i, (key, path, text) in enumerate(rows):
        named = (path or "").rsplit("/", 1)[-1].split(".")[0].lower() in lic.LICENSE_FILES
        if own[i] and (every or named):
            d = (path or "").rpartition("/")[0]
            stated.setdefault(d, []).append(own[i][1])
    out = []
    for i, (key, path, text) in enumerate(rows):
        name, origin, d = own[i] and own[i][1], None, (path or "").rpartition("/")[0]
        while not own[i]:
            if d in stated:
                name, origin = min((-stated[d].count(n), n) for n in stated[d])[1], d
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        out.append((str(key), str(path), str(own[i] and own[i][1]), str(name), str(origin)))
    return sorted(out)


def rows():
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    out = [
        (1, "LICENSE", "MIT License\n\n" + mit),
        (2, "a/b/LICENSE.txt", gpl + "\n" + "of the " * 40),
        (3, "a/b/c/x.py", "print(1)"),
        (4, "a/y.py", "the of license"),
        (5, "z.py", None),
        (6, None, "x"),
        (7, "a/b/c/own.py", "# licensed under the APACHE license, version 2.0\ncode"),
        (8, "q/r/COPYING", ""),
        (9, "q/r/s.py", "no\n" * 3000 + mit),
        (9, "q/r/s.py", "no\n" * 3000 + mit),
        (None, "q/r/t.py", "word " * 30000),
        (11, "q/NOTICE", "Licensed under CC BY-NC 4.0."),
        (12, "q/r/é.py", "Licensed under CC BY-NC-ND 4.0"),
        (13, "v/LICENSE.md", "\n".join(["Copyright (c) someone", *re.findall(".{1,70}(?: |$)", dict(lic.TEXTS)["MIT"])])),
        (14, "v/w/f.c", "int x;"),
        (15, "z/COPYING", dict(lic.TEXTS)["BSD-2-Clause"].replace(". ", ".\n")),
        (16, "z/notes.txt", dict(lic.TEXTS)["Zlib"]),
    ]
    return out


def test_against_brute_force(spark):
    files = spark.createDataFrame([(*r, "clash") for r in rows()], "key bigint, path string, text string, dir string").repartition(3)
    for every in (False, True):
        got = lic.scan(files, every_statement=every).collect()
        assert sorted((str(r["key"]), str(r["path"]), str(r["own_license"]), str(r["license"]), str(r["inherited_from"])) for r in got) == brute(rows(), every=every)


def test_anchors_lose_no_line():
    weights = lic.Weights(1000, {"the": 900, "under": 500, "license": 30, "licensed": 30})
    anchors = set(weights.anchors(0.8))
    for _, template in lic.TEMPLATES:
        own = lic.terms_of(template)
        rest = [t for t in own if t not in anchors]
        assert weights.norm(rest) < 0.8 * weights.norm(own)


def test_empty(spark):
    assert lic.scan(spark.createDataFrame([], "key bigint, path string, text string")).count() == 0


def test_query_on_its_table(spark):
    from emberloom.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()

    def path(r):
        d = r["doc_id"]
        parts = [r["source"]] + ([str(d // 1000)] if d % 1000 else []) + ([str(d // 100)] if d % 100 else [])
        return "/".join(parts) + ("/LICENSE." if d % 100 == 0 else "/") + f"{d}.txt"

    got = queries.op2_licenses(spark, "/root/testdata/sf0.001").collect()
    want = brute([(r["doc_id"], path(r), r["text"]) for r in docs], every=True)
    assert sorted((str(r["doc_id"]), r["path"], str(r["own_license"]), str(r["license"]), str(r["inherited_from"])) for r in got) == want
    assert any(w[2] != "None" for w in want)


def test_planted_notices_are_found_alike_at_several_sizes(spark):
    planted = ["All rights reserved.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]
    common = "all right is the work this under version general public released reserved rights of in a".split()
    for n in (300, 3000, 30000):
        lines = [" ".join([common[(7 * k + j * j) % len(common)] for j in range(6)] + [f"w{k % 97}", f"v{k % 89}"]) for k in range(n)]
        rows = [(k, f"d{k}/x.txt", "\n".join(lines[k * 10 : k * 10 + 10] + [planted[k // 10 % 3]] * (k % 10 == 0))) for k in range(n // 10)]
        got = {r["key"]: r["own_license"] for r in lic.scan(spark.createDataFrame(rows, "key bigint, path string, text string")).collect()}
        assert all(got[k] == (["Proprietary", "MIT", "GPL-3.0"][k // 10 % 3] if k % 10 == 0 else None) for k in got), n


def test_other_words_weigh_by_their_true_frequency(spark):
    texts = ["project notes"] * 400 + ["plain line"] * 400 + ["released by the people under a license"] * 200 + ["Released under the MIT License. project"] * 20 + ["Released under the MIT License. zyx"]
    files = spark.createDataFrame([(k, f"d{k}/x", t) for k, t in enumerate(texts)], "key bigint, path string, text string")
    score = {r["key"]: r["own_score"] for r in lic.scan(files, threshold=0.1).collect()}
    own = {"released", "under", "the", "mit", "license"}
    df = {w: sum(w in re.findall(lic.TERM, t.lower()) for t in texts) for w in own | {"project", "zyx"}}
    w2 = {w: (math.log((1 + len(texts)) / (1 + c)) + 1) ** 2 for w, c in df.items()}
    dot = sum(w2[w] for w in own)
    for key, word in ((1000, "project"), (1020, "zyx")):
        assert score[key] == round(dot / math.sqrt(dot * (dot + w2[word])), 9)
