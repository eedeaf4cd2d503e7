import random

import numpy as np

from emberloom.llm import langid


def brute_viterbi(scores, switch):
    from itertools import product

    best = max(product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])))
    return list(best)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 1, 7, 3])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    got = langid.viterbi(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        assert got[at : at + n].tolist() == brute_viterbi(scores[at : at + n], 2.0) if n else True
        at += n


def sample():
    en = "the thing with this and that is then one of them all there"
    de = "der die das und nicht eine keit ung schon ist für über sich"
    ru = "это что как так его она они мы был для все ещё"
    rng = random.Random(1)
    return [(lang, " ".join(rng.choices(ws.split(), k=60))) for lang, ws in (("en", en), ("de", de), ("ru", ru)) for _ in range(20)]


def test_spans_and_scripts(spark):
    model = langid.Model(sample())
    (lang, score, spans), = langid.Labeller(model).label(["the thing with this and that 12 ... " * 3 + "der die das und nicht eine " * 2])
    assert lang == "en" and 0.5 < score < 1 and [s[0] for s in spans] == ["en", "de"] and spans[0][1] == 0 and spans[-1][2] == 36
    texts = [None, "", "12 34", "это они", "漢字", "nicht über", "the\tthis", "x" * 100_000, "the " * 50_000]
    docs = spark.createDataFrame([(i, t, "zz", 0.0) for i, t in enumerate(texts)] + [(1, "", "", 1.0), (None, "das und", "", 1.0)], "doc_id bigint, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["und", "und", "und", "ru", model.common, "de", "en"]
    assert got[4]["score"] == 0 and got[0]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs, model).count() == len(texts) + 2


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    model = langid.fit(none)
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert [tuple(r)[:3] for r in langid.identify(docs, model).collect()] == [(1, "und", 0.0)]
    assert langid.identify(none, model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from emberloom.llm import queries

    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, total = got.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert total > 100 and right / total > 0.97


def brute_predict(samples, text):
    """(language, score, spans) from the definition: trigram counts, scripts, one dynamic programme over the words."""
    import math
    from collections import Counter
    from itertools import groupby

    names = sorted({lang for lang, _ in samples})
    grams, scripts = {x: Counter() for x in names}, {x: Counter() for x in names}

    def runs(word):
        letters = [(c, langid.script(c) if c.isalpha() else "") for c in word]
        return ["".join(c for c, _ in g) for kind, g in groupby(letters, key=lambda x: x[1]) if kind]

    for lang, t in samples:
        for word in t.lower().split():
            for run in runs(word):
                scripts[lang][langid.script(run[0])] += len(run)
                grams[lang].update(f" {run} "[k : k + 3] for k in range(len(run)))
    vocabulary = len({g for c in grams.values() for g in c}) + 1
    total = {x: sum(grams[x].values()) + vocabulary for x in names}
    uses = {x: {s for s, n in scripts[x].items() if n >= langid.SCRIPT_SHARE * sum(scripts[x].values())} for x in names}
    learned = set().union(*uses.values())
    words = (text or "").lower().split()
    table, letters, known = [], [], []
    for word in words:
        score = dict.fromkeys(names, 0.0)
        own = runs(word)
        letters.append(sum(map(len, own)))
        known.append(sum(len(r) for r in own if langid.script(r[0]) in learned))
        for run in own:
            if langid.script(run[0]) in learned:
                for x in names:
                    score[x] += sum(math.log((grams[x][f" {run} "[k : k + 3]] + 1) / total[x]) for k in range(len(run)))
                    score[x] -= 0 if langid.script(run[0]) in uses[x] else 1e6
        top = max(score.values())
        table.append({x: max(score[x] - top, -langid.WORD_NATS) for x in names})
    if not sum(letters):
        return "und", 0.0, []
    best = {x: (table[0][x], (x,)) for x in names}
    for row in table[1:]:
        step = {}
        for x in names:
            y = max(names, key=lambda y: (best[y][0] - (y != x) * langid.SWITCH, y == x))
            step[x] = (best[y][0] - (y != x) * langid.SWITCH + row[x], (*best[y][1], x))
        best = step
    labels = max(best.values(), key=lambda v: v[0])[1]
    held = Counter()
    for x, n in zip(labels, known):
        held[x] += n
    top = max(names, key=lambda x: held[x])
    cuts = [0, *[k for k in range(1, len(labels)) if labels[k] != labels[k - 1]], len(labels)]
    common = max(names, key=lambda x: (sum(lang == x for lang, _ in samples), x))
    return (top if held[top] else common), held[top] / sum(letters), [(labels[a], a, b) for a, b in zip(cuts, cuts[1:])]


def test_identify_against_brute_force(spark):
    samples = sample()
    rng = random.Random(11)
    pools = [[w for lang, t in samples if lang == x for w in t.split()] for x in ("en", "de", "ru")]
    texts = [" ".join(" ".join(rng.choices(rng.choice(pools), k=rng.randint(1, 9))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts += ["12 - 34", "漢字 the", "thing漢 это-the über9", "the", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.Model(samples)).collect()}
    for k, t in enumerate(texts):
        lang, score, spans = brute_predict(samples, t)
        assert got[k]["lang_pred"] == lang and abs(got[k]["score"] - score) < 1e-12 and [tuple(s) for s in got[k]["spans"]] == spans, t


def test_every_language_is_learned_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_TOTAL", 5_000)
    rows = [(300 * k + i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}q{i % 7}" for _ in range(5)), f"l{k:03d}") for k in range(250) for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 250
