import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberloom.functions import codes, strings, vectors
from emberloom.operators import corpus, evaluation, graph, merge, retrieval, risk, sampling


def test_code_sets(spark):
    df = spark.createDataFrame([([" g1234 ", "G1234", "S12", None],)], "c array<string>")
    assert df.select(codes.clean_codes(F.col("c"))).first()[0] == ["G1234"]
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(codes.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def test_spelling_v1(spark):
    def keys(c):
        return strings.spelling_keys(F.transform(strings.tokens(F.col(c)), strings.jamo))

    df = spark.createDataFrame([("스타벅스", "스타박스", 0.889), ("XSR", "XSL", 2 / 3), ("", "x", 0.0)], "a string, b string, s double")
    for r in df.select(strings.spelling_similarity(keys("a"), keys("b")).alias("got"), "s").collect():
        assert r["got"] == pytest.approx(r["s"], abs=6e-4)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.dot("a", "b"), vectors.unit("a"), vectors.is_unit("b")).collect()
    assert [r[0] for r in rows] == [3.0, 0.0, None, None] and rows[0][1] == pytest.approx([0.6, 0.8]) and rows[0][2] is True


def brute_auc(s, y, w):
    pairs = [(wi * wj, 1.0 if a > b else 0.5 if a == b else 0.0) for a, p, wi in zip(s, y, w) if p == 1 for b, q, wj in zip(s, y, w) if q == 0]
    return sum(x * v for x, v in pairs) / sum(x for x, _ in pairs)


def test_auc(spark):
    rng = np.random.default_rng(1)
    s, y, w = rng.integers(0, 9, 80) / 8, rng.integers(0, 2, 80), rng.random(80)
    rows = [(float(a), int(b), float(c)) for a, b, c in zip(s, y, w)] + [(None, 1, 1.0), (float("nan"), 0, 1.0)]
    df = spark.createDataFrame(rows, "score double, y int, w double")
    assert evaluation.auc(df).first()["auc"] == pytest.approx(brute_auc(s, y, np.ones(80)))
    assert evaluation.auc(df, weight=F.col("w")).first()["auc"] == pytest.approx(brute_auc(s, y, w))
    assert evaluation.auc(df.where("y = 1")).first()["auc"] is None


def test_thresholds_and_grades(spark):
    df = spark.createDataFrame([(k / 100, int(k > 40)) for k in range(100)], "score double, y int")
    assert evaluation.precision_threshold(df, 0.8, 30).first()["threshold"] == pytest.approx(0.27, abs=0.02)
    cuts = evaluation.grade_cuts(df).first()
    assert cuts["caution"] < cuts["review"] < cuts["risk"]
    assert evaluation.calibration(df.withColumnRenamed("score", "p")).count() == 10


def scalar_risk(f):
    seen = {a: f[a] is not None and not math.isnan(f[a]) for a in ("x1_d", "x2_text_d", "x3_d", "x2_whole", "x4")}
    seen["x3_d"] = seen["x3_d"] and f["has_meaning_both"]
    v = {a: f[a] if s else 0.0 for a, s in seen.items()}
    none = 0.0 if f["has_distinctive_a"] and f["has_distinctive_b"] else 1.0
    figure = f["mark_type"] in risk.FIGURE_FAMILY
    key = "+".join(a for a in ("x2_whole", "x4") if seen[a]) or "base"
    if not seen["x1_d"] and not seen["x2_text_d"] and seen["x2_whole"]:
        key = "noname:" + key
    icpt, w = risk.BLOCKS[key]
    terms = [v["x1_d"], v["x2_text_d"], v["x3_d"], none, 0 if figure else v["x1_d"], v["x1_d"] * none, v["x2_whole"], v["x2_whole"] if figure else 0, v["x4"]]
    z = icpt + sum(a * b for a, b in zip(w, terms))
    p = 1 / (1 + math.exp(-z))
    grade = sum(p >= c for c in risk.CUTS.get(key, risk.CUTS["named"]))
    if any(seen[a] and v[a] >= t for a, t in risk.STANDALONE.items()) or (figure and seen["x2_whole"] and v["x2_whole"] >= risk.FIGURE_RULE):
        grade = max(grade, 2)
    return key, p, grade, z


def test_risk_model(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(200):
        x = [None if rng.random() < 0.3 else float(np.round(rng.random(), 3)) for _ in range(5)]
        rows.append((k, *x, *(bool(b) for b in rng.integers(0, 2, 3)), ["text", "figure", "combined-figure", None][k % 4]))
    rows.append((200, float("nan"), None, None, 0.95, None, True, True, True, "figure"))
    names = "id int, x1_d double, x2_text_d double, x3_d double, x2_whole double, x4 double, has_meaning_both boolean, has_distinctive_a boolean, has_distinctive_b boolean, mark_type string"
    got = {r["id"]: r for r in risk.score(spark.createDataFrame(rows, names)).collect()}
    for row in rows:
        f = dict(zip([n.split()[0] for n in names.split(", ")], row))
        r = got[f["id"]]
        key, p, grade, z = scalar_risk(f)
        assert (r["pattern"], r["grade"]) == (key, grade) and r["p"] == pytest.approx(p) and sum(r["contributions"].values()) == pytest.approx(z)
        assert 0 <= r["rank_band"] <= 1 + 1e-6


def test_model_constraints_hold(spark):
    assert risk.coupling_violations(spark).count() == 0


def test_merge(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z"), (4, "n")], "k int, v string")
    assert {r["k"]: r["state"] for r in merge.staged(a, b, "k").collect()} == {1: "kept", 2: "unchanged", 3: "conflict", 4: "inserted"}
    with pytest.raises(Exception, match="conflicting record 3"):
        merge.merge_or_fail(a, b, "k").collect()
    fine = merge.merge_or_fail(a, b.where("k <> 3"), "k")
    assert sorted(r["k"] for r in fine.collect()) == [1, 2, 3, 4] and merge.merge_or_fail(fine, fine, "k").count() == 4
    assert {r["column"]: r["changed"] for r in merge.changed_cells(a, b, "k").collect()} == {"v": 2}


def test_groups(spark):
    rows = [(k, f"p{k // 2}") for k in range(9)] + [(k, f"q{(k + 1) // 2}") for k in range(9)] + [(100, None), (101, "alone"), (None, "p0")]
    got = {r["node"]: r["root"] for r in graph.groups_by_shared_key(spark.createDataFrame(rows, "node int, key string"), "node", "key").collect()}
    assert got == {**{k: 0 for k in range(9)}, 100: 100, 101: 101}


def test_sampling(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 1), ("d", 0)], "key string, size bigint")
    for n in (3, 10, 40, 81, 200):
        got = {r["key"]: r["quota"] for r in sampling.largest_remainder(sizes, n, "key").collect()}
        assert sum(got.values()) == min(n, 81) and all(1 <= q for q in got.values()) and "d" not in got


def test_tiers_and_stats(spark):
    e = spark.createDataFrame([(1, "bolt", ["x"]), (2, "big bolt", ["bolt nut", "bolt"]), (3, "nut", ["a bolt"]), (4, None, None)], "entry_id int, name string, aliases array<string>")
    assert [(r["entry_id"], r["tier"], r["via_alias"]) for r in retrieval.tiered_search(e, "BOLT").collect()] == [(1, 0, False), (2, 1, True), (3, 2, True)]
    t = spark.createDataFrame([("A b1 cc", "o"), ("a B1 CC", "o"), ("cc dd", "p"), (None, "q")], "title string, owner string")
    assert {r["token"]: (r["a"], r["n"]) for r in corpus.token_stats(t).collect()} == {"cc": (2, 2)}


def test_sources_and_sinks(spark, tmp_path):
    from emberloom.sources import readers, sinks

    (tmp_path / "t.txt").write_text("a¶¶b¶¶c\n1¶¶ ¶¶x¶¶extra\n2¶¶y\n\n")
    got = readers.delimited(spark, str(tmp_path / "t.txt"), "¶¶", ["a", "b", "c"]).collect()
    assert [tuple(r) for r in got] == [("1", None, "x"), ("2", "y", None)]
    (tmp_path / "x.xml").write_text("<r><item><no>1</no><codes>G1| |G2</codes></item><item><no>2</no></item></r>")
    got = readers.xml_items(spark, str(tmp_path / "x.xml"), "item", ["no", "codes"], ("codes",)).collect()
    assert [tuple(r) for r in got] == [("1", ["G1", "G2"]), ("2", [])]
    (tmp_path / "d.json").write_text(json.dumps({"marks": [{"application_no": "4020200000001", "nice_classes": [9]}], "info": {}}))
    assert readers.json_records(spark, str(tmp_path / "d.json"), "marks", readers.MARK).first()["nice_classes"] == [9]
    root = str(tmp_path / "out")
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int").coalesce(1).write.parquet(str(source / "1"))
    spark.createDataFrame([(2, "c", 2)], "k int, v string, version int").coalesce(1).write.parquet(str(source / "2"))
    stream = spark.readStream.schema("k int, v string, version int").option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    sinks.merge_stream(stream, root, "k", "version", str(tmp_path / "cp")).awaitTermination()
    assert {(r["k"], r["v"]) for r in sinks.latest(spark, root).collect()} == {(1, "a"), (2, "c")}


def test_streaming_counts(spark, tmp_path):
    from emberloom.streaming import quota

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("event_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp").parquet(str(tmp_path / "e"))
    q = quota.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(calls) from days").first()[0] == events.count()
