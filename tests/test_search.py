import pytest
from pyspark.sql import functions as F

from emberloom.operators import distinct, search


def test_pair_generic():
    a, b = [("alpha", 0.9), ("coffee", 0.1)], [("beta", 0.8), ("coffee", 0.1)]
    assert distinct.pair_generic(a, b) == {"coffee"}
    assert distinct.pair_generic([("coffee", 0.1)], b) == {"coffee"} and distinct.pair_generic([("coffee", 0.1)], [("shop", 0.2)]) == set()
    shared = [("x", 0.9), ("coffee", 0.1), ("shop", 0.1)]
    assert distinct.pair_generic(shared, [("y", 0.9), ("coffee", 0.1), ("shop", 0.1)]) == set()
    assert distinct.pair_generic([("x", 0.9), ("sun", 0.1), ("light", 0.1)], [("sunlight", 0.9)]) == set()


def test_judgement(spark):
    tokens = spark.createDataFrame([(t, None, None) for t in ("famous", "desc", "rel", "apple", "ab", "coined", "")] + [("rel", None, [9]), ("apple", ["G1234"], None), ("apple", ["G9999"], [1])], "token string, goods array<string>, classes array<int>")
    stats = spark.createDataFrame([("coined", 5, 10)], "token string, a bigint, n bigint")
    words = spark.createDataFrame([("rel", 3.0)], "token string, zipf double")
    descriptive = spark.createDataFrame([("desc", True, None), ("rel", False, [9])], "token string, absolute boolean, classes array<int>")
    goods = spark.createDataFrame([("apple", [31], ["G1234"])], "token string, classes array<int>, codes array<string>")
    got = {(r["token"], str(r["goods"]), str(r["classes"])): (r["score"], r["reasons"]) for r in distinct.judged(tokens, stats, words, descriptive, goods, famous=["famous"]).collect()}
    n = "None"
    assert got["famous", n, n][0] == 1 and got["desc", n, n] == (0, ["descriptive"]) and got["rel", n, n][0] == 0.5 and got["rel", n, "[9]"][0] == 0
    assert got["apple", n, n][0] == 0 and got["apple", "['G1234']", n][0] == 0 and got["apple", "['G9999']", "[1]"][0] == 1
    assert got["ab", n, n] == (0, ["simple"]) and got["coined", n, n][0] == pytest.approx(0.75) and got["", n, n][0] == 0


def test_search(spark):
    marks = spark.createDataFrame(
        [(1, "스타벅스 coffee", ["G1234"], [1.0, 0.0]), (2, "스타박스", ["G1234", "S12345"], [0.6, 0.8]), (3, None, ["S12345"], [0.0, 1.0]), (4, "other", None, None)],
        "id int, title string, codes array<string>, embedding array<float>",
    )
    queries = spark.createDataFrame(
        [(1, "스타벅스", ["g1234", "bad"], [1.0, 0.0], "text"), (2, None, None, [0.0, 1.0], "figure"), (3, "other", None, None, None), (4, None, None, None, "text")],
        "query_id int, name string, goods array<string>, embedding array<float>, mark_type string",
    )
    stats = spark.createDataFrame([("coffee", 50, 100)], "token string, a bigint, n bigint")
    words = spark.createDataFrame([("coffee", 5.5)], "token string, zipf double")
    found = search.candidates(queries, marks, stats, words, 5)
    got = {(r["query_id"], r["id"]): r for r in found.collect()}
    assert got[1, 1]["x1_d"] == 1 and got[1, 1]["removed"] == ["coffee"] and got[1, 1]["rank"] == 1 and got[1, 1]["x4"] == 1 and got[1, 1]["grade"] == 3
    assert got[1, 3]["x1_d"] is None and got[1, 3]["pattern"].startswith("noname:")
    assert got[2, 3]["grade"] >= 2 and got[2, 3]["figure_caveat"] and (4, 1) not in got
    assert got[3, 4]["x2_whole"] is None and got[3, 4]["pattern"] == "base"
    overall = {r["query_id"]: r["overall_grade"] for r in search.overall(found).collect()}
    assert overall[1] == 3 and set(overall) == {1, 2, 3}
    nested = search.shown(found).where(F.col("query_id") == 1).orderBy("rank").first()["candidate"]
    assert nested["risk"]["grade"] == "risk" and nested["axes"]["x1"] == 1
    with pytest.raises(ValueError):
        search.candidates(queries, marks, stats, words, 21)


def test_meaning_photo_and_nameless_floor(spark):
    marks = spark.createDataFrame(
        [(1, "blue sky", None, [1.0, 0.0], [0.8, 0.6], True), (2, "zorbix", None, [1.0, 0.0], [1.0, 0.0], False)],
        "id int, title string, codes array<string>, embedding array<float>, title_vector array<float>, has_meaning boolean",
    )
    queries = spark.createDataFrame(
        [(1, "sea wind", [0.95, 0.3122], "figure", [1.0, 0.0], True, False, True), (2, "sea wind", [0.95, 0.3122], "text", [1.0, 0.0], True, True, False)],
        "query_id int, name string, embedding array<float>, mark_type string, name_vector array<float>, has_meaning boolean, photo boolean, nameless_floor boolean",
    ).withColumn("goods", F.lit(None).cast("array<string>"))
    none = spark.createDataFrame([], "token string, a bigint, n bigint"), spark.createDataFrame([], "token string, zipf double")
    got = {(r["query_id"], r["id"]): r for r in search.candidates(queries, marks, *none, 5, baseline=0.3).collect()}
    assert got[1, 1]["x3_d"] == pytest.approx(0.7143) and got[1, 2]["x3_d"] is None and got[2, 1]["x3_d"] == pytest.approx(0.7143)
    assert got[1, 1]["nameless_floor"] and got[1, 1]["pattern"] == "noname:x2_whole" and got[1, 1]["x2_whole"] == pytest.approx(0.95)
    assert got[2, 1]["x2_whole"] is None and got[2, 1]["pattern"] == "base" and not got[2, 1]["nameless_floor"]


def test_repeated_names_and_sets_bring_k_ids_each(spark):
    """The pools equal brute force, and marks are cut to the k least ids of a value before queries meet them."""
    import random

    from emberloom.operators import retrieval

    rng = random.Random(8)
    sets = [["a"], ["a", "b"], ["b", "c"], ["c", "d", "e"], []]
    marks = {i: (rng.choice(["red bolt", "red nut", "blue nut", "x"]), rng.choice(sets)) for i in rng.sample(range(1000), 300)}
    asked = {q: (rng.choice(["red bolt", "nut"]), rng.choice(sets)) for q in range(40)}
    m = spark.createDataFrame([(i, *v) for i, v in marks.items()], "id bigint, name string, codes array<string>")
    q = spark.createDataFrame([(i, *v) for i, v in asked.items()], "query_id bigint, q_name string, codes array<string>")
    named = retrieval.name_topk(q.select("query_id", "q_name"), m.select("id", "name"), F.when(F.col("name") == F.col("q_name"), 1.0).when(F.right("name", F.lit(3)) == F.right("q_name", F.lit(3)), 0.5).otherwise(0.0), 7, 0.1)
    likeness = lambda a, b: 1.0 if a == b else 0.5 if a[-3:] == b[-3:] else 0.0
    want = {(k, i, r, s) for k, (n, _) in asked.items() for r, (s, i) in enumerate(sorted(((-likeness(v[0], n), i) for i, v in marks.items() if likeness(v[0], n) >= 0.1))[:7], 1)}
    assert {(r["query_id"], r["id"], r["rank"], -r["score"]) for r in named.collect()} == want
    coded = retrieval.codes_topk(q.select("query_id", "codes"), m.select("id", "codes"), 7)
    jaccard = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 4) if set(a) & set(b) else 0
    want = {(k, i, r, -s) for k, (_, c) in asked.items() for r, (s, i) in enumerate(sorted((-jaccard(v[1], c), i) for i, v in marks.items() if jaccard(v[1], c))[:7], 1)}
    assert {(r["query_id"], r["id"], r["rank"], r["jaccard"]) for r in coded.collect()} == want
    for found, value in ((named, "name"), (coded, "m_set")):
        assert f"WindowGroupLimit [{value}#" in found._jdf.queryExecution().optimizedPlan().toString()
