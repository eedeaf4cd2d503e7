"""Registered queries answer for their whole tables, whatever ids these have."""

import numpy as np

from emberloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_searches_take_every_hundredth_row_as_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    asked = [i for i in ids if i % 100 == 0]
    got = {}
    for r in catalogue.vector_topk(spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    assert sorted(got) == asked
    for q in asked:
        best = sorted((v @ v[ids.index(q)]).tolist(), reverse=True)[:20]
        assert np.allclose([got[q][k] for k in range(1, 21)], best, atol=2e-6)
    for name in ("visual_status", "knn_label_vote"):
        assert sorted({r["query_id"] for r in catalogue.QUERIES[name](spark, SF).collect()}) == asked
    assert catalogue.retrieval_metrics(spark, SF).first()["n"] == len(asked)
    parts = [r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    assert {r["query_id"] for r in catalogue.search_flagship(spark, SF).collect()} == {p for p in parts if p % 100 == 0}


def test_goods_pairs_cover_all_suppliers(spark):
    sf = "/root/testdata/sf0.01"
    l, p = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part"))
    sets = {}
    for r in l.join(p, l["l_partkey"] == p["p_partkey"]).select("l_suppkey", "p_brand").distinct().collect():
        sets.setdefault(r[0], set()).add(r[1])
    keys = sorted(sets)
    want = {(a, b, len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4)) for a in keys for b in keys if a < b and sets[a] & sets[b]}
    got = [tuple(r) for r in catalogue.goods_jaccard_pairs(spark, sf).select("l_key", "r_key", "both", "jaccard").collect()]
    assert len(got) == len(want) > 60 * 59 // 2 and set(got) == want


def test_goods_pairs_of_equal_and_different_sets(spark, monkeypatch):
    from pyspark.sql import functions as F

    from emberloom.operators import retrieval

    sets = {k: ["a", "b", "c"] for k in range(40)} | {k: ["c", "d"] for k in range(20, 60, 3)} | {100: ["a"], 101: ["z"], 102: [], 103: ["a", "a"], 104: ["d", "a", "b"]}
    rows = spark.createDataFrame([*sets.items(), (None, ["a"]), (105, None)], "k bigint, codes array<string>")
    want = sorted((a, b, len(x), round(len(x) / len(set(sets[a]) | set(sets[b])), 4)) for a in sets for b in sets if a < b and (x := set(sets[a]) & set(sets[b])))
    for chunk in (retrieval.CHUNK, 7):
        monkeypatch.setattr(retrieval, "CHUNK", chunk)
        assert sorted(tuple(r) for r in retrieval.pairs_within(rows, "k", "codes").collect()) == want
    made = spark.createDataFrame([(k, list("abcdefghij")) for k in range(300)], "k bigint, codes array<string>")
    pairs = retrieval.pairs_within(made, "k", "codes")
    assert pairs.count() == 300 * 299 // 2 and [tuple(r) for r in pairs.agg(F.min("both"), F.max("both"), F.min("jaccard")).collect()] == [(10, 10, 1.0)]
