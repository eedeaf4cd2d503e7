from emberloom.operators import goods


def test_matching_cascade(spark):
    m = spark.createDataFrame([("fresh apple", 31, ["G1"]), ("Apple Juice", 32, ["G2"]), ("red wine glass set", 21, ["G3"]), ("phone", 9, ["G4"])], "name string, nice_class int, codes array<string>")
    items = spark.createDataFrame(
        [(1, 31, "fresh apple"), (2, 32, "APPLE-JUICE"), (3, 5, "apple juice"), (4, 9, "phonecase"), (5, 21, "set red glass wine"), (6, 9, "unknown thing"), (7, None, "")], "item int, nice_class int, name string"
    )
    got = {r["item"]: (r["codes"], r["method"]) for r in goods.match_goods(items, m, ("case",)).collect()}
    assert got == {1: (["G1"], "exact"), 2: (["G2"], "key_in_class"), 3: (["G2"], "key"), 4: (["G4"], "suffix"), 5: (["G3"], "tokens"), 6: (None, None), 7: (None, None)}


def test_texts_and_presets(spark):
    t = spark.createDataFrame([(1, "first; 제9류 phone, tablet; class 25: shirt"), (2, None)], "k int, text string")
    assert [(r["nice_class"], r["name"]) for r in goods.split_goods_text(t, "k", "text").orderBy("pos").collect()] == [(None, "first"), (9, "phone"), (9, "tablet"), (25, "shirt")]
    p = spark.createDataFrame([(2, "cafe", ["coffee shop"]), (1, "coffee", None), (3, "x", None)], "pos int, label string, aliases array<string>")
    assert [r["pos"] for r in goods.preset_match(p, "Coffee").collect()] == [1, 2] and goods.preset_match(p, " ").count() == 0


def test_name_check(spark):
    items = spark.createDataFrame([(1, "Abc ", "filed"), (2, "x", "registered"), (3, "abc", "registered"), (4, None, None)], "pos int, title string, status string")
    s = goods.name_summary(items, "ABC", total=10).first()
    assert (s["exact"], s["exact_registered"], s["registered"], s["complete"], s["state"]) == (2, 1, 2, False, "exact_registered")
    assert [r["pos"] for r in goods.check_priority(items, "abc").collect()] == [3, 1, 2, 4]
    assert goods.name_summary(items.limit(0), "abc").first()["state"] == "none"


def test_dedupe_plan(spark):
    rows = spark.createDataFrame(
        [(1, "p", "a", ""), (2, "p", "a", "g"), (3, "p", "b", "g"), (4, "p", "a", ""), (5, "q", "a", "g"), (6, "p", None, "h")], "no int, pair string, x string, y string"
    )
    got = {r["no"]: (r["kept"], r["unverified"]) for r in goods.dedupe_plan(rows, ["pair"], "no", ["x", "y"]).collect()}
    assert got == {1: (1, ""), 2: (1, "y"), 3: (3, ""), 4: (1, ""), 5: (5, ""), 6: (1, "x;y")}
