"""Operators whose queries SQL does not express, and small cases of the others."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberloom.functions import phonetic, strings, vectors
from emberloom.operators import cases, ingest, marks, meaning, reports, risk, selection
from emberloom.sources import readers, vector_index, xlsx
from emberloom.streaming import quota


def test_greedy_plan_is_one_brand_after_the_other(spark):
    rng = random.Random(3)
    for most in (1, 3):
        rows = [(b, b, r, i) for b in range(12) for r, i in enumerate(rng.sample(range(30), 15))]
        taken, want = set(), set()
        for b in range(12):
            own = [i for bb, _, _, i in rows if bb == b and i not in taken][:most]
            taken |= set(own)
            want |= {(b, i) for i in own}
        plan = selection.greedy_plan(spark.createDataFrame(rows, "brand int, place int, rank int, item int"), "brand", "place", "item", most)
        assert {(r["brand"], r["item"]) for r in plan.collect()} == want


def replay(calls, per_day, per_month):
    months, days, out = {}, {}, {}
    for ts, key in sorted(calls):
        day, month = ts[:10], ts[:7]
        ok = months.get(month, 0) < per_month and (per_day == 0 or days.get(day, 0) < per_day)
        months[month], days[day] = months.get(month, 0) + ok, days.get(day, 0) + ok
        out[key] = ok
    return out


def calls(n=400):
    rng = random.Random(5)
    return [(f"2026-0{rng.randint(1, 2)}-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 3):02d}:00", k) for k in range(n)]


@pytest.mark.parametrize("per_day, per_month", [(5, 30), (0, 50), (40, 1000), (3, 0)])
def test_only_granted_calls_use_a_budget(spark, per_day, per_month):
    rows = calls()
    df = spark.createDataFrame(rows, "t string, event_id bigint").select("event_id", F.to_timestamp("t").alias("ts"))
    got = {r["event_id"]: r["allowed"] for r in quota.batch_quota(df, per_day, per_month).collect()}
    assert got == replay(rows, per_day, per_month)


def test_stateful_quota_over_batches(spark, tmp_path):
    rows = sorted(calls(120))
    for k, part in enumerate((rows[:50], rows[50:90], rows[90:])):
        df = spark.createDataFrame(part, "t string, event_id bigint").select("event_id", F.to_timestamp("t").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{k}"))
    got = {}
    stream = spark.readStream.schema("event_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = (
        quota.stateful_quota(stream, 4, 25).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
        .foreachBatch(lambda df, k: got.update({r["event_id"]: r["allowed"] for r in df.collect()})).start()
    )
    query.awaitTermination(120)
    assert got == replay(rows, 4, 25)


def test_kept_counts(spark):
    df = spark.createDataFrame([("2026-01-01", "2026-01"), ("2026-02-20", "2026-02"), ("2026-02-20", "2026-02")], "day string, month string")
    got = {r["period"]: r["used"] for r in quota.kept_counts(df, F.to_date(F.lit("2026-02-21"))).collect()}
    assert got == {"2026-01": 1, "2026-02": 2, "2026-02-20": 2}


def test_weighted_allocation():
    assert cases.allocate_weighted(10, {"a": 1, "b": 1, "c": 2}, {"a": 9, "b": 9, "c": 9}) == {"a": 3, "b": 2, "c": 5}
    assert cases.allocate_weighted(10, {"a": 1, "b": 1, "c": 2}, {"a": 9, "b": 1, "c": 3}) == {"a": 6, "b": 1, "c": 3}
    assert cases.allocate_weighted(10, {"a": 0, "b": 1}, {"a": 9, "b": 4}) == {"a": 0, "b": 4}


def test_names_of_the_registry():
    same, near = phonetic.assigned_similarity, phonetic.phonetic_similarity
    coffee, gate = frozenset({"커피"}), frozenset({"gate"})
    assert same("GATE", "GATE HELLO") == pytest.approx((1 + 4 / 9) / 2) and same("BLUE BOTTLE", "BOTTLE BLUE") == 1
    assert same("커피빈", "커피 빈") == same("ROYALE BEE", "ROYALEBEE") == same("(주)스타벅스 코리아", "스타벅스") == 1
    assert same("ab cd ab", "ab cd") == pytest.approx(5 / 6) and same("★", "★") == 0
    many = " ".join(f"tok{chr(97 + i) * 2}" for i in range(12))
    assert same(many, many) == 1 and same(many, " ".join(many.split()[:6])) == pytest.approx(0.75)
    assert same("나이키", "NIKE") <= 0.3 and same("BLUE COFFEE", "RED COFFEE", coffee) <= 0.5
    assert near("게", "개") >= 0.95 and near("Hello Dream!", "DREAM") == 1 and near("Zorbix Gate", "GATE") >= 0.9 and near("Zorbix Gate", "GATE", gate) <= 0.5
    assert near("DREAM", "DREAM", frozenset({"dream"})) == 1 and near("스타벅스커피", "스타벅스") >= 0.95 and near("Zorbix Gate", "ZORBIX", gate) == 1
    assert near("BLUE COFFEE", "RED COFFEE", coffee) <= 0.5


def test_chains_pair_like_subsets():
    rng = random.Random(4)
    for _ in range(80):
        n, m = rng.randint(1, 6), rng.randint(6, 8)
        g = [[rng.choice([0, 0.2, 0.5, rng.random()]) for _ in range(m)] for _ in range(n)]
        a, b = phonetic.paired_by_subsets(g), phonetic.paired_by_chains(g)
        assert len({j for _, j in b}) == len(b) == n and sum(g[i][j] for i, j in a) == pytest.approx(sum(g[i][j] for i, j in b))


def test_hash_embedding_values():
    from hashlib import blake2b

    v = phonetic.hash_embedding("ab")
    want = np.zeros(256)
    for gram in (" ab", "ab "):
        code = int.from_bytes(blake2b(gram.encode(), digest_size=4).digest(), "big")
        want[(code >> 1) % 256] += 1 if code & 1 else -1
    assert np.allclose(v, want / np.linalg.norm(want))


def test_words_and_compounds(spark):
    table = {"하늘": 5.0, "푸르": 4.5, "바다": 5.2, "커피": 5.0, "blue": 4.0, "the": 7.0, "zq": 9.0}
    zipf = lambda t: table.get(t, 0.0)
    assert meaning.compound("하늘바다", zipf) == ("하늘", "바다") and meaning.compound("푸른하늘", zipf) == ("푸른", "하늘") and meaning.compound("하늘", zipf) is None
    assert meaning.is_word("blue", zipf) and not meaning.is_word("zq", zipf) and not meaning.is_word("12", zipf) and meaning.is_word("봄", zipf, frozenset("봄")) and not meaning.is_word("솰라", zipf)
    names = spark.createDataFrame([(1, "Blue 12"), (2, "푸른하늘"), (3, "솰라 zq"), (4, None), (5, "하늘")], "id int, name string")
    got = {r["id"]: r["has_meaning"] for r in meaning.has_meaning(names, "name", spark.createDataFrame(list(table.items()), "token string, zipf double")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}
    goods = frozenset({"커피", "아이스크림"})
    assert meaning.split_suffix("스타벅스커피 x", goods) == "스타벅스 커피 x" and meaning.split_suffix("아이스크림", goods) == "아이스크림" and meaning.split_suffix("왕커피", goods) == "왕커피"
    split = meaning.split_suffixes(spark.createDataFrame([(1, "블루커피"), (2, None)], "id int, name string"), "name", spark.createDataFrame([("커피",)], "goods_name string"))
    assert {r["id"]: r["split"] for r in split.collect()} == {1: "블루 커피", 2: ""}


def test_embedders_and_views(spark):
    meaning.register("ones", lambda: meaning.Embedder("ones", 2, lambda texts: np.ones((len(texts), 2), np.float32)))
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    assert [list(r["vector"]) for r in meaning.embedded(df, "t", "ones").collect()] == [[1.0, 1.0]] * 3
    with pytest.raises(ValueError):
        meaning.embedded(df, "t", "none")
    m = spark.createDataFrame([([[3.0, 0.0], [0.0, 2.0]],)], "v array<array<double>>").select(meaning.mean_view(F.col("v"))).first()[0]
    assert m == pytest.approx([2**-0.5, 2**-0.5])
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>")
    t = spark.createDataFrame([(7, [0.9, 0.4359]), (8, [0.0, 1.0])], "id int, v array<double>")
    assert [r["id"] for r in meaning.semantic_topk(q, t, 0.3313).collect()] == [7]


def test_read_text_and_versions(spark):
    assert meaning.read_matches("STARBUCK", "Starbucks Coffee") and meaning.read_matches("cofee", "Blue Coffee") and not meaning.read_matches("", "x") and not meaning.read_matches("qqq", "Blue")
    with pytest.raises(Exception, match="takes version 2"):
        spark.range(1).select(meaning.checked_version("2", F.lit("1"))).collect()
    tokens = spark.createDataFrame([([("a", 0.1), ("b", 0.9)], [("c", 0.2), ("a", 0.3)], ["a", "c"])], "x array<struct<token:string,score:double>>, y array<struct<token:string,score:double>>, g array<string>")
    assert [tuple(t) for t in tokens.select(meaning.removed_tokens(F.col("x"), F.col("y"), F.col("g"))).first()[0]] == [("a", "both"), ("c", "candidate")]


def test_nameless_floor_lifts_only_what_it_may(spark):
    base = dict(x1_d=0.0, x2_text_d=0.0, x3_d=None, has_meaning_both=False, x2_whole=0.89, x4=None, has_distinctive_a=True, has_distinctive_b=True, mark_type="figure")
    rows = [{**base, "id": 1, "nameless_floor": True}, {**base, "id": 2, "nameless_floor": False}, {**base, "id": 3, "nameless_floor": True, "x2_whole": None}]
    ddl = "id int, nameless_floor boolean, x1_d double, x2_text_d double, x3_d double, has_meaning_both boolean, x2_whole double, x4 double, has_distinctive_a boolean, has_distinctive_b boolean, mark_type string"
    got = {r["id"]: r for r in meaning.nameless_floor(spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl), "id").collect()}
    assert got[1]["nameless_floor"] and got[1]["pattern"] == "noname:x2_whole" and got[1]["grade"] > got[2]["grade"]
    assert not got[2]["nameless_floor"] and got[2]["pattern"] == "x2_whole" and not got[3]["nameless_floor"]


def test_areas_of_an_image(spark):
    image = np.full((40, 50, 3), 255, np.uint8)
    image[5:15, 5:25] = 0  # text
    image[20:30, 10:20] = 10  # drawing
    assert marks.areas(image, [(5, 5, 25, 15)]) == (0.1, 0.05) and marks.areas(image, []) == (0.0, 0.25) and not marks.looks_like_photo(image)
    noise = np.random.default_rng(0).integers(30, 230, (40, 40, 3)).astype(np.uint8)
    assert marks.looks_like_photo(noise)
    df = spark.createDataFrame([(bytearray(image.tobytes()), 40, 50, [(5, 5, 25, 15, 0.9), (0, 0, 50, 40, 0.1)])], "p binary, h int, w int, b array<struct<x0:int,y0:int,x1:int,y1:int,confidence:double>>")
    assert tuple(df.select(marks.area_shares("p", "h", "w", "b").alias("a")).select("a.*").first()) == (0.1, 0.05, False)


def test_conflicts_fail_before_anything_is_written(spark):
    runtime = spark.createDataFrame([(1, "a", "x", 2000)], "number int, image string, title string, year int")
    for bad in ((1, "a", "other", 2000), (2, "a", "x", 2001)):
        with pytest.raises(Exception, match="cannot promote"):
            ingest.promotion(runtime, spark.createDataFrame([bad], runtime.schema), "number", "image", F.col("year"))[0].collect()
    rows = spark.createDataFrame([(1, "유사", "human", True, None)], "case_no int, verdict string, source string, confirmed boolean, original string")
    label = spark.createDataFrame([(1, "비유사", "llm", "근거")], "case_no int, verdict string, source string, evidence string")
    with pytest.raises(Exception, match="refused"):
        ingest.labelled(rows, label, ["case_no"]).collect()
    left, manifest = ingest.quarantined({"r": runtime}, "number", F.lit(1))
    assert left["r"].count() == 0 and manifest.first()["removed"] == 1


def test_reports_small(spark):
    assert reports.monotone_violations({"x1": 0.5, "t": -0.4, "n": -0.2}, {"x1": ["t", "n"]}) == ["x1 + t + n"]
    df = spark.createDataFrame([("c%d" % (k % 9), k % 17 / 16, int(k % 17 > 8 or k % 5 == 0)) for k in range(120)], "source string, score double, y int")
    block = reports.metric_block(df, "source", 100).first()
    assert 0 < block["low"] <= block["auc"] <= block["high"] <= 1


def workbook(sheets):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({c for _, rows in sheets for r in rows for c in r if c and not c.startswith("=")})
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        for k, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="s"><v>{shared.index(c)}</v></c>' for j, c in enumerate(r) if c) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    book = workbook([("제30류", [["고시"], ["", "상품 명칭", "유사군코드"], ["", "커피", "G0301, S2001"], ["", "차", "a/b"], ["", "", "G1"]]), ("all", [["class", "name", "code"], ["30", "커피", "G9999"], ["31", "커피", "g1234"]])])
    (tmp_path / "a.xlsx").write_bytes(book)
    got = {(r["goods_name"], r["nice_class"]): r["codes"] for r in xlsx.goods_workbooks(spark, str(tmp_path)).collect()}
    assert got == {("커피", 30): ["G0301", "G9999", "S2001"], ("차", 30): ["a", "b"], ("커피", 31): ["G1234"]}


def test_vector_index(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id int, vector array<float>")
    vector_index.build(good, str(tmp_path), "g1", 2)
    assert vector_index.load(spark, str(tmp_path), 2).count() == 2
    bad = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0]), (None, [1.0, 0.0]), (5, [float("nan"), 0.0]), (6, None)], "id int, vector array<float>")
    assert sorted(r["reason"] for r in vector_index.violations(bad, 2).collect()) == ["dimension", "dimension", "key_twice", "key_twice", "no_key", "not_unit", "not_unit"]
    with pytest.raises(ValueError):
        vector_index.build(bad, str(tmp_path), "g2", 2)
    with pytest.raises(ValueError):
        vector_index.load(spark, str(tmp_path), 3)


def test_readers(spark, tmp_path):
    import gzip

    (tmp_path / "a.json.gz").write_bytes(gzip.compress('[{"a": "1"}, {"a": "2"}]'.encode()))
    from pyspark.sql import types as T

    element = T.StructType([T.StructField("a", T.StringType())])
    assert sorted(r["a"] for r in readers.json_array(spark, str(tmp_path / "a.json.gz"), element).collect()) == ["1", "2"]
    (tmp_path / "b.csv").write_text('x,y\n"a ""q"", b",\n" ",2\n')
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "b.csv"), ["x", "y"]).collect()] == [('a "q", b', None), (None, "2")]
    xml = spark.createDataFrame([("<r><totalCount> 12 </totalCount></r>",), ("<r/>",)], "x string")
    assert [r[0] for r in xml.select(readers.total_count(F.col("x"))).collect()] == [12, None]
    with pytest.raises(Exception, match="no total"):
        spark.createDataFrame([("<r><totalCount>x</totalCount></r>",)], "x string").select(readers.total_count(F.col("x"))).collect()
    with pytest.raises(Exception, match="status"):
        readers.checked_status(spark.createDataFrame([("30",)], "s string"), "s").collect()
    d = spark.createDataFrame([("1", ["B", "A", "A"], [("X", 3)], ["v"]), ("2", None, [("Y", 2), ("Y", None)], None)], "application_no string, codes array<string>, goods array<struct<code:string,nice:int>>, vienna array<string>")
    assert [(r["similarity_codes"], r["nice_classes"]) for r in readers.detail(d).collect()] == [(["A", "B"], [3]), (["Y"], [2])]
    h = readers.harmonised(spark.createDataFrame([("1", " ", "z")], "appNo string, Title string, title string".replace("title string", "name string")), {"number": ["ApplicationNumber", "appNo"], "title": ["Title", "name"], "x": ["none"]})
    assert tuple(h.first()) == ("1", "z", None)


def test_denormalised(spark):
    main = spark.createDataFrame([("1", "r1", "figure"), ("2", None, "text")], "application_no string, registration_no string, mark_kind string")
    applicants = spark.createDataFrame([("1", "b", 2), ("1", "a", 1)], "application_no string, applicant string, seq int")
    holders = spark.createDataFrame([("r1", "h2", 5), ("r1", "h1", 3)], "registration_no string, right_holder string, pos int")
    vienna = spark.createDataFrame([("1", "v2", 1), ("1", "v1", 2), ("1", "v2", 3)], "application_no string, code string, pos int")
    goods = spark.createDataFrame([("1", 9, "G2"), ("1", 3, "G1"), ("1", 9, "G2")], "application_no string, nice_class int, similarity_code string")
    r = readers.denormalised(main, applicants, holders, vienna, goods, ["figure"]).collect()
    assert len(r) == 1 and (r[0]["applicant"], r[0]["right_holder"], r[0]["vienna_codes"], r[0]["nice_classes"], r[0]["similarity_codes"]) == ("a", "h1", ["v2", "v1"], [3, 9], ["G1", "G2"])


def test_jdbc_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "APP string, T string").write.format("jdbc").options(url=url, dbtable="MARKS", createTableColumnTypes="APP VARCHAR(20), T VARCHAR(20)", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    got = readers.jdbc_by_keys(spark, url, "MARKS", "APP", spark.createDataFrame([("1",), ("3",), ("9",)], "APP string"), ["APP", "T"])
    assert sorted(tuple(r) for r in got.collect()) == [("1", "a"), ("3", "c")]


def test_string_expressions(spark):
    df = spark.createDataFrame([("주식회사 Foo, Inc.", "20260102", "40-2019-0000123"), ("Bar Co", "2026.01.02", "4020190000123"), ("", "x", "")], "o string, d string, n string")
    rows = df.select(strings.owner_key(F.col("o")), strings.parse_date(F.col("d")).cast("string"), strings.number_forms(F.col("n")), strings.has_final(F.lit("한")), strings.has_final(F.lit("하"))).collect()
    assert [r[0] for r in rows] == ["foo", "bar", ""] and [r[1] for r in rows] == ["2026-01-02", "2026-01-02", None]
    assert rows[0][2] == rows[1][2] == ["4020190000123", "40-2019-0000123"] and rows[0][3] and not rows[0][4]
    c = spark.createDataFrame([(0.5,), (float("nan"),), (1.2,)], "c double").select(vectors.recalibrated(F.col("c"), 0.3)).collect()
    assert [r[0] for r in c] == pytest.approx([2 / 7, 0, 1])


def test_coupling_holds(spark):
    assert risk.coupling_violations(spark).count() == 0 and risk.coupling_table(spark).count() == 32 * 6
