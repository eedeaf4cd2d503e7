"""Queries of selection, review lists and goods tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberloom.functions import strings
from emberloom.operators import selection
from emberloom.plans.registry import Bound, query, read
from emberloom.plans.report_queries import _STATS_SQL, _stats

_ITEMS = Bound(
    "part",
    pos="p_partkey",
    number="CASE p_partkey % 10 WHEN 0 THEN '10' || lpad(CAST(p_partkey AS STRING), 11, '0') WHEN 1 THEN '40-' || lpad(CAST(p_partkey - 1 AS STRING), 11, '0') ELSE '40' || lpad(CAST(p_partkey - p_partkey % 2 AS STRING), 11, '0') END",
    title="p_name",
    status="CASE WHEN p_partkey % 7 = 0 THEN '거절' ELSE '등록' END",
    drawn="p_partkey % 5 <> 0",
    owner="p_brand",
    size="p_size",
    registered="CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2001.02.' || lpad(CAST(1 + p_size % 28 AS STRING), 2, '0') END",
)


def _items(spark, sf_dir):
    none = F.array().cast("array<string>")
    return _ITEMS(spark, sf_dir).withColumns({"vienna": F.when(F.col("drawn"), F.array(F.lit("1"))).otherwise(none), "classes": F.array(F.col("size").cast("int"))})


_SCREEN_SQL = f"""WITH i AS (SELECT *, regexp_replace(number, '[^0-9]', '', 'g') AS n FROM ({_ITEMS.sql})), t AS (SELECT DISTINCT '40' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS n FROM part WHERE p_size < 4),
j AS (SELECT i.*, CASE WHEN owner NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'other_owner' WHEN status <> '등록' THEN 'not_registered' WHEN NOT drawn THEN 'no_vienna' WHEN length(i.n) <> 13 OR i.n[1:2] IN ('10', '20', '30') THEN 'bad_number' WHEN t.n IS NOT NULL THEN 'taken' END AS why FROM i LEFT JOIN t USING (n)),
k AS (SELECT *, min(CASE WHEN why IS NULL OR why = 'taken' THEN pos END) OVER (PARTITION BY n) AS first FROM j), s AS (SELECT *, CASE WHEN (why IS NULL OR why = 'taken') AND pos > first THEN 'duplicate' ELSE why END AS reason FROM k)
"""


def _screened(spark, sf_dir):
    taken = read(spark, sf_dir, "part").where("p_size < 4").select(F.concat(F.lit("40"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("number"))
    return selection.screened(_items(spark, sf_dir), F.col("owner").isin("Brand#11", "Brand#12", "Brand#13"), taken)


@query(_SCREEN_SQL + "SELECT coalesce(reason, 'candidate') AS reason, count(*) AS n FROM s GROUP BY 1")
def screening_reasons(spark, sf_dir):
    return _screened(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("candidate")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    _SCREEN_SQL
    + """SELECT pos, number, CAST(row_number() OVER (ORDER BY contains(' ' || lower(title) || ' ', ' bolt ') DESC, size IN (5, 6, 7) DESC, CASE WHEN registered = '' THEN 0 ELSE CAST(replace(registered, '.', '') AS INTEGER) END DESC, number) AS INTEGER) AS place FROM s WHERE reason IS NULL"""
)
def selection_order(spark, sf_dir):
    own = _screened(spark, sf_dir).where("reason is null")
    order = selection.selection_order(F.lit("bolt"), [5, 6, 7])
    return own.select("pos", "number", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("place"))


@query()
def greedy_plan(spark, sf_dir):
    """Brands in order take their five largest parts, where a part may be wanted by three brands; tested against one brand after the other."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("b"))
    wanted = p.select("p_partkey", "p_size", F.explode(F.array("b", (F.col("b") * 7 % 50).cast("int"), (F.col("b") * 3 % 50).cast("int"))).alias("brand")).distinct()
    ranked = wanted.withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("p_size"), "p_partkey"))).withColumn("place", F.col("brand"))
    return selection.greedy_plan(ranked, "brand", "place", "p_partkey", 5)


@query(
    """WITH r AS (SELECT p_partkey AS number, [CAST(p_size AS INTEGER), CAST(p_size % 10 AS INTEGER)] AS classes, p_partkey % 3 = 0 AS filled FROM part),
k AS (SELECT number, CASE WHEN list_contains(classes, 9) THEN 0 WHEN list_contains(classes, 35) THEN 1 WHEN list_contains(classes, 3) THEN 2 ELSE 3 END AS rank FROM r WHERE NOT filled AND number % 8 <> 1) SELECT number, CAST(rank AS INTEGER) AS rank FROM k"""
)
def backfill_targets(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    records = p.select(k.alias("number"), F.array(F.col("p_size").cast("int"), (F.col("p_size") % 10).cast("int")).alias("classes"), F.when(k % 3 == 0, F.array(F.lit("G1234"))).otherwise(F.array().cast("array<string>")).alias("codes"))
    return selection.backfill_targets(records, p.where(k % 8 == 1).select(k.alias("number")), "number", [9, 35, 3], True).select("number", "rank")


@query(
    _STATS_SQL
    + """SELECT token, round(zipf, 6) AS zipf, token SIMILAR TO '[0-9]+' OR zipf >= 3 AS eligible, CASE WHEN NOT (token SIMILAR TO '[0-9]+' OR zipf >= 3) THEN '제외' WHEN length(token) = 4 THEN '포함' WHEN token SIMILAR TO '[0-9]+' THEN '보류' ELSE '제외' END AS verdict,
 length(token) = 4 AS judged FROM s"""
)
def candidate_verdicts(spark, sf_dir):
    t = _stats(spark, sf_dir).select("token", "zipf")
    found = selection.judged_candidates(t, t.where(F.char_length("token") == 4).select("token", F.lit("포함").alias("verdict")))
    return found.withColumn("zipf", F.round("zipf", 6))


@query(_STATS_SQL + "SELECT token, a, CAST(n AS BIGINT) AS n FROM s ORDER BY n DESC, a DESC, token LIMIT 100")
def review_tokens(spark, sf_dir):
    return selection.review_tokens(_stats(spark, sf_dir), 100).select("token", "a", "n")


@query(
    """WITH t AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || CASE WHEN p_partkey % 3 = 0 THEN ' plus' ELSE '' END AS title FROM part),
e AS (SELECT pos, title, unnest(list_distinct(regexp_extract_all(lower(title), '([a-z]+|[0-9]+)'))) AS token FROM t), f AS (SELECT token, lower(title) AS k, min(pos) AS pos, arg_min(title, pos) AS title FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY pos) AS place FROM f) SELECT token, list(title ORDER BY place) AS examples FROM r WHERE place <= 3 GROUP BY token"""
)
def token_examples(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat(F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(k % 3 == 0, " plus").otherwise(""))
    return selection.examples(read(spark, sf_dir, "part").select(k.alias("pos"), title.alias("title")))


@query(
    """WITH g AS (SELECT p_name || ' 커피 음료' AS goods_name, p_size AS c FROM part), t AS (SELECT unnest(['커피', '음료', '피음', 'bolt', 'red', '카페']) AS token),
h AS (SELECT token, c, count(*) AS n FROM g, t WHERE CASE WHEN token SIMILAR TO '[가-힣]+' THEN contains('커피음료', token) ELSE list_contains(regexp_extract_all(lower(goods_name), '([a-z]+|[가-힣]+|[0-9]+)'), token) END GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, c) AS place FROM h) SELECT token, c AS nice_class, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3"""
)
def class_evidence(spark, sf_dir):
    goods = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" 커피 음료")).alias("goods_name"), F.col("p_size").alias("nice_class"))
    tokens = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in ("커피", "음료", "피음", "bolt", "red", "카페")])).alias("token"))
    return selection.class_evidence(tokens, goods)


@query(
    """WITH q AS (SELECT p_partkey AS query_id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part WHERE p_partkey % 100 = 0), c AS (SELECT q.query_id, p.p_partkey AS id, regexp_replace(lower(upper(p.p_name) || '!'), '[^a-z0-9]', '', 'g') AS t FROM q, part p WHERE p.p_partkey <> q.query_id)
SELECT q.query_id, c.id FROM c JOIN q USING (query_id) WHERE c.t = q.k AND q.k <> ''"""
)
def same_name_pairs(spark, sf_dir):
    """Every part whose id is divisible by 100 against all parts."""
    p = read(spark, sf_dir, "part")
    q = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"))
    key = strings.letters_and_digits
    own = p.select(F.col("p_partkey").alias("id"), F.concat(F.upper("p_name"), F.lit("!")).alias("title"))
    candidates = own.join(q.select("query_id", key(F.col("name")).alias("_k")), key(F.col("title")) == F.col("_k")).where("id <> query_id").drop("_k")
    return selection.same_name_pairs(q, candidates)


@query(
    """WITH r AS (SELECT p_partkey AS id, p_brand || '|' || lower(p_brand) || ' Inc.|X ' || p_type AS owners FROM part)
SELECT id, list_sort(list_distinct(['x' || lower(replace(p_type, ' ', '')), CASE WHEN p_brand = 'Brand#11' THEN 'brandgroup' ELSE replace(lower(p_brand), '#', '') END])) AS owners FROM r JOIN part ON p_partkey = id"""
)
def owner_groups(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("|"), F.lower("p_brand"), F.lit(" Inc.|X "), "p_type").alias("names"))
    alias = spark.range(1).select(F.lit("BRAND #11").alias("name"), F.lit("Brand Group").alias("representative"))
    return selection.owner_groups(rows, alias, "names").select("id", "owners")


@query("SELECT o_orderkey AS id, c.c_name AS local_name FROM orders LEFT JOIN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS k, c_name FROM customer WHERE c_custkey % 2 = 0) c ON lpad(CAST(o_custkey AS VARCHAR), 8, '0') = c.k")
def with_local_records(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.regexp_replace(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), "^(....)", "$1-").alias("number"))
    c = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("number"), F.col("c_name").alias("name"))
    return selection.with_local(o, c, "number", ["name"]).select("id", "local_name")


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name || p_partkey), p_name || p_partkey) AS INTEGER) AS place FROM part")
def name_places(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_name", F.col("p_partkey").cast("string")).alias("n"))
    return selection.name_order(p, "n", "p_brand").select("p_partkey", "place")


_PICKS = "SELECT o_custkey AS basket, o_orderkey AS pos, 'g' || CAST(o_orderkey % 30 AS VARCHAR) AS goods_name, o_orderkey % 3 AS nice_class, ['g' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 4, '0'), 'bad'] AS codes FROM orders"
_PICKED_SQL = f"""WITH p AS ({_PICKS}), f AS (SELECT *, min(pos) OVER (PARTITION BY basket, goods_name, nice_class) = pos AS fresh FROM p), k AS (SELECT *, CASE WHEN fresh THEN row_number() OVER (PARTITION BY basket, fresh ORDER BY pos) END AS k FROM f),
s AS (SELECT basket, pos, codes, CASE WHEN k IS NULL THEN 'duplicate' WHEN k > 20 THEN 'limit' ELSE 'added' END AS state FROM k)
"""


def _picked(spark, sf_dir):
    k = F.col("o_orderkey")
    code = F.concat(F.lit("g"), F.lpad((k % 30).cast("string"), 4, "0"))
    picks = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("basket"), k.alias("pos"), F.concat(F.lit("g"), (k % 30).cast("string")).alias("goods_name"), (k % 3).alias("nice_class"), F.array(code, F.lit("bad")).alias("codes"))
    return selection.selected_goods(picks)


@query(_PICKED_SQL + "SELECT basket, pos, state FROM s")
def selected_goods(spark, sf_dir):
    return _picked(spark, sf_dir).select("basket", "pos", "state")


@query(_PICKED_SQL + "SELECT basket, list_sort(list_distinct(list(upper(codes[1])))) AS codes FROM s WHERE state = 'added' GROUP BY basket")
def goods_unions(spark, sf_dir):
    return selection.goods_union(_picked(spark, sf_dir))


@query(
    """WITH r AS (SELECT o_orderkey AS id, concat_ws(';', CASE WHEN o_totalprice > 200000 THEN 'dear' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS reasons FROM orders)
SELECT id, reasons, CASE WHEN id % 5 = 0 THEN 'Y' ELSE '' END AS done FROM r WHERE reasons <> ''"""
)
def review_queue(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    done = o.where("id % 5 = 0").select("id", F.lit("Y").alias("done"))
    return selection.review_queue(o, ["id"], done, {"dear": F.col("o_totalprice") > 200000, "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query(
    """WITH n AS (SELECT l_suppkey AS c, p_name AS name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), m AS (SELECT c, arg_min(name, (-n, name)) AS name FROM n GROUP BY c),
u AS (SELECT l_suppkey AS c, list_sort(list_distinct(list(p_brand))) AS codes, list_sort(list_distinct(list(l_linenumber))) AS numbers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT c AS case_id, name, codes, numbers FROM u JOIN m USING (c)"""
)
def case_queries(spark, sf_dir):
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = l.join(p, l["l_partkey"] == p["p_partkey"]).select(F.col("l_suppkey").alias("case_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("code"), F.col("l_linenumber").alias("number"))
    return selection.case_queries(rows, "case_id", "name", "code", "number")


@query(
    """WITH g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name || CAST(p_partkey - p_partkey % 20 // 19 AS VARCHAR) END AS goods_name, CAST(p_size AS INTEGER) AS nice_class, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE 'G1234' END AS code,
 CASE WHEN p_partkey % 13 = 0 THEN p_name || CAST(p_partkey AS VARCHAR) ELSE 'alias' END AS alias FROM part),
v AS (SELECT id, 'no_name' AS problem FROM g WHERE trim(goods_name) = '' UNION ALL SELECT id, 'bad_class' FROM g WHERE nice_class NOT BETWEEN 1 AND 45 UNION ALL SELECT id, 'bad_code' FROM g WHERE code = 'x'
 UNION ALL SELECT id, 'alias_is_name' FROM g WHERE alias IN (SELECT goods_name FROM g) UNION ALL SELECT id, 'twice' FROM g WHERE (goods_name, nice_class) IN (SELECT (goods_name, nice_class) FROM g GROUP BY goods_name, nice_class HAVING count(*) > 1))
SELECT goods_name, nice_class, problem FROM v JOIN g USING (id)"""
)
def goods_violations(spark, sf_dir):
    k = F.col("p_partkey")
    shifted = (k - F.floor((k % 20) / 19)).cast("bigint").cast("string")
    goods = read(spark, sf_dir, "part").select(
        F.when(k % 9 == 0, " ").otherwise(F.concat("p_name", shifted)).alias("goods_name"), F.col("p_size").cast("int").alias("nice_class"), F.array(F.when(k % 11 == 0, "x").otherwise("G1234")).alias("codes"),
        F.array(F.when(k % 13 == 0, F.concat("p_name", k.cast("string"))).otherwise("alias")).alias("aliases"),
    )
    return selection.goods_violations(goods)


@query(
    _STATS_SQL
    + """, t AS (SELECT CASE WHEN n % 5 = 0 THEN upper(token) ELSE token END AS token, CASE WHEN n % 3 = 0 THEN '기타' ELSE '품질' END AS kind, CAST(n AS INTEGER) AS c, CASE WHEN n % 7 = 0 THEN '제외' ELSE '포함' END AS verdict FROM s)
SELECT token, CASE WHEN kind = '기타' THEN 'unknown_kind' WHEN c NOT BETWEEN 1 AND 45 THEN 'bad_class' ELSE 'not_normal' END AS problem FROM t WHERE verdict <> '제외' AND (kind = '기타' OR c NOT BETWEEN 1 AND 45 OR token <> lower(token))"""
)
def term_violations(spark, sf_dir):
    n = F.col("n")
    terms = _stats(spark, sf_dir).select(
        F.when(n % 5 == 0, F.upper("token")).otherwise(F.col("token")).alias("token"), F.when(n % 3 == 0, "기타").otherwise("품질").alias("kind"), F.array(n.cast("int")).alias("classes"), F.when(n % 7 == 0, "제외").otherwise("포함").alias("verdict")
    )
    return selection.term_violations(terms, ["품질", "수량"])
