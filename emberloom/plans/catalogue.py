"""Query catalogue: name -> Spark plan on the test tables, and name -> DuckDB oracle.

Bindings: embeddings are image vectors; part is the registry of marks (p_name
title, p_brand owner, p_type kind, p_size class); suppliers' part brands are
code sets; documents are titles with source as owner; labels.quality is the
outcome; orders are cases of customers; events is a call log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberloom.functions import codes, strings, vectors
from emberloom.operators import corpus, evaluation, graph, merge, retrieval, risk, sampling
from emberloom.plans.registry import ORACLES, QUERIES, query, read

# --- vectors -----------------------------------------------------------------

_TOPK_SQL = """
WITH s AS (SELECT q.vec_id AS query_id, m.vec_id AS id, round(CAST(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) AS DOUBLE), 6) AS score
  FROM embeddings q, embeddings m WHERE q.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
"""


def _topk(spark, sf_dir, k=20):
    """Queries are all rows whose id is divisible by 100, against all rows."""
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.vector_topk(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k)


@query(
    _TOPK_SQL
    + """SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank, CASE WHEN score >= 0.75 THEN 'STRONG_MATCH' WHEN score >= 0.55 THEN 'POSSIBLE_MATCH'
  WHEN score >= 0.45 THEN 'WEAK_MATCH' ELSE 'NO_CLOSE_MATCH' END AS status FROM t WHERE rank <= 20"""
)
def vector_topk(spark, sf_dir):
    return _topk(spark, sf_dir).withColumn("status", vectors.visual_status(F.col("score")))


@query(
    _TOPK_SQL
    + """, g AS (SELECT query_id, count(*) AS n, max(score) AS top, max(CASE WHEN rank = 2 THEN score END) AS second, avg(score) AS mean FROM t WHERE rank <= 20 AND id <> query_id GROUP BY query_id)
SELECT query_id, n, top, round(coalesce(top - second, 0), 6) AS gap, round(top - mean, 6) AS lead,
 CASE WHEN top >= 0.75 THEN 'STRONG_MATCH' WHEN top >= 0.55 THEN 'POSSIBLE_MATCH' WHEN top >= 0.45 THEN 'WEAK_MATCH' ELSE 'NO_CLOSE_MATCH' END AS status,
 CASE WHEN n < 2 THEN 'INSUFFICIENT_CANDIDATES' WHEN top >= 0.55 AND coalesce(top - second, 0) < 0.04 THEN 'MULTIPLE_CLOSE_CANDIDATES' ELSE '' END AS uncertain FROM g"""
)
def visual_status(spark, sf_dir):
    top = _topk(spark, sf_dir).where("id <> query_id")
    g = top.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.avg("score").alias("mean"))
    gap = F.coalesce(F.col("top") - F.col("second"), F.lit(0.0))
    return g.select(
        "query_id", "n", "top", F.round(gap, 6).alias("gap"), F.round(F.col("top") - F.col("mean"), 6).alias("lead"),
        vectors.visual_status(F.col("top")).alias("status"), vectors.uncertainty(F.col("n"), F.col("top"), gap).alias("uncertain"),
    )


@query(
    _TOPK_SQL
    + """, n AS (SELECT t.*, e.label AS code FROM t JOIN embeddings e ON e.vec_id = t.id WHERE rank <= 10),
v AS (SELECT query_id, code, count(*) AS votes FROM n GROUP BY ALL), c AS (SELECT * FROM v WHERE votes / 10.0 >= 0.4)
SELECT * FROM c UNION ALL SELECT query_id, code, 1 FROM n WHERE rank = 1 AND query_id NOT IN (SELECT query_id FROM c)"""
)
def knn_label_vote(spark, sf_dir):
    label = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("code"))
    return retrieval.knn_codes(_topk(spark, sf_dir, 10), label, 10)


@query(
    """SELECT vec_id, abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 1e-3 AS is_unit, len(embedding) AS dim FROM embeddings"""
)
def vector_check(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.is_unit("embedding").alias("is_unit"), F.size("embedding").cast("bigint").alias("dim"))


@query(
    """WITH x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT i, avg(CASE WHEN label = 0 THEN v END) AS a, avg(CASE WHEN label <> 0 THEN v END) AS b FROM x GROUP BY i)
SELECT vec_id, round(sum(v * (coalesce(a, 0) - coalesce(b, 0))), 6) AS score, round(sum(v * (coalesce(a, 0) - coalesce(b, 0))), 6) > 0 AS towards FROM x JOIN m USING (i) GROUP BY vec_id"""
)
def centroid_direction(spark, sf_dir):
    """Score along the difference of two group means; the direction is one vector of fixed length."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.doubles("embedding").alias("v"))
    each = e.select("label", F.posexplode("v").alias("i", "x"))
    means = each.groupBy("i").agg(F.avg(F.when(F.col("label") == 0, F.col("x"))).alias("a"), F.avg(F.when(F.col("label") != 0, F.col("x"))).alias("b"))
    part = F.struct("i", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("d"))
    direction = means.agg(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["d"]).alias("d"))
    score = F.round(vectors.dot("v", "d"), 6)
    return e.crossJoin(F.broadcast(direction)).select("vec_id", score.alias("score"), (score > 0).alias("towards"))


# --- code sets ---------------------------------------------------------------

_SETS_SQL = "WITH s AS (SELECT DISTINCT l.l_suppkey AS k, p.p_brand AS code FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey), n AS (SELECT k, count(*) AS size FROM s GROUP BY k)\n"


def _brand_sets(spark, sf_dir):
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    pairs = l.join(p, l["l_partkey"] == p["p_partkey"])
    return pairs.groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("p_brand").alias("codes"))


@query(
    _SETS_SQL
    + """SELECT a.k AS l_key, b.k AS r_key, count(*) AS "both", round(count(*) / CAST(any_value(na.size) + any_value(nb.size) - count(*) AS DOUBLE), 4) AS jaccard
FROM s a JOIN s b ON a.code = b.code AND a.k < b.k JOIN n na ON na.k = a.k JOIN n nb ON nb.k = b.k GROUP BY ALL"""
)
def goods_jaccard_pairs(spark, sf_dir):
    return retrieval.pairs_within(_brand_sets(spark, sf_dir), "k", "codes")


@query(
    """WITH s AS (SELECT DISTINCT o.o_custkey AS id, p.p_brand AS code FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey),
q AS (SELECT * FROM (VALUES ('Brand#11'), ('Brand#12'), ('Brand#13'), ('Brand#21')) t(code)),
j AS (SELECT s.id, count(q.code) AS inter, count(*) AS size FROM s LEFT JOIN q USING (code) GROUP BY s.id HAVING count(q.code) > 0),
t AS (SELECT id, inter AS "both", round(inter / CAST(size + 4 - inter AS DOUBLE), 4) AS jaccard FROM j)
SELECT id, "both", jaccard, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY jaccard DESC, id) AS rank FROM t) WHERE rank <= 20"""
)
def goods_overlap_topn(spark, sf_dir):
    o, l, p = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    wide = o.join(l, o["o_orderkey"] == l["l_orderkey"]).join(p, l["l_partkey"] == p["p_partkey"])
    sets = wide.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("p_brand").alias("codes"))
    wanted = spark.createDataFrame([(1, ["Brand#11", "Brand#12", "Brand#13", "Brand#21"])], "query_id int, codes array<string>")
    hits = retrieval.overlaps(retrieval.postings(wanted, "query_id", "codes"), retrieval.postings(sets, "id", "codes"), "query_id", "id")
    return retrieval.best(hits, 20, "query_id", "jaccard", "id").select("id", "both", "jaccard", "rank")


@query(
    """WITH a AS (SELECT p_partkey AS id, 'name' AS s FROM part WHERE p_name LIKE '%bolt%'), b AS (SELECT p_partkey, 'brand' FROM part WHERE p_brand = 'Brand#11'),
c AS (SELECT p_partkey, 'size' FROM part WHERE p_size = 7)
SELECT 1 AS query_id, id, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id"""
)
def pool_union(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("query_id", F.lit(1)).withColumnRenamed("p_partkey", "id")
    return retrieval.pool_union({"name": p.where(F.col("p_name").contains("bolt")), "brand": p.where("p_brand = 'Brand#11'"), "size": p.where("p_size = 7")})


@query(
    """SELECT p_name AS name, list_sort(list_distinct(list(p_brand))) AS code_union, count(*) AS n FROM part GROUP BY p_name"""
)
def codes_for_union(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_set("p_brand")).alias("code_union"), F.count("*").alias("n"))


@query(
    """SELECT c_custkey, list_sort(list_distinct(list_filter(list_transform(['g' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0'), ' S12345 ', 'X1', 'g12'], lambda x: upper(trim(x))), lambda x: regexp_full_match(x, '[GS][0-9]{4,6}')))) AS codes,
 CAST(2 AS INTEGER) AS ignored FROM customer"""
)
def clean_codes(spark, sf_dir):
    raw = F.array(F.concat(F.lit("g"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0")), F.lit(" S12345 "), F.lit("X1"), F.lit("g12"))
    return read(spark, sf_dir, "customer").select("c_custkey", codes.clean_codes(raw).alias("codes"), codes.ignored_codes(raw).alias("ignored"))


# --- names -------------------------------------------------------------------

_TOKENS_SQL = "regexp_extract_all(lower({}), '([a-z]+|[0-9]+)')"


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part),
k AS (SELECT name, list_distinct(CASE WHEN len(t) <= 3 THEN list_concat([array_to_string(t, '')], list_filter(t, lambda x: length(x) >= 2)) ELSE [array_to_string(t, '')] END) AS keys
  FROM (SELECT name, regexp_extract_all(lower(name), '([a-z]+|[0-9]+)') AS t FROM n)),
e AS (SELECT name, unnest(keys) AS key FROM k)
SELECT a.name AS name_a, b.name AS name_b, round(max(1 - levenshtein(a.key, b.key) / CAST(greatest(length(a.key), length(b.key)) AS DOUBLE)), 4) AS similarity
FROM e a JOIN e b ON a.name < b.name GROUP BY ALL"""
)
def spelling_similarity(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    k = n.withColumn("keys", strings.spelling_keys(strings.tokens(F.col("name"))))
    a, b = k.select(F.col("name").alias("name_a"), F.col("keys").alias("ka")), k.select(F.col("name").alias("name_b"), F.col("keys").alias("kb"))
    return a.join(b, F.col("name_a") < F.col("name_b")).select("name_a", "name_b", F.round(strings.spelling_similarity(F.col("ka"), F.col("kb")), 4).alias("similarity"))


@query(
    """WITH p AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, CASE WHEN p_name = 'bolt' THEN 0 WHEN starts_with(p_name, 'bolt') THEN 1 WHEN contains(p_name, 'bolt') THEN 2 END AS tier FROM p)
SELECT p_name AS entry_id, p_name AS name, CAST(tier AS INTEGER) AS tier, false AS via_alias FROM t WHERE tier IS NOT NULL ORDER BY tier, length(p_name), p_name LIMIT 10 OFFSET 2"""
)
def tiered_search(spark, sf_dir):
    e = read(spark, sf_dir, "part").select(F.col("p_name").alias("entry_id"), F.col("p_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases")).distinct()
    return retrieval.tiered_search(e, "bolt", 2, 10)


@query(
    """WITH o AS (SELECT DISTINCT lower(text) AS title, source AS owner FROM documents),
e AS (SELECT owner, unnest(list_distinct(regexp_extract_all(title, '([a-z]+|[0-9]+)'))) AS token FROM o)
SELECT token, count(DISTINCT owner) AS a, CAST(count(*) AS BIGINT) AS n FROM e WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 2"""
)
def token_stats_an(spark, sf_dir):
    return corpus.token_stats(read(spark, sf_dir, "documents").select(F.col("text").alias("title"), F.col("source").alias("owner")))


@query(
    """WITH o AS (SELECT DISTINCT lower(text) AS title, source AS owner FROM documents),
e AS (SELECT owner, unnest(list_distinct(regexp_extract_all(title, '([a-z]+|[0-9]+)'))) AS token FROM o),
s AS (SELECT token, count(DISTINCT owner) AS a, count(*) AS n FROM e WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 2),
z AS (SELECT *, log10(n) + 2 AS zipf FROM s)
SELECT token, a, CAST(n AS BIGINT) AS n, round((1 - 0.5 * least(1.0, greatest(0.0, (zipf - 3) / 2.5))) * (1 - least(1.0, a / 10.0) * least(1.0, n / 20.0)), 4) AS score FROM z"""
)
def token_score(spark, sf_dir):
    return corpus.token_scores(token_stats_an(spark, sf_dir), F.log10("n") + 2)


@query(
    """SELECT item_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' WHEN contains(text, '도형') THEN 'figure' WHEN NOT regexp_matches(text, '\\p{L}') THEN 'no_letters' WHEN length(trim(text)) <= 2 THEN 'short' ELSE 'other' END AS bucket,
 regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM benchmark"""
)
def name_buckets(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", strings.name_bucket(F.col("text")).alias("bucket"), strings.letters_and_digits(F.col("text")).alias("key"))


@query(
    """SELECT p_partkey, (contains(' ' || trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' bolt ')) AS brand_in_title FROM part"""
)
def brand_in_title(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", strings.brand_in_title(F.col("p_name"), F.lit("bolt")).alias("brand_in_title"))


@query(
    """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
 regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs FROM pages"""
)
def xml_like_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        F.size(F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))).alias("paragraphs"),
    )


# --- filters, histograms, audits ---------------------------------------------


@query("SELECT coalesce(nullif(trim(o_orderstatus), ''), 'unknown') AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, sf_dir):
    return corpus.histogram(read(spark, sf_dir, "orders"), F.col("o_orderstatus"), "status")


@query(
    """SELECT coalesce(CASE WHEN o_orderstatus <> 'F' THEN 'not_registered' WHEN o_totalprice < 50000 THEN 'no_code' WHEN o_orderkey % 7 = 0 THEN 'bad_number' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'other_class' END, 'accepted') AS reason,
 count(*) AS n FROM orders GROUP BY 1"""
)
def filter_reasons(spark, sf_dir):
    reason = corpus.first_reason(
        ("not_registered", F.col("o_orderstatus") != "F"), ("no_code", F.col("o_totalprice") < 50000), ("bad_number", F.col("o_orderkey") % 7 == 0),
        ("other_class", ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
    )
    return read(spark, sf_dir, "orders").groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT p_name AS value, count(*) AS n, min(p_partkey) AS first_member FROM part GROUP BY 1 HAVING count(*) > 1)
SELECT 'duplicate_name' AS check_name, value, n, CAST(first_member AS DOUBLE) AS detail FROM d
UNION ALL SELECT 'completeness', 'p_name', count(*), round(count(nullif(trim(p_name), '')) / CAST(count(*) AS DOUBLE), 4) FROM part
UNION ALL SELECT 'completeness', 'p_brand', count(*), round(count(nullif(trim(p_brand), '')) / CAST(count(*) AS DOUBLE), 4) FROM part
UNION ALL SELECT 'missing', 'lineitem', count(*), 0.0 FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orphan', 'part', count(*), 0.0 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"""
)
def audit_report(spark, sf_dir):
    p, l = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    dup = corpus.duplicate_groups(p, F.col("p_name"), "value", "p_partkey").select(F.lit("duplicate_name").alias("check_name"), "value", "n", F.col("first_member").cast("double").alias("detail"))
    rows = p.agg(F.count("*").alias("n"))
    full = corpus.completeness(p, ["p_name", "p_brand"]).crossJoin(F.broadcast(rows)).select(F.lit("completeness").alias("check_name"), F.col("column").alias("value"), "n", F.col("share").alias("detail"))
    missing = l.join(p, "p_partkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("check_name"), F.lit("lineitem").alias("value"), "n", F.lit(0.0).alias("detail"))
    orphan = p.join(l, "p_partkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan").alias("check_name"), F.lit("part").alias("value"), "n", F.lit(0.0).alias("detail"))
    return dup.unionByName(full).unionByName(missing).unionByName(orphan)


@query("SELECT b AS class, count(p_partkey) AS n FROM range(1, 46) t(b) LEFT JOIN part ON p_size = b GROUP BY b")
def class_histogram(spark, sf_dir):
    return corpus.dense_histogram(read(spark, sf_dir, "part"), "p_size", 1, 45, "class")


@query("SELECT count(*) AS records, CAST(min(year(o_orderdate)) AS VARCHAR) || ' ~ ' || CAST(max(year(o_orderdate)) AS VARCHAR) AS years FROM orders")
def dataset_header(spark, sf_dir):
    y = F.year("o_orderdate").cast("string")
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("records"), F.concat_ws(" ~ ", F.min(y), F.max(y)).alias("years"))


@query("SELECT p_type AS kind, p_size >= 25 AS large, count(*) AS n, grouping_id(p_type, p_size >= 25) AS level FROM part GROUP BY GROUPING SETS ((p_type, p_size >= 25), (p_type), ())")
def backfill_status(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), (F.col("p_size") >= 25).alias("large"))
    return p.groupingSets([["kind", "large"], ["kind"], []], "kind", "large").agg(F.count("*").alias("n"), F.grouping_id("kind", "large").cast("bigint").alias("level"))


@query(
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'figure' WHEN p_size < 20 AND p_name IS NOT NULL THEN 'combined-text' WHEN p_name IS NOT NULL THEN 'text' END AS mark_type,
 CASE WHEN nullif(trim(p_name), '') IS NOT NULL THEN 'p_name' WHEN nullif(trim(p_brand), '') IS NOT NULL THEN 'p_brand' END AS source FROM part"""
)
def mark_types(spark, sf_dir):
    t = F.when(F.col("p_size") < 10, "figure").when((F.col("p_size") < 20) & F.col("p_name").isNotNull(), "combined-text").when(F.col("p_name").isNotNull(), "text")
    return read(spark, sf_dir, "part").select("p_partkey", t.alias("mark_type"), strings.provenance(p_name=F.col("p_name"), p_brand=F.col("p_brand")).alias("source"))


# --- joins -------------------------------------------------------------------


@query(
    """SELECT count(*) FILTER (o.k IS NULL) AS only_left, count(*) FILTER (c.k IS NULL) AS only_right, count(*) FILTER (o.k IS NOT NULL AND c.k IS NOT NULL) AS "both"
FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k"""
)
def full_reconcile(spark, sf_dir):
    return merge.reconcile(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    """Customers without a kind of order."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query(
    """WITH s AS (SELECT o_custkey AS k, min(o_orderkey) AS only_order FROM orders GROUP BY 1 HAVING count(*) = 1)
SELECT c.c_custkey, coalesce(o.o_orderkey, s.only_order) AS matched FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW' AND o.o_orderkey % 5 = 0 LEFT JOIN s ON s.k = c.c_custkey"""
)
def fallback_join(spark, sf_dir):
    """By full key, else the only row of the case."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    full = o.where("o_orderpriority = '5-LOW' and o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    single = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("only_order"), F.count("*").alias("n")).where("n = 1")
    return c.join(full, "c_custkey", "left").join(single, "c_custkey", "left").select("c_custkey", F.coalesce("o_orderkey", "only_order").alias("matched"))


@query(
    """WITH RECURSIVE m AS (SELECT DISTINCT o_custkey AS node, CAST(o_totalprice / 100 AS BIGINT) AS key FROM orders),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM m a JOIN m b ON a.key = b.key),
r(node, root) AS (SELECT DISTINCT node, node FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT node, min(root) AS root FROM r GROUP BY node"""
)
def components(spark, sf_dir):
    m = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.round(F.col("o_totalprice") / 100).cast("bigint").alias("key"))
    return graph.groups_by_shared_key(m, "node", "key")


@query(
    """WITH t AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z]+|[0-9]+)'))) AS token, 'c' AS tag FROM conversations),
b AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '([a-z]+|[0-9]+)'))) AS token, 'b' AS tag FROM benchmark)
SELECT token, string_agg(DISTINCT tag, '' ORDER BY tag) AS tags FROM (SELECT token, tag FROM t UNION ALL SELECT token, tag FROM b) GROUP BY token"""
)
def tagged_union(spark, sf_dir):
    def own(name, tag):
        return read(spark, sf_dir, name).select(F.explode(F.array_distinct(strings.tokens(F.col("text")))).alias("token"), F.lit(tag).alias("tag")).distinct()

    return own("conversations", "c").unionByName(own("benchmark", "b")).groupBy("token").agg(F.array_join(F.array_sort(F.collect_set("tag")), "").alias("tags"))


# --- ordered analytics -------------------------------------------------------


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY 1")
def representative_row(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order")
    )


@query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first FROM orders")
def first_of_family(spark, sf_dir):
    return corpus.first_of_family(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "place", "is_first")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_by, count(*) OVER (PARTITION BY text) AS copies, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents")
def dedupe_keep_first(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return corpus.keep_first(d, ["h"], ["doc_id"]).select("doc_id", "kept_by", "copies", "duplicate")


@query(
    """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS turn FROM orders)
SELECT o_orderkey, month, CAST(turn AS INTEGER) AS turn FROM t ORDER BY turn, month LIMIT 50"""
)
def round_robin_month(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return corpus.round_robin(o, "month", "o_orderkey", 50).select("o_orderkey", "month", "turn")


@query(
    """WITH RECURSIVE c AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT n, event_id, day, month, 0 AS used_day, 0 AS used_month FROM c WHERE n = 1
  UNION ALL SELECT c.n, c.event_id, c.day, c.month, CASE WHEN c.day <> r.day THEN 0 ELSE r.used_day + (r.used_month < 300 AND r.used_day < 20)::INT END,
   CASE WHEN c.month <> r.month THEN 0 ELSE r.used_month + (r.used_month < 300 AND r.used_day < 20)::INT END FROM r JOIN c ON c.n = r.n + 1)
SELECT event_id, day, month, used_month < 300 AND used_day < 20 AS allowed, CASE WHEN used_month >= 300 THEN 'month' WHEN used_day >= 20 THEN 'day' END AS denied_by FROM r"""
)
def quota_month_day(spark, sf_dir):
    """The oracle replays the calls one by one."""
    from emberloom.streaming import quota

    return quota.batch_quota(read(spark, sf_dir, "events"), 20, 300)


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_user_turn FROM conversations")
def turn_carry_forward(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return corpus.carry_forward(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "last_user_turn").select("conv_id", "turn", "role", "last_user_turn")


@query(
    """SELECT p_partkey, p_name, p_brand FROM part ORDER BY CASE WHEN p_name LIKE '%bolt%' AND p_brand = 'Brand#11' THEN 0 WHEN p_name LIKE '%bolt%' THEN 1 WHEN p_brand = 'Brand#11' THEN 2 ELSE 3 END, p_partkey LIMIT 25 OFFSET 5"""
)
def name_priority_page(spark, sf_dir):
    exact, registered = F.col("p_name").contains("bolt"), F.col("p_brand") == "Brand#11"
    bucket = F.when(exact & registered, 0).when(exact, 1).when(registered, 2).otherwise(3)
    return read(spark, sf_dir, "part").orderBy(bucket, "p_partkey").offset(5).limit(25).select("p_partkey", "p_name", "p_brand")


# --- evaluation --------------------------------------------------------------

_SCORED_SQL = """WITH s AS (SELECT d.doc_id, d.source, d.lang, l.quality AS y, round(least(1.0, d.n_chars / 8000.0), 3) AS score FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT *, least(1.0, 3.0 / count(*) OVER (PARTITION BY source)) AS w FROM s),
b AS (SELECT score, sum(CASE WHEN y = 1 THEN 1.0 ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN 1.0 ELSE 0 END) AS neg, count(*) AS n FROM s GROUP BY score),
f AS (SELECT score, pos, neg, n, sum(n) OVER (ORDER BY score DESC) AS support, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS precision, sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () AS recall,
  coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
"""


def _scored(spark, sf_dir):
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    score = F.round(F.least(F.lit(1.0), F.col("n_chars") / 8000.0), 3)
    return d.select("doc_id", "source", "lang", "n_chars").join(l, "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("y"), score.alias("score"))


@query(_SCORED_SQL + "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS DOUBLE) AS pos, CAST(sum(neg) AS DOUBLE) AS neg, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM f")
def auc_rank(spark, sf_dir):
    return evaluation.auc(_scored(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


@query(
    _SCORED_SQL
    + """, wb AS (SELECT lang, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg, count(*) AS n FROM c GROUP BY ALL),
wf AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM wb)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(sum(pos), 6) AS pos, round(sum(neg), 6) AS neg, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END, 6) AS auc FROM wf GROUP BY lang"""
)
def auc_weighted(spark, sf_dir):
    rows = evaluation.case_weights(_scored(spark, sf_dir), "source")
    return evaluation.auc(rows, ["lang"], F.col("w")).select("lang", "n", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"), F.round("auc", 6).alias("auc"))


@query(_SCORED_SQL + "SELECT doc_id, source, round(w, 6) AS w FROM c")
def case_weights(spark, sf_dir):
    return evaluation.case_weights(_scored(spark, sf_dir), "source").select("doc_id", "source", F.round("w", 6).alias("w"))


@query(_SCORED_SQL + "SELECT min(CASE WHEN precision >= 0.6 THEN score END) AS threshold, arg_max(score, (precision, support)) AS best_score, round(max(precision), 6) AS best_precision FROM f WHERE support >= 20")
def precision_threshold(spark, sf_dir):
    return evaluation.precision_threshold(_scored(spark, sf_dir), 0.6, 20).withColumn("best_precision", F.round("best_precision", 6))


@query(
    _SCORED_SQL
    + """, p AS (SELECT min(CASE WHEN support >= 30 AND precision >= 0.8 THEN score END) AS risk0, coalesce(max(CASE WHEN recall >= 0.9 THEN score END), 0.0) AS review0 FROM f),
q AS (SELECT coalesce(risk0, (review0 + 1) / 2) AS risk, review0 FROM p), r AS (SELECT risk, CASE WHEN review0 >= risk THEN risk - 1e-6 ELSE review0 END AS review FROM q),
u AS (SELECT round(review / 2, 4) AS c, round(review, 4) AS r, round(risk, 4) AS k FROM r), v AS (SELECT c, greatest(r, round(c + 0.0001, 4)) AS r, k FROM u)
SELECT CAST(c AS DOUBLE) AS caution, CAST(r AS DOUBLE) AS review, CAST(greatest(k, round(r + 0.0001, 4)) AS DOUBLE) AS risk FROM v"""
)
def grade_thresholds(spark, sf_dir):
    return evaluation.grade_cuts(_scored(spark, sf_dir))


@query(
    _SCORED_SQL
    + """, g AS (SELECT CASE WHEN score >= 0.75 THEN 3 WHEN score >= 0.5 THEN 2 WHEN score >= 0.25 THEN 1 ELSE 0 END AS grade, y FROM s),
a AS (SELECT t.grade, count(g.y) AS n, coalesce(sum(g.y), 0) AS pos FROM range(4) t(grade) LEFT JOIN g ON g.grade = t.grade GROUP BY 1)
SELECT grade, n, CAST(pos AS BIGINT) AS pos, round(pos / CAST(nullif(n, 0) AS DOUBLE), 6) AS precision, round(sum(pos) OVER (ORDER BY grade DESC) / CAST(sum(pos) OVER () AS DOUBLE), 6) AS recall_from FROM a"""
)
def grade_table(spark, sf_dir):
    grade = risk.grade_of(F.col("score"), [F.lit(0.25), F.lit(0.5), F.lit(0.75)])
    t = evaluation.grade_table(_scored(spark, sf_dir).select(grade.cast("bigint").alias("grade"), "y"))
    return t.select("grade", "n", "pos", F.round("precision", 6).alias("precision"), F.round("recall_from", 6).alias("recall_from"))


@query(
    _SCORED_SQL
    + """SELECT t.bin, count(s.y) AS n, round(avg(s.score), 6) AS mean_p, round(avg(s.y), 6) AS rate FROM range(10) t(bin) LEFT JOIN s ON least(CAST(floor(s.score * 10) AS BIGINT), 9) = t.bin GROUP BY 1"""
)
def calibration(spark, sf_dir):
    t = evaluation.calibration(_scored(spark, sf_dir).select(F.col("score").alias("p"), "y"))
    return t.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query(_SCORED_SQL + "SELECT round(avg(pow(score - y, 2)), 6) AS brier, round(sum(w * pow(score - y, 2)) / sum(w), 6) AS weighted FROM c")
def brier(spark, sf_dir):
    rows = evaluation.case_weights(_scored(spark, sf_dir), "source")
    return rows.agg(F.round(evaluation.brier(F.col("score"), F.col("y")), 6).alias("brier"), F.round(evaluation.brier(F.col("score"), F.col("y"), F.col("w")), 6).alias("weighted"))


@query(
    _SCORED_SQL
    + """SELECT tau, count(*) FILTER (score >= tau) AS support, round(count(*) FILTER (score >= tau AND y = 1) / CAST(nullif(count(*) FILTER (score >= tau), 0) AS DOUBLE), 6) AS precision,
 round(count(*) FILTER (score >= tau AND y = 1) / CAST(nullif(count(*) FILTER (y = 1), 0) AS DOUBLE), 6) AS recall FROM s, (SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS tau) GROUP BY tau"""
)
def threshold_grid(spark, sf_dir):
    t = evaluation.threshold_grid(_scored(spark, sf_dir), [0.1, 0.3, 0.5, 0.7, 0.9])
    return t.select("tau", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    _SCORED_SQL + """, x AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) + below AS good, sum(n) OVER () AS total FROM f)
SELECT arg_max(score, (good, -score)) AS threshold, round(max(good) / any_value(total), 6) AS accuracy FROM x"""
)
def best_accuracy(spark, sf_dir):
    return evaluation.best_accuracy(_scored(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    """WITH s AS (SELECT n_chars AS a, y FROM (SELECT d.n_chars, l.toxic + 2 * l.quality AS y FROM documents d JOIN labels l USING (doc_id))),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb FROM s)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r"""
)
def spearman(spark, sf_dir):
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = d.select("doc_id", F.col("n_chars").alias("a")).join(l, "doc_id").select("a", (F.col("toxic") + 2 * F.col("quality")).alias("b"))
    return evaluation.spearman(rows, "a", "b").withColumn("rho", F.round("rho", 6))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS z FROM orders")
def zscore(spark, sf_dir):
    return evaluation.z_scores(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "z").select("o_orderkey", F.round("z", 6).alias("z"))


@query(
    """SELECT source, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.25), 4) AS q1, round(quantile_cont(n_chars, 0.75), 4) AS q3,
 min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY source"""
)
def quartiles(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(*evaluation.quartiles("n_chars"))


@query("SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low, count(*) AS total FROM orders GROUP BY 1")
def confusion(spark, sf_dir):
    p = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"))
    return p.agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"), F.count("*").alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 4) AS mean, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def grouping_report(spark, sf_dir):
    flag, status = "l_returnflag", "l_linestatus"
    cube = read(spark, sf_dir, "lineitem").select(flag, status, "l_discount").cube(flag, status)
    return cube.agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean"), F.grouping_id(flag, status).cast("bigint").alias("level"))


_CUTS_SQL = " + ".join(f"(u >= {c})::INT" for c in evaluation.POISSON_CUTS)


@query(
    _SCORED_SQL
    + f""", r AS (SELECT source, range AS replicate, CAST(('0x' || substr(md5('0:' || range || ':' || source), 1, 13)) AS BIGINT) / CAST(pow(16, 13) AS DOUBLE) AS u FROM (SELECT DISTINCT source FROM s), range(1000)),
t AS (SELECT source, replicate, {_CUTS_SQL} AS times FROM r),
rb AS (SELECT replicate, score, sum(CASE WHEN y = 1 THEN times ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN times ELSE 0 END) AS neg FROM s JOIN t USING (source) WHERE times > 0 GROUP BY ALL),
rf AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM rb),
ra AS (SELECT replicate, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM rf GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT count(*) AS replicates, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM ra"""
)
def bootstrap_interval(spark, sf_dir):
    found = evaluation.interval(evaluation.bootstrap_auc(_scored(spark, sf_dir), "source", 1000))
    return found.select("replicates", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# --- sampling ----------------------------------------------------------------


@query(
    """WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('7:', doc_id)), doc_id) AS place FROM documents)
SELECT doc_id, lang, CAST(place AS INTEGER) AS place FROM t WHERE place <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 10 ELSE 5 END"""
)
def stratified_sample(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    quotas = d.select("lang").distinct().withColumn("quota", F.when(F.col("lang") == "en", 20).when(F.col("lang") == "de", 10).otherwise(5))
    return sampling.stratified(d, "lang", "doc_id", quotas, 7).select("doc_id", "lang", "place")


@query("SELECT doc_id, CAST(('0x' || substr(md5('3:' || source), 1, 8)) AS BIGINT) % 5 AS fold FROM documents")
def folds(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", sampling.fold_of(3, 5, "source").alias("fold"))


@query(
    """WITH s AS (SELECT source AS key, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT *, size * 100 / CAST(sum(size) OVER () AS DOUBLE) AS exact FROM s),
f AS (SELECT *, least(size, greatest(1, CAST(floor(exact) AS BIGINT))) AS base FROM t),
g AS (SELECT *, least(100, sum(size) OVER ()) - sum(base) OVER () AS missing, row_number() OVER (ORDER BY (base < size) DESC, exact - floor(exact) DESC, key) AS place, row_number() OVER (ORDER BY base DESC, key) AS over_place FROM f)
SELECT key, size, CAST(base + CASE WHEN missing > 0 AND base < size AND place <= missing THEN 1 WHEN missing < 0 AND base > 1 AND over_place <= -missing THEN -1 ELSE 0 END AS BIGINT) AS quota FROM g"""
)
def largest_remainder(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("size"))
    return sampling.largest_remainder(sizes, 100, "key")


@query(
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM c)
SELECT o_custkey, o_orderpriority AS modal, n FROM r WHERE k = 1"""
)
def modal_value(spark, sf_dir):
    return sampling.modal(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    """WITH a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY md5(concat('0:', o_orderkey)), o_orderkey) AS place FROM orders), b AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY md5(concat('1:', p_partkey)), p_partkey) AS place FROM part)
SELECT CAST(place AS INTEGER) AS place, a.k AS left_key, b.k AS right_key FROM a JOIN b USING (place) WHERE place <= 100 AND a.k <> b.k"""
)
def random_negative_pairs(spark, sf_dir):
    return sampling.random_pairs(read(spark, sf_dir, "orders"), "o_orderkey", read(spark, sf_dir, "part"), "p_partkey", 100)


# --- merging -----------------------------------------------------------------


def _versions(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    old = p.where("p_partkey % 10 <> 1").withColumn("version", F.lit(1))
    new = p.where("p_partkey % 3 = 0 or p_partkey % 10 = 1").withColumn("p_size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 100).otherwise(F.col("p_size"))).withColumn("version", F.lit(2))
    return old, new


_VERSIONS_SQL = """WITH old AS (SELECT p_partkey, p_name, p_size, 1 AS version FROM part WHERE p_partkey % 10 <> 1),
new AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size, 2 AS version FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 10 = 1)
"""


@query(_VERSIONS_SQL + "SELECT p_partkey, arg_max(p_name, version) AS p_name, arg_max(p_size, version) AS p_size, max(version) AS version FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY 1")
def merge_upsert(spark, sf_dir):
    return merge.upsert(*_versions(spark, sf_dir), "p_partkey", "version")


@query(_VERSIONS_SQL + "SELECT * FROM old WHERE p_partkey NOT IN (SELECT p_partkey FROM new)")
def prune(spark, sf_dir):
    return merge.pruned(*_versions(spark, sf_dir), "p_partkey")


@query(
    _VERSIONS_SQL
    + """SELECT p_partkey, CASE WHEN o.p_name IS NULL THEN 'inserted' WHEN n.p_name IS NULL THEN 'kept' WHEN o.p_name = n.p_name AND o.p_size = n.p_size THEN 'unchanged' ELSE 'conflict' END AS state FROM old o FULL JOIN new n USING (p_partkey)"""
)
def staging_states(spark, sf_dir):
    old, new = (v.drop("version") for v in _versions(spark, sf_dir))
    return merge.staged(old, new, "p_partkey")


@query(
    _VERSIONS_SQL
    + """SELECT 'p_name' AS "column", count(*) FILTER (o.p_name IS DISTINCT FROM n.p_name) AS changed FROM old o LEFT JOIN new n USING (p_partkey)
UNION ALL SELECT 'p_size', count(*) FILTER (o.p_size IS DISTINCT FROM n.p_size) FROM old o LEFT JOIN new n USING (p_partkey)"""
)
def unchanged_violations(spark, sf_dir):
    old, new = (v.drop("version") for v in _versions(spark, sf_dir))
    return merge.changed_cells(old, new, "p_partkey")


# --- risk --------------------------------------------------------------------

_AXES_SQL = """WITH f AS (SELECT o_orderkey AS id, o_custkey % 50 AS q, CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS a, CAST((o_orderkey * 53) % 97 AS DOUBLE) / 96 AS b, CAST((o_orderkey * 71) % 89 AS DOUBLE) / 88 AS c,
  CAST((o_orderkey * 29) % 83 AS DOUBLE) / 82 AS d, CAST((o_orderkey * 13) % 79 AS DOUBLE) / 78 AS e FROM orders)
"""


def _axes(spark, sf_dir, named=True):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def part(m, n):
        return ((k * m) % n).cast("double") / (n - 1)

    none = F.lit(None).cast("double")
    return o.select(
        k.alias("id"),
        (F.col("o_custkey") % 50).alias("q"),
        part(37, 101).alias("x1_d") if named else none.alias("x1_d"),
        part(53, 97).alias("x2_text_d") if named else none.alias("x2_text_d"),
        part(71, 89).alias("x3_d"),
        (k % 3 == 0).alias("has_meaning_both"),
        F.when(k % 4 != 0, part(29, 83)).alias("x2_whole"),
        F.when(k % 5 != 0, part(13, 79)).alias("x4"),
        F.lit(True).alias("has_distinctive_a"),
        (k % 7 != 0).alias("has_distinctive_b"),
        F.when(k % 6 == 0, "figure").when(k % 6 == 1, "combined-figure").when(k % 6 == 2, "combined-text").otherwise("text").alias("mark_type"),
    )


def _risk_sql(named: bool) -> str:
    values = ", ".join(f"('{key}', {icpt}, {', '.join(map(str, w))}, {', '.join(map(str, risk.CUTS.get(key, risk.CUTS['named'])))})" for key, (icpt, w) in risk.BLOCKS.items())
    x1, x2 = ("a", "b") if named else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    return (
        _AXES_SQL
        + f""", g AS (SELECT id, q, {x1} AS x1, {x2} AS x2t, CASE WHEN id % 3 = 0 THEN c END AS x3, CASE WHEN id % 4 <> 0 THEN d END AS x2w, CASE WHEN id % 5 <> 0 THEN e END AS x4,
  CASE WHEN id % 7 <> 0 THEN 0.0 ELSE 1.0 END AS nd, id % 6 IN (0, 1) AS fig FROM f),
h AS (SELECT *, coalesce(nullif(concat_ws('+', CASE WHEN x2w IS NOT NULL THEN 'x2_whole' END, CASE WHEN x4 IS NOT NULL THEN 'x4' END), ''), 'base') AS k0 FROM g),
i AS (SELECT *, CASE WHEN x1 IS NULL AND x2t IS NULL AND x2w IS NOT NULL THEN 'noname:' || k0 ELSE k0 END AS pattern FROM h),
w(pattern, icpt, w1, w2, w3, w4, w5, w6, w7, w8, w9, c1, c2, c3) AS (VALUES {values}),
j AS (SELECT i.*, icpt + w1 * coalesce(x1, 0) + w2 * coalesce(x2t, 0) + w3 * coalesce(x3, 0) + w4 * nd + w5 * CASE WHEN fig THEN 0 ELSE coalesce(x1, 0) END + w6 * coalesce(x1, 0) * nd
  + w7 * coalesce(x2w, 0) + w8 * CASE WHEN fig THEN coalesce(x2w, 0) ELSE 0 END + w9 * coalesce(x4, 0) AS logit, c1, c2, c3 FROM i JOIN w USING (pattern)),
p AS (SELECT *, 1 / (1 + exp(-logit)) AS p FROM j),
r AS (SELECT *, CASE WHEN p >= c3 THEN 3 WHEN p >= c2 THEN 2 WHEN p >= c1 THEN 1 ELSE 0 END AS g0 FROM p),
s AS (SELECT *, CASE WHEN coalesce(x1 >= 0.98, false) OR coalesce(x2t >= 0.75, false) OR coalesce(x3 >= 0.7707, false) OR (fig AND coalesce(x2w >= 0.9, false)) THEN greatest(g0, 2) ELSE g0 END AS grade,
  (round(p, 6) - CASE g0 WHEN 0 THEN 0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END) / (CASE g0 WHEN 0 THEN c1 WHEN 1 THEN c2 WHEN 2 THEN c3 ELSE 1 END - CASE g0 WHEN 0 THEN 0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END) AS band FROM r)
"""
    )


@query(_risk_sql(True) + "SELECT id, pattern, round(p, 6) AS p, CAST(grade AS INTEGER) AS grade, fig AS figure_caveat, round(logit, 6) AS logit FROM s")
def risk_score_named(spark, sf_dir):
    scored = risk.score(_axes(spark, sf_dir))
    total = F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, x: a + x)
    return scored.select("id", "pattern", F.round("p", 6).alias("p"), "grade", "figure_caveat", F.round(total, 6).alias("logit"))


@query(_risk_sql(False) + "SELECT id, pattern, round(p, 6) AS p, CAST(grade AS INTEGER) AS grade FROM s")
def risk_score_nameless(spark, sf_dir):
    return risk.score(_axes(spark, sf_dir, named=False)).select("id", "pattern", F.round("p", 6).alias("p"), "grade")


@query(
    _risk_sql(True)
    + """, t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY g0 DESC, round(band, 9) DESC, coalesce(x2w, -1) DESC, id) AS rank FROM s) SELECT q, id, CAST(rank AS INTEGER) AS rank, CAST(grade AS INTEGER) AS grade FROM t WHERE rank <= 5"""
)
def risk_ranking(spark, sf_dir):
    scored = risk.score(_axes(spark, sf_dir)).withColumn("rank_band", F.round("rank_band", 9))
    return risk.ranked(scored, "q", "id", 5).select("q", "id", "rank", "grade")


@query(
    _risk_sql(True)
    + """, t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY g0 DESC, round(band, 9) DESC, coalesce(x2w, -1) DESC, id) AS rank FROM s), u AS (SELECT *, CASE WHEN starts_with(pattern, 'noname:') THEN 'noname' ELSE 'named' END AS kind FROM t WHERE rank <= 5),
m AS (SELECT q, max(grade) AS og FROM u GROUP BY q), x AS (SELECT u.q, m.og, arg_min(pattern, rank) AS pattern, arg_min(kind, rank) AS kind FROM u JOIN m USING (q) WHERE grade = og GROUP BY ALL)
SELECT x.q, CAST(x.og AS INTEGER) AS overall_grade, x.pattern, round(max(u.p), 6) AS max_p FROM x JOIN u ON u.q = x.q AND u.kind = x.kind GROUP BY ALL"""
)
def overall_grade(spark, sf_dir):
    scored = risk.score(_axes(spark, sf_dir)).withColumn("rank_band", F.round("rank_band", 9))
    found = risk.overall(risk.ranked(scored, "q", "id", 5), "q")
    return found.select("q", "overall_grade", "pattern", F.round("max_p", 6).alias("max_p"))


def _coupling_sql() -> str:
    """Logits of both blocks at each vertex, by plain arithmetic from the coefficients."""
    def logit(key: str, image: str, goods: str) -> str:
        icpt, (w1, w2, w3, wn, wt, wx, wi, wf, wg) = risk.BLOCKS[key]
        return (
            f"round({icpt} + {w1} * a + {w2} * b + {w3} * c + {wn} * nd + {wt} * (CASE WHEN figure THEN 0 ELSE a END) + {wx} * a * nd"
            f" + {wi} * {image} + {wf} * (CASE WHEN figure THEN {image} ELSE 0 END) + {wg} * {goods}, 6)"
        )

    steps = [("base", "x2_whole", "0", "0", risk.IMAGE_FLOOR, "0"), ("base", "x4", "0", "0", "0", risk.GOODS_FLOOR)]
    for v in ("0.0", "1.0"):
        steps += [("x2_whole", "x2_whole+x4", v, "0", v, risk.GOODS_FLOOR), ("x4", "x2_whole+x4", "0", v, risk.IMAGE_FLOOR, v)]
    grid = """WITH v AS (SELECT a, b, c, d AS has_distinctive_b, f AS figure, CASE WHEN d THEN 0 ELSE 1 END AS nd FROM (VALUES (0.0), (1.0)) t1(a), (VALUES (0.0), (1.0)) t2(b), (VALUES (0.0), (1.0)) t3(c),
 (VALUES (true), (false)) t4(d), (VALUES (true), (false)) t5(f))"""
    parts = [
        f"SELECT CAST(a AS DOUBLE) AS x1_d, CAST(b AS DOUBLE) AS x2_text_d, CAST(c AS DOUBLE) AS x3_d, has_distinctive_b, figure, '{lo}' AS lower, '{up}' AS upper,"
        f" CAST({logit(lo, i2, g2)} AS DOUBLE) AS low, CAST({logit(up, i3, g3)} AS DOUBLE) AS high FROM v"
        for lo, up, i2, g2, i3, g3 in steps
    ]
    return grid + "\n" + "\nUNION ALL ".join(parts)


@query(_coupling_sql())
def coupling_vertices(spark, sf_dir):
    t = risk.coupling_table(spark)
    return t.select(*[c for c in t.columns if c not in ("low", "high")], F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def goods_floor(spark, sf_dir):
    out = risk.goods_floor(_axes(spark, sf_dir, named=False), "id")
    return out.select("id", "pattern", F.round("p", 6).alias("p"), "grade", "goods_floor")




# --- phonetics (Arrow UDFs; no SQL form, tests hold them against brute force) ------


def _name_pairs(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    a, b = n.select(F.col("name").alias("name_a")), n.select(F.col("name").alias("name_b"))
    return a.join(b, F.col("name_a") < F.col("name_b"))


@query()
def phonetic_similarity(spark, sf_dir):
    from emberloom.functions import phonetic

    return _name_pairs(spark, sf_dir).select("name_a", "name_b", F.round(phonetic.phonetic_similarity_udf("name_a", "name_b"), 4).alias("similarity"))


@query()
def spelling_v2(spark, sf_dir):
    from emberloom.functions import phonetic

    return _name_pairs(spark, sf_dir).select("name_a", "name_b", F.round(phonetic.assigned_similarity_udf("name_a", "name_b"), 4).alias("similarity"))


@query()
def lcs_rule(spark, sf_dir):
    from emberloom.functions import phonetic

    pairs = _name_pairs(spark, sf_dir).select("name_a", "name_b", phonetic.tokens_udf("name_a").alias("ta"), phonetic.tokens_udf("name_b").alias("tb"))
    return pairs.select("name_a", "name_b", phonetic.common_run_udf("ta", "tb").alias("run"))


@query()
def hash_embed(spark, sf_dir):
    from emberloom.functions import phonetic

    n = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return n.select("name", F.transform(phonetic.hash_embedding_udf("name"), lambda x: F.round(x, 6)).alias("vector"))


@query()
def search_flagship(spark, sf_dir):
    """Parts as marks with their supplier brands as codes and embeddings by id; queries of all input kinds, every row whose id is divisible by 100."""
    from emberloom.operators import meaning, search

    p, e = read(spark, sf_dir, "part"), read(spark, sf_dir, "embeddings")
    code = F.array(F.concat(F.lit("G"), F.lpad(F.regexp_extract("p_brand", "[0-9]+", 0), 4, "0")), F.concat(F.lit("S"), F.lpad(F.col("p_size").cast("string"), 4, "0")))
    m = p.join(e, p["p_partkey"] == e["vec_id"], "left").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), code.alias("codes"), "embedding")
    pick = m.where("id % 100 = 0")
    # ids are hundreds: their hundreds count decides which inputs a query has
    nth = F.expr("id div 100")
    q = pick.select(
        F.col("id").alias("query_id"), F.when(nth % 2 == 1, F.col("title")).alias("name"), F.when(nth % 3 != 0, F.col("codes")).alias("goods"),
        F.when(nth % 4 != 3, F.col("embedding")).alias("embedding"), F.lit("text").alias("mark_type"),
    )
    stats = corpus.token_stats(p.select(F.col("p_name").alias("title"), F.col("p_brand").alias("owner")))
    words = stats.select("token", (F.log10("n") + 2).alias("zipf"))
    # names are few and repeat: each is read for words and embedded once
    names = p.select(F.col("p_name").alias("title")).distinct()
    meant = meaning.embedded(meaning.has_meaning(names, "title", words), "title", out="title_vector")
    m = m.join(meant, "title", "left")
    q = q.join(meant.withColumnsRenamed({"title": "name", "title_vector": "name_vector"}), "name", "left")
    found = search.candidates(q, m, stats, words, 5)
    return found.select("query_id", "id", "rank", "grade", "pattern", F.round("x3_d", 4).alias("x3"), F.round("p", 6).alias("p"), "sources")


@query(
    _SCORED_SQL
    + """, n AS (SELECT CASE WHEN score >= 0.75 THEN 3 WHEN score >= 0.5 THEN 2 WHEN score >= 0.25 THEN 1 ELSE 0 END AS g FROM s),
x AS (SELECT round(1 - score / 2, 3) AS p, doc_id % 11 = 0 AS lifted FROM s), t(grade) AS (VALUES (1), (2), (3)),
k AS (SELECT grade, (SELECT count(*) FROM n WHERE g >= grade) - CASE WHEN grade < 3 THEN (SELECT count(*) FROM x WHERE lifted) ELSE 0 END AS need FROM t),
a AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS place FROM x), fr AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS place FROM x WHERE NOT lifted)
SELECT CAST(k.grade AS BIGINT) AS grade, floor(coalesce(CASE WHEN k.grade = 3 THEN a.p ELSE fr.p END, NULL) * 10000) / 10000 AS cut FROM k LEFT JOIN a ON a.place = need LEFT JOIN fr ON fr.place = need"""
)
def matched_cuts(spark, sf_dir):
    s = _scored(spark, sf_dir)
    named = s.select(risk.grade_of(F.col("score"), [F.lit(0.25), F.lit(0.5), F.lit(0.75)]).alias("grade"))
    return evaluation.matched_cuts(named, s.select(F.round(1 - F.col("score") / 2, 3).alias("p"), (F.col("doc_id") % 11 == 0).alias("lifted")))


@query(
    _SCORED_SQL
    + """, u AS (SELECT lang, source, score, y FROM s UNION ALL SELECT lang, NULL, score, y FROM s UNION ALL SELECT NULL, NULL, score, y FROM s),
v AS (SELECT lang, source, score, sum(y) AS pos, sum(1 - y) AS neg FROM u GROUP BY ALL),
z AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang, source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
SELECT lang, source, CAST(sum(pos + neg) AS BIGINT) AS n, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / CAST(sum(pos) * sum(neg) AS DOUBLE) END, 6) AS auc FROM z GROUP BY lang, source"""
)
def slice_report(spark, sf_dir):
    found = evaluation.slice_report(_scored(spark, sf_dir), [["lang", "source"], ["lang"], []])
    return found.select("lang", "source", "n", F.round("auc", 6).alias("auc"))


@query(
    _TOPK_SQL
    + """, e AS (SELECT t.*, a.label AS la, b.label AS lb FROM t JOIN embeddings a ON a.vec_id = t.query_id JOIN embeddings b ON b.vec_id = t.id WHERE t.id <> t.query_id),
x AS (SELECT query_id, min(CASE WHEN la = lb THEN rank - 1 END) AS rank, max(CASE WHEN la = lb THEN score END) AS score, max(CASE WHEN la <> lb THEN score END) AS best_other FROM e GROUP BY query_id)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(score), 6) AS mean_score,
 round(quantile_cont(score, 0.5), 6) AS median_score, round(avg(score - best_other), 6) AS mean_margin FROM x"""
)
def retrieval_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    top = _topk(spark, sf_dir, e.count())
    la, lb = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb"))
    rows = top.where("id <> query_id").join(la, "query_id").join(lb, "id")
    same = F.col("la") == F.col("lb")
    x = rows.groupBy("query_id").agg(F.min(F.when(same, F.col("rank") - 1)).alias("rank"), F.max(F.when(same, F.col("score"))).alias("score"), F.max(F.when(~same, F.col("score"))).alias("best_other"))
    m = evaluation.retrieval_metrics(x)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mean_score", "median_score", "mean_margin")])


@query("SELECT CAST(strftime(d, '%Y%m') AS VARCHAR) AS month FROM range(DATE '1992-01-01', DATE '1998-12-02', INTERVAL 1 MONTH) t(d)")
def month_range(spark, sf_dir):
    return spark.range(1).select(F.explode(F.expr("sequence(date'1992-01-01', date'1998-12-01', interval 1 month)")).alias("d")).select(F.date_format("d", "yyyyMM").alias("month"))


@query(
    """SELECT query_id, vec_id, CASE WHEN s < 0.45 THEN 'low' WHEN s < 0.55 THEN 'weak' WHEN s < 0.75 THEN 'possible' ELSE 'strong' END AS band FROM (
 SELECT z.vec_id AS query_id, e.vec_id, round(CAST(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])) AS DOUBLE), 6) AS s FROM embeddings e, embeddings z WHERE z.vec_id % 100 = 0)"""
)
def similarity_bands(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = retrieval.against_all(q, e, F.round(vectors.dot("embedding", "q"), 6))
    return scored.select("query_id", "vec_id", vectors.similarity_band(F.col("score")).alias("band"))


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS v FROM orders), b AS (SELECT k, list_sort(list(v)) AS vs FROM a GROUP BY k)
SELECT vs AS pattern, count(*) AS n FROM b GROUP BY vs"""
)
def pattern_counts(spark, sf_dir):
    own = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("pattern"))
    return own.groupBy("pattern").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT o_custkey AS k, o_orderpriority AS tag, o_orderstatus AS hit, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT tag, sum(n) AS received, sum(CASE WHEN hit = 'F' THEN n ELSE 0 END) AS good FROM r GROUP BY tag)
SELECT tag, CAST(received AS BIGINT) AS received, CAST(good AS BIGINT) AS good, round(good / CAST(received AS DOUBLE), 6) AS precision, round(good / CAST(sum(good) OVER () AS DOUBLE), 6) AS recall, good / CAST(received AS DOUBLE) >= 0.49 AS adopt, good < 30 AS shaky FROM t"""
)
def evidence_table(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.count("*").alias("received"), F.count_if(F.col("o_orderstatus") == "F").alias("good"))
    total = g.agg(F.sum("good").alias("total"))
    share = F.col("good") / F.col("received")
    return g.crossJoin(F.broadcast(total)).select(
        "tag", "received", "good", F.round(share, 6).alias("precision"), F.round(F.col("good") / F.col("total"), 6).alias("recall"), (share >= 0.49).alias("adopt"), (F.col("good") < 30).alias("shaky")
    )


from emberloom.plans import case_queries, ingest_queries, report_queries, selection_queries  # noqa: E402, F401  they register their queries

__all__ = ["ORACLES", "QUERIES"]
