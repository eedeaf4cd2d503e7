"""Queries of paged ingest, cursors, promotion, quarantine and label updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberloom.operators import ingest
from emberloom.plans.registry import Bound, query, read

#: customers as sources, their orders as items, five to a page
_ITEMS_SQL = """WITH i AS (SELECT o_custkey AS source, o_orderkey AS item, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 5) AS INTEGER) AS k FROM orders),
g AS (SELECT source, k + 1 AS page_no, list(item ORDER BY item) AS items, sum(count(*)) OVER (PARTITION BY source) AS total FROM i GROUP BY source, k),
r AS (SELECT source, page_no, CASE WHEN source % 4 = 1 AND page_no = 3 THEN (SELECT x.items FROM g x WHERE x.source = g.source AND x.page_no = 1) ELSE items END AS items, CASE WHEN source % 3 = 0 THEN NULL ELSE total END AS total, source % 5 = 2 AND page_no = 2 AS failed FROM g)
"""


def _pages(spark, sf_dir):
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("item"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("item")) - 1
    pages = o.withColumn("page_no", (F.floor(place / 5) + 1).cast("int")).groupBy("source", "page_no").agg(F.array_sort(F.collect_list("item")).alias("items"))
    total = o.groupBy("source").agg(F.count("*").alias("total"))
    first = pages.where("page_no = 1").select("source", F.col("items").alias("_first"))
    s, p = F.col("source"), F.col("page_no")
    joined = pages.join(total, "source").join(first, "source")
    return joined.select(
        "source", "page_no", F.when((s % 4 == 1) & (p == 3), F.col("_first")).otherwise(F.col("items")).alias("items"), F.when(s % 3 != 0, F.col("total")).alias("total"),
        ((s % 5 == 2) & (p == 2)).alias("failed"),
    )


_READ_SQL = (
    _ITEMS_SQL
    + """, j AS (SELECT *, len(items) AS n, min(page_no) OVER (PARTITION BY source, items) < page_no AS repeat FROM r WHERE page_no <= 4),
s AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN repeat THEN 'repeat' WHEN n < 5 OR coalesce(page_no * 5 >= total, false) THEN 'last' ELSE 'page' END AS state FROM j),
t AS (SELECT *, min(CASE WHEN state <> 'page' THEN page_no END) OVER (PARTITION BY source) AS stop FROM s),
d AS (SELECT source, page_no, CAST(n AS INTEGER) AS n_items, state FROM t WHERE page_no <= coalesce(stop, 999) AND state <> 'repeat')
"""
)


@query(_READ_SQL + "SELECT * FROM d")
def pages_read(spark, sf_dir):
    return ingest.read_pages(_pages(spark, sf_dir), 5, 4)


@query(
    _READ_SQL
    + """, c AS (SELECT c_custkey AS source, 1 AS page, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 10 END AS rows_per_page FROM customer), e AS (SELECT source, max(CASE WHEN state <> 'failed' THEN page_no END) AS last, max((state = 'last')::INT) AS done FROM d GROUP BY source)
SELECT source, CAST(coalesce(last + 1, CASE WHEN c.rows_per_page = 5 THEN c.page ELSE 1 END, 1) AS INTEGER) AS page, CAST(5 AS INTEGER) AS rows_per_page FROM c FULL JOIN e USING (source) WHERE coalesce(done, 0) = 0"""
)
def cursors_after(spark, sf_dir):
    current = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.lit(1).alias("page"), F.when(F.col("c_custkey") % 2 == 0, 5).otherwise(10).alias("rows_per_page"))
    return ingest.cursors(current, ingest.read_pages(_pages(spark, sf_dir), 5, 4), 5)


@query(
    """WITH i AS (SELECT o_custkey AS name, o_orderkey % 40 AS number, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4) AS INTEGER) + 1 AS page_no FROM orders),
t AS (SELECT name, count(DISTINCT number) AS total FROM i GROUP BY name), f AS (SELECT name, number, min(page_no) AS page_no FROM i WHERE page_no <= 5 GROUP BY ALL),
p AS (SELECT DISTINCT name, page_no FROM i WHERE page_no <= 5), a AS (SELECT p.name, p.page_no, count(f.number) AS added FROM p LEFT JOIN f USING (name, page_no) GROUP BY ALL),
w AS (SELECT *, coalesce(sum(added) OVER (PARTITION BY name ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(max((added = 0)::INT) OVER (PARTITION BY name ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idle FROM a)
SELECT name, CAST(sum(added) AS BIGINT) AS found, any_value(total) AS total, sum(added) = any_value(total) AS complete FROM w JOIN t USING (name) WHERE idle = 0 AND before < 500 AND before < total GROUP BY name"""
)
def name_searches(spark, sf_dir):
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderkey") % 40).alias("number"), "o_orderkey")
    place = F.row_number().over(Window.partitionBy("name").orderBy("o_orderkey")) - 1
    paged = o.withColumn("page_no", (F.floor(place / 4) + 1).cast("int")).groupBy("name", "page_no")
    pages = paged.agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "number"))), lambda x: F.struct(x["number"].alias("number"))).alias("items"))
    return ingest.name_search(pages.join(o.groupBy("name").agg(F.count_distinct("number").alias("total")), "name"))


@query("SELECT p_name AS name, CAST(row_number() OVER (ORDER BY p_name) AS INTEGER) AS place FROM (SELECT DISTINCT p_name FROM part) WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 5)")
def pending_files(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return ingest.pending(p.select(F.col("p_name").alias("name")).distinct(), p.where("p_size < 5").select(F.col("p_name").alias("name")))


_RUNTIME = Bound("part", number="p_partkey", image="'i' || CAST(p_partkey AS STRING)", title="p_name", year="1990 + p_size % 20", keep="p_partkey % 3 <> 0")
_STAGED = Bound(
    "part",
    number="p_partkey",
    image="CASE WHEN p_partkey % 50 = 6 THEN 'i' || CAST(p_partkey + 1 AS STRING) ELSE 'i' || CAST(p_partkey AS STRING) END",
    title="CASE WHEN p_partkey % 40 = 1 THEN p_name || '!' ELSE p_name END",
    year="1990 + p_size % 20",
    keep="p_partkey % 2 = 0 OR p_partkey % 40 = 1",
)


def _staging(spark, sf_dir):
    return tuple(b(spark, sf_dir).where("keep").drop("keep") for b in (_RUNTIME, _STAGED))


@query(
    f"""WITH r AS (SELECT * FROM ({_RUNTIME.sql}) WHERE keep), s AS (SELECT * FROM ({_STAGED.sql}) WHERE keep), j AS (SELECT coalesce(r.number, s.number) AS number, r.number IS NULL AS fresh, s.number IS NULL AS old,
  r.image = s.image AND r.title = s.title AND r.year = s.year AS same, s.image AS image, s.number AS sn FROM r FULL JOIN s ON r.number = s.number), o AS (SELECT image, min(number) AS owner FROM r GROUP BY image)
SELECT j.number, CASE WHEN sn IS NOT NULL AND owner IS NOT NULL AND owner <> j.number THEN 'owned_elsewhere' WHEN fresh THEN 'inserted' WHEN old THEN 'kept' WHEN same THEN 'unchanged' ELSE 'conflict' END AS state FROM j LEFT JOIN o USING (image)"""
)
def promotion_states(spark, sf_dir):
    return ingest.promoted(*_staging(spark, sf_dir), "number", "image")


@query(
    f"""WITH r AS (SELECT * FROM ({_RUNTIME.sql}) WHERE keep), s AS (SELECT * FROM ({_STAGED.sql}) WHERE keep AND number % 40 <> 1 AND number % 50 <> 6), f AS (SELECT * FROM s WHERE number NOT IN (SELECT number FROM r)), m AS (SELECT * FROM r UNION ALL SELECT * FROM f)
SELECT (SELECT count(*) FROM f) AS new_records, (SELECT count(*) FROM s WHERE number IN (SELECT number FROM r)) AS unchanged_records, count(*) AS records, CAST(min(year) AS VARCHAR) || ' ~ ' || CAST(max(year) AS VARCHAR) AS years FROM m"""
)
def promotion_header(spark, sf_dir):
    runtime, staging = _staging(spark, sf_dir)
    clean = staging.where("number % 40 <> 1 and number % 50 <> 6")
    return ingest.promotion(runtime, clean, "number", "image", F.col("year"))[1]


@query("SELECT 'part' AS \"table\", count(*) AS rows, count(*) FILTER (p_partkey = 7) AS removed FROM part UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_partkey = 7) FROM lineitem")
def quarantine_manifest(spark, sf_dir):
    tables = {"part": read(spark, sf_dir, "part"), "lineitem": read(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")}
    return ingest.quarantined(tables, "p_partkey", F.lit(7))[1].drop("digest")


_ROWS = Bound(
    "orders",
    case_no="o_orderkey",
    verdict="CASE WHEN o_orderkey % 3 = 0 THEN '유사' ELSE '' END",
    source="CASE WHEN o_orderkey % 3 = 0 THEN 'llm' ELSE '' END",
    confirmed="o_orderkey % 3 <> 0 AND o_orderkey % 7 = 1",
    original="CAST(NULL AS STRING)",
)


@query(
    f"""WITH r AS ({_ROWS.sql}) SELECT case_no, CASE WHEN case_no % 4 = 0 THEN '비유사' WHEN case_no % 6 = 3 THEN '제외' ELSE verdict END AS verdict, CASE WHEN case_no % 4 = 0 THEN 'human' WHEN case_no % 6 = 3 THEN 'llm' ELSE source END AS source,
 CASE WHEN case_no % 4 = 0 THEN true WHEN case_no % 6 = 3 THEN false ELSE confirmed END AS confirmed, CASE WHEN case_no % 4 = 0 AND source = 'llm' THEN verdict END AS original FROM r"""
)
def labels_applied(spark, sf_dir):
    rows = _ROWS(spark, sf_dir)
    k = F.col("case_no")
    human, model = k % 4 == 0, (k % 4 != 0) & (k % 6 == 3)
    new = rows.where(human | model).select("case_no", F.when(human, "비유사").otherwise("제외").alias("verdict"), F.when(human, "human").otherwise("llm").alias("source"), F.lit("근거").alias("evidence"))
    return ingest.labelled(rows, new, ["case_no"])


@query(
    """SELECT p_partkey AS number, CASE WHEN p_size <= 10 THEN CASE WHEN p_partkey % 2 = 0 THEN 'm' END ELSE CASE WHEN p_partkey % 4 = 0 THEN 'm' END END AS memo,
 CASE WHEN p_size > 10 THEN 'outside' WHEN (CASE WHEN p_partkey % 2 = 0 THEN 'm' END) IS DISTINCT FROM (CASE WHEN p_partkey % 4 = 0 THEN 'm' END) THEN 'memo_changed' ELSE 'same' END AS state FROM part"""
)
def plan_sync(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    records = p.select(k.alias("number"), F.when(k % 4 == 0, "m").alias("memo"))
    return ingest.synced(records, p.where("p_size <= 10").select(k.alias("number"), F.when(k % 2 == 0, "m").alias("memo")), "number")


_TARGETS = Bound("orders", kind="CASE o_orderkey % 4 WHEN 0 THEN 'registration' WHEN 1 THEN 'application' WHEN 2 THEN 'international' ELSE 'unknown' END", number="CASE WHEN o_custkey % 9 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END", pos="o_orderkey")
_EXISTING = Bound("customer", kind="CASE c_custkey % 3 WHEN 0 THEN 'registration' WHEN 1 THEN 'application' ELSE 'international' END", number="CAST(c_custkey AS STRING)", result="CASE c_custkey % 5 WHEN 0 THEN '0건' WHEN 1 THEN '오류' ELSE 'ok' END")


@query(
    f"""WITH t AS (SELECT kind, number, min(pos) AS pos FROM ({_TARGETS.sql}) WHERE kind <> 'unknown' AND number <> '' GROUP BY ALL), e AS ({_EXISTING.sql})
SELECT t.kind, t.number, t.pos FROM t LEFT JOIN e USING (kind, number) WHERE e.result IS NULL OR e.result IN ('0건', '오류') ORDER BY CASE t.kind WHEN 'registration' THEN 1 WHEN 'application' THEN 2 ELSE 3 END, t.pos LIMIT 300"""
)
def lookup_plan(spark, sf_dir):
    return ingest.lookups(_TARGETS(spark, sf_dir), _EXISTING(spark, sf_dir), 300, retry_failed=True)


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS number, nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_name END), '') AS title, CASE WHEN p_partkey % 4 = 0 THEN [] ELSE [CAST(p_size AS INTEGER), 7] END AS classes,
 CASE WHEN p_partkey % 5 <> 0 THEN DATE '2001-02-03' END AS date FROM part"""
)
def staged_records(spark, sf_dir):
    k = F.col("p_partkey")
    items = read(spark, sf_dir, "part").select(
        k.alias("number"), F.when(k % 3 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.when(k % 4 == 0, "x").otherwise(F.concat(F.lit("ab|"), F.col("p_size").cast("string"), F.lit("| 7|9a"))).alias("classes"),
        F.when(k % 5 == 0, "2001").otherwise("20010203").alias("date"),
    )
    return ingest.staged_record(items)
