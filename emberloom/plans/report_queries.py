"""Queries of reports and model checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberloom.functions import phonetic, strings
from emberloom.operators import corpus, meaning, reports, risk
from emberloom.plans.registry import Bound, query, read

_STATS_SQL = """WITH o AS (SELECT DISTINCT lower(text) AS title, source AS owner FROM documents), e AS (SELECT owner, unnest(list_distinct(regexp_extract_all(title, '([a-z]+|[0-9]+)'))) AS token FROM o),
s AS (SELECT token, count(DISTINCT owner) AS a, count(*) AS n, length(token) = 2 AS legal, log10(count(*)) + 2 AS zipf FROM e WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 2)
"""


def _stats(spark, sf_dir):
    stats = corpus.token_stats(read(spark, sf_dir, "documents").select(F.col("text").alias("title"), F.col("source").alias("owner")))
    return stats.withColumns({"legal": F.char_length("token") == 2, "zipf": F.log10("n") + 2})


@query(
    _STATS_SQL
    + """, g AS (SELECT * FROM (VALUES (5.0), (10.0)) a(theta_a), (VALUES (10.0), (20.0)) b(theta_n), (VALUES (0.3), (0.5), (0.7)) c(theta)),
x AS (SELECT g.*, legal, CASE WHEN legal THEN 0 ELSE round((1 - 0.5 * least(1.0, greatest(0.0, (zipf - 3) / 2.5))) * (1 - least(1.0, a / CAST(theta_a AS DOUBLE)) * least(1.0, n / CAST(theta_n AS DOUBLE))), 4) END AS score FROM s, g)
SELECT CAST(theta_a AS DOUBLE) AS theta_a, CAST(theta_n AS DOUBLE) AS theta_n, CAST(theta AS DOUBLE) AS theta, count(*) FILTER (score < theta) AS weak, count(*) FILTER (score < theta AND legal) AS by_law,
 count(*) FILTER (score < theta AND NOT legal) AS by_count FROM x GROUP BY ALL"""
)
def sensitivity_grid(spark, sf_dir):
    return reports.sensitivity(_stats(spark, sf_dir), [5, 10], [10, 20], [0.3, 0.5, 0.7])


@query("SELECT trim(o) AS owner, count(*) AS n FROM (SELECT unnest(string_split(p_brand || '| ' || p_type || '|', '|')) AS o FROM part) WHERE trim(o) <> '' GROUP BY 1")
def owner_distribution(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("| "), "p_type", F.lit("|")).alias("owners"))
    return reports.owners(p, "owners")


@query(
    """WITH s AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS a, list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 0)) AS e0 FROM orders GROUP BY 1), t AS (SELECT a, coalesce(e0, []) AS e FROM s),
u AS (SELECT len(list_intersect(a, e)) AS b, len(a) AS na, len(e) AS ne FROM t)
SELECT count(*) AS n, round(avg(CASE WHEN ne > 0 THEN b / CAST(na + ne - b AS DOUBLE) ELSE 0 END), 6) AS mean_jaccard, round(avg(CASE WHEN b > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(sum(b) / CAST(sum(ne) AS DOUBLE), 6) AS precision,
 round(sum(b) / CAST(sum(na) AS DOUBLE), 6) AS recall, round(avg(ne), 6) AS mean_estimated, round(avg(na), 6) AS mean_actual FROM u"""
)
def set_quality(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderpriority").alias("actual"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("estimated")
    )
    q = reports.set_quality(o)
    return q.select("n", *[F.round(c, 6).alias(c) for c in ("mean_jaccard", "hit_rate", "precision", "recall", "mean_estimated", "mean_actual")])


_PAIRS = Bound(
    "orders",
    id="o_orderkey",
    case_id="o_custkey",
    y="CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END",
    easy="o_orderkey % 2 = 0",
    x1="CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END",
    x3="CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 53 AS DOUBLE) / 52 END",
    x4="CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 67 AS DOUBLE) / 66 END",
    x9="CAST(NULL AS DOUBLE)",
    gate_a="o_orderkey % 7 <> 0",
    gate_b="o_orderkey % 11 <> 0",
)


@query(
    f"""WITH p AS ({_PAIRS.sql}), l AS (SELECT 'x1' AS axis, y, easy, x1 AS v FROM p UNION ALL SELECT 'x3', y, easy, x3 FROM p UNION ALL SELECT 'x4', y, easy, x4 FROM p UNION ALL SELECT 'x9', y, easy, x9 FROM p),
a AS (SELECT axis, avg(v) FILTER (y = 0 AND easy) AS e, avg(v) FILTER (y = 0 AND NOT easy) AS o FROM l GROUP BY axis)
SELECT axis, round(coalesce(e, o, 0), 4) AS floor, CASE WHEN e IS NOT NULL THEN 'easy' WHEN o IS NOT NULL THEN 'other' ELSE 'none' END AS basis FROM a"""
)
def floor_means(spark, sf_dir):
    return reports.floor_means(_PAIRS(spark, sf_dir), ["x1", "x3", "x4", "x9"])


@query(
    f"""WITH p AS ({_PAIRS.sql}), s AS (SELECT y, 'base' AS pattern FROM p UNION ALL SELECT y, 'x1' FROM p WHERE x1 IS NOT NULL UNION ALL SELECT y, 'x4' FROM p WHERE x4 IS NOT NULL UNION ALL SELECT y, 'x1+x4' FROM p WHERE x1 IS NOT NULL AND x4 IS NOT NULL)
SELECT pattern, count(*) AS n, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, least(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) >= 400 AS feasible FROM s GROUP BY pattern"""
)
def pattern_support(spark, sf_dir):
    return reports.pattern_support(_PAIRS(spark, sf_dir), ["x1", "x4"], 400)


_PACK = Bound(
    "orders",
    split="CASE WHEN o_orderkey % 5 = 0 THEN 'holdout' ELSE 'dev' END",
    label="CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'cannot_assess' WHEN 2 THEN 'low' WHEN 3 THEN 'high' ELSE 'medium' END",
    confidence="CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE 3 END",
    annotator="CASE WHEN o_orderkey % 8 = 1 THEN ' ' ELSE 'a' END",
)


@query(
    f"""WITH p AS ({_PACK.sql}), c AS (SELECT split, count(*) AS pairs, count(label) AS labelled, count(*) FILTER (label = 'cannot_assess') AS unsure, count(*) FILTER (confidence IS NULL) AS nc, count(*) FILTER (trim(annotator) = '') AS na,
  least(count(*) FILTER (label = 'low'), count(*) FILTER (label = 'high')) AS least FROM p GROUP BY split)
SELECT split, pairs, labelled, list_filter([CASE WHEN labelled <> 160 THEN 'labels_incomplete' END, CASE WHEN nc > 0 THEN 'confidence_incomplete' END, CASE WHEN na > 0 THEN 'annotator_incomplete' END,
 CASE WHEN unsure / CAST(labelled AS DOUBLE) > 0.1 THEN 'unsure_rate_exceeds_policy' END, CASE WHEN least < 100 THEN 'class_minimum_not_met' END], lambda x: x IS NOT NULL) AS reasons, false AS ready FROM c"""
)
def labelling_readiness(spark, sf_dir):
    return reports.readiness(_PACK(spark, sf_dir), {"dev": 160, "holdout": 160}, {"dev": 100, "holdout": 100}, ["low", "high"])


@query(
    f"""WITH p AS (SELECT y, least(1.0::DOUBLE, x1 * 1.25) AS b, CASE WHEN id % 6 = 1 THEN least(1.0::DOUBLE, x1 * 1.25) / 2 ELSE least(1.0::DOUBLE, x1 * 1.25) END AS a FROM ({_PAIRS.sql}) WHERE x1 IS NOT NULL)
SELECT y, count(*) AS n, count(*) FILTER (b >= 0.9999) AS at_one, count(*) FILTER (b >= 0.9999 AND a >= 0.9999) AS still_at_one, count(*) FILTER (a < b - 1e-9) AS fell, round(avg(b - a) FILTER (a < b - 1e-9), 6) AS mean_fall FROM p GROUP BY y"""
)
def distinctiveness_effect(spark, sf_dir):
    b = F.least(F.lit(1.0), F.col("x1") * 1.25)
    rows = _PAIRS(spark, sf_dir).where("x1 is not null").select("y", b.alias("before"), F.when(F.col("id") % 6 == 1, b / 2).otherwise(b).alias("after"))
    return reports.effect(rows, "before", "after").withColumn("mean_fall", F.round("mean_fall", 6))


@query(
    f"""WITH p AS (SELECT CASE WHEN gate_a AND gate_b THEN 'open' ELSE 'shut' END AS gate, x1 AS score, y FROM ({_PAIRS.sql}) WHERE x1 IS NOT NULL),
b AS (SELECT gate, score, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY ALL), f AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY gate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
a AS (SELECT gate, round(sum(pos * (below + 0.5 * neg)) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) AS auc, CAST(sum(pos + neg) AS BIGINT) AS n FROM f GROUP BY gate)
SELECT a.gate, n, auc, median(score) FILTER (y = 1) AS median_similar, median(score) FILTER (y = 0) AS median_dissimilar FROM a JOIN p USING (gate) GROUP BY ALL"""
)
def gate_effect(spark, sf_dir):
    g = reports.gate_effect(_PAIRS(spark, sf_dir), "x1", ["gate_a", "gate_b"])
    return g.select("gate", "n", F.round("auc", 6).alias("auc"), "median_similar", "median_dissimilar")


@query(
    """WITH t AS (SELECT p_name AS a, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '') ELSE p_name || ' x' END AS b, CASE WHEN p_partkey % 4 = 0 THEN 0.5 ELSE 1.0 END AS score FROM part),
w AS (SELECT score, list_sort(regexp_extract_all(lower(a), '([a-z]+|[0-9]+)')) AS sa, list_sort(regexp_extract_all(lower(b), '([a-z]+|[0-9]+)')) AS sb, array_to_string(regexp_extract_all(lower(a), '([a-z]+|[0-9]+)'), '') AS ja,
 array_to_string(regexp_extract_all(lower(b), '([a-z]+|[0-9]+)'), '') AS jb FROM t WHERE score >= 1)
SELECT CASE WHEN sa = sb THEN 'same_tokens' WHEN ja = jb THEN 'blanks_only' ELSE 'shared_part' END AS kind, count(*) AS n FROM w GROUP BY 1"""
)
def problem_cases(spark, sf_dir):
    k = F.col("p_partkey") % 3
    b = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.concat("p_name", F.lit(" x")))
    p = read(spark, sf_dir, "part").select(
        strings.tokens(F.col("p_name")).alias("tokens_a"), strings.tokens(b).alias("tokens_b"), F.when(F.col("p_partkey") % 4 == 0, 0.5).otherwise(1.0).alias("score")
    )
    return reports.problem_cases(p)


@query("SELECT count(*) AS n, round(avg(coalesce(x1, 0)), 3) AS mean, count(*) FILTER (x1 >= 0.999) AS exact, count(*) FILTER (x1 >= 0.8) AS near, count(*) FILTER (coalesce(x1, 0) <= 0) AS unread FROM (" + _PAIRS.sql + ")")
def reading_quality(spark, sf_dir):
    return reports.reading_quality(_PAIRS(spark, sf_dir), "x1")


_POOLS = Bound(
    "lineitem",
    sample="CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END",
    mode="CASE WHEN l_linenumber % 2 = 0 THEN 'image' ELSE 'both' END",
    query_id="l_suppkey",
    id="l_partkey",
    title="CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'x' END",
    reason="CASE l_partkey % 7 WHEN 0 THEN 'self' WHEN 1 THEN 'same_owner' ELSE NULL END",
    similarity="CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 89 AS DOUBLE) / 88 END",
)


@query(
    f"""WITH p AS ({_POOLS.sql}), t AS (SELECT sample, mode, query_id, coalesce(max(similarity) FILTER (reason IS NULL), 0) AS top FROM p GROUP BY ALL),
s AS (SELECT sample, mode, count(*) AS searches, median(top) AS median_top FROM t GROUP BY ALL)
SELECT sample, mode, searches, round(median_top, 6) AS median_top, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NULL AND trim(title) = '') AS kept_nameless, count(*) FILTER (reason = 'self') AS self,
 count(*) FILTER (reason = 'same_owner') AS same_owner, round(quantile_cont(similarity, 0.5) FILTER (reason IS NULL), 6) AS median, round(quantile_cont(similarity, 0.9) FILTER (reason IS NULL), 6) AS p90 FROM p JOIN s USING (sample, mode) GROUP BY ALL"""
)
def pool_summary(spark, sf_dir):
    s = reports.pool_summary(_POOLS(spark, sf_dir))
    return s.select("sample", "mode", "searches", F.round("median_top", 6).alias("median_top"), "kept", "kept_nameless", "self", "same_owner", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


_TIMES = Bound("events", query_id="event_id", mode="CASE WHEN event_id % 2 = 0 THEN 'image' ELSE 'name' END", a="CAST((event_id * 37) % 1009 AS DOUBLE)", b="CAST((event_id * 53) % 997 AS DOUBLE)", c="CAST((event_id * 71) % 991 AS DOUBLE)")


def _times(spark, sf_dir):
    t = _TIMES(spark, sf_dir)
    return t.select("query_id", "mode", (F.col("a") + F.col("b") + F.col("c")).alias("ms"), F.create_map(F.lit("pool"), "a", F.lit("score"), "b", F.lit("rank"), "c").alias("stages"))


@query(f"WITH t AS ({_TIMES.sql}) SELECT query_id, a + b + c AS ms, CASE WHEN a > b AND a > c THEN 'pool' WHEN b >= a AND b >= c THEN 'score' WHEN c > b AND c >= a THEN 'rank' ELSE 'pool' END AS longest_stage FROM t ORDER BY ms DESC, query_id LIMIT 10")
def slowest_requests(spark, sf_dir):
    return reports.slowest(_times(spark, sf_dir), 10)


@query(f"WITH t AS ({_TIMES.sql}) SELECT mode, 'pool' AS stage, round(median(a), 1) AS median_ms FROM t GROUP BY mode UNION ALL SELECT mode, 'score', round(median(b), 1) FROM t GROUP BY mode UNION ALL SELECT mode, 'rank', round(median(c), 1) FROM t GROUP BY mode")
def stage_medians(spark, sf_dir):
    return reports.stage_medians(_times(spark, sf_dir))


_SMALL = "SELECT doc_id, source, quality AS y, round(least(1.0, n_chars / 8000.0), 3) AS score FROM documents JOIN labels USING (doc_id)"


def _labelled(spark, sf_dir):
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.select("doc_id", "source", "n_chars").join(l, "doc_id").select("doc_id", "source", F.col("quality").alias("y"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 8000.0), 3).alias("score"))


@query(
    f"""WITH s AS ({_SMALL}), d AS (SELECT r.range AS replicate, s.score, row_number() OVER (PARTITION BY r.range ORDER BY md5('0:' || r.range || ':' || s.doc_id), s.doc_id) <= (SELECT count(*) FROM s WHERE y = 1) AS hit FROM s, range(50) r),
b AS (SELECT replicate, score, sum(hit::INT) AS pos, sum((NOT hit)::INT) AS neg FROM d GROUP BY ALL), f AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
a AS (SELECT replicate, sum(pos * (below + 0.5 * neg)) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auc FROM f GROUP BY replicate)
SELECT count(*) AS rounds, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.05), 6) AS p5, round(quantile_cont(auc, 0.95), 6) AS p95 FROM a"""
)
def shuffled_auc(spark, sf_dir):
    found = reports.shuffled_auc(_labelled(spark, sf_dir), "doc_id", 50)
    return found.select("rounds", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p95")])


@query()
def metric_block(spark, sf_dir):
    found = reports.metric_block(_labelled(spark, sf_dir), "source", 200)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("auc", "brier", "low", "high")])


@query(
    f"""WITH p AS ({_PAIRS.sql}) SELECT id, round(coalesce(greatest(x1, x3, x4), 0), 6) AS largest, round(CASE WHEN x1 IS NULL AND x3 IS NULL AND x4 IS NULL THEN 0 ELSE (coalesce(x1, 0) + coalesce(x3, 0) + coalesce(x4, 0))
 / ((x1 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT + (x4 IS NOT NULL)::INT) END, 6) AS mean FROM p"""
)
def baseline_scores(spark, sf_dir):
    found = reports.baseline_scores(["x1", "x3", "x4"])
    return _PAIRS(spark, sf_dir).select("id", *[F.round(c, 6).alias(n) for n, c in found.items()])


@query(
    f"""WITH p AS ({_PAIRS.sql}), c AS (SELECT * FROM (VALUES ('caution', 0.3), ('review', 0.5), ('risk', 0.8)) t(cut, least))
SELECT cut, CAST(least AS DOUBLE) AS "at", count(*) AS n, count(*) FILTER (y = 1) AS similar, round(count(*) FILTER (y = 1) / CAST(count(*) AS DOUBLE), 6) AS precision FROM p JOIN c ON x4 >= c.least GROUP BY ALL"""
)
def cut_table(spark, sf_dir):
    rows = _PAIRS(spark, sf_dir).where("x4 is not null").select(F.col("x4").alias("p"), "y")
    return reports.cut_table(rows, {"caution": 0.3, "review": 0.5, "risk": 0.8}).withColumn("precision", F.round("precision", 6))


def _model_rows(spark, sf_dir):
    from emberloom.plans.catalogue import _axes

    return _axes(spark, sf_dir)


def _w(pattern: str, term: str) -> float:
    return risk.BLOCKS[pattern][1][risk.TERMS.index(term)]


def _delta_sql(axis: str) -> str:
    """Difference of the logits with and without an axis, by the coefficients of the two blocks."""
    other = "x4" if axis == "x2w" else "x2w"

    def logit(image: bool, goods: bool) -> str:
        key = "+".join([n for n, on in (("x2_whole", image), ("x4", goods)) if on]) or "base"
        c, (w1, w2, w3, wn, wt, wx, wi, wf, wg) = risk.BLOCKS[key]
        sum_ = f"{c} + {w1} * a + {w2} * b + {w3} * coalesce(x3, 0) + {wn} * nd + {wt} * (CASE WHEN fig THEN 0 ELSE a END) + {wx} * a * nd"
        return sum_ + (f" + {wi} * x2w + {wf} * (CASE WHEN fig THEN x2w ELSE 0 END)" if image else "") + (f" + {wg} * x4" if goods else "")

    if axis == "x2w":
        return f"CASE WHEN {other} IS NULL THEN ({logit(True, False)}) - ({logit(False, False)}) ELSE ({logit(True, True)}) - ({logit(False, True)}) END"
    return f"CASE WHEN {other} IS NULL THEN ({logit(False, True)}) - ({logit(False, False)}) ELSE ({logit(True, True)}) - ({logit(True, False)}) END"


_MODEL_SQL = """WITH g AS (SELECT CAST((k * 37) % 101 AS DOUBLE) / 100 AS a, CAST((k * 53) % 97 AS DOUBLE) / 96 AS b, CASE WHEN k % 3 = 0 THEN CAST((k * 71) % 89 AS DOUBLE) / 88 END AS x3, CASE WHEN k % 4 <> 0 THEN CAST((k * 29) % 83 AS DOUBLE) / 82 END AS x2w,
 CASE WHEN k % 5 <> 0 THEN CAST((k * 13) % 79 AS DOUBLE) / 78 END AS x4, CASE WHEN k % 7 <> 0 THEN 0.0 ELSE 1.0 END AS nd, k % 6 IN (0, 1) AS fig FROM (SELECT o_orderkey AS k FROM orders))
"""


@query(
    _MODEL_SQL
    + f""", d AS (SELECT 'x2_whole' AS axis, {risk.IMAGE_FLOOR} AS floor, x2w AS v, {_delta_sql('x2w')} AS delta FROM g WHERE x2w IS NOT NULL UNION ALL SELECT 'x4', {risk.GOODS_FLOOR}, x4, {_delta_sql('x4')} FROM g WHERE x4 IS NOT NULL)
SELECT axis, CAST(floor AS DOUBLE) AS floor, count(*) AS n, count(*) FILTER (v >= floor AND delta < -1e-9) AS violations, count(*) FILTER (v < floor AND delta < 0) AS lower_below_floor, round(avg(delta) FILTER (v >= floor), 6) AS mean_change FROM d GROUP BY ALL"""
)
def monotonicity(spark, sf_dir):
    return reports.monotonicity(_model_rows(spark, sf_dir), {"x2_whole": risk.IMAGE_FLOOR, "x4": risk.GOODS_FLOOR})


@query()
def slope_conditions(spark, sf_dir):
    found = reports.slopes(_model_rows(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])


@query()
def grade_distribution(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    alone = rows.withColumn("x4", F.lit(None).cast("double"))
    return reports.grade_distribution({"all": risk.score(rows), "without_goods": risk.score(alone)})


@query()
def nameless_floor(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).withColumn("nameless_floor", F.col("id") % 6 == 0)
    return meaning.nameless_floor(rows, "id").select("id", "pattern", F.round("p", 6).alias("p"), "grade", "nameless_floor", "goods_floor")


@query(
    """WITH t AS (SELECT DISTINCT text, regexp_extract_all(lower(text), '([a-z]+|[0-9]+)') AS w FROM benchmark), e AS (SELECT DISTINCT text, unnest(w) AS token FROM t),
z AS (SELECT token, CASE WHEN length(token) >= 8 THEN 2.0 ELSE 3.5 END AS zipf FROM (SELECT DISTINCT token FROM e))
SELECT text, coalesce(max((token SIMILAR TO '[a-z]+' AND length(token) >= 3 AND zipf >= 3)::INT) = 1, false) AS has_meaning FROM t LEFT JOIN e USING (text) LEFT JOIN z USING (token) GROUP BY text"""
)
def meaning_gate(spark, sf_dir):
    """Names that have a word: the benchmark's texts, words by length."""
    names = read(spark, sf_dir, "benchmark").select("text").distinct()
    token = names.select(F.explode(strings.tokens(F.col("text"))).alias("token")).distinct()
    words = token.withColumn("zipf", F.when(F.char_length("token") >= 8, 2.0).otherwise(3.5))
    return meaning.has_meaning(names, "text", words)


@query()
def mined_readings(spark, sf_dir):
    """Latin words beside syllables: parts' names with the reading of one of their words."""
    p = read(spark, sf_dir, "part").select(strings.tokens(F.col("p_name")).alias("t")).where(F.size("t") > 1)
    read_as = F.udf(lambda x: phonetic.readings(x)[0], "string")
    tokens = F.concat("t", F.array(read_as(F.col("t")[0])))
    rows = p.distinct().select(tokens.alias("tokens"))
    return reports.mined_readings(rows, read_as(F.col("latin")), phonetic.syllable_similarity_udf, 0.5, 1.01)


@query(
    """WITH p AS (SELECT p_partkey AS id, p_brand AS term, CAST((p_partkey * 31 + length(p_brand)) % 7 AS DOUBLE) / 7 AS score FROM part UNION ALL SELECT p_partkey, p_type, CAST(p_partkey % 5 AS DOUBLE) / 5 FROM part)
SELECT id, arg_min(term, (-score, term)) AS term, max(score) AS score FROM p GROUP BY id"""
)
def best_terms(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("term"), (((F.col("p_partkey") * 31 + F.length("p_brand")) % 7).cast("double") / 7).alias("score"))
    b = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("term"), ((F.col("p_partkey") % 5).cast("double") / 5).alias("score"))
    return meaning.best_term(a.unionByName(b), "id", "term", "score")


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id - a.vec_id % 10),
u AS (SELECT vec_id, unnest(x) / sqrt(list_inner_product(x, x)) AS x, unnest(y) / sqrt(list_inner_product(y, y)) AS y, unnest(range(len(x))) AS i FROM n), m AS (SELECT vec_id, i, (x + y) / 2 AS z FROM u)
SELECT vec_id, round(sqrt(sum(z * z)), 6) AS length_before, round(max(z) / sqrt(sum(z * z)), 6) AS largest FROM m GROUP BY vec_id"""
)
def mean_views(spark, sf_dir):
    """Each vector averaged with the first of its ten."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("b"))
    both = e.join(first, F.col("vec_id") - F.col("vec_id") % 10 == F.col("k"))
    from emberloom.functions import vectors

    mean = F.zip_with(vectors.unit("embedding"), vectors.unit("b"), lambda x, y: (x + y) / 2)
    return both.select("vec_id", F.round(vectors.norm(mean), 6).alias("length_before"), F.round(F.array_max(meaning.mean_view(F.array("embedding", "b"))), 6).alias("largest"))


@query(
    """WITH c AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS fig, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS sug, o_orderkey % 5 = 0 AS fb, o_orderkey % 7 = 0 AS ph, o_orderkey % 4 <> 0 AS img, CASE WHEN o_orderkey % 6 <> 0 THEN 'n' END AS name,
 o_orderkey % 8 <> 0 AS sp, o_orderkey % 9 <> 0 AS me, o_orderkey % 10 <> 0 AS gd, o_orderkey % 11 <> 0 AS cov, o_orderkey % 13 <> 0 AS fo FROM orders)
SELECT id, list_filter([CASE WHEN fig THEN 'figure_low_data' END, CASE WHEN sug IS NOT NULL THEN 'name_suggested' END, CASE WHEN fb THEN 'ocr_fallback' END, CASE WHEN ph THEN 'photo_query' END, CASE WHEN NOT img THEN 'no_image' END,
 CASE WHEN name IS NULL THEN 'no_name' END, CASE WHEN name IS NOT NULL AND NOT sp THEN 'no_pronunciation' END, CASE WHEN name IS NOT NULL AND NOT me THEN 'no_meaning' END, CASE WHEN NOT gd THEN 'no_goods' END,
 CASE WHEN gd AND NOT cov THEN 'goods_coverage' END, CASE WHEN gd AND NOT img AND name IS NULL THEN 'goods_only' END, CASE WHEN NOT fo THEN 'no_candidates' END], lambda x: x IS NOT NULL) AS caveats FROM c"""
)
def search_caveats(spark, sf_dir):
    k = F.col("o_orderkey")
    x = lambda m: k % m == 0
    found = meaning.caveats(x(2), F.when(x(3), F.lit("x")), x(5), x(7), ~x(4), F.when(~x(6), F.lit("n")), ~x(8), ~x(9), ~x(10), ~x(11), ~x(13))
    return read(spark, sf_dir, "orders").select(k.alias("id"), found.alias("caveats"))
