"""Queries of case grading, labels, marks and orders of review, on orders and parts as cases and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberloom.operators import cases, marks
from emberloom.plans.registry import Bound, query, read

_CASES = Bound(
    "orders",
    id="o_orderkey",
    kind="CASE WHEN o_orderkey % 3 = 0 THEN 'scope' WHEN o_orderkey % 3 = 1 THEN 'refusal' ELSE 'invalidation' END",
    result="CASE o_orderkey % 7 WHEN 0 THEN '각하' WHEN 1 THEN '기각' WHEN 2 THEN '취소' WHEN 3 THEN '속함' WHEN 4 THEN '불속' WHEN 5 THEN '무효' ELSE '일부무효' END",
    conclusions="CASE o_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN '33:긍정' WHEN 2 THEN '34-7:긍정' WHEN 3 THEN '34-7:부정|34-12:긍정' WHEN 4 THEN '35-1:긍정' WHEN 5 THEN '34-7:부정' WHEN 6 THEN '36:부정' ELSE '35-1:부정|x' END",
    mark_verdict="CASE o_orderkey % 5 WHEN 0 THEN '유사' WHEN 1 THEN '비유사' ELSE NULL END",
    goods_verdict="CASE o_orderkey % 4 WHEN 0 THEN '비유사' ELSE '유사' END",
    scope_basis="CASE WHEN o_orderkey % 11 = 0 THEN '효력제한|자유실시' ELSE '' END",
    fame_in_body="o_orderkey % 13 = 0",
    bad_faith="o_orderkey % 17 = 0",
    prior_lapsed="o_orderkey % 19 = 0",
    inferred="o_orderkey % 6 = 1",
    description="CASE WHEN o_orderkey % 2 = 0 THEN '적극적 권리범위확인' ELSE '소극적 권리범위확인' END",
)
_PARSED = (
    f"WITH c AS ({_CASES.sql}), p AS (SELECT *, list_filter(string_split(conclusions, '|'), lambda x: contains(x, ':')) AS parts FROM c), "
    "a AS (SELECT *, list_transform(parts, lambda x: split_part(x, ':', 1)) AS arts, coalesce(mark_verdict, '') AS v, "
    "array_to_string(list_filter(['34-9', '34-11', '34-12', '34-13'], lambda f: list_contains(list_transform(parts, lambda x: split_part(x, ':', 1)), f)), ',') AS fame, "
    "concat_ws('·', CASE WHEN bad_faith THEN '부정한 목적' END, CASE WHEN fame_in_body THEN '저명·주지(문구 제외 후)' END) AS body FROM p)\n"
)


@query(
    _PARSED
    + """SELECT id, g[1:1] AS grade, g[3:] AS reason FROM (SELECT id, CASE WHEN result = '각하' THEN '3|각하(본안 판단 없음)'
 WHEN kind = 'scope' THEN CASE WHEN scope_basis <> '' THEN '3|권리범위: ' || replace(scope_basis, '|', '·') WHEN v = '' THEN '2|권리범위: 표장 유사 소결 없음' WHEN fame <> '' THEN '2|권리범위: 표장 소결 있으나 인지도 조문 ' || fame
   WHEN fame_in_body THEN '2|권리범위: 표장 ' || v || ' 소결이나 저명·주지 언급' ELSE '1|권리범위: 표장 ' || v || ' 소결, 인지도 언급 없음' END
 WHEN prior_lapsed THEN '3|유사 판단 없음(선등록상표 소멸·무효로 취소)' WHEN fame <> '' THEN '3|결론에 인지도 조문 ' || fame WHEN len(arts) = 0 THEN '2|결론 조문 추출 실패' WHEN arts = ['33'] THEN '3|식별력 사례(33조만)'
 WHEN list_contains(arts, '34-7') THEN CASE WHEN body = '' THEN '1|결론 7호, 인지도 언급 없음' || CASE WHEN inferred THEN ' (표장 소결 추론, 신뢰도 low)' ELSE '' END ELSE '2|결론 7호이나 본문에 ' || body END
 WHEN list_contains(arts, '35-1') THEN CASE WHEN body <> '' THEN '2|결론 35-1(선출원 저촉)이나 본문에 ' || body WHEN v = '' THEN '2|결론 35-1(선출원 저촉)이나 표장 소결 없음' ELSE '1|결론 35-1(선출원 저촉), 표장 ' || v || ' 소결, 인지도 언급 없음' END
 ELSE '2|결론 조문이 7호 아님(' || array_to_string(arts, ',') || ')' END AS g FROM a)"""
)
def case_grades(spark, sf_dir):
    return cases.graded(_CASES(spark, sf_dir)).select("id", "grade", "reason")


def _article_sql(article: str, label: str) -> str:
    says = f"(CASE WHEN list_contains(parts, '{article}:긍정') THEN '긍정' WHEN list_contains(parts, '{article}:부정') THEN '부정' END)"
    guess = f"(CASE WHEN {says} = '긍정' THEN '유사' ELSE '비유사' END)"
    goods = f"({guess} = '비유사' AND goods_verdict = '비유사')"
    return (
        f"CASE WHEN {says} IS NOT NULL THEN CASE WHEN inferred THEN {guess} || '|{label} ' || {says} || ' — 표장 소결 추론' WHEN {goods} AND v = '' THEN '|{label} 부정은 상품 비유사 때문 — 표장 판단 없음'"
        f" WHEN v <> '' AND v <> {guess} AND {goods} THEN '유사|소결 표장 유사(상품 비유사로 {label} 부정)' WHEN v <> '' AND v <> {guess} THEN {guess} || '|{label} ' || {says} || ' · 소결 표장 ' || v || '와 불일치'"
        f" ELSE {guess} || '|{label} ' || {says} END END"
    )


@query(
    _PARSED
    + f"""SELECT id, split_part(e, '|', 1) AS guess, split_part(e, '|', 2) AS basis FROM (SELECT id, CASE WHEN kind = 'scope' THEN CASE WHEN result = '속함' THEN '유사|주문 속함(scope)' WHEN result = '불속' THEN '비유사|주문 불속(scope)'
  WHEN result = '기각' AND contains(description, '소극') THEN '유사|주문 기각(소극적 권리범위확인 → 속함)' WHEN result = '기각' THEN '비유사|주문 기각(적극적 권리범위확인 → 불속)' ELSE '|' END
 ELSE coalesce({_article_sql('34-7', '결론 7호')}, {_article_sql('35-1', '결론 35-1(선출원 저촉)')}, CASE WHEN v <> '' THEN v || '|소결 표장 ' || v || '(조문 없음)' ELSE '|' END) END AS e FROM a)"""
)
def outcome_estimates(spark, sf_dir):
    return cases.estimated(_CASES(spark, sf_dir)).select("id", "guess", "basis")


_KINDS = {"refusal": ["BUILDING"], "invalidation": ["MACHINERY", "FURNITURE"], "scope": []}


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'refusal' WHEN 'MACHINERY' THEN 'invalidation' WHEN 'FURNITURE' THEN 'invalidation' ELSE '' END AS kind FROM customer")
def case_kinds(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", cases.case_kind(F.col("c_mktsegment"), _KINDS).alias("kind"))


_NUMBERS = Bound(
    "orders",
    id="o_orderkey",
    number="CASE o_orderkey % 6 WHEN 0 THEN '40-' || lpad(CAST(o_orderkey AS STRING), 7, '0') || '-0000' WHEN 1 THEN '40' || '2019' || lpad(CAST(o_orderkey AS STRING), 7, '0') WHEN 2 THEN CAST(o_orderkey AS STRING) WHEN 3 THEN '제 0' || CAST(o_custkey AS STRING) || '호' WHEN 4 THEN '123456789' ELSE '' END",
    wording="CASE o_orderkey % 5 WHEN 0 THEN '국제' WHEN 1 THEN '서비스표' WHEN 2 THEN '상표서비스표' ELSE '상표' END",
)


@query(
    f"""WITH n AS ({_NUMBERS.sql}), d AS (SELECT id, wording, regexp_replace(number, '[^0-9]', '', 'g') AS g FROM n),
e AS (SELECT *, length(g) = 13 AND g[1:2] IN ('40', '41', '42', '43', '44', '45') AS long FROM d)
SELECT id, CASE WHEN g = '' THEN '' WHEN wording = '국제' THEN 'international' WHEN long AND g LIKE '%0000' THEN 'registration' WHEN long THEN 'application' WHEN length(g) <= 7 THEN 'registration' ELSE 'unknown' END AS kind,
 CASE WHEN g = '' OR wording = '국제' OR long OR length(g) > 7 THEN g ELSE CASE wording WHEN '서비스표' THEN '41' WHEN '상표서비스표' THEN '45' ELSE '40' END || lpad(CAST(CAST(g AS BIGINT) AS VARCHAR), 7, '0') || '0000' END AS number FROM e"""
)
def case_numbers(spark, sf_dir):
    n = _NUMBERS(spark, sf_dir).withColumn("n", cases.normalized_number(F.col("number"), F.col("wording")))
    return n.select("id", F.col("n.kind").alias("kind"), F.col("n.number").alias("number"))


_MEMOS = Bound(
    "orders",
    id="o_orderkey",
    label="CASE o_orderkey % 3 WHEN 0 THEN '유사' WHEN 1 THEN '비유사' ELSE '제외' END",
    memo="CASE o_orderkey % 4 WHEN 0 THEN '표장 유사하나 상품 비유사' WHEN 1 THEN '표장 유사 여부 판단 없음' ELSE NULL END",
    axes="CASE o_orderkey % 5 WHEN 0 THEN '외관·호칭' WHEN 1 THEN '상품' ELSE '' END",
)


@query(f"WITH m AS ({_MEMOS.sql}) SELECT id, CASE WHEN label = '유사' OR id % 4 = 0 THEN '유사' WHEN label = '비유사' AND id % 5 = 0 THEN '비유사' ELSE '' END AS mark_label FROM m WHERE label IN ('유사', '비유사')")
def mark_labels(spark, sf_dir):
    rows = cases.target_rows(_MEMOS(spark, sf_dir))
    return rows.select("id", cases.mark_label(F.col("label"), F.col("memo"), F.col("axes")).alias("mark_label"))


_TRIALS = Bound(
    "orders",
    number="o_orderkey",
    kind="CASE WHEN o_orderkey % 3 = 0 THEN 'scope' WHEN o_orderkey % 3 = 1 THEN 'refusal' ELSE 'invalidation' END",
    month="substr(CAST(o_orderdate AS STRING), 1, 7)",
    claimant="CASE WHEN o_custkey % 2 = 0 THEN 'Claimant  ' || CAST(o_custkey % 40 AS STRING) ELSE 'claimant ' || CAST(o_custkey % 40 AS STRING) END",
)


@query(f"WITH t AS ({_TRIALS.sql}) SELECT month, min(number) AS number FROM t GROUP BY month, lower(regexp_replace(claimant, '\\s+', ' ', 'g'))")
def claimant_months(spark, sf_dir):
    return cases.first_per_month(_TRIALS(spark, sf_dir), "month", "claimant", "number").select("month", "number")


@query(
    f"""WITH t AS ({_TRIALS.sql}), s AS (SELECT kind, number, month, row_number() OVER (ORDER BY month DESC, number DESC) AS place FROM t WHERE kind = 'scope'),
i AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY number) AS turn FROM t WHERE kind = 'invalidation'),
f AS (SELECT kind, month, min(number) AS number FROM t WHERE kind = 'refusal' GROUP BY kind, month, lower(regexp_replace(claimant, '\\s+', ' ', 'g'))),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY number) AS turn FROM f),
u AS (SELECT kind, number, month, place FROM s UNION ALL SELECT kind, number, month, row_number() OVER (ORDER BY turn, month) FROM i UNION ALL SELECT kind, number, month, row_number() OVER (ORDER BY turn, month) FROM r)
SELECT kind, number, month, CAST(place AS INTEGER) AS place FROM u WHERE place <= CASE kind WHEN 'scope' THEN 30 WHEN 'invalidation' THEN 40 ELSE 50 END"""
)
def collection_sample(spark, sf_dir):
    found = cases.collection_sample(_TRIALS(spark, sf_dir), {"scope": 30, "invalidation": 40, "refusal": 50})
    return found.select("kind", "number", "month", "place")


_QUEUE = Bound(
    "orders",
    number="o_custkey",
    pos="o_orderkey",
    round="o_custkey % 3",
    grade="CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '3' END",
    reason="CASE WHEN o_orderkey % 8 = 1 THEN '권리범위: 표장 유사 소결이나 저명·주지 언급' ELSE '그 외' END",
    family_copy="o_orderkey % 9 = 0",
    kind="CASE o_custkey % 4 WHEN 0 THEN 'scope' WHEN 1 THEN 'refusal' WHEN 2 THEN 'invalidation' ELSE '' END",
    confidence="CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE NULL END",
    counterpart="CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 50 AS STRING) ELSE '' END",
)


@query(
    f"""WITH q AS ({_QUEUE.sql}), f AS (SELECT number, arg_min(round, pos) AS round, arg_min(grade, pos) AS grade, arg_min(reason, pos) AS reason, arg_min(family_copy, pos) AS family_copy, arg_min(kind, pos) AS kind,
  arg_min(struct_pack(c := confidence), pos).c AS confidence FROM q GROUP BY number),
c AS (SELECT number, string_agg(counterpart, ';' ORDER BY first) AS counterparts FROM (SELECT number, counterpart, min(pos) AS first FROM q WHERE counterpart <> '' GROUP BY ALL) GROUP BY number),
b AS (SELECT f.*, CASE WHEN grade = '1' THEN 0 WHEN grade = '2' AND reason LIKE '권리범위%저명·주지 언급%' THEN 1 END AS bucket FROM f WHERE NOT family_copy),
k AS (SELECT *, CASE kind WHEN 'scope' THEN 0 WHEN 'refusal' THEN 1 WHEN 'invalidation' THEN 2 ELSE 3 END AS ko, CASE confidence WHEN 'high' THEN 0 WHEN 'low' THEN 1 ELSE 2 END AS co FROM b WHERE bucket IS NOT NULL)
SELECT k.number, round, bucket, kind, confidence, coalesce(counterparts, '') AS counterparts, CAST(row_number() OVER (PARTITION BY round ORDER BY bucket, ko, co, k.number) AS INTEGER) AS place FROM k LEFT JOIN c USING (number)"""
)
def curation_queue(spark, sf_dir):
    return cases.curation_queue(_QUEUE(spark, sf_dir))


_LABELS = Bound(
    "orders",
    verdict="CASE o_orderkey % 5 WHEN 0 THEN '유사' WHEN 1 THEN '비유사' WHEN 2 THEN '제외' ELSE NULL END",
    source="CASE o_custkey % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'human' ELSE 'human-confirmed' END",
    model="CASE WHEN o_custkey % 3 = 1 AND o_orderkey % 2 = 0 THEN '비유사' ELSE '' END",
    second="CASE o_orderkey % 4 WHEN 0 THEN '유사' WHEN 1 THEN '비유사' ELSE '' END",
    estimate="CASE o_orderkey % 3 WHEN 0 THEN '유사' WHEN 1 THEN '비유사' ELSE '' END",
)


@query(
    f"""WITH l AS ({_LABELS.sql}), m AS (SELECT *, coalesce(verdict, '') AS v, CASE WHEN model <> '' THEN model WHEN source = 'llm' THEN coalesce(verdict, '') ELSE '' END AS llm FROM l)
SELECT count(*) AS rows, count(*) FILTER (v <> '') AS labelled, count(*) FILTER (v = '유사') AS similar, count(*) FILTER (v = '비유사') AS dissimilar, count(*) FILTER (v = '제외') AS excluded,
 count(*) FILTER (v <> '' AND source = 'human-confirmed') AS agreed, count(*) FILTER (v <> '' AND source = 'human' AND model <> '') AS changed, count(*) FILTER (v <> '' AND llm <> '' AND estimate <> '') AS with_estimate,
 count(*) FILTER (v <> '' AND llm <> '' AND llm = estimate) AS estimate_agreed, count(*) FILTER (llm <> '' AND second <> '') AS two_passes, count(*) FILTER (llm <> '' AND second = llm) AS passes_agreed FROM m"""
)
def label_summary(spark, sf_dir):
    return cases.label_summary(_LABELS(spark, sf_dir))


_YIELDS = Bound("orders", kind="o_orderpriority", condition_group="CAST(o_custkey % 60 AS STRING)", figure="o_custkey % 60 < 20", grade="CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '2' END")


@query(
    f"""WITH y AS ({_YIELDS.sql}), g AS (SELECT kind, condition_group, figure, count(*) AS received, count(*) FILTER (grade = '1') AS first FROM y GROUP BY ALL),
k AS (SELECT kind, sum(received) AS an, sum(first) AS af, sum(received) FILTER (NOT figure) AS wn, sum(first) FILTER (NOT figure) AS wf FROM g GROUP BY kind)
SELECT g.kind, condition_group, figure, received, first, round(CASE WHEN received >= 20 THEN first / CAST(received AS DOUBLE) WHEN figure OR coalesce(wn, 0) < 20 THEN af / CAST(an AS DOUBLE) ELSE wf / CAST(wn AS DOUBLE) END, 6) AS rate, received < 20 AS replaced FROM g JOIN k USING (kind)"""
)
def yield_table(spark, sf_dir):
    return cases.yield_table(_YIELDS(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


# --- marks -------------------------------------------------------------------

_SHARES = Bound(
    "part",
    id="p_partkey",
    text_share="CAST(p_partkey % 21 AS DOUBLE) / 100",
    figure_share="CAST(p_partkey % 17 AS DOUBLE) / 100",
    name="CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END",
    override="CASE p_partkey % 11 WHEN 0 THEN '문자' WHEN 1 THEN '도형' WHEN 2 THEN '결합' ELSE NULL END",
    has_image="p_partkey % 5 <> 0",
    read="p_partkey % 7 <> 0",
    mark_kind="CASE p_partkey % 9 WHEN 0 THEN '도형상표' WHEN 1 THEN '도형복합' ELSE '' END",
    drawn="p_partkey % 3 = 0",
)


@query(
    f"""WITH s AS ({_SHARES.sql}), t AS (SELECT id, CASE WHEN text_share < 0.05 THEN '도형' WHEN figure_share < 0.08 THEN '문자' ELSE '결합' END AS type,
  CASE WHEN text_share < 0.05 THEN '도형' WHEN figure_share < 0.08 THEN '문자' WHEN figure_share >= text_share THEN '도형' ELSE '문자' END AS dominant FROM s)
SELECT id, type, dominant, CASE WHEN type = '결합' THEN '결합-' || dominant || '요부' ELSE type END AS level, type AS shown FROM t"""
)
def auto_types(spark, sf_dir):
    s = _SHARES(spark, sf_dir).withColumn("t", marks.auto_type(F.col("text_share"), F.col("figure_share")))
    level = marks.model_type(F.col("t.type"), F.col("t.dominant"), F.lit(True))
    return s.select("id", F.col("t.type").alias("type"), F.col("t.dominant").alias("dominant"), level.alias("level"), marks.display_type(level).alias("shown"))


@query(
    f"""WITH s AS ({_SHARES.sql}), n AS (SELECT *, trim(name) <> '' AS named FROM s)
SELECT id, CASE WHEN override = '결합' THEN CASE WHEN named THEN '결합-문자요부' ELSE '결합-도형요부' END WHEN override IS NOT NULL THEN override WHEN NOT has_image THEN '문자' WHEN NOT read THEN CASE WHEN named THEN '문자' ELSE '도형' END
 WHEN named THEN CASE WHEN figure_share < 0.08 THEN '문자' ELSE '결합-문자요부' END ELSE CASE WHEN text_share >= 0.05 THEN '결합-도형요부' ELSE '도형' END END AS level,
 CASE WHEN override IS NOT NULL THEN 'user' WHEN NOT has_image OR NOT read THEN 'fallback' ELSE 'ocr' END AS source, override IS NULL AND has_image AND NOT read AS fallback FROM n"""
)
def query_types(spark, sf_dir):
    s = _SHARES(spark, sf_dir)
    seen = [F.when(F.col("read"), F.col(c)) for c in ("text_share", "figure_share")]
    return s.select("id", marks.query_type(F.col("override"), F.col("has_image"), F.col("name"), *seen).alias("q")).select("id", "q.level", "q.source", "q.fallback")


@query(
    f"""WITH s AS ({_SHARES.sql}), r AS (SELECT *, CASE mark_kind WHEN '도형상표' THEN '도형' WHEN '도형복합' THEN '결합' ELSE CASE WHEN drawn AND trim(name) <> '' THEN '결합' WHEN drawn THEN '도형' WHEN trim(name) <> '' THEN '문자' END END AS by_register,
  CASE WHEN mark_kind <> '' THEN '상표구분' WHEN drawn THEN '비엔나코드' WHEN trim(name) <> '' THEN '상표명' ELSE '없음' END AS why FROM s),
t AS (SELECT id, by_register, why, CASE WHEN by_register IS NULL AND read THEN CASE WHEN text_share < 0.05 THEN '도형' WHEN figure_share < 0.08 THEN '문자' ELSE '결합' END END AS seen FROM r)
SELECT coalesce(by_register, seen) AS type, CASE WHEN seen IS NOT NULL THEN 'OCR' ELSE why END AS basis, count(*) AS n FROM t GROUP BY ALL"""
)
def register_types(spark, sf_dir):
    s = _SHARES(spark, sf_dir).withColumn("vienna", F.when(F.col("drawn"), F.array(F.lit("01.01"))).otherwise(F.array(F.lit(" "))))
    typed = marks.precomputed_types(s.select("id", "mark_kind", "vienna", "name"), s.where("read").select("id", "text_share", "figure_share"), "id")
    return typed.groupBy("type", "basis").agg(F.count("*").alias("n"))


_PARTS = Bound(
    "part",
    id="p_partkey",
    kind="CASE p_partkey % 4 WHEN 0 THEN '문자' WHEN 1 THEN '도형' WHEN 2 THEN '결합' ELSE '' END",
    figure="CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 10 AS DOUBLE) / 10 ELSE NULL END",
    text="CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 8 AS DOUBLE) / 8 ELSE NULL END",
    whole="CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 6 AS DOUBLE) / 6 ELSE NULL END",
    confirmed="CASE p_partkey % 9 WHEN 0 THEN '문자' WHEN 1 THEN '결합-도형요부' ELSE NULL END",
    dominant="CASE WHEN p_partkey % 2 = 0 THEN '도형' ELSE '문자' END",
)


@query(
    f"""WITH p AS ({_PARTS.sql}), c AS (SELECT *, CASE kind WHEN '문자' THEN text WHEN '도형' THEN figure WHEN '결합' THEN greatest(coalesce(figure, text), coalesce(text, figure)) END AS chosen FROM p)
SELECT id, coalesce(chosen, whole) AS score, CASE WHEN chosen IS NULL THEN 'whole' WHEN kind = '문자' THEN 'text_ortho' WHEN kind = '도형' THEN 'fig' ELSE 'max' END AS source,
 CASE confirmed WHEN '문자' THEN 'text' WHEN '결합-도형요부' THEN 'figure' ELSE CASE kind WHEN '문자' THEN 'text' WHEN '도형' THEN 'figure' WHEN '결합' THEN CASE dominant WHEN '도형' THEN 'figure' ELSE 'text' END ELSE '' END END AS gate FROM c"""
)
def combined_scores(spark, sf_dir):
    p = _PARTS(spark, sf_dir)
    s = p.withColumn("s", marks.combined_score(F.col("kind"), F.col("figure"), F.col("text"), F.col("whole")))
    return s.select("id", F.col("s.score").alias("score"), F.col("s.source").alias("source"), marks.gate_type(F.col("confirmed"), F.col("kind"), F.col("dominant")).alias("gate"))


_TRAIN = Bound(
    "orders",
    id="o_orderkey",
    case_id="CAST(o_custkey AS STRING)",
    label="CASE o_orderkey % 3 WHEN 0 THEN '유사' WHEN 1 THEN '비유사' ELSE '' END",
    photo_a="o_orderkey % 10 = 0",
    photo_b="o_orderkey % 14 = 0",
    x1_d="CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.5 END",
    x2_text_d="CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.25 END",
    x2_whole="CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 0.75 END",
)


@query(
    f"""WITH t AS ({_TRAIN.sql}), p AS (SELECT *, CASE WHEN photo_a OR photo_b THEN NULL ELSE x2_whole END AS w FROM t WHERE label <> '' AND case_id NOT IN ('1', '2', '3'))
SELECT id, label, CAST(w AS DOUBLE) AS x2_whole FROM p WHERE x1_d IS NOT NULL OR x2_text_d IS NOT NULL OR w IS NOT NULL"""
)
def training_rows(spark, sf_dir):
    return marks.training_rows(_TRAIN(spark, sf_dir), ["1", "2", "3"]).select("id", "label", F.col("x2_whole").cast("double").alias("x2_whole"))


@query(
    """WITH r AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 3 = 0 AS i, o_orderkey % 4 = 0 AS c, CAST(o_totalprice AS BIGINT) AS a FROM orders)
SELECT k AS custkey, arg_max(id, (i::INT, c::INT, a)) AS id FROM r GROUP BY k"""
)
def better_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 0).alias("has_image"), (F.col("o_orderkey") % 4 == 0).alias("confident"),
        F.round("o_totalprice").cast("bigint").alias("area"),
    )
    return marks.better_rows(rows, "custkey").select("custkey", "id")
