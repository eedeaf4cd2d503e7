"""Cases of a tribunal: kinds, grading, outcome estimates, labels, numbers and orders of review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Results of orders, verdicts, polarities of conclusions.
DISMISSED, REJECTED, IN_SCOPE, OUT_OF_SCOPE = "각하", "기각", "속함", "불속"
SIMILAR, DISSIMILAR, EXCLUDED = "유사", "비유사", "제외"
AFFIRMED, DENIED = "긍정", "부정"
#: Articles about fame, the two articles of similarity with their labels, and that of distinctiveness.
FAME_ARTICLES = ("34-9", "34-11", "34-12", "34-13")
SIMILARITY_ARTICLES = (("34-7", "결론 7호"), ("35-1", "결론 35-1(선출원 저촉)"))
DISTINCTIVENESS_ARTICLE = "33"
#: What an order says of similarity by kind of case, and words of kinds in descriptions.
ORDER_SAYS = {"refusal": {"기각": SIMILAR, "취소": DISSIMILAR}, "invalidation": {"무효": SIMILAR, "일부무효": SIMILAR, "취소": SIMILAR, "기각": DISSIMILAR}}
KIND_WORDS = (("거절", "refusal"), ("무효", "invalidation"), ("권리범위", "scope"))
#: Axes on which marks are judged, number prefixes by wording, orders of review.
MARK_AXES = ("외관", "호칭", "관념")
NUMBER_PREFIX = {"상표": "40", "서비스표": "41", "상표서비스표": "45"}
REVIEW_KINDS, REVIEW_CONFIDENCE = ("scope", "refusal", "invalidation"), ("high", "low")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def case_kind(description: Column, kinds: dict[str, list[str]]) -> Column:
    """Kind of a case: by the exact description of a short list, else by a word in it, else ''."""
    text = F.trim(F.coalesce(description, F.lit("")))
    out = F.lit("")
    for word, kind in reversed(KIND_WORDS):
        out = F.when(text.contains(word), kind).otherwise(out)
    for kind, values in reversed(kinds.items()):
        out = F.when(text.isin(*values), kind).otherwise(out)
    return out


def conclusions(text: Column) -> Column:
    """'article:polarity|...' as an array of (article, polarity); parts without a colon are skipped."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: p.contains(":"))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("article"), F.regexp_extract(p, "^[^:]*:(.*)$", 1).alias("polarity")))


def polarity(found: Column, article: str) -> Column:
    """The last polarity given for an article, null without one."""
    own = F.filter(found, lambda x: x["article"] == article)
    return F.try_element_at(F.transform(own, lambda x: x["polarity"]), F.lit(-1))


def _option(value: str | Column, *reason: str | Column) -> Column:
    parts = [F.lit(r) if isinstance(r, str) else r for r in reason]
    return F.struct((F.lit(value) if isinstance(value, str) else value).alias("value"), F.concat(*parts).alias("reason"))


def graded(rows: DataFrame) -> DataFrame:
    """Adds grade ('1' pure similarity, '2' to review, '3' out) and its reason; the first rule that holds counts.

    Columns: kind, result, conclusions, mark_verdict, scope_basis, and the flags fame_in_body, bad_faith, prior_lapsed, inferred.
    """
    found = conclusions(F.col("conclusions"))
    articles = F.array_distinct(F.transform(found, lambda x: x["article"]))
    fame = F.filter(F.array(*[F.lit(a) for a in FAME_ARTICLES]), lambda a: F.array_contains(articles, a))
    verdict, basis = _text("mark_verdict"), _text("scope_basis")
    body = F.array_compact(F.array(F.when(_flag("bad_faith"), F.lit("부정한 목적")), F.when(_flag("fame_in_body"), F.lit("저명·주지(문구 제외 후)"))))
    inferred = F.when(_flag("inferred"), " (표장 소결 추론, 신뢰도 low)").otherwise("")
    (seventh, _), (earlier, _) = SIMILARITY_ARTICLES
    dismissed = _option("3", "각하(본안 판단 없음)")
    scope = (
        F.when(F.col("result") == DISMISSED, dismissed)
        .when(basis != "", _option("3", "권리범위: ", F.replace(basis, F.lit("|"), F.lit("·"))))
        .when(verdict == "", _option("2", "권리범위: 표장 유사 소결 없음"))
        .when(F.size(fame) > 0, _option("2", "권리범위: 표장 소결 있으나 인지도 조문 ", F.array_join(fame, ",")))
        .when(_flag("fame_in_body"), _option("2", "권리범위: 표장 ", verdict, " 소결이나 저명·주지 언급"))
        .otherwise(_option("1", "권리범위: 표장 ", verdict, " 소결, 인지도 언급 없음"))
    )
    other = (
        F.when(F.col("result") == DISMISSED, dismissed)
        .when(_flag("prior_lapsed"), _option("3", "유사 판단 없음(선등록상표 소멸·무효로 취소)"))
        .when(F.size(fame) > 0, _option("3", "결론에 인지도 조문 ", F.array_join(fame, ",")))
        .when(F.size(articles) == 0, _option("2", "결론 조문 추출 실패"))
        .when(F.forall(articles, lambda a: a == DISTINCTIVENESS_ARTICLE), _option("3", "식별력 사례(33조만)"))
        .when(F.array_contains(articles, seventh) & (F.size(body) == 0), _option("1", "결론 7호, 인지도 언급 없음", inferred))
        .when(F.array_contains(articles, seventh), _option("2", "결론 7호이나 본문에 ", F.array_join(body, "·")))
        .when(F.array_contains(articles, earlier) & (F.size(body) > 0), _option("2", "결론 35-1(선출원 저촉)이나 본문에 ", F.array_join(body, "·")))
        .when(F.array_contains(articles, earlier) & (verdict == ""), _option("2", "결론 35-1(선출원 저촉)이나 표장 소결 없음"))
        .when(F.array_contains(articles, earlier), _option("1", "결론 35-1(선출원 저촉), 표장 ", verdict, " 소결, 인지도 언급 없음"))
        .otherwise(_option("2", "결론 조문이 7호 아님(", F.array_join(articles, ","), ")"))
    )
    chosen = F.when(F.col("kind") == "scope", scope).otherwise(other)
    return rows.withColumn("_o", chosen).withColumns({"grade": F.col("_o.value"), "reason": F.col("_o.reason")}).drop("_o")


def estimated(rows: DataFrame) -> DataFrame:
    """Adds guess (similar, dissimilar or '') and basis, from columns kind, result, conclusions, mark_verdict, goods_verdict, description, inferred."""
    found = conclusions(F.col("conclusions"))
    verdict, goods, result = _text("mark_verdict"), _text("goods_verdict"), _text("result")
    about = _text("description")
    none = _option("", "")
    scope = (
        F.when(result == IN_SCOPE, _option(SIMILAR, "주문 속함(scope)"))
        .when(result == OUT_OF_SCOPE, _option(DISSIMILAR, "주문 불속(scope)"))
        .when((result == REJECTED) & about.contains("소극"), _option(SIMILAR, "주문 기각(소극적 권리범위확인 → 속함)"))
        .when((result == REJECTED) & about.contains("적극"), _option(DISSIMILAR, "주문 기각(적극적 권리범위확인 → 불속)"))
        .otherwise(none)
    )
    by_article = []
    for article, label in SIMILARITY_ARTICLES:
        says = polarity(found, article)
        guess = F.when(says == AFFIRMED, SIMILAR).otherwise(DISSIMILAR)
        by_goods = (guess == DISSIMILAR) & (goods == DISSIMILAR)
        by_article.append(
            F.when(
                says.isin(AFFIRMED, DENIED),
                F.when(_flag("inferred"), _option(guess, f"{label} ", says, " — 표장 소결 추론"))
                .when(by_goods & (verdict == ""), _option("", f"{label} 부정은 상품 비유사 때문 — 표장 판단 없음"))
                .when((verdict != "") & (verdict != guess) & by_goods, _option(SIMILAR, f"소결 표장 유사(상품 비유사로 {label} 부정)"))
                .when((verdict != "") & (verdict != guess), _option(guess, f"{label} ", says, " · 소결 표장 ", verdict, "와 불일치"))
                .otherwise(_option(guess, f"{label} ", says)),
            )
        )
    order = F.lit("")
    for kind, says in ORDER_SAYS.items():
        for value, meaning in says.items():
            of_kind = F.col("kind") == kind if kind == "refusal" else F.col("kind") != "refusal"
            order = F.when(of_kind & (result == value), meaning).otherwise(order)
    rest = (
        F.when(verdict != "", _option(verdict, "소결 표장 ", verdict, "(조문 없음)"))
        .when(F.exists(found, lambda x: x["article"] == SIMILARITY_ARTICLES[0][0]) & (order != ""), _option(order, "주문 ", result, "(", F.col("kind"), ")"))
        .otherwise(none)
    )
    chosen = F.when(F.col("kind") == "scope", scope).otherwise(F.coalesce(*by_article, rest))
    return rows.withColumn("_o", chosen).withColumns({"guess": F.col("_o.value"), "basis": F.col("_o.reason")}).drop("_o")


def target_rows(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.where(F.col(label).isin(SIMILAR, DISSIMILAR))


def mark_label(label: Column, memo: Column, axes: Column) -> Column:
    """Label of the marks alone: similar by label or memo, dissimilar only if a mark axis was judged, else ''."""
    memo_says = F.coalesce(memo, F.lit("")).rlike(r"표장\s*유사(?!\s*(?:여부|판단|미판단))")
    judged = F.lit(False)
    for axis in MARK_AXES:
        judged = judged | F.coalesce(axes, F.lit("")).contains(axis)
    return F.when((F.coalesce(label, F.lit("")) == SIMILAR) | memo_says, SIMILAR).when((label == DISSIMILAR) & judged, DISSIMILAR).otherwise("")


def normalized_number(number: Column, wording: Column) -> Column:
    """struct(kind, number): application and registration numbers of 13 digits, short registration numbers filled up, foreign and other ones as they are."""
    digits = F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9]", "")
    year = F.substring(digits, 3, 4).cast("int")
    long = (F.char_length(digits) == 13) & F.substring(digits, 1, 2).isin("40", "41", "42", "43", "44", "45")
    prefix = F.lit(NUMBER_PREFIX["상표"])
    for word, value in NUMBER_PREFIX.items():
        prefix = F.when(wording == word, value).otherwise(prefix)
    filled = F.concat(prefix, F.lpad(F.regexp_replace(digits, "^0+(?=.)", ""), 7, "0"), F.lit("0000"))

    def pair(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("number"))

    return (
        F.when(digits == "", pair("", digits))
        .when(wording == "국제", pair("international", digits))
        .when(long & digits.endswith("0000"), pair("registration", digits))
        .when(long, pair("application", digits))
        .when(F.char_length(digits) <= 7, pair("registration", filled))
        .otherwise(pair("unknown", digits))
    )


def family_key(claimant: Column, numbers: Column) -> Column:
    """First 8 hex digits of a hash of the claimant without blanks and the set of prior numbers."""
    name = F.lower(F.regexp_replace(F.coalesce(claimant, F.lit("")), r"\s", ""))
    return F.substring(F.sha1(F.concat(name, F.lit("|"), F.array_join(F.array_sort(F.array_distinct(numbers)), "|")).cast("binary")), 1, 8)


def first_per_month(rows: DataFrame, month: str, claimant: str, number: str) -> DataFrame:
    """One row for each claimant and month, that of the least number, combined before it moves."""
    key = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(claimant), F.lit("")), r"\s+", " ")))
    others = [c for c in rows.columns]
    least = rows.groupBy(F.col(month).alias("_m"), key.alias("_k")).agg(F.min_by(F.struct(*others), F.col(number)).alias("r"))
    return least.select(*[F.col(f"r.{c}").alias(c) for c in others])


def collection_sample(rows: DataFrame, quotas: dict[str, int], kind: str = "kind", month: str = "month", claimant: str = "claimant", number: str = "number") -> DataFrame:
    """Scope cases newest first, invalidations by month in turn, refusals once for each claimant and month, by month in turn; place tells the order of a kind."""
    from emberloom.operators.corpus import round_robin

    scope = rows.where(F.col(kind) == "scope").orderBy(F.desc(month), F.desc(number)).limit(quotas.get("scope", 0))
    scope = scope.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(month), F.desc(number))))
    parts = [scope]
    for name in ("invalidation", "refusal"):
        own = rows.where(F.col(kind) == name)
        own = first_per_month(own, month, claimant, number) if name == "refusal" else own
        turned = round_robin(own, month, number, quotas.get(name, 0))
        parts.append(turned.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy("turn", month))).drop("turn"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def curation_queue(rows: DataFrame) -> DataFrame:
    """rows (number, pos, round, grade, reason, family_copy, kind, confidence, counterpart) -> one row a case in the order of review.

    First rounds first; within one, grade 1, then grade 2 of scope cases about
    fame; by kind, confidence and number. Counterparts are joined in their order.
    """
    first = rows.groupBy("number").agg(
        F.min_by(F.struct("round", "grade", "reason", "family_copy", "kind", "confidence"), "pos").alias("f"),
        F.array_sort(F.collect_list(F.struct("pos", "counterpart"))).alias("c"),
    )
    known = F.array_distinct(F.filter(F.transform("c", lambda x: x["counterpart"]), lambda x: x.isNotNull() & (x != "")))
    bucket = F.when(F.col("grade") == "1", 0).when((F.col("grade") == "2") & F.col("reason").rlike("^권리범위.*저명·주지 언급"), 1)
    kind = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in REVIEW_KINDS]), F.col("kind")), F.lit(0)) - 1, F.lit(len(REVIEW_KINDS)))
    sure = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in REVIEW_CONFIDENCE]), F.col("confidence")), F.lit(0)) - 1, F.lit(len(REVIEW_CONFIDENCE)))
    flat = first.select("number", "f.*", F.array_join(known, ";").alias("counterparts")).where(~_flag("family_copy")).withColumn("bucket", bucket).where("bucket is not null")
    # rounds are few and small beside the archive: the queue of one is ordered by itself
    keyed = flat.withColumns({"_k": kind, "_c": sure})
    place = F.row_number().over(Window.partitionBy("round").orderBy("bucket", "_k", "_c", "number"))
    return keyed.select("number", "round", "bucket", "kind", "confidence", "counterparts", place.alias("place"))


def label_summary(rows: DataFrame) -> DataFrame:
    """One row of counts: verdicts, confirmed rows, and how often human, model, estimate and second pass agree."""
    verdict, source, second, estimate = (_text(c) for c in ("verdict", "source", "second", "estimate"))
    model = F.when(_text("model") != "", _text("model")).otherwise(F.when(source == "llm", verdict).otherwise(""))
    done = verdict != ""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(done).alias("labelled"),
        *[F.count_if(verdict == v).alias(n) for n, v in (("similar", SIMILAR), ("dissimilar", DISSIMILAR), ("excluded", EXCLUDED))],
        F.count_if(done & (source == "human-confirmed")).alias("agreed"),
        F.count_if(done & (source == "human") & (_text("model") != "")).alias("changed"),
        F.count_if(done & (model != "") & (estimate != "")).alias("with_estimate"),
        F.count_if(done & (model != "") & (model == estimate)).alias("estimate_agreed"),
        F.count_if((model != "") & (second != "")).alias("two_passes"),
        F.count_if((model != "") & (second == model)).alias("passes_agreed"),
    )


def yield_table(rows: DataFrame, least: int = 20) -> DataFrame:
    """rows (kind, condition_group, figure, grade): received, first-grade and yield of each kind and group.

    A group with less than least cases takes the yield of its kind's word
    cases, or for the figure group, or if those are few too, of the whole kind.
    """
    hit = F.col("grade") == "1"
    groups = rows.groupBy("kind", "condition_group", "figure").agg(F.count("*").alias("received"), F.count_if(hit).alias("first"))
    kinds = groups.groupBy("kind").agg(
        F.sum("received").alias("all_n"), F.sum("first").alias("all_first"),
        F.sum(F.when(~F.col("figure"), F.col("received")).otherwise(0)).alias("word_n"), F.sum(F.when(~F.col("figure"), F.col("first")).otherwise(0)).alias("word_first"),
    )
    joined = groups.join(kinds, "kind")
    few = F.col("received") < least
    whole = F.col("figure") | (F.col("word_n") < least)
    n = F.when(~few, F.col("received")).when(whole, F.col("all_n")).otherwise(F.col("word_n"))
    first = F.when(~few, F.col("first")).when(whole, F.col("all_first")).otherwise(F.col("word_first"))
    return joined.select("kind", "condition_group", "figure", "received", "first", F.when(n > 0, first / n).otherwise(0.0).alias("rate"), few.alias("replaced"))


def allocate_weighted(total: int, weights: dict[str, float], caps: dict[str, int]) -> dict[str, int]:
    """Shares of a total by weight, none above its cap; what a cap leaves over is shared again, rests go by largest remainder, then key.

    For a handful of strata, on the driver.
    """
    given = dict.fromkeys(weights, 0)
    open_ = {k for k in weights if weights[k] > 0 and caps.get(k, 0) > 0}
    while total > 0 and open_:
        whole = sum(weights[k] for k in open_)
        ideal = {k: total * weights[k] / whole for k in sorted(open_)}
        full = {k for k in open_ if ideal[k] >= caps[k]}
        if full:
            given |= {k: caps[k] for k in full}
            total -= sum(caps[k] for k in full)
            open_ -= full
            continue
        given |= {k: int(ideal[k]) for k in open_}
        for k in sorted(open_, key=lambda k: (int(ideal[k]) - ideal[k], k))[: total - sum(given[k] for k in open_)]:
            given[k] += 1
        break
    return given
