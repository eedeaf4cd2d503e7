"""The three-input search: pools, axes, risk, rank and overall, for a whole table of queries.

queries: query_id, name, goods array<string>, embedding array<float>, mark_type,
and optionally name_vector with has_meaning, photo and nameless_floor.
marks: id, title, codes array<string>, embedding array<float>, and optionally
title_vector with has_meaning.
Any of a query's inputs may be null; without any it gets no candidate. The
meaning axis is observed where both names have a word; the image of a photo
query is not held against a named pair; a query whose mark the user called a
figure (nameless_floor) takes the nameless judgement if it is graded higher.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberloom.functions import codes, phonetic, vectors
from emberloom.operators import distinct, meaning, retrieval, risk
from emberloom.session import use_checkpoint_dir


def pools(queries: DataFrame, marks: DataFrame, sizes: dict[str, int] = retrieval.POOLS) -> DataFrame:
    """(query_id, id, sources): union of the image, phonetic, spelling and goods pools."""
    q_image = queries.where("embedding is not null").select("query_id", F.col("embedding").alias("q"))
    named = queries.where("trim(coalesce(name, '')) <> ''").select("query_id", F.col("name").alias("q_name"))
    titled = marks.where("trim(coalesce(title, '')) <> ''").select("id", F.col("title").alias("name"))
    q_codes = queries.select("query_id", codes.clean_codes(F.col("goods")).alias("codes")).where(F.size("codes") > 0)
    m_codes = marks.select("id", codes.clean_codes(F.col("codes")).alias("codes")).where(F.size("codes") > 0)
    return retrieval.pool_union(
        {
            "image": retrieval.vector_topk(q_image, marks.where("embedding is not null").select("id", F.col("embedding").alias("v")), sizes["image"]),
            "phonetic": retrieval.name_topk(named, titled, F.round(phonetic.phonetic_similarity_udf("name", "q_name"), 4), sizes["phonetic"], 1e-9),
            "spelling": retrieval.spelling_topk(named, titled, sizes["spelling"]),
            "goods": retrieval.codes_topk(q_codes, m_codes, sizes["goods"]),
        }
    )


def judged_names(rows: DataFrame, key: str, name: str, stats: DataFrame, words: DataFrame) -> DataFrame:
    """(key, judged): each name's tokens in order with their scores, judged once per distinct token."""
    each = rows.select(key, F.posexplode(phonetic.tokens_udf(name)).alias("pos", "token"))
    spark = rows.sparkSession
    none = spark.createDataFrame([], "token string, absolute boolean, classes array<int>, codes array<string>")
    tokens = each.select("token").distinct().select("token", F.lit(None).cast("array<string>").alias("goods"), F.lit(None).cast("array<int>").alias("classes"))
    scored = distinct.judged(tokens, stats, words, none, none).select("token", "score")
    own = each.join(scored, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "score"))).alias("j"))
    return own.select(key, F.transform("j", lambda x: F.struct(x["token"].alias("token"), x["score"].alias("score"))).alias("judged"))


def candidates(queries: DataFrame, marks: DataFrame, stats: DataFrame, words: DataFrame, top_k: int = 5, baseline: float = 0.0) -> DataFrame:
    """The ranked candidates of each query with their axes, grade and contributions."""
    if not 1 <= top_k <= 20:
        raise ValueError("top_k is 1 to 20")
    flag = F.lit(False)
    for name, kind in (("name_vector", "array<float>"), ("has_meaning", "boolean"), ("photo", "boolean"), ("nameless_floor", "boolean")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    for name, kind in (("title_vector", "array<float>"), ("has_meaning", "boolean")):
        if name not in marks.columns:
            marks = marks.withColumn(name, F.lit(None).cast(kind))
    marks = marks.withColumnRenamed("has_meaning", "title_has_meaning")
    # names repeat: each is judged once
    m = marks.join(judged_names(marks.select("title").distinct(), "title", "title", stats, words).withColumnRenamed("judged", "judged_b"), "title", "left")
    q = queries.join(judged_names(queries.select("name").distinct(), "name", "name", stats, words).withColumnRenamed("judged", "judged_a"), "name", "left")
    pairs = pools(queries, marks).join(q.withColumnsRenamed({"embedding": "q_embedding"}), "query_id").join(m.withColumnsRenamed({"embedding": "m_embedding", "codes": "m_codes"}), "id")
    both = F.col("name").isNotNull() & F.col("title").isNotNull()
    meant = F.coalesce(F.col("has_meaning") & F.col("title_has_meaning") & F.col("name_vector").isNotNull() & F.col("title_vector").isNotNull(), flag)
    # names repeat: their pairs are compared once
    names = pairs.where(both).select("name", "title", "judged_a", "judged_b").dropDuplicates(["name", "title"])
    compared = names.select("name", "title", distinct.name_axes("name", "title", "judged_a", "judged_b").alias("n"))
    scored = pairs.join(compared, ["name", "title"], "left")
    qc, mc = codes.clean_codes(F.col("goods")), codes.clean_codes(F.col("m_codes"))
    axes = scored.select(
        "query_id",
        "id",
        "title",
        "sources",
        "mark_type",
        F.concat_ws(":", "query_id", "id").alias("pair"),
        F.when(both, F.col("n.x1")).alias("x1_d"),
        F.when(both, F.col("n.x2_text")).alias("x2_text_d"),
        F.when(both & meant, F.round(vectors.recalibrated(vectors.dot("name_vector", "title_vector"), baseline), 4)).alias("x3_d"),
        (both & meant).alias("has_meaning_both"),
        F.when(both, F.col("n.has_distinctive_a")).otherwise(True).alias("has_distinctive_a"),
        F.when(both, F.col("n.has_distinctive_b")).otherwise(True).alias("has_distinctive_b"),
        F.when(~(both & F.coalesce("photo", flag)), F.round(vectors.clip01(vectors.dot("q_embedding", "m_embedding")), 4)).alias("x2_whole"),
        (both & F.coalesce("nameless_floor", flag)).alias("nameless_floor"),
        F.when((F.size(qc) > 0) & (F.size(mc) > 0), F.round(codes.jaccard(qc, mc), 4)).alias("x4"),
        F.when(both, F.col("n.generic")).alias("removed"),
    )
    # the judgements compared below all start from the same axes, which are computed once
    use_checkpoint_dir(marks.sparkSession)
    return risk.ranked(meaning.nameless_floor(axes.checkpoint(), "pair").drop("pair"), "query_id", "id", top_k)


def overall(found: DataFrame) -> DataFrame:
    return risk.overall(found, "query_id")


def shown(found: DataFrame) -> DataFrame:
    """Candidates as nested response rows."""
    rounded = {a: F.round(a, 3) for a in ("x1_d", "x2_text_d", "x3_d", "x2_whole", "x4", "p")}
    return found.select(
        "query_id",
        "rank",
        F.struct(
            "id",
            "title",
            F.struct(rounded["x1_d"].alias("x1"), rounded["x2_text_d"].alias("x2_text"), rounded["x3_d"].alias("x3"), rounded["x2_whole"].alias("x2_img"), rounded["x4"].alias("x4")).alias("axes"),
            F.struct(rounded["p"].alias("p"), F.element_at(F.array(*[F.lit(g) for g in risk.GRADES]), F.col("grade") + 1).alias("grade"), "contributions").alias("risk"),
            F.col("removed"),
            F.split("sources", ",").alias("sources"),
        ).alias("candidate"),
    )
