"""Distinctiveness: which tokens of a name carry it, and which are left out of a pair's comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberloom.functions import phonetic
from emberloom.operators.corpus import intrinsic, is_simple_mark, registration_factor

#: Score from which a token is salient, and the cap of a relative term without known goods.
SALIENT, CAPPED = 0.5, 0.5


def goods_single_tokens(goods: DataFrame) -> DataFrame:
    """goods (name, nice_class, codes) -> token, classes, codes of names that are one token."""
    own = goods.select(phonetic.tokens_udf("name").alias("t"), "nice_class", "codes").where(F.size("t") == 1)
    return own.groupBy(F.col("t")[0].alias("token")).agg(F.collect_set("nice_class").alias("classes"), F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes"))


def judged(
    tokens: DataFrame, stats: DataFrame, words: DataFrame, descriptive: DataFrame, goods_index: DataFrame, famous: list[str] = (), places: list[str] = (), surnames: list[str] = (), overrides: list[str] = ()
) -> DataFrame:
    """Adds score and reasons to tokens (token, goods array or null, classes array or null).

    stats (token, a, n), words (token, zipf), descriptive (token, absolute,
    classes) and goods_index are joined by token; the name lists are of fixed
    size. Order: famous, descriptive, goods name, place, surname, simple mark,
    override, intrinsic times registration.
    """
    d = descriptive.select("token", F.col("absolute").alias("d_absolute"), F.col("classes").alias("d_classes"))
    g = goods_index.select("token", F.col("classes").alias("g_classes"), F.col("codes").alias("g_codes"))
    rows = tokens.join(stats, "token", "left").join(words, "token", "left").join(d, "token", "left").join(g, "token", "left")
    unknown = F.col("goods").isNull() & F.col("classes").isNull()
    relative = F.col("d_absolute").isNotNull() & ~F.col("d_absolute")
    class_hit = F.coalesce(F.arrays_overlap("classes", "d_classes"), F.lit(False))
    goods_hit = F.coalesce(F.arrays_overlap("goods", "g_codes"), F.lit(False)) | F.coalesce(F.arrays_overlap("classes", "g_classes"), F.lit(False))
    token = F.col("token")
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("d_absolute", F.lit(False)) | (relative & class_hit), "descriptive"),
            F.when(F.col("g_codes").isNotNull() & (unknown | goods_hit), "goods"),
            F.when(token.isin(*places) if places else F.lit(False), "place"),
            F.when(token.isin(*surnames) if surnames else F.lit(False), "surname"),
            F.when(is_simple_mark(token), "simple"),
        )
    )
    coined = intrinsic(F.col("zipf")) * registration_factor(F.coalesce("a", F.lit(0)), F.coalesce("n", F.lit(0)))
    capped = F.when(relative & unknown, F.least(coined, F.lit(CAPPED))).otherwise(coined)
    score = (
        F.when(token == "", 0.0)
        .when(token.isin(*famous) if famous else F.lit(False), 1.0)
        .when(F.size("reasons") > 0, 0.0)
        .when(token.isin(*overrides) if overrides else F.lit(False), 1.0)
        .otherwise(capped)
    )
    out = rows.withColumn("reasons", reasons).withColumn("score", F.round(score, 4))
    return out.select(*tokens.columns, "score", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("coined"))).alias("reasons"))


def salient(judgements: Column) -> Column:
    return F.transform(F.filter(judgements, lambda j: j["score"] >= SALIENT), lambda j: j["token"])


def weak(judgements: Column) -> Column:
    return F.transform(F.filter(judgements, lambda j: j["score"] < SALIENT), lambda j: j["token"])


def joined_compounds(own: list[str], other: list[str], weak_tokens: set[str]) -> set[str]:
    """Weak tokens of runs of two or more whose joined spelling is a single token of the other name."""
    singles = {phonetic.spell(t) for t in other}
    out: set[str] = set()
    for i in range(len(own)):
        for j in range(i + 2, len(own) + 1):
            run = own[i:j]
            if weak_tokens & set(run):
                joined = phonetic.spell("".join(run))
                if any(phonetic.edit_similarity(joined, s) >= 0.9 for s in singles):
                    out |= weak_tokens & set(run)
    return out


def pair_generic(a: list[tuple[str, float]], b: list[tuple[str, float]]) -> set[str]:
    """Tokens a pair is compared without: each name's weak ones if it has a salient one, less what both share as a run or a compound."""
    names = [[t for t, _ in x] for x in (a, b)]
    low = [[t for t, s in x if s < SALIENT] for x in (a, b)]
    out = {t for x, w in zip((a, b), low, strict=True) if any(s >= SALIENT for _, s in x) for t in w}
    out -= set(phonetic.common_run(*low))
    return out - joined_compounds(names[0], names[1], set(low[0])) - joined_compounds(names[1], names[0], set(low[1]))


_JUDGED = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("score", T.DoubleType())]))
_AXES = T.StructType(
    [
        T.StructField("x1", T.DoubleType()),
        T.StructField("x2_text", T.DoubleType()),
        T.StructField("has_distinctive_a", T.BooleanType()),
        T.StructField("has_distinctive_b", T.BooleanType()),
        T.StructField("generic", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(_AXES)
def name_axes(name_a: pd.Series, name_b: pd.Series, judged_a: pd.Series, judged_b: pd.Series) -> pd.DataFrame:
    """Sound and spelling likeness of two names without the pair's generic tokens, null where a side has no token."""
    out = []
    for a, b, ja, jb in zip(name_a, name_b, judged_a, judged_b):
        own = [[(j["token"], j["score"]) for j in (x if x is not None else ())] for x in (ja, jb)]
        generic = frozenset(pair_generic(*own))
        known = bool(phonetic.tokens(a or "") and phonetic.tokens(b or ""))
        out.append(
            (
                round(phonetic.phonetic_similarity(a, b, generic), 4) if known else None,
                round(phonetic.assigned_similarity(a, b, generic), 4) if known else None,
                any(s >= SALIENT for _, s in own[0]),
                any(s >= SALIENT for _, s in own[1]),
                sorted(generic),
            )
        )
    return pd.DataFrame(out, columns=[f.name for f in _AXES.fields])
