"""Risk model: missing-pattern blocks of a logistic model, grades, and the rule layer.

Input rows have x1_d, x2_text_d, x3_d, x2_whole, x4 (null: not observed),
has_meaning_both, has_distinctive_a, has_distinctive_b and mark_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficient blocks by observed pattern.
TERMS = ("x1_d", "x2_text_d", "x3_d", "any_no_distinctive", "x1_text", "x1_no_distinctive", "x2_whole", "x2_figure", "x4")
BLOCKS = {
    "base": (-3.6361, (1.5580, 0.8547, 0.0, 0.7364, 2.1974, -0.9297, 0.0, 0.0, 0.0)),
    "x2_whole": (-3.8103, (1.3354, 0.8547, 0.0, 0.7488, 2.4199, -0.9421, 0.5, 0.6382, 0.0)),
    "x4": (-3.4535, (1.4033, 0.8547, 0.0, 1.2100, 2.1454, -1.4033, 0.0, 0.0, 0.9583)),
    "x2_whole+x4": (-3.4712, (1.2467, 0.8547, 0.0, 1.0534, 2.1454, -1.2467, 0.5, 0.3637, 0.9583)),
    "noname:x2_whole": (-1.9187, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.1447, 0.3229, 0.0)),
    "noname:x2_whole+x4": (-1.9572, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.1447, 0.3229, 1.5302)),
}
REFERENCE = "x2_whole+x4"
#: Least probabilities of caution, review and risk.
CUTS = {"named": (0.0902, 0.1805, 0.5902), "noname:x2_whole": (0.3677, 0.4910, 0.5724), "noname:x2_whole+x4": (0.2944, 0.4441, 0.7892)}
#: Axis values that alone lift a grade to review; the figure rule's; floors that couple axes.
STANDALONE = {"x1_d": 0.98, "x2_text_d": 0.75, "x3_d": 0.7707}
FIGURE_RULE, GOODS_FLOOR, IMAGE_FLOOR = 0.9, 0.0252, 0.3487
#: Mark types of the text and figure families; anything else counts as text.
TEXT_FAMILY, FIGURE_FAMILY = ("text", "combined-text"), ("figure", "combined-figure")
GRADES = ("safe", "caution", "review", "risk")


def blocks_table(spark) -> DataFrame:
    rows = [(key, intercept, *weights, *CUTS.get(key, CUTS["named"])) for key, (intercept, weights) in BLOCKS.items()]
    names = ", ".join(f"w_{t} double" for t in TERMS)
    return spark.createDataFrame(rows, f"pattern string, intercept double, {names}, cut1 double, cut2 double, cut3 double")


def observed(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def design(rows: DataFrame) -> DataFrame:
    """Adds the design terms (t_ columns), the missing flags and the pattern."""
    seen = {a: observed(a) for a in ("x1_d", "x2_text_d", "x2_whole", "x4")}
    seen["x3_d"] = observed("x3_d") & F.coalesce("has_meaning_both", F.lit(False))
    value = {a: F.when(s, F.col(a)).otherwise(0.0) for a, s in seen.items()}
    figure = F.coalesce(F.col("mark_type").isin(*FIGURE_FAMILY), F.lit(False))
    distinct = F.coalesce("has_distinctive_a", F.lit(True)) & F.coalesce("has_distinctive_b", F.lit(True))
    none = F.when(distinct, 0.0).otherwise(1.0)
    terms = {
        **value,
        "any_no_distinctive": none,
        "x1_text": F.when(figure, 0.0).otherwise(value["x1_d"]),
        "x1_no_distinctive": value["x1_d"] * none,
        "x2_figure": F.when(figure, value["x2_whole"]).otherwise(0.0),
    }
    key = F.concat_ws("+", F.when(seen["x2_whole"], F.lit("x2_whole")), F.when(seen["x4"], F.lit("x4")))
    key = F.when(key == "", "base").otherwise(key)
    nameless = ~seen["x1_d"] & ~seen["x2_text_d"] & seen["x2_whole"]
    out = {f"t_{t}": terms[t] for t in TERMS} | {f"miss_{a}": F.when(s, 0).otherwise(1) for a, s in seen.items()}
    return rows.withColumns(out).withColumns({"figure_family": figure, "pattern": F.when(nameless, F.concat(F.lit("noname:"), key)).otherwise(key)})


def grade_of(p: Column, cuts: list[Column]) -> Column:
    """Index of the highest known cut that p reaches."""
    hit = F.lit(0)
    for k, cut in enumerate(cuts, 1):
        hit = F.when(cut.isNotNull() & (p >= cut), k).otherwise(hit)
    return hit


def score(rows: DataFrame) -> DataFrame:
    """Adds pattern, logit, p, grade (0..3), contributions and figure_caveat."""
    table = F.broadcast(blocks_table(rows.sparkSession))  # six rows
    joined = design(rows).join(table, "pattern")
    shares = {t: F.col(f"w_{t}") * F.col(f"t_{t}") for t in TERMS}
    logit = F.col("intercept")
    for t in TERMS:
        logit = logit + shares[t]
    reference = BLOCKS[REFERENCE][0]
    parts = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("intercept", "miss_pattern", *TERMS)]), F.array(F.lit(reference), F.col("intercept") - reference, *[shares[t] for t in TERMS])
    )
    scored = joined.withColumns({"logit": logit, "contributions": parts})
    scored = scored.withColumn("p", F.when(F.col("logit") > -700, 1 / (1 + F.exp(-F.col("logit")))).otherwise(0.0))
    base = grade_of(F.col("p"), [F.col(f"cut{k}") for k in (1, 2, 3)])
    alone = F.lit(False)
    for axis, tau in STANDALONE.items():
        alone = alone | ((F.col(f"miss_{axis}") == 0) & (F.col(f"t_{axis}") >= tau))
    figure = F.col("figure_family") & (F.col("miss_x2_whole") == 0) & (F.col("t_x2_whole") >= FIGURE_RULE)
    lifted = F.when(alone | figure, F.greatest(base, F.lit(2))).otherwise(base)
    # where in its grade's band p lies, so that blocks of different scale interleave
    index = grade_of(F.col("p"), [F.col(f"cut{k}") for k in (1, 2, 3)])
    low = F.element_at(F.array(F.lit(0.0), F.col("cut1"), F.col("cut2"), F.col("cut3")), index + 1)
    high = F.element_at(F.array(F.col("cut1"), F.col("cut2"), F.col("cut3"), F.lit(1.0)), index + 1)
    out = scored.withColumns({"grade": lifted, "figure_caveat": F.col("figure_family"), "rank_index": index, "rank_band": (F.round("p", 6) - low) / (high - low)})
    helpers = [c for c in out.columns if c.startswith(("w_", "t_", "cut"))]
    return out.drop("intercept", *helpers)


def goods_floor(rows: DataFrame, key: str) -> DataFrame:
    """score(), where a nameless image+goods judgement gives way to the image alone if that is graded strictly higher."""
    full = score(rows)
    alone = score(rows.withColumn("x4", F.lit(None).cast("double")).where("x2_whole is not null"))
    other = alone.select(key, F.col("grade").alias("g2"), F.col("p").alias("p2"), F.col("rank_index").alias("i2"), F.col("rank_band").alias("b2"), F.col("pattern").alias("pat2"))
    both = full.join(other, key, "left")
    can = F.col("pattern").startswith("noname:") & (F.col("x4") >= GOODS_FLOOR) & F.col("g2").isNotNull()
    swap = can & (F.col("g2") > F.col("grade"))
    place = F.when(can, F.greatest(F.struct("rank_index", "rank_band"), F.struct(F.col("i2").alias("rank_index"), F.col("b2").alias("rank_band")))).otherwise(
        F.struct("rank_index", "rank_band")
    )
    return both.select(
        *[c for c in full.columns if c not in ("grade", "p", "pattern", "rank_index", "rank_band")],
        F.when(swap, F.col("g2")).otherwise(F.col("grade")).alias("grade"),
        F.when(swap, F.col("p2")).otherwise(F.col("p")).alias("p"),
        F.when(swap, F.col("pat2")).otherwise(F.col("pattern")).alias("pattern"),
        place["rank_index"].alias("rank_index"),
        place["rank_band"].alias("rank_band"),
        F.coalesce(swap, F.lit(False)).alias("goods_floor"),
    )


def ranked(rows: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k first of each query: grade place by p, place in the band, image, then key."""
    image = F.coalesce(F.col("x2_whole"), F.lit(-1.0))
    order = Window.partitionBy(query).orderBy(F.desc("rank_index"), F.desc("rank_band"), image.desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def overall(top: DataFrame, query: str) -> DataFrame:
    """Per query over its ranked candidates: highest grade, the first pattern with it, highest p of that kind."""
    best = top.groupBy(query).agg(F.max("grade").alias("grade"))
    named = F.when(F.col("pattern").startswith("noname:"), "noname").otherwise("named")
    joined = top.withColumn("kind", named).join(best.withColumnRenamed("grade", "overall_grade"), query)
    first = joined.where("grade = overall_grade").groupBy(query, "overall_grade").agg(F.min_by(F.struct("pattern", "kind"), "rank").alias("first"))
    peaks = joined.groupBy(query, "kind").agg(F.max("p").alias("max_p"))
    return first.select(query, "overall_grade", F.col("first.pattern").alias("pattern"), F.col("first.kind").alias("kind")).join(peaks, [query, "kind"]).select(
        query, "overall_grade", "pattern", "max_p"
    )


def coupling_violations(spark, tolerance: float = 1e-9) -> DataFrame:
    """Vertices of the unit box where observing one more axis at its floor lowers the logit."""
    return coupling_table(spark).where(F.col("high") < F.col("low") - tolerance)


def coupling_table(spark) -> DataFrame:
    """Each vertex of the unit box with its logit before (low) and after (high) one more axis is observed at its floor."""
    def bit(k: int) -> Column:
        return F.shiftright("id", k).bitwiseAND(F.lit(1)) == 1

    grid = spark.range(0, 32, 1, 1).select(
        *[F.when(bit(k), 1.0).otherwise(0.0).alias(axis) for k, axis in enumerate(("x1_d", "x2_text_d", "x3_d"))], bit(3).alias("has_distinctive_b"), bit(4).alias("figure")
    )
    base = grid.select(
        "*", F.lit(True).alias("has_meaning_both"), F.lit(True).alias("has_distinctive_a"), F.when(F.col("figure"), "figure").otherwise("text").alias("mark_type")
    )
    none = F.lit(None).cast("double")
    steps = [("base", "x2_whole", none, none, F.lit(IMAGE_FLOOR), none), ("base", "x4", none, none, none, F.lit(GOODS_FLOOR))]
    for v in (0.0, 1.0):
        steps += [("x2_whole", "x2_whole+x4", F.lit(v), none, F.lit(v), F.lit(GOODS_FLOOR)), ("x4", "x2_whole+x4", none, F.lit(v), F.lit(IMAGE_FLOOR), F.lit(v))]
    found = None
    for low, high, a2, a4, b2, b4 in steps:
        keys = ["x1_d", "x2_text_d", "x3_d", "has_distinctive_b", "figure"]
        less = score(base.withColumns({"x2_whole": a2, "x4": a4})).select(*keys, F.col("logit").alias("low"))
        more = score(base.withColumns({"x2_whole": b2, "x4": b4})).select(*keys, F.col("logit").alias("high"))
        part = less.join(more, keys).select(*keys, F.lit(low).alias("lower"), F.lit(high).alias("upper"), "low", "high")
        found = part if found is None else found.unionByName(part)
    return found
