"""Reports: sensitivity, effects of gates and of distinctiveness, pools, shuffled baselines, checks of a fitted model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.operators import evaluation, risk
from emberloom.operators.corpus import intrinsic
from emberloom.operators.sampling import draw


def sensitivity(stats: DataFrame, thetas_a: list[float], thetas_n: list[float], cuts: list[float], legal: str = "legal", zipf: str = "zipf") -> DataFrame:
    """stats (token, a, n, legal flag, zipf): for each pair of saturation points and each cut, how many tokens are weak, and how many of those by law."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("theta_a"), F.lit(float(n)).alias("theta_n"), F.lit(float(t)).alias("theta")) for a in thetas_a for n in thetas_n for t in cuts])
    cells = stats.select("a", "n", F.coalesce(legal, F.lit(False)).alias("legal"), zipf, F.explode(grid).alias("g"))
    factor = 1 - F.least(F.lit(1.0), F.col("a") / F.col("g.theta_a")) * F.least(F.lit(1.0), F.col("n") / F.col("g.theta_n"))
    score = F.when(F.col("legal"), 0.0).otherwise(F.round(intrinsic(F.col(zipf)) * factor, 4))
    weak = score < F.col("g.theta")
    return cells.groupBy("g.theta_a", "g.theta_n", "g.theta").agg(
        F.count_if(weak).alias("weak"), F.count_if(weak & F.col("legal")).alias("by_law"), F.count_if(weak & ~F.col("legal")).alias("by_count")
    )


def owners(rows: DataFrame, column: str) -> DataFrame:
    """Owners of '|'-separated lists, most frequent first (place)."""
    each = rows.select(F.explode(F.split(column, r"\|")).alias("o")).select(F.trim("o").alias("owner")).where("owner <> ''")
    return each.groupBy("owner").agg(F.count("*").alias("n"))


def set_quality(rows: DataFrame) -> DataFrame:
    """rows (estimated, actual arrays): how well sets are estimated, over rows with an actual set."""
    known = rows.where(F.size("actual") > 0)
    both, union = F.size(F.array_intersect("estimated", "actual")), F.size(F.array_union("estimated", "actual"))
    a, e = F.size(F.array_distinct("actual")), F.size(F.array_distinct("estimated"))
    return known.agg(
        F.count("*").alias("n"),
        F.avg(F.when(e > 0, both / union).otherwise(0.0)).alias("mean_jaccard"),
        F.avg((both > 0).cast("double")).alias("hit_rate"),
        (F.sum(both) / F.nullif(F.sum(e), F.lit(0))).alias("precision"),
        (F.sum(both) / F.nullif(F.sum(a), F.lit(0))).alias("recall"),
        F.avg(e).alias("mean_estimated"),
        F.avg(a).alias("mean_actual"),
    )


def floor_means(rows: DataFrame, axes: list[str]) -> DataFrame:
    """rows (y, easy, axes): for each axis the mean of easy dissimilar pairs, else of the other dissimilar ones, else 0, and which it is."""
    def mean(axis: str, easy: bool) -> Column:
        return F.avg(F.when((F.col("y") == 0) & (F.col("easy") == F.lit(easy)), F.col(axis)))

    one = rows.agg(*[mean(a, e).alias(f"{a}_{e}") for a in axes for e in (True, False)])
    each = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_True").alias("easy"), F.col(f"{a}_False").alias("other")) for a in axes])
    long = one.select(F.explode(each).alias("x")).select("x.*")
    basis = F.when(F.col("easy").isNotNull(), "easy").when(F.col("other").isNotNull(), "other").otherwise("none")
    return long.select("axis", F.round(F.coalesce("easy", "other", F.lit(0.0)), 4).alias("floor"), basis.alias("basis"))


def pattern_support(rows: DataFrame, axes: list[str], least: int = 50) -> DataFrame:
    """rows (y, axes): for each set of axes the rows that have observed all of it, by outcome, and whether both outcomes have enough."""
    subsets = [[a for k, a in enumerate(axes) if bits >> k & 1] for bits in range(1 << len(axes))]
    hits = F.array_compact(F.array(*[F.when(reduce(lambda x, a: x & F.col(a).isNotNull(), s, F.lit(True)), F.lit("+".join(s) or "base")) for s in subsets]))
    counted = rows.select("y", F.explode(hits).alias("pattern")).groupBy("pattern")
    found = counted.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return found.withColumn("feasible", F.least("pos", "neg") >= least)


def readiness(pairs: DataFrame, expected: dict[str, int], least: dict[str, int], classes: list[str], unsure: str = "cannot_assess", most_unsure: float = 0.1) -> DataFrame:
    """pairs (split, label, confidence, annotator): per split what is missing before labels may train a model, and whether nothing is."""
    spark = pairs.sparkSession
    blank = F.coalesce(F.trim("annotator"), F.lit("")) == ""
    counted = pairs.groupBy("split").agg(
        F.count("*").alias("pairs"), F.count("label").alias("labelled"), F.count_if(F.col("label") == unsure).alias("unsure"),
        F.count_if(F.col("confidence").isNull()).alias("no_confidence"), F.count_if(blank).alias("no_annotator"),
        *[F.count_if(F.col("label") == c).alias(f"c_{k}") for k, c in enumerate(classes)],
    )
    wanted = spark.createDataFrame([(s, n, least[s]) for s, n in expected.items()], "split string, expected bigint, least bigint")
    joined = wanted.join(counted, "split", "left").na.fill(0)
    enough = reduce(lambda x, k: x & (F.col(f"c_{k}") >= F.col("least")), range(len(classes)), F.lit(True))
    share = F.col("unsure") / F.nullif(F.col("labelled"), F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("labelled") == 0, F.lit("zero_labels")).when(F.col("labelled") != F.col("expected"), F.lit("labels_incomplete")),
            F.when(F.col("no_confidence") > 0, F.lit("confidence_incomplete")),
            F.when(F.col("no_annotator") > 0, F.lit("annotator_incomplete")),
            F.when(share > most_unsure, F.lit("unsure_rate_exceeds_policy")),
            F.when(~enough, F.lit("class_minimum_not_met")),
        )
    )
    return joined.select("split", "pairs", "labelled", reasons.alias("reasons"), ((F.size(reasons) == 0) & (F.col("pairs") == F.col("expected"))).alias("ready"))


def effect(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows (y, before, after): pairs that were at 1 and stay there, and how many fell by how much, by outcome."""
    known = rows.where(F.col(before).isNotNull() & F.col(after).isNotNull() & F.col("y").isin(0, 1))
    one, fell = F.col(before) >= 0.9999, F.col(after) < F.col(before) - 1e-9
    return known.groupBy("y").agg(
        F.count("*").alias("n"), F.count_if(one).alias("at_one"), F.count_if(one & (F.col(after) >= 0.9999)).alias("still_at_one"),
        F.count_if(fell).alias("fell"), F.avg(F.when(fell, F.col(before) - F.col(after))).alias("mean_fall"),
    )


def gate_effect(rows: DataFrame, score: str, gates: list[str]) -> DataFrame:
    """rows (y, score, gate flags): AUC and medians of named pairs with a gate open on both sides and shut on one."""
    open_ = reduce(lambda x, g: x & F.coalesce(F.col(g), F.lit(False)), gates, F.lit(True))
    long = rows.where(F.col(score).isNotNull()).select(F.when(open_, "open").otherwise("shut").alias("gate"), F.col(score).alias("score"), "y")
    medians = long.groupBy("gate").agg(F.median(F.when(F.col("y") == 1, F.col("score"))).alias("median_similar"), F.median(F.when(F.col("y") == 0, F.col("score"))).alias("median_dissimilar"))
    return evaluation.auc(long, ["gate"]).join(medians, "gate")


def mined_readings(titles: DataFrame, reading: Column, likeness, low: float, high: float, least: int = 3) -> DataFrame:
    """titles (tokens array): Latin and Hangul tokens that stand together, counted, with the likeness of the Latin one's reading to the Hangul one.

    reading is an expression over a column "latin", likeness a function of two columns; distinct pairs alone are compared.
    """
    latin = F.filter("tokens", lambda t: t.rlike("^[a-z]+$") & (F.char_length(t) >= least))
    hangul = F.filter("tokens", lambda t: t.rlike("^[가-힣]+$"))
    own = titles.select(latin.alias("l"), hangul.alias("h")).where((F.size("l") > 0) & (F.size("h") > 0))
    pairs = own.select(F.explode("l").alias("latin"), "h").select("latin", F.explode("h").alias("hangul"))
    counted = pairs.groupBy("latin", "hangul").agg(F.count("*").alias("seen"))
    scored = counted.withColumn("reading", reading).withColumn("likeness", F.round(likeness(F.col("reading"), F.col("hangul")), 3))
    return scored.where((F.col("likeness") >= low) & (F.col("likeness") < high))


def problem_cases(rows: DataFrame) -> DataFrame:
    """rows (score, tokens_a, tokens_b): pairs at 1 by how their tokens differ: not at all, in blanks only, in part."""
    same = F.array_sort("tokens_a") == F.array_sort("tokens_b")
    kind = F.when(same, "same_tokens").when(F.array_join("tokens_a", "") == F.array_join("tokens_b", ""), "blanks_only").otherwise("shared_part")
    return rows.where(F.col("score") >= 1 - 1e-9).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def reading_quality(rows: DataFrame, likeness: str = "likeness") -> DataFrame:
    """How well names were read from images: mean likeness, exact ones, those of 0.8 or more, unread ones; null counts as 0."""
    x = F.coalesce(F.col(likeness), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(x), 3).alias("mean"), F.count_if(x >= 0.999).alias("exact"), F.count_if(x >= 0.8).alias("near"), F.count_if(x <= 0).alias("unread"))


def pool_summary(pools: DataFrame) -> DataFrame:
    """pools (sample, mode, query_id, id, title, reason, similarity): searches, candidates left, what was left out and why, similarities."""
    left = F.col("reason").isNull()
    per_query = pools.groupBy("sample", "mode", "query_id").agg(F.coalesce(F.max(F.when(left, F.col("similarity"))), F.lit(0.0)).alias("top"))
    tops = per_query.groupBy("sample", "mode").agg(F.count("*").alias("searches"), F.median("top").alias("median_top"))
    q = F.percentile(F.when(left, F.col("similarity")), F.array(F.lit(0.5), F.lit(0.9)))
    counts = pools.groupBy("sample", "mode").agg(
        F.count_if(left).alias("kept"), F.count_if(left & (F.coalesce(F.trim("title"), F.lit("")) == "")).alias("kept_nameless"),
        F.count_if(F.col("reason") == "self").alias("self"), F.count_if(F.col("reason") == "same_owner").alias("same_owner"), q[0].alias("median"), q[1].alias("p90"),
    )
    return tops.join(counts, ["sample", "mode"])


def slowest(rows: DataFrame, n: int) -> DataFrame:
    """rows (query_id, ms, stages map): the slowest requests and the stage that took longest."""
    longest = F.array_max(F.transform(F.map_entries("stages"), lambda e: F.struct(e["value"].alias("ms"), e["key"].alias("stage"))))
    return rows.select("query_id", "ms", longest["stage"].alias("longest_stage")).orderBy(F.desc("ms"), "query_id").limit(n)


def stage_medians(rows: DataFrame) -> DataFrame:
    return rows.select("mode", F.explode("stages").alias("stage", "ms")).groupBy("mode", "stage").agg(F.round(F.median("ms"), 1).alias("median_ms"))


def shuffled_auc(rows: DataFrame, key: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """AUC of labels dealt anew: mean, 5 and 95 percent of the rounds.

    In each round the rows of the smallest draws get the positives. Rounds are
    ordered each by itself; the rows of an evaluation are thousands.
    """
    pos = rows.agg(F.count_if(F.col("y") == 1).alias("_pos"))
    each = rows.select(key, "score").crossJoin(F.broadcast(rows.sparkSession.range(rounds).withColumnRenamed("id", "replicate"))).crossJoin(F.broadcast(pos))
    place = F.row_number().over(Window.partitionBy("replicate").orderBy(draw(seed, "replicate", key), key))
    dealt = each.withColumn("y", (place <= F.col("_pos")).cast("int")).drop("_pos")
    found = evaluation.auc(dealt, ["replicate"]).where("auc is not null")
    q = F.percentile("auc", F.array(F.lit(0.05), F.lit(0.95)))
    return found.agg(F.count("*").alias("rounds"), F.avg("auc").alias("mean"), q[0].alias("p5"), q[1].alias("p95"))


def metric_block(rows: DataFrame, case: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """rows (case, score, y): case-weighted AUC and Brier score with the bootstrap interval of the AUC, as one row."""
    weighted = evaluation.case_weights(rows, case)
    a = evaluation.auc(weighted, [], F.col("w")).select("n", "auc")
    b = weighted.agg(evaluation.brier(F.col("score"), F.col("y"), F.col("w")).alias("brier"))
    c = evaluation.interval(evaluation.bootstrap_auc(rows, case, replicates, seed)).select("low", "high")
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def baseline_scores(axes: list[str]) -> dict[str, Column]:
    """Columns to compare a model with: the largest and the mean of the axes observed, 0 if none is."""
    seen = F.array_compact(F.array(*[F.when(risk.observed(a), F.col(a)) for a in axes]))
    n = F.size(seen)
    return {"largest": F.coalesce(F.array_max(seen), F.lit(0.0)), "mean": F.when(n > 0, F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)}


def slopes(rows: DataFrame) -> DataFrame:
    """Mean change of the logit when an axis goes from 0 to 1, in the groups that precedent compares, and whether each comparison holds."""
    def slope(axis: str, mask: Column) -> DataFrame:
        own = rows.where(mask)
        values = [risk.score(own.withColumn(axis, F.lit(v))).agg(F.avg("logit").alias(f"l{k}")) for k, v in enumerate((0.0, 1.0))]
        return values[0].crossJoin(values[1]).select((F.col("l1") - F.col("l0")).alias("v"))

    figure = F.col("mark_type").isin(*risk.FIGURE_FAMILY)
    distinct = F.coalesce("has_distinctive_a", F.lit(True)) & F.coalesce("has_distinctive_b", F.lit(True))
    named = {
        "x1_text": slope("x1_d", ~figure), "x2_text": slope("x2_whole", ~figure), "x1_figure": slope("x1_d", figure), "x2_figure": slope("x2_whole", figure),
        "x4": slope("x4", F.lit(True)), "x1_without": slope("x1_d", ~distinct), "x1_with": slope("x1_d", distinct),
    }
    one = None
    for name, v in named.items():
        v = v.withColumnRenamed("v", name)
        one = v if one is None else one.crossJoin(v)
    return one.select(
        "*",
        (F.col("x1_text") > F.col("x2_text")).alias("sound_leads_in_text"),
        (F.col("x2_figure") > F.col("x1_figure")).alias("look_leads_in_figures"),
        (F.col("x4") > 0).alias("goods_raise"),
        (F.col("x1_without") < F.col("x1_with")).alias("sound_needs_distinctiveness"),
    )


def monotonicity(rows: DataFrame, floors: dict[str, float], tolerance: float = 1e-9) -> DataFrame:
    """For each axis that rows may lack: rows with it at its floor or above whose logit is lower than without it, and those below the floor."""
    parts = []
    for axis, floor in floors.items():
        own = rows.where(risk.observed(axis)).withColumn("_id", F.monotonically_increasing_id())
        own = own.withColumn("_value", F.col(axis))
        both = risk.score(own).select("_id", "_value", F.col("logit").alias("with_it")).join(
            risk.score(own.withColumn(axis, F.lit(None).cast("double"))).select("_id", F.col("logit").alias("without")), "_id"
        )
        delta, above = F.col("with_it") - F.col("without"), F.col("_value") >= floor
        parts.append(
            both.agg(
                F.lit(axis).alias("axis"), F.lit(floor).alias("floor"), F.count("*").alias("n"), F.count_if(above & (delta < -tolerance)).alias("violations"),
                F.count_if(~above & (delta < 0)).alias("lower_below_floor"), F.round(F.avg(F.when(above, delta)), 6).alias("mean_change"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def grade_distribution(variants: dict[str, DataFrame]) -> DataFrame:
    """Counts of each grade under several scored variants, one column a variant."""
    long = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("variant"), "grade") for name, df in variants.items()])
    return long.groupBy("grade").pivot("variant", list(variants)).agg(F.count(F.lit(1))).na.fill(0)


def cut_table(rows: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """rows (p, y): for each named cut, how many rows reach it and how many of those are similar."""
    each = F.array(*[F.struct(F.lit(n).alias("cut"), F.lit(float(v)).alias("at")) for n, v in cuts.items()])
    cells = rows.select("p", "y", F.explode(each).alias("c")).where(F.col("p") >= F.col("c.at"))
    counted = cells.groupBy(F.col("c.cut").alias("cut"), F.col("c.at").alias("at")).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("similar"))
    return counted.withColumn("precision", F.col("similar") / F.col("n"))


def monotone_violations(coefficients: dict[str, float], axes: dict[str, list[str]], tolerance: float = 1e-9) -> list[str]:
    """Axes, alone or with a set of their interaction terms, whose coefficients sum to less than 0."""
    out = []
    for axis, terms in axes.items():
        known = [t for t in terms if t in coefficients]
        for bits in range(1 << len(known)):
            own = [t for k, t in enumerate(known) if bits >> k & 1]
            total = coefficients.get(axis, 0.0) + sum(coefficients[t] for t in own)
            if axis in coefficients and total < -tolerance:
                out.append(" + ".join([axis, *own]))
    return out
