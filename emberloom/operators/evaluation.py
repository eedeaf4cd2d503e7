"""Evaluation: rank metrics, calibration, thresholds. Global orders are taken over
distinct scores after aggregation, never over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which an order over all rows is cut.
BINS = 64


def prefix_sums(counts: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Adds below_<c>, the sum of c over rows of smaller order, and total_<c>; order is distinct in counts.

    No task sees all rows: they fall into BINS ranges at approximate
    quantiles, sums run within a range, and what lies before a range comes
    from a table of one row for each range.
    """
    cuts = counts.agg(F.percentile_approx(order, [k / BINS for k in range(1, BINS)], 1000).alias("_cuts"))
    placed = counts.crossJoin(F.broadcast(cuts)).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    sums = placed.groupBy("_bin").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    before, everything = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = sums.select(
        "_bin", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(f"_s_{c}").over(everything).alias(f"total_{c}") for c in columns]
    )
    within = Window.partitionBy("_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{c}") for c in columns])
    joined = own.join(F.broadcast(starts), "_bin")
    return joined.select(*counts.columns, *[(F.col(f"_b_{c}") + F.col(f"_w_{c}")).alias(f"below_{c}") for c in columns], *[f"total_{c}" for c in columns])


def _by(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def by_score(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """rows (keys, score, y in 0/1) -> weights of positives and negatives at each distinct score."""
    w = F.lit(1.0) if weight is None else weight
    known = rows.where("score is not null and not isnan(score) and y is not null")
    return known.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("neg"),
        F.sum(F.lit(1)).alias("n"),
    )


def auc(rows: DataFrame, keys: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Weighted area under the ROC curve, ties counting half; null if one class is missing."""
    keys = keys or []
    return auc_of_counts(by_score(rows, keys, weight), keys)


def auc_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """auc() from the weights of positives and negatives at each distinct score."""
    if keys:
        below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        steps = counts.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    else:
        steps = prefix_sums(counts, "score", ["neg"]).withColumnRenamed("below_neg", "below")
    area = F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg")))
    return steps.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), area / (F.sum("pos") * F.sum("neg"))).alias("auc"),
    )


def brier(p: Column, y: Column, weight: Column | None = None) -> Column:
    """Aggregate: mean squared difference of probability and outcome."""
    w = F.lit(1.0) if weight is None else weight
    return F.sum(w * F.pow(p - y, 2)) / F.sum(w)


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """rows (p, y): equal bins, the last closed, empty ones included."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint"))
    counted = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")


def from_top(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """At each distinct score: support, precision and recall of what scores at least as much."""
    keys = keys or []
    counts = by_score(rows, keys)
    if not keys:
        found = prefix_sums(counts, "score", ["n", "pos"])
        n, pos = (F.col(f"total_{c}") - F.col(f"below_{c}") for c in ("n", "pos"))
        return found.select("score", n.alias("support"), (pos / n).alias("precision"), (pos / F.col("total_pos")).alias("recall"))
    above = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    return counts.select(
        *keys,
        "score",
        F.sum("n").over(above).alias("support"),
        (F.sum("pos").over(above) / F.sum("n").over(above)).alias("precision"),
        (F.sum("pos").over(above) / F.sum("pos").over(everything)).alias("recall"),
    )


def precision_threshold(rows: DataFrame, target: float, support: int) -> DataFrame:
    """The smallest score from which precision reaches the target with enough support, and the best point."""
    frame = from_top(rows).where(F.col("support") >= support)
    good = F.col("precision") >= target
    return frame.agg(
        F.min(F.when(good, F.col("score"))).alias("threshold"),
        F.max_by("score", F.struct("precision", "support")).alias("best_score"),
        F.max("precision").alias("best_precision"),
    )


def grade_cuts(rows: DataFrame, precision: float = 0.8, support: int = 30, recall: float = 0.9) -> DataFrame:
    """Increasing cuts for caution, review and risk from (p as score, y) rows."""
    frame = from_top(rows)
    picked = frame.agg(
        F.min(F.when((F.col("support") >= support) & (F.col("precision") >= precision), F.col("score"))).alias("risk0"),
        F.max(F.when(F.col("recall") >= recall, F.col("score"))).alias("review0"),
    )
    review0 = F.coalesce("review0", F.lit(0.0))
    risk = F.coalesce("risk0", (review0 + 1) / 2)
    review = F.when(review0 >= risk, risk - 1e-6).otherwise(review0)
    rounded = picked.select(F.round(review / 2, 4).alias("c"), F.round(review, 4).alias("r"), F.round(risk, 4).alias("k"))
    up = rounded.withColumn("r", F.greatest("r", F.round(F.col("c") + 0.0001, 4)))
    return up.select(F.col("c").alias("caution"), F.col("r").alias("review"), F.greatest("k", F.round(F.col("r") + 0.0001, 4)).alias("risk"))


def grade_table(rows: DataFrame, grades: int = 4) -> DataFrame:
    """rows (grade, y): per grade its size, precision, and the recall of this grade or higher."""
    counted = rows.groupBy("grade").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    every = rows.sparkSession.range(grades).withColumnRenamed("id", "grade").join(counted, "grade", "left")
    above = Window.orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    pos = F.coalesce("pos", F.lit(0))
    return every.select(
        "grade",
        F.coalesce("n", F.lit(0)).alias("n"),
        pos.alias("pos"),
        (F.col("pos") / F.col("n")).alias("precision"),
        (F.sum(pos).over(above) / F.sum(pos).over(total)).alias("recall_from"),
    )


def threshold_grid(rows: DataFrame, taus: list[float]) -> DataFrame:
    """Precision, recall and support at fixed thresholds, in one pass over the rows."""
    cells = rows.select("y", F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), (F.col("score") >= t).alias("hit")) for t in taus])).alias("g"))
    return cells.groupBy(F.col("g.tau").alias("tau")).agg(
        F.count_if(F.col("g.hit")).alias("support"),
        (F.count_if(F.col("g.hit") & (F.col("y") == 1)) / F.nullif(F.count_if(F.col("g.hit")), F.lit(0))).alias("precision"),
        (F.count_if(F.col("g.hit") & (F.col("y") == 1)) / F.nullif(F.count_if(F.col("y") == 1), F.lit(0))).alias("recall"),
    )


def best_accuracy(rows: DataFrame) -> DataFrame:
    """The score cut of highest accuracy, of equal ones the lowest."""
    sums = prefix_sums(by_score(rows, []), "score", ["pos", "neg", "n"])
    scored = sums.select("score", (F.col("total_pos") - F.col("below_pos") + F.col("below_neg")).alias("right"), F.col("total_n").alias("total"))
    return scored.agg(F.max_by("score", F.struct("right", -F.col("score"))).alias("threshold"), (F.max("right") / F.first("total")).alias("accuracy"))


def average_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks of a column, from counts of its distinct values."""
    counts = prefix_sums(rows.groupBy(column).count(), column, ["count"])
    ranks = counts.select(column, (F.col("below_count") + (F.col("count") + 1) / 2).alias(name))
    return rows.join(ranks, column)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over rows where both are known."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(known, a, "ra"), b, "rb")
    return ranked.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("ra", "rb")).alias("rho"))


def z_scores(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(x - mean) / population deviation, 0 where that is 0; the two moments are one aggregated row."""
    moments = rows.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    z = F.when(F.col("_std") == 0, F.lit(0.0)).otherwise((F.col(column) - F.col("_mean")) / F.col("_std"))
    return rows.crossJoin(F.broadcast(moments)).withColumn(name, z).drop("_mean", "_std")


def quartiles(column: str) -> list[Column]:
    """Aggregates of a distribution summary, percentiles linear."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(column).alias("n"),
        F.round(F.avg(column), 4).alias("mean"),
        F.round(q[1], 4).alias("median"),
        F.round(q[0], 4).alias("q1"),
        F.round(q[2], 4).alias("q3"),
        F.round(F.min(column), 4).alias("low"),
        F.round(F.max(column), 4).alias("high"),
    ]


def case_weights(rows: DataFrame, case: str, cap: int = 3) -> DataFrame:
    """Each row's weight min(1, cap / rows of its case), by a count that is joined back."""
    counted = rows.groupBy(case).agg(F.count("*").alias("rows_in_case"))
    return rows.join(counted, case).withColumn("w", F.least(F.lit(1.0), F.lit(float(cap)) / F.col("rows_in_case")))


def replicate_weights(groups: DataFrame, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """(key, replicate, times): Poisson(1) bootstrap counts from a hash, equal on every run and engine.

    The first 13 hex digits of an md5 make a uniform number, cut at the Poisson quantiles.
    """
    each = groups.select(key).distinct().crossJoin(F.broadcast(groups.sparkSession.range(replicates).withColumnRenamed("id", "replicate")))
    text = F.md5(F.concat_ws(":", F.lit(seed), "replicate", F.col(key).cast("string")))
    u = F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / float(16**13)
    times = sum((u >= cut).cast("int") for cut in POISSON_CUTS)
    return each.withColumn("times", times)


#: Cumulative Poisson(1) probabilities of 0, 1, 2, ... 7.
POISSON_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253)


def bootstrap_auc(rows: DataFrame, case: str, replicates: int = 100, seed: int = 0) -> DataFrame:
    """Case-resampled AUCs: per replicate, those with both classes.

    Rows are counted by case and score first, so that not they but their distinct scores are replicated.
    """
    counts = by_score(rows, [case])
    times = replicate_weights(rows, case, replicates, seed).where("times > 0")
    each = counts.join(times, case).groupBy("replicate", "score")
    drawn = each.agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("pos", "neg", "n")])
    return auc_of_counts(drawn, ["replicate"]).where("auc is not null")


def interval(replicated: DataFrame, column: str = "auc") -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    return replicated.agg(F.count("*").alias("replicates"), q[0].alias("low"), q[1].alias("high"))


def matched_cuts(named: DataFrame, nameless: DataFrame, grades: int = 3) -> DataFrame:
    """Cuts for nameless scores that give as many rows of each grade or higher as the named grades do.

    named (grade), nameless (p, lifted: a rule already lifts the row to review).
    For grades below the highest the k-th largest p among rows not lifted, k
    less the lifted ones; for the highest the k-th largest of all; cut down to
    four digits, null where k is below 1.
    """
    spark = named.sparkSession
    wanted = spark.range(1, grades + 1).withColumnRenamed("id", "grade").join(
        named.select(F.col("grade").alias("g")), F.col("g") >= F.col("grade"), "left"
    ).groupBy("grade").agg(F.count("g").alias("k"))
    counts = nameless.groupBy("p").agg(F.count_if(~F.col("lifted")).alias("free"), F.count("*").alias("all"))
    sums = prefix_sums(counts, "p", ["free", "all"])
    placed = sums.select("p", *[(F.col(f"total_{c}") - F.col(f"below_{c}")).alias(c) for c in ("free", "all")])
    lifted = nameless.agg(F.count_if("lifted").alias("lifted"))
    cells = wanted.crossJoin(F.broadcast(lifted)).withColumn("need", F.when(F.col("grade") == grades, F.col("k")).otherwise(F.col("k") - F.col("lifted")))
    reached = F.when(F.col("grade") == grades, F.col("all")).otherwise(F.col("free")) >= F.col("need")
    found = cells.join(placed, reached & (F.col("need") >= 1), "left").groupBy("grade").agg(F.max("p").alias("cut"))
    return found.select("grade", (F.floor(F.col("cut") * 10000) / 10000).alias("cut"))


def slice_report(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """AUC of each grouping set of a long table, one aggregation per set; columns not in a set are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = None
    for s in sets:
        part = auc(rows, s).select(*[F.col(k) if k in s else F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys], "n", "pos", "neg", "auc")
        out = part if out is None else out.unionByName(part)
    return out


def retrieval_metrics(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ranked (keys, rank of the expected item or null, score, best_other): recalls, similarities and margins."""
    margin = F.col("score") - F.col("best_other")
    q = F.percentile("score", F.array(F.lit(0.1), F.lit(0.5)))
    return ranked.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("rank") <= 1, 1.0).otherwise(0.0)).alias("recall_1"),
        F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)).alias("recall_5"),
        F.avg("score").alias("mean_score"),
        q[1].alias("median_score"),
        q[0].alias("p10_score"),
        F.min("score").alias("min_score"),
        F.avg(margin).alias("mean_margin"),
        F.avg((margin > 0).cast("double")).alias("positive_margin"),
    )


def adopted(low: Column, baseline: Column, margin: float = -0.02) -> Column:
    """A change is adopted if its interval's lower end is not below the baseline by more than the margin."""
    return low - baseline >= margin
