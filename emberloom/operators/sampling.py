"""Deterministic sampling and splitting: orders come from md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *key: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]))


def fold_of(seed: int, folds: int, key: Column | str) -> Column:
    """Fold of a group, from the first 8 hex digits of its draw."""
    return F.pmod(F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("bigint"), F.lit(folds))


def largest_remainder(sizes: DataFrame, n: int, key: str) -> DataFrame:
    """sizes (key, size) -> quota: proportional, at least 1 per non-empty stratum, sums to n if it can.

    Strata are few (their count does not grow with the rows), so the order over
    them is one small window.
    """
    total = F.sum("size").over(Window.partitionBy())
    exact = F.col("size") * F.lit(n) / total
    floor = F.least(F.col("size"), F.greatest(F.lit(1), F.floor(exact))).cast("bigint")
    based = sizes.where("size > 0").select(key, "size", exact.alias("exact"), floor.alias("floor"), total.alias("total"))
    missing = F.least(F.lit(n), F.col("total")) - F.sum("floor").over(Window.partitionBy())
    open_ = F.col("floor") < F.col("size")
    place = F.row_number().over(Window.orderBy(open_.desc(), (F.col("exact") - F.floor("exact")).desc(), F.col(key)))
    over = F.row_number().over(Window.orderBy(F.desc("floor"), F.col(key)))
    change = F.when((missing > 0) & open_ & (place <= missing), 1).when((missing < 0) & (F.col("floor") > 1) & (over <= -missing), -1).otherwise(0)
    return based.select(key, "size", (F.col("floor") + change).alias("quota"))


def stratified(rows: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """The quota's rows of each stratum, first by draw; quotas (stratum, quota) is a small table."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, key), key))
    most = quotas.agg(F.max("quota")).first()[0] or 0
    # the constant bound lets each task drop what cannot be drawn before the shuffle
    return rows.withColumn("place", place).where(F.col("place") <= most).join(F.broadcast(quotas.select(stratum, "quota")), stratum).where("place <= quota")


def modal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The commonest value of each group, of equally common ones the first."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    least = counted.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value"))).alias("best"))
    return least.select(group, F.col("best.value").alias("modal"), (-F.col("best.less")).alias("n"))


def random_pairs(left: DataFrame, l_key: str, right: DataFrame, r_key: str, n: int, seed: int = 0) -> DataFrame:
    """n pairs of different keys: both sides in draw order, each left row with the right row some places on.

    Rows are matched by their place, an equi-join; no product is formed.
    """
    def placed(df: DataFrame, key: str, name: str, salt: int) -> DataFrame:
        first = df.select(F.col(key).alias(name), draw(seed + salt, key).alias("d")).orderBy("d", name).limit(n)
        return first.withColumn("place", F.row_number().over(Window.orderBy("d", name))).drop("d")

    pairs = placed(left, l_key, "left_key", 0).join(placed(right, r_key, "right_key", 1), "place")
    return pairs.where("left_key <> right_key")
