"""Corpus statistics, distinctiveness, audits and dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.functions import strings

#: Saturation points of owners and titles, word frequency range, least intrinsic score.
OWNERS, TITLES, ZIPF_LOW, ZIPF_RANGE = 10.0, 20.0, 3.0, 2.5


def token_stats(titles: DataFrame, least: int = 2) -> DataFrame:
    """titles (title, owner) -> token, a (distinct owners), n (titles); equal titles of an owner count once."""
    once = titles.select(F.lower("title").alias("title"), "owner").distinct()
    each = once.select("owner", F.explode(F.array_distinct(strings.tokens(F.col("title")))).alias("token")).where(F.char_length("token") >= 2)
    # owners are counted by two aggregations, so that a token in every title is combined before it moves
    per_owner = each.groupBy("token", "owner").agg(F.count("*").alias("titles"))
    return per_owner.groupBy("token").agg(F.count("owner").alias("a"), F.sum("titles").alias("n")).where(F.col("n") >= least)


def registration_factor(a: Column, n: Column) -> Column:
    """1 less the product of two saturating shares."""
    return 1 - F.least(F.lit(1.0), a / OWNERS) * F.least(F.lit(1.0), n / TITLES)


def intrinsic(zipf: Column) -> Column:
    """1 for rare words down to a half for common ones; unknown words are 1."""
    return F.coalesce(1 - 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (zipf - ZIPF_LOW) / ZIPF_RANGE)), F.lit(1.0))


def token_scores(stats: DataFrame, zipf: Column) -> DataFrame:
    return stats.withColumn("score", F.round(intrinsic(zipf) * registration_factor(F.col("a"), F.col("n")), 4))


def is_simple_mark(token: Column) -> Column:
    """Two Latin letters, two digits or one syllable at most."""
    return token.rlike("^(?:[a-z]{1,2}|[0-9]{1,2}|[가-힣])$")


def first_reason(*tests: tuple[str, Column]) -> Column:
    """Name of the first test that fails a row, null if none does."""
    out = None
    for name, failed in tests:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def histogram(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """Counts of a value, blank ones as 'unknown'."""
    return rows.groupBy(F.coalesce(strings.blank_to_null(column), F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"))


def keep_first(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds kept_by (the first row's order key) and duplicate; the first is an aggregate that is joined back."""
    firsts = rows.groupBy(*group).agg(F.min(order[0]).alias("kept_by"), F.count("*").alias("copies"))
    return rows.join(firsts, group).withColumn("duplicate", F.col(order[0]) != F.col("kept_by"))


def first_of_family(rows: DataFrame, family: str, order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(family).orderBy(*order))
    return rows.withColumn("place", place).withColumn("is_first", F.col("place") == 1)


def round_robin(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """One row per group in turn until there are n."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def carry_forward(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """The last known value so far."""
    sofar = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(sofar))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value, per column, in one pass."""
    shares = [F.round(F.count_if(strings.blank_to_null(F.col(c).cast("string")).isNotNull()) / F.count("*"), 4).alias(c) for c in columns]
    one = rows.agg(*shares)
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("column", "share"))


def duplicate_groups(rows: DataFrame, key: Column, name: str, member: str) -> DataFrame:
    """Values that several rows share: size and first member."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.min(member).alias("first_member")).where("n > 1")


def dense_histogram(rows: DataFrame, column: str, low: int, high: int, name: str) -> DataFrame:
    every = rows.sparkSession.range(low, high + 1).withColumnRenamed("id", name)
    counts = rows.groupBy(F.col(column).cast("bigint").alias(name)).agg(F.count("*").alias("n"))
    return every.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def collapse_same_codes(rows: DataFrame, name: str, size: int) -> DataFrame:
    """rows (name, suffix, codes): names of which all size suffixes have equal codes become one row with aliases."""
    agreed = rows.groupBy(name).agg(
        F.count_distinct("suffix").alias("suffixes"), F.count_distinct(F.array_sort("codes")).alias("kinds"), F.array_sort(F.collect_set("suffix")).alias("aliases"), F.first("codes").alias("codes")
    )
    return agreed.select(name, F.when((F.col("suffixes") == size) & (F.col("kinds") == 1), F.col("aliases")).otherwise(F.array().cast("array<string>")).alias("aliases"), "codes", "kinds")
