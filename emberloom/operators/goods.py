"""Goods names: presets, splitting of goods texts, matching to the map, name checks, ordered dedupe."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberloom.functions import codes, strings

#: Share of common tokens for a fuzzy match, and presets shown.
FUZZY, PRESETS = 0.8, 3


def goods_key(c):
    return F.regexp_replace(F.lower(c), r"[\s\p{P}\p{S}]", "")


def preset_match(presets: DataFrame, needle: str, most: int = PRESETS) -> DataFrame:
    """presets (pos, label, aliases): those with the needle in a label or alias, in file order."""
    n = strings.squeeze(F.lit(needle))
    terms = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return presets.where((n != "") & F.exists(terms, lambda t: F.contains(strings.squeeze(t), n))).orderBy("pos").limit(most)


def split_goods_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A goods text cut at its delimiters; a class marker ("제9류", "class 9") holds until the next one."""
    parts = rows.select(key, F.posexplode(F.split(text, r"[;,\n]")).alias("pos", "part"))
    marker = F.coalesce(F.nullif(F.regexp_extract("part", r"(?:제\s*(\d{1,2})\s*류)", 1), F.lit("")), F.nullif(F.regexp_extract(F.lower("part"), r"(?:class\s*(\d{1,2}))", 1), F.lit("")))
    marked = parts.withColumn("nice_class", F.last(marker.cast("int"), ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")))
    name = F.trim(F.regexp_replace("part", r"(?i)제\s*\d{1,2}\s*류\s*:?|class\s*\d{1,2}\s*:?", ""))
    return marked.select(key, "pos", "nice_class", name.alias("name")).where("name <> ''")


def match_goods(items: DataFrame, goods_map: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """items (item, nice_class, name) to goods_map (name, nice_class, codes); the first step that hits counts.

    Steps: exact in the class, key in the class, key in any class, key without a
    suffix, tokens with a Jaccard of FUZZY or more in the class. Adds codes and method.
    """
    g = goods_map.select("name", "nice_class", "codes", goods_key(F.col("name")).alias("key"))
    q = items.withColumn("key", goods_key(F.col("name")))
    exact = g.groupBy("name", "nice_class").agg(codes.union_of(F.col("codes")).alias("c1"))
    in_class = g.groupBy("key", "nice_class").agg(codes.union_of(F.col("codes")).alias("c2"))
    any_class = g.groupBy("key").agg(codes.union_of(F.col("codes")).alias("c3"))
    stem = F.col("key")
    for s in suffixes:
        stem = F.when(F.col("key").endswith(s) & (F.char_length("key") >= len(s) + 2), F.expr(f"left(key, char_length(key) - {len(s)})")).otherwise(stem)
    q = q.withColumn("stem", stem)
    joined = q.join(exact, ["name", "nice_class"], "left").join(in_class, ["key", "nice_class"], "left").join(any_class, "key", "left")
    joined = joined.join(any_class.select(F.col("key").alias("stem"), F.col("c3").alias("c4")), "stem", "left")
    open_ = joined.where("c1 is null and c2 is null and c3 is null and c4 is null").select("item", "nice_class", strings.tokens(F.col("name")).alias("t")).where(F.size("t") >= 2)
    left = open_.select("item", "nice_class", F.size(F.array_distinct("t")).alias("n"), F.explode(F.array_distinct("t")).alias("token"))
    right = g.select("name", "nice_class", "codes", strings.tokens(F.col("name")).alias("t")).select("name", "nice_class", "codes", F.size(F.array_distinct("t")).alias("m"), F.explode(F.array_distinct("t")).alias("token"))
    shared = left.join(right, ["token", "nice_class"]).groupBy("item", "name", "n", "m").agg(F.count("*").alias("both"), F.first("codes").alias("codes"))
    near = shared.withColumn("j", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).where(F.col("j") >= FUZZY)
    fuzzy = near.groupBy("item").agg(F.min_by("codes", F.struct((-F.col("j")).alias("less"), "name")).alias("c5"))
    found = joined.join(fuzzy, "item", "left")
    steps = ["exact", "key_in_class", "key", "suffix", "tokens"]
    method = F.coalesce(*[F.when(F.col(f"c{k}").isNotNull(), name) for k, name in enumerate(steps, 1)])
    return found.select("item", "nice_class", "name", F.coalesce(*[F.col(f"c{k}") for k in range(1, 6)]).alias("codes"), method.alias("method"))


def name_summary(items: DataFrame, query: str, total: int | None = None, complete: bool | None = None) -> DataFrame:
    """items (title, status): counts of a name check and its state."""
    same = strings.squeeze(F.col("title")) == strings.squeeze(F.lit(query))
    registered = F.col("status") == "registered"
    s = items.agg(F.count("*").alias("scanned"), F.count_if(same).alias("exact"), F.count_if(same & registered).alias("exact_registered"), F.count_if(registered).alias("registered"))
    whole = F.lit(complete) if complete is not None else F.lit(True) if total is None else F.col("scanned") >= total
    state = (
        F.when(F.col("exact_registered") > 0, "exact_registered").when(F.col("exact") > 0, "exact_other").when(~whole, "incomplete").when(F.col("scanned") > 0, "similar_only").otherwise("none")
    )
    return s.select("*", whole.alias("complete"), state.alias("state"))


def check_priority(items: DataFrame, query: str) -> DataFrame:
    """items (pos, title, status) in order: exact and registered, exact, registered, the rest."""
    same = F.coalesce(strings.squeeze(F.col("title")) == strings.squeeze(F.lit(query)), F.lit(False))
    registered = F.coalesce(F.col("status") == "registered", F.lit(False))
    return items.orderBy(F.when(same & registered, 0).when(same, 1).when(registered, 2).otherwise(3), "pos")


def dedupe_plan(rows: DataFrame, group: list[str], order: str, compared: list[str]) -> DataFrame:
    """Adds kept (order value of the row that stands for this one) and unverified (columns blank on one side).

    Rows of a group are taken in order; a row falls to the first kept row from
    which it differs in no column that both have. Rows are told apart by first
    collapsing equal ones, so a group holds its distinct rows only.
    """
    names = [*group, *compared]
    firsts = rows.groupBy(*names).agg(F.min(order).alias(order))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        out = []
        for r in pdf.sort_values(order).itertuples(index=False):
            row = r._asdict()
            hit = None
            for k in kept:
                if all(not (row[c] and k[c] and row[c] != k[c]) for c in compared):
                    hit = k
                    break
            if hit is None:
                kept.append(row)
                out.append((*(row[c] for c in names), row[order], ""))
            else:
                out.append((*(row[c] for c in names), hit[order], ";".join(c for c in compared if bool(row[c]) != bool(hit[c]))))
        return pd.DataFrame(out, columns=[*names, "kept", "unverified"])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), f"kept {rows.schema[order].dataType.simpleString()}", "unverified string"])
    found = firsts.groupBy(*group).applyInPandas(plan, schema)
    a, b = rows.alias("a"), found.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return a.join(b, on, "left").select("a.*", "b.kept", "b.unverified")
