"""Selection: which records a run takes, in which order, and the lists people work through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.functions import codes, strings
from emberloom.operators.corpus import first_reason
from emberloom.operators.marks import registration_value
from emberloom.session import use_checkpoint_dir

#: Least frequency of an English word that may be a descriptive term, most selected goods.
ENGLISH_ZIPF, SELECTED = 3.0, 20


def screened(items: DataFrame, owner: Column, taken: DataFrame, number: str = "number") -> DataFrame:
    """Items with the first reason against them (null: a candidate): another owner, not registered, no figure code, no trademark number, taken already.

    Of items with the same number only the first (by pos) is judged.
    """
    clean = F.regexp_replace(F.coalesce(F.col(number), F.lit("")), "[^0-9]", "")
    seen = items.withColumn("_number", clean).join(taken.select(F.col(number).alias("_number"), F.lit(True).alias("_taken")).distinct(), "_number", "left")
    valid = strings.is_application_number(F.col(number))
    reason = first_reason(
        ("other_owner", ~owner), ("not_registered", F.coalesce(F.col("status"), F.lit("")) != "등록"), ("no_vienna", F.size(F.coalesce("vienna", F.array().cast("array<string>"))) == 0),
        ("bad_number", ~F.coalesce(valid, F.lit(False))), ("taken", F.col("_taken").isNotNull()),
    )
    judged = seen.withColumn("reason", reason)
    kept = judged.groupBy("_number").agg(F.min(F.when(F.col("reason").isNull() | (F.col("reason") == "taken"), F.col("pos"))).alias("_first"))
    joined = judged.join(kept, "_number")
    repeat = (F.col("reason").isNull() | (F.col("reason") == "taken")) & (F.col("pos") > F.col("_first"))
    return joined.withColumn("reason", F.when(repeat, "duplicate").otherwise(F.col("reason"))).drop("_number", "_taken", "_first")


def selection_order(brand: Column, classes: list[int]) -> list[Column]:
    """Order of choice: brand in the title, registered, with figure codes, of a wanted class, latest registration, number."""
    wanted = F.arrays_overlap(F.coalesce("classes", F.array().cast("array<int>")), F.array(*[F.lit(c) for c in classes]))
    return [
        strings.brand_in_title(F.coalesce("title", F.lit("")), brand).desc(), (F.col("status") == "등록").desc(), (F.size("vienna") > 0).desc(), wanted.desc(),
        registration_value(F.col("registered")).desc(), F.col("number"),
    ]


def greedy_plan(candidates: DataFrame, brand: str, place: str, item: str, most: int) -> DataFrame:
    """candidates (brand, place of the brand, rank of the item with it, item) -> at most `most` items a brand, brands served in order, an item once.

    Brands offer for their best items, an item stays with the first brand that
    offers, and refused brands offer for their next ones until none is refused:
    the same plan as serving one brand after the other, in few rounds.
    """
    use_checkpoint_dir(candidates.sparkSession)
    open_ = candidates.select(brand, place, "rank", item).checkpoint()
    best = Window.partitionBy(brand).orderBy("rank")
    while True:
        offers = open_.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= most).drop("_k").checkpoint()
        held = offers.groupBy(item).agg(F.min(place).alias("_first"))
        refused = offers.join(held, item).where(F.col(place) > F.col("_first")).select(brand, item)
        if refused.limit(1).count() == 0:
            return offers
        open_ = open_.join(refused, [brand, item], "left_anti").checkpoint()


def backfill_targets(records: DataFrame, attempted: DataFrame, key: str, classes: list[int], rest: bool) -> DataFrame:
    """Records without codes that were not asked for yet, with the place of their first class in a priority list (others last, if wanted)."""
    rank = F.array_min(F.filter(F.transform("classes", lambda c: F.array_position(F.array(*[F.lit(x) for x in classes]), c) - 1), lambda k: k >= 0))
    blank = F.size(F.coalesce("codes", F.array().cast("array<string>"))) <= 0
    found = records.where(blank).join(attempted.select(key), key, "left_anti").withColumn("rank", F.coalesce(rank, F.lit(len(classes))).cast("int"))
    return found if rest else found.where(F.col("rank") < len(classes))


def judged_candidates(tokens: DataFrame, judgements: DataFrame) -> DataFrame:
    """tokens (token, zipf) with a verdict: that of the judgement (token, verdict), held back for numbers without one, left out otherwise; rare English words are left out anyway."""
    t = F.col("token")
    hangul, digits = t.rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]"), t.rlike("^[0-9]+$")
    rare = ~hangul & ~digits & (F.coalesce("zipf", F.lit(0.0)) < ENGLISH_ZIPF)
    joined = tokens.join(judgements.select("token", F.col("verdict").alias("_v")), "token", "left")
    verdict = F.when(rare, "제외").when(F.col("_v").isNotNull(), F.col("_v")).when(digits, "보류").otherwise("제외")
    return joined.select("token", "zipf", (~rare).alias("eligible"), verdict.alias("verdict"), F.col("_v").isNotNull().alias("judged"))


def review_tokens(stats: DataFrame, n: int) -> DataFrame:
    """The n tokens that stand in most titles, then of most owners, then by name."""
    return stats.orderBy(F.desc("n"), F.desc("a"), "token").limit(n)


def examples(titles: DataFrame, n: int = 3) -> DataFrame:
    """titles (pos, title) -> token and its first n titles that differ beyond case; a token's titles are cut down before they move."""
    each = titles.select("pos", "title", F.explode(F.array_distinct(strings.tokens(F.col("title")))).alias("token"))
    first = each.groupBy("token", F.lower("title").alias("_k")).agg(F.min(F.struct("pos", "title")).alias("f"))
    place = F.row_number().over(Window.partitionBy("token").orderBy("f"))
    kept = first.withColumn("place", place).where(F.col("place") <= n)
    return kept.groupBy("token").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["title"]).alias("examples"))


def class_evidence(tokens: DataFrame, goods: DataFrame, top: int = 3) -> DataFrame:
    """tokens (token) -> the classes of most goods (goods_name, nice_class) that name it: Hangul tokens as part of the joined name, others as a token.

    Parts of a name are made by the name, so that both ways are equi-joins.
    """
    t = goods.select("goods_name", "nice_class", strings.tokens(F.col("goods_name")).alias("ts")).withColumn("joined", F.array_join("ts", ""))
    lengths = F.sequence(F.lit(1), F.least(F.char_length("joined"), F.lit(20)))
    parts = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.char_length("joined") - n + 1), lambda i: F.substr("joined", i, n))))
    within = F.filter(F.when(F.char_length("joined") > 0, parts).otherwise(F.array().cast("array<string>")), lambda p: p.rlike("^[가-힣ㄱ-ㅎㅏ-ㅣ]+$"))
    named = F.array_distinct(F.concat(F.filter("ts", lambda x: ~x.rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]")), within))
    each = t.select("nice_class", F.explode(named).alias("token")).join(tokens.select("token").distinct(), "token", "left_semi")
    counted = each.groupBy("token", "nice_class").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "nice_class"))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def same_name_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """queries (query_id, name), candidates (query_id, id, title): pairs of equal name, each once."""
    key = strings.letters_and_digits
    joined = candidates.join(queries.select("query_id", key(F.col("name")).alias("_k")), "query_id").where((F.col("_k") != "") & (key(F.col("title")) == F.col("_k")))
    return joined.select("query_id", "id").distinct()


def owner_groups(rows: DataFrame, alias: DataFrame, column: str) -> DataFrame:
    """Adds owners: the '|'-separated owners as normal names, each by the representative that alias (name, representative) gives it."""
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.explode_outer(F.split(column, r"\|")).alias("o")).withColumn("_k", strings.owner_key(F.col("o")))
    known = alias.select(strings.owner_key(F.col("name")).alias("_k"), strings.owner_key(F.col("representative")).alias("_to")).dropDuplicates(["_k"])
    named = each.join(known, "_k", "left").select("_row", F.coalesce("_to", "_k").alias("k")).where("k <> ''")
    sets = named.groupBy("_row").agg(F.array_sort(F.collect_set("k")).alias("owners"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return numbered.join(sets, "_row", "left").drop("_row").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))


def with_local(items: DataFrame, local: DataFrame, number: str, columns: list[str]) -> DataFrame:
    """Foreign items with columns of the local record of the same number, whatever its hyphens."""
    digits = F.regexp_replace(F.coalesce(F.col(number), F.lit("")), "[^0-9]", "")
    own = local.select(digits.alias("_n"), *[F.col(c).alias(f"local_{c}") for c in columns]).where("_n <> ''").dropDuplicates(["_n"])
    return items.withColumn("_n", digits).join(own, "_n", "left").drop("_n")


def name_order(entries: DataFrame, name: str, group: str) -> DataFrame:
    """Place of each entry in its group by length of the name, then name."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.char_length(name), name)))


def selected_goods(picks: DataFrame) -> DataFrame:
    """picks (basket, pos, goods_name, nice_class, codes) -> what a basket takes: first of each name and class, SELECTED at most, with what became of every pick."""
    state = picks.groupBy("basket", "goods_name", "nice_class").agg(F.min("pos").alias("_first"))
    joined = picks.join(state, ["basket", "goods_name", "nice_class"])
    fresh = joined.where("pos = _first").withColumn("_k", F.row_number().over(Window.partitionBy("basket").orderBy("pos"))).select("basket", "pos", "_k")
    placed = joined.join(fresh, ["basket", "pos"], "left")
    return placed.select("basket", "pos", "goods_name", "nice_class", "codes", F.when(F.col("_k").isNull(), "duplicate").when(F.col("_k") > SELECTED, "limit").otherwise("added").alias("state"))


def goods_union(picked: DataFrame) -> DataFrame:
    """Codes of a basket's added goods, valid ones in order."""
    added = picked.where("state = 'added'").select("basket", F.explode(codes.clean_codes(F.col("codes"))).alias("code"))
    return added.groupBy("basket").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def review_queue(rows: DataFrame, key: list[str], done: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows that a reason asks to review, with all their reasons, and the done mark of an earlier queue by key."""
    why = F.concat_ws(";", *[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in reasons.items()])
    asked = rows.withColumn("reasons", why).where("reasons <> ''")
    return asked.join(done.select(*key, "done"), key, "left").select(*key, "reasons", F.coalesce("done", F.lit("")).alias("done"))


def case_queries(rows: DataFrame, case: str, name: str, codes_col: str, number: str) -> DataFrame:
    """One query for each case: its commonest name (of equal ones the first), the union of its codes, its numbers."""
    named = rows.where(strings.blank_to_null(F.col(name)).isNotNull()).groupBy(case, name).agg(F.count("*").alias("n"))
    modal = named.groupBy(case).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(name).alias("v"))).alias("m")).select(case, F.col("m.v").alias(name))
    code = rows.select(case, F.explode_outer(codes_col).alias("c")).groupBy(case).agg(F.array_sort(F.collect_set("c")).alias("codes"))
    numbers = rows.groupBy(case).agg(F.array_sort(F.collect_set(number)).alias("numbers"))
    return numbers.join(code, case).join(modal, case, "left")


def goods_violations(goods: DataFrame) -> DataFrame:
    """goods (goods_name, nice_class, codes, aliases): what is wrong with a row: no name, class, code, an alias that is a name, a name twice in a class."""
    bad_code = F.exists("codes", lambda c: ~c.rlike("^[GS][0-9]{4,6}$"))
    own = goods.withColumn("_id", F.monotonically_increasing_id())
    simple = own.select(
        "_id", F.explode(F.array_compact(F.array(
            F.when(F.coalesce(F.trim("goods_name"), F.lit("")) == "", F.lit("no_name")), F.when(~F.coalesce(F.col("nice_class").between(1, 45), F.lit(False)), F.lit("bad_class")),
            F.when(F.coalesce(bad_code, F.lit(False)) | (F.size("codes") <= 0), F.lit("bad_code")),
        ))).alias("problem"),
    )
    alias = own.select("_id", F.explode("aliases").alias("alias")).join(goods.select(F.col("goods_name").alias("alias")).distinct(), "alias", "left_semi").select("_id", F.lit("alias_is_name").alias("problem"))
    twice = own.groupBy("goods_name", "nice_class").agg(F.count("*").alias("n")).where("n > 1")
    again = own.join(twice, ["goods_name", "nice_class"]).select("_id", F.lit("twice").alias("problem"))
    found = simple.unionByName(alias).unionByName(again).distinct()
    return found.join(own.select("_id", "goods_name", "nice_class"), "_id").select("goods_name", "nice_class", "problem")


def term_violations(terms: DataFrame, kinds: list[str]) -> DataFrame:
    """Descriptive terms (token, kind, classes, verdict) that are not valid: unknown kind, class out of range, token not in normal form; rejected ones are not looked at."""
    normal = F.array_join(strings.tokens(F.col("token")), "") == F.col("token")
    problem = F.when(~F.col("kind").isin(*kinds), "unknown_kind").when(F.exists("classes", lambda c: ~c.between(1, 45)), "bad_class").when(~F.coalesce(normal, F.lit(False)), "not_normal")
    return terms.where(F.coalesce(F.col("verdict"), F.lit("")) != "제외").withColumn("problem", problem).where("problem is not null").select("token", "problem")
