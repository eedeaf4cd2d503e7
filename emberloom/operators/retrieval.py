"""Candidate retrieval: vector, phonetic, spelling and code paths, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.functions import strings
from emberloom.functions.vectors import dot

#: Queries compared with the whole table at once.
QUERY_BLOCK = 5_000
#: Keys of one code set that are expanded together, about.
CHUNK = 256
#: Pool sizes of the retrieval paths.
POOLS = {"image": 20, "phonetic": 20, "spelling": 20, "semantic": 5, "goods": 20}


def best(pairs: DataFrame, k: int, query: str, score: str, key: str) -> DataFrame:
    """The k best rows of each query by score, then key, with their rank.

    row_number below a constant becomes a group limit before the shuffle, so
    each task sends k rows of a query at most.
    """
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def against_all(queries: DataFrame, table: DataFrame, score: Column) -> DataFrame:
    """score of every (query, row), the queries broadcast in blocks of QUERY_BLOCK rows."""
    n = -(-queries.count() // QUERY_BLOCK)
    blocks = [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(n)) == k) for k in range(n)]
    parts = [table.crossJoin(F.broadcast(b)).withColumn("score", score) for b in blocks]
    return reduce(DataFrame.unionByName, parts)


def vector_topk(queries: DataFrame, marks: DataFrame, k: int = 20, digits: int = 6) -> DataFrame:
    """queries (query_id, q) and marks (id, v): the k nearest by inner product, rounded before ranking."""
    scored = against_all(queries, marks, F.round(dot("v", "q"), digits)).select("query_id", "id", "score")
    return best(scored, k, "query_id", "score", "id")


def phrase_topk(queries: DataFrame, marks: DataFrame, score: Column, k: int, least: float) -> DataFrame:
    """Top k above a least score for any pair score (phonetic, spelling, semantic)."""
    scored = against_all(queries, marks, score).where(F.col("score") >= least)
    return best(scored.select("query_id", "id", "score"), k, "query_id", "score", "id")


def shared_topk(scored: DataFrame, marks: DataFrame, k: int, query: str, value: str, score: str) -> DataFrame:
    """scored (query, value, score) and marks (id, value): the k best marks of each query, where a mark has its value's score.

    The k least ids of a value are all that it can bring, as ids decide between equal scores.
    """
    near = scored.withColumn("_r", F.rank().over(Window.partitionBy(query).orderBy(F.desc(score)))).where(F.col("_r") <= k).drop("_r")
    first = marks.withColumn("_n", F.row_number().over(Window.partitionBy(value).orderBy("id"))).where(F.col("_n") <= k).select("id", value)
    return best(near.join(first, value).drop(value), k, query, score, "id")


def name_topk(queries: DataFrame, marks: DataFrame, score: Column, k: int, least: float) -> DataFrame:
    """phrase_topk() of queries (query_id, q_name) and marks (id, name) for a score of the two names and what follows from them.

    Names repeat, so distinct ones are scored and ranked, and queries take the answer of their name; names that rank behind k
    others cannot bring a row.
    """
    scored = against_all(queries.drop("query_id").dropDuplicates(["q_name"]), marks.drop("id").dropDuplicates(["name"]), score).where(F.col("score") >= least)
    found = shared_topk(scored.select("q_name", "name", "score"), marks.select("id", "name"), k, "q_name", "name", "score")
    return queries.select("query_id", "q_name").join(found, "q_name").select("query_id", "id", "score", "rank")


def spelling_topk(queries: DataFrame, marks: DataFrame, k: int = 20) -> DataFrame:
    """queries (query_id, q_name) and marks (id, name)."""
    q = queries.withColumn("q_keys", strings.spelling_keys(strings.tokens(F.col("q_name"))))
    m = marks.withColumn("keys", strings.spelling_keys(strings.tokens(F.col("name"))))
    return name_topk(q, m, F.round(strings.spelling_similarity(F.col("keys"), F.col("q_keys")), 4), k, 1e-9)


def postings(sets: DataFrame, key: str, codes: str) -> DataFrame:
    """(key, code, size): a code set table turned into posting rows."""
    own = F.array_distinct(F.col(codes))
    return sets.select(key, F.explode(own).alias("code"), F.size(own).alias("size"))


def overlaps(left: DataFrame, right: DataFrame, l_key: str, r_key: str) -> DataFrame:
    """Posting tables -> (l_key, r_key, both, jaccard) of all pairs that share a code."""
    pairs = left.withColumnRenamed("size", "l_size").join(right.withColumnRenamed("size", "r_size"), "code")
    counted = pairs.groupBy(l_key, r_key).agg(F.count("*").alias("both"), F.first("l_size").alias("l_size"), F.first("r_size").alias("r_size"))
    return counted.select(l_key, r_key, "both", F.round(F.col("both") / (F.col("l_size") + F.col("r_size") - F.col("both")), 4).alias("jaccard"))


def codes_topk(queries: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """queries (query_id, codes) and marks (id, codes): the k of each query that share codes, by jaccard; equal sets are compared once."""
    q = queries.select("query_id", F.array_sort(F.array_distinct("codes")).alias("q_set"))
    m = marks.select("id", F.array_sort(F.array_distinct("codes")).alias("m_set"))
    sides = [postings(x.select(c).distinct(), c, c) for x, c in ((q, "q_set"), (m, "m_set"))]
    found = shared_topk(overlaps(*sides, "q_set", "m_set"), m, k, "q_set", "m_set", "jaccard")
    return q.join(found, "q_set").select("query_id", "id", "both", "jaccard", "rank")


def pairs_within(sets: DataFrame, key: str, codes: str) -> DataFrame:
    """sets (key, codes; a key once) -> overlaps() of all pairs l_key < r_key that share a code.

    Keys with equal sets form a class: classes are compared, and a pair of
    classes becomes its pairs of keys at the end, chunk of keys by chunk of
    keys, dealt to all tasks whatever the size of a class.
    """
    own = sets.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.array_sort(F.array_distinct(F.col(codes))).alias("own")).where(F.size("own") > 0)
    classes = own.groupBy("own").agg(F.min("key").alias("class"), F.count("*").alias("n"))
    post = postings(classes, "class", "own")
    between = overlaps(post.withColumnRenamed("class", "l_class"), post.withColumnRenamed("class", "r_class"), "l_class", "r_class").where("l_class <= r_class")
    dealt = own.join(classes, "own").select("class", "key", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    chunks = dealt.groupBy("class", "chunk").agg(F.collect_list("key").alias("keys"))
    l, r = (chunks.select(*[F.col(c).alias(f"{side}_{c}") for c in chunks.columns]) for side in "lr")
    met = between.join(l, "l_class").join(r, "r_class").where("l_class < r_class or l_chunk <= r_chunk")
    spread = met.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l_class", "l_chunk", "r_class", "r_chunk")
    # the keys of two chunks of one class are met once, those of one chunk both ways
    each = spread.select("*", F.explode("l_keys").alias("a")).select("*", F.explode("r_keys").alias("b")).where("l_class < r_class or l_chunk < r_chunk or a < b")
    return each.select(F.least("a", "b").alias("l_key"), F.greatest("a", "b").alias("r_key"), "both", "jaccard")


def pool_union(pools: dict[str, DataFrame]) -> DataFrame:
    """Union of (query_id, id) pools: one row per pair with the names of its pools, in order."""
    tagged = [df.select("query_id", "id", F.lit(name).alias("source")) for name, df in pools.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def knn_codes(neighbours: DataFrame, codes: DataFrame, k: int, share: float = 0.4) -> DataFrame:
    """Codes that at least share of a query's neighbours have; those of the nearest if none has."""
    joined = neighbours.join(codes, "id")
    votes = joined.groupBy("query_id", "code").agg(F.count("*").alias("votes"))
    common = votes.where(F.col("votes") / k >= share).select("query_id", "code", "votes")
    nearest = joined.where("rank = 1").select("query_id", "code", F.lit(1).cast("bigint").alias("votes"))
    return common.unionByName(nearest.join(common.select("query_id").distinct(), "query_id", "left_anti"))


def tiered_search(entries: DataFrame, needle: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """entries (entry_id, name, aliases): hits by tier, names before aliases, then length and name.

    An alias stands for its entry only if its tier is strictly better than the
    name's, and of several matching aliases the first listed one counts.
    """
    n = F.lit(needle)
    own = strings.match_tier(F.col("name"), n)
    hits = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: strings.match_tier(a, n).isNotNull())
    alias = F.try_element_at(hits, F.lit(1))
    alias_tier = strings.match_tier(alias, n)
    via = F.coalesce(alias_tier < own, own.isNull())
    found = entries.withColumn("via_alias", via).withColumn("tier", F.when(via, alias_tier).otherwise(own)).where("tier is not null")
    ordered = found.orderBy("tier", "via_alias", F.char_length("name"), "name", "entry_id")
    page = ordered.offset(offset).limit(limit)
    return page.select("entry_id", "name", "tier", "via_alias")
