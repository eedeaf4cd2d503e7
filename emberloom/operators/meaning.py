"""The meaning axis: words by frequency, compounds, pluggable embedders, and what a search says about its limits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberloom.functions import phonetic, vectors
from emberloom.operators import risk

#: Least frequencies of a word and of a part, least letters, syllables of a part, endings of adnominal forms.
ZIPF_KO, ZIPF_EN, ZIPF_PART = 2.5, 3.0, 4.0
LETTERS_EN, PART_SYLLABLES = 3, 2
#: Fixed value: likeness from which text read from an image is a name.
READ_LIKENESS = 0.5
#: Syllables before and in a goods name at the end of a run.
SUFFIX_BEFORE, SUFFIX_SYLLABLES = 2, 2


def word_zipf(frequency: Column) -> Column:
    """log10 of occurrences in a billion words, 0 for an unknown word."""
    return F.when(frequency > 0, F.log10(frequency) + 9).otherwise(0.0)


def compound(token: str, zipf: Callable[[str], float], adnominal: frozenset[str] = frozenset()) -> tuple[str, str] | None:
    """The two words of a Korean token that is none itself: the split whose rarer part is commonest, the earliest of equal ones, else after an adnominal form."""
    if not token or not phonetic.is_syllable(token[0]) or len(token) <= PART_SYLLABLES or zipf(token) >= ZIPF_KO:
        return None

    def stem(part: str) -> float:
        found = [zipf(part[:-1])] if len(part) > 1 and part[-1] in adnominal else []
        if part and phonetic.is_syllable(part[-1]) and phonetic.parts(part[-1])[2] in ("ㄴ", "ㄹ"):
            found.append(zipf(part[:-1] + phonetic.compose(*phonetic.parts(part[-1])[:2])))
        return max(found, default=0.0)

    splits = [(token[:k], token[k:]) for k in range(PART_SYLLABLES, len(token))]
    value = {s: (zipf(s[0]), stem(s[0]), zipf(s[1])) for s in splits}
    even = [(min(max(own, st if st >= ZIPF_PART else 0.0) if own < ZIPF_PART else own, right), -len(a)) for (a, b), (own, st, right) in value.items() if len(b) >= PART_SYLLABLES]
    best = max((e for e in even if e[0] >= ZIPF_PART), default=None)
    if best:
        return token[: -best[1]], token[-best[1] :]
    return next((s for s, (own, st, right) in value.items() if own < ZIPF_PART <= st and right >= ZIPF_PART), None)


def is_word(token: str, zipf: Callable[[str], float], single: frozenset[str] = frozenset(), adnominal: frozenset[str] = frozenset()) -> bool:
    """Whether a token is a word: by frequency, one syllable only by a closed list, or as a compound."""
    if re.fullmatch("[a-z]+", token):
        return len(token) >= LETTERS_EN and zipf(token) >= ZIPF_EN
    if not token or token.isdigit():
        return False
    if len(token) == 1:
        return token in single
    return zipf(token) >= ZIPF_KO or compound(token, zipf, adnominal) is not None


def has_meaning(names: DataFrame, name: str, words: DataFrame, single: frozenset[str] = frozenset(), adnominal: frozenset[str] = frozenset()) -> DataFrame:
    """Adds has_meaning: whether one of a name's tokens is a word by words (token, zipf).

    Distinct tokens and their parts are joined to the word table, which stays distributed; the rules run over what came back for each token.
    """
    distinct = names.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    each = distinct.select("_name", F.explode(phonetic.tokens_udf("_name")).alias("token")).distinct()
    tokens = each.select("token").distinct()
    looked = tokens.select("token", F.explode(_parts("token")).alias("part"))
    table = words.select(F.col("token").alias("part"), "zipf").groupBy("part").agg(F.max("zipf").alias("zipf"))
    known = looked.join(table, "part").groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("part", "zipf"))).alias("z"))

    @F.pandas_udf(T.BooleanType())
    def judge(tokens: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series([is_word(t, (lambda z: lambda p: z.get(p, 0.0))(dict(m) if m is not None else {}), single, adnominal) for t, m in zip(tokens, tables)])

    judged = tokens.join(known, "token", "left").select("token", judge("token", "z").alias("w"))
    meant = each.join(judged, "token").groupBy("_name").agg(F.max("w").alias("has_meaning"))
    return names.join(meant, F.col(name) == F.col("_name"), "left").drop("_name").withColumn("has_meaning", F.coalesce("has_meaning", F.lit(False)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(tokens: pd.Series) -> pd.Series:
    """A token, its beginnings and ends, and beginnings without a last sound: all that the rules may look up."""
    out = []
    for t in tokens:
        found = {t, *(t[:k] for k in range(1, len(t))), *(t[k:] for k in range(1, len(t)))} if phonetic.is_syllable(t[0]) else {t}
        found |= {p[:-1] + phonetic.compose(*phonetic.parts(p[-1])[:2]) for p in list(found) if phonetic.is_syllable(p[-1]) and phonetic.parts(p[-1])[2]}
        out.append(sorted(found))
    return pd.Series(out)


def split_suffix(name: str, goods: frozenset[str]) -> str:
    """The name with a blank before the longest goods name that ends a run of syllables."""
    def cut(run: re.Match) -> str:
        own = run[0]
        ends = [] if own in goods else [k for k in range(SUFFIX_BEFORE, len(own) - SUFFIX_SYLLABLES + 1) if own[k:] in goods]
        return f"{own[: ends[0]]} {own[ends[0] :]}" if ends else own

    return re.sub("[가-힣]{3,}", cut, name or "")


def split_suffixes(names: DataFrame, name: str, goods: DataFrame, out: str = "split") -> DataFrame:
    """Adds the name split by goods names (goods_name); ends of runs are joined to the goods names, so neither side is broadcast whole."""
    runs = names.select(F.col(name).alias("_name")).distinct().select("_name", F.explode(F.regexp_extract_all("_name", F.lit("([가-힣]{3,})"), F.lit(1))).alias("run"))
    ends = runs.select("_name", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("run") - 1), lambda k: F.substr("run", k, F.char_length("run")))).alias("end")).distinct()
    known = ends.join(goods.select(F.col("goods_name").alias("end")).distinct(), "end", "left_semi").groupBy("_name").agg(F.collect_set("end").alias("_goods"))

    @F.pandas_udf(T.StringType())
    def split(values: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([split_suffix(v, frozenset(g if g is not None else ())) for v, g in zip(values, found)])

    return names.join(known, F.col(name) == F.col("_name"), "left").withColumn(out, split(F.col(name), F.col("_goods"))).drop("_name", "_goods")


class Embedder:
    """What turns texts into unit vectors: a name, a dimension, a baseline, and a function from a list of texts to a matrix."""

    def __init__(self, name: str, dims: int, embed: Callable[[list[str]], np.ndarray], baseline: float = 0.0, prefix: str = ""):
        self.name, self.dims, self.embed, self.baseline, self.prefix = name, dims, embed, baseline, prefix


_EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hash": lambda: Embedder("hash", 256, lambda texts: np.array([phonetic.hash_embedding(t) for t in texts], np.float32).reshape(len(texts), 256))}


def register(name: str, make: Callable[[], Embedder]) -> None:
    """Make an embedder known; make() is called once in each worker, so that a model is loaded there."""
    _EMBEDDERS[name] = make


@lru_cache(maxsize=2)
def _loaded(make: Callable[[], Embedder]) -> Embedder:
    return make()


def embedded(texts: DataFrame, text: str, model: str = "hash", out: str = "vector", batch: int = 32) -> DataFrame:
    """Adds the vector of each text; distinct texts are embedded once, in batches."""
    if model not in _EMBEDDERS:
        raise ValueError(f"unknown embedder {model}")
    make = _EMBEDDERS[model]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _loaded(make)
        for part in parts:
            wanted = [own.prefix + (t or "") for t in part]
            rows = [own.embed(wanted[k : k + batch]) for k in range(0, len(wanted), batch)]
            yield pd.Series([v.tolist() for block in rows for v in block])

    distinct = texts.select(text).distinct()
    return texts.join(distinct.withColumn(out, run(text)), text, "left")


def semantic_topk(queries: DataFrame, marks: DataFrame, baseline: float, k: int = 5, least: float = 0.55) -> DataFrame:
    """queries (query_id, q) and marks (id, v) of unit vectors: the k likest by recalibrated cosine, at least `least`."""
    from emberloom.operators.retrieval import phrase_topk

    return phrase_topk(queries, marks, F.round(vectors.recalibrated(vectors.dot("v", "q"), baseline), 4), k, least)


def mean_view(views: Column) -> Column:
    """Views of one image (array of vectors): each to unit length, averaged, to unit length again."""
    units = F.transform(views, vectors.unit)
    total = vectors.let(units, lambda us: F.aggregate(F.slice(us, 2, F.size(us)), us[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y)))
    # the mean's length is what the last step divides by anyway
    return vectors.let(total, vectors.unit)


def best_term(rows: DataFrame, key: str, term: str, score: str) -> DataFrame:
    """Of each row's terms the likest, of equally like ones the first by name."""
    best = rows.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("less"), F.col(term).alias("t"))).alias("b"))
    return best.select(key, F.col("b.t").alias(term), (-F.col("b.less")).alias(score))


def read_matches(text: str | None, name: str | None) -> bool:
    """Whether text read from an image is a name or loosely one of its parts."""
    def fold(x: str) -> str:
        return re.sub(r"[^\w]|_", "", (x or "").casefold())

    box, whole = fold(text or ""), fold(name or "")
    if not box or not whole:
        return False
    if box in whole or (len(whole) >= 2 and whole in box):
        return True
    parts = [p for p in map(fold, re.split(r"[\s/·,()\[\]&+\-]+", name or "")) if p]
    return any(SequenceMatcher(None, box, p).ratio() >= READ_LIKENESS for p in [whole, *parts])


def nameless_floor(pairs: DataFrame, key: str) -> DataFrame:
    """goods_floor(), where a named judgement gives way to the nameless one of the same pair if that is graded strictly higher.

    Only for pairs whose flag nameless_floor is set: the user called the mark a figure and gave a name and an image.
    """
    named = risk.goods_floor(pairs, key)
    none = F.lit(None).cast("double")
    bare = pairs.where(F.coalesce("nameless_floor", F.lit(False)) & F.col("x2_whole").isNotNull())
    bare = bare.withColumns({"x1_d": none, "x2_text_d": none, "x3_d": none, "has_meaning_both": F.lit(False), "has_distinctive_a": F.lit(True), "has_distinctive_b": F.lit(True)})
    other = risk.goods_floor(bare, key).select(key, *[F.col(c).alias(f"_{c}") for c in ("grade", "p", "pattern", "rank_index", "rank_band")])
    both = named.join(other, key, "left")
    swap = F.coalesce(F.col("_grade") > F.col("grade"), F.lit(False))
    place = F.when(F.col("_grade").isNotNull(), F.greatest(F.struct("rank_index", "rank_band"), F.struct(F.col("_rank_index").alias("rank_index"), F.col("_rank_band").alias("rank_band")))).otherwise(F.struct("rank_index", "rank_band"))
    fixed = {c: F.when(swap, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("grade", "p", "pattern")}
    return both.withColumn("_place", place).withColumns({**fixed, "rank_index": F.col("_place.rank_index"), "rank_band": F.col("_place.rank_band"), "nameless_floor": swap}).select(
        *[c for c in named.columns if c != "nameless_floor"], "nameless_floor"
    )


def removed_tokens(judged_a: Column, judged_b: Column, generic: Column, salient: float = 0.5) -> Column:
    """Tokens a pair was compared without, in the order first seen, each with the side that finds it weak: query, candidate or both."""
    def weak(judged: Column) -> Column:
        return F.transform(F.filter(judged, lambda j: j["score"] < salient), lambda j: j["token"])

    order = F.array_distinct(F.concat(F.transform(judged_a, lambda j: j["token"]), F.transform(judged_b, lambda j: j["token"])))
    side = lambda t: F.when(F.array_contains(weak(judged_a), t) & F.array_contains(weak(judged_b), t), "both").when(F.array_contains(weak(judged_a), t), "query").otherwise("candidate")
    return F.transform(F.filter(order, lambda t: F.array_contains(generic, t)), lambda t: F.struct(t.alias("token"), side(t).alias("side")))


def caveats(figure: Column, suggested: Column, fallback: Column, photo: Column, has_image: Column, name: Column, spoken: Column, meant: Column, has_goods: Column, covered: Column, found: Column) -> Column:
    """What to tell about a search's limits, in fixed order; each condition a boolean column, suggested and name strings or null."""
    named = name.isNotNull()
    tests = [
        ("figure_low_data", figure), ("name_suggested", suggested.isNotNull()), ("ocr_fallback", fallback), ("photo_query", photo), ("no_image", ~has_image), ("no_name", ~named),
        ("no_pronunciation", named & ~spoken), ("no_meaning", named & ~meant), ("no_goods", ~has_goods), ("goods_coverage", has_goods & ~covered), ("goods_only", has_goods & ~has_image & ~named),
        ("no_candidates", ~found),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests]))


def checked_version(wanted: str, given: Column) -> Column:
    """The version that a row was made with; one that the model does not take raises."""
    return F.when(given == wanted, given).otherwise(F.raise_error(F.concat(F.lit(f"the model takes version {wanted}, not "), F.coalesce(given, F.lit("none")))))
