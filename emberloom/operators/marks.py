"""Kinds of marks: from areas, from register data, of queries; and the rows and records built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberloom.functions import codes, strings

#: Kinds of marks, shares of text below which a mark is a figure and of figure below which it is text.
TEXT, FIGURE, COMBINED = "문자", "도형", "결합"
FIGURE_BELOW, TEXT_BELOW = 0.05, 0.08
#: Register words for figure marks and combined ones.
REGISTER_FIGURE, REGISTER_COMBINED = "도형상표", "도형복합"
#: Least confidence of a text box, colour difference that counts as drawn, and what looks like a photo.
BOX_CONFIDENCE, DRAWN = 0.2, 24
PHOTO_COLOURS, PHOTO_MIDDLE, MIDDLE = 0.3, 0.45, (20, 235)


def auto_type(text_share: Column, figure_share: Column) -> Column:
    """struct(type, dominant) from the shares of area that text and drawing take."""
    def pair(kind: str, dominant) -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(dominant) if isinstance(dominant, str) else dominant).alias("dominant"))

    larger = F.when(figure_share >= text_share, FIGURE).otherwise(TEXT)
    return F.when(text_share < FIGURE_BELOW, pair(FIGURE, FIGURE)).when(figure_share < TEXT_BELOW, pair(TEXT, TEXT)).otherwise(pair(COMBINED, larger))


def model_type(kind: Column, dominant: Column, has_name: Column) -> Column:
    """The model's four levels; a combined mark of unknown dominant part goes by whether it has a name. Null for an unknown kind."""
    part = F.when(dominant.isin(TEXT, FIGURE), dominant).when(has_name, TEXT).otherwise(FIGURE)
    return F.when(kind == COMBINED, F.concat(F.lit(f"{COMBINED}-"), part, F.lit("요부"))).when(kind.isin(TEXT, FIGURE), kind)


def display_type(level: Column) -> Column:
    return F.when(level.startswith(COMBINED), COMBINED).otherwise(level)


def register_type(kind: Column, vienna: Column, name: Column) -> Column:
    """struct(type, basis) from register data: its own word, else figure codes and name; null type if there is nothing."""
    k = F.trim(F.coalesce(kind, F.lit("")))
    drawn = F.size(F.filter(F.coalesce(vienna, F.array().cast("array<string>")), lambda c: F.trim(c) != "")) > 0
    named = strings.blank_to_null(name).isNotNull()

    def pair(value: str | None, basis: str) -> Column:
        return F.struct(F.lit(value).cast("string").alias("type"), F.lit(basis).alias("basis"))

    return (
        F.when(k == REGISTER_FIGURE, pair(FIGURE, "상표구분"))
        .when(k == REGISTER_COMBINED, pair(COMBINED, "상표구분"))
        .when(drawn & named, pair(COMBINED, "비엔나코드"))
        .when(drawn, pair(FIGURE, "비엔나코드"))
        .when(named, pair(TEXT, "상표명"))
        .otherwise(pair(None, "없음"))
    )


def precomputed_types(records: DataFrame, shares: DataFrame, key: str) -> DataFrame:
    """Types of all records: by register data, and for those without any, by the shares (key, text_share, figure_share) read from their image."""
    typed = records.withColumn("r", register_type(F.col("mark_kind"), F.col("vienna"), F.col("name"))).join(shares, key, "left")
    seen = auto_type(F.col("text_share"), F.col("figure_share"))
    by_image = F.col("r.type").isNull() & F.col("text_share").isNotNull()
    return typed.select(key, F.when(by_image, seen["type"]).otherwise(F.col("r.type")).alias("type"), F.when(by_image, F.lit("OCR")).otherwise(F.col("r.basis")).alias("basis"))


def query_type(override: Column, has_image: Column, name: Column, text_share: Column, figure_share: Column) -> Column:
    """struct(level, source, fallback) of a query: the user's type, else by inputs; unread shares (null) fall back.

    A name always makes a mark of the text family.
    """
    named = strings.blank_to_null(name).isNotNull()

    def answer(level: Column, source: str, fallback: bool = False) -> Column:
        return F.struct(level.alias("level"), F.lit(source).alias("source"), F.lit(fallback).alias("fallback"))

    by_text, by_figure = F.lit(f"{COMBINED}-{TEXT}요부"), F.lit(f"{COMBINED}-{FIGURE}요부")
    return (
        F.when(override.isNotNull(), answer(model_type(override, F.lit(""), named), "user"))
        .when(~has_image, answer(F.lit(TEXT), "fallback"))
        .when(text_share.isNull() | figure_share.isNull(), answer(F.when(named, TEXT).otherwise(FIGURE), "fallback", True))
        .when(named, answer(F.when(figure_share < TEXT_BELOW, F.lit(TEXT)).otherwise(by_text), "ocr"))
        .otherwise(answer(F.when(text_share >= FIGURE_BELOW, by_figure).otherwise(F.lit(FIGURE)), "ocr"))
    )


def combined_score(kind: Column, figure: Column, text: Column, whole: Column) -> Column:
    """struct(score, source): the part that the kind tells, the larger for combined marks, the whole where that is missing."""
    chosen = F.when(kind == TEXT, text).when(kind == FIGURE, figure).when(kind == COMBINED, F.greatest(figure, text))
    source = F.when(kind == TEXT, "text_ortho").when(kind == FIGURE, "fig").when(kind == COMBINED, "max")
    return F.when(chosen.isNotNull(), F.struct(chosen.alias("score"), source.alias("source"))).otherwise(F.struct(whole.alias("score"), F.lit("whole").alias("source")))


def gate_type(confirmed: Column, automatic: Column, dominant: Column) -> Column:
    """'text', 'figure' or '' by the confirmed kind, else the automatic one with its dominant part."""
    own = F.when(confirmed.isin(TEXT, f"{COMBINED}-{TEXT}요부"), "text").when(confirmed.isin(FIGURE, f"{COMBINED}-{FIGURE}요부"), "figure")
    auto = F.when(automatic == TEXT, "text").when(automatic == FIGURE, "figure").when(automatic == COMBINED, F.when(dominant == FIGURE, "figure").otherwise("text"))
    return F.coalesce(own, auto, F.lit(""))


def records(marks: DataFrame, types: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """Search records: marks with a key, their clean title, type, valid code set and place in the index (null if not indexed)."""
    known = marks.where(strings.blank_to_null(F.col(key)).isNotNull())
    title = F.trim(F.regexp_replace(strings.first_known(F.col("title_ko"), F.col("title_en")), r"\s+", " "))
    joined = known.join(types.select(key, "type"), key, "left").join(positions.select(key, "position"), key, "left")
    return joined.select(key, title.alias("title"), "type", codes.clean_codes(F.col("codes")).alias("codes"), "position")


def training_rows(pairs: DataFrame, left_out: list[str]) -> DataFrame:
    """Pairs with a verdict, without the cases left out; a photo on either side takes the image value away, and rows with neither name nor image value go."""
    photo = F.coalesce(F.col("photo_a"), F.lit(False)) | F.coalesce(F.col("photo_b"), F.lit(False))
    kept = pairs.where(F.col("label").isin("유사", "비유사") & ~F.col("case_id").isin(*left_out))
    return kept.withColumn("x2_whole", F.when(~photo, F.col("x2_whole"))).where(F.col("x1_d").isNotNull() | F.col("x2_text_d").isNotNull() | F.col("x2_whole").isNotNull())


def eligible(marks: DataFrame, key: str, gate: Column) -> tuple[DataFrame, DataFrame]:
    """Marks with a key that pass a gate, and one row of how many passed and were left out."""
    known = marks.where(strings.blank_to_null(F.col(key)).isNotNull())
    passed = F.coalesce(gate, F.lit(False))
    return known.where(passed), known.agg(F.count_if(passed).alias("kept"), F.count_if(~passed).alias("left_out"))


def better_rows(rows: DataFrame, key: str) -> DataFrame:
    """Of several rows of a key that with an image, then the confident one, then the larger."""
    others = [c for c in rows.columns if c != key]
    rank = F.struct(F.coalesce("has_image", F.lit(False)), F.coalesce("confident", F.lit(False)), F.coalesce("area", F.lit(0)))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def registration_value(date: Column) -> Column:
    """The first eight digits of a date as a number, 0 if there are fewer."""
    digits = F.regexp_replace(F.coalesce(date, F.lit("")), "[^0-9]", "")
    return F.when(F.char_length(digits) >= 8, F.substring(digits, 1, 8).cast("int")).otherwise(0)


def areas(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> tuple[float, float]:
    """Share of an image that its text boxes cover, and of the smallest box around what else is drawn.

    pixels (height, width, 3); the ground is the median colour of a rim of two pixels.
    """
    height, width = pixels.shape[:2]
    if not height or not width:
        return 0.0, 0.0
    text = np.zeros((height, width), bool)
    for x0, y0, x1, y1 in boxes:
        text[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = True
    rim = 2 if min(height, width) > 8 else 1
    inner = np.zeros((height, width), bool)
    inner[rim : height - rim, rim : width - rim] = True
    # corner pixels stand in a row and a column of the rim
    edge = [pixels[:rim], pixels[-rim:], pixels[:, :rim], pixels[:, -rim:]]
    ground = np.median(np.concatenate([e.reshape(-1, 3) for e in edge]), axis=0)
    drawn = (np.abs(pixels.astype(float) - ground.astype(pixels.dtype)).max(axis=2) > DRAWN) & ~text
    at = np.argwhere(drawn)
    box = np.prod(at.max(axis=0) - at.min(axis=0) + 1) if len(at) else 0
    return round(float(text.mean()), 4), round(float(box / (height * width)), 4)


def looks_like_photo(pixels: np.ndarray) -> bool:
    """Many different colours and many middle tones."""
    flat = pixels.reshape(-1, 3)
    if not len(flat):
        return False
    colours = len(np.unique(flat, axis=0)) / len(flat)
    middle = (flat.min(axis=1) > MIDDLE[0]) & (flat.max(axis=1) < MIDDLE[1])
    return bool(colours > PHOTO_COLOURS and middle.mean() > PHOTO_MIDDLE)


_AREAS = T.StructType([T.StructField("text_share", T.DoubleType()), T.StructField("figure_share", T.DoubleType()), T.StructField("photo", T.BooleanType())])


@F.pandas_udf(_AREAS)
def area_shares(pixels: pd.Series, height: pd.Series, width: pd.Series, boxes: pd.Series) -> pd.DataFrame:
    """Decoded images (RGB bytes, height, width) and text boxes (x0, y0, x1, y1, confidence) -> shares and whether it looks like a photo."""
    out = []
    for data, h, w, found in zip(pixels, height, width, boxes):
        image = np.frombuffer(data or b"", np.uint8).reshape(int(h), int(w), 3)
        kept = [tuple(int(b[k]) for k in ("x0", "y0", "x1", "y1")) for b in (found if found is not None else []) if b["confidence"] >= BOX_CONFIDENCE]
        out.append((*areas(image, kept), looks_like_photo(image)))
    return pd.DataFrame(out, columns=[f.name for f in _AREAS.fields])
