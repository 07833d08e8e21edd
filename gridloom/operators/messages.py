"""Descriptions and chat-style training records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions.keyed import key_hash, pick
from gridloom.functions.numbers import fixed
from gridloom.functions.text import adjacency_phrase, box_region, size_category, size_phrase, tidy_sentence

BANKS = {
    "static": (K.NEGATIVE_SENTENCES, K.SINGLE_SENTENCES, K.MULTI_SENTENCES),
    "change": (K.CHANGE_NEGATIVE_SENTENCES, K.CHANGE_SINGLE_SENTENCES, K.CHANGE_MULTI_SENTENCES),
}


def describe(
    totals: DataFrame, key: Sequence[Column | str], seed: int | str = 42, bank: str = "static", name: str = "description"
) -> DataFrame:
    """Adds a sentence per patch from ``patch_totals``: keyed choice of wording, slots filled, tidied."""
    negative, single, multi = BANKS[bank]
    h = key_hash(seed, *key)
    n = F.col("pit_count")

    def chosen(sentences: Sequence[str]) -> Column:
        return F.get(F.array(*[F.lit(s) for s in sentences]), pick(h, len(sentences)))

    sentence = F.when(n == 0, chosen(negative)).when(n == 1, chosen(single)).otherwise(chosen(multi))
    slots = {
        "{count}": n.cast("string"),
        "{size}": size_category(F.col("largest")),
        "{region}": box_region(F.col("largest")),
        "{area}": fixed(F.col("total_area_ha"), 2),
        "{adjacency}": adjacency_phrase(n, F.col("span_x"), F.col("span_y"), bank == "change"),
        "{phrase}": size_phrase(n, F.col("min_area_ha"), F.col("max_area_ha"), F.col("total_area_ha")),
    }
    out = sentence
    for slot, value in slots.items():
        out = F.replace(out, F.lit(slot), F.coalesce(value, F.lit("")))
    return totals.withColumn(name, tidy_sentence(out) if bank == "static" else out)


def json_number(c: Column) -> Column:
    """A coordinate rounded to 4 places as JSON text without exponent or padding."""
    return F.regexp_replace(c.cast("decimal(10,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def grounding_target(boxes: Column, label: str = K.BOX_LABEL) -> Column:
    """Boxes as the JSON list a model is trained to emit."""

    def item(b: Column) -> Column:
        corners = F.concat_ws(", ", *[json_number(b[c]) for c in ("x1", "y1", "x2", "y2")])
        return F.concat(F.lit(f'{{"label": "{label}", "bbox": ['), corners, F.lit("]}"))

    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(boxes, item)), F.lit("]"))


def quoted(c: Column) -> Column:
    """A JSON string literal."""
    return F.get(F.split(F.to_json(F.struct(c.alias("v"))), r'^\{"v":'), F.lit(1)).substr(F.lit(1), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def action_target(tool: Column, direction: Column, reason: Column | None = None) -> Column:
    """The JSON tool call a model is trained to emit, with or without its reason."""
    said = F.lit("") if reason is None else F.concat(F.lit(', "reason": '), quoted(reason))
    where = F.coalesce(F.concat(F.lit(', "direction": '), quoted(F.nullif(direction, F.lit("")))), F.lit(""))
    return F.concat(F.lit('{"action": '), quoted(tool), said, where, F.lit("}"))


def _part(kind: str, value: Column) -> Column:
    missing = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"),
        (value if kind == "image" else missing).alias("image"),
        (value if kind == "text" else missing).alias("text"),
    )


def to_messages(images: Sequence[Column], user_text: Column, target: Column, system: Column | None = None) -> Column:
    """``messages`` array: optional system turn, user turn with images and text, assistant turn."""

    def turn(role: str, *parts: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    turns = [turn("user", *[_part("image", i) for i in images], _part("text", user_text)), turn("assistant", _part("text", target))]
    if system is not None:
        turns.insert(0, turn("system", _part("text", system)))
    return F.array(*turns)


def last_text(messages: Column) -> Column:
    return F.element_at(F.element_at(messages, -1)["content"], 1)["text"]


def user_text(messages: Column) -> Column:
    """Text of the first user turn."""
    user = F.element_at(F.filter(messages, lambda m: m["role"] == "user"), 1)
    return F.element_at(user["content"], -1)["text"]


def gold_action(messages: Column) -> Column:
    return F.get_json_object(last_text(messages), "$.action")


def referenced_images(df: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Distinct image paths used in ``messages``; with a listing, only those that exist."""
    paths = (
        df.select(F.explode("messages.content").alias("c"))
        .select(F.explode("c").alias("p"))
        .filter(F.col("p.type") == "image")
        .select(F.col("p.image").alias("path"))
        .distinct()
    )
    return paths if listing is None else paths.join(listing.select("path"), "path", "left_semi")
