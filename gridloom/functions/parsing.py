"""Typed values out of model text: box lists, tool calls, JSON actions, patch keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom import constants as K
from gridloom.functions import boxes as B
from gridloom.functions.calls import read_call
from gridloom.functions.text import strip, tool_to_action

# Markers and number pattern of the model outputs.
TOOL_CALL = r"(?s)<\|tool_call_start\|>(.*?)<\|tool_call_end\|>"
CALL_END, TURN_END = "<|tool_call_end|>", "<|im_end|>"
# The first name with brackets behind it. Starting at whole words and giving nothing back keeps it linear in a word.
BARE_CALL = r"(?U)(?<!\w)\w++\s*+\([^)]*+\)"
FOUR_NUMBERS = r"\[\s*[\d.]+\s*,\s*[\d.]+\s*,\s*[\d.]+\s*,\s*[\d.]+\s*\]"

# An end mark that model text cannot hold: control characters are escaped in JSON.
_END = "\\u0001end"


def bracketed(text: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the last ``closing`` bracket; null where there is no such span."""
    return F.nullif(F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0), F.lit(""))


def with_strict_json(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the JSON value of the whole text as a VARIANT, or null.

    ``try_parse_json`` ignores text after the first value, so the text becomes the first of two list
    items, the second an end mark: trailing or extra content moves the mark and is refused. Every
    step is a column of its own, so nothing is parsed twice. Of doubled keys the last counts, which is
    what the session is set to.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    pair = F.col("_pair")
    whole = (F.size(pair) == 2) & (F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == F.lit("\u0001end"))
    return (
        df.withColumn("_json", listed)
        .withColumn("_pair", F.try_variant_get("_json", "$", "array<variant>"))
        .withColumn(name, F.when(whole, F.get(pair, F.lit(0))))
        .drop("_json", "_pair")
    )


def _read(e: Column) -> Column:
    """Label and numbers of one list element; null numbers unless ``bbox`` is a list."""
    return F.struct(
        F.coalesce(F.try_variant_get(e, "$.label", "string"), F.lit(K.BOX_LABEL)).alias("label"),
        F.try_variant_get(e, "$.bbox", "array<double>").alias("xs"),
        F.size(F.try_variant_get(e, "$.bbox", "array<variant>")).alias("n"),
    )


def _labelled(r: Column) -> Column:
    return F.struct(r["label"].alias("label"), *[F.get(r["xs"], F.lit(i)).alias(c) for i, c in enumerate(B.CORNERS)])


def _clamped(b: Column) -> Column:
    c = B.clamp_box(b)
    return F.struct(b["label"].alias("label"), *[c[n].alias(n) for n in B.CORNERS])


def _unreadable(r: Column) -> Column:
    return r["xs"].isNull() | F.exists(r["xs"], lambda x: x.isNull())


def parse_boxes(df: DataFrame, text: str, mode: str = "strict", min_area: float = 0.0) -> DataFrame:
    """Add ``boxes`` and ``n_boxes`` parsed from a text column.

    strict: four numbers per box, clamped to [0, 1], positive extent, at least ``min_area``.
    perception: four numbers per box as they stand; one unreadable number empties the row.
    lenient: every object with a ``bbox`` counts; without a JSON list, bracketed number quadruples count.
    """
    if mode not in ("strict", "perception", "lenient"):
        raise ValueError(f"unknown mode {mode!r}")
    parsed = with_strict_json(df, bracketed(F.col(text), "[", "]"), "_value").withColumn(
        "_items", F.try_variant_get("_value", "$", "array<variant>")
    )
    items = F.coalesce(F.col("_items"), F.expr("cast(array() as array<variant>)"))
    if mode == "lenient":
        items = F.filter(items, lambda e: F.try_variant_get(e, "$.bbox", "variant").isNotNull())
    staged = parsed.withColumn("_rows", F.transform(items, _read))
    rows = F.col("_rows")
    if mode == "strict":
        good = F.filter(rows, lambda r: (r["n"] == 4) & ~_unreadable(r))
        shaped = F.transform(F.transform(good, _labelled), _clamped)
        out = staged.withColumn(
            "boxes", F.filter(shaped, lambda b: B.is_valid_box(b) & (B.box_area(b) >= F.lit(float(min_area))))
        ).withColumn("n_boxes", F.size("boxes"))
    elif mode == "perception":
        quads = F.filter(rows, lambda r: r["n"] == 4)
        kept = F.when(F.exists(quads, _unreadable), F.filter(quads, lambda r: F.lit(False))).otherwise(quads)
        out = staged.withColumn("boxes", F.transform(kept, _labelled)).withColumn("n_boxes", F.size("boxes"))
    else:
        out = staged.withColumn("boxes", F.transform(rows, _labelled)).withColumn(
            "n_boxes",
            F.when(F.col("_items").isNotNull(), F.size("boxes")).otherwise(
                F.coalesce(F.regexp_count(F.col(text), F.lit(FOUR_NUMBERS)), F.lit(0))
            ),
        )
    return out.drop("_value", "_items", "_rows")


def is_unparseable(text: Column, n_boxes: Column) -> Column:
    """Non-empty output that is neither ``[]`` nor boxes nor contains an opening bracket."""
    t = strip(F.coalesce(text, F.lit("")))
    return (t != "") & (t != "[]") & (n_boxes == 0) & ~t.contains("[")


def is_parseable_list(text: Column, n_boxes: Column) -> Column:
    """The change-detection harness' test: ``[]``, or boxes, or an opening bracket somewhere."""
    t = strip(F.coalesce(text, F.lit("")))
    return (t == "[]") | (n_boxes > 0) | t.contains("[")


def _unlisted(t: Column) -> Column:
    """A call stripped of the list brackets around it."""
    return F.when(
        t.startswith("[") & t.endswith("]") & (F.length(t) >= 2), strip(F.substring(t, F.lit(2), F.length(t) - 2))
    ).otherwise(t)


def parse_tool_calls(df: DataFrame, text: str) -> DataFrame:
    """Add ``action, tool, reason, direction, outcome`` from tool-call text; failures become discards.

    Any expression may be an argument and any length is read; values other than literals read None."""
    raw = F.col(text)
    staged = (
        df.withColumn("_marked", raw.rlike(TOOL_CALL))
        .withColumn("_inner", F.when(F.col("_marked"), strip(F.regexp_extract(raw, TOOL_CALL, 1))))
        .withColumn("_body", _unlisted(F.col("_inner")))
        .withColumn("_call", read_call(F.col("_body")))
        .withColumn("_name", F.col("_call.name"))
        .withColumn("_known", tool_to_action(F.col("_name")))
        .withColumn("direction", F.when(F.col("_known").isNotNull(), F.col("_call.direction")))
        .withColumn("_said", strip(F.coalesce(F.col("_call.reason"), F.lit(""))))
    )
    after = F.substring(raw, F.instr(raw, CALL_END) + len(CALL_END), F.length(raw))
    trailing = strip(F.substring_index(after, TURN_END, 1))
    marked = F.col("_marked")
    body, name, said, direction = (F.col(c) for c in ("_body", "_name", "_said", "direction"))
    directed = (
        F.when(direction.isNull(), said)
        .when(said != "", F.concat(F.lit("["), direction, F.lit("] "), said))
        .otherwise(F.concat(F.lit("direction="), direction))
    )
    staged = staged.withColumn("_said", directed).withColumn("_after", F.when(marked, trailing))
    extra = (F.col("_after") != "") & (F.instr(F.col("_said"), F.col("_after")) == 0)
    full = F.when(extra & (said != ""), F.concat(said, F.lit(" — "), F.col("_after"))).when(extra, F.col("_after")).otherwise(said)
    outcome = (
        F.when(body.isNull(), "no_tool_call").when(name.isNull(), "unparseable")
        .when(F.col("_known").isNull(), "unknown_tool").otherwise("ok")
    )
    return (
        staged.withColumn("outcome", outcome)
        .withColumn("action", F.coalesce(F.col("_known"), F.lit("discard")))
        .withColumn("tool", F.when(body.isNull(), "(no_tool_call)").when(name.isNull(), "(unparseable)").otherwise(name))
        .withColumn(
            "reason",
            F.when(body.isNull(), "agent emitted no parseable tool call; default discard")
            .when(name.isNull(), F.concat(F.lit("agent tool-call body did not parse: "), F.substring(body, 1, 120)))
            .when(F.col("_known").isNull(), F.concat(F.lit("agent called unknown tool '"), name, F.lit("'; default discard")))
            .otherwise(F.coalesce(F.nullif(full, F.lit("")), F.lit("(no reason given)"))),
        )
        .drop("_marked", "_inner", "_body", "_call", "_name", "_known", "_said", "_after")
    )


def lenient_tool(text: Column) -> Column:
    """Tool name of a marked or bare call; ``<no_call>`` or ``<unparseable>`` otherwise."""
    marked = text.rlike(TOOL_CALL)
    bare = F.nullif(F.regexp_extract(strip(F.substring_index(text, TURN_END, 1)), BARE_CALL, 0), F.lit(""))
    body = F.when(marked, _unlisted(strip(F.regexp_extract(text, TOOL_CALL, 1)))).otherwise(bare)
    return F.when(body.isNull(), "<no_call>").otherwise(F.coalesce(read_call(body)["name"], F.lit("<unparseable>")))


def _is_null(field: str) -> Column:
    """True for a JSON null in the object, not for an absent field."""
    return F.coalesce(F.is_variant_null(F.try_variant_get("_obj", f"$.{field}", "variant")), F.lit(False))


def parse_json_actions(df: DataFrame, text: str, mode: str = "policy") -> DataFrame:
    """Add ``action`` and ``outcome`` (policy mode: also ``tool`` and ``reason``) from JSON text.

    policy: action trimmed and lower-cased, every failure becomes a discard with its own code.
    eval: action taken as it stands, ``<unparseable>`` or ``<no_action_field>`` otherwise.
    """
    staged = with_strict_json(df.withColumn("_span", bracketed(F.col(text), "{", "}")), F.col("_span"), "_obj").withColumn(
        "_said", F.try_variant_get("_obj", "$.action", "string")
    )
    span, obj, said = F.col("_span"), F.col("_obj"), F.col("_said")
    if mode == "eval":
        return (
            staged.withColumn(
                "action",
                F.when(obj.isNull(), "<unparseable>").otherwise(F.coalesce(said, F.lit("<no_action_field>"))),
            )
            .withColumn(
                "outcome",
                F.when(obj.isNull(), "unparseable").when(said.isNull(), "no_action_field").otherwise("ok"),
            )
            .drop("_span", "_obj", "_said")
        )
    # A null field reads None; an absent one is empty.
    named = F.lower(strip(F.coalesce(F.when(_is_null("action"), "None").otherwise(said), F.lit(""))))
    known = named.isin(*K.ACTIONS)
    reason = strip(F.coalesce(F.when(_is_null("reason"), "None").otherwise(F.try_variant_get("_obj", "$.reason", "string")), F.lit("")))
    direction = F.coalesce(F.try_variant_get("_obj", "$.direction", "string"), F.lit(""))
    worded = F.coalesce(F.nullif(reason, F.lit("")), F.lit("(no reason given)"))
    return (
        staged.withColumn(
            "outcome",
            F.when(span.isNull(), "no_json").when(obj.isNull(), "json_decode_error")
            .when(~known, "invalid_action").otherwise("ok"),
        )
        .withColumn("action", F.when(obj.isNotNull() & known, named).otherwise("discard"))
        .withColumn(
            "tool",
            F.when(span.isNull(), "(no_json)").when(obj.isNull(), "(json_decode_error)")
            .when(~known, F.concat(F.lit("(invalid_action:"), named, F.lit(")"))).otherwise(named),
        )
        .withColumn(
            "reason",
            F.when(span.isNull(), "agent emitted no JSON object; default discard")
            .when(obj.isNull(), "JSON parse failed")
            .when(~known, F.concat(F.lit("agent emitted unknown action '"), named, F.lit("'; default discard")))
            .when(direction != "", F.concat(F.lit("["), direction, F.lit("] "), worded))
            .otherwise(worded),
        )
        .drop("_span", "_obj", "_said")
    )


def parse_outcomes(df: DataFrame) -> DataFrame:
    """Rows per parse outcome, so failures are counted instead of vanishing in discards."""
    return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def patch_num(path: Column) -> Column:
    """Patch number: the second-last ``_`` token of the file stem, where the last is a known year."""
    return F.nullif(F.regexp_extract(path, r"_(-?\d+)_(2016|2022)(?:\.[^./]*)?$", 1), F.lit("")).try_cast("long")


def patch_year(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"_(-?\d+)_(2016|2022)(?:\.[^./]*)?$", 2), F.lit("")).try_cast("int")
