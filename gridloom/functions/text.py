"""Text vocabulary: regions, size words, phrases, classifiers, prompts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from gridloom import constants as K
from gridloom.functions.boxes import box_area, box_centroid
from gridloom.functions.numbers import fixed


# The characters that count as white space at the ends of a text.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Both ends freed of any whitespace (``trim`` only takes blanks); what lies between is not looked at."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def lookup(mapping: dict[str, str], c: Column) -> Column:
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.try_element_at(literal, c)


def tool_to_action(c: Column) -> Column:
    return lookup(K.TOOL_TO_ACTION, c)


def action_to_tool(c: Column) -> Column:
    return lookup({action: tool for tool, action in K.TOOL_TO_ACTION.items()}, c)


def centroid_region(x: Column, y: Column) -> Column:
    h = F.when(x < 0.33, "left").when(x > 0.67, "right").otherwise("center")
    v = F.when(y < 0.33, "upper").when(y > 0.67, "lower").otherwise("middle")
    return (
        F.when((h == "center") & (v == "middle"), F.lit("center of the scene"))
        .when(h == "center", F.concat(v, F.lit(" portion of the scene")))
        .when(v == "middle", F.concat(h, F.lit(" side of the scene")))
        .otherwise(F.concat(v, F.lit("-"), h, F.lit(" quadrant")))
    )


def box_region(b: Column) -> Column:
    c = box_centroid(b)
    return centroid_region(c["x"], c["y"])


def size_category(b: Column) -> Column:
    area = F.greatest(box_area(b), F.lit(0.0))
    return (
        F.when(area < 0.01, "very small")
        .when(area < 0.04, "small")
        .when(area < 0.15, "moderate")
        .when(area < 0.40, "large")
        .otherwise("very large")
    )


def size_phrase(n: Column, smallest: Column, largest: Column, total: Column) -> Column:
    """Phrase for the spread of areas, from the group's min, max and sum."""
    spread = (largest - smallest) / F.greatest(total / n, F.lit(1e-9))
    return (
        F.when(n <= 1, F.lit(""))
        .when(spread < 0.4, "with roughly uniform pit sizes")
        .when(spread < 1.5, "with mixed pit sizes")
        .otherwise("dominated by one or two large pits among smaller satellite pits")
    )


def adjacency_phrase(n: Column, span_x: Column, span_y: Column, change: bool = False) -> Column:
    """Phrase for how far the centroids lie apart, from the range of x and of y."""
    total = span_x + span_y
    tight = "clustered together" if change else "clustered together in a tight group"
    return (
        F.when(n < 2, F.lit(""))
        .when(total < 0.3, tight)
        .when(total < 0.7, "spread across a connected area")
        .otherwise("scattered across the scene")
    )


def tidy_sentence(c: Column) -> Column:
    """Close the gaps that empty slots leave behind."""
    single = F.regexp_replace(c, " {2,}", " ")
    return F.replace(F.replace(single, F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(","))


def plain_description(n: Column, total_ha: Column) -> Column:
    """The fixed sentence of the first dataset version."""
    return F.when(n == 0, F.lit(K.NEGATIVE_SENTENCES[0])).otherwise(
        F.concat(
            n.cast("string"),
            F.lit(" active excavation "),
            F.when(n == 1, "pit").otherwise("pits"),
            F.lit(" visible, total affected area approximately "),
            fixed(total_ha, 2),
            F.lit(" hectares."),
        )
    )


def presence_description(n_pixels: Column) -> Column:
    return F.when(n_pixels > 0, F.lit(K.PRESENT_SENTENCE)).otherwise(F.lit(K.ABSENT_SENTENCE))


def task_of_prompt(text: Column) -> Column:
    """Task of a training row, told by its user prompt; null where neither fits."""
    low = F.lower(text)
    return F.when(
        text.contains("Provide result as a valid JSON") | (low.contains("detect") & low.contains("bbox")),
        "grounding",
    ).when(low.contains("describe"), "description")


def task_of_target(text: Column) -> Column:
    """Task of a training row, told by its target text."""
    return (
        F.when(text.startswith('{"action"'), "action")
        .when(text.startswith("[") | text.contains("bbox"), "grounding")
        .otherwise("description")
    )


def scratchpad(confidence: Column, n_boxes: Column, cloud: Column, remaining_kb: Column) -> Column:
    return F.concat(
        F.lit("confidence="), fixed(confidence, 2),
        F.lit("; boxes="), n_boxes.cast("string"),
        F.lit("; cloud_cover="), F.coalesce(cloud.cast("string"), F.lit("n/a")),
        F.lit("; budget_remaining_kb="), remaining_kb.cast("string"),
    )


def tile_prompt(
    tile_id: Column, lon: Column, lat: Column, cloud: Column, captured_at: Column,
    n_boxes: Column, max_area: Column, description: Column, confidence: Column,
    remaining_kb: Column, total_kb: Column,
    priors: Column | None = None, neighbors_json: Column | None = None,
    cloud_unit: str = "fraction",
) -> Column:
    """The decision prompt of one tile; priors and neighbours only in the rich variant.

    ``cloud_unit`` is ``fraction`` (scaled to percent) or ``percent`` (printed as it is).
    """
    percent = cloud * 100 if cloud_unit == "fraction" else cloud
    rich = (
        [F.lit("Mission priors: "), priors, F.lit("\nNeighbor summary (structured):\n"), neighbors_json, F.lit("\n\n")]
        if priors is not None
        else []
    )
    return F.concat(
        F.lit("Tile "), tile_id.cast("string"), F.lit(" at lon="), fixed(lon, 4), F.lit(", lat="), fixed(lat, 4),
        F.lit(".\nCloud cover: "), F.coalesce(F.concat(fixed(percent, 0), F.lit("%")), F.lit("n/a")),
        F.lit(". Captured: "), F.coalesce(captured_at, F.lit("unknown")),
        F.lit(".\n\nVLM detection:\n- "), n_boxes.cast("string"), F.lit(" mining-pit candidate bounding box(es)"),
        F.when(n_boxes > 0, F.concat(F.lit(" (largest area = "), fixed(max_area, 3), F.lit(")"))).otherwise(F.lit("")),
        F.lit('\n- Description: "'), strip(description), F.lit('"\n- Derived confidence: '), fixed(confidence, 2),
        F.lit("\n\n"), *rich,
        F.lit("Pass budget: "), remaining_kb.cast("string"), F.lit(" KB of "), total_kb.cast("string"),
        F.lit(" KB remaining.\n\nChoose the appropriate tool."),
    )


DIRECTIONS = ("north", "south", "east", "west")


def neighbor_json(neighbors: Column) -> Column:
    """The neighbour map as indented JSON, directions in fixed order, absent ones as null."""

    def entry(direction: str) -> Column:
        v = F.try_element_at(neighbors, F.lit(direction))
        return F.concat(
            F.lit(f'  "{direction}": '),
            F.when(v.isNull(), F.lit("null")).otherwise(
                F.concat(
                    F.lit('{\n    "action": "'), v["action"],
                    F.lit('",\n    "boxes": '), v["boxes"].cast("string"),
                    F.lit(',\n    "scene_hint": "'), v["scene_hint"], F.lit('"\n  }'),
                )
            ),
        )

    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *[entry(d) for d in DIRECTIONS]), F.lit("\n}"))


def _or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def label_message(
    coord_id: Column, lon: Column, lat: Column, stratum: Column, cloud: Column, captured_at: Column,
    issue: Column, remaining_kb: Column, total_kb: Column, prior_downlinked: Column,
    priors: Column, neighbors: Column,
) -> Column:
    """The labelling message of one tile; missing values print as ``None``."""
    return F.concat(
        F.lit("Tile "), coord_id, F.lit(" at lon="), fixed(lon, 4), F.lit(", lat="), fixed(lat, 4),
        F.lit(".\nStratum (sampling category): "), stratum,
        F.lit("\nCloud cover (metadata, may be unreliable): "), _or_none(cloud),
        F.lit("\nCaptured: "), _or_none(captured_at),
        F.lit("\nTile imagery issue: "), _or_none(issue),
        F.lit("\nPass budget: "), remaining_kb.cast("string"), F.lit(" of "), total_kb.cast("string"),
        F.lit(" KB remaining\nPrior tiles downlinked this pass: "), prior_downlinked.cast("string"),
        F.lit("\nMission priors: "), priors,
        F.lit("\nNeighbor summary (structured):\n"), neighbor_json(neighbors), F.lit("\n"),
    )


def prompt_fields(text: Column) -> dict[str, Column]:
    """Fields read back from a labelling message; the budget and text defaults where absent."""

    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    budget = r"Pass budget: (\d+) of (\d+) KB"
    return {
        "tile_id": found(r"Tile (\w+)"),
        "lon": found(r"lon=(-?\d+\.\d+)").try_cast("double"),
        "lat": found(r"lat=(-?\d+\.\d+)").try_cast("double"),
        "cloud_cover": found(r"Cloud cover.*?:\s*(\d+\.?\d*)").try_cast("double"),
        "captured_at": found(r"Captured: (\S+)"),
        "budget_remaining_kb": F.coalesce(found(budget, 1).try_cast("int"), F.lit(256)),
        "budget_total_kb": F.coalesce(found(budget, 2).try_cast("int"), F.lit(512)),
        "mission_priors": F.coalesce(strip(found(r"Mission priors: (.+?)\n")), F.lit("(none)")),
        "neighbors_json": F.coalesce(
            found(r"(?s)Neighbor summary \(structured\):\n(\{.*?\n\})\n"), F.lit("{}")
        ),
    }
