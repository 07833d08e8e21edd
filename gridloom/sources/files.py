"""Readers and writers. Every schema is given, none is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions.numbers import fixed
from gridloom.functions.parsing import patch_num, patch_year

MESSAGES = "messages array<struct<role:string,content:array<struct<type:string,image:string,text:string>>>>"
LABELS = (
    "coord_id string, lon double, lat double, stratum string, "
    "context struct<budget_remaining_kb:int,budget_total_kb:int,prior_tiles_downlinked:int,cloud_cover:double,"
    "captured_at:string,tile_imagery_issue:string,mission_priors:string,"
    "neighbor_summary:map<string,struct<action:string,boxes:bigint,scene_hint:string>>>, "
    "label struct<action:string,reason:string,direction:string>"
)
SPLITS = "patch_name string, split string, class_percentage string"
EVENTS = (
    "pass_id string, seq bigint, event string, ts timestamp, tile_id string, lon double, lat double, fetch_ms bigint, "
    "image_url string, image_available boolean, cloud_cover double, captured_at string, source string, size_km double, "
    "detection struct<tile_id:string,boxes:array<struct<label:string,bbox:array<double>,confidence:double>>,"
    "description:string,overall_confidence:double>, inference_ms bigint, scratchpad string, action string, "
    "reasoning string, decision_ms bigint, bandwidth_used_kb bigint, bandwidth_remaining_kb bigint"
)
GEOMETRY = "struct<type:string,coordinates:string>"
PROPERTIES = "struct<id:string,status:string>"


def clean_splits(rows: DataFrame) -> DataFrame:
    """Split rows to ``patch_num, year, split, class_percentage``; the last row of a key wins.

    ``rows`` brings ``patch_name, split, class_percentage`` as text and ``_row``, their order.
    """
    split = F.lower(F.trim(F.coalesce("split", F.lit(""))))
    keyed = rows.select(
        patch_num(F.col("patch_name")).alias("patch_num"), patch_year(F.col("patch_name")).alias("year"),
        F.when(split.isin("train", "test"), split).otherwise("train").alias("split"),
        F.coalesce(F.col("class_percentage").try_cast("double"), F.lit(0.0)).alias("class_percentage"), "_row",
    ).filter(F.col("patch_num").isNotNull() & (F.col("patch_num") != -1))
    return keyed.groupBy("patch_num", "year").agg(
        F.max_by("split", "_row").alias("split"), F.max_by("class_percentage", "_row").alias("class_percentage")
    )


def read_splits(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per-year split files; where a key repeats, the later file and the later line win."""
    parts = []
    for i, path in enumerate(paths):
        raw = spark.read.csv(path, header=True, schema=SPLITS, enforceSchema=False)
        at = F.struct(F.lit(i), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        parts.append(raw.select("*", at.alias("_row")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return clean_splits(rows)


def index_patch_files(paths: DataFrame) -> DataFrame:
    """File listing to ``path, patch_num, year, kind``; anything else is left out."""
    p = F.col("path")
    kind = F.when(p.contains("IMAGE"), "image").when(p.contains("MASK"), "mask")
    return (
        paths.filter(p.endswith(".tif"))
        .select("path", patch_num(p).alias("patch_num"), patch_year(p).alias("year"), kind.alias("kind"))
        .filter(F.col("patch_num").isNotNull() & (F.col("patch_num") != -1) & F.col("kind").isNotNull())
    )


def list_files(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """Paths below a folder; contents are never opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")


def write_messages(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per line; unset image or text keys are left out."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).json(path).filter(F.col("messages").isNotNull())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS).json(path).filter(F.col("coord_id").isNotNull())


def site_vertices(features: DataFrame) -> DataFrame:
    """GeoJSON features (``site_id, status, geometry``) to one row per ring vertex.

    Polygons and multi-polygons only; empty ones yield nothing.
    """
    kind, raw = F.col("geometry.type"), F.col("geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(raw, "array<array<array<double>>>")).when(
        kind == "MultiPolygon", F.flatten(F.from_json(raw, "array<array<array<array<double>>>>"))
    )
    return (
        features.select("site_id", "status", F.posexplode(rings).alias("ring_no", "ring"))
        .select("site_id", "status", "ring_no", F.posexplode("ring").alias("vertex_no", "pt"))
        .select("site_id", "status", "ring_no", "vertex_no", F.get("pt", F.lit(0)).alias("lon"), F.get("pt", F.lit(1)).alias("lat"))
    )


def read_site_vertices(spark: SparkSession, path: str, collection: bool = False) -> DataFrame:
    """Vertices of a GeoJSON source: one feature per line, or (``collection``) one document per file.

    Line-delimited features split over tasks; a document is read whole by one task.
    """
    if collection:
        doc = spark.read.schema(f"features array<struct<geometry:{GEOMETRY},properties:{PROPERTIES}>>").json(path, multiLine=True)
        rows = doc.select(F.posexplode("features").alias("no", "f")).select(F.col("no").cast("string").alias("no"), "f.*")
        site = F.coalesce("properties.id", "no")
    else:
        rows = spark.read.schema(f"geometry {GEOMETRY}, properties {PROPERTIES}").json(path)
        site = F.col("properties.id")
    return site_vertices(rows.select(site.alias("site_id"), F.col("properties.status").alias("status"), "geometry"))


def normalize_tile_metadata(df: DataFrame, raw: str = "metadata", size_km: float = 1.28) -> DataFrame:
    """Header JSON to typed columns; unreadable JSON counts as empty, defaults fill the gaps."""
    v = F.try_parse_json(F.col(raw))
    cloud = F.try_variant_get(v, "$.cloud_cover", "double")
    return df.select(
        "*",
        F.coalesce(F.try_variant_get(v, "$.image_available", "boolean"), F.lit(True)).alias("image_available"),
        cloud.alias("cloud_cover"),
        F.try_variant_get(v, "$.datetime", "string").alias("datetime"),
        F.try_variant_get(v, "$.source", "string").alias("source"),
        F.coalesce(F.try_variant_get(v, "$.size_km", "double"), F.lit(float(size_km))).alias("size_km"),
        F.try_variant_get(v, "$.footprint", "variant").alias("footprint"),
    )


def build_manifest(tiles: DataFrame, message: Column, root: str = "cache") -> DataFrame:
    """One row per tile with its artefact paths and the head of its message."""
    base = F.concat(F.lit(f"{root}/"), F.col("coord_id"))
    return tiles.select(
        "coord_id", "lon", "lat", "stratum",
        *[F.concat(base, F.lit(f"/{f}")).alias(n) for n, f in
          (("rgb_path", "rgb.png"), ("swir_path", "swir.png"), ("meta_path", "meta.json"), ("context_path", "context.json"))],
        F.substring(message, 1, 200).alias("user_message_preview"),
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions, manifests and metric summaries, one record per line."""
    df.write.mode(mode).json(path)


def policy_rows(results: DataFrame) -> DataFrame:
    """Policy results in file form: the ratio with six decimals."""
    return results.select(
        "policy", "tiles_downlinked", "pits_captured", "pits_total", F.col("kb_used").alias("bytes_used_kb"),
        fixed(F.col("pits_per_kb"), 6).alias("pits_per_kb"),
    )


def write_policy_csv(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    policy_rows(results).write.mode(mode).csv(path, header=True)


def policy_markdown(results: DataFrame) -> DataFrame:
    """One Markdown table line per policy."""
    return results.select(
        "policy",
        F.concat(
            F.lit("| "), F.col("policy"), F.lit(" | "), F.col("tiles_downlinked").cast("string"), F.lit(" | "),
            F.col("pits_captured").cast("string"), F.lit(" of "), F.col("pits_total").cast("string"), F.lit(" | "),
            F.col("kb_used").cast("string"), F.lit(" KB | "), fixed(F.col("pits_per_kb"), 4), F.lit(" |"),
        ).alias("line"),
    )


def read_events(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Tagged pass events as JSON lines, one wide nullable row per event."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENTS).json(path)
