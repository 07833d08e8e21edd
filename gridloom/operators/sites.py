"""Sites: centroids from polygon vertices and verification status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def site_centroids(vertices: DataFrame, key: str = "site_id") -> DataFrame:
    """Mean of all ring vertices, the closing one included, to 5 places."""
    return vertices.groupBy(key).agg(
        F.bround(F.avg("lon"), 5).alias("lng"), F.bround(F.avg("lat"), 5).alias("lat"), F.count(F.lit(1)).alias("n_vertices")
    )


def site_status(has_image: Column, n_boxes: Column) -> Column:
    return F.when(~has_image, "fetch_error").when(n_boxes > 0, "confirmed").otherwise("empty")


def site_counts(sites: DataFrame) -> DataFrame:
    """Sites per bucket; missing, unverified and failed checks share one."""
    status = F.col("status")
    bucket = F.when(status.isNull() | status.isin("unverified", "fetch_error"), "unverified").otherwise(status)
    return sites.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
