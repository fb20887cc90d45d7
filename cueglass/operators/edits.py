"""Manual corrections of resolved images, and fallback values for display."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueglass.functions.text import non_empty

EDITABLE = ["podcast_id", "podcast_title", "episode_id", "episode_title", "timestamp"]


def apply_overrides(resolutions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace each field an override gives; other fields stay, as does ``validated``."""
    given = overrides.select("image_id", *[F.col(c).alias(f"_{c}") for c in EDITABLE])
    replaced = {
        c: F.coalesce(
            non_empty(F.col(f"_{c}")) if dict(overrides.dtypes)[c] == "string" else F.col(f"_{c}"),
            F.col(c),
        )
        for c in EDITABLE
    }
    return (
        resolutions.join(given, "image_id", "left")
        .withColumns(replaced)
        .drop(*[f"_{c}" for c in EDITABLE])
    )


def drop_deleted(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Leave out every row of a deleted image; works for any table keyed by image."""
    return rows.join(overrides.where("deleted").select("image_id"), "image_id", "left_anti")


def first_filled(*values: Column | str) -> Column:
    """First value that is neither null nor empty; plain strings are literals."""
    return F.coalesce(
        *[F.lit(v) if isinstance(v, str) else non_empty(v) for v in values]
    )


def timestamp_options(first: Column, second: Column, root: Column) -> Column:
    """Distinct filled timestamps in this order."""
    return F.array_distinct(
        F.filter(F.array(first, second, root), lambda t: t.isNotNull() & (t != ""))
    )


def eligible_for_transcript(resolutions: DataFrame) -> DataFrame:
    """Validated, with a podcast, some title and a timestamp."""
    return resolutions.where(
        reduce(
            and_,
            [
                F.col("validated"),
                F.col("podcast_id").isNotNull(),
                first_filled(F.col("episode_title"), F.col("podcast_title")).isNotNull(),
                non_empty(F.col("timestamp")).isNotNull(),
            ],
        )
    )


def status_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Total, successful and failed items; ``error`` is null on success."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
