"""Sinks for resolutions, transcripts and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_resolutions(resolutions: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All rows, failed images included; their ``error`` column says why."""
    resolutions.write.mode("overwrite").format(fmt).save(path)


def write_transcripts(transcripts: DataFrame, path: str, fmt: str = "parquet") -> None:
    transcripts.write.mode("overwrite").format(fmt).save(path)


def write_quotes(quotes: DataFrame, path: str, column: str = "quote") -> None:
    """One quote after the other as text, two blank lines between them."""
    quotes.select(F.col(column).alias("value")).write.mode("overwrite").option(
        "lineSep", "\n\n\n"
    ).text(path)
