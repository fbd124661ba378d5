"""Key figures as text, with thousands separators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_kpis(df: DataFrame, places: Mapping[str, int] | int) -> DataFrame:
    """Every figure as text with its decimal places (ties to even); NULL stays NULL.

    ``places`` is one number for all columns, or a number per column to keep.
    """
    if isinstance(places, int):
        places = dict.fromkeys(df.columns, places)
    return df.select(*(F.format_number(name, count).alias(name) for name, count in places.items()))
