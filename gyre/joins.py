"""Joins whose sides both grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(side: DataFrame) -> DataFrame:
    """``side`` of an equi-join that deals both sides out by key, never broadcast.

    Spark guesses a side's size from its files, which are packed, and takes an exploded side for no longer than its source; what it then broadcasts
    may fill the driver, which builds the table.
    """
    return side.hint("merge")
