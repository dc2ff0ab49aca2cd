"""Membership joins that stay even when one key fills the right side."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keep_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``.

    The right keys are made distinct first: that combines before the shuffle, so
    a hot key costs one row there, and AQE can split it on the left.
    """
    return left.join(right.select(*on).distinct(), on, "left_semi")


def drop_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(*on).distinct(), on, "left_anti")
