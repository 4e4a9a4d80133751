"""Epoch arithmetic that takes timestamps with and without time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice.functions.geo import col


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds(ts) -> Column:
    return F.unix_seconds(col(ts).cast("timestamp"))
