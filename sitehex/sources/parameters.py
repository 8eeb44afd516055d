"""Resolving user input against fixed tables, for one request or a whole column of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City
from sitehex.reference_data import synonyms_table


def resolve_category_column(requests: DataFrame, word: str = "word") -> DataFrame:
    """One row per (request, stored category); an unknown word stands for itself."""
    table = synonyms_table(requests.sparkSession).withColumnRenamed("word", "_key")
    return (
        requests.withColumn("_key", F.lower(F.trim(F.col(word))))
        .join(F.broadcast(table), "_key", "left")
        .withColumn("category", F.coalesce("category", "_key"))
        .withColumn("position", F.coalesce("position", F.lit(0)))
        .drop("_key")
    )


def check_city_column(requests: DataFrame, city: str = "city", cities: Sequence[City] = CITIES) -> DataFrame:
    """Validate a column of city names: known ones normalised, others marked with what exists."""
    names = [c.name for c in cities]
    key = F.lower(F.trim(F.col(city)))
    known = key.isin(names)
    return (
        requests.withColumn("resolved_city", F.when(known, key))
        .withColumn("error", F.when(~known, F.lit("unavailable")))
        .withColumn("available", F.when(~known, F.lit(", ".join(names))))
    )
