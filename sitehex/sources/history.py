"""Monthly history documents per (city, tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.reference_data import history_tags_table

DOC = "struct<result:array<struct<timestamp:string,value:double>>>"


def read_documents(spark, path: str) -> DataFrame:
    """``(city, tag, body)`` JSON lines as fetched."""
    return spark.read.schema("city string, tag string, body string").json(path)


def ingest_history(docs: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Rows ``(city, category, month, count)``, one per month.

    A tag shared by two categories feeds both. A failed fetch has no parseable result and so
    leaves no rows: absent is not zero.
    """
    tags = F.broadcast(history_tags_table(docs.sparkSession)) if tags is None else tags
    return (
        docs.join(tags, "tag")
        .select("city", "category", F.inline(F.from_json("body", DOC)["result"]))
        .select(
            "city", "category",
            F.substring("timestamp", 1, 10).cast("date").alias("month"),
            F.col("value").cast("bigint").alias("count"),
        )
        .dropDuplicates(["city", "category", "month", "count"])
    )
