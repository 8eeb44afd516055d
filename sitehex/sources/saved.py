"""Append-only store of saved-site versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.operators.saved import SITE_SCHEMA


def with_defaults(rows: DataFrame) -> DataFrame:
    """Fill what a writer may omit. A missing score stays NULL: unscored is not zero."""
    have = set(rows.columns)

    def col(name, kind, default=None):
        c = F.col(name) if name in have else F.lit(None)
        c = c.cast(kind)
        return (c if default is None else F.coalesce(c, default)).alias(name)

    now = F.current_timestamp()
    defaults = {
        "id": F.uuid(), "note": F.lit(""), "status": F.lit("candidate"), "created_at": now, "updated_at": now,
    }
    return rows.select(
        *[col(n, k, defaults.get(n)) for n, k in (f.strip().split(" ") for f in SITE_SCHEMA.split(","))]
    )


def append_saved_site(rows: DataFrame, path: str) -> None:
    with_defaults(rows).write.mode("append").partitionBy("city").parquet(path)
