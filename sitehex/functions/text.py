"""Names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def place_name(area, locality) -> Column:
    """``area, locality`` without blanks or repeats; NULL when the cell has no name at all."""
    parts = F.array_compact(F.array(F.nullif(_c(area), F.lit("")), F.nullif(_c(locality), F.lit(""))))
    return F.nullif(F.array_join(F.array_distinct(parts), ", "), F.lit(""))


def half_up_1dp(x) -> Column:
    """One decimal, halves away from the floor: the rounding the display layer uses."""
    return F.floor(_c(x) * 10 + F.lit(0.5)) / F.lit(10.0)


def district_matches(needle: str, *names) -> Column:
    """Case-insensitive literal containment in any of the names (no pattern characters)."""
    wanted = F.lower(F.lit(needle.strip()))
    cond = F.lit(False)
    for n in names:
        cond = cond | F.coalesce(F.contains(F.lower(_c(n)), wanted), F.lit(False))
    return cond


# The display texts of ranking controls that are not the default.
LENS_LABELS = {"demand": "biggest markets", "low_competition": "least competition", "accessible": "most reachable"}
AVOID_LABEL = "avoid · saturated"
DISTRICT_LABEL, PAGE_LABEL = "in ", "more · pg "


def lens_label(strategy: Column, order: Column, district: Column, page: Column) -> Column:
    """Label of a ranking's controls, row by row; NULL for the default ones. Absent parts drop out of the join."""
    lens = F.try_element_at(F.create_map(*[F.lit(x) for kv in LENS_LABELS.items() for x in kv]), strategy)
    parts = (
        F.when(order == "worst", F.lit(AVOID_LABEL)).otherwise(lens),
        F.concat(F.lit(DISTRICT_LABEL), F.nullif(F.trim(district), F.lit(""))),
        F.when(page > 1, F.concat(F.lit(PAGE_LABEL), page.cast("string"))),
    )
    return F.nullif(F.concat_ws(" · ", *parts), F.lit(""))
