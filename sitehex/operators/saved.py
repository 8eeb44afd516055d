"""Saved sites: versioned rows, their market today, and the pending overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City, idx_of
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.functions.text import place_name

SITE_KEY = ("user_id", "city", "business_type", "id")
SITE_SCHEMA = (
    "id string, user_id string, city string, business_type string, label string, note string, "
    "lon double, lat double, h3_8 string, score double, status string, created_at timestamp, "
    "updated_at timestamp"
)


def latest_versions(
    sites: DataFrame, keys: Sequence[str] = SITE_KEY, version: str = "updated_at"
) -> DataFrame:
    """Newest version of every row.

    A maximum over a struct is a partial aggregate, so a row with millions of versions collapses
    before the shuffle. The remaining columns break ties, which makes the choice repeatable.
    """
    rest = [c for c in sites.columns if c not in keys and c != version]
    newest = sites.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_v"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in sites.columns])


def drop_tombstones(changes: DataFrame, keys: Sequence[str], version: str, deleted: str) -> DataFrame:
    """Latest change per key, without the keys whose latest change is a delete."""
    return latest_versions(changes, keys, version).where(F.col(deleted) == 0).drop(deleted)


def saved_sites_list(sites: DataFrame, user: str | None = None) -> DataFrame:
    mine = sites if user is None else sites.where(F.col("user_id") == user)
    return latest_versions(mine).orderBy(F.col("created_at").desc(), *[F.col(k) for k in SITE_KEY])


def saved_sites_market(
    sites: DataFrame, surface: DataFrame, user: str | None = None, business_type: str | None = None
) -> DataFrame:
    """Saved sites against today's surface; market numbers are NULL outside the scored set.

    The trade filter is an equality on the word the site was saved under: a site saved for
    another trade must not be judged on this surface.
    """
    mine = sites
    if user is not None:
        mine = mine.where(F.col("user_id") == user)
    if business_type is not None:
        mine = mine.where(F.col("business_type") == business_type)
    latest = latest_versions(mine).withColumn("cell", G.cell_from_string("h3_8"))
    market = surface.select("city", "cell", "gap", "pop", "sup")
    return latest.join(market, ["city", "cell"], "left").select(
        "user_id", "business_type", "id", "city", "label", "h3_8", "lon", "lat",
        F.col("score").alias("saved_score"),
        F.bround("gap", 1).alias("market_gap"),
        F.col("pop").alias("residents"),
        F.col("sup").alias("rivals"),
        "status", "created_at",
    )


def saved_sites_layer(market: DataFrame) -> DataFrame:
    """One point feature per saved site; score keys appear only when known."""
    props = F.struct(
        "label", "status",
        F.bround("saved_score", 1).alias("savedScore"),
        F.col("market_gap").alias("marketGap"),
        F.bround("residents").alias("residents"),
        F.col("rivals").alias("rivals"),
    )
    feature = geo.feature_json(geo.point_geometry("lon", "lat"), props)
    return market.select("user_id", "business_type", "id", "city", feature.alias("feature"))


def overlay_pending(confirmed: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending rows whose cell is not confirmed yet, followed by the confirmed rows."""
    waiting = pending.join(confirmed.select("user_id", "h3_8").distinct(), ["user_id", "h3_8"], "left_anti")
    return waiting.select(*confirmed.columns).withColumn("pending", F.lit(True)).unionByName(
        confirmed.withColumn("pending", F.lit(False))
    )


def coord_key(lon, lat) -> Column:
    """Coordinates at five decimals as integers: an exact equality key."""
    return F.struct(
        F.floor(F.col(lon) * 100000 + 0.5).alias("x"), F.floor(F.col(lat) * 100000 + 0.5).alias("y")
    )


def market_by_coord(listed: DataFrame, layer: DataFrame) -> DataFrame:
    """Today's market number per listed site, matched on rounded coordinates."""
    right = layer.select(coord_key("lon", "lat").alias("_k"), "market_gap", "residents", "rivals").groupBy("_k").agg(
        F.max(F.struct("market_gap", "residents", "rivals")).alias("_m")
    )
    return (
        listed.withColumn("_k", coord_key("lon", "lat"))
        .join(right, "_k", "left")
        .select(*listed.columns, "_m.market_gap", "_m.residents", "_m.rivals")
    )


def saved_sites_population(sites: DataFrame, population: DataFrame) -> DataFrame:
    """People in each saved site's own cell."""
    latest = latest_versions(sites).withColumn("_cell", G.cell_from_string("h3_8"))
    people = population.select(F.col("h3_8").alias("_cell"), F.col("population").alias("people_in_cell"))
    return latest.join(people, "_cell").select("user_id", "city", "business_type", "id", "label", "people_in_cell")


def as_saved(picks: DataFrame, user: str, business_type: str, which: int = 1) -> DataFrame:
    """The ``which``-th ranked pick of each city as a row ready to append."""
    label = F.coalesce(place_name("area", "locality"), F.lit("saved site"))
    return picks.where(F.col("rank") == which).select(
        F.lit(None).cast("string").alias("id"),
        F.lit(user).alias("user_id"),
        "city",
        F.lit(business_type).alias("business_type"),
        label.alias("label"),
        F.lit("").alias("note"),
        "lon", "lat",
        F.col("h3").alias("h3_8"),
        F.col("gap").alias("score"),
        F.lit("candidate").alias("status"),
    )


def radius_join(
    sites: DataFrame, places: DataFrame, radius_m: float = 500.0, cities: Sequence[City] = CITIES
) -> DataFrame:
    """Places within a radius of each site: count and nearest distance per category.

    ``sites`` has ``(site_id, city, lon, lat)``. Both sides meet on res-9 cells of a ring wide
    enough to cover the radius, then the exact distance decides. Places standing on the same
    point collapse to one weighted row first.
    """
    edge9 = G.EDGE_M / 7**0.5
    k = int((radius_m + 2 * edge9) / (1.5 * edge9))
    here = G.with_cell(sites, "lon", "lat", idx_of(F.col("city"), cities), {"_here": 9}, cities)
    ring = here.select(
        "site_id", "city", F.col("lon").alias("_slon"), F.col("lat").alias("_slat"),
        F.explode(G.cell_ring("_here", k)).alias("h3_9"),
    )
    # Only places in some site's ring are shuffled at all.
    near = places.join(ring.select("city", "h3_9").distinct(), ["city", "h3_9"], "left_semi")
    spots = near.groupBy("city", "h3_9", "category", "lon", "lat").agg(F.count("*").alias("_n"))
    return (
        ring.join(spots, ["city", "h3_9"])
        .withColumn("_d", geo.geo_distance_m("_slon", "_slat", "lon", "lat"))
        .where(F.col("_d") <= radius_m)
        .groupBy("site_id", "city", "category")
        .agg(F.sum("_n").alias("n_within"), F.min("_d").alias("nearest_m"))
    )
