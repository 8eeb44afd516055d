"""Layer documents: small ones inline, large ones stored behind a handle that expires."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitehex.operators.atscale import cut_lineage, range_ranks
from sitehex.sources.layout import Layout, laid_out, writer
from sitehex.sources.publish import delete_path, list_folders

INLINE_BUDGET_BYTES = 256 * 1024
TTL_HOURS = 1

LAYOUT = Layout("created_hour", ("handle", "at"), ("handle",))

_OPEN = '{"type":"FeatureCollection","features":['
_CLOSE = "]}"


def route_by_bytes(features: DataFrame, budget: int = INLINE_BUDGET_BYTES) -> DataFrame:
    """Serialized size and route of every layer in ``(layer, feature)`` rows.

    The size is measured on the bytes themselves, never guessed from a row count.
    """
    size = F.sum(F.octet_length("feature").cast("bigint")) + F.count("*") - 1 + len(_OPEN) + len(_CLOSE)
    return (
        features.groupBy("layer")
        .agg(F.count("*").alias("features"), size.alias("bytes"))
        .withColumn("route", F.when(F.col("bytes") <= budget, "inline").otherwise("handle"))
    )


def feature_collections(features: DataFrame, order_by: str, budget: int = INLINE_BUDGET_BYTES) -> DataFrame:
    """One document per layer that fits the inline budget.

    Only layers measured to fit are assembled, so a document never exceeds the budget in memory.
    ``emit_layers`` stores the larger ones behind a handle.
    """
    small = route_by_bytes(features, budget).where(F.col("route") == "inline").select("layer", "bytes")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("k"), F.col("feature").alias("f"))))
    return (
        features.join(small, "layer")
        .groupBy("layer", "bytes")
        .agg(ordered.alias("_fs"))
        .select(
            "layer", "bytes", F.size("_fs").alias("features"),
            F.concat(F.lit(_OPEN), F.array_join(F.transform("_fs", lambda e: e["f"]), ","), F.lit(_CLOSE)).alias("body"),
        )
    )


def emit_layers(
    features: DataFrame, order_by: str, root: str, budget: int = INLINE_BUDGET_BYTES, now: dt.datetime | None = None
) -> DataFrame:
    """One row per layer of ``(layer, <order_by>, feature)``: a document, or a handle to its stored features.

    Columns: layer, route, features, bytes, rev, content, body (inline), handle (stored). ``rev`` is new for every
    emission, so that a reader sees that a layer was written again; ``content`` is equal for equal features. Layers above
    the budget are stored by one write, in their order, each behind a handle of its own.
    """
    now = now or dt.datetime.now(dt.timezone.utc)
    emission = uuid.uuid4().hex
    content = F.sum(F.conv(F.substring(F.md5("feature"), 1, 8), 16, 10).cast("bigint"))
    contents = features.groupBy("layer").agg(content.alias("content"))

    def of_emission(what: str):
        return F.md5(F.concat_ws("|", "layer", F.lit(what), F.lit(emission)))

    routes = cut_lineage(
        route_by_bytes(features, budget).join(contents, "layer")
        .withColumns({"rev": of_emission("rev"), "handle": F.when(F.col("route") == "handle", of_emission("handle"))})
    )
    large = features.join(routes.where(F.col("route") == "handle").select("layer", "handle"), "layer")
    _store(large.select("handle", F.col(order_by).alias("_k"), "feature"), root, now)
    documents = feature_collections(features, order_by, budget).select("layer", "body")
    return routes.join(documents, "layer", "left").select("layer", "route", "features", "bytes", "rev", "content", "body", "handle")


def _store(rows: DataFrame, root: str, now: dt.datetime) -> None:
    """Append ``(handle, _k, feature)`` with each feature's place in its layer, by ``_k`` and then the feature.

    Places come from range partitions, so a layer of any size is stored by as many tasks as it needs. Handles share files;
    Bloom filters find the ones of a handle.
    """
    placed = range_ranks(rows, ["handle"], ["_k", "feature"], "at").select("feature", "handle", "at")
    stamped = placed.withColumns({"created_at": F.lit(now), "created_hour": F.lit(now.strftime("%Y%m%d%H"))})
    writer(laid_out(stamped, LAYOUT), LAYOUT).mode("append").parquet(root)


def write_layer(features: DataFrame, root: str, now: dt.datetime | None = None, order_by: str | None = None) -> str:
    """Store one layer's features below a fresh handle and return the handle; without ``order_by`` in the order they come."""
    handle = uuid.uuid4().hex
    key = F.col(order_by) if order_by else F.monotonically_increasing_id()
    rows = cut_lineage(features.select(F.lit(handle).alias("handle"), key.alias("_k"), "feature"))
    _store(rows, root, now or dt.datetime.now(dt.timezone.utc))
    return handle


LAYER_SCHEMA = "feature string, handle string, at bigint, created_at timestamp, created_hour string"


def read_layer(spark: SparkSession, root: str, handle: str, now: dt.datetime | None = None) -> DataFrame:
    """Features behind a handle, in their order; expired ones are invisible even before clean-up removes them."""
    now = now or dt.datetime.now(dt.timezone.utc)
    alive = now - dt.timedelta(hours=TTL_HOURS)
    return (
        spark.read.schema(LAYER_SCHEMA)
        .parquet(root)
        .where((F.col("handle") == handle) & (F.col("created_hour") >= alive.strftime("%Y%m%d%H")))
        .where(F.col("created_at") > F.lit(alive))
        .orderBy("at")
        .select("feature")
    )


def write_lines(features: DataFrame, order_by: str, path: str) -> None:
    """A layer of any size as text, one feature a line, in order over the lines of all files by name."""
    ordered = features.repartitionByRange(order_by, "feature").sortWithinPartitions(order_by, "feature")
    ordered.select(F.col("feature").alias("value")).write.text(path)


def expire_layers(spark: SparkSession, root: str, now: dt.datetime | None = None) -> list[str]:
    """Drop whole hour folders in which every layer has expired."""
    now = now or dt.datetime.now(dt.timezone.utc)
    limit = (now - dt.timedelta(hours=TTL_HOURS)).strftime("%Y%m%d%H")
    gone = [f for f in list_folders(spark, root) if f.startswith("created_hour=") and f.split("=")[1] < limit]
    for f in gone:
        delete_path(spark, f"{root}/{f}")
    return gone
