"""Inputs in the engine's raw formats, derived by Spark from the generic test tables.

The test tables carry no coordinates, so points are spread over a city's box from their keys.
Row counts follow the source tables: places from customers, population and addresses from orders,
buildings and segments from line items, saved sites from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitehex.cities import CITIES, anchor, name_of
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.operators.trend import momentum_rollup
from sitehex.sources.demand import address_density, capacity_rollup
from sitehex.sources.history import ingest_history
from sitehex.sources.places import ingest_places, with_cells
from sitehex.sources.population import ingest_population
from sitehex.sources.reach import ingest_contours, ingest_edges
from sitehex.tables import Tables

# Trades the surrogate places are given.
TRADES = (
    "bakery", "cafe", "restaurant", "supermarket", "coffee_shop", "bar", "pharmacy", "gym", "hair_salon",
    "clothing_store", "hotel", "kindergarten", "elementary_school", "art_gallery", "doctor", "dentist",
    "beauty_salon", "park", "physical_therapy", "bank_credit_union",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _limit(idx: Column, attr: str) -> Column:
    return anchor(idx, attr)


def tri(key: str, a: int, b: int) -> Column:
    """Key-derived position in [0, 1), dense in the middle."""
    return F.expr(
        f"(cast(({key} * {a} + 7) % 65521 as double) + cast(({key} * {b} + 11) % 65521 as double)) / double(131042)"
    )


def spread(df: DataFrame, key: str, idx: Column, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Add ``idx, city, lon, lat`` for a point inside the city with that index."""
    return (
        df.withColumn("idx", idx.cast("bigint"))
        .withColumn("city", name_of(F.col("idx")))
        .withColumn("lon", _limit(F.col("idx"), "lon_min") + (_limit(F.col("idx"), "lon_max") - _limit(F.col("idx"), "lon_min")) * tri(key, *x))
        .withColumn("lat", _limit(F.col("idx"), "lat_min") + (_limit(F.col("idx"), "lat_max") - _limit(F.col("idx"), "lat_min")) * tri(key, *y))
    )


def sealed(df: DataFrame) -> DataFrame:
    """Make derived rows behave like a stored file: predicates stop here instead of being rewritten
    through the arithmetic that made the columns (a stored table has its columns ready)."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _point() -> Column:
    return F.struct("lon", "lat").alias("geometry")


def _box(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    return F.struct(
        xmin.cast("float").alias("xmin"), xmax.cast("float").alias("xmax"),
        ymin.cast("float").alias("ymin"), ymax.cast("float").alias("ymax"),
    ).alias("bbox")


def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    df = spread(read(spark, sf_dir, "customer"), "c_custkey", F.col("c_nationkey") % 3, (48271, 30269), (16807, 40692))
    df = df.withColumn("lon", F.col("lon") + F.when(k % 41 == 0, 10.0).otherwise(0.0))
    m = k % 31
    trade = _pick(TRADES, F.when(m >= 20, (m - 20) % 4).otherwise(m))
    status = F.when(k % 53 == 0, "closed").when(k % 7 != 0, "open")
    return sealed(
        df.select(
            k.cast("string").alias("id"),
            F.struct(F.when(k % 29 != 0, F.col("c_name")).alias("primary")).alias("names"),
            F.struct(F.when(k % 97 != 0, trade).alias("primary")).alias("categories"),
            F.when(k % 89 != 0, (F.lit(37) + (k * 37) % 100) / 100.0).alias("confidence"),
            status.alias("operating_status"),
            _point(),
            _box(F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat")),
        )
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_places(raw_places(spark, sf_dir))


def raw_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(read(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey") % 3, (48271, 39373), (16807, 33614))
    per_cell = G.with_cell(df, "lon", "lat", "idx", {"cell": 8}).groupBy("idx", "cell").agg(
        F.sum(F.lit(20) + F.col("o_orderkey") % 181).alias("people"),
        F.count("*").alias("n"),
        F.min("o_orderkey").alias("k"),
    )
    empty = (F.col("n") == 1) & (F.col("k") % 5 == 0)
    return sealed(
        per_cell.select(
            G.cell_to_string("cell").alias("h3"),
            F.when(empty, 0).otherwise(F.col("people")).cast("float").alias("population"),
            _pick([c.country for c in CITIES], F.col("idx")).alias("country"),
        )
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_population(raw_population(spark, sf_dir))


def _lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_suppkey") % 3, (48271, 39373), (16807, 33614))


def _storeys() -> tuple[Column, Column]:
    floors = F.when(F.col("l_linenumber") % 4 == 0, F.col("l_quantity").cast("int")).alias("num_floors")
    height = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("height")
    return height, floors


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested footprints with a known area, for the rollup and everything above it."""
    height, floors = _storeys()
    df = _lineitem_points(spark, sf_dir)
    flat = df.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("id"),
        "city", "lon", "lat", height, floors, (F.col("l_extendedprice") / 100.0).alias("area_m2"),
        F.col("l_returnflag").alias("subtype"),
    )
    return sealed(
        with_cells(flat)
    )


def raw_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints as geometry: a square per line item, with a courtyard for some, a wing for others."""
    height, floors = _storeys()
    mx = _limit(F.col("idx"), "metres_per_deg_lon")
    side = F.sqrt(F.col("l_extendedprice") / 100.0)
    df = _lineitem_points(spark, sf_dir).withColumn("dx", side / 2 / mx).withColumn("dy", side / 2 / G.M_PER_DEG_LAT)

    def square(scale: float, shift: float = 0.0) -> Column:
        def at(sx, sy):
            return F.struct(
                (F.col("lon") + F.col("dx") * (sx * scale + shift)).alias("lon"),
                (F.col("lat") + F.col("dy") * sy * scale).alias("lat"),
            )

        return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))

    plain = F.array(F.array(square(1.0)))
    courtyard = F.array(F.array(square(1.0), square(0.5)))
    wing = F.array(F.array(square(1.0)), F.array(square(0.5, 3.0)))
    shape = F.when(F.col("l_linenumber") == 1, courtyard).when(F.col("l_linenumber") == 2, wing).otherwise(plain)
    return sealed(
        df.select(
            F.when(F.col("l_partkey") % 17 != 0, F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber")).alias("id"),
            height, floors,
            F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("subtype"),
            shape.alias("geometry"),
            _box(F.col("lon") - F.col("dx"), F.col("lon") + F.col("dx"), F.col("lat") - F.col("dy"), F.col("lat") + F.col("dy")),
        )
    )


def cell_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity_rollup(buildings(spark, sf_dir))


def raw_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(read(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey") % 3, (40014, 39373), (16807, 40692))
    return sealed(
        df.select(_point(), _box(F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat")))
    )


def addr_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_density(raw_addresses(spark, sf_dir))


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitehex.reference_data import ROAD_CLASSES, WALK_CLASSES

    half = F.col("l_quantity") / 100000.0
    classes = (*ROAD_CLASSES, *WALK_CLASSES, "raceway")
    return sealed(
        _lineitem_points(spark, sf_dir).select(
            F.when(F.col("l_linestatus") == "O", "road").otherwise("rail").alias("subtype"),
            _pick(classes, F.col("l_partkey") % len(classes)).alias("class"),
            _box(F.col("lon") - half, F.col("lon") + half, F.col("lat") - half, F.col("lat") + half),
        )
    )


def raw_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine localities per city on a grid that leaves a strip open, and macrohoods inside some.

    Every third macrohood has two parts, every fourth a hole; only belgrade carries English names.
    """
    n = F.col("n_nationkey").cast("bigint")
    base = (
        read(spark, sf_dir, "nation")
        .withColumn("idx", n % 3)
        .withColumn("slot", F.floor(n / 3))
        .withColumn("w", _limit(F.col("idx"), "lon_max") - _limit(F.col("idx"), "lon_min"))
        .withColumn("h", _limit(F.col("idx"), "lat_max") - _limit(F.col("idx"), "lat_min"))
        .withColumn("x0", _limit(F.col("idx"), "lon_min") + F.col("w") * (F.col("slot") % 3) * 0.3)
        .withColumn("y0", _limit(F.col("idx"), "lat_min") + F.col("h") * F.floor(F.col("slot") / 3) * 0.3)
    )

    def rect(fx0, fx1, fy0, fy1) -> Column:
        def at(fx, fy):
            return F.struct(
                (F.col("x0") + F.col("w") * 0.3 * fx).alias("lon"), (F.col("y0") + F.col("h") * 0.3 * fy).alias("lat")
            )

        return F.array(at(fx0, fy0), at(fx1, fy0), at(fx1, fy1), at(fx0, fy1), at(fx0, fy0))

    locality = F.array(F.array(rect(0.0, 1.0, 0.0, 1.0)))
    single = F.array(F.array(rect(0.2, 0.8, 0.2, 0.8)))
    holed = F.array(F.array(rect(0.1, 0.9, 0.1, 0.9), rect(0.4, 0.6, 0.4, 0.6)))
    double = F.array(F.array(rect(0.0, 0.4, 0.0, 0.4)), F.array(rect(0.6, 1.0, 0.6, 1.0)))
    english = F.when(F.col("idx") == 2, F.concat(F.lit("EN "), F.col("n_name")))

    def row(subtype: str, name: Column, shape: Column) -> DataFrame:
        box = geo.bbox_of(shape)
        return base.select(
            F.lit(subtype).alias("subtype"),
            F.struct(
                name.alias("primary"),
                F.when(english.isNotNull(), F.create_map(F.lit("en"), F.concat(F.lit("EN "), name))).alias("common"),
            ).alias("names"),
            shape.alias("geometry"),
            _box(box["xmin"] - 0.001, box["xmax"] + 0.001, box["ymin"] - 0.001, box["ymax"] + 0.001),
        )

    hood_shape = F.when(n % 3 == 0, double).when(n % 4 == 0, holed).otherwise(single)
    hoods = row("macrohood", F.concat(F.lit("Hood "), F.col("n_name")), hood_shape)
    return sealed(
        row("locality", F.col("n_name"), locality).unionByName(hoods)
    )


MINUTES = {5: 1, 10: 2, 15: 3}


def measured_origins(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    """Centre children of the measured cells, and one more child for a third of them.

    ``people`` is the stored population when it is already loaded (as for all reach inputs below).
    """
    people = population(spark, sf_dir) if people is None else people
    q, r = G.cell_q("h3_8"), G.cell_r("h3_8")
    measured = F.pmod((q + 5000) * 31 + (r + 5000) * 17, F.lit(100).cast("bigint")) >= 37
    centre = G.cell_to_center_child("h3_8", 9)
    extra = F.when(F.pmod(q + r, F.lit(3).cast("bigint")) == 0, centre + F.lit(G.Q_UNIT))
    return sealed(
        (
            people.where(measured)
            .select(
                F.explode(F.array_compact(F.array(centre, extra))).alias("origin_h3_9"),
                _pick([c.name for c in CITIES], G.cell_city_idx("h3_8")).alias("city"),
            )
        )
    )


def isochrone_cells(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    steps = [
        F.struct(F.lit(m).alias("minutes"), F.lit(dq * G.Q_UNIT + dr).cast("bigint").alias("delta"))
        for m, k in MINUTES.items()
        for dq, dr in G.disk_offsets(k)
    ]
    return (
        measured_origins(spark, sf_dir, people)
        .select("origin_h3_9", "city", F.inline(F.array(*steps)))
        .select("origin_h3_9", "minutes", (F.col("origin_h3_9") + F.col("delta")).alias("reachable_h3_9"), "city")
    )


HEX = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1), (1, 0))


def _at9(q: Column, r: Column, idx: Column) -> Column:
    return G._to_lonlat(q, r, 9, idx, CITIES)


def _json_point(p: Column) -> Column:
    return F.concat(F.lit("["), p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))


def raw_contours(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    """One document per origin: a hexagon outline per contour, two lobes for some origins."""
    q, r = G.cell_q("origin_h3_9").cast("double"), G.cell_r("origin_h3_9").cast("double")
    idx = G.cell_city_idx("origin_h3_9")

    corners = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in HEX])

    def outline(k: int, shift: int) -> Column:
        size = k + 0.6
        ring = F.transform(
            corners, lambda c: _json_point(_at9(q + shift + c["u"] * F.lit(size), r + c["v"] * F.lit(size), idx))
        )
        return F.concat(F.lit("[["), F.array_join(ring, ","), F.lit("]]"))

    def feature(m: int, k: int) -> Column:
        two = F.concat(F.lit('"MultiPolygon","coordinates":['), outline(k, 0), F.lit(","), outline(1, 8), F.lit("]"))
        one = F.concat(F.lit('"Polygon","coordinates":'), outline(k, 0))
        return F.concat(
            F.lit('{"type":"Feature","properties":{"contour":%d},"geometry":{"type":' % m),
            F.when(two_lobes(), two).otherwise(one),
            F.lit("}}"),
        )

    extras = F.lit(
        '{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[0.0,0.0]}},'
        '{"type":"Feature","properties":{"contour":20},"geometry":{"type":"Polygon","coordinates":[]}}'
    )
    body = F.concat(
        F.lit('{"type":"FeatureCollection","features":['),
        F.concat_ws(",", *[feature(m, k) for m, k in MINUTES.items()], extras),
        F.lit("]}"),
    )
    return sealed(
        measured_origins(spark, sf_dir, people).select("origin_h3_9", "city", body.alias("body"))
    )


def two_lobes() -> Column:
    q, r = G.cell_q("origin_h3_9"), G.cell_r("origin_h3_9")
    return F.pmod(q * 7 + r * 3, F.lit(40).cast("bigint")) == 0


def isochrones(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    return ingest_contours(raw_contours(spark, sf_dir, people))


def raw_edges(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    """One document per origin with a line to every cell up to three steps away."""
    q, r = G.cell_q("origin_h3_9"), G.cell_r("origin_h3_9")
    idx = G.cell_city_idx("origin_h3_9")
    here = _at9(q.cast("double"), r.cast("double"), idx)
    jitter = F.pmod(q * 13 + r * 7, F.lit(10).cast("bigint")) / 4.0

    offsets = F.array(
        *[
            F.struct(F.lit(dq).alias("u"), F.lit(dr).alias("v"), F.lit(float(max(abs(dq), abs(dr), abs(dq + dr)))).alias("k"))
            for dq, dr in G.disk_offsets(3)
            if (dq, dr) != (0, 0)
        ]
    )

    def line(o: Column) -> Column:
        there = _at9((q + o["u"]).cast("double"), (r + o["v"]).cast("double"), idx)
        return F.concat(
            F.lit('{"type":"Feature","properties":{"duration":'), (jitter + o["k"] * 170.0).cast("string"),
            F.lit(',"distance":'), (jitter + o["k"] * 230.0).cast("string"),
            F.lit('},"geometry":{"type":"LineString","coordinates":['),
            _json_point(here), F.lit(","), _json_point(there), F.lit("]}}"),
        )

    lines = F.array_join(F.transform(offsets, line), ",")
    extras = F.lit(
        '{"type":"Feature","properties":{"duration":1.0,"distance":1.0},"geometry":{"type":"Point","coordinates":[0.0,0.0]}},'
        '{"type":"Feature","properties":{"duration":99999.0,"distance":99999.0},"geometry":{"type":"LineString","coordinates":[[0.0,0.0]]}}'
    )
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", lines, extras), F.lit("]}"))
    return sealed(
        measured_origins(spark, sf_dir, people).select("origin_h3_9", "city", body.alias("body"))
    )


def isochrone_edges(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    return ingest_edges(raw_edges(spark, sf_dir, people))


HISTORY_TAG_OF = {
    "1-URGENT": "shop=bakery",
    "2-HIGH": "amenity=cafe",
    "3-MEDIUM": "amenity=restaurant",
    "4-NOT SPECIFIED": "shop=supermarket",
    "5-LOW": "tourism=hotel",
}


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative monthly order counts as fetched documents; one fetch failed, one series is short."""
    tag = F.lit(None).cast("string")
    for prio, t in HISTORY_TAG_OF.items():
        tag = F.when(F.col("o_orderpriority") == prio, t).otherwise(tag)
    monthly = (
        read(spark, sf_dir, "orders")
        .select(
            name_of(F.col("o_custkey") % 3).alias("city"), tag.alias("tag"),
            F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
        )
        .where(F.col("tag").isNotNull())
        .groupBy("city", "tag", "ym")
        .agg(F.count("*").alias("n"))
    )
    short = (F.col("city") == "amsterdam") & (F.col("tag") == "shop=supermarket") & (F.col("ym") > "1995-08")
    # Months are few, so the running total over one series is a short window.
    from pyspark.sql import Window

    w = Window.partitionBy("city", "tag").orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)
    series = monthly.where(~short).withColumn("value", F.sum("n").over(w).cast("double"))
    entry = F.struct(F.concat(F.col("ym"), F.lit("-01T00:00:00Z")).alias("timestamp"), "value")
    docs = series.groupBy("city", "tag").agg(F.array_sort(F.collect_list(entry)).alias("result"))
    failed = (F.col("city") == "belgrade") & (F.col("tag") == "tourism=hotel")
    return sealed(
        docs.select(
            "city", "tag", F.when(failed, F.lit("502 Bad Gateway")).otherwise(F.to_json(F.struct("result"))).alias("body")
        )
    )


def poi_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_history(raw_history(spark, sf_dir))


BUSINESS = ("bakery", "cafe", "food and drink")


def saved_events(events: DataFrame) -> DataFrame:
    """Saved-site versions out of an events table or stream (row-wise, so it works on both)."""
    u = F.col("user_id")
    df = spread(
        events.where(F.col("event_type").isin("signup", "purchase")), "user_id", u % 3, (48271, 39373), (16807, 33614)
    )
    df = df.withColumn("lon", F.col("lon") + F.when(u % 11 == 0, 0.8).otherwise(0.0))
    df = G.with_cell(df, "lon", "lat", "idx", {"cell": 8})
    return df.select(
        u.cast("string").alias("id"),
        F.concat(F.lit("u"), (u % 20).cast("string")).alias("user_id"),
        "city",
        _pick(BUSINESS, F.floor(u / 3) % 3).alias("business_type"),
        F.concat(F.lit("site "), F.col("event_id").cast("string")).alias("label"),
        F.lit("").alias("note"),
        "lon", "lat",
        G.cell_to_string("cell").alias("h3_8"),
        F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") / 6.0, 4)).alias("score"),
        F.when(F.col("event_id") % 3 == 0, "shortlisted").otherwise("candidate").alias("status"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def saved_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved_events(read(spark, sf_dir, "events"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(read(spark, sf_dir, "supplier"), "s_suppkey", F.col("s_suppkey") % 3, (48271, 39373), (16807, 33614))
    return sealed(
        df.select(F.col("s_suppkey").alias("click_id"), "city", "lon", "lat")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") * 31 + F.col("turn") * 17) % 6
    assistant = F.col("role") == "assistant"
    return sealed(
        read(spark, sf_dir, "conversations").select(
            "conv_id", "turn", "role", "text",
            F.when(assistant & (k == 0), "picks").when(assistant & (k == 1), "competitors").alias("layer"),
            F.when(assistant & (k == 2), "setLayer").alias("tool"),
        )
    )


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitehex.sources.divisions import ingest_divisions

    return ingest_divisions(raw_divisions(spark, sf_dir))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitehex.operators.districts import district_resolution

    return district_resolution(population(spark, sf_dir), divisions(spark, sf_dir))


def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum_rollup(poi_history(spark, sf_dir))


def market_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables the scored surface reads."""
    return Tables(
        places=places(spark, sf_dir),
        population=population(spark, sf_dir),
        cell_capacity=cell_capacity(spark, sf_dir),
        addr_density=addr_density(spark, sf_dir),
        isochrone_cells=isochrone_cells(spark, sf_dir),
    )
