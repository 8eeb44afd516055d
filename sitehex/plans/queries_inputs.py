"""Queries over the grid, geometry and loaders; they run on the raw input tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sitehex.cities import CITIES
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.operators import affinity as aff
from sitehex.operators import catchment as cat
from sitehex.operators import quality as qc
from sitehex.operators.atscale import cut_lineage, new_folder
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W
from sitehex.plans.oracle import centre, d, geo_distance, pack, parent_q, parent_r, pick, q_of, quoted, r_of, with_cell
from sitehex.plans.registry import query
from sitehex.reference_data import ROAD_CLASSES, WALK_CLASSES
from sitehex.sources.layout import space_filling
from sitehex.sources import demand, layer_store, parameters, publish, saved
from sitehex.sources import places as src_places

# ---- grid -----------------------------------------------------------------------------------


@query(
    "grid_cell_ids",
    "select id, city, h3_8, h3_9, printf('%x', h3_8) as text8, h3_8 as back from places",
)
def grid_cell_ids(spark, sf):
    text = G.cell_to_string("h3_8")
    return S.places(spark, sf).select(
        "id", "city", "h3_8", "h3_9", text.alias("text8"), G.cell_from_string(text).alias("back")
    )


@query(
    "grid_parents",
    f"select distinct reachable_h3_9 as cell, {pack('idx', 8, parent_q('rq', 'rr'), parent_r('rq', 'rr'))} as parent from reach",
)
def grid_parents(spark, sf):
    cells = W.stored(spark, sf, "isochrone_cells").select(F.col("reachable_h3_9").alias("cell")).distinct()
    return cells.withColumn("parent", G.cell_to_parent("cell", 8))


@query(
    "grid_children",
    f"select cell, {pack('idx', 9, '2*q-r+dq', 'q+3*r+dr')} as child, dq=0 and dr=0 as is_center from population, ring1",
)
def grid_children(spark, sf):
    cells = S.population(spark, sf).select(F.col("h3_8").alias("cell"))
    kids = cells.select("cell", F.explode(G.cell_to_children("cell", 9)).alias("child"))
    return kids.withColumn("is_center", G.cell_to_center_child("cell", 9) == F.col("child"))


@query(
    "grid_rings",
    f"select p.cell, cast(m.k as integer) as k, {pack('p.idx', 8, 'p.q+a.dq', 'p.r+b.dr')} as neighbour from population p, "
    "(values (1),(2)) m(k), range(-2,3) a(dq), range(-2,3) b(dr) where greatest(abs(dq),abs(dr),abs(dq+dr))<=m.k",
)
def grid_rings(spark, sf):
    cells = S.population(spark, sf).select(F.col("h3_8").alias("cell"))
    one = cells.select("cell", F.lit(1).alias("k"), F.explode(G.cell_ring("cell", 1)).alias("neighbour"))
    two = cells.select("cell", F.lit(2).alias("k"), F.explode(G.cell_ring("cell", 2)).alias("neighbour"))
    return one.unionAll(two)


_vlon, _vlat = centre(f"(q+{d(1 / 3)})", f"(r+{d(1 / 3)})")


@query(
    "grid_outlines",
    f"select cell, round(clon,6) as lon, round(clat,6) as lat, cast(7 as integer) as vertices, round({_vlon},6) as first_lon, "
    f"round({_vlat},6) as first_lat, true as closed from placed",
)
def grid_outlines(spark, sf):
    ring = G.cell_boundary("cell", 8)
    return (
        S.population(spark, sf)
        .select(F.col("h3_8").alias("cell"))
        .withColumn("_at", G.cell_center("cell", 8))
        .withColumn("_ring", ring)
        .select(
            "cell", F.round("_at.lon", 6).alias("lon"), F.round("_at.lat", 6).alias("lat"),
            F.size("_ring").alias("vertices"),
            F.round(F.get("_ring", F.lit(0))["lon"], 6).alias("first_lon"),
            F.round(F.get("_ring", F.lit(0))["lat"], 6).alias("first_lat"),
            (F.get("_ring", F.lit(0)) == F.get("_ring", F.lit(6))).alias("closed"),
        )
    )


_digits = " | ".join(f"(((o_orderkey//{7**i})%7) << {3 * (15 - 8 + i)})" for i in range(8))
_h3 = f"((1::bigint<<59) | (8::bigint<<52) | ((o_orderkey%122)<<45) | {_digits} | 2097151)"


@query(
    "grid_h3_ids",
    f"select h3, printf('%x', h3) as text, (h3 & ~(15::bigint<<52) & 9223372036854775807 | (7::bigint<<52)) | 16777215 as parent7, "
    "(h3 & ~(15::bigint<<52) | (9::bigint<<52)) & ~(7::bigint<<18) as centre9, "
    "((h3 & ~(15::bigint<<52) | (9::bigint<<52)) & ~(7::bigint<<18)) + 6*(1<<18) as last_child9 from "
    f"(select {_h3} as h3 from orders)",
)
def grid_h3_ids(spark, sf):
    digits = " | ".join(f"shiftleft((o_orderkey div {7**i}) % 7, {3 * (15 - 8 + i)})" for i in range(8))
    h3 = F.expr(f"shiftleft(1L, 59) | shiftleft(8L, 52) | shiftleft(o_orderkey % 122, 45) | {digits} | 2097151L")
    return S.read(spark, sf, "orders").select(h3.alias("h3")).select(
        "h3",
        G.cell_to_string("h3").alias("text"),
        G.cell_to_parent("h3", 7, grid="h3").alias("parent7"),
        G.cell_to_center_child("h3", 9, grid="h3").alias("centre9"),
        F.get(G.cell_to_children("h3", 9, grid="h3"), F.lit(6)).alias("last_child9"),
    )


_morton_bits = " + ".join(f"((mx31 >> {i}) & 1) * {1 << (2 * i)} + ((my31 >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(31))


@query(
    "grid_mercator_morton",
    "select id, mercator_x, mercator_y, cast("
    + _morton_bits
    + " as bigint) as zkey from (select *, mercator_x >> 1 as mx31, mercator_y >> 1 as my31 from (select id, "
    "cast(floor(cast(4294967295 as double)*((lon+180)/360)) as bigint) as mercator_x, "
    "cast(floor(cast(4294967295 as double)*(cast(0.5 as double)-ln(tan((lat+90)/360*pi()))/pi()/2)) as bigint) as mercator_y from places))",
)
def grid_mercator_morton(spark, sf):
    return S.places(spark, sf).select(
        "id", G.mercator_x("lon").alias("mercator_x"), G.mercator_y("lat").alias("mercator_y"),
        space_filling().alias("zkey"),
    )


_c8lon, _c8lat = centre("q", "r")


@query(
    "geometry_distances",
    f"select id, round(12742014.36*asin(sqrt(power(sin(radians(clat-lat)/2),2)+cos(radians(lat))*cos(radians(clat))*power(sin(radians(clon-lon)/2),2))),3) "
    f"as great_circle, round({geo_distance('lon', 'lat', 'clon', 'clat')},3) as ellipsoidal from "
    f"(select *, {_c8lon} as clon, {_c8lat} as clat from (select *, {q_of('h3_8')} as q, {r_of('h3_8')} as r from places))",
)
def geometry_distances(spark, sf):
    df = S.places(spark, sf).withColumn("_at", G.cell_center("h3_8", 8))
    args = ("lon", "lat", F.col("_at.lon"), F.col("_at.lat"))
    return df.select(
        "id",
        F.round(geo.great_circle_m(*args), 3).alias("great_circle"),
        F.round(geo.geo_distance_m(*args), 3).alias("ellipsoidal"),
    )


# ---- loaders --------------------------------------------------------------------------------


@query("ingest_places", "select id, name, category, confidence, lon, lat, city, h3_8, h3_9 from places")
def ingest_places(spark, sf):
    return S.places(spark, sf)


@query("ingest_population", "select cell as h3_8, cast(population as float) as population, country from population")
def ingest_population(spark, sf):
    return S.population(spark, sf)


_unit = f"{d(6371007.18)}*{d(6371007.18)}"


def _square_area(x: str, y: str, w: str, h: str) -> str:
    """Spherical area of the axis-parallel rectangle around (x, y)."""
    def t(v):
        return f"tan(radians({v})/2)"

    half = f"tan(radians(2*({w}))/2)"
    return (
        f"abs(2*atan2({half}*2*{t(f'{y}-({h})')},1+{t(f'{y}-({h})')}*{t(f'{y}-({h})')}) "
        f"- 2*atan2({half}*2*{t(f'{y}+({h})')},1+{t(f'{y}+({h})')}*{t(f'{y}+({h})')}))*{_unit}"
    )


@query(
    "ingest_buildings",
    "select city, h3_8, count(*) as buildings, count(height) as with_height, count(num_floors) as with_floors, "
    "count(*) filter (where no_id) as without_id, cast(round(sum(area_m2)) as bigint) as area_m2 from (select *, "
    f"{_square_area('lon', 'lat', 'dx', 'dy')} as a1, {_square_area('lon', 'lat', 'dx*0.5', 'dy*0.5')} as a2, "
    "case l_linenumber when 1 then a1-a2 when 2 then a1+a2 else a1 end as area_m2 from bcells) group by city, h3_8".replace(
        "bcells",
        "(" + with_cell("(select r.*, (xmin+xmax)/2 as blon, (ymin+ymax)/2 as blat from (select b.l_partkey%17=0 as no_id, b.l_linenumber, b.lon, b.lat, b.dx, b.dy, "
        "case when l_linenumber%2=0 then l_quantity end as height, case when l_linenumber%4=0 then l_quantity end as num_floors, "
        "cast(cast(b.lon-b.dx as float) as double) as xmin, cast(cast(b.lon+b.dx as float) as double) as xmax, "
        "cast(cast(b.lat-b.dy as float) as double) as ymin, cast(cast(b.lat+b.dy as float) as double) as ymax, c.* from "
        "(select *, sqrt(l_extendedprice/100)/2/mx as dx, sqrt(l_extendedprice/100)/2/cast(111194.9 as double) as dy from "
        "(select * exclude (idx, city, country, lon0, lat0), from buildings_at)) b join cities c on "
        "cast(cast(b.lon-b.dx as float) as double) between c.lon_min and c.lon_max and cast(cast(b.lat-b.dy as float) as double) between c.lat_min and c.lat_max) r)",
        {"h3_8": 8}, "blon", "blat") + ")",
    ),
)
def ingest_buildings(spark, sf):
    df = demand.ingest_buildings(S.raw_buildings(spark, sf))
    return df.groupBy("city", "h3_8").agg(
        F.count("*").alias("buildings"), F.count("height").alias("with_height"),
        F.count("num_floors").alias("with_floors"), F.count_if(F.col("id") == "").alias("without_id"),
        F.round(F.sum("area_m2")).cast("bigint").alias("area_m2"),
    )


@query("capacity_rollup", "select city, h3_8, floor_area_m2, buildings from cell_capacity")
def capacity_rollup(spark, sf):
    return S.cell_capacity(spark, sf)


@query("address_density", "select city, h3_8, addr_count from addr_density")
def address_density(spark, sf):
    return S.addr_density(spark, sf)


_classes = pick((*ROAD_CLASSES, *WALK_CLASSES, "raceway"), "l_partkey%16")
_half = "l_quantity/cast(100000 as double)"


def _corner(v: str, sign: str) -> str:
    return f"cast(cast({v}{sign}{_half} as float) as double)"


@query(
    "road_density",
    "select city, h3_8, count(*) as seg_count, "
    f"cast(round(coalesce(sum(floor(len*1000+0.5)) filter (where class in ({quoted(ROAD_CLASSES)})),0)/1000) as bigint) as road_len_m, "
    f"cast(round(coalesce(sum(floor(len*1000+0.5)) filter (where class in ({quoted(WALK_CLASSES)})),0)/1000) as bigint) as walk_len_m from (select *, "
    "12742014.36*asin(sqrt(power(sin(radians(ymax-ymin)/2),2)+cos(radians(ymin))*cos(radians(ymax))*power(sin(radians(xmax-xmin)/2),2))) as len from ("
    + with_cell(
        f"(select s.*, c.idx, c.city, c.lon0, c.lat0, c.mx, (xmin+xmax)/2 as blon, (ymin+ymax)/2 as blat from (select {_classes} as class, "
        f"{_corner('lon', '-')} as xmin, {_corner('lon', '+')} as xmax, {_corner('lat', '-')} as ymin, {_corner('lat', '+')} as ymax "
        "from buildings_at where l_linestatus='O') s join cities c on xmin between c.lon_min and c.lon_max and ymin between c.lat_min and c.lat_max)",
        {"h3_8": 8}, "blon", "blat",
    )
    + ")) group by city, h3_8",
)
def road_density(spark, sf):
    df = demand.road_density(S.raw_segments(spark, sf))
    return df.select(
        "city", "h3_8", "seg_count",
        F.round("road_len_m").cast("bigint").alias("road_len_m"),
        F.round("walk_len_m").cast("bigint").alias("walk_len_m"),
    )


@query(
    "ingest_divisions",
    "select v.subtype, v.nm, cast(round(a.poly_area/1000) as bigint) as area_k from divs v join div_areas a on a.subtype=v.subtype and a.nm=v.nm",
)
def ingest_divisions(spark, sf):
    return S.divisions(spark, sf).select(
        "subtype", "nm", F.round(F.col("poly_area") / 1000).cast("bigint").alias("area_k")
    )


_two = "(((oq*7+orr*3)%40)+40)%40=0"


@query(
    "ingest_contours",
    "select origin_h3_9, cast(minutes as integer) as minutes, city, case when two then 2 else 1 end::bigint as lobes, "
    "case when two then 14 else 7 end::bigint as vertices from "
    f"(select o.origin_h3_9, o.city, m.minutes, {_two} as two from origins o, (values (5),(10),(15)) m(minutes))",
)
def ingest_contours(spark, sf):
    rings = geo.parse_polygon_coordinates("geojson")
    return (
        S.isochrones(spark, sf)
        .withColumn("_n", F.size(F.get(rings, F.lit(0))))
        .groupBy("origin_h3_9", "minutes", "city")
        .agg(F.count("*").alias("lobes"), F.sum("_n").alias("vertices"))
    )


@query(
    "derive_reach_cells",
    f"select distinct origin_h3_9, cast(minutes as integer) as minutes, city, {pack('idx', 9, 'rq', 'rr')} as reachable_h3_9 from ("
    "select origin_h3_9, minutes, city, idx, rq, rr from reach union all "
    f"select o.origin_h3_9, m.minutes, o.city, o.idx, o.oq+8+k.dq, o.orr+k.dr from origins o, ring1 k, (values (5),(10),(15)) m(minutes) where {_two})",
)
def derive_reach_cells(spark, sf):
    return cat.derive_reach_cells(W.stored(spark, sf, "isochrones"))


_kk = "greatest(abs(dq),abs(dr),abs(dq+dr))"
_jit = "((((oq*13+orr*7)%10)+10)%10)/cast(4 as double)"


@query(
    "ingest_edges",
    f"select origin_h3_9, city, cast(round_even({_jit}+170*{_kk},0) as integer) as duration_s, "
    f"cast(round_even({_jit}+230*{_kk},0) as integer) as dist_m, round_even(hlon,5) as lon, round_even(hlat,5) as lat from (select *, "
    f"{centre('oq', 'orr', 9)[0]} as hlon, {centre('oq', 'orr', 9)[1]} as hlat from reach where minutes=15 and not (rq=oq and rr=orr)) t, "
    "(select 1) one".replace("from reach where", "from (select *, rq-oq as dq, rr-orr as dr from reach) where"),
)
def ingest_edges(spark, sf):
    first = F.get(F.from_json("geom", "array<array<double>>"), F.lit(0))
    return S.isochrone_edges(spark, sf).select(
        "origin_h3_9", "city", "duration_s", "dist_m",
        F.get(first, F.lit(0)).alias("lon"), F.get(first, F.lit(1)).alias("lat"),
    )


@query(
    "candidate_origins",
    f"select distinct city, {pack('idx', 9, '2*q-r+dq', 'q+3*r+dr')} as h3_9, round({centre('(2*q-r+dq)', '(q+3*r+dr)', 9)[0]},6) as lon, "
    f"round({centre('(2*q-r+dq)', '(q+3*r+dr)', 9)[1]},6) as lat from cells, ring1",
)
def candidate_origins(spark, sf):
    return cat.candidate_origins(S.population(spark, sf)).select(
        "city", "h3_9", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")
    )


@query("ingest_history", "select city, category, month, count from poi_history")
def ingest_history(spark, sf):
    return S.poi_history(spark, sf)


@query(
    "affinity_lookup",
    "select p.id, t.target, p.category, coalesce(a.weight,0) as weight from places p, (values ('cafe'),('hotel')) t(target) "
    "left join affinity a on a.target=t.target and a.neighbor=p.category",
)
def affinity_lookup(spark, sf):
    pairs = S.places(spark, sf).select("id", "category", F.explode(F.array(F.lit("cafe"), F.lit("hotel"))).alias("target"))
    return aff.lookup_weight(pairs).select("id", "target", "category", "weight")


# ---- sinks ----------------------------------------------------------------------------------


@query(
    "append_saved_site",
    "select city, business_type, count(*) as rows, count(score) as scored, count(*) as candidates, count(*) as dated from saved_sites group by 1,2",
)
def append_saved_site(spark, sf):
    root = new_folder(spark, "saved")
    rows = S.saved_sites(spark, sf).drop("status", "note", "created_at", "updated_at")
    saved.append_saved_site(rows.where(F.col("user_id") <= "u15"), root)
    saved.append_saved_site(rows.where(F.col("user_id") > "u15"), root)
    return (
        spark.read.parquet(root)
        .groupBy("city", "business_type")
        .agg(
            F.count("*").alias("rows"), F.count("score").alias("scored"),
            F.count_if(F.col("status") == "candidate").alias("candidates"), F.count("created_at").alias("dated"),
        )
    )


@query(
    "replace_partition",
    "select city, count(*) as cells, cast(sum(addr_count) as bigint) as addresses from addr_density where city<>'belgrade' group by city",
)
def replace_partition(spark, sf):
    """Load all cities, reload two of them, and reload the third without rows."""
    root = new_folder(spark, "table")
    table = W.stored(spark, sf, "addr_density")
    names = [c.name for c in CITIES]
    publish.replace_partition(table, root, "city", names)
    publish.replace_partition(table, root, "city", names[:2])
    publish.replace_partition(table.where(F.col("city") != "belgrade"), root, "city", ["belgrade"])
    return spark.read.parquet(root).groupBy("city").agg(
        F.count("*").alias("cells"), F.sum("addr_count").alias("addresses")
    )


@query(
    "load_verified",
    "select city, count(*) as cells, true as rejected_bad_load from reach group by city",
)
def load_verified(spark, sf):
    """Publish reach cells through their checks; a shifted copy of the load must be refused."""
    root = new_folder(spark, "table")
    reach = W.stored(spark, sf, "isochrone_cells")
    names = [c.name for c in CITIES]
    checks = [qc.reach_inside_box, qc.origin_in_own_reach, qc.reach_nested]
    publish.load_verified(reach, root, "city", names, checks)
    shifted = reach.withColumn("origin_h3_9", F.col("origin_h3_9") + 4 * G.Q_UNIT)
    try:
        publish.load_verified(shifted, root, "city", names, checks)
        refused = False
    except publish.CheckFailed:
        refused = True
    return spark.read.parquet(root).groupBy("city").agg(F.count("*").alias("cells")).withColumn(
        "rejected_bad_load", F.lit(refused)
    )


@query(
    "delete_rows",
    "select city, count(*) as places from places where category<>'park' group by city",
)
def delete_rows(spark, sf):
    root = new_folder(spark, "table")
    W.stored(spark, sf, "places").write.partitionBy("city").parquet(root)
    publish.delete_rows(spark, root, "city", [c.name for c in CITIES], F.col("category") == "park")
    return spark.read.parquet(root).groupBy("city").agg(F.count("*").alias("places"))


_feature = (
    "'{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":['||round_even(lon,5)||','||round_even(lat,5)"
    "||']},\"properties\":{\"n\":\"'||name||'\"}}'"
)


def _layer_features(spark, sf):
    feature = geo.feature_json(geo.point_geometry("lon", "lat"), F.struct(F.col("name").alias("n")))
    return W.stored(spark, sf, "places").select(
        F.concat_ws("/", "city", "category").alias("layer"), "id", feature.alias("feature")
    )


@query(
    "layer_routes",
    "select layer, count(*) as features, cast(sum(strlen(f))+count(*)-1+42 as bigint) as bytes, "
    "case when sum(strlen(f))+count(*)-1+42<=4096 then 'inline' else 'handle' end as route from "
    f"(select city||'/'||category as layer, {_feature} as f from places) group by layer",
)
def layer_routes(spark, sf):
    return layer_store.route_by_bytes(_layer_features(spark, sf), budget=4096)


@query(
    "layer_documents",
    "select layer, cast(sum(strlen(f))+count(*)-1+42 as bigint) as bytes, cast(count(*) as integer) as features, "
    "'{\"type\":\"FeatureCollection\",\"features\":['||string_agg(f, ',' order by id)||']}' as body from "
    f"(select city||'/'||category as layer, id, {_feature} as f from places) group by layer having sum(strlen(f))+count(*)-1+42<=262144",
)
def layer_documents(spark, sf):
    return layer_store.feature_collections(_layer_features(spark, sf), "id")


@query(
    "layer_emit",
    "select layer, case when bytes<=4096 then 'inline' else 'handle' end as route, features, bytes, content, "
    "case when bytes<=4096 then body end as body, case when bytes>4096 then features end as stored, case when bytes>4096 then lines end as lines from "
    "(select layer, count(*) as features, cast(sum(strlen(f))+count(*)-1+42 as bigint) as bytes, "
    "cast(sum(cast('0x'||substr(md5(f),1,8) as bigint)) as bigint) as content, "
    "cast(sum(cast('0x'||substr(md5(pos||':'||f),1,8) as bigint)) as bigint) as lines, "
    "'{\"type\":\"FeatureCollection\",\"features\":['||string_agg(f, ',' order by id)||']}' as body from "
    f"(select *, row_number() over (partition by layer order by id, f)-1 as pos from (select city||'/'||category as layer, id, {_feature} as f from places)) group by layer)",
)
def layer_emit(spark, sf):
    """Every layer at a small budget: its document, or the features found behind its handle and their order."""
    root = new_folder(spark, "layers")
    emitted = cut_lineage(layer_store.emit_layers(_layer_features(spark, sf), "id", root, budget=4096))
    line = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("at").cast("string"), "feature")), 1, 8), 16, 10).cast("bigint")
    stored = spark.read.schema(layer_store.LAYER_SCHEMA).parquet(root).groupBy("handle").agg(
        F.count("*").alias("stored"), F.sum(line).alias("lines")  # changes with the place of any line
    )
    return emitted.join(stored, "handle", "left").select("layer", "route", "features", "bytes", "content", "body", "stored", "lines")


@query(
    "layer_store",
    "select 'fresh' as age, count(*) as features from places union all select 'expired', 0 union all select 'cleaned', 1",
)
def layer_store_query(spark, sf):
    """Write a layer, read it inside and after its lifetime, then clean up."""
    root = new_folder(spark, "layers")
    now = dt.datetime(2026, 1, 1, 12, 0, tzinfo=dt.timezone.utc)
    handle = layer_store.write_layer(_layer_features(spark, sf), root, now)
    fresh = layer_store.read_layer(spark, root, handle, now + dt.timedelta(minutes=30))
    late = layer_store.read_layer(spark, root, handle, now + dt.timedelta(minutes=61))
    counted = fresh.agg(F.count("*").alias("features")).select(F.lit("fresh").alias("age"), "features").unionAll(
        late.agg(F.count("*").alias("features")).select(F.lit("expired").alias("age"), "features")
    )
    out = cut_lineage(counted)
    gone = layer_store.expire_layers(spark, root, now + dt.timedelta(hours=3))
    return out.unionAll(spark.range(1).select(F.lit("cleaned").alias("age"), F.lit(len(gone)).cast("bigint").alias("features")))


# ---- straight on the raw files --------------------------------------------------------------


@query(
    "raw_category_histogram",
    "select city, category, count(*) as n from raw_places_in group by 1,2",
)
def raw_category_histogram(spark, sf):
    return src_places.raw_category_histogram(S.raw_places(spark, sf)).orderBy("city", F.desc("n"), "category")


@query(
    "raw_cell_density",
    "select city, cell, count(*) as n from ("
    + with_cell("(select * from raw_places_in where category='bakery')", {"cell": 8})
    + ") group by 1,2",
)
def raw_cell_density(spark, sf):
    return src_places.raw_cell_density(S.raw_places(spark, sf), "bakery").orderBy("city", F.desc("n"), "cell")


_WORDS = ("Bakery ", "COFFEE", "food & drink", "Pizza", " hair salons", "gym", "hairdresser")
_TOWNS = ("Berlin", " amsterdam", "Paris", "BELGRADE ")


@query(
    "resolve_categories",
    "select c.c_custkey, c.word, coalesce(s.category, lower(trim(c.word))) as category, cast(coalesce(s.position,0) as integer) as position from "
    f"(select c_custkey, {pick(_WORDS, 'c_custkey%7')} as word from customer) c left join synonyms s on s.word=lower(trim(c.word))",
)
def resolve_categories(spark, sf):
    words = S.read(spark, sf, "customer").select("c_custkey", S._pick(_WORDS, F.col("c_custkey") % 7).alias("word"))
    return parameters.resolve_category_column(words).select("c_custkey", "word", "category", "position")


@query(
    "check_city",
    f"select c_custkey, city, case when k in ('berlin','amsterdam','belgrade') then k end as resolved_city, "
    "case when k not in ('berlin','amsterdam','belgrade') then 'unavailable' end as error, "
    "case when k not in ('berlin','amsterdam','belgrade') then 'berlin, amsterdam, belgrade' end as available from "
    f"(select c_custkey, {pick(_TOWNS, 'c_custkey%4')} as city, lower(trim({pick(_TOWNS, 'c_custkey%4')})) as k from customer)",
)
def check_city(spark, sf):
    towns = S.read(spark, sf, "customer").select("c_custkey", S._pick(_TOWNS, F.col("c_custkey") % 4).alias("city"))
    return parameters.check_city_column(towns)
