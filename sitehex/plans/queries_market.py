"""Queries over the scored surface: signals, ranking, layers, catchments, districts, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitehex.cities import CITIES
from sitehex.functions import geometry as geo
from sitehex.functions.grid import CORNERS
from sitehex.functions.text import place_name
from sitehex.operators import affinity as aff
from sitehex.operators import catchment as cat
from sitehex.operators import coverage as cov
from sitehex.operators import districts as dis
from sitehex.operators import layers, ranking, scoring, surface, trend
from sitehex.operators.quality import PROBES
from sitehex.operators.ranking import LENSES, RankRequest
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W
from sitehex.plans.oracle import d, geo_distance, pack, q_of, quoted, r_of, weighted
from sitehex.plans.registry import query
from sitehex.reference_data import resolve_categories

FOOD = resolve_categories("food and drink")


def r6(name: str):
    return F.round(name, 6).alias(name)


# ---- signals and score ----------------------------------------------------------------------


@query("city_cells", "select city, cell, pop from cells")
def city_cells(spark, sf):
    return scoring.city_cells(W.stored(spark, sf, "population"))


@query("ring_supply", "select city, cell, n as sup from supply_food")
def ring_supply(spark, sf):
    return scoring.ring_supply(W.stored(spark, sf, "places"), FOOD)


@query("ring_supply_all_trades",
       f"select city, {pack('idx', 8, 'q+dq', 'r+dr')} as cell, count(*) as sup from (select city, idx, {q_of('h3_8')} as q, {r_of('h3_8')} as r from places), ring1 group by 1,2")
def ring_supply_all(spark, sf):
    return scoring.ring_supply(W.stored(spark, sf, "places"))


@query("demand_axes",
       "select coalesce(c.city,a.city) as city, coalesce(c.h3_8,a.h3_8) as cell, c.floor_area_m2 as cap_area, a.addr_count as addr_cnt "
       "from cell_capacity c full join addr_density a on a.city=c.city and a.h3_8=c.h3_8")
def demand_axes(spark, sf):
    cap = scoring.capacity(W.stored(spark, sf, "cell_capacity"))
    return cap.join(scoring.addresses(W.stored(spark, sf, "addr_density")), ["city", "cell"], "full")


@query("accessibility", "select city, cell, round(acc_pop,6) as acc_pop from acc")
def accessibility(spark, sf):
    return scoring.accessibility(W.stored(spark, sf, "isochrone_cells"), W.stored(spark, sf, "population")).select(
        "city", "cell", r6("acc_pop")
    )


@query("joined_signals", "select city, cell, pop, sup, cap_area, addr_cnt, round(acc_pop,6) as acc_pop from joined_food")
def joined_signals(spark, sf):
    return scoring.joined(W.market(spark, sf), FOOD).withColumn("acc_pop", r6("acc_pop"))


_P95 = "pop_p95 sup_p95 acc_p95 cap_p95 addr_p95".split()


@query("scale_p95", f"select city, {', '.join(f'round({c},6) as {c}' for c in _P95)} from scale_food")
def scale_p95(spark, sf):
    cells = scoring.joined(W.market(spark, sf), FOOD)
    return scoring.scale(cells).select("city", *[r6(c) for c in _P95])


_SCORE = "dem supply_n acc_n gap".split()


@query("scored_surface",
       f"select city, cell, pop, sup, addr_cnt, {', '.join(f'round({c},6) as {c}' for c in ['acc_pop', 'cap_area', *_SCORE])} from scored_food")
def scored_surface(spark, sf):
    return scoring.scored(W.market(spark, sf), FOOD).select(
        "city", "cell", "pop", "sup", "addr_cnt", *[r6(c) for c in ["acc_pop", "cap_area", *_SCORE]]
    )


@query("two_factor_gap",
       "select city, cell, pop, sup, round(least(100,100*pop/pop_p95)*(100-least(100,sup*cast(100 as double)/sup_p95))/100,6) as gap from "
       "joined_food join scale_food using (city)")
def two_factor_gap(spark, sf):
    return scoring.scored_two_factor(W.market(spark, sf), FOOD).select("city", "cell", "pop", "sup", r6("gap"))


@query("reweighted_scores",
       "select city, cell, " + ", ".join(f"round({weighted(scoring.exponents(w))},6) as w{i}" for i, w in enumerate((scoring.NEUTRAL, *PROBES))) + " from scored_food")
def reweighted_scores(spark, sf):
    df = W.surface(spark, sf, "food and drink")
    for i, w in enumerate((scoring.NEUTRAL, *PROBES)):
        df = scoring.reweight(df, w, f"w{i}")
    return df.select("city", "cell", *[r6(f"w{i}") for i in range(1 + len(PROBES))])


_HALF_UP = "floor({g}*10+0.5)/cast(10 as double)"


@query("display_gap", f"select city, cell, {_HALF_UP.format(g='round(' + weighted(scoring.exponents(PROBES[3])) + ',9)')} as gap_display from scored_food")
def display_gap(spark, sf):
    from sitehex.functions.text import half_up_1dp

    df = scoring.reweight(W.surface(spark, sf, "food and drink"), PROBES[3], "g")
    return df.select("city", "cell", half_up_1dp(F.round("g", 9)).alias("gap_display"))


# ---- surface read-outs ----------------------------------------------------------------------


@query("opportunity_rows",
       "select city, cell, round_even(round(gap,9),1) as gap, round(dem,6) as dem, round_even(pop,0) as pop, sup, round_even(acc_pop,0) as acc from scored_food")
def opportunity_rows(spark, sf):
    s = W.surface(spark, sf, "food and drink").withColumn("gap", F.round("gap", 9))
    return surface.opportunity_rows(s).withColumn("dem", F.round("dem", 6))


@query("opportunity_features")
def opportunity_features(spark, sf):
    return surface.opportunity_layer(W.surface(spark, sf, "food and drink"))


@query("opportunity_stats",
       "select s.city, count(*) as cell_count, round_even(max(gap),1) as top_gap, round_even(quantile_cont(gap,0.5),1) as median_gap, "
       "round(any_value(pop_p95),6) as pop_p95, round(any_value(sup_p95),6) as sup_p95, round(any_value(acc_p95),6) as acc_p95, "
       "count(*) filter (where acc_pop is null) as not_measured from scored_food s group by s.city")
def opportunity_stats(spark, sf):
    df = surface.opportunity_stats(W.surface(spark, sf, "food and drink"))
    return df.select("city", "cell_count", "top_gap", "median_gap", r6("pop_p95"), r6("sup_p95"), r6("acc_p95"), "not_measured")


def _extreme(which: str) -> str:
    g = _HALF_UP.format(g=f"round({weighted(scoring.exponents(PROBES[3]))},9)")
    sign = "desc" if which == "best" else "asc"
    return (
        f"select city, cell, {g} as score, '{which}' as kind from scored_food "
        f"qualify row_number() over (partition by city order by {g} {sign}, cell)=1"
    )


@query("extreme_cell_best", _extreme("best"))
def extreme_best(spark, sf):
    return surface.extreme_cell(W.surface(spark, sf, "food and drink"), "best", PROBES[3]).drop("lon", "lat")


@query("extreme_cell_worst", _extreme("worst"))
def extreme_worst(spark, sf):
    return surface.extreme_cell(W.surface(spark, sf, "food and drink"), "worst", PROBES[3]).drop("lon", "lat")


_NEUTRAL_SHOWN = _HALF_UP.format(g=weighted(scoring.exponents(scoring.NEUTRAL)))


@query("kpi_strip",
       f"select m.city, r.competitors, t.top_score, m.median_opportunity from (select city, quantile_cont({_NEUTRAL_SHOWN},0.5) as median_opportunity from scored_food group by city) m "
       f"left join (select city, count(*) as competitors from places where category in ({quoted(FOOD)}) group by city) r on r.city=m.city "
       f"left join (select city, {_NEUTRAL_SHOWN} as top_score from scored_food where acc_pop is not null qualify row_number() over (partition by city order by gap desc, pop desc, cell)=1) t on t.city=m.city")
def kpi_strip(spark, sf):
    s = W.surface(spark, sf, "food and drink")
    picks = ranking.rank_sites(s)
    return surface.kpi_strip(s, W.stored(spark, sf, "places"), picks, FOOD)


@query("reveal_order",
       "select layer, id, row_number() over (partition by layer order by dd, id)-1 as idx, round(dd/max(dd) over (partition by layer),6) as dist from ("
       "select p.layer, p.id, round(sqrt(power((p.lon-m.cx)*cos(radians(m.cy)),2)+power(p.lat-m.cy,2)),9) as dd from pts p join "
       "(select layer, sum(cast(floor(lon*100000+0.5) as bigint))/count(*)/100000 as cx, sum(cast(floor(lat*100000+0.5) as bigint))/count(*)/100000 as cy from pts group by layer) m on m.layer=p.layer)"
       .replace("pts p", "(select city as layer, id, round_even(lon,5) as lon, round_even(lat,5) as lat from places) p")
       .replace("from pts", "from (select city as layer, id, round_even(lon,5) as lon, round_even(lat,5) as lat from places)"))
def reveal_order(spark, sf):
    pts = W.stored(spark, sf, "places").select(
        F.col("city").alias("layer"), "id", geo.round5("lon").alias("lon"), geo.round5("lat").alias("lat")
    )
    return surface.reveal_order(pts, 3).withColumn("dist", F.round("dist", 6))


@query("sample_per_city",
       f"select city, id, name, lon, lat, round(clon,6) as cell_lon, round(clat,6) as cell_lat, round({geo_distance('lon', 'lat', 'clon', 'clat')},3) as drift_m from "
       f"(select *, lon0 + {d(531.0)}*({d(1.7320508075688772)}*q+{d(0.8660254037844386)}*r)/mx as clon, lat0 + {d(531.0)}*{d(1.5)}*r/{d(111194.9)} as clat from "
       f"(select *, {q_of('h3_8')} as q, {r_of('h3_8')} as r from places where name<>'')) qualify row_number() over (partition by city order by id)<=5")
def sample_per_city(spark, sf):
    return surface.sample_per_city(W.stored(spark, sf, "places")).select(
        "city", "id", "name", "lon", "lat", r6("cell_lon"), r6("cell_lat"), F.round("drift_m", 3).alias("drift_m")
    )


# ---- ranking --------------------------------------------------------------------------------


def _lens(w) -> str:
    return f"round({w[0]}*dem+{w[1]}*(100-supply_n)+{w[2]}*acc_n,9)"


def _rank_sql(order: str, where: str = "true", first: int = 1, last: int = 3) -> str:
    return (
        "select city, cast(rk as integer) as rank, cell, printf('%x', cell) as h3, round_even(round(gap,9),1) as gap, round(dem,6) as dem, round_even(pop,0) as pop, "
        "sup, round_even(acc_pop,0) as acc, round_even(cap_area,0) as cap_m2, addr_cnt as addr, round_even(clon,5) as lon, round_even(clat,5) as lat, "
        f"area, locality from (select s.*, d.area, d.locality, row_number() over (partition by s.city order by {order}) as rk from scored_food s "
        f"left join districts d on d.city=s.city and d.h3_8=s.cell where acc_pop is not null and {where}) where rk between {first} and {last}"
    )


def _rank(spark, sf, request: RankRequest):
    s = W.surface(spark, sf, "food and drink")
    return ranking.rank_sites(s, W.stored(spark, sf, "districts"), request).withColumn("dem", F.round("dem", 6))


BALANCED = "gap desc, pop desc, cell"


@query("rank_balanced", _rank_sql(BALANCED))
def rank_balanced(spark, sf):
    return _rank(spark, sf, RankRequest())


for _name, _w in LENSES.items():

    @query(f"rank_{_name}", _rank_sql(f"{_lens(_w)} desc, pop desc, cell", last=6))
    def rank_lens(spark, sf, _name=_name):
        return _rank(spark, sf, RankRequest(strategy=_name, count=6))


@query("rank_worst", _rank_sql("sup desc, gap asc, cell", "pop >= 0.4*pop_p95"))
def rank_worst(spark, sf):
    return _rank(spark, sf, RankRequest(order="worst"))


@query("rank_in_district", _rank_sql(BALANCED, "(contains(lower(area),'nation_1') or contains(lower(locality),'nation_1'))"))
def rank_in_district(spark, sf):
    return _rank(spark, sf, RankRequest(district=" Nation_1 "))


@query("rank_second_page", _rank_sql(BALANCED, first=5, last=8))
def rank_second_page(spark, sf):
    return _rank(spark, sf, RankRequest(count=4, page=2))


@query("rank_one_city", _rank_sql(BALANCED, "s.city='amsterdam'", 4, 6))
def rank_one_city(spark, sf):
    s = W.surface(spark, sf, "food and drink")
    page = ranking.rank_city(s, "amsterdam", W.stored(spark, sf, "districts"), RankRequest(page=2))
    return page.withColumn("dem", F.round("dem", 6))


@query("flagship",
       "select city, cast(rk as integer) as rank, cell, round_even(round(gap,9),1) as gap, pop, sup, round_even(acc_pop,0) as acc, area, locality from "
       "(select s.*, d.area, d.locality, row_number() over (partition by s.city order by gap desc, pop desc, s.cell) as rk from scored_bakery s left join districts d on d.city=s.city and d.h3_8=s.cell where acc_pop is not null) where rk<=3")
def flagship(spark, sf):
    """End to end in one go: score every cell of every city for a trade and rank the best."""
    s = scoring.scored(W.market(spark, sf), ["bakery"])
    top = ranking.rank_sites(s, W.stored(spark, sf, "districts"))
    return top.select("city", "rank", "cell", "gap", "pop", "sup", "acc", "area", "locality")


_AVAILABLE = (
    "select city, cast(row_number() over (partition by city order by n desc, locality) as integer) as position, locality, n as cells from "
    "(select city, locality, count(*) as n from districts where locality<>'' group by 1,2) qualify position<=12"
)


@query("available_districts", _AVAILABLE)
def available_districts(spark, sf):
    return ranking.available_districts(W.stored(spark, sf, "districts"))


@query("rank_explain_no_match", f"select * from ({_AVAILABLE}) where city='berlin'")
def rank_explain(spark, sf):
    """A district nobody has: the answer is the list of names that exist."""
    request = RankRequest(district="no such place")
    districts = W.stored(spark, sf, "districts")
    picks = ranking.rank_city(W.surface(spark, sf, "food and drink"), "berlin", districts, request)
    return ranking.resolve_rank_or_explain(picks, districts, "berlin", request)["available"]


@query("place_names",
       "select city, h3_8, case when area<>'' and locality<>'' and area<>locality then area||', '||locality else nullif(greatest(area,locality),'') end as place from districts")
def place_names(spark, sf):
    return W.stored(spark, sf, "districts").select("city", "h3_8", place_name("area", "locality").alias("place"))


_PICKS = "(select city, cell, idx from scored_food where acc_pop is not null qualify row_number() over (partition by city order by gap desc, pop desc, cell)<=6)"
_PER_CAT = (
    f"select p.city, p.cell, pl.category, count(*) as n, max(a.weight) as w from {_PICKS} p, ring1 k join places pl on pl.city=p.city and "
    f"pl.h3_8={pack('p.idx', 8, '(' + q_of('p.cell') + ')+k.dq', '(' + r_of('p.cell') + ')+k.dr')} join affinity a on a.target='restaurant' and a.neighbor=pl.category group by 1,2,3"
)


@query("affinity_fit",
       f"select p.city, p.cell as pick, round_even(coalesce(sum(c.n*c.w),0),2) as fit from {_PICKS} p left join ({_PER_CAT}) c on c.city=p.city and c.cell=p.cell group by 1,2")
def affinity_fit(spark, sf):
    return aff.affinity_fit(
        _picks(spark, sf), W.stored(spark, sf, "places"), "restaurant", picks_bound=6 * len(CITIES)
    ).drop("top_neighbours")


def _picks(spark, sf, n: int = 6):
    return ranking.rank_sites(W.surface(spark, sf, "food and drink"), W.stored(spark, sf, "districts"), RankRequest(count=n))


@query("top_neighbours",
       f"select city, cell as pick, cast(row_number() over (partition by city, cell order by n*w desc, category)-1 as integer) as pos, category, n, w from ({_PER_CAT}) qualify pos<3")
def top_neighbours(spark, sf):
    fit = aff.affinity_fit(
        _picks(spark, sf), W.stored(spark, sf, "places"), "restaurant", picks_bound=6 * len(CITIES)
    )
    return fit.select("city", "pick", F.posexplode("top_neighbours").alias("pos", "e")).select("city", "pick", "pos", "e.*")


@query("affinity_surface",
       f"select city, {pack('idx', 8, 'q+dq', 'r+dr')} as cell, round_even(round(sum(weight),9),2) as fit from (select p.city, p.idx, {q_of('p.h3_8')} as q, {r_of('p.h3_8')} as r, a.weight "
       "from places p join affinity a on a.target='cafe' and a.neighbor=p.category), ring1 group by 1,2")
def affinity_surface(spark, sf):
    return aff.affinity_surface(W.stored(spark, sf, "places"), "cafe")


@query("pick_features")
def pick_features(spark, sf):
    request = RankRequest(strategy="demand")
    picks = ranking.rank_sites(W.surface(spark, sf, "food and drink"), W.stored(spark, sf, "districts"), request)
    fit = aff.affinity_fit(picks, W.stored(spark, sf, "places"), "restaurant", picks_bound=3 * len(CITIES))
    return ranking.pick_features(picks, fit, request).select("city", "rank", "cell", "place", "lens", "fit", "feature")


# ---- layers ---------------------------------------------------------------------------------


@query("capacity_rows", "select city, h3_8 as cell, cast(round_even(floor_area_m2,0) as bigint) as floor, buildings from cell_capacity")
def capacity_rows(spark, sf):
    return layers.capacity_rows(W.stored(spark, sf, "cell_capacity"))


def _outline(q: str, r: str) -> str:
    """SQL text of a base cell's closed ring, corner by corner; needs the city's lon0, lat0 and mx."""
    points = []
    for dq, dr in (*CORNERS, CORNERS[0]):
        qf, rf = f"({q}+{d(dq / 3.0)})", f"({r}+{d(dr / 3.0)})"
        lon = f"lon0+{d(531.0)}*({d(1.7320508075688772)}*{qf}+{d(0.8660254037844386)}*{rf})/mx"
        lat = f"lat0+{d(531.0)}*{d(1.5)}*{rf}/{d(111194.9)}"
        points.append(f"'['||round_even({lon},5)||','||round_even({lat},5)||']'")
    return "'[['||" + "||','||".join(points) + "||']]'"


@query("capacity_features",
       "select city, cell, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Polygon\",\"coordinates\":'||"
       f"{_outline('q', 'r')}"
       "||'},\"properties\":{\"floor\":'||floor||',\"buildings\":'||buildings||'}}' as feature from "
       "(select t.city, t.h3_8 as cell, cast(round_even(floor_area_m2,0) as bigint) as floor, buildings, c.lon0, c.lat0, c.mx, "
       f"{q_of('h3_8')} as q, {r_of('h3_8')} as r from cell_capacity t join cities c on c.city=t.city)")
def capacity_features(spark, sf):
    return layers.capacity_layer(W.stored(spark, sf, "cell_capacity"))


@query("capacity_stats",
       "select city, count(*) as cell_count, round_even(min(clon),5) as min_lon, round_even(min(clat),5) as min_lat, round_even(max(clon),5) as max_lon, round_even(max(clat),5) as max_lat from "
       f"(select t.city, c.lon0 + {d(531.0)}*({d(1.7320508075688772)}*q+{d(0.8660254037844386)}*r)/c.mx as clon, c.lat0 + {d(531.0)}*{d(1.5)}*r/{d(111194.9)} as clat from "
       f"(select city, {q_of('h3_8')} as q, {r_of('h3_8')} as r from cell_capacity) t join cities c on c.city=t.city) group by city")
def capacity_stats(spark, sf):
    return layers.capacity_stats(W.stored(spark, sf, "cell_capacity"))


@query("capacity_ramp",
       "select city, cell, floor, p95, floor/cast(p95 as double) as share, case when floor/cast(p95 as double)>=1 then 1.0 when floor/cast(p95 as double)>=0.7 then 0.7 "
       "when floor/cast(p95 as double)>=0.4 then 0.4 when floor/cast(p95 as double)>=0.15 then 0.15 else 0.0 end::double as stop from "
       "(select city, cell, floor, greatest(1, first_value(floor) over (partition by city order by case when i=least(n-1,cast(floor(n*cast(0.95 as double)) as bigint)) then 0 else 1 end)) as p95 from "
       "(select *, row_number() over (partition by city order by floor, cell)-1 as i, count(*) over (partition by city) as n from "
       "(select city, h3_8 as cell, cast(round_even(floor_area_m2,0) as bigint) as floor from cell_capacity)))")
def capacity_ramp(spark, sf):
    return layers.capacity_ramp(W.stored(spark, sf, "cell_capacity"))


@query("competitor_features",
       "select city, id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":['||round_even(lon,5)||','||round_even(lat,5)||']},\"properties\":{\"n\":\"'||name||'\"}}' as feature "
       f"from places where category in ({quoted(FOOD)})")
def competitor_features(spark, sf):
    return layers.competitors_layer(W.stored(spark, sf, "places"), FOOD)


_INNER = ("(select city, min(lon)+(max(lon)-min(lon))*0.4 as w, max(lon)-(max(lon)-min(lon))*0.4 as e, "
          "min(lat)+(max(lat)-min(lat))*0.4 as s, max(lat)-(max(lat)-min(lat))*0.4 as n from places group by city)")


@query("competitors_in_box",
       f"select p.city, p.id from places p join {_INNER} b on b.city=p.city and p.lon between b.w and b.e and p.lat between b.s and b.n where p.category in ({quoted(FOOD)})")
def competitors_in_box(spark, sf):
    """The middle of every city's frame, read from the table that is clustered along a space-filling curve."""
    places = W.stored(spark, sf, "places")
    frames = places.groupBy("city").agg(*[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("lo", F.min), ("hi", F.max))])
    out = None
    for b in frames.collect():  # one row for each city
        dx, dy = (b.hi_lon - b.lo_lon) * 0.4, (b.hi_lat - b.lo_lat) * 0.4
        box = (b.lo_lon + dx, b.hi_lon - dx, b.lo_lat + dy, b.hi_lat - dy)
        part = layers.competitors(places, FOOD, [c for c in CITIES if c.name == b.city], box).select("city", "id")
        out = part if out is None else out.unionAll(part)
    return out


@query("competitors_bbox",
       f"select city, min(lon) as min_lon, min(lat) as min_lat, max(lon) as max_lon, max(lat) as max_lat, count(*) as n from places where category in ({quoted(FOOD)}) group by city")
def competitors_bbox(spark, sf):
    return layers.competitors_bbox(W.stored(spark, sf, "places"), FOOD)


# ---- catchments -----------------------------------------------------------------------------

_LOBED = "(((oq*7+orr*3)%40)+40)%40=0"
_TOP3 = _PICKS.replace("<=6", "<=3")


@query("catchment_polygons",
       f"select p.city, p.cell, o.origin_h3_9, case when {_LOBED} then 2 else 1 end::bigint as lobes from {_TOP3} p join origins o on o.city=p.city and o.cell=p.cell and o.is_center")
def catchment_polygons(spark, sf):
    drawn = cat.catchment_polygons(
        _picks(spark, sf, 3), W.stored(spark, sf, "isochrones"), picks_bound=3 * len(CITIES)
    )
    return drawn.groupBy("city", "cell", "origin_h3_9").agg(F.count("feature").alias("lobes"))


_EDGE = "cast(round_even(((((oq*13+orr*7)%10)+10)%10)/cast(4 as double)+{m}*greatest(abs(rq-oq),abs(rr-orr),abs(rq-oq+rr-orr)),0) as integer)"


@query("catchment_edges",
       f"select p.city, p.cell, o.origin_h3_9, {_EDGE.format(m=170)} as duration_s, {_EDGE.format(m=230)} as dist_m from {_TOP3} p join reach o on o.city=p.city and o.cell=p.cell "
       "and o.is_center and o.minutes=15 and not (o.rq=o.oq and o.rr=o.orr)")
def catchment_edges(spark, sf):
    return cat.catchment_edges(
        _picks(spark, sf, 3), W.stored(spark, sf, "isochrone_edges"), picks_bound=3 * len(CITIES)
    ).drop("feature")


@query("catchment_sub_web",
       f"select p.city, p.cell, count(*) as edges from {_TOP3} p join reach o on o.city=p.city and o.cell=p.cell and o.is_center and o.minutes=15 and not (o.rq=o.oq and o.rr=o.orr) "
       f"where {_EDGE.format(m=170)}<=300 group by 1,2")
def catchment_sub_web(spark, sf):
    web = cat.catchment_edges(
        _picks(spark, sf, 3), W.stored(spark, sf, "isochrone_edges"), cat.WEB_CORE_SECONDS, picks_bound=3 * len(CITIES)
    )
    return web.groupBy("city", "cell").agg(F.count("*").alias("edges"))


@query("catchment_stats",
       f"select s.city, s.cell, coalesce(case when o.origin_h3_9 is not null then case when {_LOBED} then 2 else 1 end end,0)::bigint as lobes, round_even(a.acc_pop,0) as reachable_people, "
       "o.origin_h3_9 is not null as measured from scored_food s left join origins o on o.city=s.city and o.cell=s.cell and o.is_center left join acc a on a.city=s.city and a.cell=s.cell")
def catchment_stats(spark, sf):
    everywhere = W.surface(spark, sf, "food and drink").select("city", "cell")
    return cat.catchment_stats(
        everywhere, W.stored(spark, sf, "isochrones"), W.stored(spark, sf, "isochrone_cells"), W.stored(spark, sf, "population")
    )


@query("point_catchment",
       "select c.s_suppkey as click_id, c.city, c.h3_9 as origin_h3_9, "
       "round((select cast(sum(p.population) as double)/7 from reach r join population p on p.cell=r.reached_parent and p.country=r.country where r.city=c.city and r.origin_h3_9=c.h3_9 and r.minutes=10),6) as people, "
       "(select case when count(*)>0 then count(pl.id) end from reach r left join places pl on pl.city=r.city and pl.h3_9=r.reachable_h3_9 and pl.category ilike '%bakery%' where r.city=c.city and r.origin_h3_9=c.h3_9 and r.minutes=10) as places "
       "from clicks c")
def point_catchment(spark, sf):
    return cat.point_catchment(
        S.clicks(spark, sf), W.stored(spark, sf, "isochrone_cells"), W.stored(spark, sf, "population"), W.stored(spark, sf, "places")
    ).withColumn("people", F.round("people", 6))


@query("catchment_profile",
       "select r.city, r.origin_h3_9, cast(r.minutes as integer) as minutes, count(*) as cells, nullif(cast(sum(coalesce(pl.n,0)) as bigint),0) as pois, "
       "round_even(cast(sum(p.population) as double)/7,0) as people from reach r left join population p on p.cell=r.reached_parent "
       "left join (select city, h3_9, count(*) as n from places group by 1,2) pl on pl.city=r.city and pl.h3_9=r.reachable_h3_9 group by 1,2,3")
def catchment_profile(spark, sf):
    return cat.catchment_profile(
        None, W.stored(spark, sf, "isochrone_cells"), W.stored(spark, sf, "population"), W.stored(spark, sf, "places")
    )


@query("reverse_reach",
       "select city, reachable_h3_9, origin_h3_9 from reach where minutes=10 and (city, reachable_h3_9) in (select (city, h3_9) from places where category='bakery')")
def reverse_reach(spark, sf):
    shops = W.stored(spark, sf, "places").where(F.col("category") == "bakery")
    targets = shops.select("city", F.col("h3_9").alias("reachable_h3_9"))
    return cat.reverse_reach(targets, W.stored(spark, sf, "isochrone_cells"))


_SHOP = ("(select city, min(h3_9) as h3_9 from places where category='bakery' and (city, h3_9) in "
         "(select (city, reachable_h3_9) from reach where minutes=10) group by city)")


@query("reverse_reach_of",
       f"select r.city, r.reachable_h3_9, r.origin_h3_9 from reach r join {_SHOP} s on s.city=r.city and s.h3_9=r.reachable_h3_9 where r.minutes=10")
def reverse_reach_of(spark, sf):
    """Who walks to one known shop of each city: a lookup by a column that the table is not ordered by."""
    reach = W.stored(spark, sf, "isochrone_cells")
    shops = W.stored(spark, sf, "places").where(F.col("category") == "bakery").select("city", F.col("h3_9").alias("reachable_h3_9"))
    reached = shops.join(reach.where(F.col("minutes") == 10), ["city", "reachable_h3_9"], "left_semi")
    out = None
    for shop in reached.groupBy("city").agg(F.min("reachable_h3_9").alias("cell")).collect():  # one row for each city
        part = cat.reverse_reach_of(reach, shop.city, [shop.cell])
        out = part if out is None else out.unionAll(part)
    return out


@query("origin_profile",
       "select r.city, r.origin_h3_9, cast(r.minutes as integer) as minutes, count(*) as cells, nullif(cast(sum(coalesce(pl.n,0)) as bigint),0) as pois, "
       "round_even(cast(sum(p.population) as double)/7,0) as people from reach r left join population p on p.cell=r.reached_parent "
       "left join (select city, h3_9, count(*) as n from places group by 1,2) pl on pl.city=r.city and pl.h3_9=r.reachable_h3_9 "
       "where (r.city, r.origin_h3_9) in (select (city, min(origin_h3_9)) from reach group by city) group by 1,2,3")
def origin_profile(spark, sf):
    """The first origin of each city, each by its key."""
    reach, people, places = (W.stored(spark, sf, n) for n in ("isochrone_cells", "population", "places"))
    out = None
    for first in reach.groupBy("city").agg(F.min("origin_h3_9").alias("o")).collect():  # one row for each city
        part = cat.origin_profile(first.city, first.o, reach, people, places)
        out = part if out is None else out.unionAll(part)
    return out


@query("spot_check_origins",
       "select city, id, name, h3_9 as origin_h3_9 from places where name<>'' and (city, h3_9) in (select (city, origin_h3_9) from reach) "
       "qualify row_number() over (partition by city order by md5(id), id)=1")
def spot_check_origins(spark, sf):
    return cat.spot_check_origin(W.stored(spark, sf, "places"), W.stored(spark, sf, "isochrone_cells"))


# ---- names and coverage ---------------------------------------------------------------------


@query("district_resolution", "select city, h3_8, area, locality from districts")
def district_resolution(spark, sf):
    return dis.district_resolution(W.stored(spark, sf, "population"), S.divisions(spark, sf))


@query("coverage_report",
       "select c.city, count(*) as populated_cells, round_even(100.0::double*count(*) filter (where d.locality<>'')/count(*),1) as pct_with_locality, "
       "round_even(100.0::double*count(*) filter (where d.area<>'')/count(*),1) as pct_with_area, count(*) filter (where coalesce(d.area,'')='' and coalesce(d.locality,'')='') as with_no_name_at_all "
       "from cells c left join districts d on d.city=c.city and d.h3_8=c.cell group by c.city")
def coverage_report(spark, sf):
    return dis.coverage_report(W.stored(spark, sf, "population"), W.stored(spark, sf, "districts"))


@query("population_totals", "select country, sum(population) as total, count(*) as hexes from population group by country")
def population_totals(spark, sf):
    return cov.population_totals(W.stored(spark, sf, "population"))


@query("poi_cells_with_population",
       "select city, round_even(100.0::double*count(*) filter (where pop>0)/count(*),1) as pct_with_population from "
       "(select pl.city, pl.h3_8, max(p.population) as pop from places pl left join population p on p.cell=pl.h3_8 group by 1,2) group by city")
def poi_cells_with_population(spark, sf):
    return cov.poi_cells_with_population_pct(W.stored(spark, sf, "places"), W.stored(spark, sf, "population"))


@query("measured_coverage",
       "select city, count(acc_pop) as measured_cells, count(*) as cells, round_even(100.0::double*count(acc_pop)/count(*),1) as pct_cells, "
       "round_even(100*sum(case when acc_pop is not null then pop else 0 end)/sum(pop),1) as pct_population from scored_food group by city")
def measured_coverage(spark, sf):
    return cov.measured_coverage(W.surface(spark, sf, "food and drink"))


@query("run_history",
       "select conv_id, run, min(turn) as first_turn, count(*) as turns, max(case when role='user' then length(text) end) as question_chars, "
       "case when max(case when layer='picks' then 1 else 0 end)=1 then 'rebuild' when count(layer)+count(tool)>0 then 'steer' else 'talk' end as kind from "
       "(select *, cast(sum(case when role='user' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as run from turns where role in ('user','assistant')) where run>0 group by 1,2")
def run_history(spark, sf):
    return cov.run_history(S.turns(spark, sf))


# ---- trend ----------------------------------------------------------------------------------


@query("momentum_rollup", "select city, category, first_count, last_count, first_month, last_month from momentum")
def momentum_rollup(spark, sf):
    return trend.momentum_rollup(W.stored(spark, sf, "poi_history"))


@query("momentum_all", "select city, category, first_count, last_count, first_month, last_month, pct_change from momentum_pct")
def momentum_all(spark, sf):
    return trend.momentum_all(W.stored(spark, sf, "category_momentum"))


_REQ = "(select distinct city, category from places where category<>'')"


@query("category_trend",
       "select q.city, q.category, coalesce(h.n,0) as n, case when coalesce(h.n,0)<12 or coalesce(m.first_count,0)=0 then 'flat' when m.pct_change>8 then 'rising' when m.pct_change<-8 then 'saturating' else 'flat' end as direction, "
       "case when h.n>=12 and m.first_count>0 then m.pct_change end as pct_change, year(m.first_month) as from_year, coalesce(h.n,0)>=12 as enough_history from "
       f"{_REQ} q left join (select city, category, count(*) as n from poi_history group by 1,2) h on h.city=q.city and h.category=q.category left join momentum_pct m on m.city=q.city and m.category=q.category")
def category_trend(spark, sf):
    return _trend(spark, sf).drop("monthly")


def _trend(spark, sf):
    wanted = W.stored(spark, sf, "places").where(F.col("category") != "").select("city", "category")
    return trend.category_trend(wanted, W.stored(spark, sf, "poi_history"), W.stored(spark, sf, "category_momentum"))


@query("category_series",
       f"select h.city, h.category, cast(row_number() over (partition by h.city, h.category order by h.month)-1 as integer) as pos, h.month, h.count from poi_history h join {_REQ} q on q.city=h.city and q.category=h.category")
def category_series(spark, sf):
    return _trend(spark, sf).select("city", "category", F.posexplode("monthly").alias("pos", "e")).select(
        "city", "category", "pos", "e.month", "e.count"
    )
