"""Queries over saved sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitehex.operators import ranking
from sitehex.operators import saved as sv
from sitehex.operators.atscale import new_folder
from sitehex.operators.ranking import RankRequest
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W
from sitehex.plans.oracle import geo_distance
from sitehex.plans.registry import query
from sitehex.sources.saved import append_saved_site

WORD = "food and drink"

_MARKET = (
    "select s.user_id, s.business_type, s.id, s.city, s.label, s.h3_8, s.lon, s.lat, s.score as saved_score, round_even(round(m.gap,9),1) as market_gap, "
    "m.pop as residents, m.sup as rivals, s.status, s.created_at from saved_latest s left join scored_food m on m.city=s.city and m.cell=s.cell "
    "where s.business_type='food and drink'"
)


def _market(spark, sf):
    surface = W.surface(spark, sf, WORD).withColumn("gap", F.round("gap", 9))
    return sv.saved_sites_market(W.stored(spark, sf, "saved_sites"), surface, business_type=WORD)


@query("saved_sites_market", _MARKET)
def saved_sites_market(spark, sf):
    return _market(spark, sf)


@query("saved_site_features")
def saved_site_features(spark, sf):
    return sv.saved_sites_layer(_market(spark, sf))


@query("saved_sites_list",
       "select user_id, city, business_type, id, label, h3_8, lon, lat, score, status, created_at from saved_latest")
def saved_sites_list(spark, sf):
    return sv.saved_sites_list(W.stored(spark, sf, "saved_sites")).drop("note", "updated_at")


@query("overlay_pending",
       "with c as (select * from saved_latest where cast(id as bigint)%4<>0) select user_id, id, h3_8, true as pending from saved_latest where (user_id, h3_8) not in (select (user_id, h3_8) from c) "
       "union all select user_id, id, h3_8, false from c")
def overlay_pending(spark, sf):
    latest = sv.latest_versions(W.stored(spark, sf, "saved_sites"))
    confirmed = latest.where(F.col("id").cast("bigint") % 4 != 0)
    return sv.overlay_pending(confirmed, latest).select("user_id", "id", "h3_8", "pending")


_KEY = "cast(floor(lon*100000+0.5) as bigint), cast(floor(lat*100000+0.5) as bigint)"


@query("market_by_coord",
       f"with m as ({_MARKET}), k as (select cast(floor(lon*100000+0.5) as bigint) as x, cast(floor(lat*100000+0.5) as bigint) as y, max(market_gap) as market_gap, max(residents) as residents, max(rivals) as rivals from m group by 1,2) "
       "select s.user_id, s.id, s.city, s.business_type, k.market_gap, k.residents, k.rivals from saved_latest s left join k on k.x=cast(floor(s.lon*100000+0.5) as bigint) and k.y=cast(floor(s.lat*100000+0.5) as bigint)")
def market_by_coord(spark, sf):
    listed = sv.latest_versions(W.stored(spark, sf, "saved_sites")).select("user_id", "id", "city", "business_type", "lon", "lat")
    return sv.market_by_coord(listed, _market(spark, sf)).drop("lon", "lat")


@query("saved_sites_population",
       "select s.user_id, s.city, s.business_type, s.id, s.label, cast(p.population as float) as people_in_cell from saved_latest s join population p on p.cell=s.cell")
def saved_sites_population(spark, sf):
    return sv.saved_sites_population(W.stored(spark, sf, "saved_sites"), W.stored(spark, sf, "population"))


@query("save_ranked_pick",
       "select s.city, 'u1' as user_id, 'food and drink' as business_type, coalesce(case when area<>'' and locality<>'' and area<>locality then area||', '||locality else nullif(greatest(area,locality),'') end, 'saved site') as label, "
       "printf('%x', cell) as h3_8, round_even(round(gap,9),1) as score, 'candidate' as status from (select s.*, d.area, d.locality, row_number() over (partition by s.city order by gap desc, pop desc, cell) as rk from scored_food s "
       "left join districts d on d.city=s.city and d.h3_8=s.cell where acc_pop is not null) s where rk=2")
def save_ranked_pick(spark, sf):
    """Re-derive the ranking, append the second pick of every city, read the store back."""
    root = new_folder(spark, "saved")
    picks = ranking.rank_sites(W.surface(spark, sf, WORD), W.stored(spark, sf, "districts"), RankRequest(count=6))
    append_saved_site(sv.as_saved(picks, "u1", WORD, 2), root)
    return spark.read.parquet(root).select("city", "user_id", "business_type", "label", "h3_8", "score", "status")


@query("radius_join",
       "select s.id||'/'||s.user_id as site_id, s.city, p.category, count(*) as n_within, "
       f"round(min({geo_distance('s.lon', 's.lat', 'p.lon', 'p.lat')}),3) as nearest_m from saved_latest s join places p on p.city=s.city and "
       f"{geo_distance('s.lon', 's.lat', 'p.lon', 'p.lat')}<=500 group by 1,2,3")
def radius_join(spark, sf):
    sites = sv.latest_versions(W.stored(spark, sf, "saved_sites")).select(
        F.concat_ws("/", "id", "user_id").alias("site_id"), "city", "lon", "lat"
    )
    return sv.radius_join(sites, W.stored(spark, sf, "places"), 500.0).withColumn("nearest_m", F.round("nearest_m", 3))


@query("drop_tombstones",
       "select user_id, last_value_id as event_id, value from (select user_id, arg_max(event_id, ts) as last_value_id, arg_max(value, ts) as value, arg_max(event_type, ts) as kind from events group by user_id) where kind<>'error'")
def drop_tombstones(spark, sf):
    """Latest change per user; users whose latest change is a delete disappear."""
    changes = S.read(spark, sf, "events").select(
        "user_id", "ts", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("deleted")
    )
    return sv.drop_tombstones(changes, ["user_id"], "ts", "deleted").select("user_id", "event_id", "value")
