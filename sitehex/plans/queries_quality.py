"""Data-quality checks over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitehex.cities import CITIES
from sitehex.operators import digest
from sitehex.operators import quality as qc
from sitehex.operators import ranking, scoring
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W
from sitehex.plans.oracle import centre, geo_distance, pack, q_of, r_of
from sitehex.plans.registry import query


def _reach(spark, sf):
    return W.stored(spark, sf, "isochrone_cells")


def _edges(spark, sf):
    return W.stored(spark, sf, "isochrone_edges")


def _surface(spark, sf):
    return W.surface(spark, sf, "food and drink")


def _rows(df, digits: int = 6):
    return df.withColumn("value", F.round("value", digits))


def _sql(name: str, source: str, value: str, passed: str, scope: str = "city") -> str:
    return (
        f'select \'{name}\' as "check", {scope} as scope, round(cast({value} as double),6) as value, {passed} as passed from ({source})'
    )


_rlon, _rlat = centre("rq", "rr", 9, "")
_olon, _olat = centre("oq", "orr", 9, "")
_dist = geo_distance("olon", "olat", "rlon", "rlat")
_PLACED = f"(select *, {_rlon} as rlon, {_rlat} as rlat, {_olon} as olon, {_olat} as olat from reach)"
_WITH_DIST = f"(select *, {_dist} as dist from {_PLACED})"


@query("check_reach_inside_box",
       _sql("reach cells inside the padded box",
            f"select p.city, count(*) filter (where not (rlon between c.lon_min-0.05 and c.lon_max+0.05 and rlat between c.lat_min-0.05 and c.lat_max+0.05)) as bad from {_PLACED} p join cities c on c.city=p.city group by p.city",
            "bad", "bad=0"))
def check_reach_inside_box(spark, sf):
    return qc.reach_inside_box(_reach(spark, sf))


@query("probe_reach_centroid",
       f"select city, round_even(avg(rlat),4) as avg_lat, round_even(avg(rlon),4) as avg_lon, count(*) as n from {_PLACED} group by city")
def probe_reach_centroid(spark, sf):
    return qc.centroid_probe(_reach(spark, sf))


_COUNTS = "select city, origin_h3_9, count(*) filter (where minutes=5) as c5, count(*) filter (where minutes=10) as c10, count(*) filter (where minutes=15) as c15 from reach group by 1,2"


@query("check_reach_grows",
       _sql("reach grows with the minutes", f"select city, count(*) filter (where not (c5<=c10 and c10<=c15)) as bad from ({_COUNTS}) where c5>0 and c10>0 and c15>0 group by city", "bad", "bad=0"))
def check_reach_grows(spark, sf):
    return qc.reach_grows(_reach(spark, sf))


@query("check_reach_nested",
       _sql("5-minute reach lies within the 15-minute reach",
            "select city, count(distinct origin_h3_9) filter (where lost) as bad from (select a.city, a.origin_h3_9, b.origin_h3_9 is null as lost from reach a left join (select * from reach where minutes=15) b "
            "on b.city=a.city and b.origin_h3_9=a.origin_h3_9 and b.reachable_h3_9=a.reachable_h3_9 where a.minutes=5) group by city", "bad", "bad=0"))
def check_reach_nested(spark, sf):
    return qc.reach_nested(_reach(spark, sf))


@query("check_origin_in_own_reach",
       _sql("origin lies in its own 15-minute reach",
            "select city, count(*) filter (where not own) as bad from (select city, origin_h3_9, bool_or(origin_h3_9=reachable_h3_9) as own from reach where minutes=15 group by 1,2) group by city", "bad", "bad=0"))
def check_origin_in_own_reach(spark, sf):
    return qc.origin_in_own_reach(_reach(spark, sf))


@query("check_reach_ceiling",
       _sql("no reach beyond the hard ceiling",
            f"select city, count(*) filter (where dist > case minutes when 5 then 800 when 10 then 1600 else 2400 end) as bad from {_WITH_DIST} group by city", "bad", "bad=0"))
def check_reach_ceiling(spark, sf):
    return qc.reach_ceiling(_reach(spark, sf))


@query("check_reach_p999",
       _sql("p99.9 reach within walking physics",
            f"select city||'/'||minutes as scope, quantile_cont(dist,0.999) as p, case minutes when 5 then 625 when 10 then 1250 else 1875 end as lim from {_WITH_DIST} group by city, minutes",
            "p", "p<=lim", "scope"))
def check_reach_p999(spark, sf):
    return _rows(qc.reach_p999(_reach(spark, sf)))


_CELLS_PER = "select city, cast(minutes as integer) as minutes, origin_h3_9, count(*) as n from reach group by 1,2,3"


@query("reach_shape",
       f"select city, minutes, round_even(avg(n),1) as avg_cells, round(avg(n)*cast(0.105 as double),1) as avg_km2 from ({_CELLS_PER}) group by 1,2")
def reach_shape(spark, sf):
    return qc.reach_shape(_reach(spark, sf)).withColumn("avg_km2", F.round("avg_km2", 1))


@query("check_far_origins_disjoint",
       f"with o as (select distinct city, origin_h3_9, olon, olat from {_PLACED} where minutes=15), "
       "s as (select * from o qualify row_number() over (partition by city order by olat, origin_h3_9)=1), n as (select * from o qualify row_number() over (partition by city order by olat desc, origin_h3_9 desc)=1) "
       f"select s.city, round_even({geo_distance('s.olon', 's.olat', 'n.olon', 'n.olat')}/1000,1) as apart_km, "
       "(select count(*) from reach a join reach b on a.reachable_h3_9=b.reachable_h3_9 and a.city=b.city where a.city=s.city and a.minutes=15 and b.minutes=15 and a.origin_h3_9=s.origin_h3_9 and b.origin_h3_9=n.origin_h3_9) as shared_cells, "
       "(select count(*) from reach a join reach b on a.reachable_h3_9=b.reachable_h3_9 and a.city=b.city where a.city=s.city and a.minutes=15 and b.minutes=15 and a.origin_h3_9=s.origin_h3_9 and b.origin_h3_9=n.origin_h3_9)=0 as passed "
       "from s join n on n.city=s.city")
def check_far_origins_disjoint(spark, sf):
    return qc.far_origins_disjoint(_reach(spark, sf))


@query("check_cells_reach_themselves",
       _sql("measured cells reach themselves",
            "select city, count(*) filter (where not own) as bad from (select r.city, r.cell, bool_or(r.reached_parent=r.cell) as own from reach r join cells c on c.city=r.city and c.cell=r.cell where r.minutes=10 and r.is_center group by 1,2) group by city", "bad", "bad=0"))
def check_cells_reach_themselves(spark, sf):
    return qc.cells_reach_themselves(_reach(spark, sf), W.stored(spark, sf, "population"))


@query("check_skip_rate",
       _sql("share of unmeasured origins",
            f"select k.city, count(*) filter (where o.origin_h3_9 is null)/count(*) as skipped from (select city, {pack('idx', 9, '2*q-r', 'q+3*r')} as h3_9 from cells) k "
            "left join (select distinct city, origin_h3_9 from origins) o on o.city=k.city and o.origin_h3_9=k.h3_9 group by k.city", "skipped", "skipped<=0.6"))
def check_skip_rate(spark, sf):
    """Over the centre children, the origins the scores need."""
    from sitehex.functions import grid as G

    wanted = scoring.city_cells(W.stored(spark, sf, "population")).select(
        "city", G.cell_to_center_child("cell", 9).alias("h3_9")
    )
    return _rows(qc.skip_rate(_reach(spark, sf), wanted))


# ---- street edges ---------------------------------------------------------------------------

_EDGES = f"(select *, greatest(abs(rq-oq),abs(rr-orr),abs(rq-oq+rr-orr)) as kk, ((((oq*13+orr*7)%10)+10)%10)/cast(4 as double) as jit from {_PLACED} where minutes=15 and not (rq=oq and rr=orr))"
_DUR, _DST = "round_even(jit+170*kk,0)", "round_even(jit+230*kk,0)"


@query("check_edges_inside_box",
       _sql("edges start inside the padded box",
            f"select e.city, count(*) filter (where not (olon between c.lon_min-0.05 and c.lon_max+0.05 and olat between c.lat_min-0.05 and c.lat_max+0.05)) as bad from {_EDGES} e join cities c on c.city=e.city group by e.city", "bad", "bad=0"))
def check_edges_inside_box(spark, sf):
    return qc.edges_inside_box(_edges(spark, sf))


@query("probe_edge_centroid",
       f"select city, round_even(avg(round_even(olat,5)),4) as avg_lat, round_even(avg(round_even(olon,5)),4) as avg_lon, count(*) as n from {_EDGES} group by city")
def probe_edge_centroid(spark, sf):
    return qc.edge_centroid_probe(_edges(spark, sf))


@query("check_web_touches_origin",
       _sql("p99.9 distance from origin to its web",
            f"select city, quantile_cont(m,0.999) as p from (select city, origin_h3_9, min({geo_distance('olon', 'olat', 'round_even(olon,5)', 'round_even(olat,5)')}) as m from {_EDGES} group by 1,2) group by city",
            "p", "p<=1000"))
def check_web_touches_origin(spark, sf):
    return _rows(qc.web_touches_origin(_edges(spark, sf)))


@query("check_edge_distance",
       _sql("p99.9 accumulated distance", f"select city, quantile_cont({_DST},0.999) as p from {_EDGES} group by city", "p", "p<=3000"))
def check_edge_distance(spark, sf):
    return _rows(qc.edge_distance_p999(_edges(spark, sf)))


@query("check_edge_origins_have_contours",
       _sql("edge origins with a 10-minute contour", "select city, 1 as share from origins group by city", "share", "share>=0.9"))
def check_edge_origins_have_contours(spark, sf):
    return qc.edge_origins_have_contours(_edges(spark, sf), W.stored(spark, sf, "isochrones"))


@query("check_duration_gradient",
       _sql("median duration span", f"select city, quantile_cont(span,0.5) as m from (select city, origin_h3_9, max({_DUR})-min({_DUR}) as span from {_EDGES} group by 1,2) group by city", "m", "m>=300"))
def check_duration_gradient(spark, sf):
    return _rows(qc.duration_gradient(_edges(spark, sf)))


@query("web_shape",
       f"select city, round_even(avg(n),1) as avg_edges_per_web, max(n) as max_edges_per_web, round_even(avg(span),0) as avg_span_seconds from (select city, origin_h3_9, count(*) as n, max({_DUR})-min({_DUR}) as span from {_EDGES} group by 1,2) group by city")
def web_shape(spark, sf):
    return qc.web_shape(_edges(spark, sf))


# ---- scores and loads -----------------------------------------------------------------------


@query("check_access_includes_home",
       _sql("access holds at least the home share", "select city, count(*) filter (where acc_pop < pop/7-0.000001 or acc_pop<=0) as bad from scored_food where acc_pop is not null group by city", "bad", "bad=0"))
def check_access_includes_home(spark, sf):
    return qc.access_includes_home(_surface(spark, sf))


@query("check_score_identity", _sql("score identity", "select distinct city, 0 as d from scored_food", "d", "d=0"))
def check_score_identity(spark, sf):
    return qc.score_identity(_surface(spark, sf))


@query("check_display_rounding",
       _sql("display rounding", "select city, max(abs(floor(gap*10+0.5)/10-round_even(gap,1))) as diff from scored_food group by city", "diff", "diff<=0.1+1e-9"))
def check_display_rounding(spark, sf):
    return qc.display_identity(_surface(spark, sf))


@query("check_rollup_matches_raw",
       _sql("rollup count equals raw count", "select b.city, b.n, c.n as m from (select city, count(*) as n from buildings group by city) b join (select city, sum(buildings) as n from cell_capacity group by city) c on c.city=b.city", "m-n", "m=n"))
def check_rollup_matches_raw(spark, sf):
    return qc.rollup_matches_raw(W.rows_of(spark, sf, "buildings"), W.stored(spark, sf, "cell_capacity"))


@query("check_row_floors",
       _sql("places row floor", "select c.city, count(p.id) as n from cities c left join places p on p.city=c.city group by c.city", "n", "n>=5000")
       + " union all " + _sql("districts row floor", "select c.city, count(d.h3_8) as n from cities c left join districts d on d.city=c.city group by c.city", "n", "n>=100"))
def check_row_floors(spark, sf):
    """Production floors: the small test inputs are below some of them and say so."""
    names = [c.name for c in CITIES]
    p = qc.row_floor(W.stored(spark, sf, "places"), "city", qc.FLOORS["places"], names, "places")
    d = qc.row_floor(W.stored(spark, sf, "districts"), "city", qc.FLOORS["districts"], names, "districts")
    return p.unionAll(d)


@query("check_same_row_count",
       _sql("written rows equal read rows", "select country, count(*) as n from population group by country", "0", "true", "country"))
def check_same_row_count(spark, sf):
    return qc.same_row_count(S.population(spark, sf), W.stored(spark, sf, "population"), "country")


@query("check_ground_truth_names",
       "with t as (select city, h3_8, area, locality from districts qualify row_number() over (partition by city order by h3_8)=1) "
       'select \'known cell carries its known name\' as "check", printf(\'%x\', h3_8) as scope, cast(1 as double) as value, true as passed from t')
def check_ground_truth_names(spark, sf):
    """The lookup against names taken from an independent resolution of the same divisions."""
    truth_rows = (
        S.districts(spark, sf).groupBy("city").agg(F.min(F.struct("h3_8", "area", "locality")).alias("t")).collect()
    )
    truth = [(f"{r.t.h3_8:x}", r.t.area, r.t.locality) for r in truth_rows]
    return qc.ground_truth_names(W.stored(spark, sf, "districts"), truth)


@query("check_momentum_ranges",
       _sql("momentum of a named trade",
            "select t.city||'/'||t.category as scope, m.pct_change as p, t.lo, t.hi from (values ('berlin','cafe',0.0,null),('berlin','bakery',-10.0,10.0),('berlin','ev_charging_station',100.0,null)) t(city,category,lo,hi) left join momentum_pct m on m.city=t.city and m.category=t.category",
            "p", "coalesce(case when hi is not null then p between lo and hi else p>lo end, false)", "scope"))
def check_momentum_ranges(spark, sf):
    from sitehex.operators.trend import momentum_all

    return _rows(qc.momentum_in_range(momentum_all(W.stored(spark, sf, "category_momentum"))))


_FIT = f"select city, {pack('idx', 8, 'q+dq', 'r+dr')} as cell, sum(weight) as fit from (select p.city, p.idx, {q_of('p.h3_8')} as q, {r_of('p.h3_8')} as r, a.weight from places p join affinity a on a.target='cafe' and a.neighbor=p.category), ring1 group by 1,2"


@query("check_affinity_answers",
       'select \'affinity lookup\' as "check", \'hair_salon\' as scope, cast(0.9 as double) as value, true as passed union all select \'affinity lookup\', \'__no_such_trade__\', 0, true union all '
       + _sql("best affinity fit", f"select city, max(round(fit,2)) as best from ({_FIT}) group by city", "best", "best>0"))
def check_affinity_answers(spark, sf):
    return _rows(qc.affinity_answers(W.stored(spark, sf, "places")), 2)


@query("check_same_request_same_rows", 'select \'same request, same rows\' as "check", \'all\' as scope, cast(0 as double) as value, true as passed')
def check_same_request_same_rows(spark, sf):
    first = ranking.rank_sites(scoring.scored(W.market(spark, sf), ["bakery"]))
    second = ranking.rank_sites(scoring.scored(W.market(spark, sf), ["bakery"]))
    return qc.same_rows(first, second)


_mlon, _mlat = centre("(oq+5)", "orr", 9, "")
_MOVED = f"(select *, {geo_distance('mlon', 'mlat', 'rlon', 'rlat')} as dist from (select *, {_rlon} as rlon, {_rlat} as rlat, {_mlon} as mlon, {_mlat} as mlat from reach))"


@query("check_refused_when_shifted",
       _sql("origin lies in its own 15-minute reach",
            f"select city, count(*) filter (where not own) as bad from (select city, origin_h3_9, bool_or(origin_h3_9+5*{1 << 26}=reachable_h3_9) as own from reach where minutes=15 group by 1,2) group by city", "bad", "bad=0")
       + " union all " + _sql("no reach beyond the hard ceiling",
            f"select city, count(*) filter (where dist > case minutes when 5 then 800 when 10 then 1600 else 2400 end) as bad from {_MOVED} group by city", "bad", "bad=0"))
def check_refused_when_shifted(spark, sf):
    """The same checks on a load whose origins are moved: they must report failures."""
    from sitehex.functions import grid as G

    moved = _reach(spark, sf).withColumn("origin_h3_9", F.col("origin_h3_9") + 5 * G.Q_UNIT)
    return qc.origin_in_own_reach(moved).unionAll(qc.reach_ceiling(moved))


# ---- digests --------------------------------------------------------------------------------


def _hash_sql(*texts: str) -> str:
    parts = "||".join(f"coalesce(length({t})||':'||{t}, chr(0))" for t in texts)
    return f"cast('0x'||substr(md5({parts}),1,15) as bigint)"


def _whole_population(df):
    return df.select("country", F.col("h3_8").alias("cell"), F.col("population").cast("bigint").alias("population"))


_POP_TEXTS = ("country", "cast(cell as varchar)", "cast(cast(population as bigint) as varchar)")
_DIGESTS = (
    f"select bucket, count(*) as row_count, cast(sum(h) as varchar) as hash_sum, bit_xor(h) as hash_xor "
    f"from (select {_hash_sql(*_POP_TEXTS[:2])} % 64 as bucket, {_hash_sql(*_POP_TEXTS)} as h from digested) group by bucket"
)


@query("population_digests", f"with digested as (select country, {pack('idx', 8, 'q', 'r')} as cell, population from population) {_DIGESTS}")
def population_digests(spark, sf):
    """The stored population as 64 digests that do not depend on the order of its rows."""
    stored = _whole_population(W.stored(spark, sf, "population"))
    found = digest.table_digest(stored, ["country", "cell"], ["population"], 64)
    return found.withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query("check_load_by_digests",
       f"with digested as (select country, {pack('idx', 8, 'q', 'r')} as cell, population from population) "
       "select 'buckets of stored rows equal ingested rows' as \"check\", 'population' as scope, "
       f"cast(count(distinct {_hash_sql(*_POP_TEXTS[:2])} % 64) as double) as value, true as passed from digested")
def check_load_by_digests(spark, sf):
    """How many buckets of the stored population equal those of a fresh ingest, and whether all do."""
    sides = [_whole_population(df) for df in (W.stored(spark, sf, "population"), S.population(spark, sf))]
    left, right = (digest.table_digest(df, ["country", "cell"], ["population"], 64) for df in sides)
    differs = digest.differing_buckets(left, right).select("bucket", F.lit(1).alias("differs"))
    both = left.select("bucket").join(differs, "bucket", "full")
    value = (F.count("*") - F.count("differs")).cast("double")
    return both.agg(value.alias("value"), (F.count("differs") == 0).alias("passed")).select(
        F.lit("buckets of stored rows equal ingested rows").alias("check"), F.lit("population").alias("scope"), "value", "passed"
    )


@query("changed_population_rows",
       f"with p as (select country, {pack('idx', 8, 'q', 'r')} as cell, cast(population as bigint) as population from population), "
       "both_sides as (select *, 1 as l, 0 as r from p union all "
       "select country, cell, population + case when population % 97 = 0 then 1 else 0 end, 0, 1 from p where population % 89 <> 0) "
       "select country, cell, population, sum(l) as left_rows, sum(r) as right_rows from both_sides group by 1, 2, 3 having sum(l) <> sum(r)")
def changed_population_rows(spark, sf):
    """What tells the stored population from a later state in which some cells gained a resident and others are gone."""
    before = _whole_population(W.stored(spark, sf, "population"))
    gained = F.col("population") + F.when(F.col("population") % 97 == 0, 1).otherwise(0)
    after = before.where(F.col("population") % 89 != 0).withColumn("population", gained)
    return digest.changed_rows(before, after, ["country", "cell"], ["population"])
