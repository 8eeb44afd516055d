"""Independent SQL for the registered queries, written for a plain SQL engine.

Named relations are composed as WITH clauses; only the ones a statement mentions are included.
The arithmetic of the test inputs is the same as in ``surrogates`` so both sides see equal numbers;
everything above it is written the naive way on purpose.
"""

from __future__ import annotations

import re

from sitehex.cities import CITIES
from sitehex.plans.surrogates import BUSINESS, HISTORY_TAG_OF, TRADES
from sitehex.reference_data import AFFINITY, CATEGORY_SYNONYMS, HISTORY_TAGS


def d(x: float) -> str:
    return f"cast({x!r} as double)"


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def pick(values, index: str) -> str:
    """Element of a literal list by zero-based index."""
    return f"([{quoted(values)}])[({index}) + 1]"


def tri(key: str, a: int, b: int) -> str:
    return f"(cast(({key}*{a}+7)%65521 as double)+cast(({key}*{b}+11)%65521 as double))/cast(131042 as double)"


def points(src: str, key: str, idx: str, x, y, where: str = "true") -> str:
    return (
        f"select s.*, c.idx, c.city, c.country, c.lon0, c.lat0, c.mx, "
        f"c.lon_min+(c.lon_max-c.lon_min)*({tri(key, *x)}) as lon, "
        f"c.lat_min+(c.lat_max-c.lat_min)*({tri(key, *y)}) as lat "
        f"from {src} s join cities c on c.idx = ({idx}) where {where}"
    )


def pack(idx: str, res: int, q: str, r: str) -> str:
    return (
        f"((cast({idx} as bigint)*16+{res})*4503599627370496 + (cast({q} as bigint)+33554432)*67108864 "
        f"+ (cast({r} as bigint)+33554432))"
    )


def with_cell(src: str, outs: dict[str, int], lon: str = "lon", lat: str = "lat") -> str:
    """``select *`` plus the cells of a point; ``src`` carries idx, lon0, lat0 and mx."""
    cols = [
        f"({lon}-lon0)*mx as g_x",
        f"({lat}-lat0)*{d(111194.9)} as g_y",
        f"(g_x*{d(0.5773502691896258)} - g_y*{d(0.3333333333333333)})/{d(531.0)} as g_q8",
        f"g_y*{d(0.6666666666666666)}/{d(531.0)} as g_r8",
        "g_q8*2-g_r8 as g_q9",
        "g_q8+g_r8*3 as g_r9",
    ]
    for res in sorted(set(outs.values())):
        q, r = f"g_q{res}", f"g_r{res}"
        cols += [
            f"floor({q}+{d(0.5)}) as g_a{res}", f"floor({r}+{d(0.5)}) as g_b{res}", f"floor(-{q}-{r}+{d(0.5)}) as g_c{res}",
            f"abs(g_a{res}-{q}) as g_da{res}", f"abs(g_b{res}-{r}) as g_db{res}", f"abs(g_c{res}+{q}+{r}) as g_dc{res}",
            f"case when g_da{res}>g_db{res} and g_da{res}>g_dc{res} then -g_b{res}-g_c{res} else g_a{res} end as g_qq{res}",
            f"case when g_da{res}>g_db{res} and g_da{res}>g_dc{res} then g_b{res} "
            f"when g_db{res}>g_dc{res} then -g_a{res}-g_c{res} else g_b{res} end as g_rr{res}",
        ]
    cols += [f"{pack('idx', res, f'g_qq{res}', f'g_rr{res}')} as {name}" for name, res in outs.items()]
    return f"select *, {', '.join(cols)} from {src}"


def q_of(cell: str) -> str:
    return f"((({cell}) >> 26) & 67108863) - 33554432"


def r_of(cell: str) -> str:
    return f"(({cell}) & 67108863) - 33554432"


def centre(q: str, r: str, res: int = 8, al: str = "") -> tuple[str, str]:
    """Longitude and latitude of fractional axial coordinates; needs lon0, lat0, mx in scope."""
    if res == 9:
        q, r = f"((cast({q} as double)*3+{r})/{d(7.0)})", f"((cast({r} as double)*2-{q})/{d(7.0)})"
    p = f"{al}." if al else ""
    x = f"{d(531.0)}*({d(1.7320508075688772)}*({q}) + {d(0.8660254037844386)}*({r}))"
    y = f"{d(531.0)}*{d(1.5)}*({r})"
    return f"({p}lon0 + ({x})/{p}mx)", f"({p}lat0 + ({y})/{d(111194.9)})"


def parent_q(q: str, r: str) -> str:
    return f"cast((3*({q}-({du(q, r)}))+({r}-({dv(q, r)})))/7 as bigint)"


def parent_r(q: str, r: str) -> str:
    return f"cast((2*({r}-({dv(q, r)}))-({q}-({du(q, r)})))/7 as bigint)"


def digit(q: str, r: str) -> str:
    return f"(((({q})+5*({r}))%7+7)%7)"


def du(q: str, r: str) -> str:
    return f"case {digit(q, r)} when 1 then 1 when 3 then 1 when 4 then -1 when 6 then -1 else 0 end"


def dv(q: str, r: str) -> str:
    return f"case {digit(q, r)} when 2 then -1 when 3 then -1 when 4 then 1 when 5 then 1 else 0 end"


def geo_distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    m = f"radians((({lat1})+({lat2}))/2)"
    plat = f"({d(111132.09)} - cos({m}*2)*{d(566.05)} + cos({m}*4)*{d(1.2)})"
    plon = f"(cos({m})*{d(111415.13)} - cos({m}*3)*{d(94.55)} + cos({m}*5)*{d(0.12)})"
    return f"sqrt(power((({lon2})-({lon1}))*{plon},2) + power((({lat2})-({lat1}))*{plat},2))"


CTES: dict[str, str] = {}

CTES["cities"] = (
    "select cast(idx as bigint) as idx, city, country, cast(lat_min as double) as lat_min, cast(lat_max as double) as lat_max, "
    "cast(lon_min as double) as lon_min, cast(lon_max as double) as lon_max, cast(lon0 as double) as lon0, "
    "cast(lat0 as double) as lat0, cast(mx as double) as mx from (values "
    + ", ".join(
        f"({c.idx}, '{c.name}', '{c.country}', {c.lat_min}, {c.lat_max}, {c.lon_min}, {c.lon_max}, {c.lon0}, {c.lat0}, {c.metres_per_deg_lon})"
        for c in CITIES
    )
    + ") t(idx, city, country, lat_min, lat_max, lon_min, lon_max, lon0, lat0, mx)"
)
CTES["ring1"] = "select * from (values (0,0),(1,0),(0,1),(-1,1),(-1,0),(0,-1),(1,-1)) t(dq,dr)"
CTES["disk"] = (
    "select m.minutes, m.k, a.dq, b.dr from (values (5,1),(10,2),(15,3)) m(minutes,k), range(-3,4) a(dq), range(-3,4) b(dr) "
    "where greatest(abs(dq),abs(dr),abs(dq+dr)) <= k"
)
CTES["affinity"] = "select target, neighbor, cast(weight as double) as weight from (values " + ", ".join(
    f"('{t}','{n}',{w})" for t, ns in AFFINITY.items() for n, w in ns.items()
) + ") t(target, neighbor, weight)"
CTES["synonyms"] = "select * from (values " + ", ".join(
    f"('{w}',{i},'{c}')" for w, cs in CATEGORY_SYNONYMS.items() for i, c in enumerate(cs)
) + ") t(word, position, category)"

# ---- raw and ingested inputs ----------------------------------------------------------------

_trade = pick(TRADES, "case when c_custkey%31>=20 then (c_custkey%31-20)%4 else c_custkey%31 end")
CTES["raw_places_at"] = points("customer", "s.c_custkey", "s.c_nationkey%3", (48271, 30269), (16807, 40692))
CTES["raw_places"] = (
    "select cast(c_custkey as varchar) as id, case when c_custkey%29<>0 then c_name end as name, "
    f"case when c_custkey%97<>0 then {_trade} end as category, "
    "case when c_custkey%89<>0 then (37+(c_custkey*37)%100)/cast(100 as double) end as confidence, "
    "case when c_custkey%53=0 then 'closed' when c_custkey%7<>0 then 'open' end as operating_status, "
    "lon + case when c_custkey%41=0 then 10 else 0 end as lon, lat from raw_places_at"
)


def _tagged(src: str, x: str, y: str) -> str:
    """Rows of a raw relation joined to every city whose box holds the float corner."""
    return (
        f"select s.*, c.idx, c.city, c.country, c.lon0, c.lat0, c.mx from {src} s join cities c on "
        f"cast(cast({x} as float) as double) between c.lon_min and c.lon_max and "
        f"cast(cast({y} as float) as double) between c.lat_min and c.lat_max"
    )


CTES["raw_places_in"] = _tagged("raw_places", "s.lon", "s.lat")
CTES["places_at"] = (
    "select id, coalesce(name,'') as name, coalesce(category,'') as category, coalesce(confidence,0) as confidence, lon, lat, "
    "city, idx, lon0, lat0, mx from raw_places_in where coalesce(confidence,0)>=0.5 and coalesce(operating_status,'open')<>'closed'"
)
CTES["places"] = with_cell("places_at", {"h3_8": 8, "h3_9": 9})
CTES["pop_points"] = points("orders", "s.o_orderkey", "s.o_custkey%3", (48271, 39373), (16807, 33614))
CTES["pop_cells"] = with_cell("pop_points", {"cell": 8})
CTES["raw_population"] = (
    "select cell, idx, case when count(*)=1 and min(o_orderkey)%5=0 then 0 else cast(sum(20+o_orderkey%181) as double) end as population, "
    "any_value(country) as country from pop_cells group by cell, idx"
)
CTES["population"] = (
    f"select p.cell, p.idx, p.population, p.country, c.city, c.lon0, c.lat0, c.mx, {q_of('p.cell')} as q, {r_of('p.cell')} as r "
    "from raw_population p join cities c on c.idx = p.idx where p.population > 0"
)
_clon, _clat = centre("q", "r")
CTES["placed"] = f"select *, {_clon} as clon, {_clat} as clat from population"
CTES["cells"] = (
    "select p.cell, p.idx, p.population as pop, p.country, p.q, p.r, p.clon, p.clat, c.city, p.lon0, p.lat0, p.mx from placed p "
    "join cities c on c.country = p.country where clon between c.lon_min and c.lon_max and clat between c.lat_min and c.lat_max"
)
CTES["buildings_at"] = points("lineitem", "s.l_orderkey", "s.l_suppkey%3", (48271, 39373), (16807, 33614))
CTES["buildings"] = with_cell("buildings_at", {"h3_8": 8})
_storeys = (
    "coalesce(case when l_linenumber%4=0 then cast(cast(l_quantity as int) as double) end, "
    "case when l_linenumber%2=0 then l_quantity/3 end, cast(1 as double))"
)
CTES["cell_capacity"] = (
    f"select city, h3_8, cast(sum(cast(floor(l_extendedprice/cast(100 as double)*({_storeys})*10000+0.5) as bigint)) as double)/10000 "
    "as floor_area_m2, count(*) as buildings from buildings group by city, h3_8"
)
CTES["addr_at"] = points("orders", "s.o_orderkey", "s.o_custkey%3", (40014, 39373), (16807, 40692))
CTES["addr_points"] = "select lon, lat from addr_at"
CTES["addr_in"] = _tagged("addr_points", "s.lon", "s.lat")
CTES["addr_cells"] = with_cell("addr_in", {"h3_8": 8})
CTES["addr_density"] = "select city, h3_8, count(*) as addr_count from addr_cells group by city, h3_8"

# ---- reach ----------------------------------------------------------------------------------

_measured = "(((q+5000)*31+(r+5000)*17)%100+100)%100 >= 37"
CTES["origins"] = (
    f"select *, {pack('idx', 9, 'oq', 'orr')} as origin_h3_9 from ("
    f"select city, idx, country, cell, 2*q-r as oq, q+3*r as orr, true as is_center, lon0, lat0, mx from population where {_measured} "
    f"union all select city, idx, country, cell, 2*q-r+1, q+3*r, false, lon0, lat0, mx from population where {_measured} and (((q+r)%3)+3)%3=0)"
)
CTES["reach0"] = "select o.*, k.minutes, o.oq+k.dq as rq, o.orr+k.dr as rr from origins o, disk k"
CTES["reach"] = (
    f"select *, {pack('idx', 9, 'rq', 'rr')} as reachable_h3_9, "
    f"{pack('idx', 8, parent_q('rq', 'rr'), parent_r('rq', 'rr'))} as reached_parent from reach0"
)
CTES["acc"] = (
    "select r.city, r.cell, cast(sum(p.population) as double)/7 as acc_pop from reach r join population p "
    "on p.cell = r.reached_parent and p.country = r.country where r.minutes = 10 and r.is_center group by r.city, r.cell"
)


def market(tag: str, categories) -> None:
    CTES[f"supply_{tag}"] = (
        f"select city, {pack('idx', 8, 'q+dq', 'r+dr')} as cell, count(*) as n from (select city, idx, {q_of('h3_8')} as q, "
        f"{r_of('h3_8')} as r from places where category in ({quoted(categories)})), ring1 group by 1, 2"
    )
    CTES[f"joined_{tag}"] = (
        "select c.city, c.cell, c.pop, coalesce(s.n,0) as sup, cp.floor_area_m2 as cap_area, ad.addr_count as addr_cnt, a.acc_pop, "
        f"c.q, c.r, c.clon, c.clat, c.lon0, c.lat0, c.mx, c.idx from cells c left join supply_{tag} s on s.city=c.city and s.cell=c.cell "
        "left join cell_capacity cp on cp.city=c.city and cp.h3_8=c.cell left join addr_density ad on ad.city=c.city and ad.h3_8=c.cell "
        "left join acc a on a.city=c.city and a.cell=c.cell"
    )
    CTES[f"scale_{tag}"] = (
        "select city, quantile_cont(pop,0.95) as pop_p95, greatest(quantile_cont(cast(sup as double),0.95),1) as sup_p95, "
        "greatest(quantile_cont(acc_pop,0.95),1) as acc_p95, greatest(quantile_cont(cap_area,0.95),1) as cap_p95, "
        f"greatest(quantile_cont(cast(addr_cnt as double),0.95),1) as addr_p95 from joined_{tag} group by city"
    )
    CTES[f"scored_{tag}"] = (
        "select j.*, s.* exclude (city), least(100,pop*100/pop_p95) as pop_n, least(100,cap_area*100/cap_p95) as cap_n, "
        "least(100,addr_cnt*100/addr_p95) as addr_n, least(100,sup*cast(100 as double)/sup_p95) as supply_n, "
        "case when acc_pop is not null then least(100,acc_pop*100/acc_p95) end as acc_n, "
        "(pop_n + coalesce(case when cap_area is not null then cap_n end,0) + coalesce(case when addr_cnt is not null then addr_n end,0))"
        "/(1 + case when cap_area is not null then 1 else 0 end + case when addr_cnt is not null then 1 else 0 end) as dem, "
        "dem*(100-supply_n)/100*coalesce(acc_n/100,1) as gap "
        f"from joined_{tag} j join scale_{tag} s on s.city=j.city"
    )


market("bakery", ["bakery"])
market("food", CATEGORY_SYNONYMS["food and drink"])


def weighted(e: dict[str, float]) -> str:
    return (
        f"greatest(0,least(100,100*power(dem/100,{d(e['demand'])})*power((100-supply_n)/100,{d(e['low_competition'])})"
        f"*coalesce(power(acc_n/100,{d(e['accessibility'])}),1)))"
    )


# ---- divisions ------------------------------------------------------------------------------

CTES["div_base"] = (
    "select n_name, cast(n_nationkey as bigint) as n, c.idx, c.city, cast(n_nationkey//3 as bigint) as slot, c.lon_max-c.lon_min as w, "
    "c.lat_max-c.lat_min as h, c.lon_min + (c.lon_max-c.lon_min)*((n_nationkey//3)%3)*cast(0.3 as double) as x0, "
    "c.lat_min + (c.lat_max-c.lat_min)*((n_nationkey//3)//3)*cast(0.3 as double) as y0 from nation join cities c on c.idx = n_nationkey%3"
)


def _rects(rows) -> str:
    return ", ".join(f"({','.join(str(v) for v in r)})" for r in rows)


# One row per rectangle: division kind, part number, 1 for an outline and -1 for a hole, fractions.
CTES["div_rects"] = (
    "select kind, part, sign, cast(fx0 as double) fx0, cast(fx1 as double) fx1, cast(fy0 as double) fy0, cast(fy1 as double) fy1 from (values "
    + _rects(
        [
            ("'locality'", 1, 1, 0, 1, 0, 1),
            ("'single'", 1, 1, 0.2, 0.8, 0.2, 0.8),
            ("'holed'", 1, 1, 0.1, 0.9, 0.1, 0.9),
            ("'holed'", 1, -1, 0.4, 0.6, 0.4, 0.6),
            ("'double'", 1, 1, 0, 0.4, 0, 0.4),
            ("'double'", 2, 1, 0.6, 1, 0.6, 1),
        ]
    )
    + ") t(kind, part, sign, fx0, fx1, fy0, fy1)"
)
CTES["divs"] = (
    "select *, 'locality' as subtype, 'locality' as kind, case when idx=2 then 'EN '||n_name else n_name end as nm from div_base union all "
    "select *, 'macrohood', case when n%3=0 then 'double' when n%4=0 then 'holed' else 'single' end, "
    "case when idx=2 then 'EN Hood '||n_name else 'Hood '||n_name end from div_base"
)
CTES["div_shapes"] = (
    "select v.subtype, v.nm, v.city, v.n, r.part, r.sign, v.x0+v.w*cast(0.3 as double)*r.fx0 as xa, v.x0+v.w*cast(0.3 as double)*r.fx1 as xb, "
    "v.y0+v.h*cast(0.3 as double)*r.fy0 as ya, v.y0+v.h*cast(0.3 as double)*r.fy1 as yb from divs v join div_rects r on r.kind=v.kind"
)
# A rectangle on the sphere: two meridian sides contribute nothing, two parallels bound the excess.
_excess = (
    "abs(2*atan2(tan(radians(xb-xa)/2)*2*tan(radians(ya)/2), 1+tan(radians(ya)/2)*tan(radians(ya)/2))"
    " - 2*atan2(tan(radians(xb-xa)/2)*2*tan(radians(yb)/2), 1+tan(radians(yb)/2)*tan(radians(yb)/2)))"
)
CTES["div_areas"] = (
    f"select subtype, nm, city, n, sum(sign*{_excess})*{d(6371007.18)}*{d(6371007.18)} as poly_area from div_shapes group by 1,2,3,4"
)
CTES["div_hits"] = (
    "select distinct c.city, c.cell, s.subtype, s.nm, a.poly_area from cells c join div_shapes s on s.sign=1 and c.clon>s.xa and c.clon<s.xb "
    "and c.clat>s.ya and c.clat<s.yb join div_areas a on a.subtype=s.subtype and a.nm=s.nm where not exists (select 1 from div_shapes h "
    "where h.sign=-1 and h.subtype=s.subtype and h.nm=s.nm and h.part=s.part and c.clon>h.xa and c.clon<h.xb and c.clat>h.ya and c.clat<h.yb)"
)
CTES["districts"] = (
    "select city, cell as h3_8, coalesce(arg_min(nm, poly_area) filter (where subtype='macrohood'),'') as area, "
    "coalesce(arg_min(nm, poly_area) filter (where subtype='locality'),'') as locality from div_hits group by city, cell"
)

# ---- history --------------------------------------------------------------------------------

_tag = "case o_orderpriority " + " ".join(f"when '{p}' then '{t}'" for p, t in HISTORY_TAG_OF.items()) + " end"
CTES["tag_months"] = (
    f"select c.city, {_tag} as tag, cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n from orders "
    "join cities c on c.idx=o_custkey%3 group by 1,2,3"
)
CTES["tag_series"] = (
    "select city, tag, month, cast(sum(n) over (partition by city, tag order by month) as bigint) as cnt from tag_months "
    "where tag is not null and not (city='amsterdam' and tag='shop=supermarket' and month>date '1995-08-01') "
    "and not (city='belgrade' and tag='tourism=hotel')"
)
CTES["tags"] = "select * from (values " + ", ".join(f"('{c}','{t}')" for c, t in HISTORY_TAGS.items()) + ") t(category, tag)"
CTES["poi_history"] = "select s.city, t.category, s.month, s.cnt as count from tag_series s join tags t on t.tag=s.tag"
CTES["momentum"] = (
    "select city, category, arg_min(count, month) as first_count, arg_max(count, month) as last_count, min(month) as first_month, "
    "max(month) as last_month from poi_history group by city, category"
)
CTES["momentum_pct"] = (
    "select *, round_even(cast(100 as double)*(last_count-first_count)/nullif(first_count,0),1) as pct_change from momentum"
)

# ---- saved sites ----------------------------------------------------------------------------

CTES["saved_at"] = points(
    "events", "s.user_id", "s.user_id%3", (48271, 39373), (16807, 33614), "s.event_type in ('signup','purchase')"
)
CTES["saved_pts"] = (
    "select * exclude (lon), lon + case when user_id%11=0 then 0.8 else 0 end as lon from saved_at"
)
CTES["saved_cells"] = with_cell("saved_pts", {"cell": 8})
CTES["saved_sites"] = (
    "select cast(user_id as varchar) as id, 'u'||(user_id%20) as user_id, city, "
    f"{pick(BUSINESS, '(user_id//3)%3')} as business_type, 'site '||event_id as label, lon, lat, cell, printf('%x', cell) as h3_8, "
    "case when event_id%5<>0 then round(value/6,4) end as score, case when event_id%3=0 then 'shortlisted' else 'candidate' end as status, "
    "ts as created_at, ts as updated_at from saved_cells"
)
CTES["saved_latest"] = (
    "select * from saved_sites qualify row_number() over (partition by user_id, city, business_type, id order by updated_at desc)=1"
)
CTES["clicks_at"] = points("supplier", "s.s_suppkey", "s.s_suppkey%3", (48271, 39373), (16807, 33614))
CTES["clicks"] = with_cell("clicks_at", {"h3_9": 9, "h3_8": 8})
CTES["turns"] = (
    "select conv_id, turn, role, text, case when role='assistant' and (conv_id*31+turn*17)%6=0 then 'picks' "
    "when role='assistant' and (conv_id*31+turn*17)%6=1 then 'competitors' end as layer, "
    "case when role='assistant' and (conv_id*31+turn*17)%6=2 then 'setLayer' end as tool from conversations"
)


def compose(body: str) -> str:
    """Prefix a statement with the relations it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    # A relation must not see itself: names equal to base tables would otherwise recurse.
    head = "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in CTES if n in needed)
    return head + (",\n" + body[len("with "):] if body.startswith("with ") else "\n" + body)
