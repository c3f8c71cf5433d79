"""Points, roads and rasters around customers, and the assembled feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.functions import scalars
from gridpanel.operators import cleaning, panel, proximity, raster, roads
from gridpanel.plans import features as plan
from gridpanel.sources import readers
from registry.base import query, r, yyyymm

PI = "3.14159265358979323846"


def radius(meters: float) -> str:
    """Radius in degrees, as SQL computes it."""
    return f"greatest({meters}.0::double / 110540.0::double, {meters}.0::double / 111320.0::double)"


def inside_sql(dx: str, dy: str, meters: float) -> str:
    """Strictly within all 64 sides of the buffer polygon.

    The side a point can violate is the one whose sector holds the point's angle.
    """
    angle = f"atan2({dy}, {dx})"
    side = f"(floor({angle} / ({PI} / 32)) + 0.5) * ({PI} / 32)"
    return (
        f"(({dx}) * cos({side}) + ({dy}) * sin({side})) < {radius(meters)} * cos({PI} / 64)"
    )


FSP_TYPES_SQL = """select l.NIS_RAD, f.factype from locations l join fsp f
    on abs(l.LON - f.Lon) <= 0.1 and abs(l.LAT - f.Lat) <= 0.1
   and sqrt((l.LON - f.Lon) * (l.LON - f.Lon) + (l.LAT - f.Lat) * (l.LAT - f.Lat)) <= """


@query(
    "providers_in_radius",
    "locations",
    "fsp",
    sql=f"""with h as ({FSP_TYPES_SQL} {radius(3000)}) select NIS_RAD, factype, count(*) as n
            from h group by 1, 2""",
)
def _(v):
    return proximity.count_in_radius(v("locations"), v("fsp"), 3000, by="factype")


PROVIDER_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "provider_counts",
    "locations",
    "fsp",
    sql=f"""with h as ({FSP_TYPES_SQL} {radius(500)})
            select l.NIS_RAD, {', '.join(
                f"count(h.factype) filter (h.factype = '{t}') as {t}" for t in PROVIDER_TYPES)}
            from locations l left join h on l.NIS_RAD = h.NIS_RAD group by 1""",
)
def _(v):
    return proximity.count_in_radius(v("locations"), v("fsp"), 500, by="factype", pivot=True)


@query(
    "provider_dates",
    "fsp",
    sql="""with d as (select *, case when year > 0 then make_date(year, month, day) end as s from fsp)
           select fsp_id, cast(strftime(case when year = 0 then (select min(s) from d) else s end,
                  '%Y%m%d') as int) as start_day from d""",
)
def _(v):
    raw = v("fsp").withColumnsRenamed({"Lat": "GPSLatitud", "Lon": "GPSLongitu"})
    dated = readers.providers(raw).withColumn("d", F.date_format("start_dte", "yyyyMMdd"))
    return dated.select("fsp_id", F.col("d").cast("int").alias("start_day"))


@query(
    "customers_in_buffer",
    "locations",
    "customers_all",
    sql=f"""select l.NIS_RAD, c.NIS_RAD as point_NIS_RAD, c.mktsegment
            from locations l join customers_all c
              on abs(c.LON - l.LON) < 0.1 and abs(c.LAT - l.LAT) < 0.1
             and {inside_sql('c.LON - l.LON', 'c.LAT - l.LAT', 2000)}""",
)
def _(v):
    return proximity.points_in_buffer(
        v("locations"), v("customers_all"), 2000, columns=["NIS_RAD", "LAT", "LON", "mktsegment"]
    ).select("NIS_RAD", "point_NIS_RAD", "mktsegment")


@query(
    "structures_in_buffer",
    "customers_all",
    sql=f"""select a.NIS_RAD, count(*) as n from customers_all a join customers_all b
              on abs(b.LON - a.LON) < 0.1 and abs(b.LAT - a.LAT) < 0.1
             and {inside_sql('b.LON - a.LON', 'b.LAT - a.LAT', 1000)} group by 1""",
)
def _(v):
    return proximity.count_in_radius(
        v("customers_all"), v("customers_all"), 1000, shape="polygon", right_xy=("LON", "LAT")
    )


@query(
    "transformer_matches",
    "customers_all",
    "tx_data",
    sql="""select c.NIS_RAD, count(*) as matches from customers_all c
           join tx_data t on c.LAT = t.LAT and c.LON = t.LON group by 1""",
)
def _(v):
    matched = proximity.match_transformers(v("customers_all"), v("tx_data"))
    return matched.groupBy("NIS_RAD").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "electrified_structure_count",
    "customers_all",
    "tx_data",
    sql="""select (select count(*) from customers_all c join tx_data t
                   on c.LAT = t.LAT and c.LON = t.LON)
                  + (select count(*) from (select distinct LAT, LON from customers_all
                     where NIS_RAD not in (select tx_id from tx_data))) as electrified_structures""",
)
def _(v):
    return proximity.count_structures(v("customers_all"), v("tx_data"))


def _structures_sql(meters: float) -> str:
    return f"""asked as (select distinct nis_rad, period from bills),
        near as (select a.nis_rad, a.period, c.NIS_RAD as cid, c.LAT, c.LON
            from asked a join customers_all s on a.nis_rad = s.NIS_RAD
            join customers_all c on c.installation is not null
             and date_trunc('month', c.installation) <= a.period
             and abs(c.LON - s.LON) < 0.1 and abs(c.LAT - s.LAT) < 0.1
             and {inside_sql('c.LON - s.LON', 'c.LAT - s.LAT', meters)}),
        site as (select LAT, LON, count(*) as n from tx_data group by 1, 2),
        tx as (select nis_rad, period, sum(n) as n from near join site using (LAT, LON) group by 1, 2),
        other as (select nis_rad, period, count(distinct (LAT, LON)) as n from near
                  where cid not in (select tx_id from tx_data) group by 1, 2),
        es as (select a.nis_rad, a.period,
                      cast(coalesce(tx.n, 0) + coalesce(other.n, 0) as bigint) as electrified_structures
               from asked a left join tx using (nis_rad, period) left join other using (nis_rad, period))"""


@query(
    "electrified_structures",
    "bills",
    "customers_all",
    "tx_data",
    sql=f"""with {_structures_sql(3000)}
            select nis_rad, cast(strftime(period, '%Y%m') as int) as month, electrified_structures
            from es""",
)
def _(v):
    found = proximity.electrified_structures(v("bills"), v("customers_all"), v("tx_data"), 3000)
    return found.select("nis_rad", yyyymm(F.col("period")).alias("month"), "electrified_structures")


# ---------------------------------------------------------------- roads

DISTANCE_SQL = """sg as (select distinct x1, y1, x2, y2 from road_segments),
    pr as (select l.NIS_RAD, l.LON as px, l.LAT as py, sg.*,
             case when (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 then
               greatest(0.0, least(1.0, ((l.LON - x1) * (x2 - x1) + (l.LAT - y1) * (y2 - y1))
                 / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) else 0.0 end as t
           from locations l cross join sg),
    ds as (select NIS_RAD, min(sqrt((px - x1 - t * (x2 - x1)) * (px - x1 - t * (x2 - x1))
             + (py - y1 - t * (y2 - y1)) * (py - y1 - t * (y2 - y1)))) as distance_to_road
           from pr group by 1)"""


@query(
    "nearest_road",
    "locations",
    "road_segments",
    sql=f"""with {DISTANCE_SQL} select NIS_RAD, {r('distance_to_road')} as distance_to_road from ds""",
)
def _(v):
    return roads.nearest_segment_distance(v("locations"), v("road_segments"))


UNITED_SQL = """un as (select distinct ROADCLASS, case when (x1, y1) < (x2, y2) then x1 else x2 end as x1,
               case when (x1, y1) < (x2, y2) then y1 else y2 end as y1,
               case when (x1, y1) < (x2, y2) then x2 else x1 end as x2,
               case when (x1, y1) < (x2, y2) then y2 else y1 end as y2
             from road_segments where ROADCLASS in ('A', 'B'))"""


def _lengths_sql(meters: float, united: str = UNITED_SQL) -> str:
    return f"""{united},
        cd as (select l.NIS_RAD, ROADCLASS, x1 - LON as ax, y1 - LAT as ay, x2 - x1 as dx, y2 - y1 as dy
             from locations l join un on least(x1, x2) <= LON + {radius(meters)}
              and greatest(x1, x2) >= LON - {radius(meters)} and least(y1, y2) <= LAT + {radius(meters)}
              and greatest(y1, y2) >= LAT - {radius(meters)}),
        sd as (select cd.*, cos((k + 0.5) * {PI} / 32) * dx + sin((k + 0.5) * {PI} / 32) * dy as speed,
                 {radius(meters)} * cos({PI} / 64)
                 - cos((k + 0.5) * {PI} / 32) * ax - sin((k + 0.5) * {PI} / 32) * ay as room
             from cd cross join (select unnest(range(64)) as k)),
        bd as (select NIS_RAD, ROADCLASS, ax, ay, dx, dy,
                 greatest(0.0, coalesce(max(case when speed < 0 then room / speed end), 0.0)) as lo,
                 least(1.0, coalesce(min(case when speed > 0 then room / speed end), 1.0)) as hi,
                 bool_or(speed = 0 and room < 0) as beside from sd group by 1, 2, 3, 4, 5, 6),
        ln as (select NIS_RAD, ROADCLASS, sum(case when beside then 0.0 else greatest(0.0, hi - lo)
                 * sqrt(dx * dx + dy * dy) end) as len from bd group by 1, 2),
        rl as (select l.NIS_RAD, coalesce(sum(len) filter (ROADCLASS = 'A'), 0.0) as road_class_A_length,
                 coalesce(sum(len) filter (ROADCLASS = 'B'), 0.0) as road_class_B_length
               from locations l left join ln using (NIS_RAD) group by 1)"""


@query(
    "road_lengths",
    "locations",
    "road_segments",
    sql=f"""with {_lengths_sql(10000)}
            select NIS_RAD, {r('road_class_A_length')} as road_class_A_length,
                   {r('road_class_B_length')} as road_class_B_length,
                   {r('road_class_A_length + road_class_B_length')} as total_road_length from rl""",
)
def _(v):
    return roads.segment_length_in_buffer(v("locations"), v("road_segments"))


# Level roads, each with a second one that begins in its first quarter and ends behind it.
FLAT_SQL = """select ROADCLASS, least(x1, x2) as x1, y1, greatest(x1, x2) as x2, y1 as y2 from road_segments
              union all
              select ROADCLASS, least(x1, x2) + abs(x2 - x1) / 4, y1, greatest(x1, x2) + abs(x2 - x1) / 2, y1
              from road_segments where road_id % 3 < 2"""

FLAT_UNION_SQL = f"""fl as ({FLAT_SQL}),
        ob as (select *, max(x2) over (partition by ROADCLASS, y1 order by x1, x2 rows between unbounded preceding and 1 preceding) as done
               from fl where ROADCLASS in ('A', 'B') and x1 < x2),
        ib as (select *, sum(case when done is null or x1 > done then 1 else 0 end) over (partition by ROADCLASS, y1 order by x1, x2) as island
               from ob),
        un as (select ROADCLASS, min(x1) as x1, any_value(y1) as y1, max(x2) as x2, any_value(y1) as y2
               from ib group by ROADCLASS, y1, island)"""


@query(
    "overlapping_road_lengths",
    "locations",
    "road_segments",
    sql=f"""with {_lengths_sql(3000, FLAT_UNION_SQL)}
            select NIS_RAD, {r('road_class_A_length')} as road_class_A_length,
                   {r('road_class_B_length')} as road_class_B_length,
                   {r('road_class_A_length + road_class_B_length')} as total_road_length from rl""",
)
def _(v):
    flat = v.args[0].sql(FLAT_SQL.replace("road_segments", "{roads}"), roads=v("road_segments"))
    return roads.segment_length_in_buffer(v("locations"), flat, 3000)


@query(
    "road_features",
    "locations",
    "road_segments",
    sql=f"""with {DISTANCE_SQL}, {_lengths_sql(2500)}
            select NIS_RAD, {r('distance_to_road')} as distance_to_road,
                   {r('road_class_A_length')} as road_class_A_length,
                   {r('road_class_B_length')} as road_class_B_length,
                   {r('road_class_A_length + road_class_B_length')} as total_road_length
            from rl join ds using (NIS_RAD)""",
)
def _(v):
    return roads.road_features(v("locations"), v("road_segments"), "both", meters=2500)


@query(
    "segments_from_text",
    "road_segments",
    sql=f"""select road_id, ROADCLASS, part, {r('x1')} as x1, {r('y1')} as y1, {r('x2')} as x2,
                   {r('y2')} as y2
            from (select road_id, ROADCLASS, 0 as part, x1, y1, x2, y2 from road_segments
                  union all
                  select road_id, ROADCLASS, 1 as part, x2, y2, x1 + 1, y1 + 1 from road_segments
                  where ROADCLASS = 'B') t
            where ROADCLASS <> 'C'""",
)
def _(v):
    # Class B roads as two-part lines, class C roads without geometry.
    def point(x, y):
        return F.concat_ws(" ", x, y)

    first = F.concat_ws(", ", point(F.col("x1"), F.col("y1")), point(F.col("x2"), F.col("y2")))
    second = F.concat_ws(
        ", ", point(F.col("x2"), F.col("y2")), point(F.col("x1") + 1, F.col("y1") + 1)
    )
    text = (
        F.when(F.col("ROADCLASS") == "A", F.concat(F.lit("LINESTRING ("), first, F.lit(")")))
        .when(
            F.col("ROADCLASS") == "B",
            F.concat(F.lit("MULTILINESTRING (("), first, F.lit("), ("), second, F.lit("))")),
        )
    )
    lines = v("road_segments").withColumn("geometry", text)
    return readers.road_segments(lines).drop("seg")


# ---------------------------------------------------------------- rasters


def _zonal_sql(meters: float) -> str:
    return f"""z{meters} as (select l.NIS_RAD, p.year, p.value from locations l join raster_pixels p
        on abs(p.lon_c - l.LON) < 0.1 and abs(p.lat_c - l.LAT) < 0.1
       and {inside_sql('p.lon_c - l.LON', 'p.lat_c - l.LAT', meters)})"""


STAT_SQL = {
    "mean": "avg(value)",
    "sum": "sum(value)",
    "max": "max(value)",
    "min": "min(value)",
    "std": "stddev_pop(value)",
    "median": "quantile_cont(value, 0.5)",
    "pixels_count": "count(value)",
    "pixels_nonzero": "count(value) filter (value > 0)",
}


@query(
    "raster_stats",
    "locations",
    "raster_pixels",
    sql=f"""with {_zonal_sql(1500)}, ok as (select * from z1500 where value >= 5 and value <= 80)
            select l.NIS_RAD, {', '.join(
                f"{r(f'coalesce({e}, 0)')} as {s}" if not s.startswith('pixels')
                else f'coalesce({e}, 0) as {s}' for s, e in STAT_SQL.items())}
            from locations l left join ok on l.NIS_RAD = ok.NIS_RAD group by 1""",
)
def _(v):
    return raster.zonal_stats(
        v("locations"), v("raster_pixels"), 1500, nodata=5, max_valid=80
    )


@query(
    "raster_stats_by_buffer",
    "locations",
    "raster_pixels",
    sql=f"""with {_zonal_sql(250)}, {_zonal_sql(500)}, {_zonal_sql(1000)},
            a as (select NIS_RAD, {', '.join(f'{STAT_SQL[s]} as {s}' for s in ('mean', 'sum', 'pixels_count'))}
                  from z250 where value >= -999 and value <= 1000 group by 1),
            b as (select NIS_RAD, {', '.join(f'{STAT_SQL[s]} as {s}' for s in ('mean', 'sum', 'pixels_count'))}
                  from z500 where value >= -999 and value <= 1000 group by 1),
            c as (select NIS_RAD, {', '.join(f'{STAT_SQL[s]} as {s}' for s in ('mean', 'sum', 'pixels_count'))}
                  from z1000 where value >= -999 and value <= 1000 group by 1)
            select l.NIS_RAD, {', '.join(
                (f"{r(f'coalesce({t}.{s}, 0)')}" if s != 'pixels_count' else f'coalesce({t}.{s}, 0)')
                + f' as lights_{s}_{m}m'
                for t, m in (('a', 250), ('b', 500), ('c', 1000)) for s in ('mean', 'sum', 'pixels_count'))}
            from locations l left join a using (NIS_RAD) left join b using (NIS_RAD)
            left join c using (NIS_RAD)""",
)
def _(v):
    return raster.zonal_stats(
        v("locations"),
        v("raster_pixels"),
        [250, 500, 1000],
        ("mean", "sum", "pixels_count"),
        max_valid=1000,
        prefix="lights_",
    )


NEAREST_SQL = """by_year as (select distinct nis_rad, year(f_fact) as year from bills),
    rated as (select b.nis_rad, b.year, y.ry, row_number() over (partition by b.nis_rad, b.year
                order by abs(y.ry - b.year), y.ry) as k
              from by_year b cross join (select distinct year as ry from raster_pixels) y),
    near_year as (select nis_rad, year, ry from rated where k = 1)"""


@query(
    "nearest_raster_year",
    "bills",
    "raster_pixels",
    sql=f"""with {NEAREST_SQL}
            select year, min(ry) as raster_year, count(*) as customers from near_year group by 1""",
)
def _(v):
    dated = v("bills").select("nis_rad", F.year("f_fact").alias("year")).distinct()
    matched = raster.nearest_year(dated, v("raster_pixels"))
    return matched.groupBy("year").agg(
        F.min("raster_year").alias("raster_year"), F.count(F.lit(1)).alias("customers")
    )


def _yearly_sql(meters: float) -> str:
    return f"""{NEAREST_SQL}, {_zonal_sql(meters)},
        zs as (select NIS_RAD as nis_rad, year as ry, {', '.join(f'{e} as {s}' for s, e in STAT_SQL.items())}
               from z{meters} where value >= 0 group by 1, 2),
        yearly as (select n.nis_rad, n.year, zs.* exclude (nis_rad, ry)
                   from near_year n left join zs on n.nis_rad = zs.nis_rad and n.ry = zs.ry)"""


@query(
    "population_in_buffer",
    "bills",
    "locations",
    "raster_pixels",
    sql=f"""with {_yearly_sql(500)}
            select nis_rad, year, {r('coalesce("sum", 0)')} as population from yearly""",
)
def _(v):
    return raster.population_features(v("bills"), v("locations"), v("raster_pixels"))


@query(
    "night_lights",
    "bills",
    "locations",
    "raster_pixels",
    sql=f"""with {_yearly_sql(1200)}
            select nis_rad, year, {r('coalesce("mean", 0)')} as lights_mean,
                   {r('coalesce("sum", 0)')} as lights_sum, {r('coalesce("max", 0)')} as lights_max,
                   {r('coalesce("std", 0)')} as lights_std,
                   coalesce(pixels_count, 0) as lights_pixels from yearly""",
)
def _(v):
    return raster.lights_features(v("bills"), v("locations"), v("raster_pixels"), 1200)


@query(
    "raster_catalogue",
    "raster_pixels",
    sql=f"""select year, count(*) as pixels, {r('sum(value)')} as total from raster_pixels group by 1""",
)
def _(v):
    # Each year comes in two files; the later one counts, the earlier one has other values.
    pixels = v("raster_pixels")
    old = pixels.withColumn("value", F.col("value") * 2).withColumn("part", F.lit("a"))
    both = old.unionByName(pixels.withColumn("part", F.lit("b")))
    name = F.concat(F.lit("dir/pop_grid_"), F.col("year").cast("string"), F.lit("_"), "part", F.lit(".tif"))
    listed = both.withColumn("path", name).drop("year")
    found = readers.raster_catalogue(listed, readers.population_year(F.col("path")))
    return found.groupBy("year").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("value").alias("total")
    )


CLASS_SQL = """px as (select NIS_RAD, cast(floor(abs(33.91261 - LON) / 0.008333) as int) as X,
              cast(floor(abs(5.470695 - LAT) / 0.008340186677631579) as int) as Y from locations),
    cl as (select NIS_RAD, px.X, px.Y, case when pixel_value = '-Infinity'::double then 'NA'
                when pixel_value = 0 then 'Peri_Urban' when pixel_value = 50 then 'Urban'
                when pixel_value = 100 then 'Rural' end as classification
           from px left join rural_urban_pixels r on px.X = r.X and px.Y = r.Y)"""


@query(
    "classified_locations",
    "locations",
    "rural_urban_pixels",
    sql=f"""with {CLASS_SQL}
            select NIS_RAD, X, Y, classification,
                   case when classification = 'Rural' then 'Rural' else 'Urban' end as binary_class from cl""",
)
def _(v):
    found = raster.classify_pixels(v("locations"), v("rural_urban_pixels"))
    return found.select(
        "NIS_RAD",
        "X",
        "Y",
        "classification",
        scalars.binary_rural_urban(F.col("classification")).alias("binary_class"),
    )


# ---------------------------------------------------------------- feature table


@query(
    "feature_table",
    "bills",
    "locations",
    "fsp",
    "road_segments",
    "raster_pixels",
    "customers_all",
    "tx_data",
    sql=f"""with h as ({FSP_TYPES_SQL} {radius(500)}),
            pv as (select NIS_RAD, count(*) filter (factype = 'LARGE') as large from h group by 1),
            {DISTANCE_SQL}, {_lengths_sql(10000)}, {_yearly_sql(500)}, {_structures_sql(500)}
            select b.nis_rad, b.period_month as month, count(*) as bills, {r('max(l.LAT)')} as LAT,
                   max(coalesce(large, 0)) as large, {r('max(distance_to_road)')} as distance_to_road,
                   {r('max(road_class_A_length + road_class_B_length)')} as total_road_length,
                   {r('max(coalesce(yearly."sum", 0))')} as population,
                   {r('max(coalesce(yearly."mean", 0))')} as lights_mean,
                   max(electrified_structures) as electrified_structures
            from (select *, cast(strftime(period, '%Y%m') as int) as period_month,
                         year(f_fact) as year from bills) b
            left join locations l on b.nis_rad = l.NIS_RAD
            left join pv on b.nis_rad = pv.NIS_RAD
            left join ds on b.nis_rad = ds.NIS_RAD
            left join rl on b.nis_rad = rl.NIS_RAD
            left join yearly on b.nis_rad = yearly.nis_rad and b.year = yearly.year
            left join es on b.nis_rad = es.nis_rad and b.period = es.period
            group by 1, 2""",
)
def _(v):
    bills, locations = v("bills"), v("locations")
    sets = plan.extract_features(
        bills,
        locations,
        v("fsp"),
        v("raster_pixels"),
        v("road_segments"),
        v("raster_pixels"),
        v("customers_all"),
        v("tx_data"),
    )
    table = plan.assemble_features(bills, locations, *sets.values())
    return table.groupBy("nis_rad", yyyymm(F.col("period")).alias("month")).agg(
        F.count(F.lit(1)).alias("bills"),
        F.max("LAT").alias("LAT"),
        F.max("LARGE").alias("large"),
        F.max("distance_to_road").alias("distance_to_road"),
        F.max("total_road_length").alias("total_road_length"),
        F.max("population").alias("population"),
        F.max("lights_mean").alias("lights_mean"),
        F.max("electrified_structures").alias("electrified_structures"),
    )


# ---------------------------------------------------------------- from features to the panel of the analysis


def _own_places(text: str) -> str:
    """The SQL of a feature around billed customers' own places."""
    return text.replace("locations l", "billed l")


PANEL_SQL = f"""with billed as (select * from customers_all where NIS_RAD in (select nis_rad from bills)),
    h as ({_own_places(FSP_TYPES_SQL)} {radius(500)}),
    pv as (select NIS_RAD, count(*) filter (factype = 'LARGE') as fsp from h group by 1),
    ts as (select l.NIS_RAD, count(*) as total from billed l
           join (select LAT, LON from customers_all union all select LAT, LON from tx_data) s
             on abs(s.LON - l.LON) < 0.1 and abs(s.LAT - l.LAT) < 0.1
            and {inside_sql('s.LON - l.LON', 's.LAT - l.LAT', 500)} group by 1),
    {_own_places(DISTANCE_SQL)}, {_own_places(_yearly_sql(500))}, {_structures_sql(500)},
    mo as (select b.nis_rad, mths, sum(csmo_fact) as csmo_fact, max(distance_to_road) as road, max(coalesce(fsp, 0)) as fsp,
             max(coalesce(yearly."sum", 0)) as population, max(coalesce(yearly."mean", 0)) as lights,
             max(electrified_structures) as es, max(coalesce(total, 0)) as total
           from (select i.*, year(f_fact) as year,
                        cast(trunc(epoch(cast(f_fact as timestamp) - installation) / (30.436875 * 86400)) as int) as mths
                 from bills i join customers_all c on i.nis_rad = c.NIS_RAD where installation is not null) b
           left join pv on b.nis_rad = pv.NIS_RAD left join ts on b.nis_rad = ts.NIS_RAD left join ds on b.nis_rad = ds.NIS_RAD
           left join yearly on b.nis_rad = yearly.nis_rad and b.year = yearly.year
           left join es on b.nis_rad = es.nis_rad and b.period = es.period
           where mths >= 0 group by 1, 2),
    cal as (select nis_rad, unnest(range(min(mths), max(mths) + 1)) as mths from mo group by 1),
    fi as (select cal.nis_rad, cal.mths, csmo_fact, {', '.join(
        f'last_value({c} ignore nulls) over (partition by cal.nis_rad order by cal.mths rows unbounded preceding) as {c}'
        for c in ('road', 'fsp', 'population', 'lights', 'es', 'total'))}
           from cal left join mo on cal.nis_rad = mo.nis_rad and cal.mths = mo.mths),
    sh as (select *, case when total > 0 then 100 * es / total end as share from fi)"""


@query(
    "panel_from_features",
    "bills",
    "fsp",
    "road_segments",
    "raster_pixels",
    "customers_all",
    "tx_data",
    sql=f"""{PANEL_SQL}
            select nis_rad, mths as Nof_Mths, csmo_fact, {r('road * 111.32')} as min_dist2_road, cast(fsp as double) as fsp,
                   {r('population')} as population, {r('greatest(lights, 0)')} as Night_Lights, {r('share')} as Electrification,
                   total as total_structs
            from sh where nis_rad not in (select nis_rad from sh where share > 100)""",
)
def _(v):
    """Features around customers' own places, assembled to bills, aligned to months of tenure and prepared."""
    places, bills = v("customers_all"), v("bills")
    structures = places.select("LAT", "LON").unionByName(v("tx_data").select("LAT", "LON"))
    providers = v("fsp").withColumn("factype", F.when(F.col("factype") == "LARGE", "SACCO").otherwise(F.col("factype")))
    sets = plan.extract_features(
        bills,
        places,
        providers,
        v("raster_pixels"),
        v("road_segments"),
        v("raster_pixels"),
        places,
        v("tx_data"),
        structures=structures,
    )
    wanted = ["SACCO", "population", "distance_to_road", "lights_mean", "electrified_structures", "total_structs"]
    table = plan.assemble_features(cleaning.add_tenure(bills, places), places, *sets.values())
    prepared = panel.prepare_panel(plan.tenure_panel(table, wanted))
    return prepared.select(
        "nis_rad",
        "Nof_Mths",
        "csmo_fact",
        "min_dist2_road",
        "fsp",
        "population",
        "Night_Lights",
        "Electrification",
        "total_structs",
    )
