"""The engine's inputs, derived from the given tables by SQL both engines run.

Every view reads its whole base tables. Integer-valued measures keep sums exact.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS = {
    "locations": """
        select s_suppkey as NIS_RAD,
               -1.5 + cast((s_suppkey * 7919) % 4001 as double) / 4001 * 0.5 as LAT,
               36.6 + cast((s_suppkey * 104729) % 5003 as double) / 5003 * 0.5 as LON,
               cast(timestamp '1994-06-01' + ((s_suppkey * 37) % 900) * interval '1' day as timestamp)
                   as installation,
               case when s_nationkey % 5 < 3 then 'Rural' else 'Urban' end as rural_urban
        from {supplier}""",
    "locations_raw": """
        select s_suppkey as NIS_RAD,
               case when s_acctbal < 0 then null else l.LAT end as LAT, l.LON,
               l.installation
        from {supplier} join locations l on s_suppkey = l.NIS_RAD""",
    "bills": """
        select l_suppkey as nis_rad, l_shipdate as f_fact,
               date_trunc('month', l_shipdate) as period, l_quantity as csmo_fact
        from {lineitem}""",
    "panel": """
        select b.nis_rad,
               cast((year(b.period) - year(t.installation)) * 12
                    + month(b.period) - month(t.installation) as int) as Nof_Mths,
               b.period as Month, t.rural_urban,
               cast(year(t.installation) as int) as Year_of_connection,
               sum(b.csmo_fact) as csmo_fact
        from bills b join locations t on b.nis_rad = t.NIS_RAD
        where b.f_fact >= t.installation
        group by 1, 2, 3, 4, 5""",
    "customers_all": """
        select c_custkey as NIS_RAD,
               -1.5 + cast((c_custkey * 6007) % 3001 as double) / 3001 * 0.5 as LAT,
               36.6 + cast((c_custkey * 9973) % 4507 as double) / 4507 * 0.5 as LON,
               case when c_acctbal > 9800 then null
                    else cast(timestamp '1994-01-01' + ((c_custkey * 53) % 2500) * interval '1' day
                              as timestamp) end as installation,
               c_mktsegment as mktsegment, c_acctbal as acctbal
        from {customer}""",
    "tx_data": """
        select NIS_RAD as tx_id, LAT, LON from customers_all where mktsegment = 'BUILDING'
        union all
        select -1 - NIS_RAD as tx_id, LAT, LON from customers_all
        where mktsegment = 'BUILDING' and acctbal < 2000
        union all
        select -100000000 - NIS_RAD as tx_id, LAT, LON from customers_all where acctbal < 0""",
    "fsp": """
        select p_partkey as fsp_id, p_type as factype,
               -1.5 + cast((p_partkey * 6151) % 2999 as double) / 2999 * 0.5 as Lat,
               36.6 + cast((p_partkey * 7877) % 4001 as double) / 4001 * 0.5 as Lon,
               case when p_size % 10 = 0 then 0 else 1990 + p_size end as year,
               1 + p_size % 12 as month, 1 + p_size % 28 as day
        from {part}""",
    "road_segments": """
        select p_partkey as road_id, 0 as seg,
               case p_size % 3 when 0 then 'A' when 1 then 'B' else 'C' end as ROADCLASS,
               36.6 + cast((p_partkey * 3571) % 3989 as double) / 3989 * 0.5 as x1,
               -1.5 + cast((p_partkey * 2749) % 3001 as double) / 3001 * 0.5 as y1,
               36.6 + cast((p_partkey * 3571) % 3989 as double) / 3989 * 0.5
                   + (cast(p_size as double) - 25) / 1000 as x2,
               -1.5 + cast((p_partkey * 2749) % 3001 as double) / 3001 * 0.5
                   + (cast(p_size * 7 % 50 as double) - 25) / 1000 as y2
        from {part}""",
    "raster_pixels": """
        select y.year, cast(floor(cast(o_orderkey as double) / 100) as int) as py, cast(o_orderkey % 100 as int) as px,
               36.6 + (cast(o_orderkey % 100 as double) + 0.5) * 0.005 as lon_c,
               -1.0 - (cast(floor(cast(o_orderkey as double) / 100) as double) + 0.5) * 0.005 as lat_c,
               cast((cast(floor(o_totalprice) as bigint) + y.year * 7) % 97 - 3 as double) as value
        from {orders}
        cross join (select 1995 as year union all select 1998 union all select 2001) y""",
    "rural_urban_pixels": """
        select cast(770 + floor(cast(p_partkey as double) / 70) as int) as Y, cast(320 + p_partkey % 70 as int) as X,
               case p_size % 4 when 0 then cast('-Infinity' as double)
                    when 1 then cast(0 as double) when 2 then cast(50 as double)
                    else cast(100 as double) end as pixel_value
        from {part}""",
    "features": """
        select p.*, cast((p.nis_rad * 23) % 50 as double) / 1000 as min_dist2_road,
               cast((p.nis_rad + p.Nof_Mths) % 4 as double) as commercial_bank,
               cast((p.nis_rad * 3 + p.Nof_Mths) % 9 as double) as Mobile_Money_agents,
               case when p.Nof_Mths % 5 = 0 then null
                    else cast(p.nis_rad % 3 as double) end as SACCO,
               cast(1000 + (p.nis_rad * 7 + p.Nof_Mths * 3) % 500 as double) as population,
               case when p.nis_rad % 33 = 0 then null
                    else cast(50 + (p.nis_rad * 31) % 400 as double) end as total_structs,
               cast((p.nis_rad * 11 + p.Nof_Mths * 5) % 63 - 2 as double) as Night_Lights,
               case when p.nis_rad % 40 = 1 and p.Nof_Mths = 30 then cast(1.2 as double)
                    else cast((p.nis_rad * 17) % 100 as double) / 100 end as Electrification,
               cast(500 + p.nis_rad % 40 + p.Nof_Mths as double) as GDP
        from panel p""",
    "gcp": """
        select nis_rad, Nof_Mths,
               case when (nis_rad + Nof_Mths) % 17 = 0 then null
                    else cast(100 + (nis_rad * 13 + Nof_Mths * 7) % 50 as double) end as GCP
        from panel""",
}


def _needs(name: str, seen: dict[str, None]) -> dict[str, None]:
    for other in VIEWS:
        if other != name and re.search(rf"(from|join)\s+{other}\b", VIEWS[name]):
            _needs(other, seen)
    seen[name] = None
    return seen


def _with(names: tuple[str, ...]) -> str:
    needed: dict[str, None] = {}
    for name in names:
        _needs(name, needed)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed)


def oracle(*names: str, body: str) -> str:
    """SQL over the given tables: the named views, then `body`, which may go on with CTEs."""
    text = _with(names).format(**{t: t for t in BASE_TABLES})
    body = body.strip()
    return f"{text}, {body[5:]}" if body.lower().startswith("with ") else f"{text}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same view as a DataFrame over the Parquet tables."""
    text = f"{_with((name,))}\nselect * from {name}"
    used = [t for t in BASE_TABLES if f"{{{t}}}" in text]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(text, **tables)
