"""Cleaning, growth, segments, panel, quality and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.functions import scalars
from gridpanel.operators import (
    cleaning,
    distributions,
    growth,
    panel,
    quality,
    segments,
)
from gridpanel.operators.regression import lag_within
from registry.base import query, r, yyyymm, yyyymmdd

QUARTILE_SQL = f"""
    {r('quantile_cont(csmo_fact, 0.25)')} as Qrtl1, {r('quantile_cont(csmo_fact, 0.5)')} as Median,
    {r('quantile_cont(csmo_fact, 0.75)')} as Qrtl3"""


# ---------------------------------------------------------------- cleaning and joins


@query(
    "clean_locations",
    "locations_raw",
    sql=f"""select NIS_RAD, {r('LAT')} as LAT, {r('LON')} as LON from locations_raw
            where LAT is not null and LON is not null""",
)
def _(v):
    return cleaning.clean_locations(v("locations_raw")).select("NIS_RAD", "LAT", "LON")


@query(
    "clean_bills",
    "bills",
    sql="""with d as (select distinct nis_rad, f_fact, period, csmo_fact from bills)
           select nis_rad, cast(strftime(f_fact, '%Y%m%d') as int) as day,
                  cast(strftime(period, '%Y%m') as int) as month, csmo_fact
           from d where csmo_fact <= (select quantile_cont(csmo_fact, 0.95) from d)""",
)
def _(v):
    # Dates arrive as day-first text, as in the files the operator is made for.
    raw = v("bills").withColumn("f_fact", F.date_format("f_fact", "dd/MM/yyyy"))
    clean = cleaning.clean_bills(raw)
    return clean.select(
        "nis_rad",
        yyyymmdd(F.col("f_fact")).alias("day"),
        yyyymm(F.col("period")).alias("month"),
        "csmo_fact",
    )


@query(
    "bill_locations",
    "bills",
    "locations_raw",
    sql=f"""select b.nis_rad, count(*) as bills, {r('max(l.LAT)')} as LAT, {r('max(l.LON)')} as LON
            from bills b left join (select * from locations_raw
                 where LAT is not null and LON is not null) l on b.nis_rad = l.NIS_RAD
            group by 1""",
)
def _(v):
    joined = cleaning.attach_locations(v("bills"), cleaning.clean_locations(v("locations_raw")))
    return joined.groupBy("nis_rad").agg(
        F.count(F.lit(1)).alias("bills"), F.max("LAT").alias("LAT"), F.max("LON").alias("LON")
    )


@query(
    "tenure_months",
    "bills",
    "locations",
    sql="""select b.nis_rad, cast(strftime(f_fact, '%Y%m%d') as int) as day,
                  cast(trunc(epoch(cast(f_fact as timestamp) - installation)
                       / (30.436875 * 86400)) as int) as months_since_connection
           from bills b left join locations l on b.nis_rad = l.NIS_RAD""",
)
def _(v):
    rows = cleaning.add_tenure(v("bills"), v("locations"))
    return rows.select(
        "nis_rad", yyyymmdd(F.col("f_fact")).alias("day"), "months_since_connection"
    )


@query(
    "valid_coordinates",
    "customers_all",
    sql=f"""select NIS_RAD, {r('LAT')} as LAT, {r('LON')} as LON from customers_all
            where LAT between -1.4 and -1.1 and LON between 36.7 and 37""",
)
def _(v):
    box = {"min_lat": -1.4, "max_lat": -1.1, "min_lon": 36.7, "max_lon": 37}
    return cleaning.filter_valid(v("customers_all"), bounds=box).select("NIS_RAD", "LAT", "LON")


@query(
    "bills_of_rural_customers",
    "bills",
    "locations",
    sql="""select nis_rad, count(*) as bills, sum(csmo_fact) as kwh from bills
           where nis_rad in (select NIS_RAD from locations where rural_urban = 'Rural') group by 1""",
)
def _(v):
    rural = v("locations").filter("rural_urban = 'Rural'")
    kept = cleaning.keep_keys(v("bills"), rural, "nis_rad", "NIS_RAD")
    return kept.groupBy("nis_rad").agg(
        F.count(F.lit(1)).alias("bills"), F.sum("csmo_fact").alias("kwh")
    )


@query(
    "customers_without_transformer",
    "customers_all",
    "tx_data",
    sql="""select NIS_RAD, mktsegment from customers_all
           where NIS_RAD not in (select tx_id from tx_data)""",
)
def _(v):
    return cleaning.drop_keys(v("customers_all"), v("tx_data"), "NIS_RAD", "tx_id").select(
        "NIS_RAD", "mktsegment"
    )


@query(
    "first_bill_per_customer",
    "bills",
    sql="""select nis_rad, cast(strftime(f_fact, '%Y%m%d') as int) as day, csmo_fact
           from (select *, row_number() over (partition by nis_rad order by f_fact, csmo_fact) as rn
                 from bills) t where rn = 1""",
)
def _(v):
    first = cleaning.first_per_key(v("bills"), "nis_rad", ["f_fact", "csmo_fact"])
    return first.select("nis_rad", yyyymmdd(F.col("f_fact")).alias("day"), "csmo_fact")


# ---------------------------------------------------------------- growth


@query(
    "growth_curve",
    "panel",
    sql=f"""select Nof_Mths, {QUARTILE_SQL}, count(*) as "count" from panel group by 1""",
)
def _(v):
    return growth.growth_curve(v("panel"))


@query(
    "growth_attached",
    "panel",
    sql=f"""select p.nis_rad, p.Nof_Mths, p.csmo_fact, q.Qrtl1, q.Median, q.Qrtl3
            from panel p join (select Nof_Mths, {QUARTILE_SQL} from panel group by 1) q
              on p.Nof_Mths = q.Nof_Mths""",
)
def _(v):
    rows = growth.growth_curve(v("panel"), attach=True)
    return rows.select("nis_rad", "Nof_Mths", "csmo_fact", *growth.QUARTILES)


@query(
    "growth_by_location",
    "panel",
    sql=f"""select rural_urban, Nof_Mths, {QUARTILE_SQL}, count(*) as "count" from panel
            where Nof_Mths < 120 group by 1, 2 order by 1, 2""",
)
def _(v):
    rows = cleaning.within_tenure(v("panel"), C.MAX_MONTHS_PLOT, inclusive=False)
    return growth.growth_curve(rows, ["rural_urban", "Nof_Mths"]).orderBy("rural_urban", "Nof_Mths")


@query(
    "bill_quantiles_by_tenure",
    "bills",
    "locations",
    sql=f"""with d as (select distinct nis_rad, f_fact, period, csmo_fact from bills),
            c as (select * from d where csmo_fact <= (select quantile_cont(csmo_fact, 0.95) from d)),
            t as (select l.rural_urban, cast(trunc(epoch(cast(f_fact as timestamp) - installation)
                         / (30.436875 * 86400)) as int) as Nof_Mths, csmo_fact
                  from c join locations l on c.nis_rad = l.NIS_RAD)
            select rural_urban, Nof_Mths, {QUARTILE_SQL}, count(*) as "count" from t
            group by 1, 2""",
)
def _(v):
    bills = cleaning.add_tenure(cleaning.clean_bills(v("bills")), v("locations"))
    rows = cleaning.attach_locations(bills, v("locations"), ["rural_urban"])
    rows = rows.withColumnRenamed("months_since_connection", "Nof_Mths")
    return growth.growth_curve(rows, ["rural_urban", "Nof_Mths"])


@query(
    "calendar_curve",
    "panel",
    sql=f"""select cast(strftime(Month, '%Y%m') as int) as month, {QUARTILE_SQL}, count(*) as "count"
            from panel group by 1""",
)
def _(v):
    curve = growth.calendar_curve(v("panel"))
    return curve.select(yyyymm(F.col("Month")).alias("month"), *growth.QUARTILES, "count")


@query(
    "connection_year_curve",
    "panel",
    sql=f"""select Nof_Mths, Year_of_connection, {QUARTILE_SQL}, count(*) as "count" from panel
            where Nof_Mths < 120 and Year_of_connection >= 1995 group by 1, 2 having count(*) > 30""",
)
def _(v):
    return growth.connection_year_curve(v("panel"), min_year=1995, min_count=31)


@query(
    "class_curve",
    "panel",
    "locations",
    "rural_urban_pixels",
    sql=f"""with px as (
              select NIS_RAD, cast(floor(abs(33.91261 - LON) / 0.008333) as int) as X,
                     cast(floor(abs(5.470695 - LAT) / 0.008340186677631579) as int) as Y from locations),
            cl as (
              select NIS_RAD, case pixel_value when 0 then 'Peri_Urban' when 50 then 'Urban'
                              when 100 then 'Rural' end as classification
              from px join rural_urban_pixels using (X, Y))
            select classification, Nof_Mths, {QUARTILE_SQL}, count(*) as "count"
            from panel p join cl on p.nis_rad = cl.NIS_RAD
            where classification is not null and Nof_Mths <= 125 group by 1, 2""",
)
def _(v):
    from gridpanel.operators.raster import classify_pixels

    classified = classify_pixels(v("locations"), v("rural_urban_pixels"))
    return growth.class_curve(v("panel"), classified)


# ---------------------------------------------------------------- segments


@query(
    "consumption_summary",
    "bills",
    sql=f"""select nis_rad, {r('avg(csmo_fact)')} as Mean_Kwh,
                   {r('quantile_cont(csmo_fact, 0.5)')} as Median_Kwh,
                   {r('stddev_samp(csmo_fact)')} as Std_Kwh, count(csmo_fact) as "Count"
            from bills group by 1""",
)
def _(v):
    return segments.consumption_summary(v("bills"))


@query(
    "customer_statistics",
    "bills",
    sql=f"""select nis_rad, {r('avg(csmo_fact)')} as Mean, {r('quantile_cont(csmo_fact, 0.5)')} as Median,
                   max(csmo_fact) as Max, min(csmo_fact) as Min,
                   {r('stddev_samp(csmo_fact)')} as Std, count(csmo_fact) as "Count"
            from bills group by 1""",
)
def _(v):
    return segments.customer_statistics(v("bills"))


TIERS_SQL = """s as (select nis_rad, avg(csmo_fact) as m from panel group by 1),
    c as (select quantile_cont(m, 0.33) as c0, quantile_cont(m, 0.67) as c1 from s),
    t as (select nis_rad, m, case when m <= c0 then 'Low' when m <= c1 then 'Medium'
                 when m > c1 then 'High' end as segment from s cross join c)"""


@query(
    "consumption_tiers",
    "panel",
    sql=f"with {TIERS_SQL} select nis_rad, {r('m')} as Mean_Kwh, segment from t",
)
def _(v):
    tiers = segments.consumption_tiers(segments.consumption_summary(v("panel")))
    return tiers.select("nis_rad", "Mean_Kwh", "segment")


@query(
    "segment_report",
    "panel",
    sql=f"""with {TIERS_SQL}
            select segment, count(distinct p.nis_rad) as customer_count, count(*) as bill_count,
                   {r('avg(csmo_fact)')} as avg_consumption,
                   {r('quantile_cont(csmo_fact, 0.5)')} as median_consumption
            from panel p join t on p.nis_rad = t.nis_rad group by 1""",
)
def _(v):
    tiers = segments.consumption_tiers(segments.consumption_summary(v("panel")))
    return segments.segment_report(v("panel"), tiers)


@query(
    "segment_growth",
    "panel",
    sql=f"""with {TIERS_SQL}
            select segment, Nof_Mths, {QUARTILE_SQL}, count(*) as "count"
            from panel p join t on p.nis_rad = t.nis_rad where Nof_Mths <= 125
            group by 1, 2 having count(*) > 20""",
)
def _(v):
    tiers = segments.consumption_tiers(segments.consumption_summary(v("panel")))
    return segments.segment_growth(v("panel"), tiers, min_count=21, max_months=125)


@query(
    "cluster_growth",
    "panel",
    "locations",
    sql=f"""select 'SC' || (case rural_urban when 'Rural' then 0 else 1 end) as segment,
                   Nof_Mths, {QUARTILE_SQL}, count(*) as "count" from panel group by 1, 2""",
)
def _(v):
    label = F.when(F.col("rural_urban") == "Rural", 0).otherwise(1)
    labels = v("locations").select(
        F.col("NIS_RAD").alias("nis_rad"), F.lit(2).alias("k"), label.alias("label")
    )
    return segments.cluster_growth(v("panel"), labels, 2)


PREPARED_SQL = """prep as (
    select nis_rad, Nof_Mths, Month, rural_urban, Year_of_connection, csmo_fact,
           min_dist2_road * 111.32 as min_dist2_road,
           coalesce(commercial_bank, 0) + coalesce(Mobile_Money_agents, 0) + coalesce(SACCO, 0) as fsp,
           population, coalesce(total_structs, 0) as total_structs,
           case when Night_Lights < 0 then 0 else Night_Lights end as Night_Lights,
           Electrification * 100 as Electrification, GDP
    from features
    where nis_rad not in (select nis_rad from features where Electrification * 100 > 100))"""


def _dummy_sql(variable: str) -> str:
    low, rest = ("High", "Low") if variable == "min_dist2_road" else ("Low", "High")
    return (
        f"case when {variable} < quantile_cont({variable}, 0.5) over (partition by rural_urban)"
        f" then '{low}' else '{rest}' end as {variable}_dummy"
    )


DUMMIES_SQL = f"""{PREPARED_SQL},
    dum as (select *, {', '.join(_dummy_sql(x) for x in C.DUMMY_SOURCES)} from prep)"""


@query(
    "dummy_curve",
    "features",
    sql=f"""with {DUMMIES_SQL}
            select rural_urban, population_dummy, Nof_Mths,
                   {r('quantile_cont(csmo_fact, 0.5)')} as med, count(*) as "count"
            from dum where Nof_Mths < 120 group by 1, 2, 3""",
)
def _(v):
    rows = panel.median_dummies(panel.prepare_panel(v("features")))
    return segments.dummy_curve(rows, "population_dummy", by_location=True)


@query(
    "road_dummy_curve",
    "features",
    sql=f"""with {DUMMIES_SQL}
            select min_dist2_road_dummy, Nof_Mths,
                   {r('quantile_cont(csmo_fact, 0.5)')} as med, count(*) as "count"
            from dum where Nof_Mths < 120 and rural_urban = 'Urban' group by 1, 2""",
)
def _(v):
    rows = panel.median_dummies(panel.prepare_panel(v("features")))
    return segments.dummy_curve(rows, "dist2_road_dummy", location="Urban")


def _pairs_sql() -> str:
    parts = []
    order = C.DUMMY_PLOT_ORDER
    for i, d1 in enumerate(order):
        for d2 in order[i + 1 :]:
            c1, c2 = C.DUMMY_ALIASES.get(d1, d1), C.DUMMY_ALIASES.get(d2, d2)
            s1, s2 = d1.split("_")[0], d2.split("_")[0]
            pair = d1.replace("_dummy", "") + "_" + d2.replace("_dummy", "")
            parts.append(
                f"select '{pair}' as pair, rural_urban, {c1} || '_{s1}_' || {c2} || '_{s2}'"
                " as dummy_comb, Nof_Mths, csmo_fact from dum where Nof_Mths < 120"
            )
    return " union all ".join(parts)


@query(
    "interaction_curves",
    "features",
    sql=f"""with {DUMMIES_SQL}, e as ({_pairs_sql()})
            select pair, rural_urban, dummy_comb, Nof_Mths,
                   {r('quantile_cont(csmo_fact, 0.5)')} as med from e group by 1, 2, 3, 4""",
)
def _(v):
    rows = panel.median_dummies(panel.prepare_panel(v("features")))
    return segments.interaction_curves(rows)


# ---------------------------------------------------------------- panel


@query(
    "prepared_panel",
    "features",
    sql=f"""with {PREPARED_SQL}
            select nis_rad, Nof_Mths, {r('min_dist2_road')} as min_dist2_road, fsp, total_structs,
                   Night_Lights, {r('Electrification')} as Electrification from prep""",
)
def _(v):
    return panel.prepare_panel(v("features")).select(
        "nis_rad",
        "Nof_Mths",
        "min_dist2_road",
        "fsp",
        "total_structs",
        "Night_Lights",
        "Electrification",
    )


COMPLETE_SQL = """spans as (
    select nis_rad, rural_urban, Year_of_connection, max(Nof_Mths) - min(Nof_Mths) as nof_M,
           count(*) as "count" from panel group by 1, 2, 3)"""


@query(
    "complete_customers",
    "panel",
    sql=f"""with {COMPLETE_SQL} select * from spans where "count" - nof_M >= 0""",
)
def _(v):
    return panel.complete_customers(v("panel"))


TARGETS_SQL = f"""{COMPLETE_SQL},
    st as (select rural_urban, Year_of_connection, count(*) as available from spans
           where "count" - nof_M >= 0 group by 1, 2),
    w as (select *, available / sum(available) over (partition by rural_urban) as weight from st),
    tg as (select *, round_even(weight * (case rural_urban when 'Rural' then 0.59 * 60
                                          else (1 - 0.59) * 60 end), 0) as want from w)"""


@query(
    "stratum_targets",
    "panel",
    sql=f"""with {TARGETS_SQL}
            select rural_urban, Year_of_connection, available, {r('weight')} as weight,
                   cast(case when available >= want then want else 0 end as bigint) as target from tg""",
)
def _(v):
    return panel.stratum_targets(panel.complete_customers(v("panel")), 60, C.RURAL_SHARE)


@query(
    "balanced_sample_sizes",
    "features",
    sql=f"""with {TARGETS_SQL}
            select rural_urban, Year_of_connection, cast(want as bigint) as customers
            from tg where available >= want and want > 0""",
)
def _(v):
    features = v("features")
    in_order = features.withColumn("Year_of_connection", F.col("Year_of_connection") + 20)
    sample = panel.balanced_sample(in_order, 60, C.RURAL_SHARE)
    counted = sample.groupBy("rural_urban", "Year_of_connection").agg(
        F.count_distinct("nis_rad").alias("customers")
    )
    return counted.withColumn("Year_of_connection", F.col("Year_of_connection") - 20)


@query("balanced_sample", "features")
def _(v):
    in_order = v("features").withColumn("Year_of_connection", F.col("Year_of_connection") + 20)
    return panel.balanced_sample(in_order, 60, C.RURAL_SHARE).select(
        "nis_rad", "rural_urban", "Nof_Mths", "csmo_fact"
    )


@query(
    "median_dummies",
    "features",
    sql=f"""with {DUMMIES_SQL}
            select nis_rad, Nof_Mths, {', '.join(f'{x}_dummy' for x in C.DUMMY_SOURCES)} from dum""",
)
def _(v):
    rows = panel.median_dummies(panel.prepare_panel(v("features")))
    return rows.select("nis_rad", "Nof_Mths", *[f"{x}_dummy" for x in C.DUMMY_SOURCES])


@query(
    "merged_gcp",
    "features",
    "gcp",
    sql="""select f.nis_rad, f.Nof_Mths,
                  case when Year_of_connection < 2010 then 2009 else Year_of_connection end
                      as Year_of_connection, f.GDP as GDP_annual, g.GCP as GDP
           from features f join gcp g on f.nis_rad = g.nis_rad and f.Nof_Mths = g.Nof_Mths
           where g.GCP is not null""",
)
def _(v):
    text = v("gcp").withColumn("GCP", F.col("GCP").cast("string"))
    return panel.merge_gcp(v("features"), text).select(
        "nis_rad", "Nof_Mths", "Year_of_connection", "GDP_annual", "GDP"
    )


@query(
    "log_transform",
    "features",
    sql=f"""with {PREPARED_SQL} select nis_rad, Nof_Mths,
            {', '.join(f"{r(f'ln({x} + 0.1)')} as {x}" for x in C.LOG_VARS)} from prep""",
)
def _(v):
    rows = panel.log_transform(panel.prepare_panel(v("features")))
    return rows.select("nis_rad", "Nof_Mths", *C.LOG_VARS)


@query(
    "standardized_panel",
    "features",
    sql=f"""with {PREPARED_SQL} select nis_rad, Nof_Mths,
            {', '.join(
                f"{r(f'({x} - avg({x}) over ()) / stddev_samp({x}) over ()')} as {x}"
                for x in C.CONTINUOUS_VARS)} from prep""",
)
def _(v):
    rows = panel.prepare_panel(v("features"))
    return panel.standardize(rows, C.CONTINUOUS_VARS).select(
        "nis_rad", "Nof_Mths", *C.CONTINUOUS_VARS
    )


@query(
    "demeaned_panel",
    "features",
    sql=f"""with {PREPARED_SQL} select nis_rad, Nof_Mths,
            {', '.join(
                f"{r(f'{x} - avg({x}) over (partition by nis_rad)')} as {x}, "
                f"{r(f'avg({x}) over (partition by nis_rad)')} as {x}_mean"
                for x in C.TIME_VARYING_VARS)} from prep""",
)
def _(v):
    rows = panel.demean_within(panel.prepare_panel(v("features")))
    return rows.select(
        "nis_rad",
        "Nof_Mths",
        *[c for x in C.TIME_VARYING_VARS for c in (x, f"{x}_mean")],
    )


@query(
    "lagged_consumption",
    "panel",
    sql="""select nis_rad, Nof_Mths, csmo_fact,
                  lag(csmo_fact) over (partition by nis_rad order by Nof_Mths) as csmo_fact_lag
           from panel""",
)
def _(v):
    rows = v("panel").select("nis_rad", "Nof_Mths", "csmo_fact")
    return lag_within(rows, ["csmo_fact"])


@query(
    "panel_by_location",
    "panel",
    sql=f"""select l.part, count(*) as rows, {r('sum(csmo_fact)')} as kwh from panel
            join (select 'urban' as part, 'Urban' as u union all select 'rural', 'Rural'
                  union all select 'combined', 'Urban' union all select 'combined', 'Rural') l
              on rural_urban = l.u group by 1""",
)
def _(v):
    from gridpanel.sources.readers import union_parts

    parts = panel.split_by_location(v("panel"))
    return union_parts(
        [
            p.agg(
                F.lit(name).alias("part"),
                F.count(F.lit(1)).alias("rows"),
                F.sum("csmo_fact").alias("kwh"),
            )
            for name, p in parts.items()
        ]
    )


@query(
    "long_features",
    "features",
    sql="""select nis_rad, Nof_Mths, 'population' as variable, population as value from features
           union all select nis_rad, Nof_Mths, 'total_structs', total_structs from features
           union all select nis_rad, Nof_Mths, 'GDP', GDP from features""",
)
def _(v):
    return scalars.to_long(
        v("features"), ["population", "total_structs", "GDP"], ["nis_rad", "Nof_Mths"]
    )


@query(
    "plausible_rows",
    "features",
    sql="""select nis_rad, Nof_Mths from features
           where population * 40 <= 50000 and Night_Lights * 20 <= 1000""",
)
def _(v):
    limits = scalars.plausible(F.col("population") * 40, F.col("Night_Lights") * 20)
    return v("features").filter(limits).select("nis_rad", "Nof_Mths")


# ---------------------------------------------------------------- distributions


@query(
    "ecdf",
    "features",
    sql=f"""with c as (select total_structs as value, count(*) as n from features group by 1)
            select value, {r('sum(n) over (order by value) / (select count(*) from features)')} as cdf
            from c where value is not null""",
)
def _(v):
    return distributions.ecdf(v("features"), "total_structs")


@query(
    "ecdf_by_location",
    "features",
    sql=f"""with m as (select nis_rad, min_by(rural_urban, Nof_Mths) as rural_urban,
                              avg(total_structs) as v from features group by 1),
            c as (select rural_urban, v as value, count(*) as n from m where v is not null group by 1, 2)
            select rural_urban, {r('value')} as value,
                   {r('sum(n) over (partition by rural_urban order by value) / sum(n) over (partition by rural_urban)')}
                   as cdf from c""",
)
def _(v):
    means = distributions.customer_means(v("features"), ["total_structs"])
    return distributions.ecdf(means, "total_structs", "rural_urban", "non_null")


@query(
    "consumption_cdf",
    "bills",
    sql=f"""with c as (select csmo_fact as value, count(*) as n from bills group by 1),
            e as (select value, sum(n) over (order by value) / sum(n) over () as cdf from c)
            select value, {r('cdf')} as cdf from e where cdf <= 0.99""",
)
def _(v):
    return distributions.ecdf(v("bills"), "csmo_fact", upto=0.99)


@query(
    "price_cdf",
    "bills",
    sql=f"""with c as (select l_extendedprice as value, count(*) as n from lineitem group by 1)
            select value, {r('sum(n) over (order by value) / sum(n) over ()')} as cdf from c""",
)
def _(v):
    spark, sf_dir = v.args
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return distributions.ecdf(rows, "l_extendedprice")


@query(
    "customer_means",
    "features",
    sql=f"""select nis_rad, {r('avg(total_structs)')} as total_structs,
                   {r('avg(population)')} as population, {r('avg(Night_Lights)')} as Night_Lights,
                   min_by(rural_urban, Nof_Mths) as rural_urban from features group by 1""",
)
def _(v):
    return distributions.customer_means(
        v("features"), ["total_structs", "population", "Night_Lights"]
    )


@query(
    "histogram",
    "features",
    sql=f"""with s as (select min(csmo_fact) as lo, max(csmo_fact) as hi,
                      (max(csmo_fact) - min(csmo_fact)) / 29 as w from features),
            o as (select *, (floor(lo / w - 0.5) + 0.5) * w as origin from s),
            b as (select rural_urban, greatest(cast(ceil((csmo_fact - origin) / w) - 1 as bigint), 0) as bin,
                         count(*) as n from features cross join o group by 1, 2),
            f as (select rural_urban, unnest(generate_series(0,
                         greatest(cast(ceil((hi - origin) / w) - 1 as bigint), 0))) as bin, origin, w
                  from (select distinct rural_urban from features) cross join o)
            select f.rural_urban, f.bin, {r('origin + f.bin * w')} as low,
                   {r('origin + f.bin * w + w')} as high, coalesce(n, 0) as "count"
            from f left join b on f.rural_urban = b.rural_urban and f.bin = b.bin""",
)
def _(v):
    return distributions.histogram(v("features"), "csmo_fact", by="rural_urban")


# ---------------------------------------------------------------- quality


@query(
    "panel_structure",
    "features",
    sql="""select count(distinct nis_rad) as n_individuals, count(distinct Nof_Mths) as n_time_periods,
                  count(*) as n_observations,
                  count(*) = count(distinct nis_rad) * count(distinct Nof_Mths) as is_balanced
           from features""",
)
def _(v):
    return quality.validate_panel(v("features"))["structure"]


@query(
    "missing_values",
    "features",
    sql="""select 'SACCO' as variable, count(*) as missing_count from features where SACCO is null
           union all select 'total_structs', count(*) from features where total_structs is null""",
)
def _(v):
    return quality.validate_panel(v("features"))["missing"]


QUALITY_VARS = ("csmo_fact", "population", "total_structs", "Night_Lights", "GDP")


@query(
    "value_ranges",
    "features",
    sql=" union all ".join(
        f"select '{x}' as variable, min({x}) as min, max({x}) as max from features"
        for x in QUALITY_VARS
    ),
)
def _(v):
    rows = v("features").select(*QUALITY_VARS, F.lit(1).alias("nis_rad"), F.lit(1).alias("Nof_Mths"))
    ranges = quality.validate_panel(rows)["ranges"]
    return ranges.filter(F.col("variable").isin(*QUALITY_VARS))


@query(
    "outliers",
    "features",
    sql=" union all ".join(
        f"""select '{x}' as variable,
            count(*) filter ({x} < q1 - 1.5 * (q3 - q1) or {x} > q3 + 1.5 * (q3 - q1)) as n_outliers,
            {r(f'count(*) filter ({x} < q1 - 1.5 * (q3 - q1) or {x} > q3 + 1.5 * (q3 - q1)) / count(*)')}
                as outlier_rate,
            {r('max(q1 - 1.5 * (q3 - q1))')} as lower_bound,
            {r('max(q3 + 1.5 * (q3 - q1))')} as upper_bound
            from features cross join (select quantile_cont({x}, 0.25) as q1,
                 quantile_cont({x}, 0.75) as q3 from features)"""
        for x in QUALITY_VARS
    ),
)
def _(v):
    return quality.detect_outliers(v("features"), QUALITY_VARS)


@query(
    "bill_outliers",
    "bills",
    sql=f"""with q as (select quantile_cont(l_extendedprice, 0.25) as q1,
                              quantile_cont(l_extendedprice, 0.75) as q3 from lineitem)
            select 'l_extendedprice' as variable,
                   count(*) filter (l_extendedprice > q3 + 0.5 * (q3 - q1)
                                    or l_extendedprice < q1 - 0.5 * (q3 - q1)) as n_outliers,
                   {r('''count(*) filter (l_extendedprice > q3 + 0.5 * (q3 - q1)
                         or l_extendedprice < q1 - 0.5 * (q3 - q1)) / count(*)''')} as outlier_rate,
                   {r('max(q1 - 0.5 * (q3 - q1))')} as lower_bound,
                   {r('max(q3 + 0.5 * (q3 - q1))')} as upper_bound from lineitem cross join q""",
)
def _(v):
    spark, sf_dir = v.args
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return quality.detect_outliers(rows, ["l_extendedprice"], multiplier=0.5)


def _stats_sql(x: str) -> str:
    return (
        f"{r(f'avg({x})')} as {x}_mean, {r(f'quantile_cont({x}, 0.5)')} as {x}_median, "
        f"{r(f'stddev_samp({x})')} as {x}_sd, min({x}) as {x}_min, max({x}) as {x}_max"
    )


@query(
    "summary_stats",
    "features",
    sql=f"""select rural_urban, {', '.join(_stats_sql(x) for x in QUALITY_VARS)}, count(*) as n
            from features group by 1""",
)
def _(v):
    return quality.summary_stats(v("features"), variables=QUALITY_VARS)


def _corr_sql(rows: str, names: tuple[str, ...] = QUALITY_VARS) -> str:
    return " union all ".join(
        f"select '{a}' as var1, '{b}' as var2, {r(f'corr({a}, {b})')} as correlation from {rows}"
        for a in names
        for b in names
        if a != b
    )


COMPLETE_ROWS = " and ".join(f"{x} is not null" for x in QUALITY_VARS)


@query(
    "correlations",
    "features",
    sql=f"""with ok as (select * from features where {COMPLETE_ROWS})
            select * from ({_corr_sql('ok')}) order by abs(correlation) desc, var1, var2""",
)
def _(v):
    return quality.correlations(v("features"), QUALITY_VARS)


@query(
    "rank_correlations",
    "features",
    sql=f"""with ok as (select * from features where {COMPLETE_ROWS}),
            rk as (select {', '.join(
                f"rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0 as {x}"
                for x in QUALITY_VARS)} from ok)
            select * from ({_corr_sql('rk')}) order by abs(correlation) desc, var1, var2""",
)
def _(v):
    return quality.correlations(v("features"), QUALITY_VARS, "spearman")


REPORT_VARS = ("nis_rad", "Nof_Mths", *QUALITY_VARS)


@query(
    "strong_correlations",
    "features",
    sql=f"""with ok as (select * from features where {COMPLETE_ROWS})
            select * from ({_corr_sql('ok', REPORT_VARS)}) where abs(correlation) > 0.7""",
)
def _(v):
    report = quality.quality_report(v("features").select("rural_urban", *REPORT_VARS))
    return report["high_correlations"]


def _report_sql() -> str:
    gaps = " union all ".join(
        f"select '{x}' as variable, count(*) as n from features where {x} is null having count(*) > 0"
        for x in ("rural_urban", *REPORT_VARS)
    )
    fixed = (
        (0, 0, "'Data Quality Report'"),
        (0, 1, "'=================='"),
        (0, 2, "''"),
        (0, 3, f"'Data Dimensions: ' || n_rows || ' rows x {len(REPORT_VARS) + 1} columns'"),
        (0, 4, "''"),
        (1, 0, "'Panel Structure:'"),
        (1, 1, "'- Individuals: ' || ids"),
        (1, 2, "'- Time periods: ' || times"),
        (1, 3, "'- Balanced: ' || upper(cast(n_rows = ids * times as varchar))"),
        (1, 4, "''"),
    )
    top = " union all ".join(f"select {a} as section, {b} as position, {text} as line from st" for a, b, text in fixed)
    return f"""with ok as (select * from features where {COMPLETE_ROWS}),
        st as (select count(*) as n_rows, count(distinct nis_rad) as ids, count(distinct Nof_Mths) as times from features),
        ms as ({gaps}),
        hc as (select * from ({_corr_sql('ok', REPORT_VARS)}) where abs(correlation) > 0.7)
        {top}
        union all select 2, 0, 'Missing Data:' where exists (from ms)
        union all select 2, 1, 'variable missing_count' where exists (from ms)
        union all select 2, 2, variable || ' ' || n from ms
        union all select 3, 0, 'High Correlations (|r| > 0.7):' where exists (from hc)
        union all select 3, 1, 'var1 var2 correlation' where exists (from hc)
        union all select 3, 2, var1 || ' ' || var2 || ' ' || format('{{:.6f}}', correlation) from hc"""


@query("quality_report", "features", sql=_report_sql())
def _(v):
    rows = v("features").select("nis_rad", "Nof_Mths", "rural_urban", *QUALITY_VARS)
    return quality.report_lines(quality.quality_report(rows))


@query(
    "described_features",
    "features",
    sql=" union all ".join(
        f"""select '{x}' as variable, count({x}) as "count", {r(f'avg({x})')} as mean,
            {r(f'stddev_samp({x})')} as std, min({x}) as min, {r(f'quantile_cont({x}, 0.25)')} as q25,
            {r(f'quantile_cont({x}, 0.5)')} as q50, {r(f'quantile_cont({x}, 0.75)')} as q75,
            max({x}) as max from features"""
        for x in QUALITY_VARS
    ),
)
def _(v):
    return quality.describe(v("features"), QUALITY_VARS)


@query(
    "display_names",
    "fsp",
    sql="""select distinct replace(replace(upper(substr(t, 1, 1)) || lower(substr(t, 2)), 'Gdp', 'GDP'),
                  '_', ' ') as name, count(*) as n
           from (select factype as t from fsp) group by 1""",
)
def _(v):
    named = v("fsp").select(scalars.display_name(F.col("factype")).alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
