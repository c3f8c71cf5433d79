"""Panel models, clustering and curves."""

from __future__ import annotations

import re
import uuid
from functools import partial

from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.operators import clustering, curves, panel, regression, segments
from gridpanel.plans import analysis
from gridpanel.session import ensure_checkpoint_dir, written
from registry.base import query, r
from registry.panel_queries import PREPARED_SQL

PAIR = ["population", "Night_Lights"]


def _prepared(v):
    return panel.prepare_panel(v("features"))


def _dummied(v):
    """Written at each step, since the next one reads it several times."""
    prepared = written(panel.prepare_panel(written(v("features"))))
    return written(panel.standardize(panel.median_dummies(prepared), [C.OUTCOME, *C.CONTINUOUS_VARS]))


def _table(v, fits):
    return regression.coefficient_table(v.args[0], fits)


def _coefficients(v, fits):
    return _table(v, fits).select("model", "term", "coef", "se", "r2", "n")


def _two_slopes(source: str, x1: str, x2: str, y: str, rows: str) -> str:
    """Closed form of a regression on two variables, from covariances of `source`."""
    return f"""mm as (select count(*) as n, avg({x1}) as m1, avg({x2}) as m2, avg({y}) as my,
              sum(({x1} - a1) * ({x1} - a1)) as s11, sum(({x1} - a1) * ({x2} - a2)) as s12,
              sum(({x2} - a2) * ({x2} - a2)) as s22, sum(({x1} - a1) * ({y} - ay)) as s1y,
              sum(({x2} - a2) * ({y} - ay)) as s2y, sum(({y} - ay) * ({y} - ay)) as syy
            from (select *, avg({x1}) over () as a1, avg({x2}) over () as a2, avg({y}) over () as ay
                  from {source})),
        bb as (select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1,
                 (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2,
                 s11 * s22 - s12 * s12 as det from mm),
        ee as (select *, syy - b1 * s1y - b2 * s2y as ssr, {rows} as df from bb)"""


SLOPES = (
    ("population", "b1", "sqrt(ssr / df * s22 / det)"),
    ("Night_Lights", "b2", "sqrt(ssr / df * s11 / det)"),
)
INTERCEPT = (
    "my - b1 * m1 - b2 * m2",
    "sqrt(ssr / df * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det))",
)


def _rows_sql(model: str, constant: str | None, r2: str = "1 - ssr / syy") -> str:
    terms = [] if constant is None else [(constant, *INTERCEPT)]
    return " union all ".join(
        f"select '{model}' as model, '{t}' as term, {r(b)} as coef, {r(se)} as se, {r(r2)} as r2, n from ee"
        for t, b, se in (*terms, *SLOPES)
    )


@query(
    "ols",
    "features",
    sql=f"""with {PREPARED_SQL}, {_two_slopes('prep', *PAIR, 'csmo_fact', 'n - 3')}
            {_rows_sql('ols', 'const')}""",
)
def _(v):
    return _coefficients(v, {"ols": regression.ols(_prepared(v), C.OUTCOME, PAIR)})


@query(
    "pooling_model",
    "features",
    sql=f"""with {PREPARED_SQL}, {_two_slopes('prep', *PAIR, 'csmo_fact', 'n - 3')}
            {_rows_sql('pooling', '(Intercept)')}""",
)
def _(v):
    fit = regression.panel_fit(_prepared(v), C.OUTCOME, PAIR, "pooling")
    return _coefficients(v, {"pooling": fit})


@query(
    "within_model",
    "features",
    sql=f"""with {PREPARED_SQL},
            dm as (select nis_rad, population - avg(population) over w as population,
                     Night_Lights - avg(Night_Lights) over w as Night_Lights,
                     csmo_fact - avg(csmo_fact) over w as csmo_fact
                   from prep window w as (partition by nis_rad)),
            {_two_slopes('dm', *PAIR, 'csmo_fact',
                         'n - (select count(distinct nis_rad) from prep) - 2')}
            {_rows_sql('within', None)}""",
)
def _(v):
    fit = regression.panel_fit(_prepared(v), C.OUTCOME, PAIR, "within")
    return _coefficients(v, {"within": fit})


@query(
    "between_model",
    "features",
    sql=f"""with {PREPARED_SQL},
            me as (select nis_rad, avg(population) as population, avg(Night_Lights) as Night_Lights,
                     avg(csmo_fact) as csmo_fact from prep group by 1),
            {_two_slopes('me', *PAIR, 'csmo_fact', 'n - 3')}
            {_rows_sql('between', '(Intercept)')}""",
)
def _(v):
    fit = regression.panel_fit(_prepared(v), C.OUTCOME, PAIR, "between")
    return _coefficients(v, {"between": fit})


def _tagged(text: str, tag: str) -> str:
    """The closed form under names of its own, to stand beside others."""
    return re.sub(r"\b(mm|bb|ee)\b", rf"\1_{tag}", text)


def _location_sql() -> str:
    parts, rows = [], []
    for location in ("Urban", "Rural"):
        tag = location[0].lower()
        parts.append(f"l{tag} as (select * from prep where rural_urban = '{location}')")
        parts.append(
            f"""d{tag} as (select nis_rad, population - avg(population) over w as population,
                  Night_Lights - avg(Night_Lights) over w as Night_Lights,
                  csmo_fact - avg(csmo_fact) over w as csmo_fact
                from l{tag} window w as (partition by nis_rad))"""
        )
        parts.append(_tagged(_two_slopes(f"l{tag}", *PAIR, "csmo_fact", "n - 3"), f"p{tag}"))
        free = f"n - (select count(distinct nis_rad) from l{tag}) - 2"
        parts.append(_tagged(_two_slopes(f"d{tag}", *PAIR, "csmo_fact", free), f"w{tag}"))
        rows.append(_tagged(_rows_sql(f"pool_{tag}", "(Intercept)"), f"p{tag}"))
        rows.append(_tagged(_rows_sql(f"fe_{tag}", None), f"w{tag}"))
    return f"with {PREPARED_SQL}, {', '.join(parts)} {' union all '.join(rows)}"


@query("location_models", "features", sql=_location_sql())
def _(v):
    fits = regression.panel_regression(_prepared(v), xs=PAIR)
    table = _coefficients(v, {name: fit for name, fit in fits.items() if not name.startswith("re_")})
    return table


RANDOM_SQL = f"""{PREPARED_SQL},
    q as (select nis_rad, population as x, csmo_fact as y, avg(population) over w as mx,
            avg(csmo_fact) over w as my, count(*) over w as t from prep
          window w as (partition by nis_rad)),
    i as (select nis_rad, any_value(mx) as mx, any_value(my) as my, any_value(t) as t from q group by 1),
    wi as (select sum((x - mx) * (x - mx)) as sxx, sum((x - mx) * (y - my)) as sxy,
             sum((y - my) * (y - my)) as syy, count(*) as n from q),
    be as (select count(*) as ids, sum(t) as p00, sum(t * mx) as p01, sum(t * mx * mx) as p11,
             sum(t * my) as p0y, sum(t * mx * my) as p1y, sum(t * my * my) as pyy,
             sum(t * t) as z00, sum(t * t * mx) as z01, sum(t * t * mx * mx) as z11 from i),
    vc as (select *, (syy - sxy * sxy / sxx) / (n - ids - 1) as s_e, p00 * p11 - p01 * p01 as det,
             pyy - p0y * p0y / p00
               - (p1y - p01 * p0y / p00) * (p1y - p01 * p0y / p00) / (p11 - p01 * p01 / p00) as qb
           from wi cross join be),
    su as (select *, greatest(0, (qb - (ids - 2) * s_e)
             / (n - (p11 * z00 - 2 * p01 * z01 + p00 * z11) / det)) as s_u from vc),
    qd as (select 1 - h as c, x - h * mx as x, y - h * my as y
           from (select q.*, 1 - sqrt(s_e / (s_e + t * s_u)) as h from q cross join su)),
    g as (select count(*) as n, sum(c * c) as cc, sum(c * x) as cx, sum(x * x) as xx, sum(c * y) as cy,
            sum(x * y) as xy, sum(y * y) as yy, sum(y) as sy from qd),
    ge as (select *, cc * xx - cx * cx as det, (cy * xx - xy * cx) / (cc * xx - cx * cx) as b0,
             (xy * cc - cy * cx) / (cc * xx - cx * cx) as b1 from g),
    gr as (select *, yy - b0 * cy - b1 * xy as ssr, yy - sy * sy / n as tss from ge)"""


@query(
    "random_effects_model",
    "features",
    sql=f"""with {RANDOM_SQL}
            select 'random' as model, '(Intercept)' as term, {r('b0', 4)} as coef,
                   {r('sqrt(ssr / (n - 2) * xx / det)', 4)} as se, {r('1 - ssr / tss', 4)} as r2, n from gr
            union all
            select 'random', 'population', {r('b1', 4)}, {r('sqrt(ssr / (n - 2) * cc / det)', 4)},
                   {r('1 - ssr / tss', 4)}, n from gr""",
)
def _(v):
    fit = regression.panel_fit(_prepared(v), C.OUTCOME, ["population"], "random")
    table = _coefficients(v, {"random": fit})
    return table.withColumns({c: F.round(c, 4) for c in ("coef", "se", "r2")})


@query(
    "panel_moments",
    "features",
    sql=f"""with {PREPARED_SQL}
            select nis_rad, count(*) as T, {', '.join(
                f"{r(f'avg({x})')} as {x}" for x in (*C.CONTINUOUS_VARS, C.OUTCOME))}
            from prep group by 1""",
)
def _(v):
    return regression.panel_moments(_prepared(v))


@query("panel_models_by_location", "features")
def _(v):
    fits = regression.panel_regression(_dummied(v))
    return _table(v, fits)


@query("model_comparison", "features")
def _(v):
    fits = regression.panel_regression(_dummied(v), xs=["population", "Night_Lights", "fsp"])
    return regression.compare(_table(v, fits))


@query("mundlak_model", "features")
def _(v):
    return _table(v, {"mundlak": regression.mundlak(_dummied(v))})


@query("dummy_effects", "features")
def _(v):
    return _table(v, regression.dummy_effects(_dummied(v)))


@query("subsample_models", "features")
def _(v):
    return _table(v, regression.subsamples(_dummied(v)))


@query("interaction_models", "features")
def _(v):
    return _table(v, regression.interactions(_dummied(v)))


@query("newey_west", "features")
def _(v):
    return _table(v, {"newey_west": regression.newey_west(_dummied(v))})


@query("cochrane_orcutt", "features")
def _(v):
    found = regression.cochrane_orcutt(_dummied(v))
    return _table(v, {k: found[k] for k in ("original", "transformed")})


@query("two_stage", "features")
def _(v):
    return _table(v, regression.two_stage(_dummied(v)))


@query("kmeans_scores", "bills")
def _(v):
    stats = segments.customer_statistics(v("bills"))
    scores, _ = clustering.kmeans_scan(stats, ["Mean", "Std"])
    return scores


@query(
    "kmeans_one_cluster",
    "bills",
    sql="""select 1 as k, -2.0 * count(*) as score
           from (select stddev_samp(csmo_fact) as s from bills group by nis_rad) where s is not null""",
)
def _(v):
    # One cluster of scaled columns: each has as many squares as rows.
    stats = segments.customer_statistics(v("bills"))
    scores, _ = clustering.kmeans_scan(stats, ["Mean", "Std"], ks=[1])
    return scores


@query("kmeans_labels", "bills")
def _(v):
    stats = segments.customer_statistics(v("bills"))
    _, labels = clustering.kmeans_scan(stats, ["Mean", "Std"], ks=[1, 3])
    return labels


@query("decay_fit", "panel")
def _(v):
    return curves.fit_decay(v("panel"), by=["rural_urban"])


@query(
    "decay_normal_equations",
    "panel",
    sql="""select rural_urban, 0.0 as g0, 0.0 as g1, 0.0 as g2 from panel
           where csmo_fact is not null and Nof_Mths is not null group by 1""",
)
def _(v):
    """Residuals of the fit are orthogonal to its derivatives.

    A missing fit counts as 0 only if no rate between the least and the largest of some fits best.
    """
    rows = v("panel").filter("csmo_fact is not null and Nof_Mths is not null")
    tried = [-30.0, -10.0, -3.0, -1.0, -0.1, 0.1, 1.0, 3.0, 10.0, 30.0, 100.0]
    ends = rows.groupBy("rural_urban").agg(F.min("Nof_Mths").alias("lo"), F.max("Nof_Mths").alias("hi"))
    scaled = (F.col("Nof_Mths") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    r2 = [F.coalesce(F.regr_r2("csmo_fact", F.exp(-r * scaled)), F.lit(0.0)) for r in tried]
    shape = rows.join(ends, "rural_urban").groupBy("rural_urban").agg(F.array(*r2).alias("r2"))
    inner = F.greatest(F.get("r2", F.lit(0)), F.get("r2", F.lit(len(tried) - 1))) < F.array_max("r2")
    due = shape.select("rural_urban", F.when(inner, 1.0).otherwise(0.0).alias("missing"))
    fits = curves.fit_decay(rows, by=["rural_urban"])
    at = rows.join(fits.select("rural_urban", "a", "b", "c"), "rural_urban")
    x, slope = F.col("Nof_Mths"), F.exp(-F.col("b") * F.col("Nof_Mths"))
    off = F.col("csmo_fact") - (F.col("a") * slope + F.col("c"))
    gradient = {"g0": slope, "g1": F.col("a") * x * slope, "g2": F.lit(1.0)}
    share = [
        (F.sum(off * g) / F.sqrt(F.sum(off * off) * F.sum(g * g))).alias(name) for name, g in gradient.items()
    ]
    table = at.groupBy("rural_urban").agg(*share).join(due, "rural_urban")
    return table.select(
        "rural_urban", *[(F.round(F.coalesce(F.col(n), F.col("missing")), 3) + 0.0).alias(n) for n in gradient]
    )


# The panel of an analysis that takes every stratum whole.
WHOLE_SQL = f"""{PREPARED_SQL}, ids as (
              select nis_rad, rural_urban, Year_of_connection from prep group by 1, 2, 3
              having count(*) - (max(Nof_Mths) - min(Nof_Mths)) >= 0),
            fin as (select p.*, g.GCP from prep p join gcp g on p.nis_rad = g.nis_rad and p.Nof_Mths = g.Nof_Mths
                  where g.GCP is not null and p.nis_rad in (select nis_rad from ids))"""


def _whole(raw) -> dict:
    """Sample size and rural share that take all customers."""
    customers = panel.complete_customers(panel.prepare_panel(raw))
    counts = {row["rural_urban"]: row["count"] for row in customers.groupBy("rural_urban").count().collect()}
    total = sum(counts.values())
    return {"sample_size": total, "rural_share": counts.get("Rural", 0) / total}


_COMPLETE = " and ".join(f"{x} is not null" for x in (*C.CONTINUOUS_VARS, C.OUTCOME) if x != "GDP")

@query(
    "analysis_in_stages",
    "features",
    "gcp",
    sql=f"""with {WHOLE_SQL},
            ls as (select rural_urban, count(*) as n from fin where {_COMPLETE} group by 1)
            select 'quality_dimensions' as part, count(*) as figure from fin
            union all select 'summary_stats', count(distinct rural_urban) from fin
            union all select 'plot_median_consumption', count(distinct Nof_Mths) from fin where Nof_Mths < 120
            union all select 'plot_median_by_location', count(distinct (rural_urban, Nof_Mths)) from fin where Nof_Mths < 120
            union all select 'plot_histogram_population', count(population) from fin
            union all select 'models_' || m || '_' || lower(substr(rural_urban, 1, 1)), n from ls
              cross join (select unnest(['pool', 're', 'fe']) as m)""",
)
def _(v):
    # The second run finds every stage committed and reads it.
    spark = v.args[0]
    folder, whole = f"{ensure_checkpoint_dir(spark)}/analysis-{uuid.uuid4().hex}", _whole(v("features"))
    run = partial(
        analysis.analyse,
        v("features"),
        v("gcp"),
        folder=folder,
        only=("median_", "histogram_population"),
        models=lambda data: regression.panel_regression(data["standardized"]["combined"]),
        **whole,
    )
    run()
    found = run().tables()
    rows = lambda name: found[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("figure"))
    counted = found["plot_histogram_population"].agg(
        F.lit("plot_histogram_population").alias("part"), F.sum("count").cast("long").alias("figure")
    )
    models = found["models"].groupBy(F.concat(F.lit("models_"), "model").alias("part")).agg(F.max("n").alias("figure"))
    return (
        found["quality_dimensions"]
        .select(F.lit("quality_dimensions").alias("part"), F.col("rows").alias("figure"))
        .unionByName(rows("summary_stats"))
        .unionByName(rows("plot_median_consumption"))
        .unionByName(rows("plot_median_by_location"))
        .unionByName(counted)
        .unionByName(models)
    )


@query(
    "analysis_plots",
    "features",
    "gcp",
    sql=f"""with {WHOLE_SQL},
            md as (select Nof_Mths, {r('median(csmo_fact)')} as median from fin where Nof_Mths < 120 group by 1),
            ml as (select rural_urban, Nof_Mths, {r('median(csmo_fact)')} as median from fin where Nof_Mths < 120 group by 1, 2)
            select 'all' as rural_urban, Nof_Mths, median from md union all select * from ml""",
)
def _(v):
    raw = v("features")
    tables = analysis.plots_only(raw, v("gcp"), **_whole(raw))
    both = tables["median_consumption"].withColumn("rural_urban", F.lit("all"))
    both = both.unionByName(tables["median_by_location"])
    return both.select("rural_urban", "Nof_Mths", F.col("Median").alias("median"))


@query("analysis_models", "features", "gcp")
def _(v):
    raw = written(v("features"))
    return _table(v, analysis.regressions_only(raw, v("gcp"), **_whole(raw)))


@query(
    "prepared_datasets",
    "features",
    "gcp",
    sql=f"""with {PREPARED_SQL}, ids as (
              select nis_rad, rural_urban, Year_of_connection from prep group by 1, 2, 3
              having count(*) - (max(Nof_Mths) - min(Nof_Mths)) >= 0),
            kept as (select nis_rad from ids),
            m as (select p.rural_urban, count(*) as rows, sum(p.csmo_fact) as kwh, sum(g.GCP) as gdp
                  from prep p join gcp g on p.nis_rad = g.nis_rad and p.Nof_Mths = g.Nof_Mths
                  where g.GCP is not null and p.nis_rad in (select nis_rad from kept) group by 1)
            select * from m""",
)
def _(v):
    # As many customers as there are: every stratum is taken whole.
    raw = v("features")
    data = analysis.prepare_datasets(raw, v("gcp"), **_whole(raw))
    return data["raw"]["combined"].groupBy("rural_urban").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("csmo_fact").alias("kwh"), F.sum("GDP").alias("gdp")
    )
