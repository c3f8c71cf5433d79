"""From a raw feature panel to data sets, plot tables and models."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame

from gridpanel import constants as C
from gridpanel.operators import distributions, growth, panel, quality, regression, segments
from gridpanel.operators.cleaning import within_tenure
from gridpanel.operators.regression import Fit
from gridpanel.plans.stages import Stages
from gridpanel.session import written


def prepare_datasets(
    raw: DataFrame,
    gcp: DataFrame,
    sample_size: int = C.SAMPLE_SIZE,
    rural_share: float = C.RURAL_SHARE,
    seed: int = 1,
    keep: Callable[[DataFrame], DataFrame] = written,
) -> dict[str, dict[str, DataFrame]]:
    """Raw, standardized and log-standardized panels, each urban, rural and combined.

    The nine are filters over the sampled panel, which is written once (`keep`) since
    every table and model of an analysis reads it again.
    """
    cleaned = panel.prepare_panel(raw)
    sampled = panel.balanced_sample(cleaned, sample_size, rural_share, seed)
    final = keep(panel.merge_gcp(panel.median_dummies(sampled), gcp))
    logged = panel.log_transform(final)
    return {
        "raw": panel.split_by_location(final),
        "standardized": panel.split_by_location(panel.standardize(final)),
        "log_standardized": panel.split_by_location(panel.standardize(logged)),
    }


def plot_tables(
    df: DataFrame, max_months: int = C.MAX_MONTHS_PLOT, only: tuple[str, ...] = ("",)
) -> dict[str, DataFrame]:
    """The tables behind the plots of a panel, or those whose names begin as in `only`."""
    rows = within_tenure(df, max_months, inclusive=False)
    means = distributions.customer_means(df)
    made = {
        "median_consumption": lambda: growth.growth_curve(rows),
        "median_by_location": lambda: growth.growth_curve(rows, ["rural_urban", "Nof_Mths"]),
        "consumption_by_year": lambda: growth.connection_year_curve(df, max_months),
        "interactions": lambda: segments.interaction_curves(df, max_months=max_months),
    }
    if "Month" in df.columns:
        made["seasonal_patterns"] = lambda: growth.calendar_curve(df)
    for v in distributions.ECDF_VARS:
        made[f"distribution_{v}"] = partial(
            distributions.ecdf, means, v, "rural_urban", "non_null"
        )
    for v in ("csmo_fact", "total_structs", "population", "fsp"):
        made[f"histogram_{v}"] = partial(distributions.histogram, df, v, by="rural_urban")
    for d in ("fsp_dummy", "Electrification_dummy", "population_dummy"):
        made[f"segment_{d}"] = partial(segments.dummy_curve, df, d, max_months=max_months)
    return {name: make() for name, make in made.items() if name.startswith(only)}


def location_models(name: str, parts: dict[str, DataFrame], fitter) -> dict[str, Fit]:
    """A family of models for urban and rural, flattened to one dictionary."""
    out = {}
    for location in ("urban", "rural"):
        found = fitter(parts[location])
        found = found if isinstance(found, dict) else {"": found}
        for label, fit in found.items():
            out["_".join(p for p in (name, location, label) if p)] = fit
    return out


@dataclass
class Analysis:
    """Everything one run produces; tables are lazy, or those that the run's stages committed."""

    datasets: dict[str, dict[str, DataFrame]]
    quality: dict[str, DataFrame] = field(default_factory=dict)
    summary_stats: DataFrame | None = None
    plots: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, Fit] = field(default_factory=dict)
    coefficients: DataFrame | None = None

    def model_table(self) -> DataFrame | None:
        if self.coefficients is not None or not self.models:
            return self.coefficients
        spark = self.datasets["raw"]["combined"].sparkSession
        return regression.coefficient_table(spark, self.models)

    def tables(self) -> dict[str, DataFrame]:
        """What a results sink saves."""
        out = {f"plot_{n}": t for n, t in self.plots.items()}
        out |= {f"quality_{n}": t for n, t in self.quality.items()}
        if self.summary_stats is not None:
            out["summary_stats"] = self.summary_stats
        models = self.model_table()
        return out if models is None else out | {"models": models}


def _scaled_once(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The parts of a scaled panel, which is written: every family of models reads it several times."""
    return panel.split_by_location(written(parts["combined"]))


def all_models(datasets: dict[str, dict[str, DataFrame]]) -> dict[str, Fit]:
    """Every family of models, for urban and rural customers."""
    scaled, logged = (_scaled_once(datasets[kind]) for kind in ("standardized", "log_standardized"))
    return {
        **regression.panel_regression(scaled["combined"]),
        **location_models("mundlak", scaled, regression.mundlak),
        **location_models("dummy_effects", scaled, regression.dummy_effects),
        **location_models("interactions", scaled, regression.interactions),
        **location_models("subsamples", scaled, regression.subsamples),
        **location_models("mundlak_log", logged, regression.mundlak),
    }


def analyse(
    raw: DataFrame,
    gcp: DataFrame,
    sample_size: int = C.SAMPLE_SIZE,
    rural_share: float = C.RURAL_SHARE,
    plots: bool = True,
    regressions: bool = True,
    folder: str | None = None,
    models: Callable[[dict], dict[str, Fit]] = all_models,
    only: tuple[str, ...] = ("",),
) -> Analysis:
    """The whole analysis: data sets, quality, summaries, plot tables and models.

    With `folder`, each of these is a stage that is committed there once it is written: a run that failed goes on
    behind its last committed stage, and models are there as their table only. Use a new folder for other inputs.
    """
    spark = raw.sparkSession
    stages = Stages(spark, folder) if folder else None

    def stage(name: str, make: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
        return stages.tables(name, make) if stages else dict(make())

    def keep(panel_: DataFrame) -> DataFrame:
        return stages.tables("panel", lambda: {"panel": panel_})["panel"] if stages else written(panel_)

    datasets = prepare_datasets(raw, gcp, sample_size, rural_share, keep=keep)
    combined = datasets["raw"]["combined"]
    run = Analysis(datasets)
    run.quality = stage("quality", lambda: quality.quality_report(combined))
    found = stage(
        "summary", lambda: {"summary": quality.summary_stats(combined, variables=list(C.CONTINUOUS_VARS))}
    )
    run.summary_stats = found["summary"]
    if plots:
        run.plots = stage("plots", lambda: plot_tables(combined, only=only))
    if regressions and stages:
        made = stage("models", lambda: {"models": regression.coefficient_table(spark, models(datasets))})
        run.coefficients = made["models"]
    elif regressions:
        run.models = models(datasets)
    return run


def quick_analysis(raw: DataFrame, gcp: DataFrame, sample_size: int = 10000) -> Analysis:
    """Curves, distributions, summaries and the basic models on a smaller sample."""
    datasets = prepare_datasets(raw, gcp, sample_size)
    combined = datasets["raw"]["combined"]
    return Analysis(
        datasets,
        summary_stats=quality.summary_stats(combined),
        plots=plot_tables(combined, only=("median_consumption", "distribution_")),
        models=regression.panel_regression(datasets["standardized"]["combined"]),
    )


def plots_only(
    raw: DataFrame, gcp: DataFrame, sample_size: int = C.SAMPLE_SIZE, rural_share: float = C.RURAL_SHARE
) -> dict[str, DataFrame]:
    combined = prepare_datasets(raw, gcp, sample_size, rural_share)["raw"]["combined"]
    return plot_tables(combined, only=("median_", "distribution_", "segment_fsp_dummy"))


def regressions_only(
    raw: DataFrame, gcp: DataFrame, sample_size: int = C.SAMPLE_SIZE, rural_share: float = C.RURAL_SHARE
) -> dict[str, Fit]:
    scaled = _scaled_once(prepare_datasets(raw, gcp, sample_size, rural_share)["standardized"])
    models = {
        **regression.panel_regression(scaled["combined"]),
        **location_models("mundlak", scaled, regression.mundlak),
    }
    for label, fit in regression.interactions(scaled["urban"]).items():
        models[f"interactions_{label}"] = fit
    return models
