"""k-means over a range of k."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.session import written


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1; constants to 0."""
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("m")
    )
    spread = {c: F.col(f"_m.s_{c}") for c in columns}
    return (
        df.withColumn("_m", moments.scalar())
        .withColumns(
            {
                c: F.when(spread[c] > 0, (F.col(c) - F.col(f"_m.m_{c}")) / spread[c]).otherwise(0.0)
                for c in columns
            }
        )
        .drop("_m")
    )


def kmeans_scan(
    df: DataFrame,
    columns: Sequence[str],
    key: str = "nis_rad",
    ks: Iterable[int] = range(1, 11),
    seed: int = 42,
    max_iter: int = 300,
) -> tuple[DataFrame, DataFrame]:
    """Scores (k, score) and labels (key, k, label) for every number of clusters.

    The score is minus the squared distances to the centres. One cluster needs no
    iteration: its centre is the origin of the scaled data. The others take `max_iter`
    rounds at most, or end when no centre moves.
    """
    columns = list(columns)
    rows = df.select(key, *columns).dropna(subset=columns)
    # Written, so that each of many short rounds takes as many tasks as the rows' bytes need, not one per shuffle partition
    # of what made them; in order of keys, so that the draws meet rows in the same order in every run.
    scaled = written(scale(rows, columns).orderBy(key))
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(scaled)
    data = data.select(key, "features", *columns).persist()
    scores, labels = [], []
    for k in ks:
        if k == 1:
            squares = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns])
            scores.append((1, -float(data.agg(F.sum(squares)).first()[0] or 0.0)))
            labels.append(data.select(key, F.lit(1).alias("k"), F.lit(0).alias("label")))
            continue
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="label").fit(data)
        scores.append((k, -float(model.summary.trainingCost)))
        labels.append(model.transform(data).select(key, F.lit(k).alias("k"), "label"))
    table = df.sparkSession.createDataFrame(scores, "k int, score double")
    # The labels are lazy; they read the cached rows as long as these are kept.
    return table, reduce(DataFrame.unionByName, labels)
