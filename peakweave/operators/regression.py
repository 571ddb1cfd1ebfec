"""Linear model checks: coefficients, inflation factors, autocorrelation and spread of residuals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.functions.tails import chi2_p_value
from peakweave.operators.distance import correlation_matrix
from peakweave.operators.ordering import log_bucket

MAX_FACTORS = 2000


def linear_model(df: DataFrame, label: str, features: str = "features") -> tuple[DataFrame, float, object]:
    """Ordinary least squares: (term, estimate, std_error, t, p_value), R squared and the fitted model."""
    rows = df.withColumn("_y", F.col(label).cast("double"))
    model = LinearRegression(featuresCol=features, labelCol="_y", predictionCol="fitted", solver="normal").fit(rows)
    s = model.summary
    errors, ts, ps = list(s.coefficientStandardErrors), list(s.tValues), list(s.pValues)
    # the intercept comes last in the summary
    terms = [(f"x{i}", float(c)) for i, c in enumerate(model.coefficients.toArray())] + [("intercept", float(model.intercept))]
    table = [(n, c, float(e), float(t), float(p)) for (n, c), e, t, p in zip(terms, errors, ts, ps, strict=True)]
    schema = "term string, estimate double, std_error double, t double, p_value double"
    return df.sparkSession.createDataFrame(table, schema), float(s.r2), model


def residuals(df: DataFrame, label: str, model, features: str = "features") -> DataFrame:
    rows = df.withColumn("_y", F.col(label).cast("double"))
    return model.transform(rows).withColumn("residual", F.col("_y") - F.col("fitted")).drop("_y")


def vif(rows: DataFrame, array: str = "x") -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix of at most MAX_FACTORS columns.

    Spark adds up the correlations of all rows; only the column-by-column matrix comes back.
    """
    p = rows.select(F.size(array)).first()[0]
    if p > MAX_FACTORS:
        raise ValueError(f"{p} columns exceed {MAX_FACTORS}")
    r = np.eye(p)
    for row in correlation_matrix(rows, array).collect():
        r[row["i"], row["j"]] = r[row["j"], row["i"]] = row["value"] if row["value"] is not None else 0.0
    factors = np.diag(np.linalg.inv(r))
    return rows.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(factors)], "idx int, vif double")


def durbin_watson(df: DataFrame, keys: Sequence[str], order: str, residual: str = "residual") -> DataFrame:
    """Sum of squared steps between neighbouring residuals over the sum of squares, in the given order.

    Neighbours inside a value bucket meet in a window; across buckets the last residual of one meets the
    first of the next, so a model with very many rows is not gathered.
    """
    from pyspark.sql import Window

    keys = list(keys)
    base = df.withColumn("_b", log_bucket(F.col(order), 4096))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    step = F.col(residual) - F.lag(residual).over(inside)
    per_bucket = base.withColumn("_d", step * step).groupBy(*keys, "_b").agg(
        F.sum("_d").alias("_steps"),
        F.sum(F.col(residual) * F.col(residual)).alias("_ss"),
        F.min_by(residual, order).alias("_first"),
        F.max_by(residual, order).alias("_last"),
    )
    between = Window.partitionBy(*keys).orderBy("_b")
    jump = F.col("_first") - F.lag("_last").over(between)
    return (
        per_bucket.withColumn("_j", jump * jump)
        .groupBy(*keys)
        .agg(
            (
                (F.coalesce(F.sum("_steps"), F.lit(0.0)) + F.coalesce(F.sum("_j"), F.lit(0.0)))
                / F.nullif(F.sum("_ss"), F.lit(0.0))
            ).alias("durbin_watson")
        )
    )


def breusch_pagan(df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Do squared residuals depend on the features? n R squared against chi-square."""
    _, _, model = linear_model(df, label, features)
    squared = residuals(df, label, model, features).withColumn("_e2", F.col("residual") * F.col("residual"))
    aux = LinearRegression(featuresCol=features, labelCol="_e2", predictionCol="_f2", solver="normal").fit(squared)
    n, p = aux.summary.numInstances, len(aux.coefficients)
    stat = df.sparkSession.createDataFrame([(float(n * aux.summary.r2), p)], "bp double, df int")
    return stat.withColumn("p_value", chi2_p_value(F.col("bp"), F.col("df")))
