"""Model families on Spark ML, grouped validation, stacking and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ebbtide.operators.panel import gram
from ebbtide.plans.scratch import materialize

#: Rows of a block of queries and of training rows that meet in a task: 32 MB of distances.
QUERY_ROWS, TRAIN_ROWS = 512, 8_192
#: Models fitted at once: a fit is a long row of small jobs, whose waits overlap.
FITS = 4


def families(features: list[str], label: str = "y", trees: int = 300) -> dict[str, Pipeline]:
    """The study's families by name; each is a pipeline from the feature columns to ``prediction``."""
    vector = VectorAssembler(inputCols=features, outputCol="__x")
    common = {"featuresCol": "__x", "labelCol": label}
    members = {
        "linear": LinearRegression(**common),
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, standardization=True, **common),
        "lasso": LinearRegression(regParam=0.1, elasticNetParam=1.0, standardization=True, **common),
        "forest": RandomForestRegressor(numTrees=trees, minInstancesPerNode=5, seed=1, **common),
        "boosting": GBTRegressor(maxIter=trees, stepSize=0.05, maxDepth=4, minInstancesPerNode=10, seed=1, **common),
    }
    return {name: Pipeline(stages=[vector, member]) for name, member in members.items()}


def grouped_choice(df: DataFrame, features: list[str], fold: str, penalties: list[float], label: str = "y") -> float:
    """The ridge penalty of least error over folds of whole groups."""
    member = LinearRegression(featuresCol="__x", labelCol=label, elasticNetParam=0.0)
    grid = ParamGridBuilder().addGrid(member.regParam, penalties).build()
    chosen = CrossValidator(estimator=member, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), foldCol=fold, numFolds=df.select(fold).distinct().count())
    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(df)
    return penalties[int(np.argmin(chosen.fit(rows).avgMetrics))]


def out_of_fold(df: DataFrame, pipeline: Pipeline, fold: str, folds: int) -> DataFrame:
    """Predictions of each fold by a model of the others; the folds' models are fitted side by side."""
    rows = materialize(df, "rows")

    def predicted(k: int) -> DataFrame:
        model = pipeline.copy().fit(rows.filter(F.col(fold) != k))
        return model.transform(rows.filter(F.col(fold) == k)).select(*df.columns, "prediction")

    with ThreadPool(min(folds, FITS)) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(predicted), range(folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def non_negative(xx: np.ndarray, xy: np.ndarray, rounds: int = 5_000) -> np.ndarray:
    """Non-negative least squares from sums, by coordinate descent; k is a handful of members."""
    w = np.zeros(len(xy))
    for _ in range(rounds):
        was = w.copy()
        for k in range(len(w)):
            if xx[k, k] > 0:
                w[k] = max(0.0, w[k] + (xy[k] - xx[k] @ w) / xx[k, k])
        if np.abs(w - was).max() < 1e-12:
            break
    return w


def stack_weights(df: DataFrame, members: list[str], label: str = "y") -> dict[str, float]:
    """Weights of the members' predictions, not negative, that sum to 1; equal if none helps."""
    row = gram(df, members, label).first()
    w = non_negative(np.array(row["xx"]).reshape(len(members), len(members)), np.array(row["xy"]))
    w = w / w.sum() if w.sum() > 0 else np.full(len(members), 1 / len(members))
    return dict(zip(members, map(float, w)))


def _packed(df: DataFrame, rows: int, key: Column, columns: list[Column], names: tuple[str, str]) -> DataFrame:
    """Blocks of about ``rows`` rows, each one row of arrays: keys, and ``columns`` one after another."""
    blocks = max(1, -(-df.count() // rows))
    one = F.struct(key.alias("key"), F.array(*(c.cast("double") for c in columns)).alias("values"))
    # a bounded number of rows by the hash
    held = df.groupBy(F.pmod(F.xxhash64(key, *columns), F.lit(blocks)).alias("__block")).agg(F.collect_list(one).alias("__rows"))
    return held.select(F.col("__rows.key").alias(names[0]), F.flatten("__rows.values").alias(names[1]))


def _best_of_blocks(features: int, k: int):
    """Per query of a pair of blocks, its k nearest training rows, ties by place in the key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                queries, trained = batch.column("__q")[n].values, batch.column("__k")[n].values
                x = batch.column("__x")[n].values.to_numpy(zero_copy_only=False).reshape(len(queries), features)
                t = batch.column("__t")[n].values.to_numpy(zero_copy_only=False).reshape(len(trained), features + 1)
                order = pc.sort_indices(trained)
                trained, t = trained.take(order), t[order.to_numpy()]
                gap = np.zeros((len(queries), len(trained)))
                for c in range(features):
                    gap += (x[:, c, None] - t[None, :, c]) ** 2
                far = np.where(np.isnan(gap), np.inf, np.sqrt(gap))
                most = np.partition(far, min(k, len(trained)) - 1, axis=1)[:, min(k, len(trained)) - 1]
                row, col = np.nonzero(far <= most[:, None])
                sort = np.lexsort((col, far[row, col], row))
                row, col = row[sort], col[sort]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[keep], col[keep]
                d, label = far[row, col], t[col, features]
                yield pa.RecordBatch.from_arrays(
                    [queries.take(pa.array(row)), trained.take(pa.array(col)), pa.array(d, mask=np.isinf(d)), pa.array(label, mask=np.isnan(label))], names=["__q", "__k", "__d", "__l"]
                )

    return run


def nearest_neighbours(queries: DataFrame, key: str, train: DataFrame, train_key: str, features: list[str], label: str, k: int) -> DataFrame:
    """Mean label of the k nearest training rows, weighted by 1 / distance; an exact match decides alone.

    Queries of equal features are answered once, and of training rows of equal features the first k by key are all that
    can be among the nearest.  What is left meets block by block, so the work grows with the product of the numbers of
    different points; a pair of blocks returns each query's k best only, and these are merged.
    """
    names = [f"__f{n}" for n in range(len(features))]
    columns = [F.col(c).cast("double").alias(n) for c, n in zip(features, names)]
    asked = queries.select(key, *columns)
    points = materialize(asked.select(*names).distinct().withColumn("__p", F.monotonically_increasing_id()), "points")
    # nulls are one point; nothing is near it
    place = F.row_number().over(W.partitionBy(*names).orderBy("__k"))
    given = train.select(F.col(train_key).alias("__k"), *columns, F.col(label).alias("__label")).withColumn("__n", place).filter(F.col("__n") <= k)
    inputs = [F.col(n) for n in names]
    left = materialize(_packed(points, QUERY_ROWS, F.col("__p"), inputs, ("__q", "__x")), "queries")
    right = materialize(_packed(materialize(given, "given"), TRAIN_ROWS, F.col("__k"), [*inputs, F.col("__label")], ("__k", "__t")), "train")
    schema = T.StructType().add("__q", "long").add("__k", train.schema[train_key].dataType).add("__d", "double").add("__l", "double")
    near = left.repartition(max(1, left.count())).crossJoin(right).mapInArrow(_best_of_blocks(len(features), k), schema).withColumnRenamed("__q", "__p")
    first = W.partitionBy("__p").orderBy(F.asc_nulls_last("__d"), "__k")
    best = near.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k)
    exact = F.col("__d") == 0
    found = best.groupBy("__p").agg(
        F.coalesce(F.avg(F.when(exact, F.col("__l"))), F.sum(F.col("__l") / F.when(~exact, F.col("__d"))) / F.sum(1 / F.when(~exact, F.col("__d")))).alias("predicted")
    )
    answers = points.join(found, "__p").select(*(F.col(n).alias(f"__at{n}") for n in names), "predicted")
    same = [F.col(n).eqNullSafe(F.col(f"__at{n}")) for n in names]
    return asked.join(answers, same).select(key, "predicted")


def half_width(df: DataFrame, error: Column, by: list[str], level: float = 0.95) -> DataFrame:
    """Quantile of absolute errors: the half width of a prediction interval."""
    return df.groupBy(*by).agg(F.percentile(F.abs(error), level).alias("half_width"))


def shuffled(df: DataFrame, key: str, column: str, seed: int, by: Column | None = None) -> DataFrame:
    """The rows with one column dealt anew, for permutation importance; a study's weekly rows."""
    order, deal = W.orderBy(key), W.orderBy(F.xxhash64(F.lit(seed), F.col(key)) if by is None else by, key)
    own = df.withColumn("__n", F.row_number().over(order))
    other = df.select(F.col(column).alias("__v"), F.row_number().over(deal).alias("__n"))
    return own.join(other, "__n").withColumn(column, F.col("__v")).drop("__n", "__v")
