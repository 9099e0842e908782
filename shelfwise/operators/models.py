"""Price models on pyspark.ml: training, validation, search, ensembles and scoring in log space."""

from __future__ import annotations

import itertools
import math
import random
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import extract
from shelfwise.operators import metrics
from shelfwise.sources.files import scratch, stored

LEAST_PRICE = 0.01
AT_ONCE = 4
#: Trees of one fit of a large forest, nodes that the driver may hold of all fits under way, and rows of a task that grows trees.
TREES_A_FIT, NODES_AT_ONCE, ROWS_A_FITTING_TASK = 10, 500_000, 100_000


class SmapeEvaluator(Evaluator):
    """SMAPE in price space of log-space predictions."""

    def _evaluate(self, dataset) -> float:
        return dataset.select(metrics.smape(F.expm1("label"), price_of("prediction")).alias("s")).first().s

    def isLargerBetter(self) -> bool:
        return False


def price_of(prediction: str):
    return F.greatest(F.expm1(F.least(F.greatest(F.col(prediction), F.lit(0.0)), F.lit(15.0))), F.lit(LEAST_PRICE))


def model_table(products: DataFrame) -> DataFrame:
    """sample_id, fold, price, label (log1p of the price) and the sixteen inputs; rows without a price are left out."""
    x = extract.model_inputs(F.col("catalog_content"))
    rows = products.select("sample_id", "fold", "price", F.log1p("price").alias("label"), *(c.alias(k) for k, c in x.items()))
    return rows.filter("price is not null")


def inputs() -> list[str]:
    return ["value", "unit_score", "pack_qty", "title_words", "title_chars", "total_chars", "total_words", "digit_ratio", "brand_hit", "category", "has_size", "has_weight", "has_volume", "value_x_pack", "log_value", "log_total_words"]


def preparation() -> list:
    return [VectorAssembler(inputCols=inputs(), outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def forests(trees: int = 200, depth: int = 20) -> dict:
    """Two forests by name: of random samples, and of all rows with fewer inputs tried at a split."""
    return {
        "forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=42),
        "extra_forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", bootstrap=False, seed=43),
    }


def regressors(trees: int = 20, depth: int = 5) -> dict:
    """Two forests, three boosting set-ups and a ridge, by name."""
    return {
        **forests(trees, depth),
        "boost_deep": GBTRegressor(maxIter=trees // 2, maxDepth=depth + 1, stepSize=0.05, subsamplingRate=0.8, seed=42),
        "boost_wide": GBTRegressor(maxIter=trees // 2, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=43),
        "boost_small": GBTRegressor(maxIter=trees // 2, maxDepth=max(2, depth - 2), stepSize=0.1, seed=44),
        "ridge": ridge(10.0),
    }


def ridge(alpha: float, rows: int = 1000) -> LinearRegression:
    return LinearRegression(elasticNetParam=0.0, regParam=alpha / rows, standardization=False, solver="normal")


def fit(rows: DataFrame, regressor) -> PipelineModel:
    return Pipeline(stages=[*preparation(), regressor]).fit(rows)


def prepared(train: DataFrame, test: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """``preparation`` fitted to ``train``, once for all regressors that follow: label and features of ``train``, and with the
    columns ``keep`` those of ``test``."""
    prep = Pipeline(stages=preparation()).fit(train)
    return prep.transform(train).select("label", "features"), prep.transform(test).select(*keep, "label", "features")


def out_of_fold(rows: DataFrame, makers: dict, folds: int) -> DataFrame:
    """Long table sample_id, fold, model, price, y_pred: each row is scored by models that did not see its fold. The table
    is written, so the cached rows can go."""
    rows = rows.persist()
    path = scratch(rows.sparkSession, "out-of-fold")
    for f in range(folds):
        train, test = prepared(rows.filter(F.col("fold") % folds != f), rows.filter(F.col("fold") % folds == f), "sample_id", "price")
        train = train.persist()
        parts = [r.copy().fit(train).transform(test).select("sample_id", F.lit(f).alias("fold"), F.lit(name).alias("model"), "price", price_of("prediction").alias("y_pred")) for name, r in makers.items()]
        out = reduce(DataFrame.union, parts)
        out.write.mode("append").parquet(path)
        train.unpersist()
    rows.unpersist()
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def lots(forest: RandomForestRegressor, trees: int) -> list[RandomForestRegressor]:
    """A forest as forests of ``trees`` trees and a rest. Their seeds lie far apart, as a task adds its number to the seed
    that it samples by."""
    total = forest.getNumTrees()
    sizes = [trees] * (total // trees) + [total % trees] * (total % trees > 0)
    return [forest.copy({forest.numTrees: n, forest.seed: forest.getSeed() + 1_000_003 * k, forest.cacheNodeIds: True}) for k, n in enumerate(sizes)]


def grown(train: DataFrame, test: DataFrame, makers: dict) -> DataFrame:
    """model, sample_id, price, y_pred of large forests for the rows of ``test``: the mean over all trees.

    A forest is fitted in lots of trees, and each lot is scored and written before it is let go, so the driver never holds a
    whole forest. A tree has at most a leaf for each different row of inputs, which bounds the nodes of the lots under way.
    A lot takes no more tasks than its rows need, as every task sends sums for every node, and lots run side by side."""
    spark = train.sparkSession
    rows, kinds = train.agg(F.count("*"), F.approx_count_distinct("features")).first()
    tasks = max(1, -(-rows // ROWS_A_FITTING_TASK))
    train = train.coalesce(tasks).persist()
    test = stored(test.select("sample_id", "price", "features").withColumn("row", F.monotonically_increasing_id()), "held-out")  # ids may repeat
    leaves = max(1, min(kinds, 2 ** max(r.getMaxDepth() for r in makers.values())))
    trees = max(1, min(TREES_A_FIT, NODES_AT_ONCE // (2 * leaves)))
    at_once = max(1, min(NODES_AT_ONCE // (2 * leaves * trees), AT_ONCE))
    jobs = [(name, lot, scratch(spark, f"{name}-{k}")) for name, r in makers.items() for k, lot in enumerate(lots(r, trees))]

    def score(job):
        name, lot, path = job
        out = lot.fit(train).transform(test).select(F.lit(name).alias("model"), "row", "sample_id", "price", (F.col("prediction") * lot.getNumTrees()).alias("total"), F.lit(lot.getNumTrees()).alias("trees"))
        out.write.parquet(path)
        schema = out.schema
        del out
        spark._jvm.System.gc()  # else the driver's JVM fills up with the broadcasts of lots and levels that are done
        return schema

    with ThreadPool(at_once) as pool:
        schema = pool.map(score, jobs, chunksize=1)[0]
    train.unpersist()
    scored = spark.read.schema(schema).parquet(*(path for _, _, path in jobs))
    mean = scored.groupBy("model", "row").agg(F.first("sample_id").alias("sample_id"), F.first("price").alias("price"), (F.sum("total") / F.sum("trees")).alias("prediction"))
    return mean.select("model", "sample_id", "price", price_of("prediction").alias("y_pred"))


def draws(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n different seeded draws from a parameter table."""
    rng = random.Random(seed)
    keys, found = sorted(space), []
    total = int(np.prod([len(space[k]) for k in keys]))
    while len(found) < min(n, total):
        d = {k: rng.choice(space[k]) for k in keys}
        if d not in found:
            found.append(d)
    return found


def search(rows: DataFrame, make, settings: list[dict], folds: int) -> DataFrame:
    """setting, smape: mean over folds of every setting; ``AT_ONCE`` fits run side by side, as one small fit leaves a cluster
    idle. A fold is prepared once for all settings."""
    rows = rows.persist()
    spark = rows.sparkSession
    parts = [tuple(x.persist() for x in prepared(rows.filter(F.col("fold") % folds != f), rows.filter(F.col("fold") % folds == f))) for f in range(folds)]

    def score(job):
        s, f = job
        train, test = parts[f]
        return SmapeEvaluator().evaluate(make(**s).fit(train).transform(test))

    jobs = [(s, f) for s in settings for f in range(folds)]
    with ThreadPool(AT_ONCE) as pool:
        scores = np.array(pool.map(score, jobs, chunksize=1)).reshape(len(settings), folds)
    for x in (rows, *(x for pair in parts for x in pair)):
        x.unpersist()
    out = [(", ".join(f"{k}={v}" for k, v in sorted(s.items())), float(m)) for s, m in zip(settings, scores.mean(axis=1), strict=True)]
    return spark.createDataFrame(out, "setting string, smape double")


def stack(scored: DataFrame, models: list[str], folds: int) -> DataFrame:
    """Ridge on out-of-fold predictions: sample_id, price, fold, y_pred. Rows of a fold are scored by the ridge of all others."""
    wide = stored(scored.groupBy("sample_id", "price", "fold").pivot("model", models).agg(F.first("y_pred")), "wide")  # read by every fold
    rows = VectorAssembler(inputCols=models, outputCol="features").transform(wide.withColumn("label", F.col("price")))
    parts = [ridge(1.0).fit(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k)) for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("sample_id", "price", "fold", F.greatest("prediction", F.lit(LEAST_PRICE)).alias("y_pred"))


def train_mlp(rows: DataFrame, columns: list[str], hidden: tuple = (32, 16), steps: int = 40, rate: float = 0.01, seed: int = 42):
    """ReLU network by full-batch Adam: executors return the sum of gradients of their rows, the driver takes the step.

    What travels is the weights (a few thousand numbers) each way; rows stay where they are."""
    spark = rows.sparkSession
    data = rows.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.col("label").cast("double").alias("y")).persist()
    sizes = [len(columns), *hidden, 1]
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)] + [np.zeros(b) for b in sizes[1:]]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    losses = []
    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast(w)

        def gradient(batches, shared=shared):
            p = shared.value
            k = len(p) // 2
            total, loss, n = [np.zeros_like(x) for x in p], 0.0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                a = [batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)]
                for i in range(k):
                    z = a[-1] @ p[i] + p[k + i]
                    a.append(np.maximum(z, 0) if i < k - 1 else z)
                d = a[-1] - batch.column(1).to_numpy()[:, None]
                loss, n = loss + float((d**2).sum()), n + batch.num_rows
                for i in range(k - 1, -1, -1):
                    total[i] += a[i].T @ d
                    total[k + i] += d.sum(axis=0)
                    d = (d @ p[i].T) * (a[i] > 0)
            flat = np.concatenate([[loss, n], *(x.ravel() for x in total)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "g"])

        summed = data.mapInArrow(gradient, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow().sort_by("i").column("g").to_numpy()
        losses.append(summed[0] / summed[1])
        at = 2
        for j, p in enumerate(w):
            g = summed[at : at + p.size].reshape(p.shape) / summed[1]
            at += p.size
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g**2
            w[j] = p - rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        shared.unpersist()
    return w, losses


def predict_mlp(rows: DataFrame, columns: list[str], w) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def run(x):
        a = np.stack(x.tolist())
        k = len(shared.value) // 2
        for i in range(k):
            a = a @ shared.value[i] + shared.value[k + i]
            a = np.maximum(a, 0) if i < k - 1 else a
        import pandas as pd

        return pd.Series(a[:, 0])

    return rows.withColumn("prediction", run(F.array(*(F.col(c).cast("double") for c in columns))))


def importances(model: PipelineModel) -> DataFrame:
    """feature, importance of the last stage: tree importances or absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame([(c, float(v)) for c, v in zip(inputs(), values, strict=True)], "feature string, importance double")


def permutation_importance(model: PipelineModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, rise: how much SMAPE rises when one input is dealt anew among the rows.

    Values are shuffled by joining row numbers of two hash orders, once for all columns; numbers come from range partitions
    and their counts."""
    base = SmapeEvaluator().evaluate(model.transform(rows))
    other = number_rows(rows, "b").select("row", *(F.col(c).alias(f"_dealt_{c}") for c in columns))
    both = stored(number_rows(rows, "a").join(other, "row"), "dealt")
    parts = [model.transform(both.withColumn(c, F.col(f"_dealt_{c}"))).select(F.lit(c).alias("feature"), F.expm1("label").alias("y"), price_of("prediction").alias("p")) for c in columns]
    scored = reduce(DataFrame.union, parts)
    return scored.groupBy("feature").agg((metrics.smape(F.col("y"), F.col("p")) - base).alias("rise"))


def number_rows(rows: DataFrame, seed: str) -> DataFrame:
    """Consecutive numbers in the order of a seeded hash, without a single-partition window."""
    from pyspark.sql import Window

    spread = rows.withColumn("mark", F.xxhash64("sample_id", F.lit(seed))).repartitionByRange("mark").sortWithinPartitions("mark").withColumn("part", F.spark_partition_id())
    sizes = spread.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("mark", "sample_id"))
    return spread.withColumn("inside", inside).join(F.broadcast(sizes.select("part", "before")), "part").withColumn("row", F.col("before") + F.col("inside")).drop("mark", "part", "inside", "before")


def blend_sums(rows: DataFrame, candidates: np.ndarray) -> np.ndarray:
    """(y, p: array of predictions) -> for each candidate (row of weights): sum of SMAPE terms and its subgradient, and the
    number of rows. A task multiplies its rows with all candidates and returns one sum of each."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def run(batches):
        w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy()[:, None]
            p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            q = p @ w.T
            size = np.abs(q) + np.abs(y)
            ratio = np.divide(2 * np.abs(q - y), size, out=np.zeros_like(q), where=size > 0)
            slope = np.divide(2 * np.sign(q - y) - ratio * np.sign(q), size, out=np.zeros_like(q), where=size > 0)
            sums = np.concatenate([ratio.sum(axis=0)[:, None], slope.T @ p, np.full((len(w), 1), batch.num_rows)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["i", "s"])

    out = np.zeros((len(candidates), candidates.shape[1] + 2))
    for r in rows.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow().to_pylist():
        out.flat[r["i"]] = r["s"]
    shared.unpersist()
    return out


def onto_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest weights that are not negative and sum to one."""
    u = np.sort(v)[::-1]
    over = np.cumsum(u) - 1
    k = np.flatnonzero(u - over / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - over[k] / (k + 1), 0)


def lattice(n: int, parts: int, most: int) -> np.ndarray:
    """All weights of n models in whole ``parts``-ths; where those are more than ``most``, the mixes of two models."""
    if n == 1:
        return np.ones((1, 1))
    if math.comb(parts + n - 1, n - 1) <= most:
        places = np.array(list(itertools.combinations(range(parts + n - 1), n - 1)), dtype=int).reshape(-1, n - 1)
        edges = np.concatenate([np.full((len(places), 1), -1), places, np.full((len(places), 1), parts + n - 1)], axis=1)
        return (np.diff(edges, axis=1) - 1) / parts
    eye = np.eye(n)
    return np.concatenate([eye, *[(eye[i] * k + eye[j] * (parts - k))[None] / parts for i in range(n) for j in range(i) for k in range(1, parts)]])


def best_weights(rows: DataFrame, n: int, least_step: float = 1e-4, most: int = 2000) -> tuple[np.ndarray, float]:
    """rows (y, p: array of n predictions) -> (weights on the simplex, SMAPE in percent), for any number of models.

    Starts at the best of a lattice in tenths and of equal weights. Each round takes the subgradient at the best weights
    (one sum per model comes back) and then compares, in one pass, points along its projection and exchanges of one step
    between all pairs; a round without gain halves the step. SMAPE is not convex, so the lattice is what makes it global
    and the rounds what makes it exact: the result is never worse than the lattice."""
    rows = rows.persist()
    start = np.concatenate([lattice(n, 10, most), np.full((1, n), 1 / n)])
    sums = blend_sums(rows, start)
    at = int(sums[:, 0].argmin())
    best, value, step, pairs = start[at], sums[at, 0], 0.1, list(itertools.permutations(range(n), 2))
    count, slope = max(sums[at, -1], 1), sums[at, 1:-1]
    while step >= least_step and n > 1:
        down = -slope / max(np.abs(slope).max(), 1e-300)
        tries = [onto_simplex(best + step * 2.0**k * down) for k in range(-6, 3)]
        for i, j in pairs:
            move = min(step, best[j])
            if move > 0:
                tries.append(best.copy())
                tries[-1][i] += move
                tries[-1][j] -= move
        sums = blend_sums(rows, np.array(tries))
        at = int(sums[:, 0].argmin())
        if sums[at, 0] < value * (1 - 1e-12):
            best, value, slope = tries[at], sums[at, 0], sums[at, 1:-1]
        else:
            step /= 2
    rows.unpersist()
    return best, float(value / count * 100)
