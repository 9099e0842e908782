"""Pipeline stages from raw catalog text to a price, so that one saved model holds the whole way."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import extract
from shelfwise.operators import joins, metrics, models
from shelfwise.sources.files import stored


class CatalogFeatures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The sixteen numbers of a catalog text, a column each; columns of those names are replaced. A null text has the numbers
    of an empty one."""

    @keyword_only
    def __init__(self, *, inputCol: str = "catalog_content"):
        super().__init__()
        self._setDefault(inputCol="catalog_content")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(extract.model_inputs(F.coalesce(F.col(self.getInputCol()), F.lit(""))))


class BlendedPrice(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The weighted mean, in price space, of predictions in log space. Predictions that are no number are left out and the
    other weights stretched; where none is left the price is the least price."""

    weights = Param(Params._dummy(), "weights", "weight of each input column", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str = "y_pred", weights: list[float] | None = None):
        super().__init__()
        self._setDefault(outputCol="y_pred")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        total, used = F.lit(0.0), F.lit(0.0)
        for name, weight in zip(self.getInputCols(), self.getOrDefault(self.weights), strict=True):
            there = F.col(name).isNotNull() & ~F.isnan(name)
            total = total + F.when(there, weight * models.price_of(name)).otherwise(0.0)
            used = used + F.when(there, F.lit(weight)).otherwise(0.0)
        price = F.when(used > 0, F.greatest(F.try_divide(total, used), F.lit(models.LEAST_PRICE))).otherwise(models.LEAST_PRICE)
        return dataset.withColumn(self.getOutputCol(), price).drop(*self.getInputCols())


def fit_text_pipeline(rows: DataFrame, makers: dict, weights: dict[str, float]) -> PipelineModel:
    """rows of ``models.model_table`` -> a model that needs ``catalog_content`` alone and adds y_pred. The regressors see one
    prepared table; their weights are scaled to a sum of one."""
    prep = Pipeline(stages=models.preparation()).fit(rows)
    prepared = prep.transform(rows).select("label", "features").persist()
    names = [n for n in makers if weights.get(n, 0) > 0]
    fitted = [makers[n].copy({makers[n].predictionCol: f"log_{n}"}).fit(prepared) for n in names]
    prepared.unpersist()
    total = sum(weights[n] for n in names)
    blend = BlendedPrice(inputCols=[f"log_{n}" for n in names], weights=[weights[n] / total for n in names])
    return PipelineModel(stages=[CatalogFeatures(), *prep.stages, *fitted, blend])


def train(products: DataFrame, makers: dict, folds: int = 5) -> tuple[PipelineModel, DataFrame]:
    """The whole way from products (sample_id, fold, catalog_content, price): every regressor is validated over the folds and
    weighted by 1 / SMAPE, and all are then fitted to all rows. -> (the model; a row per regressor and one for the blend:
    model, rows, smape, weight)."""
    rows = stored(models.model_table(products), "model-table")
    oof = models.out_of_fold(rows, makers, folds)
    scores = oof.groupBy("model", "fold").agg(F.count("*").alias("rows"), metrics.smape(F.col("price"), F.col("y_pred")).alias("smape"))
    mean = scores.groupBy("model").agg(F.sum("rows").alias("rows"), F.avg("smape").alias("smape"))
    weighted = stored(joins.inverse_weights(mean, "smape"), "weights")
    weights = {r.model: r.weight for r in weighted.collect()}  # a row per regressor
    mixed = oof.join(F.broadcast(weighted.select("model", "weight")), "model").groupBy("sample_id").agg(F.first("price").alias("price"), F.greatest(F.sum(F.col("weight") * F.col("y_pred")), F.lit(models.LEAST_PRICE)).alias("y_pred"))
    blend = mixed.agg(F.lit("blend").alias("model"), F.count("*").alias("rows"), metrics.smape(F.col("price"), F.col("y_pred")).alias("smape"), F.lit(1.0).alias("weight"))
    return fit_text_pipeline(rows, makers, weights), weighted.select("model", "rows", "smape", "weight").union(blend)


def score(model: PipelineModel, products: DataFrame) -> DataFrame:
    """sample_id, y_pred of a table or a stream: rows that cannot be scored get the least price."""
    return model.transform(products.select("sample_id", "catalog_content")).select("sample_id", "y_pred")
