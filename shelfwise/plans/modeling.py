"""Queries over features, models, ensembles, file round trips and streams."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import extract, picture
from shelfwise.operators import features, joins, metrics, models, neighbours, stages
from shelfwise.operators.percentiles import percentiles
from shelfwise.plans.extraction import INPUTS_SQL
from shelfwise.plans.quality import ERR, LI, numeric
from shelfwise.plans.ranking import SMAPES, model_scores
from shelfwise.plans.registry import query
from shelfwise.sources import files
from shelfwise.sources.tables import downloads, image_vectors, predictions, products, read_catalog_csv, spread_products, submission, table
from shelfwise.streaming import streams

COLUMNS = ["quantity", "discount", "tax"]
IMAGE_VALUES = 64


def spread_rows(spark, d):
    """The model table, written: its inputs are read out of the texts once, by all cores, and not again by every fit."""
    return files.stored(models.model_table(spread_products(spark, d)), "model-table")


#: Stored vectors with gaps: by id, the first component not a number, the second infinite, the third absent.
_HOLES = "CASE WHEN i = 1 AND vec_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN i = 2 AND vec_id % 11 = 0 THEN CAST('inf' AS DOUBLE) WHEN i = 3 AND vec_id % 13 = 0 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) END"


@query("impute_vectors", f"WITH c AS (SELECT vec_id, i, {_HOLES} AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)), k AS (SELECT *, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN NULL ELSE x END AS y FROM c), m AS (SELECT i, avg(y) AS m FROM k GROUP BY i) SELECT vec_id, coalesce(max(y) FILTER (i = 1), 0) AS zero_1, coalesce(max(y) FILTER (i = 2), 0) AS zero_2, sum(coalesce(y, 0)) AS zero_sum, max(coalesce(y, m)) FILTER (i = 1) AS mean_1, max(coalesce(y, m)) FILTER (i = 2) AS mean_2, max(coalesce(y, m)) FILTER (i = 3) AS mean_3, sum(coalesce(y, m)) AS mean_sum, count(y) = count(*) AS kept_by_drop FROM k JOIN m USING (i) GROUP BY vec_id", "zero_1 zero_2 zero_sum mean_1 mean_2 mean_3 mean_sum")
def impute_vectors(spark, d):
    """Components that are null, not a number or infinite become 0 or the mean of the component, or the row is dropped."""
    e = table(spark, d, "embeddings")
    spoilt = lambda x, i: F.when((i == 0) & (F.col("vec_id") % 7 == 0), float("nan")).when((i == 1) & (F.col("vec_id") % 11 == 0), float("inf")).when((i == 2) & (F.col("vec_id") % 13 == 0), F.lit(None)).otherwise(x)
    rows = e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), spoilt).alias("v"))
    zero, mean, whole = features.impute(rows, "v", IMAGE_VALUES)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    both = zero.select("vec_id", F.col("v").alias("z")).join(mean.select("vec_id", F.col("v").alias("m")), "vec_id").join(whole.select("vec_id", F.lit(True).alias("kept")), "vec_id", "left")
    return both.select("vec_id", F.col("z")[0].alias("zero_1"), F.col("z")[1].alias("zero_2"), total(F.col("z")).alias("zero_sum"), *(F.col("m")[i].alias(f"mean_{i + 1}") for i in range(3)), total(F.col("m")).alias("mean_sum"), F.col("kept").isNotNull().alias("kept_by_drop"))


@query("scale_features", f"WITH f AS ({INPUTS_SQL}), s AS (SELECT avg(value) AS m, stddev_pop(value) AS s, min(total_chars) AS lo, max(total_chars) - min(total_chars) AS w, quantile_cont(digit_ratio, 0.5) AS q, quantile_cont(digit_ratio, 0.75) - quantile_cont(digit_ratio, 0.25) AS iqr FROM f) SELECT sample_id, (value - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS standard, (total_chars - lo) / CASE WHEN w = 0 THEN 1 ELSE w END AS minmax, (digit_ratio - q) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END AS robust FROM f, s", "standard minmax robust")
def scale_features(spark, d):
    x = extract.model_inputs(F.col("catalog_content"))
    rows = products(spark, d).select("sample_id", x["value"].alias("standard"), x["total_chars"].alias("minmax"), x["digit_ratio"].alias("robust"))
    out = rows
    for how in ("standard", "minmax", "robust"):
        out = features.apply_scaling(out, *features.scaling(rows, [how], how))
    return out


def whole_inputs(spark, d):
    """Every product with its text values and its whole image vector; a missing one is zeros."""
    x = extract.model_inputs(F.col("catalog_content"))
    text = products(spark, d).select("sample_id", "price", "fold", F.array(x["total_words"], x["total_chars"], x["digit_ratio"]).alias("t"))
    none = F.array_repeat(F.lit(0.0), IMAGE_VALUES)
    return text.join(image_vectors(spark, d), "sample_id", "left").withColumn("i", F.coalesce("image_vector", none)).drop("image_vector")


_whole = f"w AS (SELECT f.sample_id, p.fold, [CAST(total_words AS DOUBLE), CAST(total_chars AS DOUBLE), CAST(digit_ratio AS DOUBLE)] AS t, coalesce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(range(0, {IMAGE_VALUES}), lambda x: CAST(0 AS DOUBLE))) AS v FROM ({INPUTS_SQL}) f JOIN products p USING (sample_id) LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = f.sample_id)"


@query("fuse_weighted", f"WITH {_whole} SELECT sample_id, CAST(i - 1 AS INT) AS i, 0.6 * coalesce(t[i], 0) + 0.4 * v[i] AS value FROM w, unnest(range(1, {IMAGE_VALUES + 1})) AS u(i)", "value", 5)
def fuse_weighted(spark, d):
    """Every component of the weighted sum of text values and image vector; the shorter one is filled with zeros."""
    v = whole_inputs(spark, d).select("sample_id", features.fuse_weighted(F.col("t"), F.col("i"), 0.6, 0.4).alias("v"))
    return v.select("sample_id", F.posexplode("v").alias("i", "value"))


@query("fuse_concat")
def fuse_concat(spark, d):
    """Text values, scaled by the mean and spread of the training rows, before the image vector."""
    rows = whole_inputs(spark, d).select("sample_id", "fold", "i", *(F.col("t")[j].alias(f"t{j}") for j in range(3)))
    scaled = features.apply_scaling(rows, *features.scaling(rows.filter("fold <> 0"), ["t0", "t1", "t2"], "standard"))
    joined = scaled.withColumn("t", F.array("t0", "t1", "t2")).select("sample_id", features.as_vector("t").alias("tv"), features.as_vector("i").alias("iv"))
    return features.assemble(joined, ["tv", "iv"]).select("sample_id", vector_to_array("features").alias("features"))


@query("fuse_concat_values", f"WITH {_whole}, m AS (SELECT [avg(t[1]), avg(t[2]), avg(t[3])] AS m, [stddev_pop(t[1]), stddev_pop(t[2]), stddev_pop(t[3])] AS s FROM w WHERE fold <> 0) SELECT sample_id, CAST(i - 1 AS INT) AS i, CASE WHEN i <= 3 THEN (t[i] - m[i]) / CASE WHEN s[i] = 0 THEN 1 ELSE s[i] END ELSE v[i - 3] END AS value FROM w, m, unnest(range(1, {IMAGE_VALUES + 4})) AS u(i)", "value", 5)
def fuse_concat_values(spark, d):
    """The vectors of ``fuse_concat``, a row for each component."""
    return fuse_concat(spark, d).select("sample_id", F.posexplode("features").alias("i", "value"))


@query("fuse_gated")
def fuse_gated(spark, d):
    """Gate of each modality: logistic of its own linear model's log price, fitted on products with a price; gated vectors
    are concatenated."""
    rows = whole_inputs(spark, d).select("sample_id", F.log1p("price").alias("label"), "t", "i", features.as_vector("t").alias("tv"), features.as_vector("i").alias("iv"))
    for name in ("tv", "iv"):
        fitted = models.ridge(1.0).setFeaturesCol(name).setPredictionCol(f"{name}_p").fit(rows.filter("label is not null"))
        rows = fitted.transform(rows)
    logistic = lambda c: 1 / (1 + F.exp(-F.col(c)))
    gate = logistic("tv_p") / (logistic("tv_p") + logistic("iv_p") + 1e-8)
    return rows.withColumn("gate", gate).select("sample_id", "gate", F.concat(F.transform("t", lambda x: x * F.col("gate")), F.transform("i", lambda x: x * (1 - F.col("gate")))).alias("features"))


@query("pca")
def pca(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", features.as_vector("embedding").alias("v"))
    out, shares = features.reduce(rows, "v", 8)
    return out.select("vec_id", vector_to_array("reduced").alias("reduced"), F.lit(sum(shares)).alias("explained"))


@query("select_k_f", f"WITH l AS ({LI}), p AS (SELECT count(*) AS n, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([corr(quantity, y), corr(discount, y), corr(tax, y)]) AS r FROM l) SELECT feature, r * r / (1 - r * r) * (n - 2) AS score FROM p", "score", 3)
def select_k_f(spark, d):
    return features.f_scores(numeric(spark, d), COLUMNS, "y")


_edge = lambda c: f"quantile_cont({c}, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e_{c}"
_bin = lambda c: f"len(list_filter(e_{c}, lambda e: {c} >= e))"


@query("select_k_mi", f"WITH l AS ({LI}), e AS (SELECT {', '.join(_edge(c) for c in [*COLUMNS, 'y'])} FROM l), b AS (SELECT unnest(['quantity', 'discount', 'tax']) AS feature, unnest([{', '.join(_bin(c) for c in COLUMNS)}]) AS x, {_bin('y')} AS y FROM l, e), j AS (SELECT feature, x, y, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM j) SELECT feature, sum(CAST(n AS DOUBLE) / t * ln(CAST(n AS DOUBLE) * t / (CAST(nx AS DOUBLE) * ny))) AS score FROM k GROUP BY feature", "score")
def select_k_mi(spark, d):
    return features.binned_information(numeric(spark, d), COLUMNS, "y")


@query("select_variance", f"WITH l AS ({LI}) SELECT * FROM (SELECT unnest(['quantity', 'discount', 'tax']) AS feature, unnest([var_pop(quantity), var_pop(discount), var_pop(tax)]) AS variance FROM l) WHERE variance > 0.01", "variance")
def select_variance(spark, d):
    return numeric(spark, d).agg(*(F.var_pop(c).alias(c) for c in COLUMNS)).unpivot([], COLUMNS, "feature", "variance").filter("variance > 0.01")


def _correlated_sql() -> str:
    names = models.inputs()
    pairs = [(a, b) for j, b in enumerate(names) for a in names[:j]]
    r = ", ".join(f"coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE abs(corr({a}, {b})) END, 0) > 0.95 AS c_{a}_{b}" for a, b in pairs)
    steps, last = [], "r"
    for j, b in enumerate(names):
        steps.append(f"k{j} AS (SELECT *, NOT ({' OR '.join([f'(k_{a} AND c_{a}_{b})' for a in names[:j]] or ['false'])}) AS k_{b} FROM {last})")
        last = f"k{j}"
    kept = " UNION ALL ".join(f"SELECT '{n}' AS feature, k_{n} AS kept FROM {last}" for n in names)
    return f"WITH f AS (SELECT x.* FROM ({INPUTS_SQL}) x JOIN products p USING (sample_id) WHERE p.price IS NOT NULL), r AS (SELECT {r} FROM f), {', '.join(steps)}, k AS ({kept}), l AS (UNPIVOT (SELECT sample_id, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in names)} FROM f) ON {', '.join(names)} INTO NAME feature VALUE value) SELECT sample_id, feature, value FROM l JOIN k USING (feature) WHERE kept"


@query("drop_correlated", _correlated_sql(), "value")
def drop_correlated(spark, d):
    """The inputs left after dropping the later one of every pair with |r| > 0.95, a row for each value."""
    rows = features.assemble(spread_rows(spark, d), models.inputs())
    from pyspark.ml.stat import Correlation

    r = Correlation.corr(rows, "features").first()[0].toArray()  # inputs x inputs
    kept = []
    for j, name in enumerate(models.inputs()):
        if not any(abs(r[models.inputs().index(k), j]) > 0.95 for k in kept):
            kept.append(name)
    return rows.select("sample_id", *(F.col(k).cast("double").alias(k) for k in kept)).unpivot(["sample_id"], kept, "feature", "value")


@query("tfidf_svd")
def tfidf_svd(spark, d):
    return features.tfidf_svd(spread_products(spark, d).select("sample_id", "catalog_content"), "catalog_content", 384, 1000).select("sample_id", "text_vector")


_TOKEN = "[a-z0-9]+"


class HashedTokens:
    """A vectoriser without weights: each token of a text has the bytes of its md5, scaled to 0..1. What takes its place, such
    as a sentence model, likewise gives a matrix (tokens x dimensions) per text."""

    dims = 16

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.pattern = re.compile(_TOKEN)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            tokens = self.pattern.findall(text.lower())
            if len(self.known) > 1 << 16:
                self.known.clear()
            raw = b"".join(self.known.setdefault(t, hashlib.md5(t.encode()).digest()) for t in tokens)
            out.append(np.frombuffer(raw, np.uint8).reshape(-1, self.dims) / 255)
        return out


@query(
    "embedding_source",
    f"WITH t AS (SELECT sample_id, md5(unnest(regexp_extract_all(lower(catalog_content), '{_TOKEN}'))) AS h FROM products), v AS (SELECT sample_id, avg(CAST('0x' || h[1:2] AS INT) / 255.0::DOUBLE) AS first_value, avg(CAST('0x' || h[31:32] AS INT) / 255.0::DOUBLE) AS last_value FROM t GROUP BY sample_id) SELECT p.sample_id, CASE WHEN e.embedding IS NULL THEN 'text' ELSE 'stored' END AS source, CASE WHEN e.embedding IS NULL THEN 16 ELSE len(e.embedding) END AS dims, coalesce(e.embedding[1], v.first_value, 0) AS first_value, CASE WHEN e.embedding IS NULL THEN coalesce(v.last_value, 0) ELSE e.embedding[len(e.embedding)] END AS last_value FROM products p LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.sample_id LEFT JOIN v ON v.sample_id = p.sample_id",
    "first_value last_value",
)
def embedding_source(spark, d):
    """Stored vectors by key; the text of every other product is vectorised."""
    j = products(spark, d).select("sample_id", "catalog_content").join(image_vectors(spark, d), "sample_id", "left")
    stored = F.col("image_vector").isNotNull()
    made = features.vectorised(j.filter(~stored), "catalog_content", HashedTokens, "image_vector")
    both = j.filter(stored).select("sample_id", F.lit("stored").alias("source"), "image_vector").union(made.select("sample_id", F.lit("text").alias("source"), "image_vector"))
    return both.select("sample_id", "source", F.size("image_vector").cast("long").alias("dims"), F.col("image_vector")[0].alias("first_value"), F.element_at("image_vector", -1).alias("last_value"))


def drawn(batches):
    """sample_id -> file, content: a PNG of two coloured fields and a bar, of a size and in colours that follow from the id.
    Every eleventh file is cut off in its middle."""
    for batch in batches:
        names, bodies = [], []
        for key in batch.column(0).to_pylist():
            n, mark = int(key), hashlib.md5(key.encode()).digest()
            side = 24 + n % 9
            rgb = np.empty((side, side, 3), np.uint8)
            rgb[:], rgb[:, side // 2 :] = list(mark[:3]), list(mark[3:6])
            rgb[side // 4 : side // 3] = list(mark[6:9])
            body = picture.encode_png(rgb)
            names.append(f"{key}.png")
            bodies.append(body[: len(body) // 2] if n % 11 == 0 else body)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["file", "content"])


def pictures(spark, d, read=None):
    """sample_id, status and image (or what ``read`` makes of it) of every product, over files written for those that have a
    link, but for every 13th."""
    path = files.scratch(spark, "pictures")
    p = spread_products(spark, d)
    linked = p.filter("image_link is not null and cast(sample_id as bigint) % 13 <> 0").select("sample_id")
    files.write_files(linked.mapInArrow(drawn, "file string, content binary"), path, files.folders_for(table(spark, d, "part").count()))
    return files.scan_images(spark, path, p.select("sample_id", F.when(F.col("image_link").isNotNull(), F.concat("sample_id", F.lit(".png"))).alias("file")), read)


@query("image_scan", "SELECT status, count(*) AS n, sum(side * side) AS pixels FROM (SELECT CASE WHEN image_link IS NULL OR k % 13 = 0 THEN 'missing' WHEN k % 11 = 0 THEN 'corrupt' ELSE 'ok' END AS status, 24 + k % 9 AS side, k FROM (SELECT image_link, CAST(sample_id AS BIGINT) AS k FROM products)) GROUP BY status", "pixels")
def image_scan(spark, d):
    side = F.lit(24) + F.col("sample_id").cast("long") % 9
    out = pictures(spark, d, lambda x: x.select("file", (F.col("image.width") * F.col("image.height")).alias("pixels"))).select("status", F.coalesce("pixels", side * side).alias("pixels"))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("pixels").alias("pixels"))


@query("image_features")
def image_features(spark, d):
    """Features are taken as the pictures are read, so no pixels are written or joined."""
    read = lambda x: features.image_features(x.select(F.col("file").alias("sample_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")).withColumnRenamed("sample_id", "file")
    return pictures(spark, d, read).filter("status = 'ok'").drop("status")


def trained(names):
    def run(spark, d):
        rows = spread_rows(spark, d)
        train, test = rows.filter("fold <> 0"), rows.filter("fold = 0")
        train, test = models.prepared(train, test, "sample_id", "price")
        train = train.persist()
        parts = [models.regressors()[n].fit(train).transform(test).select(F.lit(n).alias("model"), "sample_id", "price", models.price_of("prediction").alias("y_pred")) for n in names]
        train.unpersist()
        return reduce(lambda a, b: a.union(b), parts)

    return run


@query("train_forest")
def train_forest(spark, d):
    """200 trees of depth 20 each, as in the reference."""
    rows = spread_rows(spark, d)
    return models.grown(*models.prepared(rows.filter("fold <> 0"), rows.filter("fold = 0"), "sample_id", "price"), models.forests())


for _query, _models in (("train_gbt", ("boost_deep", "boost_wide", "boost_small")), ("train_ridge", ("ridge",))):
    query(_query)(trained(_models))


@query("train_mlp")
def train_mlp(spark, d):
    rows = spread_rows(spark, d)
    fit, names = features.scaling(rows.filter("fold <> 0"), models.inputs(), "standard")
    scaled = features.apply_scaling(rows, fit, names)
    w, _ = models.train_mlp(scaled.filter("fold <> 0"), models.inputs(), steps=15)
    return models.predict_mlp(scaled.filter("fold = 0"), models.inputs(), w).select("sample_id", "price", models.price_of("prediction").alias("y_pred"))


def quick():
    return models.regressors(trees=8, depth=4)


@query("cross_validate")
def cross_validate(spark, d):
    oof = models.out_of_fold(spread_rows(spark, d), quick(), 3)
    return oof.groupBy("model", "fold").agg(metrics.smape(F.col("price"), F.col("y_pred")).alias("smape"))


@query("grid_search")
def grid_search(spark, d):
    rows = spread_rows(spark, d)
    prepared = models.Pipeline(stages=models.preparation()).fit(rows).transform(rows).select("label", "features")
    lr = models.ridge(1.0)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    lr.setSolver("auto")
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=models.SmapeEvaluator(), numFolds=3, seed=42, parallelism=4).fit(prepared)
    return spark.createDataFrame([(", ".join(f"{p.name}={v}" for p, v in sorted(g.items(), key=lambda x: x[0].name)), float(m)) for g, m in zip(grid, cv.avgMetrics, strict=True)], "setting string, smape double")


@query("random_search")
def random_search(spark, d):
    space = {"numTrees": [4, 8, 12], "maxDepth": [2, 3, 4], "subsamplingRate": [0.6, 0.8, 1.0], "minInstancesPerNode": [1, 4]}
    return models.search(spread_rows(spark, d), lambda **s: models.RandomForestRegressor(seed=42, **s), models.draws(space, 20), 3)


@query("ensemble_weighted", f"WITH {SMAPES}, w AS (SELECT model, (1 / smape) / sum(1 / smape) OVER () AS w FROM s) SELECT sample_id, greatest(sum(w * y_pred), 0.01) AS price FROM predictions JOIN w USING (model) GROUP BY sample_id", "price", 5)
def ensemble_weighted(spark, d):
    w = joins.inverse_weights(model_scores(spark, d), "smape").select("model", "weight")
    j = predictions(spark, d).join(F.broadcast(w), "model")  # a row per model
    return j.groupBy("sample_id").agg(F.greatest(F.sum(F.col("weight") * F.col("y_pred")), F.lit(0.01)).alias("price"))


@query("ensemble_voting", "SELECT sample_id, avg(y_pred) AS price FROM predictions GROUP BY sample_id", "price", 9)
def ensemble_voting(spark, d):
    return predictions(spark, d).groupBy("sample_id").agg(F.avg("y_pred").alias("price"))


@query("ensemble_stacking")
def ensemble_stacking(spark, d):
    return models.stack(predictions(spark, d).withColumnRenamed("y_true", "price"), ["m1", "m2", "m3"], 5)


_wide = "p AS (SELECT sample_id, any_value(y_true) AS y_true, max(y_pred) FILTER (model = 'm1') AS p1, max(y_pred) FILTER (model = 'm2') AS p2, max(y_pred) FILTER (model = 'm3') AS p3 FROM predictions GROUP BY sample_id)"


def _scored(name: str, grid: str) -> str:
    return f"{name} AS (SELECT a, b, avg({ERR}) * 100 AS smape FROM (SELECT a, b, a / 100.0::DOUBLE * p1 + b / 100.0::DOUBLE * p2 + (100 - a - b) / 100.0::DOUBLE * p3 AS y_pred, y_true FROM p, {grid}) GROUP BY a, b)"


@query(
    "ensemble_opt_weights",
    f"WITH {_wide}, g AS (SELECT a * 10 AS a, b * 10 AS b FROM range(0, 11) AS t(a), range(0, 11) AS u(b) WHERE a + b <= 10), {_scored('s', 'g')}, o AS (SELECT a, b FROM s ORDER BY smape, a, b LIMIT 1), h AS (SELECT o.a + i AS a, o.b + j AS b FROM o, range(-10, 11) AS t(i), range(-10, 11) AS u(j) WHERE o.a + i >= 0 AND o.b + j >= 0 AND o.a + i + o.b + j <= 100), {_scored('z', 'h')} SELECT a / 100.0::DOUBLE AS w1, b / 100.0::DOUBLE AS w2, (100 - a - b) / 100.0::DOUBLE AS w3, smape FROM z ORDER BY smape, a, b LIMIT 1",
    "w1 w2 w3 smape",
)
def ensemble_opt_weights(spark, d):
    """Best weights of three models: the whole simplex in tenths, then its surroundings of the best in hundredths. Each product is
    one row, the candidates are a short list, and what is shuffled is one sum a candidate and task."""
    wide = predictions(spark, d).groupBy("sample_id").pivot("model", ["m1", "m2", "m3"]).agg(F.first("y_pred"))
    truth = predictions(spark, d).filter("model = 'm1'").select("sample_id", "y_true")
    rows = wide.join(truth, "sample_id").select("y_true", "m1", "m2", "m3")

    def best(candidates):
        """candidates: one row with an array of (a, b) in hundredths."""
        each = rows.join(F.broadcast(candidates), F.lit(True)).select("y_true", "m1", "m2", "m3", F.explode("g").alias("g")).select("*", "g.a", "g.b")
        blend = F.col("a") / 100 * F.col("m1") + F.col("b") / 100 * F.col("m2") + (100 - F.col("a") - F.col("b")) / 100 * F.col("m3")
        return each.groupBy("a", "b").agg(metrics.smape(F.col("y_true"), blend).alias("smape")).orderBy("smape", "a", "b").limit(1)

    pairs = lambda low, high, step, a, b: F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda j: F.struct((a + i * step).alias("a"), (b + j * step).alias("b")))))
    inside = lambda g: F.filter(g, lambda x: (x["a"] >= 0) & (x["b"] >= 0) & (x["a"] + x["b"] <= 100))
    coarse = best(spark.range(1).select(inside(pairs(0, 10, 10, F.lit(0), F.lit(0))).alias("g")))
    fine = best(coarse.select(inside(pairs(-10, 10, 1, F.col("a"), F.col("b"))).alias("g")))
    return fine.select((F.col("a") / 100).alias("w1"), (F.col("b") / 100).alias("w2"), ((100 - F.col("a") - F.col("b")) / 100).alias("w3"), "smape")


@query("ensemble_opt_simplex")
def ensemble_opt_simplex(spark, d):
    """The same weights by the optimiser, which takes any number of models and any weights."""
    names = sorted(r.model for r in predictions(spark, d).select("model").distinct().collect())  # a row per model
    wide = predictions(spark, d).groupBy("sample_id").pivot("model", names).agg(F.first("y_pred"))
    truth = predictions(spark, d).filter(F.col("model") == names[0]).select("sample_id", F.col("y_true").alias("y"))
    rows = wide.join(truth, "sample_id").select("y", F.array(*names).alias("p")).filter("y is not null and forall(p, x -> x is not null)")
    w, smape = models.best_weights(rows, len(names))
    return spark.createDataFrame([(n, float(x), smape) for n, x in zip(names, w, strict=True)], "model string, weight double, smape double")


@query("compare_ensembles", f"WITH {_wide}, e AS (SELECT unnest(['mean', 'median', 'first']) AS ensemble, unnest([(p1 + p2 + p3) / 3, p1 + p2 + p3 - greatest(p1, p2, p3) - least(p1, p2, p3), p1]) AS y_pred, y_true FROM p) SELECT ensemble, avg({ERR}) * 100 AS smape, avg(abs(y_pred - y_true)) AS mae, avg({ERR}) = min(avg({ERR})) OVER () AS best FROM e GROUP BY ensemble", "smape mae")
def compare_ensembles(spark, d):
    wide = predictions(spark, d).groupBy("sample_id").pivot("model", ["m1", "m2", "m3"]).agg(F.first("y_pred"))
    truth = predictions(spark, d).filter("model = 'm1'").select("sample_id", "y_true")
    total = F.col("m1") + F.col("m2") + F.col("m3")
    made = F.array(*(F.struct(F.lit(k).alias("ensemble"), c.alias("p")) for k, c in (("mean", total / 3), ("median", total - F.greatest("m1", "m2", "m3") - F.least("m1", "m2", "m3")), ("first", F.col("m1")))))
    e = wide.join(truth, "sample_id").select("y_true", F.explode(made).alias("e")).select("y_true", "e.*")
    s = e.groupBy("ensemble").agg(metrics.smape(F.col("y_true"), F.col("p")).alias("smape"), F.avg(F.abs(F.col("p") - F.col("y_true"))).alias("mae"))
    return s.withColumn("best", F.col("smape") == F.min("smape").over(Window.partitionBy()))  # a row per ensemble


_FEATURE_LIST = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in models.inputs()) + "]"


@query("prediction_confidence", f"WITH e AS (SELECT quantile_cont(y_pred, 0.95) AS hi FROM predictions), f AS (SELECT sample_id, {_FEATURE_LIST} AS v FROM ({INPUTS_SQL})), n AS (SELECT a.sample_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)) AS far, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)), CAST(b.sample_id AS BIGINT)) AS r FROM f a, f b), k AS (SELECT sample_id, 1 / (1 + avg(sqrt(far))) AS density FROM n WHERE r <= 5 GROUP BY sample_id) SELECT sample_id, 1 / (1 + stddev_pop(y_pred)) AS agreement, least(avg(y_pred) / any_value(hi), 1) AS level, any_value(density) AS density FROM predictions JOIN k USING (sample_id), e GROUP BY sample_id", "agreement level density")
def prediction_confidence(spark, d):
    """Three measures: agreement of models, price against the 95th percentile, density of products around in feature space."""
    p = predictions(spark, d)
    e = percentiles(p, "y_pred", (0.95,), "q").select(F.col("q")[0].alias("hi"))
    x = extract.model_inputs(F.col("catalog_content"))
    near = neighbours.density(products(spark, d).select("sample_id", *(c.alias(k) for k, c in x.items())), "sample_id", models.inputs()).select(F.col("sample_id").cast("string").alias("sample_id"), "density")
    out = p.join(F.broadcast(e), F.lit(True)).groupBy("sample_id").agg((1 / (1 + F.stddev_pop("y_pred"))).alias("agreement"), F.least(F.avg("y_pred") / F.first("hi"), F.lit(1.0)).alias("level"))
    return out.join(near, "sample_id")


@query("model_report", f"WITH {SMAPES}, m AS (SELECT model, avg(abs(y_pred - y_true)) AS mae FROM predictions GROUP BY model), l AS (UNPIVOT (SELECT model, smape, r2, mae FROM s JOIN m USING (model)) ON smape, r2, mae INTO NAME metric VALUE value) SELECT metric, arg_min(model, CASE WHEN metric = 'r2' THEN -value ELSE value END) AS best, min(value) AS least, max(value) AS most FROM l GROUP BY metric", "least most")
def model_report(spark, d):
    p = predictions(spark, d)
    y, q = F.col("y_true"), F.col("y_pred")
    m = p.groupBy("model").agg(metrics.smape(y, q).alias("smape"), metrics.regression(y, q)["r2"].alias("r2"), metrics.regression(y, q)["mae"].alias("mae")).unpivot(["model"], ["smape", "r2", "mae"], "metric", "value")
    return m.groupBy("metric").agg(F.min_by("model", F.when(F.col("metric") == "r2", -F.col("value")).otherwise(F.col("value"))).alias("best"), F.min("value").alias("least"), F.max("value").alias("most"))


def fitted(spark, d, name="ridge", rows=None):
    return models.fit((rows or spread_rows(spark, d)).filter("fold <> 0"), models.regressors(trees=8)[name])


def text_model(spark, d, *names, rows=None):
    """A model from raw text to price, of these regressors in equal parts, fitted to all folds but the first."""
    names = names or ("ridge",)
    return stages.fit_text_pipeline((rows or spread_rows(spark, d)).filter("fold <> 0"), models.regressors(trees=8), dict.fromkeys(names, 1.0))


@query("predict_batch")
def predict_batch(spark, d):
    return stages.score(text_model(spark, d, "ridge", "forest"), spread_products(spark, d))


@query("feature_importance")
def feature_importance(spark, d):
    return models.importances(fitted(spark, d, "forest"))


@query("top_importance")
def top_importance(spark, d):
    return models.importances(fitted(spark, d, "forest")).orderBy(F.desc("importance"), "feature").limit(10)


@query("permutation_importance")
def permutation_importance(spark, d):
    rows = spread_rows(spark, d)
    return models.permutation_importance(fitted(spark, d, rows=rows), rows.filter("fold = 0"), models.inputs())


@query("fit_pipeline")
def fit_pipeline(spark, d):
    """The whole training: six regressors over five folds, weights by SMAPE, one model from text to price. It is saved with its
    weights, loaded, and scores the products; a row per regressor, one for the blend, one for the loaded model."""
    model, report = stages.train(spread_products(spark, d), quick(), 5)
    folder = files.scratch(spark, "models")
    files.save_model(model, folder, "text-to-price", {r.model: f"{r.weight:.6f}" for r in report.collect()})  # a row per regressor
    loaded, _ = files.load_model(spark, folder, "text-to-price")
    known = products(spark, d).filter("price is not null").select("sample_id", "price")
    again = stages.score(loaded, products(spark, d)).join(known, "sample_id").agg(F.lit("loaded").alias("model"), F.count("*").alias("rows"), metrics.smape(F.col("price"), F.col("y_pred")).alias("smape"), F.lit(1.0).alias("weight"))
    return report.union(again)


@query("score_pipeline")
def score_pipeline(spark, d):
    """Save the fitted model, load it and score the raw text of every product with it alone."""
    path = files.scratch(spark, "model")
    text_model(spark, d).write().overwrite().save(path)
    return stages.score(PipelineModel.load(path), products(spark, d))


@query("model_save_load")
def model_save_load(spark, d):
    """Two models are saved with their metadata; the most recent one is found, loaded and scores as before."""
    folder = files.scratch(spark, "models")
    rows, texts = spread_rows(spark, d), spread_products(spark, d)
    files.save_model(text_model(spark, d, rows=rows), folder, "ridge", {"trees": "0"})
    model = text_model(spark, d, "forest", rows=rows)
    files.save_model(model, folder, "forest", {"trees": "8"})
    loaded, about = files.load_model(spark, folder)
    a = stages.score(model, texts).withColumnRenamed("y_pred", "before")
    b = stages.score(loaded, texts).withColumnRenamed("y_pred", "after")
    return a.join(b, "sample_id").agg(F.lit(about["name"]).alias("name"), F.count("*").alias("rows"), F.count_if(F.abs(F.col("before") - F.col("after")) > 1e-9).alias("different"))


@query("csv_scan", "SELECT sample_id, catalog_content, image_link, price_text AS price FROM products WHERE price_text <> ''")
def csv_scan(spark, d):
    path = files.scratch(spark, "csv")
    files.write_csv(products(spark, d).filter("price_text <> ''").select("sample_id", "catalog_content", "image_link", F.col("price_text").alias("price")), path)
    return read_catalog_csv(spark, path).filter("_corrupt_record is null").drop("_corrupt_record")


@query("json_log_scan", "SELECT CASE WHEN event_id % 7 = 0 THEN 'module' ELSE '' END AS missing, event_type AS level, count(*) AS n FROM events GROUP BY ALL")
def json_log_scan(spark, d):
    path = files.scratch(spark, "logs")
    e = table(spark, d, "events")
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("level"), F.concat(F.lit("event "), F.col("event_id")).alias("message"), F.when(F.col("event_id") % 7 != 0, "catalog").alias("module"), F.col("value").alias("value")))
    e.select(line.alias("value")).write.text(path)
    logs = files.read_logs(spark, path)
    return logs.groupBy(F.array_join("missing", ",").alias("missing"), "level").agg(F.count("*").alias("n"))


@query("file_checksum_manifest", "SELECT sample_id AS file, md5(catalog_content) AS md5, octet_length(encode(catalog_content)) AS length FROM products")
def file_checksum_manifest(spark, d):
    """Every product's text is written as a file; the files are listed and digested."""
    path = files.scratch(spark, "parts")
    texts = spread_products(spark, d).select(F.col("sample_id").alias("file"), F.col("catalog_content").alias("content"))
    files.write_files(texts, path, files.folders_for(table(spark, d, "part").count()))
    return files.checksums(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "md5", "length")


@query("storage_summary")
def storage_summary(spark, d):
    a, b = files.scratch(spark, "tables"), files.scratch(spark, "texts")
    products(spark, d).write.parquet(a)
    products(spark, d).select("sample_id", "price").write.csv(b)
    return files.storage(spark, {"tables": a, "texts": b})


@query("fetch_urls", "SELECT page_id, CASE WHEN page_id % 50 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN page_id % 50 <> 0 THEN md5(html) END AS md5, CASE WHEN page_id % 50 <> 0 THEN octet_length(encode(html)) END AS size, CAST(CASE WHEN page_id % 50 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN page_id % 50 = 0 THEN 'FileNotFoundError' END AS error, page_id % 50 = 0 OR page_id % 20 = 1 AS again FROM pages WHERE html IS NOT NULL")
def fetch_urls(spark, d):
    """Every page is a file of its own in the shared store, and the files are fetched by their URLs, a kept copy of each. One
    page in fifty is not there. Then one copy in twenty is spoilt, and a second run fetches those, and what failed, again."""
    path, kept = files.scratch(spark, "pages"), files.scratch(spark, "fetched")
    pages = table(spark, d, "pages").filter("html is not null").select("page_id", F.concat("page_id", F.lit(".html")).alias("file"), F.col("html").alias("content")).repartition(8, "page_id")
    files.write_files(pages.filter("page_id % 50 <> 0"), path)
    urls = pages.select("page_id", F.concat(F.lit(path + "/"), "file").alias("url"))
    first = files.stored(files.fetch_urls(urls, kinds=("text/", "image/"), folder=kept), "fetched-manifest")
    files.write_files(urls.filter("page_id % 50 <> 0 and page_id % 20 = 1").select(F.md5("url").alias("file"), F.lit("spoilt").alias("content")), kept)
    second = files.fetch_urls(urls, kinds=("text/", "image/"), folder=kept, done=first).select("url_hash", "status", "md5", "size", "attempts", "error", F.lit(True).alias("again"))
    both = urls.select("page_id", F.md5("url").alias("url_hash")).join(first.drop("url"), "url_hash").join(second, "url_hash", "left")
    pick = (F.coalesce(second[c], first[c]).alias(c) for c in ("status", "md5", "size", "attempts", "error"))
    return both.select("page_id", *pick, F.coalesce("again", F.lit(False)).alias("again"))


@query("submission_write", "SELECT sample_id, round_even(price, 6) AS price FROM submission")
def submission_write(spark, d):
    path = files.scratch(spark, "submission")
    files.write_submission(submission(spark, d), path)
    return spark.read.schema("sample_id string, price double").option("header", True).csv(path)


@query("submission_readback", "SELECT count(*) AS rows_written, count(*) AS rows_read, CAST(0 AS BIGINT) AS one_side, CAST(0 AS BIGINT) AS different FROM submission")
def submission_readback(spark, d):
    path = files.scratch(spark, "submission")
    files.write_submission(submission(spark, d), path)
    return files.read_back_submission(submission(spark, d), path)


@query("embedding_write_read", "SELECT vec_id, len(embedding) AS dims, 'v2' AS version, CAST(embedding[1] AS DOUBLE) * 2 AS first_value, 'v1,v2' AS versions FROM embeddings", "first_value")
def embedding_write_read(spark, d):
    """Two versions of all vectors, the second doubled; the second is read, checked against its manifest. A third is written
    and deleted."""
    path = files.scratch(spark, "embeddings")
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    files.write_embeddings(e, path, "v1", {"scale": "1"})
    files.write_embeddings(e.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), path, "v2", {"scale": "2"})
    files.write_embeddings(e, path, "v3")
    files.delete_embeddings(spark, path, "v3")
    versions = files.embedding_versions(spark, path).agg(F.array_join(F.array_sort(F.collect_list("version")), ",").alias("versions"))
    read = files.read_embeddings(spark, path, "v2", 64)
    return read.join(F.broadcast(versions), F.lit(True)).select("vec_id", F.size("embedding").cast("long").alias("dims"), "version", F.col("embedding")[0].alias("first_value"), "versions")


@query("report_write", f"WITH {SMAPES} SELECT model, smape, r2 FROM s", "smape r2")
def report_write(spark, d):
    path = files.scratch(spark, "report")
    model_scores(spark, d).write.json(path)
    return spark.read.schema("model string, smape double, r2 double").json(path)


@query("stream_score")
def stream_score(spark, d):
    """Products arrive as a stream of parts; a saved and loaded model scores their raw text."""
    path, saved = files.scratch(spark, "stream-products"), files.scratch(spark, "model")
    text_model(spark, d).write().overwrite().save(saved)
    products(spark, d).select("sample_id", "catalog_content").repartition(4, "sample_id").write.parquet(path)
    stream = spark.readStream.schema("sample_id string, catalog_content string").parquet(path)
    return streams.run_to_end(stages.score(PipelineModel.load(saved), stream), "append")


def _arrivals(where: str) -> str:
    """Events by arrival, and the watermark (ms) that each arrival meets and that stands at the end."""
    return f"""e AS (SELECT *, CASE WHEN event_id % 20 = 0 AND epoch_us(ts) < low + third THEN 2 WHEN epoch_us(ts) < low + third THEN 0 WHEN epoch_us(ts) < low + 2 * third THEN 1 ELSE 2 END AS part
  FROM events, (SELECT min(epoch_us(ts)) AS low, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 AS third FROM events)),
g AS (SELECT * FROM e WHERE {where}),
m AS (SELECT max(epoch_ms(ts)) FILTER (part < 1) - 3600000 AS m1, max(epoch_ms(ts)) FILTER (part < 2) - 3600000 AS m2, max(epoch_ms(ts)) - 3600000 AS m3 FROM g)"""


_IN_TIME = "epoch_ms(s + INTERVAL 1 HOUR) <= m3 AND NOT (part = 1 AND epoch_ms(s + INTERVAL 1 HOUR) <= m1) AND NOT (part = 2 AND epoch_ms(s + INTERVAL 1 HOUR) <= m2)"


@query("stream_failures_hourly", f"WITH {_arrivals("event_type = 'error'")} SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS failures FROM (SELECT date_trunc('hour', ts) AS s, part FROM g), m WHERE {_IN_TIME} GROUP BY 1")
def stream_failures_hourly(spark, d):
    """Three arrivals, the last with late events of the first: those are dropped, and hours come out once the watermark has
    passed them."""
    parts = streams.by_arrival(table(spark, d, "events"), "ts", F.col("event_id") % 20 == 0)
    return streams.run_arrivals(parts, streams.hourly_failures).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "failures")


@query("stream_quality", f"WITH {_arrivals('true')} SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (value < 5) AS low, count(*) FILTER (value > 100) AS high FROM (SELECT value, part, time_bucket(INTERVAL 15 MINUTES, ts) - o * INTERVAL 15 MINUTES AS s FROM g, (SELECT unnest([0, 1, 2, 3]) AS o)), m WHERE {_IN_TIME} GROUP BY s")
def stream_quality(spark, d):
    """As ``stream_failures_hourly``, over sliding hours; a late event is dropped from each of its hours by itself."""
    parts = streams.by_arrival(table(spark, d, "events"), "ts", F.col("event_id") % 20 == 0)
    out = streams.run_arrivals(parts, lambda e: streams.sliding_quality(e, 5, 100))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "low", "high")


@query("stream_url_dedup", "SELECT url_hash, min(image_link) AS url FROM downloads GROUP BY url_hash")
def stream_url_dedup(spark, d):
    """Image links arrive a second apart; a link is passed on once within a day, and its state is dropped after that."""
    path = files.scratch(spark, "links")
    rows = downloads(spark, d).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sample_id").cast("long")).alias("ts"), "image_link", "url_hash")
    rows.repartition(4, "url_hash").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, image_link string, url_hash string").parquet(path)
    return streams.run_to_end(streams.first_urls(stream, "ts", "1 day"), "append").select("url_hash", F.col("image_link").alias("url"))


