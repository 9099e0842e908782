"""Queries over joins, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import extract
from shelfwise.operators import joins, metrics, neighbours
from shelfwise.operators.percentiles import beside, hashed_rank, percentiles
from shelfwise.plans.extraction import INPUTS_SQL
from shelfwise.plans.quality import BUCKET, EDGES, ERR, FOLDS, fold_scores
from shelfwise.plans.registry import query
from shelfwise.sources import files
from shelfwise.sources.tables import downloads, image_vectors, predictions, products, submission, table

SMAPES = f"s AS (SELECT model, avg({ERR}) * 100 AS smape, 1 - sum((y_pred - y_true) * (y_pred - y_true)) / (count(y_true) * var_pop(y_true)) AS r2 FROM predictions GROUP BY model)"


def model_scores(spark, d):
    return predictions(spark, d).groupBy("model").agg(metrics.smape(F.col("y_true"), F.col("y_pred")).alias("smape"), metrics.regression(F.col("y_true"), F.col("y_pred"))["r2"].alias("r2"))


@query("status_join", "SELECT p.sample_id, coalesce(d.status, 'missing') AS status, d.attempts FROM products p LEFT JOIN downloads d USING (sample_id)")
def status_join(spark, d):
    return products(spark, d).select("sample_id").join(downloads(spark, d).select("sample_id", "status", "attempts"), "sample_id", "left").select("sample_id", F.coalesce("status", F.lit("missing")).alias("status"), "attempts")


@query("id_reconcile", "WITH a AS (SELECT DISTINCT sample_id FROM products), b AS (SELECT DISTINCT sample_id FROM submission), j AS (SELECT a.sample_id AS x, b.sample_id AS y FROM a FULL JOIN b USING (sample_id)) SELECT count(*) FILTER (y IS NULL) AS missing, count(*) FILTER (x IS NULL) AS extra, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS common, 100.0 * count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(x) AS coverage, count(*) FILTER (x IS NULL OR y IS NULL) = 0 AS exact, (SELECT count(*) FROM submission) - (SELECT count(*) FROM products) AS row_difference FROM j", "coverage")
def id_reconcile(spark, d):
    return joins.reconcile(products(spark, d), submission(spark, d), "sample_id")


@query("feature_append", f"SELECT p.sample_id, p.price, f.value AS value, f.pack_qty AS pack_qty, f.category AS category FROM products p JOIN ({INPUTS_SQL}) f USING (sample_id)", "price value pack_qty category")
def feature_append(spark, d):
    """A stored feature table is appended to the rows by key."""
    x = extract.model_inputs(F.col("catalog_content"))
    path = files.scratch(spark, "features")
    products(spark, d).select("sample_id", *(x[k].alias(k) for k in ("value", "pack_qty", "category"))).write.parquet(path)
    return products(spark, d).select("sample_id", "price").join(spark.read.parquet(path), "sample_id")


@query("modal_join", f"SELECT sample_id, f.total_words AS text_words, coalesce(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0) AS image_norm, embedding IS NOT NULL AS has_image_vector FROM ({INPUTS_SQL}) f LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = sample_id", "text_words image_norm")
def modal_join(spark, d):
    x = extract.model_inputs(F.col("catalog_content"))
    j = products(spark, d).select("sample_id", x["total_words"].alias("text_words")).join(image_vectors(spark, d), "sample_id", "left")
    return j.select("sample_id", "text_words", F.coalesce(joins.dot("image_vector", "image_vector"), F.lit(0.0)).alias("image_norm"), F.col("image_vector").isNotNull().alias("has_image_vector"))


_KNN = "k AS (SELECT q.vec_id AS id, c.embedding AS e, 1 / (1 + sqrt(greatest(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)), 0))) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)), c.vec_id) AS r FROM embeddings q JOIN embeddings c ON c.vec_id % 50 <> 0 WHERE q.vec_id % 50 = 0), t AS (SELECT * FROM k WHERE r <= 5)"


@query("knn_interpolate", f"WITH {_KNN} SELECT id, avg(s) AS confidence, sum(s * CAST(e[1] AS DOUBLE)) / sum(s) AS first_value, sum(s * CAST(e[64] AS DOUBLE)) / sum(s) AS last_value FROM t GROUP BY id", "confidence first_value last_value")
def knn_interpolate(spark, d):
    """Rows with vec_id divisible by 50 play those without an image vector: a stated query set against all others."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = neighbours.interpolate(v.filter("vec_id % 50 = 0"), v.filter("vec_id % 50 <> 0"), "vec_id", "v", 5)
    return out.select(F.col("vec_id").alias("id"), "confidence", F.col("vector")[0].alias("first_value"), F.col("vector")[63].alias("last_value"))


@query("missing_image_resolve", f"WITH {_KNN}, i AS (SELECT id, avg(s) AS confidence FROM t GROUP BY id) SELECT p.sample_id, CASE WHEN e.vec_id IS NOT NULL AND e.vec_id % 50 <> 0 THEN 'real' WHEN i.confidence > 0.3 THEN 'interpolated' WHEN length(p.catalog_content) > 60 THEN 'text_based' ELSE 'configured' END AS strategy, coalesce(i.confidence, 0) AS confidence FROM products p LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.sample_id LEFT JOIN i ON CAST(i.id AS VARCHAR) = p.sample_id", "confidence")
def missing_image_resolve(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = neighbours.interpolate(v.filter("vec_id % 50 = 0"), v.filter("vec_id % 50 <> 0"), "vec_id", "v", 5).select(F.col("vec_id").cast("string").alias("sample_id"), "confidence")
    real = v.filter("vec_id % 50 <> 0").select(F.col("vec_id").cast("string").alias("sample_id"), F.lit(True).alias("real"))
    j = products(spark, d).select("sample_id", "catalog_content").join(real, "sample_id", "left").join(found, "sample_id", "left")
    strategy = F.when(F.col("real"), "real").when(F.col("confidence") > 0.3, "interpolated").when(F.length("catalog_content") > 60, "text_based").otherwise("configured")
    return j.select("sample_id", strategy.alias("strategy"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("model_pairwise", f"WITH {SMAPES} SELECT a.model AS model, b.model AS other, a.smape - b.smape AS difference, a.smape < b.smape AS better FROM s a JOIN s b ON a.model <> b.model", "difference")
def model_pairwise(spark, d):
    s = model_scores(spark, d)  # one row per model
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.col("a.model") != F.col("b.model")).select(F.col("a.model").alias("model"), F.col("b.model").alias("other"), (F.col("a.smape") - F.col("b.smape")).alias("difference"), (F.col("a.smape") < F.col("b.smape")).alias("better"))


@query("baseline_compare", f"WITH {SMAPES}, b AS (SELECT 'mean' AS baseline, avg(abs(m - y_true) / ((abs(m) + abs(y_true)) / 2)) * 100 AS base FROM predictions, (SELECT avg(y_true) AS m FROM predictions) WHERE model = 'm1' UNION ALL SELECT 'median', avg(abs(m - y_true) / ((abs(m) + abs(y_true)) / 2)) * 100 FROM predictions, (SELECT quantile_cont(y_true, 0.5) AS m FROM predictions) WHERE model = 'm1') SELECT model, baseline, base - smape AS improvement, 100 * (base - smape) / base AS percent, bool_and(smape < base) OVER (PARTITION BY model) AS beats_all, CAST(rank() OVER (PARTITION BY baseline ORDER BY smape) AS INT) AS rank FROM s, b", "improvement percent")
def baseline_compare(spark, d):
    p = predictions(spark, d)
    c = beside(p.agg(F.avg("y_true").alias("mean")), percentiles(p, "y_true", (0.5,), "q").select(F.col("q")[0].alias("median")))
    guess = F.col("g.p")
    base = p.filter("model = 'm1'").join(F.broadcast(c), F.lit(True)).select("y_true", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("p")) for k in ("mean", "median")))).alias("g"))
    base = base.groupBy(F.col("g.k").alias("baseline")).agg(metrics.smape(F.col("y_true"), guess).alias("base"))
    j = model_scores(spark, d).join(F.broadcast(base), F.lit(True))  # models x two baselines
    gain = F.col("base") - F.col("smape")
    return j.select("model", "baseline", gain.alias("improvement"), (100 * gain / F.col("base")).alias("percent"), F.bool_and(gain > 0).over(Window.partitionBy("model")).alias("beats_all"), F.rank().over(Window.partitionBy("baseline").orderBy("smape")).alias("rank"))


@query("manifest_verify", "WITH e AS (SELECT image_link AS path, any_value(url_hash) AS expected FROM downloads GROUP BY image_link), a AS (SELECT image_link AS path, CASE WHEN min(file_size) % 7000 = 0 THEN 'bad' ELSE any_value(url_hash) END AS actual FROM downloads WHERE status = 'success' GROUP BY image_link) SELECT CASE WHEN actual IS NULL THEN 'missing' WHEN actual = expected THEN 'valid' ELSE 'mismatch' END AS state, count(*) AS n FROM e LEFT JOIN a USING (path) GROUP BY 1")
def manifest_verify(spark, d):
    w = downloads(spark, d)
    expected = w.groupBy(F.col("image_link").alias("path")).agg(F.any_value("url_hash").alias("expected"))
    actual = w.filter("status = 'success'").groupBy(F.col("image_link").alias("path")).agg(F.when(F.min("file_size") % 7000 == 0, "bad").otherwise(F.any_value("url_hash")).alias("actual"))
    return joins.verify_manifest(expected, actual).groupBy("state").agg(F.count("*").alias("n"))


@query("quantile_bucket", f"WITH {EDGES} SELECT sample_id, {BUCKET} AS bucket FROM predictions, e WHERE model = 'm1'")
def quantile_bucket(spark, d):
    return metrics.with_quantile_bucket(predictions(spark, d).filter("model = 'm1'"), "y_true", 5).select("sample_id", "bucket")


@query("duplicate_flags", "SELECT sample_id, price, row_number() OVER (PARTITION BY sample_id ORDER BY price) > 1 AS duplicate FROM submission")
def duplicate_flags(spark, d):
    return submission(spark, d).withColumn("duplicate", F.row_number().over(Window.partitionBy("sample_id").orderBy("price")) > 1)


@query("url_dedup", "SELECT url_hash, min(image_link) AS url, arg_min(sample_id, CAST(sample_id AS BIGINT)) AS first_sample, count(*) AS reference_count FROM downloads GROUP BY url_hash")
def url_dedup(spark, d):
    return downloads(spark, d).groupBy("url_hash").agg(F.min("image_link").alias("url"), F.min_by("sample_id", F.col("sample_id").cast("long")).alias("first_sample"), F.count("*").alias("reference_count"))


@query("model_rank", f"WITH {SMAPES} SELECT model, smape, r2, CAST(rank() OVER (ORDER BY smape) AS INT) AS by_smape, CAST(rank() OVER (ORDER BY r2 DESC) AS INT) AS by_r2 FROM s", "smape r2")
def model_rank(spark, d):
    return model_scores(spark, d).select("*", F.rank().over(Window.orderBy("smape")).alias("by_smape"), F.rank().over(Window.orderBy(F.desc("r2"))).alias("by_r2"))


@query("sorted_gaps", "WITH g AS (SELECT price - lag(price) OVER (ORDER BY price) AS g FROM submission), m AS (SELECT avg(g) AS m FROM g) SELECT count(g) AS gaps, any_value(m) AS mean_gap, count(*) FILTER (abs(g - m) < 0.01) / CAST(count(g) AS DOUBLE) AS near_mean_share, max(g) AS widest FROM g, m", "mean_gap near_mean_share widest")
def sorted_gaps(spark, d):
    """Gaps of sorted prices: range-partitioned, with each partition's last price handed to the next."""
    g = joins.gaps(submission(spark, d).select("price"), "price")
    m = g.agg(F.avg("gap").alias("m"))
    near = F.count_if(F.abs(F.col("gap") - F.col("m")) < 0.01) / F.count("gap")
    return g.join(F.broadcast(m), F.lit(True)).agg(F.count("gap").alias("gaps"), F.first("m").alias("mean_gap"), near.alias("near_mean_share"), F.max("gap").alias("widest"))


@query("ensemble_weights", f"WITH {SMAPES} SELECT model, (1 / smape) / sum(1 / smape) OVER () AS weight FROM s", "weight", 9)
def ensemble_weights(spark, d):
    return joins.inverse_weights(model_scores(spark, d), "smape").select("model", "weight")


@query("keep_latest", "SELECT dataset_type, sample_id, CAST(CASE WHEN r <= 3 THEN r END AS INT) AS age, r <= 3 AS kept FROM (SELECT dataset_type, sample_id, row_number() OVER (PARTITION BY dataset_type ORDER BY CAST(sample_id AS BIGINT) DESC) AS r FROM downloads)")
def keep_latest(spark, d):
    """Every row, kept or to be deleted. The three newest of a type are found before the shuffle (a limit per group)."""
    newest = Window.partitionBy("dataset_type").orderBy(F.col("sample_id").cast("long").desc())
    rows = downloads(spark, d).select("dataset_type", "sample_id")
    kept = rows.withColumn("age", F.row_number().over(newest)).filter("age <= 3")
    return rows.join(F.broadcast(kept), ["dataset_type", "sample_id"], "left").withColumn("kept", F.col("age").isNotNull())  # three rows a type


@query("keep_best", f"WITH {FOLDS} SELECT model, fold, smape, CAST(row_number() OVER (PARTITION BY model ORDER BY smape, fold) AS INT) AS place FROM f QUALIFY place <= 2", "smape")
def keep_best(spark, d):
    best = Window.partitionBy("model").orderBy("smape", "fold")
    return fold_scores(spark, d).withColumn("place", F.row_number().over(best)).filter("place <= 2")


H32 = "CAST('0x' || substr(md5(sample_id), 1, 8) AS BIGINT)"


def hash32(column):
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")


@query("kfold_assign", f"WITH {EDGES} SELECT sample_id, {H32} % 5 AS fold, (row_number() OVER (PARTITION BY {BUCKET} ORDER BY md5(sample_id)) - 1) % 5 AS stratified_fold FROM predictions, e WHERE model = 'm1'")
def kfold_assign(spark, d):
    b = metrics.with_quantile_bucket(predictions(spark, d).filter("model = 'm1'"), "y_true", 5)
    ranked = hashed_rank(b.select("sample_id", "bucket"), "bucket", "sample_id")
    return ranked.select("sample_id", (hash32("sample_id") % 5).alias("fold"), (F.col("place") % 5).alias("stratified_fold"))


@query("holdout_split", f"WITH {EDGES} SELECT sample_id, percent_rank() OVER (PARTITION BY {BUCKET} ORDER BY md5(sample_id)) < 0.2 AS holdout FROM predictions, e WHERE model = 'm1'")
def holdout_split(spark, d):
    b = metrics.with_quantile_bucket(predictions(spark, d).filter("model = 'm1'"), "y_true", 5)
    ranked = hashed_rank(b.select("sample_id", "bucket"), "bucket", "sample_id")
    return ranked.select("sample_id", (F.col("place") / F.greatest(F.col("members") - 1, F.lit(1)) < 0.2).alias("holdout"))


@query("sample_rows", "SELECT sample_id, price FROM products ORDER BY md5(sample_id) LIMIT 100")
def sample_rows(spark, d):
    """A sampling operator: 100 rows, the same whatever the partitioning."""
    return products(spark, d).select("sample_id", "price").orderBy(F.md5("sample_id")).limit(100)


@query("best_model", f"WITH {SMAPES} SELECT arg_min(model, smape) AS best, min(smape) AS smape, max(smape) - min(smape) AS margin FROM s", "smape margin")
def best_model(spark, d):
    return model_scores(spark, d).agg(F.min_by("model", "smape").alias("best"), F.min("smape").alias("smape"), (F.max("smape") - F.min("smape")).alias("margin"))


@query("best_experiment", f"WITH {FOLDS} SELECT arg_min(model || '/' || fold, smape) AS lowest, arg_max(model || '/' || fold, smape) AS highest FROM f")
def best_experiment(spark, d):
    name = F.concat_ws("/", "model", "fold")
    return fold_scores(spark, d).agg(F.min_by(name, F.col("smape")).alias("lowest"), F.max_by(name, F.col("smape")).alias("highest"))


@query("union_train_test", "SELECT sample_id, catalog_content, price FROM products WHERE fold <> 0 UNION ALL SELECT sample_id, catalog_content, NULL FROM products WHERE fold = 0")
def union_train_test(spark, d):
    p = products(spark, d)
    return p.filter("fold <> 0").select("sample_id", "catalog_content", "price").unionByName(p.filter("fold = 0").select("sample_id", "catalog_content"), allowMissingColumns=True)


@query("ids_except", "SELECT sample_id FROM products EXCEPT SELECT sample_id FROM submission")
def ids_except(spark, d):
    return products(spark, d).select("sample_id").subtract(submission(spark, d).select("sample_id"))


@query("ids_intersect", "SELECT sample_id FROM products INTERSECT SELECT sample_id FROM submission")
def ids_intersect(spark, d):
    return products(spark, d).select("sample_id").intersect(submission(spark, d).select("sample_id"))
