"""Queries over checks, metrics and other aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import clean, rules
from shelfwise.operators import metrics
from shelfwise.operators.percentiles import beside, percentiles
from shelfwise.plans.cleaning import price_sql
from shelfwise.plans.registry import lit, query
from shelfwise.sources.tables import downloads, predictions, products, submission, table



def hits(c):
    return F.count_if(c)


def pct(column, *shares):
    """For the few scores of one model; ``percentiles`` is for whole columns."""
    return F.percentile(column, F.array(*(F.lit(s) for s in shares)))


@query("schema_validate", f"SELECT 'price_text' AS column_name, count(*) AS rows, count(*) FILTER (price_text IS NOT NULL AND ({price_sql('price_text')}) IS NULL) AS failed_casts, '' AS missing_columns, 'fold,price_text' AS extra_columns FROM products")
def schema_validate(spark, d):
    df = products(spark, d)
    missing, extra = sorted(set(rules.EXPECTED_TRAIN) - set(df.columns)), sorted(set(df.columns) - set(rules.EXPECTED_TRAIN))
    bad = F.col("price_text").isNotNull() & clean.price_from_text(F.col("price_text")).isNull()
    return df.agg(F.lit("price_text").alias("column_name"), F.count("*").alias("rows"), hits(bad).alias("failed_casts"), F.lit(",".join(missing)).alias("missing_columns"), F.lit(",".join(extra)).alias("extra_columns"))


@query(
    "integrity_check",
    "WITH e AS (SELECT quantile_cont(price, 0.99) AS hi, quantile_cont(price, 0.01) AS lo FROM submission), r AS (SELECT s.*, c.catalog_content, c.image_link FROM submission s LEFT JOIN products c USING (sample_id)) SELECT count(*) AS rows, count(sample_id) - count(DISTINCT sample_id) AS duplicates, count(*) FILTER (sample_id IS NULL) AS missing_ids, count(*) FILTER (price < 0) AS negative, count(*) FILTER (catalog_content IS NULL) AS no_text, count(*) FILTER (image_link IS NULL) AS no_image, count(*) FILTER (price IS NULL) AS no_price, count(*) FILTER (price = 0) AS zero, count(*) FILTER (price > 10 * hi) AS high, count(*) FILTER (price < lo / 10) AS low FROM r, e",
)
def integrity_check(spark, d):
    s = submission(spark, d)
    e = percentiles(s, "price", (0.01, 0.99), "e")
    r = s.join(products(spark, d).select("sample_id", "catalog_content", "image_link"), "sample_id", "left").join(F.broadcast(e), F.lit(True))
    p = F.col("price")
    return r.agg(
        F.count("*").alias("rows"), (F.count("sample_id") - F.count_distinct("sample_id")).alias("duplicates"), hits(F.col("sample_id").isNull()).alias("missing_ids"), hits(p < 0).alias("negative"), hits(F.col("catalog_content").isNull()).alias("no_text"), hits(F.col("image_link").isNull()).alias("no_image"),
        hits(p.isNull()).alias("no_price"), hits(p == 0).alias("zero"), hits(p > 10 * F.col("e")[1]).alias("high"), hits(p < F.col("e")[0] / 10).alias("low"),
    )


@query(
    "data_summary",
    "WITH a AS (SELECT count(*) AS rows, count(*) - count(sample_id) AS null_ids, count(*) - count(image_link) AS null_links, avg(price) AS price_mean, stddev_samp(price) AS price_std, min(price) AS price_min, quantile_cont(price, 0.25) AS price_q25, quantile_cont(price, 0.5) AS price_q50, quantile_cont(price, 0.75) AS price_q75, max(price) AS price_max, avg(length(catalog_content)) AS text_mean, min(length(catalog_content)) AS text_min, max(length(catalog_content)) AS text_max FROM products) UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM a) ON COLUMNS(*) INTO NAME measure VALUE value",
    "value",
)
def data_summary(spark, d):
    p, t = F.col("price"), F.length("catalog_content")
    q = [F.col("q")[i] for i in range(3)]
    a = products(spark, d).agg(
        F.count("*").alias("rows"), (F.count("*") - F.count("sample_id")).alias("null_ids"), (F.count("*") - F.count("image_link")).alias("null_links"), F.avg(p).alias("price_mean"), F.stddev_samp(p).alias("price_std"), F.min(p).alias("price_min"), F.max(p).alias("price_max"),
        F.avg(t).alias("text_mean"), F.min(t).alias("text_min"), F.max(t).alias("text_max"),
    )
    a = beside(a, percentiles(products(spark, d), "price", (0.25, 0.5, 0.75), "q")).withColumns({f"price_q{k}": q[i] for i, k in enumerate((25, 50, 75))}).drop("q")
    return a.select(*(F.col(c).cast("double").alias(c) for c in a.columns)).unpivot([], a.columns, "measure", "value")


@query("row_contract", f"SELECT sample_id, array_to_string(list_filter([CASE WHEN price_text IS NULL OR trim(price_text) = '' THEN 'no price' END, CASE WHEN trim(price_text) <> '' AND ({price_sql('price_text')}) IS NULL THEN 'price is no number' END, CASE WHEN ({price_sql('price_text')}) < 0 THEN 'price is negative' END, CASE WHEN image_link IS NULL THEN 'no image link' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM products WHERE image_link IS NULL OR ({price_sql('price_text')}) IS NULL OR ({price_sql('price_text')}) < 0")
def row_contract(spark, d):
    t, p = F.btrim("price_text"), clean.price_from_text(F.col("price_text"))
    reasons = F.array_compact(F.array(F.when(t.isNull() | (t == ""), F.lit("no price")), F.when((t != "") & p.isNull(), F.lit("price is no number")), F.when(p < 0, F.lit("price is negative")), F.when(F.col("image_link").isNull(), F.lit("no image link"))))
    return products(spark, d).select("sample_id", reasons.alias("r")).filter(F.size("r") > 0).select("sample_id", F.array_join("r", "; ").alias("reasons"))


@query("dataset_classify", "SELECT 'submission' AS dataset, 'prediction_output' AS kind, count(*) - count(DISTINCT sample_id) AS duplicates, count(*) FILTER (sample_id IS NULL) AS null_ids, min(price) < 0 AS has_negative, max(price) > 10000 AS has_extreme FROM submission UNION ALL SELECT 'products', 'training', count(*) - count(DISTINCT sample_id), count(*) FILTER (sample_id IS NULL), min(price) < 0, max(price) > 10000 FROM products")
def dataset_classify(spark, d):
    def kind(columns):
        c = set(columns)
        return "training" if set(rules.EXPECTED_TRAIN) <= c else "test" if {"sample_id", "catalog_content", "image_link"} <= c else "prediction_output" if c == {"sample_id", "price"} else "unknown"

    def row(name, df):
        return df.agg(F.lit(name).alias("dataset"), F.lit(kind(df.columns)).alias("kind"), (F.count("*") - F.count_distinct("sample_id")).alias("duplicates"), hits(F.col("sample_id").isNull()).alias("null_ids"), (F.min("price") < 0).alias("has_negative"), (F.max("price") > 10000).alias("has_extreme"))

    return row("submission", submission(spark, d)).union(row("products", products(spark, d)))


@query("smape", "SELECT model, coalesce(avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE abs(y_pred - y_true) / ((abs(y_true) + abs(y_pred)) / 2) END) * 100, 0) AS smape FROM predictions GROUP BY model", "smape")
def smape(spark, d):
    return predictions(spark, d).filter(metrics.finite(F.col("y_true"), F.col("y_pred"))).groupBy("model").agg(metrics.smape(F.col("y_true"), F.col("y_pred")).alias("smape"))


@query("smape_variants", "SELECT model, avg(abs(y_pred - y_true) / greatest((abs(y_true) + abs(y_pred)) / 2, 1e-8)) * 100 AS floor, avg(abs(y_true - greatest(y_pred, 0.01)) / ((abs(y_true) + abs(greatest(y_pred, 0.01))) / 2 + 1e-8)) * 100 AS clipped, avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE 2 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred)) END) * 100 AS double FROM predictions GROUP BY model", "floor clipped double")
def smape_variants(spark, d):
    return predictions(spark, d).groupBy("model").agg(metrics.smape_floor(F.col("y_true"), F.col("y_pred")).alias("floor"), metrics.smape_clipped(F.col("y_true"), F.col("y_pred")).alias("clipped"), metrics.smape_double(F.col("y_true"), F.col("y_pred")).alias("double"))


@query("smape_details", "WITH e AS (SELECT model, abs(y_true) + abs(y_pred) = 0 AS z, CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE abs(y_pred - y_true) / ((abs(y_true) + abs(y_pred)) / 2) * 100 END AS e FROM predictions) SELECT model, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS std, quantile_cont(e, 0.5) AS median, min(e) AS least, max(e) AS most, count(*) FILTER (z) AS zero_denominators FROM e GROUP BY model", "mean std median least most")
def smape_details(spark, d):
    e = predictions(spark, d).withColumn("e", metrics.row_error(F.col("y_true"), F.col("y_pred")) * 100).withColumn("z", F.abs(F.col("y_true")) + F.abs(F.col("y_pred")) == 0)
    half = percentiles(e, "e", (0.5,), "q", ("model",)).select("model", F.col("q")[0].alias("median"))
    return e.groupBy("model").agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.min("e").alias("least"), F.max("e").alias("most"), hits("z").alias("zero_denominators")).join(half, "model")


BUCKET = "1 + CAST(y_true >= e1 AS INT) + CAST(y_true >= e2 AS INT) + CAST(y_true >= e3 AS INT) + CAST(y_true >= e4 AS INT)"
EDGES = "e AS (SELECT quantile_cont(y_true, 0.2) AS e1, quantile_cont(y_true, 0.4) AS e2, quantile_cont(y_true, 0.6) AS e3, quantile_cont(y_true, 0.8) AS e4 FROM predictions WHERE model = 'm1')"
ERR = "CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE abs(y_pred - y_true) / ((abs(y_true) + abs(y_pred)) / 2) END"


@query("quantile_smape", f"WITH {EDGES} SELECT {BUCKET} AS bucket, count(*) AS n, avg({ERR}) * 100 AS smape, min(y_true) AS low, max(y_true) AS high FROM predictions, e WHERE model = 'm1' GROUP BY 1", "smape low high")
def quantile_smape(spark, d):
    b = metrics.with_quantile_bucket(predictions(spark, d).filter("model = 'm1'"), "y_true", 5)
    return b.groupBy("bucket").agg(F.count("*").alias("n"), metrics.smape(F.col("y_true"), F.col("y_pred")).alias("smape"), F.min("y_true").alias("low"), F.max("y_true").alias("high"))


REG = "avg(abs(y_pred - y_true)) AS mae, avg((y_pred - y_true) * (y_pred - y_true)) AS mse, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, 1 - sum((y_pred - y_true) * (y_pred - y_true)) / (count(y_true) * var_pop(y_true)) AS r2, avg(abs((y_pred - y_true) / y_true)) FILTER (y_true <> 0) * 100 AS mape"


@query("regression_metrics", f"SELECT model, {REG} FROM predictions GROUP BY model", "mae mse rmse r2 mape")
def regression_metrics(spark, d):
    return predictions(spark, d).groupBy("model").agg(*(c.alias(k) for k, c in metrics.regression(F.col("y_true"), F.col("y_pred")).items()))


@query("summary_stats", "SELECT avg(price) AS mean, stddev_pop(price) AS std, min(price) AS least, max(price) AS most, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75, count(*) FILTER (price < 0) AS negative, count(*) FILTER (price = 0) AS zero, count(*) FILTER (price < 0.01) AS under FROM submission", "mean std least most median q25 q75")
def summary_stats(spark, d):
    q, p = percentiles(submission(spark, d), "price", (0.5, 0.25, 0.75), "q"), F.col("price")
    a = submission(spark, d).agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("least"), F.max(p).alias("most"), hits(p < 0).alias("negative"), hits(p == 0).alias("zero"), hits(p < 0.01).alias("under"))
    return beside(a, q).withColumns({k: F.col("q")[i] for i, k in enumerate(("median", "q25", "q75"))}).drop("q")


@query(
    "residual_diagnostics",
    "WITH r AS (SELECT model, y_pred AS p, y_true AS y, y_pred - y_true AS r FROM predictions), m AS (SELECT model, avg(r) AS mean, stddev_pop(r) AS std, corr(p, abs(r)) AS c, max(p) - min(p) AS pr, max(y) - min(y) AS yr FROM r GROUP BY model) SELECT r.model, any_value(mean) AS mean, any_value(std) AS std, avg(((r - mean) / std) ** 3) AS skew, avg(((r - mean) / std) ** 4) - 3 AS kurtosis, count(*) FILTER (abs(r) > 3 * std) AS outliers, any_value(c) AS correlation, any_value(c) > 0.1 AS uneven, any_value(pr) / any_value(yr) AS range_ratio, any_value(mean) > 0.1 * any_value(std) AS over, count(*) / 6.0 * (avg(((r - mean) / std) ** 3) ** 2 + (avg(((r - mean) / std) ** 4) - 3) ** 2 / 4) AS jarque_bera FROM r JOIN m USING (model) GROUP BY r.model",
    "mean std skew kurtosis correlation range_ratio jarque_bera", 5,
)
def residual_diagnostics(spark, d):
    r = predictions(spark, d).withColumn("r", F.col("y_pred") - F.col("y_true"))
    m = r.groupBy("model").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurtosis"), F.corr("y_pred", F.abs("r")).alias("correlation"), ((F.max("y_pred") - F.min("y_pred")) / (F.max("y_true") - F.min("y_true"))).alias("range_ratio"), F.count("*").alias("rows"))
    out = r.join(F.broadcast(m.select("model", "std")), "model").groupBy("model").agg(hits(F.abs("r") > 3 * F.col("std")).alias("outliers"))
    jb = F.col("rows") / 6 * (F.pow("skew", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return m.join(out, "model").select("model", "mean", "std", "skew", "kurtosis", "outliers", "correlation", (F.col("correlation") > 0.1).alias("uneven"), "range_ratio", (F.col("mean") > 0.1 * F.col("std")).alias("over"), jb.alias("jarque_bera"))


FENCE = "e AS (SELECT quantile_cont(price, 0.01) AS p1, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, quantile_cont(price, 0.99) AS p99 FROM submission)"


@query(
    "price_anomalies",
    f"WITH {FENCE}, a AS (SELECT 'negative' AS kind, sample_id, price FROM submission WHERE price < 0 UNION ALL SELECT 'extreme_high', sample_id, price FROM submission, e WHERE price > 10 * p99 UNION ALL SELECT 'extreme_low', sample_id, price FROM submission, e WHERE price > 0 AND price < greatest(p1 / 10, 0.001) UNION ALL SELECT 'iqr', sample_id, price FROM submission, e WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) SELECT kind, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM submission) AS percent, array_to_string(list_sort(list(sample_id))[1:10], ',') AS first_ids FROM a GROUP BY kind",
    "percent",
)
def price_anomalies(spark, d):
    s = submission(spark, d)
    e = beside(s.agg(F.count("*").alias("total")), percentiles(s, "price", (0.01, 0.25, 0.75, 0.99), "e"))
    p, q = F.col("price"), [F.col("e")[i] for i in range(4)]
    kinds = F.array_compact(F.array(F.when(p < 0, F.lit("negative")), F.when(p > 10 * q[3], F.lit("extreme_high")), F.when((p > 0) & (p < F.greatest(q[0] / 10, F.lit(0.001))), F.lit("extreme_low")), F.when((p < q[1] - 1.5 * (q[2] - q[1])) | (p > q[2] + 1.5 * (q[2] - q[1])), F.lit("iqr"))))
    rows = s.join(F.broadcast(e), F.lit(True)).select("sample_id", "total", F.explode(kinds).alias("kind"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("sample_id"))).filter("rank <= 10")
    first = ranked.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("first_ids"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), (100.0 * F.count("*") / F.first("total")).alias("percent")).join(first, "kind")


@query(
    "data_quality_score",
    f"WITH p AS (SELECT {price_sql('price_text')} AS v, price_text FROM products), a AS (SELECT count(*) AS rows, count(v) AS priced, count(*) FILTER (v >= 0) AS valid, count(*) FILTER (v < 0) + count(*) FILTER (v = 0) + count(*) FILTER (v IS NULL) AS anomalies, count(*) FILTER (v IS NULL) AS invalid FROM p) SELECT *, 40.0 * priced / rows AS completeness, 30.0 * valid / rows AS validity, greatest(0, 20 - 100.0 * anomalies / rows) AS anomaly_points, CASE WHEN invalid > rows * 0.01 THEN 5 ELSE 10 END AS consistency, 40.0 * priced / rows + 30.0 * valid / rows + greatest(0, 20 - 100.0 * anomalies / rows) + CASE WHEN invalid > rows * 0.01 THEN 5 ELSE 10 END AS score FROM a",
    "completeness validity anomaly_points consistency score",
)
def data_quality_score(spark, d):
    v = F.col("v")
    a = products(spark, d).select(clean.price_from_text(F.col("price_text")).alias("v")).agg(F.count("*").alias("rows"), F.count(v).alias("priced"), hits(v >= 0).alias("valid"), (hits(v < 0) + hits(v == 0) + hits(v.isNull())).alias("anomalies"), hits(v.isNull()).alias("invalid"))
    of = lambda x, c: F.lit(float(x)) * F.col(c) / F.col("rows")
    b = a.select("*", of(40, "priced").alias("completeness"), of(30, "valid").alias("validity"), F.greatest(F.lit(0.0), 20 - of(100, "anomalies")).alias("anomaly_points"), F.when(F.col("invalid") > F.col("rows") * 0.01, 5.0).otherwise(10.0).alias("consistency"))
    return b.withColumn("score", F.col("completeness") + F.col("validity") + F.col("anomaly_points") + F.col("consistency"))


@query(
    "preprocess_quality",
    "WITH a AS (SELECT count(*) AS rows, count(DISTINCT sample_id) AS ids, count(*) FILTER (length(trim(catalog_content)) >= 20) AS texts, count(image_link) AS links, count(*) FILTER (price > 0) AS prices FROM products) SELECT rows, 25.0 * ids / rows AS id_points, 25.0 * texts / rows AS content_points, 25.0 * links / rows AS image_points, 25.0 * prices / rows AS price_points, 25.0 * (ids + texts + links + prices) / rows AS score, 25.0 * (ids + texts + links + prices) / rows < 80 AS warn FROM a",
    "id_points content_points image_points price_points score",
)
def preprocess_quality(spark, d):
    a = products(spark, d).agg(F.count("*").alias("rows"), F.count_distinct("sample_id").alias("ids"), hits(F.length(F.btrim("catalog_content")) >= 20).alias("texts"), F.count("image_link").alias("links"), hits(F.col("price") > 0).alias("prices"))
    of = lambda c: F.lit(25.0) * c / F.col("rows")
    total = of(F.col("ids") + F.col("texts") + F.col("links") + F.col("prices"))
    return a.select("rows", of(F.col("ids")).alias("id_points"), of(F.col("texts")).alias("content_points"), of(F.col("links")).alias("image_points"), of(F.col("prices")).alias("price_points"), total.alias("score"), (total < 80).alias("warn"))


@query("prediction_ranges", "SELECT min(price) AS least, max(price) AS most, avg(price) AS mean, bool_and(price IS NOT NULL) AS no_nulls, bool_and(NOT isnan(price)) AS no_nan, bool_and(NOT isinf(price)) AS no_infinite, bool_and(price > 0) AS all_positive, bool_and(price >= 0.01) AS above_least, bool_and(price <= 10000) AS below_most, count(*) FILTER (price IS NULL) AS nulls, count(*) FILTER (price < 0) AS negative, count(*) FILTER (price = 0) AS zero, count(*) FILTER (price < 0.01) AS under, count(*) FILTER (price > 10000) AS over, count(*) FILTER (price > 1000) AS suspicious FROM submission", "least most mean")
def prediction_ranges(spark, d):
    p = F.col("price")
    return submission(spark, d).agg(
        F.min(p).alias("least"), F.max(p).alias("most"), F.avg(p).alias("mean"), F.bool_and(p.isNotNull()).alias("no_nulls"), F.bool_and(~F.isnan(p)).alias("no_nan"), F.bool_and(F.abs(p) != float("inf")).alias("no_infinite"), F.bool_and(p > 0).alias("all_positive"), F.bool_and(p >= 0.01).alias("above_least"), F.bool_and(p <= 10000).alias("below_most"),
        hits(p.isNull()).alias("nulls"), hits(p < 0).alias("negative"), hits(p == 0).alias("zero"), hits(p < 0.01).alias("under"), hits(p > 10000).alias("over"), hits(p > 1000).alias("suspicious"),
    )


@query("outliers", "WITH e AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, avg(price) AS m, stddev_pop(price) AS s FROM submission) SELECT any_value(q1) - 3 * (any_value(q3) - any_value(q1)) AS low, any_value(q3) + 3 * (any_value(q3) - any_value(q1)) AS high, count(*) FILTER (price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1)) AS iqr_outliers, count(*) FILTER (abs(price - m) > 3 * s) AS z_outliers FROM submission, e", "low high")
def outliers(spark, d):
    s = submission(spark, d)
    e = beside(s.agg(F.avg("price").alias("m"), F.stddev_pop("price").alias("s")), percentiles(s, "price", (0.25, 0.75), "q"))
    width = F.col("q")[1] - F.col("q")[0]
    low, high, p = F.col("q")[0] - 3 * width, F.col("q")[1] + 3 * width, F.col("price")
    return s.join(F.broadcast(e), F.lit(True)).agg(F.first(low).alias("low"), F.first(high).alias("high"), hits((p < low) | (p > high)).alias("iqr_outliers"), hits(F.abs(p - F.col("m")) > 3 * F.col("s")).alias("z_outliers"))


SHARES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query("distribution", "WITH m AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM submission) SELECT avg(price) AS mean, any_value(s) AS std, avg(((price - m) / s) ** 3) AS skew, avg(((price - m) / s) ** 4) - 3 AS kurtosis, " + ", ".join(f"quantile_cont(price, {k / 100}) AS p{k}" for k in SHARES) + " FROM submission, m", "mean std skew kurtosis " + " ".join(f"p{k}" for k in SHARES), 5)
def distribution(spark, d):
    q = percentiles(submission(spark, d), "price", [k / 100 for k in SHARES], "q")
    a = submission(spark, d).agg(F.avg("price").alias("mean"), F.stddev_pop("price").alias("std"), F.skewness("price").alias("skew"), F.kurtosis("price").alias("kurtosis"))
    return beside(a, q).withColumns({f"p{k}": F.col("q")[i] for i, k in enumerate(SHARES)}).drop("q")


#: Severity, SQL and column of every check of a submission.
CHECKS = {
        "rows": ("critical", "count(*) > 0", lambda: F.count("*") > 0), "no_null_ids": ("critical", "count(*) = count(sample_id)", lambda: F.count("*") == F.count("sample_id")), "no_null_prices": ("critical", "count(*) = count(price)", lambda: F.count("*") == F.count("price")), "unique_ids": ("critical", "count(sample_id) = count(DISTINCT sample_id)", lambda: F.count("sample_id") == F.count_distinct("sample_id")),
        "no_negative": ("critical", "count(*) FILTER (price < 0) = 0", lambda: hits(F.col("price") < 0) == 0), "finite": ("critical", "count(*) FILTER (isinf(price) OR isnan(price)) = 0", lambda: hits(F.isnan("price") | (F.abs("price") == float("inf"))) == 0), "at_least_min": ("important", "count(*) FILTER (price < 0.01) = 0", lambda: hits(F.col("price") < 0.01) == 0),
        "at_most_max": ("important", "count(*) FILTER (price > 10000) = 0", lambda: hits(F.col("price") > 10000) == 0), "id_format": ("important", "count(*) FILTER (NOT regexp_matches(sample_id, '^[a-zA-Z0-9_-]+$')) = 0", lambda: hits(~F.col("sample_id").rlike("^[a-zA-Z0-9_-]+$")) == 0), "spread": ("important", "stddev_pop(price) > 0", lambda: F.stddev_pop("price") > 0),
        "mean_plausible": ("optional", "avg(price) BETWEEN 0.1 AND 1000", lambda: F.avg("price").between(0.1, 1000)), "no_zero": ("optional", "count(*) FILTER (price = 0) = 0", lambda: hits(F.col("price") == 0) == 0), "few_high": ("optional", "count(*) FILTER (price > 1000) <= count(*) / 100", lambda: hits(F.col("price") > 1000) <= F.count("*") / 100),
}
_long = "WITH a AS (SELECT " + ", ".join(f"{s} AS {k}" for k, (_, s, _) in CHECKS.items()) + " FROM submission), l AS (UNPIVOT a ON COLUMNS(*) INTO NAME check_name VALUE passed), c AS (SELECT *, CASE " + " ".join(f"WHEN check_name = '{k}' THEN '{s}'" for k, (s, _, _) in CHECKS.items()) + " END AS severity FROM l)"


def check_table(df):
    """One aggregate gives all checks; long form: check_name, severity, passed."""
    a = df.agg(*(c().alias(k) for k, (_, _, c) in CHECKS.items()))
    severity = F.create_map(*(x for k, (s, _, _) in CHECKS.items() for x in (F.lit(k), F.lit(s))))
    return a.unpivot([], list(CHECKS), "check_name", "passed").withColumn("severity", F.element_at(severity, F.col("check_name")))


@query("output_checks", _long + " SELECT check_name, severity, passed, CASE WHEN count(*) FILTER (NOT passed) OVER () = 0 THEN 'PASS' WHEN count(*) FILTER (passed) OVER () >= 0.8 * count(*) OVER () THEN 'PASS_WITH_WARNINGS' ELSE 'FAIL' END AS overall FROM c")
def output_checks(spark, d):
    c = check_table(submission(spark, d))
    every = Window.partitionBy()  # over the checks, thirteen rows
    failed, passed = F.sum(F.when(F.col("passed"), 0).otherwise(1)).over(every), F.sum(F.when(F.col("passed"), 1).otherwise(0)).over(every)
    return c.withColumn("overall", F.when(failed == 0, "PASS").when(passed >= 0.8 * F.count("*").over(every), "PASS_WITH_WARNINGS").otherwise("FAIL"))


@query("final_qa", _long + ", s AS (SELECT count(*) FILTER (severity = 'critical' AND NOT passed) AS critical_failed, count(*) FILTER (severity = 'important' AND NOT passed) AS important_failed, count(*) FILTER (severity = 'optional' AND NOT passed) AS optional_failed FROM c) SELECT *, CASE WHEN critical_failed > 0 THEN 'FAIL' WHEN important_failed > 1 THEN 'NEEDS_REVIEW' WHEN important_failed + optional_failed > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM s")
def final_qa(spark, d):
    bad = lambda s: hits((F.col("severity") == s) & ~F.col("passed"))
    s = check_table(submission(spark, d)).agg(*(bad(k).alias(f"{k}_failed") for k in ("critical", "important", "optional")))
    c, i, o = (F.col(f"{k}_failed") for k in ("critical", "important", "optional"))
    return s.withColumn("status", F.when(c > 0, "FAIL").when(i > 1, "NEEDS_REVIEW").when(i + o > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


@query(
    "consistency_checks",
    "WITH l AS (SELECT count(*) AS foreign_lengths FROM (SELECT DISTINCT length(sample_id) FROM submission EXCEPT SELECT DISTINCT length(sample_id) FROM products)), c AS (SELECT max(k) / CAST(sum(k) AS DOUBLE) AS common_share FROM (SELECT count(*) AS k FROM submission GROUP BY price)), g AS (SELECT avg(g) AS m FROM (SELECT price - lag(price) OVER (ORDER BY price) AS g FROM submission) WHERE g IS NOT NULL) SELECT foreign_lengths = 0 AS known_lengths, common_share, common_share < 0.1 AS varied FROM l, c, g",
    "common_share",
)
def consistency_checks(spark, d):
    s = submission(spark, d)
    lengths = s.select(F.length("sample_id").alias("k")).distinct().join(products(spark, d).select(F.length("sample_id").alias("k")).distinct(), "k", "left_anti").agg((F.count("*") == 0).alias("known_lengths"))
    common = s.groupBy("price").agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("common_share"))
    return lengths.join(common, F.lit(True)).withColumn("varied", F.col("common_share") < 0.1)  # two rows of one


@query("raw_vs_formatted", "SELECT count(*) AS rows, count(*) FILTER (price < 0.01) AS clamped, count(*) FILTER (abs(greatest(price, 0.01) - round_even(greatest(price, 0.01), 2)) > 1e-12) AS rounded, min(price) AS raw_min, max(price) AS raw_max FROM submission", "raw_min raw_max")
def raw_vs_formatted(spark, d):
    c = F.greatest("price", F.lit(0.01))
    return submission(spark, d).agg(F.count("*").alias("rows"), hits(F.col("price") < 0.01).alias("clamped"), hits(F.abs(c - F.rint(c * 100) / 100) > 1e-12).alias("rounded"), F.min("price").alias("raw_min"), F.max("price").alias("raw_max"))


@query("download_stats", "SELECT dataset_type, count(*) AS requested, count(*) FILTER (status = 'success') AS succeeded, 100.0 * count(*) FILTER (status = 'success') / count(*) AS success_rate, 100.0 * count(*) FILTER (status = 'success' AND attempts = 1) / count(*) AS first_try_rate, 100.0 * count(*) FILTER (status = 'failed') / count(*) AS failure_rate, avg(attempts) AS mean_attempts, avg(file_size) FILTER (status = 'success') AS mean_size FROM downloads GROUP BY dataset_type", "success_rate first_try_rate failure_rate mean_attempts mean_size")
def download_stats(spark, d):
    ok = F.col("status") == "success"
    rate = lambda c: 100.0 * hits(c) / F.count("*")
    return downloads(spark, d).groupBy("dataset_type").agg(F.count("*").alias("requested"), hits(ok).alias("succeeded"), rate(ok).alias("success_rate"), rate(ok & (F.col("attempts") == 1)).alias("first_try_rate"), rate(~ok).alias("failure_rate"), F.avg("attempts").alias("mean_attempts"), F.avg(F.when(ok, F.col("file_size"))).alias("mean_size"))


@query("failure_analysis", "SELECT split_part(error, '_', 1) AS kind, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS share, count(*) FILTER (attempts > 2) AS retried FROM downloads WHERE status = 'failed' GROUP BY 1", "share")
def failure_analysis(spark, d):
    f = downloads(spark, d).filter("status = 'failed'").groupBy(F.split_part("error", F.lit("_"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"), hits(F.col("attempts") > 2).alias("retried"))
    return f.select("kind", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), "retried")  # a row per kind


@query("download_summary", "SELECT coalesce(dataset_type, 'all') AS dataset_type, coalesce(status, 'all') AS status, count(*) AS n FROM downloads GROUP BY ROLLUP (dataset_type, status)")
def download_summary(spark, d):
    r = downloads(spark, d).rollup("dataset_type", "status").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("dataset_type", F.lit("all")).alias("dataset_type"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query("missing_image_analysis", "SELECT CASE WHEN GROUPING(reason) = 0 THEN 'reason' WHEN GROUPING(strategy) = 0 THEN 'strategy' ELSE 'hour' END AS facet, coalesce(reason, strategy, CAST(hour AS VARCHAR)) AS value, count(*) AS n FROM (SELECT event_type AS reason, CASE WHEN value > 50 THEN 'text_based' ELSE 'zero' END AS strategy, hour(ts) AS hour FROM events WHERE event_type = 'error') GROUP BY GROUPING SETS ((reason), (strategy), (hour))")
def missing_image_analysis(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_type").alias("reason"), F.when(F.col("value") > 50, "text_based").otherwise("zero").alias("strategy"), F.hour("ts").cast("string").alias("hour"))
    return e.unpivot([], ["reason", "strategy", "hour"], "facet", "value").groupBy("facet", "value").agg(F.count("*").alias("n"))


FOLDS = f"f AS (SELECT model, fold, avg({ERR}) * 100 AS smape FROM predictions GROUP BY model, fold)"


def fold_scores(spark, d):
    return predictions(spark, d).groupBy("model", "fold").agg(metrics.smape(F.col("y_true"), F.col("y_pred")).alias("smape"))


@query("cv_aggregate", f"WITH {FOLDS} SELECT model, avg(smape) AS mean, stddev_pop(smape) AS std, min(smape) AS least, max(smape) AS most, quantile_cont(smape, 0.5) AS median, quantile_cont(smape, 0.025) AS low, quantile_cont(smape, 0.975) AS high FROM f GROUP BY model", "mean std least most median low high")
def cv_aggregate(spark, d):
    q = pct("smape", 0.5, 0.025, 0.975)
    return fold_scores(spark, d).groupBy("model").agg(F.avg("smape").alias("mean"), F.stddev_pop("smape").alias("std"), F.min("smape").alias("least"), F.max("smape").alias("most"), q[0].alias("median"), q[1].alias("low"), q[2].alias("high"))


@query("fold_consistency", f"WITH {FOLDS}, e AS (SELECT model, stddev_pop(smape) / avg(smape) AS cv, quantile_cont(smape, 0.25) AS q1, quantile_cont(smape, 0.75) AS q3 FROM f GROUP BY model) SELECT f.model, any_value(cv) AS cv, CASE WHEN any_value(cv) < 0.1 THEN 'stable' WHEN any_value(cv) < 0.2 THEN 'moderate' ELSE 'unstable' END AS level, count(*) FILTER (smape < q1 - 1.5 * (q3 - q1) OR smape > q3 + 1.5 * (q3 - q1)) AS outlier_folds FROM f JOIN e USING (model) GROUP BY f.model", "cv")
def fold_consistency(spark, d):
    f = fold_scores(spark, d)
    e = f.groupBy("model").agg((F.stddev_pop("smape") / F.avg("smape")).alias("cv"), pct("smape", 0.25, 0.75).alias("q"))
    width, s = F.col("q")[1] - F.col("q")[0], F.col("smape")
    out = f.join(e, "model").groupBy("model").agg(F.first("cv").alias("cv"), hits((s < F.col("q")[0] - 1.5 * width) | (s > F.col("q")[1] + 1.5 * width)).alias("outlier_folds"))
    return out.select("model", "cv", F.when(F.col("cv") < 0.1, "stable").when(F.col("cv") < 0.2, "moderate").otherwise("unstable").alias("level"), "outlier_folds")


LI = "SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax FROM lineitem"


def numeric(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"))


ONE = ("quantity", "discount", "tax")
_Z = ("1", *ONE)
#: Sums over rows from which every least-squares baseline follows: s_x_y of all pairs, and of each with y.
SUMS = {f"s_{_Z[i]}_{_Z[j]}": f"{_Z[i]} * {_Z[j]}" for i in range(4) for j in range(i, 4)} | {f"t_{x}": f"{x} * y" for x in _Z} | {"t_yy": "y * y"}


def _cov(a: str, b: str) -> str:
    i, j = sorted((a, b), key=_Z.index)
    return f"(s_{i}_{j} - s_1_{a} * s_1_{b} / s_1_1)"


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _slopes() -> dict[str, str]:
    """SQL expressions over SUMS: slope of each single regression, and of each input in the regression on all (Cramer)."""
    out = {f"b_{x}": f"(t_{x} - s_1_{x} * t_1 / s_1_1) / {_cov(x, x)}" for x in ONE}
    matrix = [[_cov(x, z) for z in ONE] for x in ONE]
    right = [f"(t_{x} - s_1_{x} * t_1 / s_1_1)" for x in ONE]
    for k, x in enumerate(ONE):
        swapped = [[right[r] if c == k else matrix[r][c] for c in range(3)] for r in range(3)]
        out[f"o_{x}"] = f"{_det(swapped)} / {_det(matrix)}"
    return out


_mean = "(t_1 / s_1_1)"
GUESSES = {"mean": _mean, "median": "median", **{x: f"{_mean} + b_{x} * ({x} - s_1_{x} / s_1_1)" for x in ONE}, "ols": f"{_mean} + " + " + ".join(f"o_{x} * ({x} - s_1_{x} / s_1_1)" for x in ONE)}
LIF = LI.replace("SELECT ", "SELECT l_orderkey % 5 AS fold, ", 1)
_MEASURES = "avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y) / ((abs(p) + abs(y)) / 2)) * 100 AS smape, 1 - sum((p - y) * (p - y)) / (count(y) * var_pop(y)) AS r2"


@query(
    "baselines",
    f"""WITH l AS ({LIF}), a AS (SELECT fold, {', '.join(f'sum({e}) AS {k}' for k, e in SUMS.items())} FROM l GROUP BY fold), g AS (SELECT -1 AS g UNION ALL SELECT fold FROM a),
    s AS (SELECT g, {', '.join(f'sum({k}) AS {k}' for k in SUMS)} FROM g JOIN a ON a.fold <> g.g GROUP BY g), m AS (SELECT g, quantile_cont(y, 0.5) AS median FROM g JOIN l ON l.fold <> g.g GROUP BY g), c AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _slopes().items())} FROM s JOIN m USING (g)),
    e AS (SELECT g, y, unnest([{', '.join(f"'{k}'" for k in GUESSES)}]) AS k, unnest([{', '.join(GUESSES.values())}]) AS p FROM l JOIN c ON c.g = -1 OR c.g = l.fold), f AS (SELECT k, g, {_MEASURES} FROM e GROUP BY k, g)
    SELECT k AS baseline, max(mae) FILTER (g = -1) AS mae, max(rmse) FILTER (g = -1) AS rmse, max(smape) FILTER (g = -1) AS smape, max(r2) FILTER (g = -1) AS r2, avg(smape) FILTER (g >= 0) AS cv_smape, avg(r2) FILTER (g >= 0) AS cv_r2 FROM f GROUP BY k""",
    "mae rmse smape r2 cv_smape cv_r2", 3,
)
def baselines(spark, d):
    """Mean, median, one-input and all-input least squares, on all rows and over five folds. Rows are read for the sums of
    each fold (a few numbers), for the medians and for the errors; the fits themselves are arithmetic on the sums."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"))
    fold_sums = li.groupBy("fold").agg(*(F.sum(F.expr(f"double({e})")).alias(k) for k, e in SUMS.items()))
    g = fold_sums.select(F.col("fold").alias("g")).union(spark.sql("SELECT -1L"))
    s = g.join(F.broadcast(fold_sums), F.col("fold") != F.col("g")).groupBy("g").agg(*(F.sum(k).alias(k) for k in SUMS))  # six rows of five
    others = li.select("y", F.explode(F.array(F.lit(-1).cast("long"), *(F.when(F.col("fold") != k, F.lit(k).cast("long")) for k in range(5)))).alias("g")).filter("g is not null")
    c = s.join(percentiles(others, "y", (0.5,), "q", ("g",)).select("g", F.col("q")[0].alias("median")), "g").withColumns({k: F.expr(e) for k, e in _slopes().items()})
    guesses = F.array(*(F.struct(F.lit(k).alias("k"), F.expr(e).alias("p")) for k, e in GUESSES.items()))
    e = li.join(F.broadcast(c), (F.col("g") == -1) | (F.col("g") == F.col("fold"))).select("g", "y", F.explode(guesses).alias("e")).select("g", "y", "e.*")
    y, p = F.col("y"), F.col("p")
    m = metrics.regression(y, p)
    f = e.groupBy("k", "g").agg(m["mae"].alias("mae"), m["rmse"].alias("rmse"), metrics.smape(y, p).alias("smape"), m["r2"].alias("r2"))
    whole = lambda x: F.max(F.when(F.col("g") == -1, F.col(x))).alias(x)
    folds = lambda x: F.avg(F.when(F.col("g") >= 0, F.col(x))).alias(f"cv_{x}")
    return f.groupBy(F.col("k").alias("baseline")).agg(*(whole(x) for x in ("mae", "rmse", "smape", "r2")), folds("smape"), folds("r2"))


@query("correlation_pairs", f"WITH l AS ({LI}), p AS (SELECT unnest(['y', 'y', 'y', 'quantity', 'quantity', 'discount']) AS a, unnest(['quantity', 'discount', 'tax', 'discount', 'tax', 'tax']) AS b, unnest([corr(y, quantity), corr(y, discount), corr(y, tax), corr(quantity, discount), corr(quantity, tax), corr(discount, tax)]) AS r FROM l) SELECT a, b, r, abs(r) > 0.95 AS drop_second FROM p", "r")
def correlation_pairs(spark, d):
    names = ["y", "quantity", "discount", "tax"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = numeric(spark, d).agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs)).alias("p"))
    return row.select(F.inline("p")).withColumn("drop_second", F.abs("r") > 0.95)


@query(
    "histograms",
    "WITH v AS (SELECT model, unnest(['actual', 'predicted', 'residual']) AS series, unnest([y_true, y_pred, y_pred - y_true]) AS v FROM predictions), e AS (SELECT model, series, min(v) AS lo, max(v) AS hi FROM v GROUP BY ALL), t AS (SELECT model, regr_slope(y_pred, y_true) AS trend, regr_slope(abs(y_pred - y_true), y_pred) AS spread FROM predictions GROUP BY model) SELECT model, series, CAST(least(floor((v - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n, min(v) AS least, max(v) AS most, any_value(CASE WHEN series = 'residual' THEN spread ELSE trend END) AS slope FROM v JOIN e USING (model, series) JOIN t USING (model) GROUP BY 1, 2, 3",
    "least most slope",
)
def histograms(spark, d):
    """Fifty equal bins of actual and predicted values and of residuals, by model; slope of the trend line (predicted over
    actual; size of residuals over predicted)."""
    p = predictions(spark, d)
    y, q = F.col("y_true"), F.col("y_pred")
    v = p.select("model", F.explode(F.array(*(F.struct(F.lit(k).alias("series"), c.alias("v")) for k, c in (("actual", y), ("predicted", q), ("residual", q - y))))).alias("x")).select("model", "x.*")
    edges = v.groupBy("model", "series").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    trend = p.groupBy("model").agg(F.regr_slope("y_pred", "y_true").alias("trend"), F.regr_slope(F.abs(q - y), q).alias("spread"))
    sides = edges.join(trend, "model").withColumn("slope", F.when(F.col("series") == "residual", F.col("spread")).otherwise(F.col("trend")))  # three rows a model
    place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50), F.lit(49)).cast("long")
    return v.join(F.broadcast(sides), ["model", "series"]).groupBy("model", "series", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("slope").alias("slope"))


@query("timing_summary", "SELECT event_type AS operation, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most, avg(value) > 100 AS over_limit FROM events GROUP BY event_type", "total mean least most", 4)
def timing_summary(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), (F.avg(v) > 100).alias("over_limit"))


@query("perf_regression", "WITH h AS (SELECT quantile_cont(event_id, 0.5) AS m FROM events), a AS (SELECT event_type, avg(value) FILTER (event_id < m) AS base, avg(value) FILTER (event_id >= m) AS current FROM events, h GROUP BY event_type) SELECT event_type, base, current, 100.0 * (current - base) / base AS change, 100.0 * (current - base) / base > 10 AS regression FROM a", "base current change")
def perf_regression(spark, d):
    e = table(spark, d, "events")
    h = percentiles(e, "event_id", (0.5,), "q").select(F.col("q")[0].alias("m"))
    first = F.col("event_id") < F.col("m")
    a = e.join(F.broadcast(h), F.lit(True)).groupBy("event_type").agg(F.avg(F.when(first, F.col("value"))).alias("base"), F.avg(F.when(~first, F.col("value"))).alias("current"))
    change = 100.0 * (F.col("current") - F.col("base")) / F.col("base")
    return a.select("event_type", "base", "current", change.alias("change"), (change > 10).alias("regression"))


NAMES = "SELECT p_partkey AS id, concat(lower(p_name), ' ', CASE p_partkey % 5 WHEN 0 THEN 'MIT License' WHEN 1 THEN 'Apache 2.0' WHEN 2 THEN 'LGPL-2.1' WHEN 3 THEN 'Proprietary' ELSE 'unknown terms' END) AS name FROM part"
_RULED = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {lit(w)}, {lit(s)})" for i, (w, s) in enumerate(rules.LICENSE_RULES)) + ") AS t(ord, word, status))"


def ruled_names(spark, d):
    """Each name with the first rule whose word it holds; the rules are a short fixed list, tried in order on the row."""
    names = spark.sql(NAMES.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    rule = F.coalesce(*(F.when(F.contains(F.lower("name"), F.lit(w)), F.struct(F.lit(s).alias("status"), F.lit(w).alias("rule"))) for w, s in rules.LICENSE_RULES))
    return names.select("id", rule.alias("r")).select("id", F.coalesce("r.status", F.lit("manual_review")).alias("status"), "r.rule")


@query("rule_match", f"WITH n AS ({NAMES}), {_RULED} SELECT id, coalesce(arg_min(status, ord), 'manual_review') AS status, arg_min(word, ord) AS rule FROM n LEFT JOIN r ON contains(lower(name), word) GROUP BY id")
def rule_match(spark, d):
    return ruled_names(spark, d)


PATHS = "SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'dataset/train.csv' WHEN 1 THEN concat('cache/', p_name, '.parquet') WHEN 2 THEN concat('other/Web_Data/', p_name) WHEN 3 THEN concat('other/additional_data_', CAST(p_partkey AS STRING)) WHEN 4 THEN concat('tests/', p_name) WHEN 5 THEN concat('tests/external_', p_name) WHEN 6 THEN 'external/x.csv' WHEN 7 THEN concat('images/', CAST(p_partkey AS STRING), '.jpg') WHEN 8 THEN p_name WHEN 9 THEN 'dataset' ELSE concat('data', chr(92), 'crawled.json') END AS path FROM part"
_slashed = "replace(path, chr(92), '/')"
_first, _last = f"split_part({_slashed}, '/', 1)", f"lower(regexp_extract({_slashed}, '[^/]*$'))"
_path_tests = {"path": lambda x: f"{_slashed} = {lit(x)}", "folder": lambda x: f"{_first} = {lit(x)}", "anywhere": lambda x: f"contains(lower({_slashed}), {lit(x)})", "name": lambda x: f"contains({_last}, {lit(x)})"}


@query("rule_match_paths", f"WITH n AS ({PATHS}) SELECT id, path, CASE {' '.join(f'WHEN {_path_tests[k](x)} THEN {lit(s)}' for k, x, s in rules.PATH_RULES)} ELSE 'manual_review' END AS status, CASE {' '.join(f'WHEN {_path_tests[k](x)} THEN {lit(x)}' for k, x, s in rules.PATH_RULES)} END AS rule FROM n")
def rule_match_paths(spark, d):
    """Paths of data files by the first rule that holds: known files, folders, forbidden and suspicious names, code."""
    paths = spark.sql(PATHS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    slashed = F.replace("path", F.lit("\\"), F.lit("/"))
    tests = {"path": lambda x: slashed == x, "folder": lambda x: F.split(slashed, "/")[0] == x, "anywhere": lambda x: F.contains(F.lower(slashed), F.lit(x)), "name": lambda x: F.contains(F.lower(F.element_at(F.split(slashed, "/", -1), -1)), F.lit(x))}
    rule = F.coalesce(*(F.when(tests[k](x), F.struct(F.lit(s).alias("status"), F.lit(x).alias("rule"))) for k, x, s in rules.PATH_RULES))
    return paths.select("id", "path", rule.alias("r")).select("id", "path", F.coalesce("r.status", F.lit("manual_review")).alias("status"), "r.rule")


PROGRAMS = "SELECT p_partkey AS id, concat('import x', chr(10), CASE p_partkey % 7 WHEN 0 THEN 'r = Requests.get(url)' WHEN 1 THEN concat('df = pd.read_csv(', chr(39), 'My_External.csv', chr(39), ')') WHEN 2 THEN 'load_all(external, data); open(external)' WHEN 3 THEN 'crawl_and_scrape(api_key)' WHEN 4 THEN concat('load', chr(10), 'external data') ELSE p_name END, chr(10), p_type) AS body FROM part"
_CODE = [("external_pattern", w) for w in rules.CODE_WORDS] + [("data_pattern", w) for w in rules.CODE_PATTERNS]
_code_tests = {"external_pattern": lambda w: f"contains(lower(body), {lit(w)})", "data_pattern": lambda w: f"regexp_matches(body, {lit(w)}, 'i')"}
_code_sql = ", ".join(f"CASE WHEN {_code_tests[k](w)} THEN {lit(k + ': ' + w)} END" for k, w in _CODE)


@query("rule_match_code", f"SELECT id, unnest(list_filter([{_code_sql}], lambda x: x IS NOT NULL)) AS found FROM ({PROGRAMS})")
def rule_match_code(spark, d):
    """What in a program text hints at data from elsewhere: a row for each rule that a text meets."""
    body = F.col("body")
    programs = spark.sql(PROGRAMS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    hits = (F.when(F.contains(F.lower(body), F.lit(w)) if k == "external_pattern" else body.rlike(f"(?i){w}"), F.lit(f"{k}: {w}")) for k, w in _CODE)
    return programs.select("id", F.explode(F.array_compact(F.array(*hits))).alias("found"))


@query("compliance_rollup", f"WITH n AS ({NAMES}), {_RULED}, m AS (SELECT id, coalesce(arg_min(status, ord), 'manual_review') AS status FROM n LEFT JOIN r ON contains(lower(name), word) GROUP BY id) SELECT status, count(*) AS n, CASE WHEN status = 'allowed' THEN 'COMPLIANT' ELSE 'REQUIRES_REVIEW' END AS verdict, status = 'restricted' AS blocking FROM m GROUP BY status")
def compliance_rollup(spark, d):
    c = ruled_names(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    return c.select("status", "n", F.when(F.col("status") == "allowed", "COMPLIANT").otherwise("REQUIRES_REVIEW").alias("verdict"), (F.col("status") == "restricted").alias("blocking"))


