"""All registered queries over the catalog tables."""

from pyspark.sql import functions as F

from shelfwise.functions import clean, extract
from shelfwise.operators import metrics
from shelfwise.plans import cleaning, extraction, modeling, quality, ranking  # noqa: F401
from shelfwise.plans.cleaning import price_sql
from shelfwise.plans.extraction import INPUTS_SQL
from shelfwise.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from shelfwise.sources.tables import products

_FLAGSHIP = f"""
WITH p AS (SELECT sample_id, {price_sql('price_text')} AS price FROM products), z AS (SELECT sample_id, CASE WHEN price = 0 THEN 0.01 ELSE price END AS y FROM p WHERE price IS NOT NULL AND price >= 0),
f AS (SELECT sample_id, y, x.category AS category, x.pack_qty AS pack_qty FROM z JOIN ({INPUTS_SQL}) x USING (sample_id)), g AS (SELECT category, pack_qty, avg(y) AS guess FROM f GROUP BY category, pack_qty),
e AS (SELECT quantile_cont(y, 0.2) AS e1, quantile_cont(y, 0.4) AS e2, quantile_cont(y, 0.6) AS e3, quantile_cont(y, 0.8) AS e4 FROM f)
SELECT 1 + CAST(y >= e1 AS INT) + CAST(y >= e2 AS INT) + CAST(y >= e3 AS INT) + CAST(y >= e4 AS INT) AS bucket, count(*) AS n, avg(abs(guess - y) / ((abs(guess) + abs(y)) / 2)) * 100 AS smape FROM f JOIN g USING (category, pack_qty), e GROUP BY 1
"""


@query("flagship", _FLAGSHIP, "smape")
def flagship(spark, sf_dir):
    """Clean prices, model inputs, a mean price by category and pack size, and its SMAPE by price quantile."""
    price = clean.price_from_text(F.col("price_text"))
    x = extract.model_inputs(F.col("catalog_content"))
    rows = products(spark, sf_dir).select("sample_id", price.alias("p"), x["category"].alias("category"), x["pack_qty"].alias("pack_qty")).filter("p >= 0")
    rows = rows.withColumn("y", F.when(F.col("p") == 0, 0.01).otherwise(F.col("p")))
    # every row has a guess, so the edges are those of the prices alone, which need no model inputs
    priced = products(spark, sf_dir).select(price.alias("p")).filter("p >= 0").select(F.when(F.col("p") == 0, 0.01).otherwise(F.col("p")).alias("y"))
    guess = rows.groupBy("category", "pack_qty").agg(F.avg("y").alias("guess"))
    scored = metrics.with_quantile_bucket(rows.join(guess, ["category", "pack_qty"]), "y", 5, priced)
    return scored.groupBy("bucket").agg(F.count("*").alias("n"), metrics.smape(F.col("y"), F.col("guess")).alias("smape"))
