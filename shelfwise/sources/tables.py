"""Catalog-shaped inputs: schemas, table readers, and the product views derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_SCHEMA = "sample_id string, catalog_content string, image_link string, price string, _corrupt_record string"

PRODUCTS = """
SELECT CAST(p_partkey AS STRING) AS sample_id,
  concat('Item Name: ', p_name, ' ', lower(p_type), ', ', CAST(p_size AS STRING), ' ',
    CASE p_partkey % 6 WHEN 0 THEN 'oz' WHEN 1 THEN 'ml' WHEN 2 THEN 'grams' WHEN 3 THEN 'kg' WHEN 4 THEN 'count' ELSE 'fl oz' END,
    CASE WHEN p_partkey % 3 = 0 THEN concat(' (Pack of ', CAST(p_partkey % 12 + 1 AS STRING), ')') ELSE '' END,
    CASE WHEN p_partkey % 10 = 1 THEN concat(chr(10), 'Bullet Point 1: Apple steel case, 10cm x 5cm x 2cm', chr(10), 'Bullet Point 2: Weight: 500g') ELSE '' END,
    chr(10), 'Value: ', CAST(p_size AS STRING), '.0', chr(10), 'Unit: ',
    CASE p_partkey % 6 WHEN 0 THEN 'Oz' WHEN 1 THEN 'Milliliter' WHEN 2 THEN 'Gram' WHEN 3 THEN 'Kilogram' WHEN 4 THEN 'Count' ELSE 'Fl Oz' END) AS catalog_content,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('https://img.example.com/i/', CAST(p_partkey % 900 AS STRING), '.jpg') END AS image_link,
  CASE WHEN p_partkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice / CAST(p_partkey % 50 + 1 AS DOUBLE) END AS price,
  CASE p_partkey % 9
    WHEN 0 THEN concat('$', CAST(p_size AS STRING), '.99')
    WHEN 1 THEN concat('$1,', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), '.50')
    WHEN 2 THEN concat('EUR ', CAST(p_size AS STRING))
    WHEN 3 THEN concat('1 ', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), '.25')
    WHEN 4 THEN 'invalid' WHEN 5 THEN '' WHEN 6 THEN '0'
    WHEN 7 THEN concat('-', CAST(p_size AS STRING), '.00')
    ELSE concat('1,', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), ',500') END AS price_text,
  p_partkey % 5 AS fold
FROM part
"""
PREDICTIONS = """
SELECT p.sample_id, m.model, p.price AS y_true,
  p.price * (CAST(1 AS DOUBLE) + CAST((CAST(p.sample_id AS BIGINT) * 7 + m.k * 13) % 41 - 20 AS DOUBLE) / CAST(100 AS DOUBLE)) AS y_pred, p.fold
FROM products p CROSS JOIN (SELECT 'm1' AS model, 1 AS k UNION ALL SELECT 'm2', 2 UNION ALL SELECT 'm3', 3) m
"""
SUBMISSION = """
SELECT sample_id, CASE WHEN CAST(sample_id AS BIGINT) % 211 = 0 THEN CAST(-1 AS DOUBLE) ELSE y_pred END AS price
FROM predictions WHERE model = 'm1' AND CAST(sample_id AS BIGINT) % 101 <> 0
UNION ALL SELECT sample_id, y_pred FROM predictions WHERE model = 'm1' AND CAST(sample_id AS BIGINT) % 500 = 3
UNION ALL SELECT concat('x', sample_id), y_pred FROM predictions WHERE model = 'm1' AND CAST(sample_id AS BIGINT) % 700 = 9
"""
DOWNLOADS = """
SELECT sample_id, image_link, md5(image_link) AS url_hash,
  CASE WHEN CAST(sample_id AS BIGINT) % 5 = 0 THEN 'train' ELSE 'test' END AS dataset_type,
  CASE WHEN CAST(sample_id AS BIGINT) % 8 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN CAST(sample_id AS BIGINT) % 16 = 0 THEN 'Timeout' WHEN CAST(sample_id AS BIGINT) % 8 = 0 THEN 'http_404' END AS error,
  CAST(sample_id AS BIGINT) % 4 + 1 AS attempts, CAST(sample_id AS BIGINT) % 50 * 1000 AS file_size
FROM products WHERE image_link IS NOT NULL
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    return spark.sql(PRODUCTS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part") if part is None else part)


#: Rows of a task where a row costs much.
ROWS_A_TASK = 50_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def spread_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``products`` over all cores, as a table of few files or row groups is read by few tasks. The number of tasks grows with
    the rows; what is dealt out are the narrow rows of ``part``."""
    part = table(spark, sf_dir, "part")
    return products(spark, sf_dir, part.repartition(tasks_for(spark, part.count()), "p_partkey"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREDICTIONS.replace("FROM products", "FROM {products}"), products=products(spark, sf_dir))


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SUBMISSION.replace("FROM predictions", "FROM {predictions}"), predictions=predictions(spark, sf_dir))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOWNLOADS.replace("FROM products", "FROM {products}"), products=products(spark, sf_dir))


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("image_vector"))


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Train or test CSV: quoted text may hold newlines; price stays text; rows that cannot be parsed keep their raw text
    in ``_corrupt_record``. An empty file or one without the id column is an error."""
    header = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    if not header:
        raise ValueError(f"{path} is empty")
    if missing := [c for c in ("sample_id", "catalog_content", "image_link") if c not in header]:
        raise ValueError(f"{path} lacks columns {missing}")
    schema = ", ".join(f"`{c}` string" for c in [*header, "_corrupt_record"])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
