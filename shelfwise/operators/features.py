"""Feature scaling, fusion, selection and reduction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import picture
from shelfwise.operators.percentiles import percentiles_of

#: Vectorisers of this Python worker, by what loads them.
_LOADED: dict = {}


def scaling(df: DataFrame, columns: list[str], how: str) -> tuple[DataFrame, dict]:
    """Fit a scaling on ``df``: one row of centre and width per column, to be joined (broadcast) to whatever is scaled."""
    if how not in ("standard", "minmax"):
        quartiles = percentiles_of(df, columns, (0.25, 0.5, 0.75), "q_")
        return quartiles.select(*(x for c in columns for x in (F.col(f"q_{c}")[1].alias(f"{c}_0"), (F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]).alias(f"{c}_1")))), {c: (f"{c}_0", f"{c}_1") for c in columns}
    fits = []
    for c in columns:
        if how == "standard":
            fits += [F.avg(c).alias(f"{c}_0"), F.stddev_pop(c).alias(f"{c}_1")]
        else:
            fits += [F.min(c).alias(f"{c}_0"), (F.max(c) - F.min(c)).alias(f"{c}_1")]
    return df.agg(*fits), {c: (f"{c}_0", f"{c}_1") for c in columns}


def apply_scaling(df: DataFrame, fit: DataFrame, names: dict) -> DataFrame:
    joined = df.join(F.broadcast(fit), F.lit(True))  # one row
    scaled = {c: (F.col(c) - F.col(a)) / F.when(F.col(b) == 0, 1.0).otherwise(F.col(b)) for c, (a, b) in names.items()}
    return joined.withColumns(scaled).drop(*(x for pair in names.values() for x in pair))


def impute(df: DataFrame, column: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A vector column with null, NaN and infinite components filled with 0, filled with the mean of the component over all
    rows, and with such rows dropped. Means are one row; a component without any value becomes 0."""
    known = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    clean = df.withColumn(column, F.transform(column, known))
    means = df.agg(F.array(*(F.coalesce(F.avg(known(F.col(column)[i])), F.lit(0.0)) for i in range(size))).alias("_means"))
    zero = clean.withColumn(column, F.transform(column, lambda x: F.coalesce(x, F.lit(0.0))))
    mean = clean.join(F.broadcast(means), F.lit(True)).withColumn(column, F.transform(column, lambda x, i: F.coalesce(x, F.get("_means", i)))).drop("_means")
    return zero, mean, clean.filter(~F.exists(column, lambda x: x.isNull()))


def fuse_weighted(a: Column, b: Column, wa: float, wb: float) -> Column:
    """Weighted sum of two arrays; weights are normalised, the shorter array is filled with zeros."""
    x = F.zip_with(a, b, lambda p, q: F.coalesce(p, F.lit(0.0)) * (wa / (wa + wb)) + F.coalesce(q, F.lit(0.0)) * (wb / (wa + wb)))
    return x


def f_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, score: F of a simple regression, r^2 / (1 - r^2) * (n - 2)."""
    r = df.agg(F.count("*").alias("n"), *(F.corr(c, target).alias(c) for c in columns)).unpivot(["n"], columns, "feature", "r")
    return r.select("feature", (F.col("r") * F.col("r") / (1 - F.col("r") * F.col("r")) * (F.col("n") - 2)).alias("score"))


def binned_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """feature, score: mutual information of percentile bins of each column and of the target."""
    cuts = [i / bins for i in range(1, bins)]
    edges = percentiles_of(df, [*columns, target], cuts, "e_")
    binned = df.join(F.broadcast(edges), F.lit(True))
    place = lambda c: F.size(F.filter(f"e_{c}", lambda e: F.col(c) >= e))
    pairs = binned.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), place(c).alias("x")) for c in columns))).alias("f"), place(target).alias("y"))
    joint = pairs.groupBy("f.feature", "f.x", "y").agg(F.count("*").alias("n"))  # at most columns * bins^2 rows
    px = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    j = joint.join(px, ["feature", "x"]).join(py, ["feature", "y"]).join(total, "feature")
    p = F.col("n") / F.col("t")
    return j.groupBy("feature").agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("score"))


def reduce(df: DataFrame, column: str, k: int) -> tuple[DataFrame, list[float]]:
    """Principal components of a centred vector column as ``reduced``, and their shares of the variance; a vector of at
    most k values passes as it is."""
    size = len(df.select(column).first()[0])
    if size <= k:
        return df.withColumn("reduced", F.col(column)), [1.0 / size] * size
    centred = StandardScaler(withMean=True, withStd=False, inputCol=column, outputCol="centred").fit(df).transform(df)
    model = PCA(k=k, inputCol="centred", outputCol="reduced").fit(centred)
    return model.transform(centred).drop("centred"), model.explainedVariance.toArray().tolist()


def tfidf_svd(df: DataFrame, text: str, k: int, vocabulary: int = 1000) -> DataFrame:
    """Rank-k text vectors: TF-IDF of words and pairs (document frequency 2 or more), projected on the leading right
    singular vectors, which come from the vocabulary-sized Gram matrix."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    words = RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}_]+").transform(df.fillna({text: ""}))
    kept = StopWordsRemover(inputCol="words", outputCol="kept").transform(words)
    terms = NGram(n=2, inputCol="kept", outputCol="pairs").transform(kept).withColumn("terms", F.concat("kept", "pairs"))
    counted = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary, minDF=2.0).fit(terms).transform(terms)
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(weighted.select("tfidf"), "tfidf")).computeGramianMatrix().toArray()  # vocabulary x vocabulary, whatever the rows
    right = np.linalg.eigh(gram)[1][:, ::-1][:, :k]
    project = df.sparkSession.sparkContext.broadcast(right)

    @F.pandas_udf("array<double>")
    def onto(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.tolist()) @ project.value)) if len(v) else pd.Series([], dtype=object)

    return weighted.withColumn("text_vector", onto(vector_to_array("tfidf"))).drop("words", "kept", "pairs", "terms", "tf", "tfidf")


def encode_words(df: DataFrame, vocabulary: list[str], length: int) -> DataFrame:
    """(doc_id, ws: words, at most ``length``) -> doc_id, ids: place in the vocabulary from 2, 0 for other words, filled up
    with 1. The vocabulary has a fixed size and is broadcast; words are looked up a batch at a time."""
    known = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.array(known.value, pa.string())
        for batch in batches:
            words = batch.column(1)
            size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.ones((len(words), length), np.int32)
            ids[np.arange(length)[None] < size[:, None]] = pc.fill_null(pc.add(pc.index_in(words.flatten(), table), 2), 0).to_numpy(zero_copy_only=False)
            flat = pa.array(ids.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * length, pa.int32()), flat)], names=["doc_id", "ids"])

    return df.mapInArrow(run, "doc_id long, ids array<int>")


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="error").transform(df)


def as_vector(column: str) -> Column:
    return array_to_vector(F.col(column))


def vectorised(df: DataFrame, text: str, load, column: str) -> DataFrame:
    """``df`` with the mean of the token vectors of ``text`` in ``column``.

    ``load()`` gives the vectoriser (``dims`` and ``encode(texts)``, a matrix of tokens x dims for each). It runs once in a
    Python worker, which keeps it for all its tasks, and texts go to it a batch at a time. A text without tokens, or null, has
    zeros."""
    @F.arrow_udf("array<double>")
    def pooled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from shelfwise.operators.features import _LOADED  # the worker's own, not a copy that came with this function

        if load not in _LOADED:
            _LOADED[load] = load()
        made = _LOADED[load]
        for batch in batches:
            found = np.zeros((len(batch), made.dims))
            for i, tokens in enumerate(made.encode(["" if t is None else t for t in batch.to_pylist()])):
                if len(tokens):
                    found[i] = tokens.mean(axis=0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * made.dims, pa.int32()), pa.array(found.ravel()))

    return df.withColumn(column, pooled(F.col(text)))


def image_features(images: DataFrame) -> DataFrame:
    """(sample_id, height, width, channels, data BGR bytes) -> colour histogram (3 x 64), dominant colours (5 x 3, by number
    of pixels), texture (contrast, dissimilarity, homogeneity, energy, correlation of neighbouring grey levels) and Sobel
    edges (mean, spread, share of strong ones)."""

    def run(batches):
        for batch in batches:
            out = []
            for h, w, c, raw in zip(*(batch.column(j).to_pylist() for j in range(1, 5)), strict=True):
                x = np.frombuffer(raw, np.uint8).reshape(h, w, c)
                rgb = np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]
                level = picture.grey(rgb)
                out.append((picture.histogram(rgb), picture.dominant_colors(rgb).ravel(), picture.texture(level), picture.edges(level)))
            lists = [pa.array([list(o[j]) for o in out], pa.list_(pa.float64())) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["sample_id", "histogram", "colors", "texture", "edges"])

    return images.select("sample_id", "height", "width", "channels", "data").mapInArrow(run, "sample_id string, histogram array<double>, colors array<double>, texture array<double>, edges array<double>")
