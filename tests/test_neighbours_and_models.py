"""Exact neighbours, weights on the simplex, one model from text to price, vectoriser, streams by arrival."""

import itertools

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from shelfwise.operators import features, models, neighbours, stages
from shelfwise.plans.modeling import HashedTokens
from shelfwise.streaming import streams


def near(spark, queries, known, k, report=None):
    schema = "id long, v array<double>"
    out = neighbours.knn_join(spark.createDataFrame(queries, schema).repartition(3), spark.createDataFrame(known, schema).repartition(4), "id", "v", k, report)
    return sorted((r.id, r["rank"], r.neighbour, r.distance) for r in out.collect())


def plain(queries, known, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    known = [(i, np.array(v)) for i, v in known if i is not None and ok(v)]
    out = []
    for q, v in queries:
        if q is not None and ok(v):
            best = sorted((float(((x - np.array(v)) ** 2).sum()), i) for i, x in known)[:k]
            out += [(q, r, i, d**0.5) for r, (d, i) in enumerate(best, 1)]
    return sorted(out)


def same(got, want):
    return [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def points(rng, n, kind):
    if kind == "clusters":
        return rng.normal(size=(12, 6))[rng.integers(0, 12, n)] * 20 + rng.normal(size=(n, 6))
    if kind == "grid":  # many ties
        return rng.integers(0, 4, (n, 3)).astype(float)
    if kind == "wide":  # coordinates of very different size
        return rng.normal(size=(n, 4)) * [1, 1e4, 1e-3, 1e6]
    x = rng.normal(size=(n, 5))
    x[rng.permutation(n)[: n // 3]] = x[0]  # a third of equal rows
    return x


@pytest.mark.parametrize("kind", ["clusters", "grid", "wide", "equal"])
def test_knn_is_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "CHUNK", 30)
    rng = np.random.default_rng(3)
    x = points(rng, 700, kind)
    known = [(i * 2, v.tolist()) for i, v in enumerate(x)]
    queries = known[::5] + [(9001 + i, v.tolist()) for i, v in enumerate(points(rng, 60, kind))]
    report = {}
    assert same(near(spark, queries, known, 6, report), plain(queries, known, 6))
    if kind == "clusters":
        assert report["compared"] < len(queries) * len(known) / 4


def test_knn_on_odd_rows(spark):
    known = [(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (None, [0.0, 1.0]), (5, [0.0, 3.0])]
    assert same(near(spark, known, known, 4), plain(known, known, 4))
    assert near(spark, known, [], 4) == [] and near(spark, [], known, 4) == []
    assert same(near(spark, known, known[:1], 4), plain(known, known[:1], 4))


def test_compared_rows_grow_slower_than_the_table(spark):
    rng = np.random.default_rng(8)
    centres, shares = rng.normal(size=(400, 8)) * 30, []
    for n in (2000, 8000):
        x = centres[rng.integers(0, 400, n)] + rng.normal(size=(n, 8))
        rows, report = [(i, v.tolist()) for i, v in enumerate(x)], {}
        near(spark, rows[::50], rows, 5, report)
        shares.append(report["compared"] / (n / 50) / n)
    assert shares[1] < 0.7 * shares[0] < 0.2


def test_density(spark):
    rows = [(i, float(i % 3), float(i // 3)) for i in range(40)]
    got = {r.id: r.density for r in neighbours.density(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"]).collect()}
    x = np.array([r[1:] for r in rows])
    for i in range(40):
        assert got[i] == pytest.approx(1 / (1 + np.sort(np.sqrt(((x - x[i]) ** 2).sum(axis=1)))[:5].mean()))


def smape(y, q):
    return 200 * np.mean(np.abs(q - y) / (np.abs(q) + np.abs(y)))


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_weights_are_never_worse_than_the_grid(spark, n):
    rng = np.random.default_rng(n)
    y = np.exp(rng.normal(2, 1, 400))
    p = y[:, None] * np.exp(rng.normal(0, 0.3, (400, n)) + rng.normal(0, 0.2, n))
    rows = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, p, strict=True)], "y double, p array<double>").repartition(3)
    w, found = models.best_weights(rows, n)
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and found == pytest.approx(smape(y, p @ w))
    grid = [np.diff([-1, *c, 10 + n - 1]) - 1 for c in itertools.combinations(range(10 + n - 1), n - 1)]
    assert found <= min(smape(y, p @ (np.array(g) / 10)) for g in grid) + 1e-9
    for _ in range(300):  # nor than points around
        assert found <= smape(y, p @ models.onto_simplex(w + rng.normal(0, 0.01, n))) + 2e-3


def catalog(spark, n=600):
    text = F.concat(F.lit("Item Name: thing "), F.col("id") % 7, F.lit("\nValue: "), F.col("id") % 50, F.lit(".0\nUnit: Oz"))
    return spark.range(n).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 5).alias("fold"), F.when(F.col("id") % 97 != 0, text).alias("catalog_content"), F.exp((F.col("id") % 50) / 20.0).alias("price"))


def test_one_model_from_text_to_price(spark, tmp_path):
    made = catalog(spark)
    makers = {"ridge": models.ridge(0.1), "forest": models.regressors(6, 4)["forest"]}
    model, report = stages.train(made.filter("catalog_content is not null"), makers, 3)
    scores = {r.model: r for r in report.collect()}
    assert set(scores) == {"ridge", "forest", "blend"} and scores["ridge"].weight + scores["forest"].weight == pytest.approx(1)
    assert all(r.rows == 593 for r in scores.values()) and scores["blend"].smape < 25
    model.write().save(f"file://{tmp_path}/model")
    loaded = PipelineModel.load(f"file://{tmp_path}/model")
    # odd rows: no text, an empty one, columns of the same names as features
    odd = made.union(spark.createDataFrame([("x", 0, "", 1.0), ("y", 0, "\n \t日本", 1.0)], made.schema)).withColumn("value", F.lit("other")).withColumn("features", F.lit("other"))
    before, after = ({r.sample_id: r.y_pred for r in stages.score(m, odd).collect()} for m in (model, loaded))
    assert before == after and len(after) == 602 and all(v >= models.LEAST_PRICE for v in after.values())
    assert stages.score(loaded, odd.limit(0)).count() == 0
    made.select("sample_id", "catalog_content").repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("sample_id string, catalog_content string").parquet(f"file://{tmp_path}/in")
    scored = {r.sample_id: r.y_pred for r in streams.run_to_end(stages.score(loaded, stream), "append").collect()}
    assert scored == {k: v for k, v in after.items() if k not in "xy"}


def test_blend_leaves_out_what_is_no_number(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (float("nan"), 2.0), (None, None)], "a double, b double")
    got = [r.y_pred for r in stages.BlendedPrice(inputCols=["a", "b"], weights=[0.25, 0.75]).transform(rows).collect()]
    assert got == pytest.approx([0.25 * np.expm1(1) + 0.75 * np.expm1(2), np.expm1(2), 0.01])


class Counted(HashedTokens):
    made = 0

    def __init__(self):
        super().__init__()
        type(self).made += 1
        self.number = type(self).made

    def encode(self, texts):
        return [np.full((max(len(x), 1), self.dims), float(self.number)) for x in super().encode(texts)]


def test_vectoriser(spark):
    rows = [(i, None if i % 9 == 0 else "" if i % 9 == 1 else f"One two {i} two!") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    got = {r.id: r.v for r in features.vectorised(df, "text", HashedTokens, "v").collect()}
    one = HashedTokens()
    for i, t in rows:
        m = one.encode([t or ""])[0]
        assert got[i] == pytest.approx((m.mean(axis=0) if len(m) else np.zeros(16)).tolist())
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        again = features.vectorised(df.coalesce(1), "text", Counted, "v").select("v").collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    assert {x for r in again for x in r.v} == {1.0}  # loaded once for all batches


def test_arrivals_in_append_mode(spark):
    rows = [(f"2024-01-01 {h:02d}:10:00", "error", h) for h in range(12)] + [("2024-01-01 01:20:00", "error", 99), ("2024-01-01 11:20:00", "error", 98)]
    events = spark.createDataFrame(rows, "ts string, event_type string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    parts = streams.by_arrival(events, "ts", F.col("event_id") == 99)
    assert [p.count() for p in parts] == [4, 4, 6] and parts[2].filter("event_id = 99").count() == 1
    got = {r.hour.hour: r.failures for r in streams.run_arrivals(parts, streams.hourly_failures).collect()}
    # hour 1 without the late event; the watermark ends at 10:20, so hour 10 and 11 are still open
    assert got == {h: 1 for h in range(10)}
    assert streams.run_arrivals(streams.by_arrival(events.limit(0), "ts", F.lit(False)), streams.hourly_failures).count() == 0


# work that must not be done again for every fit


SF = "/root/testdata/sf0.001"


def counted(monkeypatch, owner, name):
    calls, real = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **k: (calls.append(a), real(*a, **k))[1])
    return calls


def test_rows_of_a_small_file_go_to_all_cores(spark):
    from shelfwise.plans import cleaning, extraction, modeling
    from shelfwise.sources import tables

    width = 2 * spark.sparkContext.defaultParallelism
    assert tables.tasks_for(spark, 10) == width and tables.tasks_for(spark, 7_200_000) == 144
    for query in (extraction.numeric_features, extraction.text_structure_padded, cleaning.product_attributes, modeling.predict_batch):
        assert query(spark, SF).rdd.getNumPartitions() == width
    assert sorted(tables.spread_products(spark, SF).collect()) == sorted(tables.products(spark, SF).collect())


def test_inputs_are_read_out_of_the_texts_once(spark):
    from shelfwise.plans import modeling
    from shelfwise.sources.tables import products

    rows = modeling.spread_rows(spark, SF)
    assert "regexp" not in rows._jdf.queryExecution().toString().lower()
    assert sorted(rows.collect()) == sorted(models.model_table(products(spark, SF)).collect())


def test_a_fold_is_prepared_once(spark, monkeypatch):
    from shelfwise.plans import modeling

    rows = modeling.spread_rows(spark, SF)
    want = {}
    for f in range(2):
        for name, r in (("one", models.ridge(0.1)), ("two", models.ridge(10.0))):
            scored = models.fit(rows.filter(f"fold % 2 <> {f}"), r).transform(rows.filter(f"fold % 2 = {f}"))
            want |= {(x.sample_id, name): x.p for x in scored.select("sample_id", models.price_of("prediction").alias("p")).collect()}
    calls = counted(monkeypatch, models, "preparation")
    got = {(x.sample_id, x.model): x.y_pred for x in models.out_of_fold(rows, {"one": models.ridge(0.1), "two": models.ridge(10.0)}, 2).collect()}
    assert len(calls) == 2 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    calls.clear()
    found = models.search(rows, lambda **s: models.RandomForestRegressor(seed=1, **s), models.draws({"numTrees": [2], "maxDepth": [1, 2]}, 2), 2).collect()
    assert len(calls) == 2 and len(found) == 2


def test_rows_are_dealt_and_pivoted_once(spark, monkeypatch):
    from shelfwise.plans import modeling

    rows = modeling.spread_rows(spark, SF)
    calls = counted(monkeypatch, models, "number_rows")
    rise = models.permutation_importance(models.fit(rows, models.ridge(1.0)), rows, models.inputs())
    assert len(calls) == 2 and "Join" not in rise._jdf.queryExecution().toString()
    assert len(rise.collect()) == len(models.inputs())
    stacked = modeling.ensemble_stacking(spark, SF)
    assert "pivot" not in stacked._jdf.queryExecution().toString().lower() and stacked.count() == stacked.select("sample_id").distinct().count()


# forests of the reference's size


def test_forests_have_all_their_trees(spark, monkeypatch):
    from shelfwise.plans import modeling

    made, real = [], models.RandomForestRegressor.fit
    monkeypatch.setattr(models.RandomForestRegressor, "fit", lambda self, *a: (made.append(real(self, *a)), made[-1])[1])
    out = modeling.train_forest(spark, SF).collect()
    for bootstrap in (True, False):
        some = [m for m in made if m.getBootstrap() is bootstrap]
        assert sum(m.getNumTrees for m in some) == 200 and {m.getMaxDepth() for m in some} == {20}
        assert max(t.depth for m in some for t in m.trees) > 5
    held = modeling.spread_rows(spark, SF).filter("fold = 0")
    assert {(r.model, r.sample_id) for r in out} == {(n, r.sample_id) for n in ("forest", "extra_forest") for r in held.collect()}
    assert len(out) == 2 * held.count()


@pytest.mark.parametrize("nodes", [2_000_000, 50])
def test_lots_of_trees_are_one_forest(spark, monkeypatch, nodes):
    monkeypatch.setattr(models, "TREES_A_FIT", 3)
    monkeypatch.setattr(models, "NODES_AT_ONCE", nodes)
    monkeypatch.setattr(models, "ROWS_A_FITTING_TASK", 200)
    made, real = [], models.RandomForestRegressor.fit
    monkeypatch.setattr(models.RandomForestRegressor, "fit", lambda self, *a: (made.append(real(self, *a)), made[-1])[1])
    products = catalog(spark).filter("catalog_content is not null").withColumn("sample_id", F.when(F.col("sample_id") % 15 == 0, "same").when(F.col("sample_id") % 25 != 5, F.col("sample_id")))
    rows = models.model_table(products.repartition(5)).withColumn("label", F.col("label") + F.rand(7)).persist()
    train, test = models.prepared(rows.filter("fold <> 0"), rows.filter("fold = 0"), "sample_id", "price")
    got = models.grown(train, test, {"forest": models.forests(7, 9)["forest"]})
    assert [(n, t) for n, t in got.dtypes] == [("model", "string"), ("sample_id", "string"), ("price", "double"), ("y_pred", "double")]
    assert sorted(m.getNumTrees for m in made) == ([1, 3, 3] if nodes > 50 else [1] * 7)
    trees = [t.toDebugString.split("\n", 1)[1] for m in made for t in m.trees]
    assert len(set(trees)) == 7
    key = lambda r: (r[0] or "", r[1], r[2])
    want = [(r.sample_id, r.price, max(np.expm1(np.mean([t.predict(r.features) for m in made for t in m.trees])), models.LEAST_PRICE)) for r in test.collect()]
    found = sorted(((r.sample_id, r.price, r.y_pred) for r in got.collect()), key=key)
    want.sort(key=key)
    assert len({r[0] for r in want}) < len(want)  # ids are repeated or missing
    assert [r[:2] for r in found] == [r[:2] for r in want] and np.allclose([r[2] for r in found], [r[2] for r in want])
    rows.unpersist()
