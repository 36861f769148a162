"""Preprocessing, models, grids and backtests against solutions of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ml
from tidemark.operators.backtest import by_horizon, forest_backtest, horizon_metrics, logit_backtest, rolling_backtest
from tidemark.operators.temporal import Rolling


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    out = []
    for d in range(40):
        for a in range(6):
            x, z = r.normal(), r.normal(1, 3)
            p = 1 / (1 + np.exp(-(0.8 * x - 0.4 * z + 0.3 * (a % 3))))
            out.append((f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", f"A{a}", f"i{a % 3}", "f", "1d" if a % 2 else "4d", 1.0 if x > 0 else -1.0, 1.0, float(abs(x)), float(x), float(r.random() < p), None if r.random() < 0.1 else float(z)))
    return out


@pytest.fixture(scope="module")
def data(spark, rows):
    df = spark.createDataFrame(rows, "date string, asset string, indicator_name string, signal_family string, horizon string, signal_direction double, signal_active double, signal_strength double, signal_signed_value double, target double, z double")
    return df.withColumn("date", F.col("date").cast("timestamp_ntz")).cache()


def design(rows):
    """The same inputs in numpy: medians for gaps, standard scores, one column a category."""
    numbers = np.array([[r[5], r[7], r[8], np.nan if r[10] is None else r[10]] for r in rows])
    medians = np.nanmedian(numbers, axis=0)
    numbers = np.where(np.isnan(numbers), medians, numbers)
    scaled = (numbers - numbers.mean(0)) / numbers.std(0)
    hot = [[float(r[c] == v) for c in (2, 3, 4) for v in sorted({q[c] for q in rows})] for r in rows]
    return np.hstack([scaled, np.array(hot)]), np.array([r[9] for r in rows]), medians


def newton(x, y, strength, steps=60):
    """Weights and intercept of a logit with a square penalty on the weights, for the summed loss."""
    w, full = np.zeros(x.shape[1] + 1), np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([strength] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), full.T @ (p - y) + ridge @ w)
    return w[:-1], w[-1]


def test_inputs_and_l2_logit(data, rows):
    x, y, medians = design(rows)
    model = ml.fit_logit(data, penalty="l2", C=0.5)
    pre = model.preprocessor
    assert [round(pre.medians[c], 12) for c in pre.numeric] == [round(m, 12) for m in medians]
    assert len(pre.names()) == x.shape[1]
    got = np.array([r.features.toArray() for r in pre.transform(data).orderBy("date", "asset").select("features").collect()])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))
    np.testing.assert_allclose(got, x[order], atol=1e-9)
    w, b = newton(x, y, 1 / 0.5)
    np.testing.assert_allclose(model.fitted.coefficients.toArray(), w, atol=2e-3)
    assert model.fitted.intercept == pytest.approx(b, abs=5e-3)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    scored = model.score(data).orderBy("date", "asset").select("pred_proba_success").collect()
    np.testing.assert_allclose([r[0] for r in scored], p[order], atol=2e-3)


def test_l1_is_sparser_and_classes_are_weighted(data):
    sparse, dense = (ml.sparsity(ml.fit_logit(data, penalty=p, C=0.02)) for p in ("l1", "l2"))
    assert sparse["n_nonzero"] < dense["n_nonzero"] and sparse["n_features"] == dense["n_features"] == len(ml.fit_logit(data, penalty="l1").weights())
    few = data.where("target = 0 OR asset = 'A1'")
    plain, even = (ml.fit_logit(few, penalty="l2", class_weight=w).score(few).agg(F.avg("pred_proba_success")).first()[0] for w in (None, "balanced"))
    assert plain == pytest.approx(few.agg(F.avg("target")).first()[0], abs=0.01) and abs(even - 0.5) < abs(plain - 0.5)
    with pytest.raises(ValueError):
        ml.fit_logit(data.where("target = 1"))


def test_unseen_categories_and_missing_columns(data, caplog):
    model = ml.fit_logit(data, penalty="l2")
    odd = data.limit(4).withColumn("indicator_name", F.lit("never seen")).drop("z")
    with caplog.at_level("WARNING"):
        assert model.score(odd).where("pred_proba_success BETWEEN 0 AND 1").count() == 4
    assert "z" in caplog.text
    features = model.preprocessor.transform(odd).first().features.toArray()
    assert features[4:7].tolist() == [0.0, 0.0, 0.0]


def test_grid_rows(data):
    got = ml.grid(ml.fit_logit, data, data, {"penalty": ["l2", "l1", "elasticnet", "none of these"], "l1_ratio": [0.2, 0.8], "C": [1.0]}).toPandas()
    assert len(got) == 5 and list(got["fit_ok"]) == [True] * 4 + [False]
    assert got["l1_ratio"].notna().sum() == 2 and (got["n_train_obs"] == data.count()).all() and got["log_loss"].dropna().is_monotonic_increasing
    assert got["error"].notna().sum() == 1


def test_forest_finds_the_signal(data):
    model = ml.fit_forest(data, trees=20, depth=4, leaf=5)
    weights = dict(model.weights())
    assert sum(weights.values()) == pytest.approx(1) and max(weights, key=weights.get) in ("signal_signed_value", "z", "signal_direction", "signal_strength")


def test_backtests(data):
    horizons, windows = {"1d": 1, "4d": 4}, Rolling(20, 6, 1)
    out = logit_backtest(data, splitter=windows, horizons=horizons)
    folds = {k for k, *_ in windows.folds(40)}
    oos = out["oos"].toPandas()
    assert set(oos["fold_id"]) == folds and not out["errors"]
    assert (oos["date"] >= oos["test_start"]).all() and (oos["train_end"] < oos["test_start"]).all() and (oos["n_test_rows"] == oos.groupby("fold_id")["date"].transform("size")).all()
    runs = by_horizon(data, logit_backtest, horizons, splitter=windows)
    assert {r.horizon: r.n_obs for r in horizon_metrics(runs).collect()} == {h: int((oos["horizon"] == h).sum()) for h in horizons}

    def fails_once(train, **settings):
        if train.agg(F.min("date")).first()[0].day == 1:
            raise RuntimeError("worker lost")
        return ml.fit_logit(train, penalty="l2")

    out = rolling_backtest(data, fails_once, windows, horizons)
    assert set(out["errors"]) == {0} and {r.fold_id for r in out["oos"].select("fold_id").distinct().collect()} == folds - {0}
    with pytest.raises(ValueError):
        forest_backtest(data.where("target = 1"), splitter=windows, horizons=horizons, trees=2)


def test_saved_models_score_alike(spark, data, tmp_path):
    for name, fit, options in (("logit", ml.fit_logit, {"penalty": "l2", "max_iter": 20}), ("crossed", ml.fit_logit, {"penalty": "l2", "max_iter": 20, "scaling": "cross_sectional"}), ("forest", ml.fit_forest, {"trees": 3, "depth": 3})):
        model = fit(data, **options)
        model.save(str(tmp_path / name))
        again = ml.load_model(spark, str(tmp_path / name))
        assert again.weights() == model.weights()
        a, b = (m.score(data).orderBy("date", "asset").select("pred_proba_success", "pred_class").collect() for m in (model, again))
        assert a == b


def test_calendars_from_elsewhere(spark, data):
    """A calendar with a date more for each of the rows' makes steps half as long; one that ends early purges more."""
    from tidemark.operators.batched import backtest_batched
    from tidemark.operators.temporal import calendar, purge

    days = data.select("date").distinct()
    twice = days.unionByName(days.select((F.col("date") + F.expr("INTERVAL 12 HOURS")).alias("date")))
    horizons = {"1d": 1, "4d": 4}
    last = {r.horizon: r.d for r in purge(data, horizons).groupBy("horizon").agg(F.max("date").alias("d")).collect()}
    far = {r.horizon: r.d for r in purge(data, horizons, dates=twice).groupBy("horizon").agg(F.max("date").alias("d")).collect()}
    end = data.agg(F.max("date")).first()[0]
    assert (end - last["4d"]).days == 4 and (end - far["4d"]).days == 2 and (end - last["1d"]).days == 1 and (end - far["1d"]).days == 0
    known = {r.date: r.pos for r in calendar(data, dates=days.where("date >= '2024-01-10'")).collect()}
    assert min(known) == data.where("date >= '2024-01-10'").agg(F.min("date")).first()[0] and sorted(known.values()) == list(range(len(known)))
    sparse = days.where("day(date) % 2 = 1")
    assert sorted({r.pos for r in calendar(data, dates=sparse).collect()}) == list(range(sparse.count())) and calendar(data, dates=sparse).count() == days.count()
    windows = Rolling(10, 3, 1)
    n = sparse.select(F.to_date("date")).distinct().count()
    for rows in (windows.assign(data, horizons, dates=sparse), backtest_batched(data, windows, horizons, dates=sparse)["oos"]):
        assert {r.fold_id for r in rows.select("fold_id").distinct().collect()} == {k for k, *_ in windows.folds(n)}
