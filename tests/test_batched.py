"""Batched logits against Newton's method in numpy, fold by fold, and their score equations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import batched, ml
from tidemark.operators.temporal import Rolling

HORIZONS = {"1d": 1, "4d": 4}
WINDOWS = Rolling(20, 6, 1)


@pytest.fixture(scope="module")
def rows():
    r, out = np.random.default_rng(4), []
    for d in range(40):
        for a in range(6):
            x, z = r.normal(), r.normal(1000, 3)
            p = 1 / (1 + np.exp(-(0.8 * x - 0.4 * (z - 1000) + 0.3 * (a % 3))))
            name = f"i{a % 3}" if d > 15 or a % 3 < 2 else "i0"
            out.append((f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", f"A{a}", name, "f", "1d" if a % 2 else "4d", 1.0 if x > 0 else -1.0, 1.0, float(abs(x)), float(x), float(r.random() < p), None if r.random() < 0.1 else float(z)))
    return out


@pytest.fixture(scope="module")
def data(spark, rows):
    df = spark.createDataFrame(rows, "date string, asset string, indicator_name string, signal_family string, horizon string, signal_direction double, signal_active double, signal_strength double, signal_signed_value double, target double, z double")
    return df.withColumn("date", F.col("date").cast("timestamp_ntz")).cache()


def design(rows):
    numbers = np.array([[r[5], r[7], r[8], np.nan if r[10] is None else r[10]] for r in rows])
    numbers = np.where(np.isnan(numbers), np.nanmedian(numbers, axis=0), numbers)
    hot = [[float(r[c] == v) for c in (2, 3, 4) for v in sorted({q[c] for q in rows})] for r in rows]
    return np.hstack([(numbers - numbers.mean(0)) / numbers.std(0), np.array(hot), np.ones((len(rows), 1))]), np.array([r[9] for r in rows])


def newton(x, y, w, strength):
    b, ridge = np.zeros(x.shape[1]), np.diag([strength] * (x.shape[1] - 1) + [0.0])
    for _ in range(80):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(b)), x.T @ (w * (p - y)) + ridge @ b)
    return b


def test_spans_say_what_assign_says(data):
    for windows in (WINDOWS, Rolling(10, 3, 0), Rolling(39, 5, 5), Rolling(45, 5, 5)):
        spans = windows.train_spans(data, HORIZONS).where("__lo <= __hi").select("date", "asset", F.explode(F.sequence("__lo", "__hi")).alias("fold_id"))
        want = windows.assign(data, HORIZONS).where("block = 'train'").select("date", "asset", "fold_id")
        assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, want.collect()))


def test_l2_folds_equal_newton(data, rows):
    settings = [{"penalty": "l2", "C": 0.5}, {"penalty": "l2", "C": 5.0, "class_weight": "balanced"}]
    fits = batched.fit_batched(WINDOWS.train_spans(data, HORIZONS), settings)
    assert len(fits.models) == 2 * len(WINDOWS.folds(40)) and not fits.errors
    days = sorted({r[0] for r in rows})
    for k, first, end, *_ in WINDOWS.folds(40):
        own = [r for r in rows if first <= (p := days.index(r[0])) < end and p + HORIZONS[r[4]] < end]
        x, y = design(own)
        for i, strength in ((0, 2.0), (1, 0.2)):
            w = np.ones(len(y)) if i == 0 else np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
            got = next(m for m in fits.models if (m.fold, m.setting) == (k, i))
            want = newton(x, y, w, strength)
            np.testing.assert_allclose(x @ got.beta, x @ want, atol=1e-6)
            np.testing.assert_allclose(got.beta[:4], want[:4], atol=1e-6)


@pytest.mark.parametrize("penalty,share", [("l1", 1.0), ("elasticnet", 0.5)])
def test_corners_are_met(data, rows, penalty, share):
    fits = batched.fit_batched(data.withColumns({"__lo": F.lit(0), "__hi": F.lit(0)}), [{"penalty": penalty, "C": 0.05, "l1_ratio": share}])
    x, y = design(rows)
    b, l1, l2 = fits.models[0].beta, share / 0.05, (1 - share) / 0.05
    slope = x.T @ (1 / (1 + np.exp(-x @ b)) - y) + l2 * np.append(b[:-1], 0)
    zero = b[:-1] == 0
    assert zero.any() and not zero.all()
    assert (np.abs(slope[:-1][zero]) <= l1 + 1e-5).all() and np.allclose(slope[:-1][~zero], -l1 * np.sign(b[:-1][~zero]), atol=1e-5) and abs(slope[-1]) < 1e-5
    told = {f: v for _, _, f, v in fits.score_rows()}
    np.testing.assert_allclose(list(told.values()), x.T @ y, atol=1e-4)
    names = ml.fit_logit(data, penalty="l2").preprocessor.names()
    assert list(told) == [*names, "intercept"] and [f for *_, f, _ in fits.coefficients()] == [*names, "intercept"]


def test_backtest_equals_the_one_by_one_fits(data):
    from tidemark.operators.backtest import rolling_backtest

    out, one = batched.backtest_batched(data, WINDOWS, HORIZONS, C=0.5), rolling_backtest(data, ml.fit_logit, WINDOWS, HORIZONS, penalty="l2", C=0.5)
    assert set(out["oos"].columns) == set(one["oos"].columns)
    key = ["fold_id", "date", "asset"]
    a, b = (x["oos"].toPandas().sort_values(key).reset_index(drop=True) for x in (out, one))
    assert len(a) == len(b) and (a[["fold_id", "train_start", "test_end", "n_train_rows_after_purge", "n_test_rows"]] == b[["fold_id", "train_start", "test_end", "n_train_rows_after_purge", "n_test_rows"]]).all().all()
    np.testing.assert_allclose(a["y_proba_pred"], b["y_proba_pred"], atol=5e-3)
    out["release"]()


def test_jobs_do_not_grow_with_folds(spark, data):
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for i, windows in enumerate((Rolling(20, 18, 1), Rolling(20, 2, 1))):
        spark.sparkContext.setJobGroup(f"folds-{i}", "")
        batched.fit_batched(windows.train_spans(data, HORIZONS), [{"penalty": "l2", "C": 0.5}])
        counts.append(len(tracker.getJobIdsForGroup(f"folds-{i}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(Rolling(20, 2, 1).folds(40)) >= 5 * len(Rolling(20, 18, 1).folds(40)) and counts[1] <= 1.5 * counts[0]


def test_cross_sectional_scaling_and_one_class(data):
    out = batched.backtest_batched(data, WINDOWS, HORIZONS, C=0.5, scaling="cross_sectional")
    assert out["oos"].where("y_proba_pred BETWEEN 0 AND 1").count() == out["oos"].count() > 0
    with pytest.raises(ValueError):
        batched.backtest_batched(data.where("target = 1"), WINDOWS, HORIZONS)
    with pytest.raises(ValueError):
        batched.fit_batched(data.withColumns({"__lo": F.lit(0), "__hi": F.lit(0), "target": F.lit(2.0)}), [{}])


def test_grid_rows(data):
    options = {"penalty": ["l2", "l1", "elasticnet", "none of these"], "l1_ratio": [0.2, 0.8], "C": [1.0]}
    got, want = (g(*a).toPandas() for g, a in ((batched.grid_batched, (data, data, options)), (ml.grid, (ml.fit_logit, data, data, options))))
    assert list(got.columns) == list(want.columns) and len(got) == 5 and list(got["fit_ok"]) == [True] * 4 + [False]
    key = ["penalty", "l1_ratio"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    np.testing.assert_allclose(a["log_loss"].astype(float), b["log_loss"].astype(float), atol=1e-3)
