"""Rolling backtests: fit each fold's purged training rows, score its test rows, put the folds together."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batched import backtest_batched
from .metrics import add_ranks, classification_metrics, confusion, top_k_detail, top_k_summary
from .ml import fit_forest, fit_logit
from .targets import HORIZONS, normalize_horizons
from .temporal import Rolling

log = logging.getLogger(__name__)


def rolling_backtest(dataset: DataFrame, fit=fit_logit, splitter: Rolling = Rolling(), horizons=HORIZONS, **settings) -> dict:
    """oos (scored test rows with ranks and their fold's dates and counts), folds, fold_metrics, metrics, errors.

    Every fold is run; one that fails, for whatever reason, is logged and left out. Rows are dealt to folds in one
    projection and kept; scored folds are tables until read, and release() lets the rows go when they have been.
    """
    assigned = splitter.assign(dataset, horizons).persist()
    told = splitter.summary(assigned).orderBy("fold_id").collect()  # a row a fold
    scored, errors = [], {}
    for k in (r.fold_id for r in told):
        own = assigned.where(F.col("fold_id") == k)
        try:
            model = fit(own.where("block = 'train'").drop("fold_id", "block"), **settings)
            scored.append(model.score(own.where("block = 'test'").drop("block")))
        except Exception as e:
            log.warning("fold %s left out: %s", k, e)
            errors[k] = str(e)[:500]
    if not scored:
        assigned.unpersist()
        raise ValueError(f"no fold could be fitted: {errors}")
    spark = dataset.sparkSession
    folds = spark.createDataFrame(told, "fold_id int, train_start timestamp_ntz, train_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz, n_train_rows_raw long, n_train_rows_after_purge long, n_train_rows_purged long, n_test_rows long")
    folds = folds.withColumns({"period_train": F.lit(splitter.train), "period_test": F.lit(splitter.test), "period_embargo": F.lit(splitter.embargo)})
    oos = reduce(DataFrame.unionByName, scored)
    oos = oos.withColumns({"y_true": F.col("target"), "y_pred": F.col("pred_class"), "y_proba_pred": F.col("pred_proba_success")}).join(F.broadcast(folds), "fold_id")
    oos = add_ranks(oos, ["date", "asset", "horizon"])
    return {"oos": oos, "folds": folds, "fold_metrics": classification_metrics(oos, ["fold_id"]), "metrics": classification_metrics(oos), "errors": errors, "release": assigned.unpersist}


def logit_backtest(dataset: DataFrame, **options) -> dict:
    """All folds in common passes (batched.py). A solver's iterations (max_iter) are no setting of it: it goes on until the score equations are met."""
    return backtest_batched(dataset, **{k: v for k, v in options.items() if k != "max_iter"})


def forest_backtest(dataset: DataFrame, **options) -> dict:
    return rolling_backtest(dataset, fit_forest, **({"depth": 6, "leaf": 20, "class_weight": "balanced"} | options))


def by_horizon(dataset: DataFrame, run=logit_backtest, horizons=HORIZONS, **options) -> dict[str, dict]:
    """A backtest of its own for each horizon; one that can't be fitted (its rows are all purged, say) is logged and left out."""
    out = {}
    for h, k in normalize_horizons(horizons).items():
        try:
            out[h] = run(dataset.where(F.col("horizon") == h), horizons={h: k}, **options)
        except ValueError as e:
            log.warning("horizon %s left out: %s", h, e)
    if not out:
        raise ValueError("no horizon could be fitted")
    return out


def horizon_metrics(runs: dict[str, dict]) -> DataFrame:
    """The metrics of by_horizon, a row a horizon."""
    return reduce(DataFrame.unionByName, [r["metrics"].withColumn("horizon", F.lit(h)) for h, r in runs.items()])


def top_k(oos: DataFrame, by=("date", "asset", "horizon"), k: int = 3) -> tuple[DataFrame, DataFrame]:
    detail = top_k_detail(oos, list(by), k)
    return detail, top_k_summary(detail, k)


def confusion_of(oos: DataFrame) -> DataFrame:
    target = next(c for c in ("y_true", "target") if c in oos.columns)
    return confusion(oos, None, target, next(c for c in ("y_pred", "pred_class") if c in oos.columns))


def plot_confusion(table: DataFrame, ax=None):
    """A figure of a confusion table's one row; needs matplotlib, which nothing else here does."""
    import matplotlib.pyplot as plt

    row = table.first()
    ax = ax or plt.subplots()[1]
    ax.imshow([[row.tn_true, row.fp_true], [row.fn_true, row.tp_true]], vmin=0, vmax=1)
    for y, x, n in ((0, 0, row.tn), (0, 1, row.fp), (1, 0, row.fn), (1, 1, row.tp)):
        ax.text(x, y, n, ha="center")
    return ax
