"""Classifiers of signal success: inputs, preprocessing fitted on training rows, logit and forest, grids."""

from __future__ import annotations

import itertools
import json
import logging
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dataset import infer_context
from .medians import discard, medians
from .metrics import classification_metrics, score_columns

log = logging.getLogger(__name__)

KEYS = {"date", "asset", "timeframe", "indicator_name", "signal_family", "horizon", "target", "signal_active", "signal_direction", "signal_strength", "signal_signed_value", "fold_id", "block", "split", "y_true", "y_pred", "y_proba_pred", "period_train", "period_test", "period_embargo", "n_train_rows_raw", "n_train_rows_after_purge", "n_train_rows_purged", "n_test_rows"}
CATEGORIES = ("indicator_name", "signal_family", "horizon")
LOGIT = {"penalty": "elasticnet", "C": 1.0, "l1_ratio": 0.5, "max_iter": 200, "class_weight": None, "scaling": "classical"}
FOREST = {"trees": 400, "depth": 8, "leaf": 20, "features": "sqrt", "class_weight": None, "seed": 42}


def model_inputs(df: DataFrame, with_active: bool = False, with_asset: bool = False, extra_numeric=(), extra_categories=()) -> tuple[list[str], list[str]]:
    """Numeric and categorical features of a dataset."""
    numeric = ["signal_direction", "signal_strength", "signal_signed_value", *(["signal_active"] if with_active else []), *infer_context(df, KEYS), *extra_numeric]
    categories = [*CATEGORIES, *(["asset"] if with_asset else []), *extra_categories]
    return list(dict.fromkeys(x for x in numeric if x in df.columns)), [x for x in categories if x in df.columns]


def cross_sectional_scale(df: DataFrame, numeric: list[str], by=("date", "horizon"), min_std: float = 1e-12) -> DataFrame:
    """Each number less its group's mean over its deviation; null with fewer than two values or none apart."""
    w = Window.partitionBy(*[b for b in by if b in df.columns])
    std = {c: F.stddev_samp(c).over(w) for c in numeric}
    return df.withColumns({c: F.when((F.count(c).over(w) >= 2) & (std[c] >= min_std), (F.col(c) - F.avg(c).over(w)) / F.nullif(std[c], F.lit(0.0))) for c in numeric})


@dataclass
class Preprocessor:
    """Medians for gaps, standard scores and one-hot categories, all learned from the training rows; unseen categories are all zeros."""

    numeric: list[str]
    categories: list[str]
    scaling: str = "classical"
    medians: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    stages: object = None

    def fit(self, train: DataFrame) -> Preprocessor:
        if self.scaling == "cross_sectional":
            train = cross_sectional_scale(train, self.numeric)
        if self.numeric:
            made = medians(train, self.numeric)
            self.medians = {r["column"]: r["median"] if r["median"] is not None else 0.0 for r in made.collect()}  # a row a column
            discard(made)
        if self.scaling == "classical" and self.numeric:
            filled = [F.coalesce(c, F.lit(self.medians[c])) for c in self.numeric]
            row = train.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(filled) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
            self.scales = {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(self.numeric)}
        index = StringIndexer(inputCols=[f"__c_{c}" for c in self.categories], outputCols=[f"__i_{c}" for c in self.categories], stringOrderType="alphabetAsc", handleInvalid="keep")
        hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"__h_{c}" for c in self.categories], dropLast=True)  # the last is the indexer's unseen value
        gather = VectorAssembler(inputCols=[f"__n_{c}" for c in self.numeric] + hot.getOutputCols(), outputCol="features")
        self.stages = Pipeline(stages=[index, hot, gather]).fit(self._ready(train))
        return self

    def _ready(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.numeric + self.categories if c not in df.columns]
        if missing:
            log.warning("columns missing in scoring, taken as null: %s", ", ".join(missing))
        df = df.withColumns({c: F.lit(None).cast("string" if c in self.categories else "double") for c in missing}) if missing else df
        center = {c: (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - self.scales.get(c, (0.0, 1.0))[0]) / self.scales.get(c, (0.0, 1.0))[1] for c in self.numeric}
        return df.withColumns({f"__n_{c}": x for c, x in center.items()} | {f"__c_{c}": F.coalesce(c, F.lit("missing")) for c in self.categories})

    def transform(self, df: DataFrame) -> DataFrame:
        if self.scaling == "cross_sectional":
            own = df.withColumns({f"__raw_{c}": F.col(c) for c in self.numeric if c in df.columns})
            out = self.stages.transform(self._ready(cross_sectional_scale(own, [c for c in self.numeric if c in df.columns])))
            out = out.withColumns({c: F.col(f"__raw_{c}") for c in self.numeric if c in df.columns})
        else:
            out = self.stages.transform(self._ready(df))
        return out.select(*df.columns, "features")

    def names(self) -> list[str]:
        indexed = self.stages.stages[0].labelsArray
        return list(self.numeric) + [f"{c}={label}" for c, labels in zip(self.categories, indexed) for label in labels]


@dataclass
class Model:
    preprocessor: Preprocessor
    fitted: object
    settings: dict

    def score(self, df: DataFrame) -> DataFrame:
        """df with pred_proba_success, pred_class and pred_log_odds."""
        out = self.fitted.transform(self.preprocessor.transform(df))
        return score_columns(out.withColumn("pred_proba_success", vector_to_array("probability")[1]).select(*df.columns, "pred_proba_success"))

    def weights(self) -> list[tuple[str, float]]:
        """Coefficients of a logit or importances of a forest, by feature."""
        got = self.fitted.coefficients if hasattr(self.fitted, "coefficients") else self.fitted.featureImportances
        return sorted(zip(self.preprocessor.names(), got.toArray().tolist()), key=lambda x: -abs(x[1]))


    def save(self, path: str) -> None:
        """Write the model below path: its stages as pyspark.ml writes them, medians, scales and settings as JSON."""
        spark, pre = SparkSession.getActiveSession(), self.preprocessor
        about = {"numeric": pre.numeric, "categories": pre.categories, "scaling": pre.scaling, "medians": pre.medians, "scales": pre.scales, "settings": self.settings, "kind": type(self.fitted).__name__}
        pre.stages.write().overwrite().save(f"{path}/stages")
        self.fitted.write().overwrite().save(f"{path}/fitted")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


FITTED = {c.__name__: c for c in (LogisticRegressionModel, RandomForestClassificationModel)}


def load_model(spark: SparkSession, path: str) -> Model:
    """What Model.save wrote."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    pre = Preprocessor(about["numeric"], about["categories"], about["scaling"], about["medians"], {c: tuple(x) for c, x in about["scales"].items()}, PipelineModel.load(f"{path}/stages"))
    return Model(pre, FITTED[about["kind"]].load(f"{path}/fitted"), about["settings"])


def labelled(train: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Rows with a target, and how many there are of each class; both must be there."""
    rows = train.where(F.col("target").isNotNull())
    counts = {r.target: r["n"] for r in rows.groupBy("target").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if set(counts) != {0.0, 1.0}:
        raise ValueError(f"the target needs the classes 0 and 1, not {sorted(counts)}")
    return rows, {int(k): v for k, v in counts.items()}


def weighted(rows: DataFrame, counts: dict[int, int], class_weight) -> DataFrame:
    total = sum(counts.values())
    w = {k: total / (2 * v) for k, v in counts.items()} if class_weight == "balanced" else {k: float((class_weight or {}).get(k, 1.0)) for k in counts}
    return rows.withColumn("__w", F.when(F.col("target") == 1, F.lit(w[1])).otherwise(F.lit(w[0]))), sum(counts[k] * w[k] for k in counts)


def trained(pre: Preprocessor, estimator, rows: DataFrame, settings: dict) -> Model:
    """Fit on rows that stay in memory (or on disk) for the solver's passes."""
    ready = pre.transform(rows).select("features", "target", "__w").persist()
    try:
        return Model(pre, estimator.fit(ready), settings)
    finally:
        ready.unpersist()


def fit_logit(train: DataFrame, **settings) -> Model:
    """Penalised logistic regression: l1, l2 or elasticnet of strength 1 / C over the summed loss."""
    s = LOGIT | settings
    rows, counts = labelled(train)
    rows, total = weighted(rows, counts, s["class_weight"])
    pre = Preprocessor(*model_inputs(rows, s.get("with_active", False), s.get("with_asset", False)), s["scaling"]).fit(rows)
    alpha = {"l1": 1.0, "l2": 0.0, "elasticnet": s["l1_ratio"]}[s["penalty"]]
    logit = LogisticRegression(labelCol="target", weightCol="__w", regParam=1 / (s["C"] * total), elasticNetParam=alpha, standardization=False, maxIter=s["max_iter"], tol=1e-8)
    return trained(pre, logit, rows, s)


def fit_forest(train: DataFrame, **settings) -> Model:
    s = FOREST | settings
    rows, counts = labelled(train)
    rows, _ = weighted(rows, counts, s["class_weight"])
    pre = Preprocessor(*model_inputs(rows), "none").fit(rows)
    forest = RandomForestClassifier(labelCol="target", weightCol="__w", numTrees=s["trees"], maxDepth=s["depth"], minInstancesPerNode=s["leaf"], featureSubsetStrategy=s["features"], seed=s["seed"])
    return trained(pre, forest, rows, s)


def combinations(options: dict[str, list]) -> list[dict]:
    """All settings; l1_ratio varies with the elastic net only."""
    out = []
    for values in itertools.product(*options.values()):
        chosen = dict(zip(options, values))
        if "l1_ratio" in chosen and chosen.get("penalty", "elasticnet") != "elasticnet":
            chosen["l1_ratio"] = None
        if chosen not in out:
            out.append(chosen)
    return out


def grid(fit, train: DataFrame, validation: DataFrame, options: dict[str, list], fixed: dict | None = None) -> DataFrame:
    """A row a combination: its settings (a column each), fit_ok, error, rows and target rate of training, validation metrics; best log loss first.

    Combinations are few, rows stay in Spark; a setting that can't be fitted is a row of the report.
    """
    spark, rows = train.sparkSession, []
    n, rate = train.where("target IS NOT NULL").agg(F.count(F.lit(1)), F.avg("target")).first()
    names = list(options)
    kinds = {k: "double" if all(v is None or isinstance(v, (int, float)) for v in options[k]) else "string" for k in names}
    told = ("n_obs", "target_rate", "accuracy", "f1", "roc_auc", "log_loss", "brier_score")
    for chosen in combinations(options):
        own = [None if (v := chosen[k]) is None else float(v) if kinds[k] == "double" else str(v) for k in names]
        try:
            got = classification_metrics(fit(train, **(fixed or {}), **{k: v for k, v in chosen.items() if v is not None}).score(validation)).first()
            rows.append((*own, True, None, n, rate, *[got[c] for c in told]))
        except Exception as e:
            rows.append((*own, False, str(e)[:200], n, rate, *[None] * len(told)))
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in names], "fit_ok boolean, error string, n_train_obs long, target_rate_train double, n_obs long", *[f"{c} double" for c in told[1:]]])
    return spark.createDataFrame(rows, schema).orderBy(F.desc("fit_ok"), F.asc_nulls_last("log_loss"), F.asc_nulls_last("brier_score"), F.desc_nulls_last("roc_auc"))


def sparsity(model: Model) -> dict:
    """How many of a logit's coefficients are not zero."""
    values = [w for _, w in model.weights()]
    kept = sum(w != 0 for w in values)
    return {"n_features": len(values), "n_nonzero": kept, "share_zero": 1 - kept / max(1, len(values))}


LOGIT_GRID = {"penalty": ["l2", "l1", "elasticnet"], "C": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.2, 0.5, 0.8]}
FOREST_GRID = {"trees": [300, 500], "depth": [6, 8, 12], "leaf": [10, 20, 50], "features": ["sqrt"], "class_weight": [None, "balanced"]}


def logit_grid(train: DataFrame, validation: DataFrame, options: dict | None = None, **fixed) -> DataFrame:
    return grid(fit_logit, train, validation, options or LOGIT_GRID, fixed)


def forest_grid(train: DataFrame, validation: DataFrame, options: dict | None = None, **fixed) -> DataFrame:
    return grid(fit_forest, train, validation, options or FOREST_GRID, fixed)
