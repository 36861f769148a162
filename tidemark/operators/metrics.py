"""Metrics of scored rows: classification, ranks within groups, top-k hit rates, confusion tables."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
#: Probabilities are ranked within so many steps of about as many distinct values, so no window holds all of them.
SCORE_STEPS = 1024


def binary(df: DataFrame, column: str) -> Column:
    """The column as 0, 1 or null; anything else raises an error when it is read."""
    c = F.col(column)
    return F.when(c.isNull() | c.isin(0, 1), c.cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{column} is not binary: "), c.cast("string"))).cast("int"))


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def score_columns(df: DataFrame, proba: str = "pred_proba_success") -> DataFrame:
    """Class (1 from a probability of 0.5) and log odds."""
    p = clipped(F.col(proba))
    return df.withColumns({"pred_class": (F.col(proba) >= 0.5).cast("int"), "pred_log_odds": F.ln(p / (1 - p))})


def with_steps(each: DataFrame, column: str, steps: int = SCORE_STEPS) -> DataFrame:
    """each with step, ascending with the column: bounds are quantiles of a sketch, however close its values lie. The bounds (steps + 1 numbers) come to the driver."""
    found = each.agg(F.percentile_approx(column, F.array(*[F.lit(k / steps) for k in range(steps + 1)]), 10 * steps)).first()[0] or [0.5]
    bounds = [-math.inf, *sorted({x for x in found if x == x}), math.inf]
    return Bucketizer(splits=bounds, inputCol=column, outputCol="step", handleInvalid="keep").transform(each).withColumn("step", F.col("step").cast("int"))


def classification_metrics(df: DataFrame, by: list[str] | None = None, target: str = "target", proba: str = "pred_proba_success") -> DataFrame:
    """n_obs, target_rate, accuracy, f1, roc_auc (null with one class), log_loss, brier_score, of rows with target and probability.

    The area under the ROC comes from tie-averaged ranks of distinct probabilities, counted before the ranking.
    """
    by = by or []
    rows = df.where(F.col(target).isNotNull() & F.col(proba).isNotNull()).select(*by, F.col(target).cast("double").alias("y"), F.col(proba).cast("double").alias("p"))
    q = clipped(F.col("p"))
    hit = F.col("y") == 1
    at = F.col("p") >= 0.5
    each = rows.groupBy(*by, "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("n1"), F.sum(F.when(hit == at, 1).otherwise(0)).alias("right"), F.sum(F.when(hit & at, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit & at, 1).otherwise(0)).alias("fp"), F.sum(F.when(hit & ~at, 1).otherwise(0)).alias("fn"),
        F.sum(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("loss"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
    )
    # rows below a probability: those of lower steps (SCORE_STEPS + 1 at most, in one window a group), and those below it in its step
    each = with_steps(each, "p")
    before = Window.unboundedPreceding
    steps = each.groupBy(*by, "step").agg(F.sum("n").alias("m")).withColumn("lower", F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("step").rowsBetween(before, -1)), F.lit(0)))
    steps = steps.select(*[F.col(b).alias(f"s_{b}") for b in by], F.col("step").alias("s_step"), "lower")
    same = F.col("step") == F.col("s_step")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"s_{b}"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "step").orderBy("p").rowsBetween(before, -1)), F.lit(0))
    ranked = each.withColumn("inside", inside).join(steps, same).withColumn("rank_sum", F.col("n1") * (F.col("lower") + F.col("inside") + (F.col("n") + 1) / 2))
    n, n1 = F.sum("n"), F.sum("n1")
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    f1 = F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    auc = (F.sum("rank_sum") - n1 * (n1 + 1) / 2) / F.nullif(n1 * (n - n1), F.lit(0))
    return ranked.groupBy(*by).agg(n.alias("n_obs"), (n1 / n).alias("target_rate"), (F.sum("right") / n).alias("accuracy"), f1.alias("f1"), auc.alias("roc_auc"), (F.sum("loss") / n).alias("log_loss"), (F.sum("brier") / n).alias("brier_score"))


def add_ranks(df: DataFrame, by: list[str], proba: str = "pred_proba_success", tie: str = "indicator_name") -> DataFrame:
    """rank_pred_proba (1 is the highest; ties by name) and rank_pct_pred_proba (ascending, ties averaged); null without a probability."""
    p, w = F.col(proba), Window.partitionBy(*by)
    some = F.when(p.isNotNull(), 1)
    first = F.row_number().over(w.orderBy(p.desc_nulls_last(), tie))
    low = F.rank().over(w.orderBy(p.asc_nulls_last()))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, proba))
    return df.withColumns({"rank_pred_proba": some * first.cast("double"), "rank_pct_pred_proba": some * (low + (same - 1) / 2) / F.nullif(F.count(p).over(w), F.lit(0))})


def top_k_detail(df: DataFrame, by: list[str], k: int = 3, target: str = "target", proba: str = "pred_proba_success", tie: str = "indicator_name") -> DataFrame:
    """One row a group: base and top-k hit rates and their lift (null where the base is 0); ranks and rates in two steps over one dealing."""
    rows = df.where(F.col(target).isNotNull() & F.col(proba).isNotNull())
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(proba), tie)))
    top, y = F.col("__r") <= k, F.col(target).cast("double")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("group_size"), F.count(target).alias("valid_target_count"), F.count_if(top).alias("top_k_count"), F.count(F.when(top, y)).alias("top_k_valid_target_count"),
        F.avg(y).alias("base_hit_rate_group"), F.avg(F.when(top, y)).alias("top_k_hit_rate_group"), F.avg(proba).alias("mean_pred_proba_group"), F.avg(F.when(top, F.col(proba))).alias("top_k_mean_pred_proba_group"),
    )
    return out.withColumn("lift_group", F.col("top_k_hit_rate_group") / F.nullif("base_hit_rate_group", F.lit(0.0)))


def top_k_summary(detail: DataFrame, k: int = 3) -> DataFrame:
    base, top = F.avg("base_hit_rate_group"), F.avg("top_k_hit_rate_group")
    return detail.agg(
        F.count(F.lit(1)).alias("n_groups"), base.alias("mean_base_hit_rate"), top.alias("mean_top_k_hit_rate"), (top / F.nullif(base, F.lit(0.0))).alias("lift_of_means"), (top - base).alias("gap"), F.avg("lift_group").alias("mean_lift"),
        F.count_if(F.col("group_size") < k).alias("groups_smaller_than_k"), F.count_if(F.col("base_hit_rate_group") == 0).alias("groups_with_zero_base"), F.count_if(F.col("valid_target_count") < F.col("group_size")).alias("groups_with_missing_target"),
    )


def confusion(df: DataFrame, by: list[str] | None = None, target: str = "target", predicted: str = "pred_class") -> DataFrame:
    """tn, fp, fn, tp and their shares of true rows, predicted rows and all (null sums give 0)."""
    t, p = binary(df, target), binary(df, predicted)
    rows = df.select(*(by or []), t.alias("t"), p.alias("p")).where("t IS NOT NULL AND p IS NOT NULL")
    cell = {n: F.count_if((F.col("t") == a) & (F.col("p") == b)) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))}
    out = rows.groupBy(*(by or [])).agg(*[v.alias(n) for n, v in cell.items()])
    share = lambda n, of: F.coalesce(F.col(n) / F.nullif(sum((F.col(x) for x in of), F.lit(0)), F.lit(0)), F.lit(0.0))
    sides = {"true": {"tn": ("tn", "fp"), "fp": ("tn", "fp"), "fn": ("fn", "tp"), "tp": ("fn", "tp")}, "pred": {"tn": ("tn", "fn"), "fn": ("tn", "fn"), "fp": ("fp", "tp"), "tp": ("fp", "tp")}, "all": {n: ("tn", "fp", "fn", "tp") for n in cell}}
    return out.withColumns({f"{n}_{kind}": share(n, of[n]) for kind, of in sides.items() for n in cell})


def threshold_sweep(df: DataFrame, thresholds=(0.3, 0.5, 0.7), target: str = "target", proba: str = "pred_proba_success") -> DataFrame:
    """Confusion counts of several thresholds, in one pass."""
    rows = df.where(F.col(target).isNotNull() & F.col(proba).isNotNull())
    at = rows.select(F.col(target).alias("target"), F.col(proba).alias("__p"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return confusion(at.withColumn("pred_class", (F.col("__p") >= F.col("threshold")).cast("int")), ["threshold"])
